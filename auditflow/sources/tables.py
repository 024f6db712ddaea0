"""Reading and writing: corpus tables, audit log, vault, requests and event streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditflow.functions.json import STRICT, is_object, truthy
from auditflow.functions.text import strip
from auditflow.operators.auditlog import LOG_DDL, RECENT, recent
from auditflow.operators.semantic import DEFAULT_MODEL, DEFAULT_TEMPERATURE

EVENT_DDL = (
    "user string, machine string, session_id string, seq bigint, ts timestamp, source string, "
    "text string, paused boolean"
)
REQUEST_DDL = "text string, scenario_id string, mask_mode string, model_id string, api_key string, temperature string, source string"
# The entry as it stands in an exported log, with preformatted times.
_ENTRY_DDL = (
    "id bigint, timestamp string, source string, machine string, user string, threats_count int, "
    "categories array<string>, original_text string, sanitized_text string, "
    "vault map<string,string>, status string"
)
EMPTY_TEXT, BAD_BODY = "Text cannot be empty.", "Invalid JSON body"


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, *key: str, rows: int | None = None) -> DataFrame:
    """Spread ``df`` over the cluster if it was read as fewer splits than there are cores.

    Scanning text is CPU-bound, and a table in one small file is one split.  A table
    with enough splits is left alone: it is not shuffled.  Where the texts are made from narrow
    columns a split stands for far more text than its bytes tell: ``rows`` is how many a task
    may get, so that tasks grow in number and not in length.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if rows is not None:
        tasks = max(4 * cores, -(-df.count() // rows))
        return df if splits >= tasks else df.repartition(tasks, *key)
    return df if splits >= cores else df.repartition(4 * cores, *key)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """A log exported as a JSON array; a missing, broken or other file gives no rows."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_DDL)
    lists = files.where(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["))
    rows = lists.select(F.inline(F.from_json("value", f"array<struct<{_colons(_ENTRY_DDL)}>>")))
    return rows.select("id", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
                       *[c for c in rows.columns if c not in ("id", "timestamp")])


def _colons(ddl: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in ddl.split(", "))


def append_audit_log(log: DataFrame, path: str) -> None:
    """Append entries to the log table; nothing written before is touched."""
    dated = log.withColumn("event_date", F.to_date("ts"))
    # Else every task would write a file for each date; dates with many entries are split again.
    dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own folder, so that a replay replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def export_audit_log(log: DataFrame, path: str, date: str, n: int = RECENT,
                     order: tuple[str, ...] = ("id",)) -> None:
    """Write the newest entries as JSON under a dated folder."""
    recent(log, n, order).write.mode("overwrite").json(f"{path}/date={date}")


def normalise_requests(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """Parse request bodies, fill in the defaults and mark what is rejected in ``error``.

    Syntax is strict, types are lenient: a number may be written as a string, and any value
    that is neither empty nor zero switches the stored audit on.
    """
    kept = [c for c in bodies.columns if c != body_col]
    checked = bodies.select(*kept, body_col, (~is_object(F.col(body_col))).alias("_bad"))
    parsed = checked.select(*kept, body_col, "_bad", F.when(~F.col("_bad"), F.from_json(body_col, REQUEST_DDL, STRICT)).alias("r"))

    def given(field: str, default) -> Column:
        return F.coalesce(F.col(f"r.{field}"), F.lit(default)).alias(field)

    text = strip(F.coalesce("r.text", F.lit("")))
    rows = parsed.select(
        *kept, text.alias("text"), F.col("r.scenario_id").alias("scenario_id"),
        truthy(F.col(body_col), "use_cached_benchmark").alias("use_cached_benchmark"), given("mask_mode", "synthetic"), given("model_id", DEFAULT_MODEL),
        (strip(F.coalesce("r.api_key", F.lit(""))) != "").alias("has_key"),
        given("source", "web_app"),
        F.when(F.col("r.temperature").isNull(), DEFAULT_TEMPERATURE).otherwise(F.col("r.temperature").try_cast("double")).alias("temperature"), "_bad",
    )
    return rows.withColumn("error", F.when(F.col("_bad"), BAD_BODY).when(F.col("text") == "", EMPTY_TEXT)).drop("_bad")


def split_requests(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted and the rejected requests."""
    return normalised.where(F.col("error").isNull()).drop("error"), normalised.where(F.col("error").isNotNull())


def ingest_interceptions(events: DataFrame) -> DataFrame:
    """Fill the defaults of reported interceptions; ``logged`` marks those worth an entry."""
    original, sanitized = F.col("original_text"), F.col("sanitized_text")
    logged = (original != "") & (sanitized != "") & (original != sanitized)
    return events.withColumns({
        "source": F.coalesce("source", F.lit("desktop")),
        "threats_count": F.coalesce("threats_count", F.lit(0)),
        "categories": F.coalesce("categories", F.array().cast("array<string>")),
        "vault": F.coalesce("vault", F.create_map().cast("map<string,string>")),
        "logged": F.coalesce(logged, F.lit(False)),
    })


def read_event_stream(spark: SparkSession, path: str, fmt: str = "json", schema: str = EVENT_DDL,
                      files_per_trigger: int | None = None) -> DataFrame:
    """Copy and paste events (and pause rows) from a folder, as they arrive."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
