"""The audit log: entries, retention, summaries, filters and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditflow.functions.lineage import cut
from auditflow.functions.text import contains_any
from auditflow.operators.anonymize import vault_entries

LOG_DDL = (
    "id bigint, ts timestamp, source string, machine string, user string, threats_count int, "
    "categories array<string>, original_text string, sanitized_text string, "
    "vault map<string,string>, status string"
)

# Defaults, limits, and the words that sort a category into a bucket
# (in this order, so FINANCIAL_PII counts as pii because it contains PII).
DEFAULT_MACHINE, DEFAULT_USER, STATUS = "LOCALHOST", "local_user", "SANITIZED"
RETAINED, RECENT, PAGE, ACTIVITY_ROWS, ACTIVITY_BINS = 500, 30, 25, 20, 7
BUCKETS = (
    ("secret", ("SECRET", "PASS", "KEY")),
    ("pii", ("GOVERNMENT", "AADHAAR", "PAN", "CONTACT", "NAME", "PII")),
    ("financial", ("FINANCIAL", "CARD", "UPI", "BANK", "AMOUNT")),
)


def report_categories(findings: Column) -> Column:
    """The different categories of a text's findings, sorted."""
    named = F.transform(findings, lambda f: F.coalesce(
        F.nullif(f["category"], F.lit("")), F.nullif(f["entity_type"], F.lit("")), F.lit("PII")))
    return F.array_sort(F.array_distinct(named))


def log_entry_view(events: DataFrame) -> DataFrame:
    """Fill the defaults of an entry and derive its display times from ``ts``."""
    return events.withColumns({
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "time_short": F.date_format("ts", "HH:mm:ss"),
        "date_short": F.date_format("ts", "MMM dd"),
        "machine": F.coalesce("machine", F.lit(DEFAULT_MACHINE)),
        "user": F.coalesce("user", F.lit(DEFAULT_USER)),
        "status": F.lit(STATUS),
    })


def log_entries(audited: DataFrame, keep_original: bool = False, text_col: str = "text") -> DataFrame:
    """Log rows for audited texts that were changed.

    ``audited`` carries ``ts, source`` and optionally ``machine, user``.  The
    original text and the values of the vault stay out of the log unless
    ``keep_original`` is set; the vault has a table of its own.
    """
    cols = audited.columns
    optional = [F.col(c) if c in cols else F.lit(None).cast("string").alias(c) for c in ("machine", "user")]
    keys = [c for c in cols if c in ("doc_id", "event_id", "seq", "session_id")]
    held = vault_entries(F.col("spans"))
    tokens = held["token"]
    values = held["original"] if keep_original else F.transform(tokens, lambda t: F.lit(None).cast("string"))
    entries = audited.where((F.size("findings") > 0) & (F.col("sanitized_text") != F.col(text_col))).select(
        *keys, "ts", "source", *optional, F.size("findings").alias("threats_count"),
        report_categories(F.col("findings")).alias("categories"),
        (F.col(text_col) if keep_original else F.lit(None).cast("string")).alias("original_text"),
        "sanitized_text", F.map_from_arrays(tokens, values).alias("vault"),
    )
    return log_entry_view(entries)


def assign_log_ids(log: DataFrame, order: list[str]) -> DataFrame:
    """Number the entries 1, 2, 3 ... in ``order`` without a single-partition window.

    The rows are range-partitioned and sorted once and checkpointed, so that the
    partition offsets and the numbering see the same partitions, also after an
    executor is lost.  The offsets are one row per partition, whatever the log's size.
    """
    placed = cut(log.drop("id").orderBy(*order).withColumn("_row", F.monotonically_increasing_id())).withColumns({
        "_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        "id", F.col("_start") + F.col("_at") + 1).drop("_row", "_part", "_at", "_start")


def retain_last(log: DataFrame, n: int = RETAINED, order: tuple[str, ...] = ("id",),
                by: str | None = None) -> DataFrame:
    """The newest ``n`` entries, of the whole log or per value of ``by``.

    Both forms cut to ``n`` rows in each map task before anything is shuffled, the second one
    up to Spark's ``spark.sql.window.group.limit.threshold`` (1,000): raise that for a larger ``n``.
    """
    newest = [F.col(c).desc() for c in order]
    if by is None:
        return log.orderBy(*newest).limit(n)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*newest))
    return log.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def recent(log: DataFrame, n: int = RECENT, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The newest ``n`` entries, newest first."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def log_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("total_events"),
        F.coalesce(F.sum(F.coalesce("threats_count", F.lit(0))), F.lit(0)).alias("total_threats_blocked"),
    )


def bucket_of(category: Column, financial_first: bool = False) -> Column:
    """The bucket a category counts in, null for none.

    ``financial_first`` looks for financial words before the pii ones.
    """
    order = (BUCKETS[0], BUCKETS[2], BUCKETS[1]) if financial_first else BUCKETS
    chain = F.when(F.lit(False), F.lit(""))
    for name, words in order:
        chain = chain.when(contains_any(F.upper(category), words), F.lit(name))
    return chain


def category_buckets(log: DataFrame, financial_first: bool = False) -> DataFrame:
    """One row with the number of category mentions per bucket."""
    buckets = log.select(F.explode("categories").alias("c")).select(
        bucket_of(F.col("c"), financial_first).alias("b"))
    return buckets.agg(*[F.count_if(F.col("b") == name).alias(f"{out}_count")
                         for name, out in (("secret", "secrets"), ("pii", "pii"), ("financial", "financial"))])


def activity_bins(log: DataFrame, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Threats of the last 20 entries over 7 bins; all zero if the log holds no threat.

    An entry's bin is its id less one, modulo 7, also where older entries are gone.  In a
    log without ids it is the position: that of the last rows follows from the row
    count, so the log itself is not numbered.  The last rows and the totals meet in one row.
    """
    number = F.col("id") - 1 if "id" in log.columns else F.lit(None).cast("long")
    last = log.orderBy(*[F.col(c).desc() for c in order]).limit(ACTIVITY_ROWS).select(
        F.struct(*order, number.alias("_number"), F.coalesce("threats_count", F.lit(1)).alias("n")).alias("e"))
    together = last.unionByName(log_totals(log), allowMissingColumns=True).agg(
        F.sort_array(F.collect_list("e"), asc=False).alias("es"),
        F.max("total_events").alias("total"), F.max("total_threats_blocked").alias("threats"))
    in_bin = f"filter(es, (e, i) -> pmod(coalesce(e._number, total - 1 - i), {ACTIVITY_BINS}) = b)"
    threats = f"aggregate({in_bin}, 0L, (s, e) -> s + e.n)"
    return together.select(F.expr(
        f"inline(transform(sequence(0, {ACTIVITY_BINS - 1}), b -> struct(b as bin, "
        f"CASE WHEN threats > 0 THEN {threats} ELSE 0L END as threats)))"))


def audit_summary(log: DataFrame, financial_first: bool = False) -> DataFrame:
    """Totals and bucket counts of the log in one pass over it."""
    def mentions(bucket: str) -> Column:
        return F.size(F.filter("categories", lambda c: bucket_of(c, financial_first) == bucket))

    per_entry = {f"{out}_count": mentions(name)
                 for name, out in (("secret", "secrets"), ("pii", "pii"), ("financial", "financial"))}
    return log.select(F.coalesce("threats_count", F.lit(0)).alias("t"),
                      *[F.greatest(v, F.lit(0)).alias(k) for k, v in per_entry.items()]).agg(
        F.count("*").alias("total_events"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_threats_blocked"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in per_entry],
    )


def _any_contains(values: Column, word: str) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.contains(F.upper(v), F.lit(word))), F.lit(False))


def filter_category(log: DataFrame, category: str) -> DataFrame:
    """Entries with ``category`` in a category or a token; AMOUNT also takes FINANCIAL categories."""
    if category == "all":
        return log
    in_tokens = _any_contains(F.map_keys("vault"), category)
    words = ("FINANCIAL", "AMOUNT") if category == "AMOUNT" else (category,)
    hit = in_tokens
    for word in words:
        hit = hit | _any_contains(F.col("categories"), word)
    return log.where(hit)


def search(log: DataFrame, query: str) -> DataFrame:
    """Entries whose texts, categories, tokens or values contain the query, ignoring case."""
    wanted = query.lower().strip()
    if not wanted:
        return log
    fields = [
        F.col("original_text"), F.col("sanitized_text"), F.array_join("categories", " "),
        F.array_join(F.map_keys("vault"), " "), F.array_join(F.map_values("vault"), " "),
    ]
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(wanted))
    return log.where(hit)


def page(log: DataFrame, n: int = PAGE, order: tuple[str, ...] = ("id",)) -> DataFrame:
    return recent(log, n, order)


def last_original(log: DataFrame, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The original text of the newest entry."""
    return recent(log, 1, order).select("original_text")


def guardian_counters(audits: DataFrame, by: str | None = None) -> DataFrame:
    """Scans, threats and interceptions over one row per audit (``source, n_findings``)."""
    found = F.col("n_findings") > 0
    grouped = audits.groupBy(by) if by else audits.groupBy()
    return grouped.agg(
        F.count("*").alias("total_scanned"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).alias("total_threats_blocked"),
        F.count_if(found & (F.col("source") == "desktop")).alias("desktop_interceptions"),
        F.count_if(found & (F.col("source") == "extension")).alias("extension_interceptions"),
    )


def vault_listing(vault: DataFrame, order: tuple[str, ...] = ("scope", "seq", "start")) -> DataFrame:
    """Token and value pairs of a scope in the order they were made."""
    return vault.select(*order, "token", "original")
