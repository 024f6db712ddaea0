"""Keyed tables that batches update: hash buckets in versions, behind a manifest.

A table is a folder.  ``data/version=V/bucket=K`` holds bucket K as batch V wrote it, and
``manifest/version=V`` says for each bucket which version is the present one.  A batch reads
and rewrites only the buckets that its keys fall into; the others keep their files.  The
manifest is one file, written last: until then readers see the version before.  A batch
starts from the version before its own, so one that is run again gives the same table.

Older versions stay where they are, for readers that began with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
_PLACES = "bucket int, at bigint"


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.hash(*keys), F.lit(buckets))


def _manifest(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def places(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The present version of each bucket, as of the last batch (before ``before``); at most one entry a bucket.

    A batch finds the manifest of the one right before it by its name, so its cost does not grow
    with the number of batches; only where that batch was empty, or for a reader, are all listed.
    """
    newest = _manifest(spark, f"{path}/manifest/version={before - 1}", _PLACES) if before else None
    if newest is None:
        every = _manifest(spark, f"{path}/manifest", f"version bigint, {_PLACES}")
        if every is None:
            return {}
        earlier = every if before is None else every.where(F.col("version") < before)
        newest = earlier.where(F.col("version") == F.lit(earlier.agg(F.max("version")).first()[0]))
    return {r["bucket"]: r["at"] for r in newest.collect()}


def _rows(spark: SparkSession, path: str, schema: StructType | str, found: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/version={at}/bucket={b}" for b, at in found.items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """The table as of the last batch (before ``before``); no rows if there is none yet."""
    return _rows(spark, path, schema, places(spark, path, before))


def touched(changes: DataFrame, keys: list[str], buckets: int = BUCKETS) -> set[int]:
    """The buckets that the keys of ``changes`` fall into, at most ``buckets`` numbers."""
    return {r[0] for r in changes.select(bucket_of(keys, buckets)).distinct().collect()}


def update_buckets(changes: DataFrame, path: str, keys: list[str], batch_id: int,
                   merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge ``changes`` into the table: ``merge`` gets the old rows of the touched buckets and the new ones.

    ``merge`` keeps the columns, and no row's key may change.  A table keeps its number of buckets.  An
    empty batch changes nothing.
    """
    spark, schema = changes.sparkSession, changes.schema
    hit = touched(changes, keys, buckets)
    if not hit:
        return
    present = places(spark, path, batch_id)
    old = _rows(spark, path, schema, {b: at for b, at in present.items() if b in hit})
    merged = merge(old.unionByName(changes)).select(*schema.names, bucket_of(keys, buckets).alias("bucket"))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={batch_id}")
    entries = spark.createDataFrame(sorted((present | dict.fromkeys(hit, batch_id)).items()), _PLACES)
    entries.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={batch_id}")
