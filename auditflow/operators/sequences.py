"""Running values over ordered events that stay parallel when one key is hot.

A window over a key sorts all its rows in one task.  Here the rows are range-partitioned by
key and order, and what one partition holds of a key is a slice of it, so slices follow the
data: a key with a third of all rows, or all of its rows in one minute, is many slices.  The
rows are windowed per key *and slice*, each slice is reduced to its last row, and what the
earlier slices carry over is joined back.  Only the slice rows of a key meet in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditflow.functions.lineage import written

SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_slice``, written once: ranges of (keys, order) of about the size that Spark gives a partition.

    Rows equal in keys and order share a slice.  It is written so that all that reads
    it sees the same slices, also after an executor is lost.
    """
    return written(df.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None,
            last: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
            since: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Add running columns to ``df``, which has a ``_slice`` column that agrees with ``order``.

    ``sums``: the sum up to the row.  ``last``: the latest non-null value up to the
    row; ``before``: the same without the row itself.  ``since``: pairs (value,
    reset), the sum of the values after the latest row with ``reset``, whose own
    value does not count.
    """
    sums, last, before, since = sums or {}, last or {}, before or {}, since or {}
    rows = Window.partitionBy(*keys, SLICE).orderBy(*order)
    to_here = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_last = rows.rowsBetween(Window.unboundedPreceding, -1)

    local = df.withColumns(
        {f"_s_{n}": F.sum(e).over(to_here) for n, e in sums.items()}
        | {f"_s_{n}": F.sum(e).over(to_here) for n, (e, _) in since.items()}
        | {f"_l_{n}": F.last(e, ignorenulls=True).over(to_here) for n, e in {**last, **before}.items()}
        | {f"_b_{n}": F.last(e, ignorenulls=True).over(to_last) for n, e in before.items()}
    )
    # For `since`: the running sum at the latest reset within the slice.
    local = local.withColumns({
        f"_r_{n}": F.last(F.when(reset, F.col(f"_s_{n}")), ignorenulls=True).over(to_here)
        for n, (_, reset) in since.items()
    })
    ends = [c for c in local.columns if c.startswith(("_s_", "_l_", "_r_"))]
    reduced = local.groupBy(*keys, SLICE).agg(F.max_by(F.struct(*ends), F.struct(*order)).alias("_e")).select(
        *keys, SLICE, "_e.*")

    slices = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    so_far = slices.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = reduced.withColumns({f"_t_{n}": F.sum(f"_s_{n}").over(so_far) for n in (*sums, *since)})
    # A slice with a reset ends with what came after it, and its running total to measure from.
    carried = totals.select(
        *keys, SLICE,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in (*sums, *since)],
        *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in (*last, *before)],
        *[F.last(F.when(F.col(f"_r_{n}").isNotNull(), F.col(f"_t_{n}") - (F.col(f"_s_{n}") - F.col(f"_r_{n}"))),
                 ignorenulls=True).over(earlier).alias(f"_z_{n}") for n in since],
    )
    # A null key is a key like any other.
    named = carried.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, SLICE)})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, SLICE)))
    joined = local.join(named, same)
    return joined.select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in last],
        *[F.coalesce(f"_b_{n}", f"_c_{n}").alias(n) for n in before],
        *[F.when(F.col(f"_r_{n}").isNotNull(), F.col(f"_s_{n}") - F.col(f"_r_{n}")).otherwise(
            F.col(f"_s_{n}") + F.col(f"_c_{n}") - F.coalesce(f"_z_{n}", F.lit(0))).alias(n) for n in since],
    )
