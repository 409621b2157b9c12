"""Functions over one total order, without sending all rows to one task.

Rows are dealt to slabs of time. Inside a slab a window does the work; what a slab needs from those before
it (a count, a sum, a last row) is one row a slab, so the window over slabs is small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


#: Rows that a slab should hold, and into how many bins of equal width their times are counted for it.
SLAB_ROWS, BINS = 1 << 20, 4096


def _slabbed(df: DataFrame, at: str, width: int | None) -> DataFrame:
    """Rows with their slab: of a fixed width, or (None) of about SLAB_ROWS rows each, by counts of the rows in BINS bins."""
    if width is not None:
        return df.withColumn("__slab", F.floor(F.col(at) / F.lit(width)))
    ends = df.agg(F.min(at), F.max(at), F.count("*")).first()
    if ends[2] <= SLAB_ROWS:
        return df.withColumn("__slab", F.lit(0).cast("long"))
    step = max(1, -(-(ends[1] - ends[0] + 1) // BINS))
    place = F.floor((F.col(at) - F.lit(ends[0])) / F.lit(step))
    slabs, held, slab = [], 0, 0
    for bin_, n in sorted(tuple(r) for r in df.groupBy(place.alias("b")).count().collect()):  # BINS rows at most
        if held and held + n > SLAB_ROWS:
            slab, held = slab + 1, 0
        slabs.append((bin_, slab))
        held += n
    of = F.broadcast(df.sparkSession.createDataFrame(slabs, "__bin long, __slab long"))
    return df.withColumn("__bin", place).join(of, "__bin").drop("__bin")


def global_sum(df: DataFrame, at: str, order: Sequence[str], width: int | None, value: str, name: str) -> DataFrame:
    """The running sum of `value` over the order (which `at` leads)."""
    rows = _slabbed(df, at, width)
    sums = rows.groupBy("__slab").agg(F.sum(value).alias("__s"))
    before = sums.select("__slab", F.coalesce(F.sum("__s").over(Window.orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(before, "__slab").withColumn(name, F.col("__own") + F.col("__before")).drop("__slab", "__own", "__before")


def global_rank(df: DataFrame, at: str, order: Sequence[str], width: int | None, name: str = "index") -> DataFrame:
    """The place (from 0) of each row in the order."""
    return global_sum(df.withColumn("__one", F.lit(1).cast("long")), at, order, width, "__one", name).withColumn(name, F.col(name) - 1).drop("__one")


def global_lag(df: DataFrame, at: str, order: Sequence[str], width: int | None, columns: Sequence[str], prefix: str = "prev_", keys: Sequence[str] = ()) -> DataFrame:
    """Each row with the columns of the row before it in the order, or of its keys' rows only; few keys don't make few tasks."""
    rows = _slabbed(df, at, width)
    own_keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    ends = rows.groupBy(*own_keys, F.col("__slab").alias("__s")).agg(F.max(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in columns])).alias("__end"))
    across = Window.partitionBy(*names).orderBy("__s") if names else Window.orderBy("__s")
    ends = ends.select(*names, "__s", F.lag("__end").over(across).alias("__end"))
    w = Window.partitionBy(*keys, "__slab").orderBy(*order)
    own = rows.withColumn("__n", F.row_number().over(w))
    for c in columns:
        own = own.withColumn(prefix + c, F.lag(c).over(w))
    same = F.col("__slab") == F.col("__s")
    for k, name in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(name))
    own = own.join(ends, same)
    for c in columns:
        own = own.withColumn(prefix + c, F.when(F.col("__n") == 1, F.col(f"__end.__{c}")).otherwise(F.col(prefix + c)))
    return own.drop("__slab", "__s", "__n", "__end", *names)
