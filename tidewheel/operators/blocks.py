"""Ordered computation over long series, split into blocks.

A window partitioned by the series alone puts one series in one task, and one series may hold
a third of all rows. Everything ordered here therefore works on (series, block):

* bounded windows (`over_blocks`): each block also receives the few rows it needs from its
  neighbours (its halo), so a moving window never crosses a partition;
* unbounded prefixes (`prefix`): each block is folded on its own, the one-row-per-block
  summaries are folded over the series, and the carry is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewheel.constants import BLOCK


def block_of(index: str | Column, size: int = BLOCK) -> Column:
    """The block a whole-number index falls in."""
    col = F.col(index) if isinstance(index, str) else index
    return F.floor(col / F.lit(size)).cast("bigint")


def halo(df: DataFrame, index: str, size: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """Copy each row into the neighbouring blocks whose windows reach it.

    Adds `_blk` (the block) and `_own` (false for copies). `index` is dense per series;
    `before` and `after` are at most one block.
    """
    if max(before, after) > size:
        raise ValueError(f"a halo of {max(before, after)} rows needs blocks of at least that size, got {size}")
    home = block_of(index, size)
    if not before and not after:
        return df.withColumn("_blk", home).withColumn("_own", F.lit(True))
    place = F.pmod(F.col(index), F.lit(size))
    targets = [home]
    if before:
        targets.append(F.when(place >= size - before, home + 1))
    if after:
        targets.append(F.when(place < after, home - 1))
    return (
        df.withColumn("_blk", F.explode(F.array(*targets)))
        .where(F.col("_blk").isNotNull())
        .withColumn("_own", F.col("_blk") == home)
    )


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    steps: Mapping[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    size: int = BLOCK,
) -> DataFrame:
    """Add one column per step, each built from the block's window ordered by `index`.

    Later steps may read earlier ones; `before`/`after` cover the sum of their reaches.
    """
    size = max(size, 4 * max(before, after))
    w = Window.partitionBy(*keys, "_blk").orderBy(index)
    out = halo(df, index, size, before, after)
    for name, build in steps.items():
        out = out.withColumn(name, build(w))
    return out.where("_own").drop("_blk", "_own")


def neighbour(df: DataFrame, keys: Sequence[str], index: str, cols: Mapping[str, tuple[str, int]],
              size: int = BLOCK) -> DataFrame:
    """`{new: (column, offset)}`: the column `offset` rows away (negative is earlier), NULL outside."""
    reach_before = max([0, *(-o for _, o in cols.values())])
    reach_after = max([0, *(o for _, o in cols.values())])

    def step(source: str, offset: int):
        return lambda w: F.lag(source, -offset).over(w) if offset < 0 else F.lead(source, offset).over(w)

    return over_blocks(df, keys, index, {n: step(c, o) for n, (c, o) in cols.items()},
                       reach_before, reach_after, size)


def sliding_sum(df: DataFrame, keys: Sequence[str], index: str, value: str, out: str, lo: int, hi: int,
                size: int = BLOCK) -> DataFrame:
    """Sum over rows `lo`..`hi` around each row (rows outside the series count 0).

    Up to 64 rows the frame is summed as it slides; a wider one is the difference of two
    running sums, so the cost per row does not grow with the width.
    """
    width = hi - lo + 1
    before, after = max(0, -lo), max(0, hi)
    if width <= 64:
        return over_blocks(df, keys, index,
                           {out: lambda w: F.sum(value).over(w.rowsBetween(lo, hi))}, before, after, size)

    def running(w):
        return F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def at(w, k, beyond):
        shifted = F.lead("_run", k) if k >= 0 else F.lag("_run", -k)
        return F.coalesce(shifted.over(w), beyond)

    def difference(w):
        total = F.max("_run_last").over(Window.partitionBy(*keys, "_blk"))
        return at(w, hi, total) - at(w, lo - 1, F.lit(0.0))

    def last(w):
        return F.last("_run").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    return over_blocks(
        df, keys, index, {"_run": running, "_run_last": last, out: difference}, before + 1, after, size
    ).drop("_run", "_run_last")


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    specs: Mapping[str, tuple],
    index: str | None = None,
    size: int = BLOCK,
    order: Sequence[str] | None = None,
    block: Column | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Running folds from the start of each series to each row, inclusive.

    `specs` is `{new: (fold, column)}` with fold one of sum, max, min, count, last (the last
    non-NULL value); `{new: (fold, column, "reverse")}` runs from the end instead, as `reverse`
    makes all of them. Order is `index` in blocks of `size`, or `order` columns with an explicit
    `block` that never decreases along them.
    """
    keys = list(keys)
    order = list(order) if order is not None else [index]
    block = block if block is not None else block_of(index, size)
    src = df.withColumn("_blk", block)
    position = F.struct(*order)

    def windows(back: bool):
        directed = [F.col(c).desc() if back else F.col(c).asc() for c in order]
        w = Window.partitionBy(*keys, "_blk").orderBy(*directed).rowsBetween(Window.unboundedPreceding, 0)
        across = F.col("_blk").desc() if back else F.col("_blk").asc()
        return w, Window.partitionBy(*keys).orderBy(across).rowsBetween(Window.unboundedPreceding, -1)

    local, totals, carry, joined = [], [], [], []
    for name, (fold, column, *direction) in specs.items():
        back = reverse or bool(direction)
        w, wb = windows(back)
        c = F.col(column)
        if fold == "last":
            local.append(F.last(c, ignorenulls=True).over(w).alias(f"_l_{name}"))
            pick = F.min_by if back else F.max_by
            totals.append(pick(c, F.when(c.isNotNull(), position)).alias(f"_t_{name}"))
            carry.append(F.last(f"_t_{name}", ignorenulls=True).over(wb).alias(f"_c_{name}"))
            joined.append(F.coalesce(f"_l_{name}", f"_c_{name}").alias(name))
            continue
        f = _FOLD[fold]
        local.append(f(c).over(w).alias(f"_l_{name}"))
        totals.append(f(c).alias(f"_t_{name}"))
        across = F.sum if fold == "count" else f
        carry.append(across(f"_t_{name}").over(wb).alias(f"_c_{name}"))
        if fold in ("sum", "count"):
            zero = F.lit(0).cast("bigint") if fold == "count" else F.lit(0)
            joined.append((F.coalesce(F.col(f"_c_{name}"), zero)
                           + F.coalesce(F.col(f"_l_{name}"), zero)).alias(name))
        else:
            both = F.greatest if fold == "max" else F.least
            joined.append(both(f"_c_{name}", f"_l_{name}").alias(name))
    inside = src.select("*", *local)
    across_blocks = src.groupBy(*keys, "_blk").agg(*totals).select(*keys, "_blk", *carry)
    return join_keys(inside, across_blocks, [*keys, "_blk"], "left").select(*df.columns, *joined)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is one like any other; the left side's keys stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def islands(df: DataFrame, keys: Sequence[str], index: str, inside: str, out: str = "island",
            size: int = BLOCK) -> DataFrame:
    """Keep the rows where `inside` holds and name each consecutive run by its first index."""
    marked = over_blocks(
        df, keys, index,
        {"_start": lambda w: F.when(
            F.col(inside) & ~F.coalesce(F.lag(inside).over(w), F.lit(False)), F.col(index))},
        before=1, size=size,
    )
    named = prefix(marked, keys, {out: ("max", "_start")}, index=index, size=size)
    return named.where(F.col(inside)).drop("_start")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str) -> DataFrame:
    """1-based position of each row within its keys, without gathering a key in one task."""
    return prefix(df.withColumn("_one", F.lit(1)), keys, {out: ("count", "_one")},
                  order=order, block=block).drop("_one")


def pack(df: DataFrame, keys: Sequence[str], index: str, cols: Sequence[str], size: int = BLOCK,
         before: int = 0, after: int = 0) -> DataFrame:
    """One row per (keys, `_blk`) with the block's rows, halo included, as sorted arrays.

    A block holds at most size + before + after rows of a dense series, so the arrays are bounded.
    """
    placed = halo(df.select(*keys, index, *cols), index, size, before, after)
    rows = F.array_sort(F.collect_list(F.struct(F.col(index), *cols)))
    grouped = placed.groupBy(*keys, "_blk").agg(rows.alias("_rows"), F.max("_own").alias("_any")).where("_any")
    return grouped.select(*keys, "_blk", *[F.col(f"_rows.{c}").alias(c) for c in (index, *cols)])
