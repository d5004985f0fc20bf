"""Coarse twins of real series, and level maps onto them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import scalar as S
from tidewheel.operators.aggregates import section_distribution
from tidewheel.operators.blocks import join_keys
from tidewheel.operators.quantiles import exact_percentiles

TWIN_STEP = 0.05


def twin_levels(frames: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """[mean, p95, max] of each section, rounded to 0.05: all that crosses from a real series to its twin."""
    raw = section_distribution(frames, keys, value, step=None)
    step = lambda c: F.round(F.floor(F.round(c, 9) / TWIN_STEP + 0.5) * TWIN_STEP, 2).alias(c)
    return raw.select(*keys, step("mean"), step("p95"), step("max"))


def default_peaks(mean: Column) -> tuple[Column, Column]:
    """(p95, max) where only a mean is given."""
    m = S.clamp(mean)
    p95 = F.least(F.lit(1.0), m + (1 - m) * F.least(F.lit(0.85), 0.45 + 0.5 * m) * F.least(F.lit(1.0), m / 0.15))
    return p95, p95 + 0.75 * (1 - p95) * F.least(F.lit(1.0), m / 0.05)


# The body's exponent is bracketed by powers of two up to 2**DOUBLINGS, and then by STEPS steps between two of them.
DOUBLINGS, STEPS = 9, 32


def level_map(frames: DataFrame, levels: DataFrame, keys: Sequence[str], value: str, out: str, ceiling: float = 1.0) -> DataFrame:
    """Carry each section's values onto its [mean, p95, max], keeping their order.

    The top 5 % rise in a line from p95 to max, the rest from a floor that makes the section average
    its mean, bent into a power where even a zero floor is too loud. Where 95 % tie at the lowest value,
    those are the body and all others the top. max is held at p95 or above; a flat section is its mean. The
    power's effect on the mean is summed over all values for a ladder of exponents, then for a finer one
    between the two that enclose the wanted mean, so no section is gathered.
    """
    keys, v = list(keys), F.col(value)
    held = lambda c: S.clamp(F.col(c), 0.0, ceiling)
    wanted = levels.select(*keys, held("mean").alias("_m"), held("p95").alias("_p"), F.greatest(held("p95"), held("max")).alias("_x"))
    ends = frames.groupBy(*keys).agg(F.min(value).alias("_r0"), F.max(value).alias("_r1"))
    edges = join_keys(exact_percentiles(frames, keys, value, {"_r95": 0.95}, kind="nearest"), ends, keys)
    above = join_keys(frames.select(*keys, value), ends, keys).where(v > F.col("_r0")).groupBy(*keys).agg(F.min(value).alias("_next"))
    tied = F.col("_r95") <= F.col("_r0")
    shape = join_keys(join_keys(edges, above, keys, "left"), wanted, keys, "left").withColumn("_tied", tied).withColumn(
        "_cut", F.when(tied, F.col("_next")).otherwise(F.col("_r95")))
    rows = join_keys(frames, shape, keys)
    body = v < F.col("_cut")
    u = F.when(body, (v - F.col("_r0")) / F.nullif(F.col("_cut") - F.col("_r0"), F.lit(0.0)))
    rise = F.when(~body, F.when(F.col("_r1") > F.col("_cut"), (v - F.col("_cut")) / F.nullif(F.col("_r1") - F.col("_cut"), F.lit(0.0)))
                  .otherwise(F.when(F.col("_tied"), 0.0).otherwise(1.0)))
    rows = rows.withColumn("_u", u).withColumn("_rise", rise)
    nb, nt = F.count("_u").alias("_nb"), F.count("_rise").alias("_nt")
    ladder = F.array(*[F.coalesce(F.avg(F.pow("_u", F.lit(2.0**k))), F.lit(0.0)) for k in range(DOUBLINGS + 1)]).alias("_means")
    sums = join_keys(rows.groupBy(*keys).agg(nb, nt, F.sum("_rise").alias("_rises"), ladder), shape, keys)
    m, p, x = F.col("_m"), F.col("_p"), F.col("_x")
    top = F.when(F.col("_tied"), F.col("_nt") * (p + x) / 2).otherwise(p * F.col("_nt") + (x - p) * F.coalesce("_rises", F.lit(0.0)))
    want = (m * (F.col("_nb") + F.col("_nt")) - top) / F.greatest(F.col("_nb"), F.lit(1))
    plain = F.col("_means")[0]
    floor = F.when(F.col("_tied"), want).otherwise(F.when(plain < 1, (want - p * plain) / F.nullif(1 - plain, F.lit(0.0))).otherwise(p))
    low = F.size(F.filter(F.slice("_means", 2, DOUBLINGS), lambda mean: mean * p > want))
    fits = sums.select(*keys, want.alias("_want"), S.clamp(floor, 0.0, p).alias("_floor"),
                       F.when(~F.col("_tied") & (floor < 0), F.least(low, F.lit(DOUBLINGS - 1))).alias("_low"), p.alias("_p"))
    bent = join_keys(rows.select(*keys, "_u"), fits.where(F.col("_low").isNotNull()), keys)
    exponent = lambda j: F.pow(F.lit(2.0), F.col("_low") + j / STEPS)
    finer = F.array(*[F.avg(F.pow("_u", exponent(F.lit(float(j))))) for j in range(STEPS + 1)]).alias("_fine")
    curves = bent.groupBy(*keys, "_low", "_want", "_p").agg(finer)
    at = F.least(F.size(F.filter("_fine", lambda mean: mean * F.col("_p") > F.col("_want"))), F.lit(STEPS))
    # Between the two exponents that enclose the mean, in a line; beyond the last, the last.
    before, after = F.element_at("_fine", F.greatest(at, F.lit(1))) * F.col("_p"), F.element_at("_fine", at + 1) * F.col("_p")
    part = F.when(at > 0, S.clamp((before - F.col("_want")) / F.nullif(before - after, F.lit(0.0)))).otherwise(1.0)
    powers = curves.select(*keys, exponent(at - 1 + F.coalesce(part, F.lit(1.0))).alias("_power"))
    solved = join_keys(join_keys(rows, fits.select(*keys, "_floor"), keys), powers, keys, "left")
    carried = F.col("_floor") + (p - F.col("_floor")) * F.pow(F.greatest(F.col("_u"), F.lit(0.0)), F.coalesce("_power", F.lit(1.0)))
    mapped = F.when(F.col("_r1") - F.col("_r0") <= 1e-12, m).when(F.col("_u").isNotNull(), carried).otherwise(p + (x - p) * F.col("_rise"))
    return solved.select(*[F.col(c) for c in frames.columns], S.clamp(mapped, 0.0, ceiling).alias(out))
