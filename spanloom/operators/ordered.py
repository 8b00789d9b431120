"""Ordered analytics that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  With
one key holding a third of the data that task never ends.  The functions here
give the same answers in two levels: rows are cut into order-contiguous slices,
each slice is handled by its own task, and one small row per (key, slice)
carries what the earlier slices contribute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut, landed

_ORDINAL_BITS = 33  # fixed by monotonically_increasing_id


def _with_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def range_slices(df: DataFrame, keys: list[str], order: list[str], write: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Range-partition by key and order; add ``_slice`` and ``_ord``.

    ``order`` must end in a unique column, so that equal timestamps of a hot key
    are still spread over many partitions.  The result is checkpointed because
    range bounds come from sampling: rows and their per-slice totals must see
    the same bounds.  Wide rows take less disk with ``landed``, which packs them; they come back in any order then.
    """
    by = [F.col(c) for c in [*keys, *order]]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = write(placed.withColumn("_pos", F.monotonically_increasing_id()))
    return placed.select(
        "*",
        F.shiftright("_pos", _ORDINAL_BITS).alias("_slice"),
        F.col("_pos").bitwiseAND((1 << _ORDINAL_BITS) - 1).alias("_ord"),
    ).drop("_pos")


def rank_sliced(sliced: DataFrame, keys: list[str], rank: str = "rn", total: str = "n", few: bool = False) -> DataFrame:
    """Rank within key for the output of :func:`range_slices`, without moving rows.

    Where keys are ``few``, the row per key and slice is written first: its size is known then, and rows stay where they are.
    """
    sliced, by = _with_key(sliced, keys)
    small = sliced.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_ord").alias("_first")
    )
    ordered = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(
        *by,
        "_slice",
        (F.coalesce(F.sum("_cnt").over(ordered), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_cnt").over(Window.partitionBy(*by)).alias(total),
    )
    small = landed(small) if few else small
    out = sliced.join(small, [*by, "_slice"]).withColumn(rank, F.col("_ord") + F.col("_shift"))
    return out.drop("_shift", "_all")


def global_rank(
    df: DataFrame, keys: list[str], order: list[str], rank: str = "rn", total: str = "n"
) -> DataFrame:
    """``row_number()`` and ``count(*)`` per key for keys of any size."""
    ranked = rank_sliced(range_slices(df, keys, order), keys, rank, total)
    return ranked.drop("_slice", "_ord")


def sliced_window(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    write_input: bool = True,
) -> DataFrame:
    """Running sums, lag, lead and last-non-null per key over ordered slices.

    ``slice_col`` must rise with ``order`` inside a key.  Row windows see one
    (key, slice) each; the per-slice summary is one row per slice.  The input is
    read twice, so it is written first: a chain of k such steps then costs k
    writes instead of 2^k evaluations.  Pass ``write_input=False`` when the input
    is already cheap to read again.
    """
    if write_input:
        df = landed(df)
    sums, lags, leads, lasts = sums or {}, lags or {}, leads or {}, lasts or {}
    by = [*keys, slice_col]
    at = F.struct(*order)
    local = Window.partitionBy(*by).orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)

    aggs: list[Column] = []
    carry: list[Column] = []
    chain = Window.partitionBy(*keys).orderBy(slice_col)
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    for name, value in sums.items():
        aggs.append(F.sum(value).alias(f"_s_{name}"))
        carry.append(F.sum(f"_s_{name}").over(before).alias(f"_s_{name}"))
    for name, value in lags.items():
        aggs.append(F.max_by(F.struct(value.alias("v")), at).alias(f"_g_{name}"))
        carry.append(F.lag(f"_g_{name}").over(chain).alias(f"_g_{name}"))
    for name, value in leads.items():
        aggs.append(F.min_by(F.struct(value.alias("v")), at).alias(f"_d_{name}"))
        carry.append(F.lead(f"_d_{name}").over(chain).alias(f"_d_{name}"))
    for name, value in lasts.items():
        aggs.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(f"_l_{name}"))
        carry.append(F.last(f"_l_{name}", ignorenulls=True).over(before).alias(f"_l_{name}"))

    small = df.groupBy(*by).agg(*aggs).select(*by, *carry)
    rows = df.join(small, by)
    out = [F.col(c) for c in df.columns]
    for name, value in sums.items():
        out.append(
            (F.coalesce(F.col(f"_s_{name}"), F.lit(0)) + F.sum(value).over(running)).alias(name)
        )
    for name, value in lags.items():
        inside = F.lag(F.struct(value.alias("v"))).over(local)
        out.append(F.coalesce(inside, F.col(f"_g_{name}"))["v"].alias(name))
    for name, value in leads.items():
        inside = F.lead(F.struct(value.alias("v"))).over(local)
        out.append(F.coalesce(inside, F.col(f"_d_{name}"))["v"].alias(name))
    for name, value in lasts.items():
        inside = F.last(value, ignorenulls=True).over(running)
        out.append(F.coalesce(inside, F.col(f"_l_{name}")).alias(name))
    return rows.select(*out)


def nearest_rank(percent: int):
    """Rank rule ``ceil(n * p / 100)`` in whole-number arithmetic."""
    return lambda n: F.greatest(F.floor((n * percent + 99) / 100), F.lit(1)).cast("bigint")


def order_stats(
    df: DataFrame, keys: list[str], value: str, percentiles: dict[str, int], median: str | None = None,
    width: int = 4096,
) -> DataFrame:
    """Exact nearest-rank percentiles and median of a bigint column per key.

    Works on the value histogram: counts combine map-side, a coarse histogram
    finds the bucket that holds each rank, and only those buckets are opened.
    """
    df, by = _with_key(df, keys)
    ranks = {name: nearest_rank(p) for name, p in percentiles.items()}
    if median:
        ranks[f"{median}_lo"] = lambda n: F.floor((n + 1) / 2).cast("bigint")
        ranks[f"{median}_hi"] = lambda n: (F.floor(n / 2) + 1).cast("bigint")

    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    hist = hist.withColumn("_bucket", F.floor(F.col(value) / width))
    coarse = hist.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_bc"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    coarse = coarse.select(
        *by, "_bucket", "_bc",
        (F.sum("_bc").over(upto) - F.col("_bc")).alias("_before"),
        F.sum("_bc").over(Window.partitionBy(*by)).alias("_n"),
    )
    for name, rule in ranks.items():
        coarse = coarse.withColumn(f"_r_{name}", rule(F.col("_n")))
    holds = None
    for name in ranks:
        one = (F.col(f"_r_{name}") > F.col("_before")) & (
            F.col(f"_r_{name}") <= F.col("_before") + F.col("_bc")
        )
        holds = one if holds is None else holds | one
    fine = hist.join(coarse.where(holds).drop("_bc"), [*by, "_bucket"])
    inner = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("_upto", F.col("_before") + F.sum("_c").over(inner))
    picks = [
        F.max(
            F.when(
                (F.col(f"_r_{name}") > F.col("_upto") - F.col("_c"))
                & (F.col(f"_r_{name}") <= F.col("_upto")),
                F.col(value),
            )
        ).alias(name)
        for name in ranks
    ]
    out = fine.groupBy(*by).agg(*picks)
    if median:
        out = out.withColumn(
            median, (F.col(f"{median}_lo") + F.col(f"{median}_hi")) / F.lit(2.0)
        ).drop(f"{median}_lo", f"{median}_hi")
    return out.drop("_all")
