"""Interval joins and sweeps.

A range predicate alone plans as a nested loop, so intervals are dealt over bins and joined on
(keys, bin). Each overlapping pair is emitted once: in the bin where the later of its starts
lies. The bin width is a parameter; it should be near the usual interval length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096
#: Positions of a stretch: what a sweep handles in one place.
STRETCH = 1 << 20


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that a closed interval touches; none if it is empty or has a null end."""
    return F.when(start <= end, F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l: tuple[Column, Column], r: tuple[Column, Column], width: int = WIDTH, parts: int | None = None) -> DataFrame:
    """Inner join of rows whose closed intervals ``l`` and ``r`` overlap and whose ``on`` columns are equal.

    Column names of both sides must differ. Rows with a null end or an end before the start match nothing.
    ``parts``: tasks for the bins where the pairs far outnumber the rows; adaptive execution would put
    bins together by the bytes of the rows.
    """
    a = left.withColumn("_ls", l[0]).withColumn("_le", l[1]).withColumn("_lbin", F.explode(bins(F.col("_ls"), F.col("_le"), width)))
    b = right.withColumn("_rs", r[0]).withColumn("_re", r[1]).withColumn("_rbin", F.explode(bins(F.col("_rs"), F.col("_re"), width)))
    if parts:
        a = a.repartition(parts, "_lbin", *(x for x, _ in on))
        b = b.repartition(parts, "_rbin", *(y for _, y in on))
    cond = (F.col("_lbin") == F.col("_rbin")) & (F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le"))
    cond = cond & (F.col("_lbin") == F.floor(F.greatest("_ls", "_rs") / width))
    for x, y in on:
        cond = cond & (F.col(x) == F.col(y))
    return a.join(b, cond).drop("_ls", "_le", "_lbin", "_rs", "_re", "_rbin")


def with_overlap(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l: tuple[Column, Column], r: tuple[Column, Column], name: str, width: int = WIDTH) -> DataFrame:
    """``left`` with the boolean ``name``: whether the row overlaps any row of ``right``, as ``overlap_join`` says it.

    The right intervals are merged first, so a bin holds no more of them than its width allows, however
    many lie there. A row is looked up once, in the bin of its start, which knows the merged intervals
    that touch it and where the first one of a later bin starts; no pair is made.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    there = right.select(*(F.col(y).alias(k) for k, (_, y) in zip(keys, on, strict=True)), r[0].alias("_rs"), r[1].alias("_re"))
    there = there.where(F.col("_rs") <= F.col("_re")).dropna(subset=keys).groupBy(*keys, "_rs").agg(F.max("_re").alias("_re"))
    there = merge_intervals(there, keys, "_rs", "_re").withColumn("_bin", F.explode(bins(F.col("_rs"), F.col("_re"), width)))
    held = there.groupBy(*keys, "_bin").agg(F.collect_list(F.struct("_rs", "_re")).alias("_in"), F.min("_rs").alias("_first"))
    asked = left.select(*(F.col(x).alias(k) for k, (x, _) in zip(keys, on, strict=True)), F.floor(l[0] / width).alias("_bin")).dropna().distinct()
    cells = held.join(asked, [*keys, "_bin"], "full")
    later = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    cells = cells.select(*keys, "_bin", "_in", F.min("_first").over(later).alias("_next"))
    cond = F.floor(l[0] / width) == F.col("_bin")
    for k, (x, _) in zip(keys, on, strict=True):
        cond = cond & (F.col(x) == F.col(k))
    hit = F.coalesce(F.exists("_in", lambda x: (x["_rs"] <= l[1]) & (x["_re"] >= l[0])), F.lit(False)) | F.coalesce(F.col("_next") <= l[1], F.lit(False))
    return left.join(cells, cond, "left").withColumn(name, hit & F.coalesce(l[0] <= l[1], F.lit(False))).drop(*keys, "_bin", "_in", "_next")


def overlap_semi(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l: tuple[Column, Column], r: tuple[Column, Column], width: int = WIDTH, anti: bool = False) -> DataFrame:
    """Rows of ``left`` that overlap any (``anti``: no) row of ``right``."""
    return with_overlap(left, right, on, l, r, "_hit", width).where(~F.col("_hit") if anti else F.col("_hit")).drop("_hit")


def first_overlap(points: DataFrame, intervals: DataFrame, on: list[tuple[str, str]], p: Column, r: tuple[Column, Column], tie: str, width: int = 512) -> DataFrame:
    """Inner join of each point with the one interval of least (start, ``tie``) that holds it; ends are whole numbers.

    An interval wins from its start, or from where all earlier ones have ended, to its end. These
    parts are disjoint, so a point meets one at most, however many intervals hold it.
    """
    keys = [y for _, y in on]
    there = intervals.withColumn("_fs", r[0]).withColumn("_fe", r[1]).where("_fs <= _fe").withColumn("_bin", F.floor(F.col("_fs") / STRETCH))
    order = Window.partitionBy(*keys, "_bin").orderBy("_fs", tie).rowsBetween(Window.unboundedPreceding, -1)
    dealt = carried(there, keys, F.max("_fe"), F.max, "_reach").withColumn("_before", F.greatest(F.max("_fe").over(order), F.col("_reach")))
    wins = dealt.where(F.col("_before").isNull() | (F.col("_fe") > F.col("_before"))).withColumn("_fs", F.greatest("_fs", F.col("_before") + 1)).drop("_bin", "_reach", "_before")
    return overlap_join(points, wins, on, (p, p), (F.col("_fs"), F.col("_fe")), width).drop("_fs", "_fe")


def points_within(points: DataFrame, intervals: DataFrame, on: list[tuple[str, str]], p: Column, r: tuple[Column, Column], ident: str, stretch: int = 1 << 16) -> DataFrame:
    """(``ident``, n): how many points the intervals of each ``ident`` hold, 0 included.

    One sweep over the counted points with the intervals' ends among them: what was met up to an end less what was met before the start. No pair is made.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    met = points.select(*(F.col(x).alias(k) for k, (x, _) in zip(keys, on, strict=True)), p.alias("_p")).dropna().groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    there = intervals.select(*(F.col(y).alias(k) for k, (_, y) in zip(keys, on, strict=True)), F.col(ident), r[0].alias("_rs"), r[1].alias("_re")).where("_rs <= _re")
    ends = F.array(F.struct(F.col("_rs").alias("p"), F.lit(0).alias("o"), F.lit(-1).alias("f")), F.struct(F.col("_re").alias("p"), F.lit(2).alias("o"), F.lit(1).alias("f")))
    asks = there.dropna(subset=keys).withColumn("_e", F.explode(ends)).select(*keys, F.col("_e.p").alias("_p"), F.col("_e.o").alias("_o"), F.lit(0).cast("long").alias("_c"), ident, F.col("_e.f").alias("_f"))
    both = met.withColumn("_o", F.lit(1)).unionByName(asks, allowMissingColumns=True).withColumn("_bin", F.floor(F.col("_p") / stretch))
    within = Window.partitionBy(*keys, "_bin").orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0)
    swept = carried(both, keys, F.sum("_c"), F.sum, "_base").withColumn("_so_far", F.coalesce("_base", F.lit(0)) + F.sum("_c").over(within))
    return swept.where("_f IS NOT NULL").groupBy(ident).agg(F.sum(F.col("_f") * F.col("_so_far")).cast("long").alias("n"))


def same_keys(keys: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def carried(df: DataFrame, keys: list[str], value: Column, fold: Callable[[Column], Column], name: str) -> DataFrame:
    """Adds what ``fold`` makes of the ``value``, an aggregate, of all earlier stretches (``_bin``) of the same keys; null in the first.

    A sweep over a chromosome so needs one row of each stretch in one place, not all of its rows.
    """
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    each = df.groupBy(*keys, "_bin").agg(value.alias("_v")).withColumn("_carry", fold(F.col("_v")).over(order))
    each = each.select(*(F.col(k).alias(f"_c_{k}") for k in [*keys, "_bin"]), F.col("_carry").alias(name))
    return df.join(each, same_keys([*keys, "_bin"], "_c_"), "left").drop(*(f"_c_{k}" for k in [*keys, "_bin"]))


def numbered_runs(df: DataFrame, keys: list[str], order: list[str], new: str, name: str) -> DataFrame:
    """Adds the number, from 1, of the run that each row lies in: runs begin where ``new`` is 1; rows are dealt by keys and ``_bin``."""
    within = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = carried(df, keys, F.sum(new), F.sum, "_runs").withColumn(name, F.coalesce("_runs", F.lit(0)) + F.sum(new).over(within))
    return out.withColumn(name, F.col(name).cast("long")).drop("_runs")


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """Adds the ``value`` of the row before, by ``order`` (its first column a position), within the same keys."""
    dealt = df.withColumn("_bin", F.floor(F.col(order[0]) / stretch))
    met = carried(dealt, keys, F.max_by(F.struct(value), F.struct(*order)), F.last, "_last")
    before = F.lag(F.struct(value)).over(Window.partitionBy(*keys, "_bin").orderBy(*order))
    return met.withColumn(name, F.coalesce(before, F.col("_last"))[value]).drop("_bin", "_last")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, label: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """Overlapping (or at most ``gap`` apart) closed intervals of the same ``keys`` as one: (keys, start, end, n [, labels])."""
    dealt = carried(df.withColumn("_bin", F.floor(F.col(start) / stretch)), keys, F.max(end), F.max, "_reach")
    order = Window.partitionBy(*keys, "_bin").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.max(end).over(order), F.col("_reach"))
    marked = dealt.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + gap), 1).otherwise(0))
    marked = numbered_runs(marked, keys, [start, end], "_new", "_island")
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")]
    if label:
        aggs.append(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"))
    return marked.groupBy(*keys, "_island").agg(*aggs).drop("_island")


def tile(regions: DataFrame, start: str, end: str, size: int = 25_000, pad: int = 500) -> DataFrame:
    """Windows of ``size`` that step by ``size - pad`` over each region: (other columns, win_start, win_end)."""
    step = size - pad
    at = F.explode(F.sequence(F.col(start), F.greatest(F.col(start), F.col(end) - 1), F.lit(step)))
    return regions.withColumn("win_start", at).withColumn("win_end", F.least(F.col("win_start") + size, F.col(end)))


def depth(df: DataFrame, keys: list[str], start: Column, end: Column, stretch: int = STRETCH) -> DataFrame:
    """Runs of equal depth of closed intervals: (keys, run_start, run_end, depth), depth above 0.

    A sweep over the +1 and -1 events of each key, stretch by stretch; no position is exploded.
    """
    events = df.select(*keys, F.explode(F.array(F.struct(start.alias("p"), F.lit(1).alias("d")), F.struct((end + 1).alias("p"), F.lit(-1).alias("d")))).alias("_e")).groupBy(*keys, F.col("_e.p").alias("run_start")).agg(F.sum("_e.d").alias("_d"))
    dealt = events.withColumn("_bin", F.floor(F.col("run_start") / stretch))
    order = Window.partitionBy(*keys).orderBy("_bin")
    sums = dealt.groupBy(*keys, "_bin").agg(F.sum("_d").alias("_s"), F.min("run_start").alias("_first"))
    sums = sums.select(*(F.col(k).alias(f"_c_{k}") for k in [*keys, "_bin"]), F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_so_far"), F.lead("_first").over(order).alias("_next"))
    within = Window.partitionBy(*keys, "_bin").orderBy("run_start")
    swept = dealt.join(sums, same_keys([*keys, "_bin"], "_c_")).withColumn("depth", F.coalesce("_so_far", F.lit(0)) + F.sum("_d").over(within))
    swept = swept.withColumn("run_end", F.coalesce(F.lead("run_start").over(within), "_next") - 1)
    return swept.where("depth > 0").select(*keys, "run_start", "run_end", "depth")


def paste(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with those of ``right`` at the same coordinates, null where it has none.

    The tracks must lie on one grid: a row of ``right`` at coordinates that ``left`` lacks ends the query with an error.
    """
    other = right.select(*(F.col(k).alias(f"_p_{k}") for k in keys), *(x for x in right.columns if x not in keys), F.lit(True).alias("_there"))
    met = left.withColumn("_here", F.lit(True)).join(other, same_keys(keys, "_p_"), "full")
    astray = F.concat(F.lit("coordinates of one track only: "), F.concat_ws(":", *(F.col(f"_p_{k}").cast("string") for k in keys)))
    checked = F.when(F.col("_here").isNull() & F.col("_there"), F.raise_error(astray).cast("boolean")).otherwise(True)
    return met.where(checked).drop("_here", "_there", *(f"_p_{k}" for k in keys))


def clip(df: DataFrame, lengths: DataFrame, chrom: str, start: str, end: str) -> DataFrame:
    """Ends cut to the chromosome's length, rows that start beyond it dropped; unknown chromosomes pass through."""
    known = lengths.select(F.col("chrom").alias("_c"), F.col("length").alias("_n"))
    met = df.join(known, F.col(chrom) == F.col("_c"), "left").where(F.col("_n").isNull() | (F.col(start) < F.col("_n")))
    return met.withColumn(end, F.coalesce(F.least(end, "_n"), F.col(end))).drop("_c", "_n")
