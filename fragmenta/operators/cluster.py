"""Clusters of discordant reads and their comparison with breakpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.operators import intervals as iv

#: Greatest gap within a cluster, its greatest width before it is broken, its least size.
GAP, WIDEST, LEAST = 150, 3000, 2
#: Padding when clusters meet breakpoints or each other, and when mates are picked up.
PAD, MATE_PAD = 100, 1150


def _places(df: DataFrame, keys: list[str], pos: str, gap: int, stretch: int) -> DataFrame:
    """(keys, pos, island) of the distinct positions: runs within stretches, numbered on by one row of each stretch."""
    dealt = df.where(F.col(pos).isNotNull()).select(*keys, pos).distinct().withColumn("_bin", F.floor(F.col(pos) / stretch))
    order = Window.partitionBy(*keys, "_bin").orderBy(pos)
    new = dealt.withColumn("_stretch_new", F.coalesce((F.col(pos) - F.lag(pos).over(order) > gap).cast("long"), F.lit(0)))
    sums = new.groupBy(*keys, "_bin").agg(F.min(pos).alias("_stretch_first"), F.max(pos).alias("_stretch_last"), F.sum("_stretch_new").alias("_stretch_n"))
    stretches = Window.partitionBy(*keys).orderBy("_bin")
    head = F.when(F.col("_stretch_first") - F.lag("_stretch_last").over(stretches) <= gap, 0).otherwise(1)
    sums = sums.withColumn("_stretch_head", head).withColumn("_stretch_base", F.sum(F.col("_stretch_n") + F.col("_stretch_head")).over(stretches.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_stretch_n"))
    sums = sums.select(*(F.col(k).alias(f"_c_{k}") for k in [*keys, "_bin"]), "_stretch_base")
    met = new.join(sums, iv.same_keys([*keys, "_bin"], "_c_"))
    return met.select(*keys, pos, (F.col("_stretch_base") + F.sum("_stretch_new").over(order)).cast("long").alias("island"))


def _placed(df: DataFrame, places: DataFrame, keys: list[str], pos: str, added: list[str]) -> DataFrame:
    narrow = places.select(*(F.col(k).alias(f"_i_{k}") for k in [*keys, pos]), *added)
    return df.join(narrow, iv.same_keys([*keys, pos], "_i_"), "left").select(*df.columns, *added)


def islands(df: DataFrame, keys: list[str], pos: str, tie: list[str], gap: int = GAP, stretch: int = iv.STRETCH) -> DataFrame:
    """Adds ``island``: rows of the same keys whose positions follow each other by at most ``gap``; numbered from 1 by position.

    Found on distinct positions, stretch by stretch; ``tie`` does not bear on it. Rows without a position have no island.
    """
    return _placed(df, _places(df, keys, pos, gap, stretch), keys, pos, ["island"])


def capped_islands(df: DataFrame, keys: list[str], pos: str, tie: list[str], gap: int = GAP, widest: int = WIDEST) -> DataFrame:
    """Islands that are also broken once they already span more than ``widest``: adds ``island`` and ``part`` within it.

    The break depends on where the last one was. Only islands wider than the cap are folded, on
    their distinct positions; the fold's state is one position, so long islands stream through it.
    """
    places = _places(df, keys, pos, gap, iv.STRETCH)
    group = [*keys, "island"]
    wide = places.groupBy(*group).agg(F.array_sort(F.collect_list(pos)).alias("_ps")).where(F.element_at("_ps", -1) - F.element_at("_ps", 1) > widest)
    # the start of the part of each place: a new one begins where the last place already lay beyond the cap
    fold = F.aggregate("_ps", F.struct(F.element_at("_ps", 1).alias("s"), F.element_at("_ps", 1).alias("l"), F.array().cast("array<bigint>").alias("o")), lambda a, p: F.struct(F.when(a["l"] - a["s"] > widest, p).otherwise(a["s"]).alias("s"), p.alias("l"), F.when(a["l"] - a["s"] > widest, F.concat(a["o"], F.array(p))).otherwise(a["o"]).alias("o")))
    cuts = wide.select(*(F.col(k).alias(f"_g_{k}") for k in group), fold["o"].alias("_cuts"))
    met = places.join(cuts, iv.same_keys(group, "_g_"), "left")
    part = F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col(pos))), F.lit(0)).cast("long")
    parts = met.withColumn("part", F.when(F.col("_cuts").isNull(), F.lit(0).cast("long")).otherwise(part))
    return _placed(df, parts, keys, pos, ["island", "part"])


def cluster_id(orientation: Column, chr1: Column, pos1: Column, chr2: Column, pos2: Column) -> Column:
    """ORT_chr1_pos1___chr2_pos2."""
    return F.concat(orientation, F.lit("_"), chr1.cast("string"), F.lit("_"), pos1.cast("string"), F.lit("___"), chr2.cast("string"), F.lit("_"), pos2.cast("string"))


def summarize(members: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cluster of at least LEAST reads: counts by class, hull of both sides, mean MAPQ (truncated), mean NM.

    The mate side's hull ends at the greatest mate position plus the read length, whatever the order of reads.
    """
    return (
        members.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("sample").startswith("t")).alias("tcount"),
            F.count_if(F.col("sample").startswith("n")).alias("ncount"),
            F.min("pos").alias("start1"),
            (F.max("pos") + F.max("readlen")).alias("end1"),
            F.min("mate_pos").alias("start2"),
            (F.max("mate_pos") + F.max("readlen")).alias("end2"),
            F.floor(F.avg("mapq")).cast("int").alias("mapq"),
            F.round(F.avg("nm"), 6).alias("nm"),
        )
        .where(F.col("n") >= LEAST)
    )


def is_valid(chr1: Column, chr2: Column, strand1: Column, strand2: Column, end1: Column, start2: Column) -> Column:
    """Clusters whose sides lie apart, or of an orientation for which that doesn't matter."""
    return (chr1 != chr2) | ((strand1 == "-") & (strand2 == "+")) | ~(end1 > start2)


def second_level(members: DataFrame, keys: list[str], gap: int = GAP) -> DataFrame:
    """Each cluster (``keys`` and its ``island``) split again by mate strand and gaps of mate positions: adds ``mate_island``."""
    first = members.withColumnRenamed("island", "_first")
    split = islands(first, [*keys, "_first", "mate_strand"], "mate_pos", ["qname", "mate"], gap)
    return split.withColumnRenamed("island", "mate_island").withColumnRenamed("_first", "island")


def best_cluster(bps: DataFrame, clusters: DataFrame, pad: int = PAD) -> DataFrame:
    """(bp_num, cluster): of the clusters that overlap both ends within ``pad`` on the same strands, that with most normal, then tumour reads, then the smallest id."""
    ends = ["chr1", "pos1", "strand1", "chr2", "pos2", "strand2"]
    hull = ["c_chr1", "c_start1", "c_end1", "c_strand1", "c_chr2", "c_start2", "c_end2", "c_strand2"]
    # of clusters with one hull only the best can win, and calls at one place have the same: pile-ups meet once
    rank = F.struct(-F.col("c_ncount"), -F.col("c_tcount"), F.col("c_id"))
    best = clusters.groupBy(*hull).agg(F.min(F.struct(rank.alias("r"), F.col("c_id").alias("id"))).alias("_best"))
    places = bps.select(*ends).distinct()
    met = iv.overlap_join(places, best, [("chr1", "c_chr1"), ("chr2", "c_chr2"), ("strand1", "c_strand1"), ("strand2", "c_strand2")], (F.col("pos1") - pad, F.col("pos1") + pad), (F.col("c_start1"), F.col("c_end1")), 512)
    met = met.where((F.col("pos2") - pad <= F.col("c_end2")) & (F.col("c_start2") <= F.col("pos2") + pad))
    found = met.groupBy(*(F.col(x).alias(f"_{x}") for x in ends)).agg(F.min("_best")["id"].alias("cluster"))
    return bps.join(found, [F.col(x) == F.col(f"_{x}") for x in ends]).select("bp_num", "cluster")


def competing(clusters: DataFrame, pad: int = PAD, span: int = 800) -> DataFrame:
    """Ids of clusters that another one of other strands overlaps on both sides within ``pad``, and that are large or between chromosomes."""
    hull = ["c_chr1", "c_start1", "c_end1", "c_strand1", "c_chr2", "c_start2", "c_end2", "c_strand2"]
    hulls = clusters.select(*hull).distinct()  # clusters of one hull have the same strands, so none competes with another
    other = hulls.select(*(F.col(x).alias(f"o_{x}") for x in hull))
    met = iv.overlap_join(hulls, other, [("c_chr1", "o_c_chr1"), ("c_chr2", "o_c_chr2")], (F.col("c_start1") - pad, F.col("c_end1") + pad), (F.col("o_c_start1"), F.col("o_c_end1")), 512)
    met = met.where((F.col("c_start2") - pad <= F.col("o_c_end2")) & (F.col("o_c_start2") <= F.col("c_end2") + pad))
    met = met.where((F.col("c_strand1") != F.col("o_c_strand1")) | (F.col("c_strand2") != F.col("o_c_strand2")))
    size = F.when(F.col("c_chr1") == F.col("c_chr2"), F.abs(F.col("c_start2") - F.col("c_start1"))).otherwise(-1)
    found = met.where((size > span) | (size == -1)).select(*(F.col(x).alias(f"_{x}") for x in hull)).distinct()
    return clusters.join(found, [F.col(x) == F.col(f"_{x}") for x in hull], "left_semi").select("c_id").distinct()


def pick_up_mates(reads: DataFrame) -> DataFrame:
    """(qname, mate, other): other records of the same fragment and orientation near the first one's mate position."""
    a = reads.select("qname", "mate", "chr", "strand", "mate_chr", "mate_pos")
    b = reads.select(F.col("qname").alias("q"), F.col("mate").alias("other"), F.col("chr").alias("b_chr"), F.col("pos").alias("b_pos"), F.col("strand").alias("b_strand"))
    near = (F.col("qname") == F.col("q")) & (F.col("mate") != F.col("other")) & (F.col("mate_chr") == F.col("b_chr")) & (F.abs(F.col("b_pos") - F.col("mate_pos")) <= MATE_PAD)
    return a.join(b, near).select("qname", "mate", "other").distinct()

