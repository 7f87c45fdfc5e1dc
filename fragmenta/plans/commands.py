"""The engine's commands as plans: postprocess, refilter, to VCF, extract pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragmenta.functions import model, vcf
from fragmenta.functions.sequence import chromosome_key, reverse_complement
from fragmenta.operators import classify, dedup, support
from fragmenta.sources import bps as bps_source

#: Defaults of the refilter (fixed values).
LOD, LOD_DB, SOMATIC_LOD, SOMATIC_LOD_DB, READLEN = 1.0, 1.0, 0.0, 2.0, 150


def numbered(df: DataFrame, order: list[Column], name: str, lead: Column, parts: int = 200) -> DataFrame:
    """All rows numbered from 1 by ``order``, dealt by ranges of ``lead``, a whole number that ascends with it (null: first).

    Ranges end at quantiles; each is numbered for itself, behind the rows of those before. Rows of
    one value of ``lead`` stay together.
    """
    keyed = df.withColumn("_lead", F.coalesce(lead.cast("long"), F.lit(-(1 << 62))))
    ends = keyed.agg(F.percentile_approx("_lead", [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    ends = sorted(set(ends))
    dealt = keyed.withColumn("_part", _range_of(F.col("_lead"), ends))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    met = dealt.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return met.withColumn(name, rank).drop("_lead", "_part", "_p", "_before")


def _range_of(value: Column, ends: list[int], first: int = 0) -> Column:
    """The number of ``ends`` below ``value``, by halving."""
    if not ends:
        return F.lit(first)
    half = len(ends) // 2
    return F.when(value > ends[half], _range_of(value, ends[half + 1 :], first + half + 1)).otherwise(_range_of(value, ends[:half], first))


def place(chrom: Column, pos: Column) -> Column:
    """A whole number that ascends with (chrom, pos)."""
    return chrom.cast("long") * (1 << 33) + F.coalesce(pos.cast("long"), F.lit(0))


def postprocess(calls: DataFrame) -> dict[str, DataFrame]:
    """``sorted``, ``dedup``, ``passed``, ``somatic`` and ``contigs`` of parsed calls.

    Ends are keyed by the chromosomes' order, under which all non-standard contigs are one.
    """
    keyed = calls.withColumn("k1", chromosome_key(F.col("chr1"))).withColumn("k2", chromosome_key(F.col("chr2")))
    order = [F.col("k1"), F.when(F.col("k1") >= 1000, F.col("chr1")).asc_nulls_first(), F.col("pos1"), F.col("strand1"), F.col("k2"), F.when(F.col("k2") >= 1000, F.col("chr2")).asc_nulls_first(), F.col("pos2"), F.col("strand2"), F.coalesce(F.col("maxlod"), F.lit(-1e30)).cast("float").desc(), F.col("bp_id")]
    key = dedup.canonical_ends(F.col("k1"), F.col("pos1"), F.col("strand1"), F.col("k2"), F.col("pos2"), F.col("strand2"))
    rank = F.struct(F.coalesce(F.col("somlod"), F.lit(-1e30)).cast("float"), -F.coalesce(F.col("maxlod"), F.lit(-1e30)).cast("float"), F.col("bp_id"))
    one = keyed.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*keyed.columns), rank).alias("_row")).select("_row.*")
    passed = one.where("conf = 'PASS'")
    contigs = passed.groupBy(F.col("contig_and_region").alias("cname")).agg(F.max(F.when(F.col("somatic") == "1", 1).otherwise(0)).alias("somatic"))
    clean = lambda df: df.drop("k1", "k2")
    return {"sorted": clean(keyed.orderBy(*order)), "dedup": clean(one.orderBy(*order)), "passed": clean(passed.orderBy(*order)), "somatic": clean(passed.where("somatic = '1'").orderBy(*order)), "contigs": contigs}


def refilter(calls: DataFrame, names: list[str], lod: float = LOD, lod_db: float = LOD_DB, somatic: float = SOMATIC_LOD, somatic_db: float = SOMATIC_LOD_DB, readlen: int = READLEN) -> DataFrame:
    """Indel calls scored again under other cutoffs, from their sample blocks; blacklisted calls keep their code."""
    rows = bps_source.sample_rows(calls, names, ["bp_id"])
    called = rows.select("bp_id", F.substring("sample", 1, 1).alias("k"), "ad", "dp", model.call_sample(F.col("ad"), F.col("dp"), F.lit(1e-3), readlen).alias("s"))
    sums = called.groupBy(F.col("bp_id").alias("_b")).agg(
        F.max("s.lo").alias("max_lod"), *(F.sum(F.when(F.col("k") == k, F.col(x)).otherwise(0)).alias(f"{k}_{x}") for k in "tn" for x in ("ad", "dp"))
    )
    met = calls.join(sums, F.col("bp_id") == F.col("_b"), "left").drop("_b")
    scored = met.withColumns({"in_dbsnp": F.col("dbsnp").isNotNull(), "refilter": F.lit(True), "lod": F.lit(lod), "lod_db": F.lit(lod_db), "left_match": F.col("lmatch"), "right_match": F.col("rmatch"), "conf1": F.coalesce("contig_conf1", F.lit(1.0)), "conf2": F.coalesce("contig_conf2", F.lit(1.0))})
    usable = lambda x: model.usable_cover(F.greatest(F.col(f"{x}_dp"), F.col(f"{x}_ad")), readlen)
    odds = model.somatic_lod(F.least(F.col("n_ad").cast("double"), usable("n")), usable("n"), F.least(F.col("t_ad").cast("double"), usable("t")), usable("t"), F.lit(1e-3))
    state = classify.somatic_state(F.col("type"), odds, F.col("t_ad"), F.col("n_ad"), F.lit(0), F.lit(0), F.col("in_dbsnp"), somatic, somatic_db)
    code = F.when(F.col("conf") == "BLACKLIST", "BLACKLIST").when(F.col("type") == "INDEL", classify.ladder(classify.INDEL)).otherwise(F.col("conf"))
    again = scored.withColumns({"conf": code, "somlod": odds, "maxlod": F.greatest(F.lit(0.0), F.col("max_lod")), "somatic": F.when(state == "SOMATIC", "1").otherwise("0")})
    return again.select(*calls.columns)


def breakend_records(calls: DataFrame, qual_mode: str = "maxlod") -> DataFrame:
    """Two records of each call: (chrom, pos, id, ref, alt, qual, filter, info)."""
    c = F.col
    ident = c("bp_num").cast("string")
    ends = []
    for k, (own, mate) in enumerate((("1", "2"), ("2", "1")), 1):
        alt = vcf.bnd_alt(F.lit("N"), c(f"chr{mate}"), c(f"pos{mate}"), c(f"strand{own}"), c(f"strand{mate}"))
        ends.append(F.struct(c(f"chr{own}").alias("chrom"), c(f"pos{own}").alias("pos"), F.concat(ident, F.lit(f":{k}")).alias("id"), alt.alias("alt"), F.concat(ident, F.lit(f":{3 - k}")).alias("mate")))
    rows = calls.withColumn("_e", F.explode(F.array(*ends)))
    info = vcf.info({"EVENT": ident, "MATEID": c("_e.mate"), "SVTYPE": F.lit("BND"), "SPAN": F.when(c("chr1") == c("chr2"), F.abs(c("pos2") - c("pos1"))).otherwise(-1).cast("string"), "SOMATIC": (c("somlod") >= 1).cast("string"), "MAXLOD": vcf.significant(c("maxlod").cast("double"))})
    return rows.select("_e.chrom", "_e.pos", "_e.id", F.lit("N").alias("ref"), "_e.alt", vcf.qual(qual_mode, c("somlod"), c("maxlod")).alias("qual"), c("conf").alias("filter"), info.alias("info"))


def symbolic_records(calls: DataFrame, qual_mode: str = "maxlod") -> DataFrame:
    """One record of each call within a chromosome, at its lower end: <DEL>, <DUP> or <INV>."""
    c = F.col
    kind = vcf.symbolic_kind(c("chr1") == c("chr2"), c("strand1"), c("strand2"))
    low, high = F.least("pos1", "pos2"), F.greatest("pos1", "pos2")
    info = vcf.info({"END": high.cast("string"), "SVTYPE": kind, "SVLEN": F.when(kind == "DEL", low - high).otherwise(high - low).cast("string"), "SVCLAIM": F.when(kind == "INV", "J").otherwise("DJ"), "SOMATIC": (c("somlod") >= 1).cast("string")})
    return calls.select(c("chr1").alias("chrom"), low.alias("pos"), c("bp_num").cast("string").alias("id"), F.lit("N").alias("ref"), F.concat(F.lit("<"), kind, F.lit(">")).alias("alt"), vcf.qual(qual_mode, c("somlod"), c("maxlod")).alias("qual"), c("conf").alias("filter"), info.alias("info"))


HEADER = ["##fileformat=VCFv4.5", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


def write_vcf(records: DataFrame, path: str, gzip: bool = True) -> None:
    """Sorted text records; the header is a file of its own that sorts first. One file only if the caller coalesces."""
    lines = records.orderBy("chrom", "pos", "id").select(F.concat_ws("\t", *(F.coalesce(F.col(x).cast("string"), F.lit(".")) for x in records.columns)).alias("value"))
    spark = records.sparkSession
    spark.createDataFrame([("\n".join(HEADER),)], "value string").coalesce(1).write.text(f"{path}/header")
    lines.write.text(f"{path}/records", compression="gzip" if gzip else "none")


def extract_pairs(reads: DataFrame, patterns: DataFrame, k: int, counts: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """All reads of fragments that contain a pattern or its reverse complement, and distinct (bp_id, qname, mate) counts of primary reads.

    ``reads`` has qname, mate, flag and seq; ``patterns`` has pattern and bp_id; all patterns have k bases or more.
    """
    both = support.with_reverse(patterns, "pattern", reverse_complement(F.col("pattern")))
    hits = support.kmer_hits(reads.select("qname", "mate", "flag", "seq"), both, k)
    found = support.fragments_of(reads, hits)
    if not counts:
        return found, None
    primary = hits.where(F.col("flag").bitwiseAND(F.lit(0x900 | 0x400)) == 0)
    return found, primary.groupBy("bp_id").agg(F.count_distinct("qname", "mate").alias("n")).orderBy("bp_id")
