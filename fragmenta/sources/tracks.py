"""Region tracks, runtimes, learned inserts, dbSNP and VCF text: readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME = "chromosome string, start int, end int, tumor_weird int, normal_weird int, tumor_mate int, normal_mate int, discordant_reads int, discordant_clusters int, contigs int, contigs_pass int, bps int, runtime_seconds double, pct_r int, pct_m int, pct_k int, pct_as int"
LEARN = "bam string, rg string, isize int"
CLUSTERS = "chr1 string, pos1 int, strand1 string, chr2 string, pos2 int, strand2 string, tcount int, ncount int, mapq1 int, mapq2 int, nm1 double, nm2 double, cname string, id string"


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, start, end, label, source) of one or more tracks; half-open ends; header and comment lines are left out."""
    cells = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)")).select(F.split("value", r"\s+").alias("c"), F.input_file_name().alias("source"))
    at = lambda k: F.get("c", F.lit(k))
    return cells.select(at(0).alias("chrom"), at(1).try_cast("long").alias("start"), at(2).try_cast("long").alias("end"), at(3).alias("label"), "source").where("start IS NOT NULL AND end IS NOT NULL")


def read_runtime(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=RUNTIME, mode="DROPMALFORMED")


def read_learn(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=LEARN, mode="DROPMALFORMED").where("isize > 0")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Discordant clusters: the file's header has a cell too many, so its own names are not used."""
    return spark.read.csv(path, sep="\t", schema=CLUSTERS, mode="DROPMALFORMED").where("pos1 IS NOT NULL")


def read_dbsnp(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, id, ref, alt) of a VCF's indels: from the position to one past it, or past the deleted bases."""
    cells = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", r"\s+").alias("c"))
    at = lambda k: F.get("c", F.lit(k))
    rows = cells.select(at(0).alias("chrom"), at(1).try_cast("long").alias("start"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"))
    return rows.where(F.length("ref") + F.length("alt") > 2).withColumn("end", F.when(F.length("ref") == 1, F.col("start") + 1).otherwise(F.col("start") + F.length("ref") + 1))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) of a list of sequences, one a line, or of a breakpoint table's junction k-mers; distinct, normalised, comments skipped."""
    from fragmenta.functions.sequence import normalize
    from fragmenta.sources import bps

    text = spark.read.text(path)
    first = text.first()
    if first is not None and first.value.startswith("#chr1\t"):
        return bps.parse(text).where("jxn_kmer IS NOT NULL").select(F.col("jxn_kmer").alias("pattern"), F.col("bp_id")).distinct()
    return text.where(~F.col("value").rlike(r"^\s*(#|$)")).select(normalize(F.col("value")).alias("pattern")).distinct()


def parse_regions(spec: str, exists=os.path.exists) -> list[tuple[str, int | None, int | None]] | str:
    """A region argument: an existing file's path, ``chr:a-b`` (the whole text, commas in numbers), or a list of chromosomes and regions; '' is everything."""
    if not spec:
        return []
    if exists(spec):
        return spec
    if ":" in spec and "-" in spec:
        chrom, _, span = spec.partition(":")
        a, _, b = span.replace(",", "").partition("-")
        return [(chrom, int(a), int(b))]
    return [(x, None, None) for x in spec.split(",") if x]


def write_tsv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.csv(path, sep="\t", header=True, compression="gzip" if gzip else "none")


def write_by_sample(df: DataFrame, path: str, sample: str = "sample") -> None:
    """One folder for each sample (the first four characters of a read's name)."""
    df.write.partitionBy(sample).parquet(path)


def read_fasta(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """(chrom, chunk, seq): the bases of each record in chunks of a fixed size, for equality joins on the chunk.

    Lines are numbered within their files' order of bytes; a record is folded in one task, in parts.
    """
    text = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", ">"), lambda r: r != "")).alias("r"))
    rows = text.select(F.regexp_extract("r", r"^(\S+)", 1).alias("chrom"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n", ""), r"\s", "").alias("s"))
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length(s) - 1) div {chunk}"))))
    return rows.withColumn("chunk", places).select("chrom", "chunk", F.expr(f"substring(s, chunk * {chunk} + 1, {chunk})").alias("seq"))


def fetch_bases(fasta: DataFrame, sites: DataFrame, length: int = 1, chunk: int = 10_000) -> DataFrame:
    """``sites`` (chrom, pos from 1) with ``bases``: joined on the chunks that each site touches."""
    at = F.explode(F.sequence(F.expr(f"(pos - 1) div {chunk}"), F.expr(f"(pos - 1 + {length} - 1) div {chunk}"))).alias("_k")
    keyed = sites.select("*", at)
    met = keyed.join(fasta.select(F.col("chrom").alias("_c"), F.col("chunk").alias("_j"), "seq"), (F.col("chrom") == F.col("_c")) & (F.col("_k") == F.col("_j")))
    low, high = F.greatest(F.col("pos") - 1 - F.col("_k") * chunk, F.lit(0)), F.least(F.col("pos") - 1 + length - F.col("_k") * chunk, F.lit(chunk))
    part = F.substring(F.col("seq"), (low + 1).cast("int"), (high - low).cast("int"))
    whole = met.groupBy(*sites.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", part.alias("p")))), lambda x: x["p"]), "").alias("bases"))
    return whole
