"""The tab-delimited breakpoint table, in all its versions.

Lines are read as text and split by expressions. A line has at least 41 columns; later versions
add contig columns, an id and a junction k-mer before the samples' blocks. Empty, missing and
undefined values are written as x, NA, '.', -1 and nan, and are null in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns in their order (fixed values); the raw header's two "alt" are told apart.
CORE = (
    "chr1 pos1 strand1 chr2 pos2 strand2 ref alt_allele span split alt_count cov cigar cigar_near dmq1 dmq2 dcn dct mapq1 mapq2 nm1 nm2 as1 as2 sub1 sub2 "
    "homol insert repeat contig_and_region naln conf type qual secondary somatic somlod maxlod dbsnp contig_conf1 contig_conf2 "
    "cpos1 cpos2 lmatch rmatch scov1 scov2 local1 local2 ctglen flipped bp_id jxn_kmer"
).split()
TEXT = {"chr1", "strand1", "chr2", "strand2", "ref", "alt_allele", "homol", "insert", "repeat", "contig_and_region", "conf", "type", "somatic", "dbsnp", "bp_id", "jxn_kmer"}
REAL = {"somlod", "maxlod", "contig_conf1", "contig_conf2"}
BLANK = {"homol": "x", "insert": "x", "repeat": "x", "dbsnp": "x", "somatic": "NA", "somlod": "NA", "bp_id": ".", "jxn_kmer": "."}
UNSET = {"span": -1, "cpos1": -1, "cpos2": -1}
SAMPLE = ("gt", "ad", "dp", "sr", "dr", "gq", "pl", "lo", "lo_n")
#: Core columns of the versions.
VERSIONS = {1: 41, 2: 51, 3: 52, 4: 53}


def type_of(name: str) -> str:
    return "string" if name in TEXT else "double" if name in REAL else "int"


def core_width(cells: Column) -> Column:
    """Core columns of a split line, told by what stands where the id and the k-mer would."""
    at = lambda k: F.get(cells, F.lit(k))
    has_id = at(51).rlike(r"^(\.|bp[^:]*)$")
    has_kmer = has_id & at(52).rlike(r"^([ACGTN]+|\.)$")
    more = (F.size(cells) >= 51) & ~at(41).contains(":")
    return F.when(has_kmer, 53).when(has_id, 52).when(more, 51).otherwise(41)


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """CORE columns, version and the sample blocks (array of strings) of each data line; comments and lines that are too short are left out."""
    cells = lines.where(~F.col(value).startswith("#")).select(F.split(value, "\t", -1).alias("_c")).where(F.size("_c") >= 41).withColumn("_w", core_width(F.col("_c")))
    columns = []
    for k, name in enumerate(CORE):
        raw = F.when(F.lit(k) < F.col("_w"), F.get("_c", F.lit(k)))
        raw = F.when(raw != BLANK[name], raw) if name in BLANK else raw
        typed = raw if type_of(name) == "string" else raw.try_cast(type_of(name))
        columns.append((F.when(typed != UNSET[name], typed) if name in UNSET else typed).alias(name))
    version = F.when(F.col("_w") == 53, 4).when(F.col("_w") == 52, 3).when(F.col("_w") == 51, 2).otherwise(1)
    return cells.select(*columns, version.alias("version"), F.slice("_c", F.col("_w") + 1, F.greatest(F.lit(0), F.size("_c") - F.col("_w"))).alias("samples"))


def sample_rows(calls: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row for each call and sample: (keys, sample, the fields of its block)."""
    zipped = F.explode(F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("name"), F.col("samples").alias("block")))
    rows = calls.select(*keys, zipped.alias("_s")).select(*keys, F.substring("_s.name", 1, 4).alias("sample"), F.split("_s.block", ":").alias("_f"))
    number = lambda k, t: F.regexp_replace(F.get("_f", F.lit(k)), "^-?nan$", "0").try_cast(t)
    pl = F.transform(F.split(F.get("_f", F.lit(6)), ","), lambda x: x.try_cast("int"))
    typed = {"gt": F.get("_f", F.lit(0)), "pl": F.when((F.size(pl) == 3) & ~F.exists(pl, lambda x: x.isNull()), pl)}
    for k, name in enumerate(SAMPLE):
        typed.setdefault(name, number(k, "double" if name in ("gq", "lo", "lo_n") else "int"))
    return rows.select(*keys, "sample", *(typed[n].alias(n) for n in SAMPLE))


def header_samples(header: str) -> list[str]:
    """Sample columns of a header line: from the first cell at 34 or later that begins with t or n."""
    cells = header.rstrip("\n").split("\t")
    if len(cells) < 41:
        raise ValueError("a header has at least 41 columns")
    first = next((k for k, x in enumerate(cells) if k >= 34 and x[:1] in ("t", "n")), len(cells))
    return cells[first:]


def lines(calls: DataFrame) -> DataFrame:
    """Calls as text lines: blanks restored, somatic odds at most 99."""
    columns = []
    for name in CORE:
        x = F.when(F.col(name) > 99, 99.0).otherwise(F.col(name)) if name == "somlod" else F.col(name)
        text = x.cast("string")
        columns.append(F.coalesce(text, F.lit(str(UNSET[name]) if name in UNSET else BLANK.get(name, ""))))
    blocks = [F.array_join("samples", "\t")] if "samples" in calls.columns else []
    whole = F.concat_ws("\t", *columns)
    return calls.select((F.when(F.size("samples") > 0, F.concat_ws("\t", whole, *blocks)).otherwise(whole) if blocks else whole).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def write(calls: DataFrame, path: str) -> None:
    lines(calls).write.text(path, compression="gzip")
