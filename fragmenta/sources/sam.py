"""SAM text as a table of reads, and back.

Binary alignment files are not decoded here; they come in as SAM text or as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("qname string", "flag int", "chr string", "pos int", "mapq int", "cigar string", "mate_chr string", "mate_pos int", "isize int", "seq string", "qual string")
#: Phred values below this are trimmed off the ends.
TRIM = 3


def _tag(cells: Column, name: str) -> Column:
    found = F.filter(cells, lambda x: x.startswith(f"{name}:"))
    return F.regexp_extract(F.get(found, F.lit(0)), r"^..:.:(.*)$", 1)


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """FIELDS, rg ('NA' if absent) and nm (-1 if absent); header lines and lines of fewer than 11 columns are left out; '=' is the read's own chromosome."""
    cells = lines.where(~F.col(value).startswith("@")).select(F.split(value, "\t").alias("c")).where(F.size("c") >= 11)
    columns = []
    for k, field in enumerate(FIELDS):
        name, kind = field.split()
        raw = F.get("c", F.lit(k))
        raw = F.when(raw == "=", F.get("c", F.lit(2))).otherwise(raw) if name == "mate_chr" else raw
        columns.append((raw.try_cast("int") if kind == "int" else raw).alias(name))
    tags = F.slice("c", 12, F.greatest(F.lit(0), F.size("c") - 11))
    return cells.select(*columns, F.coalesce(F.nullif(_tag(tags, "RG"), F.lit("")), F.lit("NA")).alias("rg"), F.coalesce(_tag(tags, "NM").try_cast("int"), F.lit(-1)).alias("nm"))


def lines(reads: DataFrame) -> DataFrame:
    """Reads as SAM lines with RG and NM tags."""
    cells = [F.coalesce(F.col(f.split()[0]).cast("string"), F.lit("*")) for f in FIELDS]
    return reads.select(F.concat_ws("\t", *cells, F.concat(F.lit("RG:Z:"), F.col("rg")), F.concat(F.lit("NM:i:"), F.col("nm").cast("string"))).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def quality_trim(seq: Column, qual: Column, least: int = TRIM) -> Column:
    """``seq`` without the bases of a quality below ``least`` at both ends; '' if none is better."""
    low = "".join(chr(33 + q) for q in range(least))
    head = F.length(qual) - F.length(F.ltrim(qual, F.lit(low)))
    kept = F.length(F.btrim(qual, F.lit(low)))
    return F.substring(seq, (head + 1).cast("int"), kept.cast("int"))


def append_program(header: list[str], name: str, version: str, command: str) -> list[str]:
    """A header with one more @PG line: its id made unique, its PP the chain's last program."""
    programs = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in header if line.startswith("@PG")]
    ids, used = [p["ID"] for p in programs], {p.get("PP") for p in programs}
    last = next((i for i in reversed(ids) if i not in used), None)
    ident, k = name, 0
    while ident in ids:
        k += 1
        ident = f"{name}.{k}"
    line = "\t".join(["@PG", f"ID:{ident}", f"PN:{name}", f"VN:{version}", f"CL:{command}", *([f"PP:{last}"] if last else [])])
    return [*header, line]
