"""VCF fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(x: Column, digits: int = 4) -> Column:
    """A number as C's %.{digits}g writes it: so many significant digits, no trailing zeros, an exponent below 1e-4 or from 10**digits.

    Ties of the shortest decimal form go up, where C decides by the binary value.
    """
    shown = F.format_string(f"%.{digits - 1}e", x.cast("double"))  # rounds, and may carry into the next exponent
    power = F.when(x == 0, F.lit(0)).otherwise(F.regexp_extract(shown, r"e([+-]\d+)$", 1).cast("int"))
    mantissa = F.regexp_replace(F.regexp_replace(F.regexp_extract(shown, r"^([^e]+)", 1), r"0+$", ""), r"\.$", "")
    plain = F.array(*(F.format_string(f"%.{max(0, digits - 1 - k)}f", x.cast("double")) for k in range(-4, digits)))
    fixed = F.get(plain, power + 4)
    fixed = F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")).otherwise(fixed)
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(x.isNull(), None).when((power < -4) | (power >= digits), exponent).otherwise(fixed)


def bnd_alt(ref: Column, mate_chrom: Column, mate_pos: Column, strand: Column, mate_strand: Column) -> Column:
    """ALT of a breakend with its mate's place in brackets: the base leads on '+', the brackets open on a mate of '-'."""
    bracket = F.when(mate_strand == "+", "]").otherwise("[")
    place = F.concat(bracket, mate_chrom.cast("string"), F.lit(":"), mate_pos.cast("string"), bracket)
    return F.when(strand == "+", F.concat(ref, place)).otherwise(F.concat(place, ref))


def symbolic_kind(same_chrom: Column, strand1: Column, strand2: Column) -> Column:
    """The writer's kinds: equal strands DEL, -+ DUP, +- INV; BND between chromosomes."""
    return F.when(~same_chrom, "BND").when(strand1 == strand2, "DEL").when(strand1 == "-", "DUP").otherwise("INV")


def viewer_kind(same_chrom: Column, strand1: Column, strand2: Column) -> Column:
    """The viewer's kinds, which read the same strands otherwise."""
    return F.when(~same_chrom, "Translocation-like").when(strand1 == strand2, "Inversion").when(strand1 == "-", "Duplication-like").otherwise("Deletion-like")


def qual(mode: str, stored: Column, maxlod: Column) -> Column:
    """QUAL by mode: missing '.', maxlod, or the stored sum."""
    if mode == "missing":
        return F.lit(".")
    if mode == "maxlod":
        return F.least(F.lit(99), F.round(10 * F.greatest(F.lit(0.0), maxlod.cast("double")))).cast("int").cast("string")
    if mode == "sum":
        return stored.cast("string")
    raise ValueError(f"no QUAL mode {mode}")


def ref_alt(ref_bases: Column, span: Column, inserted: Column) -> Column:
    """struct(ref, alt) of an indel: an insertion is one base and what follows it, a deletion its span and its first base; N where bases lack."""
    known = F.when(F.length(ref_bases) > 0, ref_bases).otherwise("N")
    one = F.substring(known, 1, 1)
    long = F.length(inserted) > 0
    return F.struct(F.when(long, one).otherwise(F.substring(known, F.lit(1), span + 1)).alias("ref"), F.when(long, F.concat(one, inserted)).otherwise(one).alias("alt"))


def info(fields: dict[str, Column], last: str = "READ_ID") -> Column:
    """key=value pairs in order of keys, ``last`` at the end; true is a flag, null and false are left out."""
    parts = []
    for name in [*sorted(k for k in fields if k != last), *(k for k in (last,) if k in fields)]:
        value = fields[name]
        parts.append(F.when(value == "true", name).when(value.isNotNull() & (value != "false"), F.concat(F.lit(f"{name}="), value)))
    return F.concat_ws(";", *parts)
