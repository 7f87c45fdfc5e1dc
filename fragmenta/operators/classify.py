"""Ordered classification ladders: the first condition that holds gives the code.

Conditions are SQL over named columns, so a ladder can be printed, tested and run by any engine.
Columns: span (-1 between chromosomes), split counts a_split, t_split, n_split; mapq, nm, matchlen,
as and contig confidence of both ends (1, 2); cov_span; homol and seq lengths; readlen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGE = "(span > 1500 OR span = -1)"
_AS = "least(as1 / CAST(matchlen1 AS DOUBLE), as2 / CAST(matchlen2 AS DOUBLE))"
_MATCH, _MAPQ, _TOP, _NM = "least(matchlen1, matchlen2)", "least(mapq1, mapq2)", "greatest(mapq1, mapq2)", "greatest(nm1, nm2)"

#: Calls from assembly alone. The matchlen - homology rung is unsigned: a negative difference counts as huge.
ASSEMBLY = [
    ("NOLOCAL", "is_distant AND NOT tsi_local"),
    ("LOCALMATCH", "nonvar_local"),
    ("DUPREADS", "t_split + n_split > 1 AND ((cov_span <= readlen + 5 AND cov_span > 0) OR cov_span < 0)"),
    ("NODISC", f"homol_len >= 20 AND {LARGE} AND {_TOP} < 60"),
    ("TOOSHORT", "seq_len < readlen + 30"),
    ("NODISC", f"a_split < 7 AND {LARGE}"),
    ("LOWMAPQ", f"{_TOP} <= 40 OR {_MAPQ} <= 10"),
    ("LOWMAPQ", f"{_MAPQ} <= 30 AND a_split <= 8"),
    ("LOWAS", f"{_NM} >= 10 OR {_AS} < 0.8"),
    ("LOWAS", f"({_NM} >= 3 OR {_AS} < 0.85) AND span < 0"),
    ("LOWMAPQ", "(matchlen1 < 50 AND mapq1 < 60) OR (matchlen2 < 50 AND mapq2 < 60)"),
    ("LOWMAPQ", "least(nm1, nm2) >= 10"),
    ("LOWSPLITSMALL", "a_split <= 3 AND span <= 1500 AND span <> -1"),
    ("LOWICSUPPORT", f"chr1 <> chr2 AND {_MATCH} < 60"),
    ("LOWICSUPPORT", f"chr1 <> chr2 AND {_NM} >= 3 AND {_MATCH} < 150"),
    ("LOWICSUPPORT", f"{_MATCH} < 0.6 * readlen"),
    ("LOWMAPQ", f"{_MAPQ} < 50 AND chr1 <> chr2"),
    ("LOWMATCHLEN", f"{_MATCH} < 40 OR (tsi_local AND {_MATCH} < 100)"),
    ("LOWMATCHLEN", "(matchlen1 - homol_len BETWEEN 0 AND 39) OR (matchlen2 - homol_len BETWEEN 0 AND 39)"),
    ("LOWMAPQ", "mapq1 < 30 OR mapq2 < 30"),
    ("SECONDARY", f"secondary AND {_MAPQ} < 30"),
    ("LOWQINVERSION", "t_split + n_split < 6 AND span < 300 AND strand1 = strand2"),
    ("HIGHHOMOLOGY", "homol_len * 4 > readlen"),
    ("WEAKCONTIG", "least(conf1, conf2) < 0.5"),
]

#: Calls from assembly and discordant reads.
BOTH = [
    ("LOWMAPQ", "(greatest(mapq1, dc_mapq1) < 30 AND distant1) OR (greatest(mapq2, dc_mapq2) < 30 AND distant2) OR (mapq1 < 10 AND distant1) OR (mapq2 < 10 AND distant2)"),
    ("LOWMAPQ", "least(nm1, nm2) >= 10"),
    ("LOWMAPQ", f"{_MAPQ} < 10"),
    ("LOWSUPPORT", "t_alt + n_alt < 4 OR (greatest(t_split, n_split) <= 5 AND cov_span < readlen + 5 AND tcount + ncount < 7)"),
    ("LOWSUPPORT", "t_alt + n_alt < 15 AND (ncount > 0 OR n_split > 0) AND span = -1"),
    ("LOWICSUPPORT", f"{_MATCH} < 50 AND chr1 <> chr2"),
    ("SECONDARY", "secondary AND span < 1000"),
    ("WEAKCONTIG", "least(conf1, conf2) < 0.5"),
]

#: Calls from discordant reads alone. WEAKDISC can't be reached: its counts are LOWMAPQDISC before.
DISCORDANT = [
    ("LOWSPANDSCRD", "span > 0 AND span < 2000 AND strand1 = '+' AND strand2 = '-'"),
    ("LOWMAPQDISC", "tcount + ncount < 8 OR least(dc_mapq1, dc_mapq2) < 15"),
    ("HIGHNM", "floor(greatest(dc_nm1, dc_nm2)) >= 4"),
    ("COMPETEDISC", "competing"),
    ("WEAKDISC", "tcount + ncount < 8"),
]

#: Indels. NOLOCAL is not listed: the ladder always overwrites it.
INDEL = [
    ("LOWMAPQ", "mapq1 < 10"),
    ("LOWMAPQ", "mapq1 < 30 OR mapq2 < 30"),
    ("LOWLOD", "max_lod < CASE WHEN in_dbsnp THEN lod_db ELSE lod END"),
    ("SHORTALIGNMENT", "NOT refilter AND least(left_match, right_match) < 20"),
    ("WEAKCONTIG", "least(conf1, conf2) < 0.5"),
]


def ladder(rungs: list[tuple[str, str]], otherwise: str = "PASS") -> Column:
    """The code of the first rung that holds; a null condition does not hold."""
    out = None
    for code, condition in rungs:
        out = F.when(F.expr(condition), code) if out is None else out.when(F.expr(condition), code)
    return out.otherwise(otherwise)


def ladder_sql(rungs: list[tuple[str, str]], otherwise: str = "PASS") -> str:
    """The ladder as a CASE expression."""
    return "CASE " + " ".join(f"WHEN {condition} THEN '{code}'" for code, condition in rungs) + f" ELSE '{otherwise}' END"


def dispatch(evidence: Column, has_discordant: Column) -> Column:
    """Which ladder scores a call."""
    tsi = evidence.startswith("TSI")
    return F.when(evidence == "INDEL", "indel").when(evidence == "DSCRD", "discordant").when((evidence == "ASDIS") | (tsi & has_discordant), "both").otherwise("assembly")


def evidence_after_clusters(evidence: Column, strand1: Column, strand2: Column, span: Column, insert_size: Column) -> Column:
    """Once clusters are matched, every call but an indel is ASSMB (small deletions) or ASDIS, whether one matched or not."""
    small = (strand1 == "+") & (strand2 == "-") & (span >= 0) & (span < 2 * insert_size)
    return F.when(evidence == "INDEL", evidence).when(small, "ASSMB").otherwise("ASDIS")


def somatic_state(kind: Column, lod: Column, t_alt: Column, n_alt: Column, n_split: Column, ncount: Column, in_dbsnp: Column, cut: float = 0.0, cut_db: float = 2.0) -> Column:
    """SOMATIC, NORMAL or FAILED."""
    ratio = F.when(n_alt > 0, t_alt / n_alt).otherwise(100.0)
    indel = F.when(lod > F.when(in_dbsnp, cut_db).otherwise(cut), "SOMATIC").otherwise("NORMAL")
    sv = F.when((ratio < 15) | ((n_split > 2) & (ncount > 1)), "FAILED").when((kind == "DSCRD") & (n_alt > 0) & (lod > cut), "FAILED").when(lod > cut, "SOMATIC").otherwise("NORMAL")
    return F.when(kind == "INDEL", indel).otherwise(sv)


def locality(in_window1: Column, in_window2: Column) -> Column:
    """A call is local if either end is."""
    return F.when(in_window1 | in_window2, "FROM_LOCAL").otherwise("DISTANT")
