"""Queries on calls: models E1-E9, E30, ladders C1-C8, sequence and VCF fields E10-E20, E24, PRJ2-PRJ4, SNK6 ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import model, vcf
from fragmenta.functions import sequence as sq
from fragmenta.operators import classify
from fragmenta.plans.core import query
from fragmenta.plans.fixtures import table, view

c = F.col


# --- DuckDB texts of the models, written apart from the Column forms
def ll(ref: str, alt: str, f: str, e: str, b: str = "1e-6::double") -> str:
    p, q = f"((1 - {f}) * (1 - {e}) + {f} * {b})", f"({f} * (1 - {b}) + (1 - {f}) * {e})"
    return f"(CASE WHEN {p} <= 0 AND {ref} > 0 THEN -1e12::double WHEN {q} <= 0 AND {alt} > 0 THEN -1e12::double ELSE (CASE WHEN {p} > 0 THEN greatest(0::double, {ref}) * log10({p}) ELSE 0 END) + (CASE WHEN {q} > 0 THEN greatest(0::double, {alt}) * log10({q}) ELSE 0 END) END)"


ERR = "CASE WHEN repeat_len <= 4 THEN 0.001::double WHEN repeat_len = 5 THEN 0.002 WHEN repeat_len = 6 THEN 0.005 WHEN repeat_len = 7 THEN 0.01 WHEN repeat_len = 8 THEN 0.02 WHEN repeat_len = 9 THEN 0.03 WHEN repeat_len = 10 THEN 0.1 ELSE 0.08 END"
BASE = f"SELECT bp_num, alt_n::double AS an, alt_t::double AS aT_, greatest(1, cov_n)::double AS dn, greatest(1, cov_t)::double AS dt, {ERR} AS e FROM v_bp_counts"
FRACTIONS = f"SELECT *, least(e, 0.005::double) AS en, greatest(0.0001::double, least(0.02::double, e)) AS et, greatest(0.00001::double, least(0.01::double, e)) AS fa, greatest(1e-6::double, least(1 - 1e-6::double, an / dn)) AS fn, greatest(1e-6::double, least(1 - 1e-6::double, aT_ / dt)) AS ft, greatest(1e-6::double, least(1 - 1e-6::double, (an + aT_) / (dn + dt))) AS fs FROM ({BASE})"
N = lambda f, e="en": ll("(dn - an)", "an", f, e)
T = lambda f, e="et": ll("(dt - aT_)", "aT_", f, e)
LOD_SQL = f"""
WITH f AS ({FRACTIONS}), p AS (SELECT *, exp(-3 * greatest(0::double, an - dn * en)) AS clean, least(fn, ft) / greatest(fn, ft) AS ratio FROM f),
m AS (SELECT bp_num, greatest({N('0::double')} + {T('ft')}, {N('fa', 'e')} + {T('fa', 'e')}) AS som,
 greatest({N('fs')} + {T('fs')} - 2 * clean + (1 - clean) * ratio * 3 + CASE WHEN an > 0 AND aT_ > 0 AND fn < 0.15 AND ft < 0.15 THEN 2 * ratio ELSE 0 END,
  {N('0.5::double')} + {T('0.5::double')}, {N('(1 - 1e-6::double)')} + {T('(1 - 1e-6::double)')}, {N('fa', 'e')} + {T('fa', 'e')},
  CASE WHEN an > dn * en + 1 THEN {N('fn')} + {T('ft')} - 0.5::double * log10(dn + dt) ELSE -1e300::double END) AS germ FROM p)
SELECT bp_num, round(som - germ, 6) + 0 AS lod FROM m
"""


def counts(spark, d):
    return view(spark, d, "v_bp_counts").withColumn("e", model.repeat_error(c("repeat_len")))


def rounded(x, digits=6):
    return F.round(x, digits) + F.lit(0.0)


@query("e1_log_likelihood", f"SELECT bp_num, round({ll('(cov_t - alt_t)::double', 'alt_t::double', '0.3::double', '0.001::double')}, 6) + 0 AS ll FROM v_bp_counts")
def e1(spark, d):
    return counts(spark, d).select("bp_num", rounded(model.log_likelihood(c("cov_t") - c("alt_t"), c("alt_t"), 0.3, 0.001)).alias("ll"))


@query("e2_somatic_lod", LOD_SQL)
def e2(spark, d):
    return counts(spark, d).select("bp_num", rounded(model.somatic_lod(c("alt_n"), c("cov_n"), c("alt_t"), c("cov_t"), c("e"))).alias("lod"))


GL = lambda g: f"(CASE WHEN al > co THEN -1e12::double ELSE -co * log10(2::double) + (co - al) * log10(((2 - {g}) * e + {g} * (1 - e)) / 2) + al * log10(((2 - {g}) * (1 - e) + {g} * e) / 2) END)"
CALL = f"""
WITH a AS (SELECT bp_num, alt_t::double AS alt, greatest(0::double, cov_t::double * 141 / 151) AS dc, {ERR} AS e FROM v_bp_counts),
b AS (SELECT *, CASE WHEN dc > 0 THEN least(1::double, alt / dc) ELSE 1::double END AS af, least(alt, dc) AS sa, trunc(least(alt, dc))::double AS al, trunc(dc)::double AS co FROM a),
g AS (SELECT *, {GL(2)} AS g0, {GL(1)} AS g1, {GL(0)} AS g2 FROM b), h AS (SELECT *, greatest(g0, g1, g2) AS top FROM g),
p AS (SELECT *, CAST(round(-10 * (g0 - top)) AS INT) AS p0, CAST(round(-10 * (g1 - top)) AS INT) AS p1, CAST(round(-10 * (g2 - top)) AS INT) AS p2 FROM h)
SELECT bp_num, round(af, 6) AS af, round({ll('(dc - sa)', 'sa', 'af', 'e')} - {ll('(dc - sa)', 'sa', '0::double', 'e')}, 6) + 0 AS lo,
 round({ll('(dc - sa)', 'sa', '0::double', 'e')} - {ll('(dc - sa)', 'sa', 'greatest(af, 0.5::double)', 'e')}, 6) + 0 AS lo_n,
 CASE WHEN g0 = top THEN '0/0' WHEN g1 = top THEN '0/1' ELSE '1/1' END AS gt, p0, p1, p2, least(99, list_sort([p0, p1, p2])[2]) AS gq, least(99, p0) AS nh_gq FROM p
"""


@query("e3_e5_sample_call", CALL)
def e5(spark, d):
    called = counts(spark, d).select("bp_num", model.call_sample(c("alt_t"), c("cov_t"), c("e"), 151).alias("s"))
    return called.select("bp_num", F.round("s.af", 6).alias("af"), rounded(c("s.lo")).alias("lo"), rounded(c("s.lo_n")).alias("lo_n"), "s.gt", *(F.get("s.pl", F.lit(k)).alias(f"p{k}") for k in range(3)), "s.gq", "s.nh_gq")


@query("e4_genotype_quality", "SELECT bp_num, least(99, list_sort([alt_n * 7, alt_t * 5, cov_t * 9])[2]) AS gq FROM v_bp_counts")
def e4(spark, d):
    return view(spark, d, "v_bp_counts").select("bp_num", F.least(F.get(F.array_sort(F.array(c("alt_n") * 7, c("alt_t") * 5, c("cov_t") * 9)), F.lit(1)), F.lit(99)).alias("gq"))


@query("e6_repeat_error", f"SELECT repeat_len, round({ERR}, 6) AS e, count(*) AS n FROM v_bp_counts GROUP BY 1, 2")
def e6(spark, d):
    return counts(spark, d).groupBy("repeat_len", F.round("e", 6).alias("e")).agg(F.count("*").alias("n"))


@query("e7_read_score", "SELECT qname, mate, CAST((readlen - clip - mapq % 5) - clip - 6 * (mapq % 3) - (mapq % 5) - CASE WHEN nm >= 0 THEN 4 * greatest(0, nm - mapq % 5) ELSE 0 END AS INT) AS score FROM v_reads")
def e7(spark, d):
    r = view(spark, d, "v_reads")
    return r.select("qname", "mate", model.read_score(c("readlen") - c("clip") - c("mapq") % 5, c("clip"), c("mapq") % 3, c("mapq") % 5, c("nm")).cast("int").alias("score"))


@query("e8_contig_confidence", "WITH x AS (SELECT qname, mate, mapq % 4 AS ops, mapq % 30 AS longest, nm / 60::double AS mm, 1 - clip / 20::double AS per FROM v_reads) SELECT qname, mate, round(greatest(0::double, least(1::double, 1 - ((CASE WHEN ops >= 2 THEN 0.2::double * (ops - 1) ELSE 0 END) + (CASE WHEN ops >= 2 AND longest <= 20 AND mm > 0.02 THEN 0.25::double ELSE 0 END) + (CASE WHEN mm > 0.01 THEN 10 * (mm - 0.01::double) ELSE 0 END) + (CASE WHEN mm > 0.05 THEN 30 * (mm - 0.05::double) * (mm - 0.05::double) ELSE 0 END) + (CASE WHEN per < 0.7 THEN 2 * (0.7::double - per) ELSE 0 END)))), 6) AS conf FROM x")
def e8(spark, d):
    r = view(spark, d, "v_reads")
    conf = model.contig_confidence(c("mapq") % 4, c("mapq") % 30, c("nm") / F.lit(60.0), 1 - c("clip") / F.lit(20.0))
    return r.select("qname", "mate", F.round(conf, 6).alias("conf"))


@query("e9_split_gate", "SELECT qname, mate FROM v_reads WHERE mapq * 3 > CASE WHEN nm = 0 THEN readlen ELSE isize % 150 END AND (pos % 100 >= 5 AND pos % 100 + 5 <= 90 OR mate_pos % 100 >= 5 AND mate_pos % 100 + 5 <= 60) AND NOT (clip = 0 AND abs(pos % 100 - mate_pos % 100) <= greatest(3, nm + 3))")
def e9(spark, d):
    """Split support: better on the contig than in place (strictly), past a break on both sides, and no indel near it in a contig of one alignment."""
    native = F.when(c("nm") == 0, c("readlen")).otherwise(c("isize") % 150)
    first = (c("pos") % 100 >= 5) & (c("pos") % 100 + 5 <= 90)
    second = (c("mate_pos") % 100 >= 5) & (c("mate_pos") % 100 + 5 <= 60)
    near = (c("clip") == 0) & (F.abs(c("pos") % 100 - c("mate_pos") % 100) <= F.greatest(F.lit(3), c("nm") + 3))
    return view(spark, d, "v_reads").where((c("mapq") * 3 > native) & (first | second) & ~near).select("qname", "mate")


WIDE = """SELECT l_orderkey AS id, l_linenumber AS ln, l_suppkey AS sk, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_partkey % 4000 END AS span, l_partkey % 11 AS a_split, l_partkey % 9 AS t_split, l_suppkey % 4 AS n_split,
 CAST(floor(l_quantity) AS INT) + 10 AS mapq1, 60 - CAST(floor(l_quantity) AS INT) % 37 AS mapq2, CAST(floor(l_discount * 100 + 0.5) AS INT) AS nm1, CAST(floor(l_tax * 100 + 0.5) AS INT) AS nm2,
 40 + l_orderkey % 120 AS matchlen1, 60 + l_suppkey % 90 AS matchlen2, 38 + l_orderkey % 115 AS as1, 50 + l_suppkey % 88 AS as2, l_partkey % 220 - 5 AS cov_span, l_suppkey % 45 AS homol_len, 150 + l_orderkey % 200 AS seq_len, 151 AS readlen,
 l_partkey % 17 = 0 AS is_distant, l_suppkey % 5 = 0 AS tsi_local, l_partkey % 97 = 0 AS nonvar_local, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 2 END AS chr1, 2 AS chr2, l_orderkey % 4 = 0 AS secondary,
 CASE WHEN l_returnflag = 'N' THEN '+' ELSE '-' END AS strand1, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand2, (l_orderkey % 100) / CAST(100 AS DOUBLE) AS conf1, (l_partkey % 50 + 50) / CAST(100 AS DOUBLE) AS conf2,
 l_suppkey % 60 AS dc_mapq1, l_partkey % 60 AS dc_mapq2, l_partkey % 2 = 0 AS distant1, l_suppkey % 2 = 0 AS distant2, l_partkey % 20 AS t_alt, l_suppkey % 6 AS n_alt, l_partkey % 12 AS tcount, l_suppkey % 3 AS ncount,
 l_orderkey % 60 / CAST(10 AS DOUBLE) AS dc_nm1, l_suppkey % 50 / CAST(10 AS DOUBLE) AS dc_nm2, l_orderkey % 7 = 0 AS competing, l_orderkey % 30 / CAST(10 AS DOUBLE) AS max_lod, l_suppkey % 9 = 0 AS in_dbsnp, CAST(1 AS DOUBLE) AS lod, CAST(0.5 AS DOUBLE) AS lod_db,
 l_partkey % 13 = 0 AS refilter, l_orderkey % 90 AS left_match, l_suppkey % 100 AS right_match FROM lineitem"""


def wide(spark, d):
    return spark.sql(WIDE.replace("FROM lineitem", "FROM {src}"), src=table(spark, d, "lineitem"))


def _ladder(name: str, rungs: list[tuple[str, str]]) -> None:
    sql = f"SELECT code, count(*) AS n, CAST(sum(id * 31 + ln) AS BIGINT) AS checksum FROM (SELECT id, ln, {classify.ladder_sql(rungs)} AS code FROM ({WIDE})) GROUP BY code"

    @query(name, sql)
    def run(spark, d):
        coded = wide(spark, d).select("id", "ln", classify.ladder(rungs).alias("code"))
        return coded.groupBy("code").agg(F.count("*").alias("n"), F.sum(c("id") * 31 + c("ln")).alias("checksum"))


_ladder("c1_assembly_ladder", classify.ASSEMBLY)
_ladder("c2_assembly_discordant_ladder", classify.BOTH)
_ladder("c3_discordant_ladder", classify.DISCORDANT)
_ladder("c4_indel_ladder", classify.INDEL)


@query("c5_somatic_state", f"WITH w AS (SELECT *, CASE WHEN sk % 3 = 0 THEN 'INDEL' WHEN sk % 3 = 1 THEN 'DSCRD' ELSE 'ASDIS' END AS kind, max_lod - 1 AS lo FROM ({WIDE})) SELECT state, kind, count(*) AS n FROM (SELECT kind, CASE WHEN kind = 'INDEL' THEN CASE WHEN lo > CASE WHEN in_dbsnp THEN 2 ELSE 0 END THEN 'SOMATIC' ELSE 'NORMAL' END WHEN CASE WHEN n_alt > 0 THEN t_alt / n_alt::double ELSE 100 END < 15 OR (n_split > 2 AND ncount > 1) THEN 'FAILED' WHEN lo > 0 AND kind = 'DSCRD' AND n_alt > 0 THEN 'FAILED' WHEN lo > 0 THEN 'SOMATIC' ELSE 'NORMAL' END AS state FROM w) GROUP BY state, kind")
def c5(spark, d):
    w = wide(spark, d).withColumn("kind", F.expr("CASE WHEN sk % 3 = 0 THEN 'INDEL' WHEN sk % 3 = 1 THEN 'DSCRD' ELSE 'ASDIS' END"))
    state = classify.somatic_state(c("kind"), c("max_lod") - 1, c("t_alt"), c("n_alt"), c("n_split"), c("ncount"), c("in_dbsnp"))
    return w.groupBy(state.alias("state"), "kind").agg(F.count("*").alias("n"))


EVIDENCE = "CASE id % 5 WHEN 0 THEN 'INDEL' WHEN 1 THEN 'ASSMB' WHEN 2 THEN 'ASDIS' WHEN 3 THEN 'DSCRD' ELSE 'TSI_L' END"


@query("c6_dispatch", f"SELECT ladder, count(*) AS n FROM (SELECT CASE WHEN ev = 'INDEL' THEN 'indel' WHEN ev = 'DSCRD' THEN 'discordant' WHEN ev = 'ASDIS' OR (ev LIKE 'TSI%' AND tcount > 0) THEN 'both' ELSE 'assembly' END AS ladder FROM (SELECT *, {EVIDENCE} AS ev FROM ({WIDE}))) GROUP BY ladder")
def c6(spark, d):
    return wide(spark, d).groupBy(classify.dispatch(F.expr(EVIDENCE), c("tcount") > 0).alias("ladder")).agg(F.count("*").alias("n"))


@query("c7_evidence_retyping", f"SELECT after, count(*) AS n FROM (SELECT CASE WHEN ev = 'INDEL' THEN ev WHEN strand1 = '+' AND strand2 = '-' AND span >= 0 AND span < 1000 THEN 'ASSMB' ELSE 'ASDIS' END AS after FROM (SELECT *, {EVIDENCE} AS ev FROM ({WIDE}))) GROUP BY after")
def c7(spark, d):
    after = classify.evidence_after_clusters(F.expr(EVIDENCE), c("strand1"), c("strand2"), c("span"), F.lit(500))
    return wide(spark, d).groupBy(after.alias("after")).agg(F.count("*").alias("n"))


@query("c8_locality", "SELECT bp_num, CASE WHEN (chr1 = bp_num % 24 AND pos1 BETWEEN 100 AND 300) OR (chr2 = bp_num % 24 AND pos2 BETWEEN 100 AND 300) THEN 'FROM_LOCAL' ELSE 'DISTANT' END AS locality FROM v_bps")
def c8(spark, d):
    inside = lambda k: (c(f"chr{k}") == c("bp_num") % 24) & c(f"pos{k}").between(100, 300)
    return view(spark, d, "v_bps").select("bp_num", classify.locality(inside(1), inside(2)).alias("locality"))


DNA = "translate(substr(md5(CAST(o_orderkey AS {S})) || md5(CAST(o_custkey AS {S})), 1, 60), '0123456789abcdef', 'ACGTACGTACGTACGT')"
SEQS = "SELECT o_orderkey AS id, " + DNA.format(S="VARCHAR") + " AS seq, CAST(o_custkey % 58 AS INT) AS c1, CAST(o_orderkey % 58 AS INT) AS c2, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_custkey % 7 = 0 AS imprecise FROM orders"


def sequences(spark, d):
    o = table(spark, d, "orders")
    return o.selectExpr("o_orderkey AS id", DNA.format(S="STRING") + " AS seq", "CAST(o_custkey % 58 AS INT) AS c1", "CAST(o_orderkey % 58 AS INT) AS c2", "CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "o_custkey % 7 = 0 AS imprecise")


RC = "reverse(translate({}, 'ACGTN', 'TGCAN'))".format


@query("e10_reverse_complement", f"SELECT id, {RC('seq')} AS rc FROM ({SEQS})")
def e10(spark, d):
    return sequences(spark, d).select("id", sq.reverse_complement(c("seq")).alias("rc"))


@query("e11_normalize", r"SELECT conv_id, turn, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ \t\n\v\f\r]+', '', 'g') AS seq FROM conversations")
def e11(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sq.normalize(c("text")).alias("seq"))


@query("e12_junction_kmer", f"SELECT id, CASE WHEN imprecise OR c1 - 9 < 0 OR c1 - 9 + 20 > length(seq) THEN '.' WHEN strand = '-' THEN {RC('substr(seq, c1 - 8, 20)')} ELSE substr(seq, c1 - 8, 20) END AS kmer FROM ({SEQS})")
def e12(spark, d):
    return sequences(spark, d).select("id", sq.junction_kmer(c("seq"), c("c1"), c("strand"), c("imprecise")).alias("kmer"))


@query("e13_coordinate_flip", f"SELECT id, CASE WHEN imprecise THEN 60 - c2 ELSE c1 END AS f1, CASE WHEN imprecise THEN 60 - c1 ELSE c2 END AS f2 FROM ({SEQS})")
def e13(spark, d):
    f = sq.flip(c("c1"), c("c2"), F.length("seq"), c("imprecise"))
    return sequences(spark, d).select("id", f["c1"].alias("f1"), f["c2"].alias("f2"))


@query("e14_homology_insertion", f"SELECT id, CASE WHEN c1 > c2 THEN CASE WHEN strand = '-' THEN {RC('substr(seq, c2 + 1, c1 - c2)')} ELSE substr(seq, c2 + 1, c1 - c2) END ELSE '' END AS homol, CASE WHEN c2 > c1 THEN CASE WHEN strand = '-' THEN {RC('substr(seq, c1 + 1, c2 - c1)')} ELSE substr(seq, c1 + 1, c2 - c1) END ELSE '' END AS ins FROM ({SEQS})")
def e14(spark, d):
    return sequences(spark, d).select("id", sq.homology(c("seq"), c("c1"), c("c2"), c("strand")).alias("homol"), sq.insertion(c("seq"), c("c1"), c("c2"), c("strand")).alias("ins"))


@query("e15_ref_alt", f"WITH s AS (SELECT id, CASE WHEN imprecise THEN '' ELSE substr(seq, 1, 30) END AS bases, c1 % 6 AS span, CASE WHEN c2 % 2 = 0 THEN substr(seq, 40, 3) ELSE '' END AS ins FROM ({SEQS})), k AS (SELECT *, CASE WHEN bases = '' THEN 'N' ELSE bases END AS known FROM s) SELECT id, CASE WHEN ins <> '' THEN substr(known, 1, 1) ELSE substr(known, 1, span + 1) END AS ref, CASE WHEN ins <> '' THEN substr(known, 1, 1) || ins ELSE substr(known, 1, 1) END AS alt FROM k")
def e15(spark, d):
    s = sequences(spark, d).select("id", F.when(c("imprecise"), "").otherwise(F.substring("seq", 1, 30)).alias("bases"), (c("c1") % 6).alias("span"), F.when(c("c2") % 2 == 0, F.substring("seq", 40, 3)).otherwise("").alias("ins"))
    return s.select("id", vcf.ref_alt(c("bases"), c("span"), c("ins")).alias("v")).select("id", "v.ref", "v.alt")


CHR = "CASE chr1 WHEN 23 THEN 'chrX' WHEN 24 THEN 'chrY' WHEN 25 THEN 'chrM' WHEN 26 THEN 'MT' WHEN 27 THEN 'chrUn_1' WHEN 0 THEN 'GL000' ELSE 'chr' || chr1 END"


@query("e16_chromosome_key", f"SELECT name, CASE WHEN try_cast(bare AS INT) BETWEEN 1 AND 22 THEN try_cast(bare AS INT) WHEN bare = 'X' THEN 23 WHEN bare = 'Y' THEN 24 WHEN bare IN ('M', 'MT') THEN 25 ELSE 1000 END AS k, count(*) AS n FROM (SELECT {CHR} AS name, regexp_replace({CHR}, '^chr', '') AS bare FROM v_bps) GROUP BY 1, 2")
def e16(spark, d):
    named = view(spark, d, "v_bps").selectExpr(f"{CHR} AS name")
    return named.groupBy("name", sq.chromosome_key(c("name")).alias("k")).agg(F.count("*").alias("n"))


@query("e17_bnd_alt", "SELECT bp_num, CASE WHEN strand1 = '+' AND strand2 = '+' THEN 'N]' || p2 || ']' WHEN strand1 = '+' THEN 'N[' || p2 || '[' WHEN strand2 = '+' THEN ']' || p2 || ']N' ELSE '[' || p2 || '[N' END AS alt FROM (SELECT *, chr2 || ':' || pos2 AS p2 FROM v_bps)")
def e17(spark, d):
    return view(spark, d, "v_bps").select("bp_num", vcf.bnd_alt(F.lit("N"), c("chr2"), c("pos2"), c("strand1"), c("strand2")).alias("alt"))


@query("e18_symbolic_kind", "SELECT kind, viewer, count(*) AS n FROM (SELECT CASE WHEN chr1 <> chr2 THEN 'BND' WHEN strand1 = strand2 THEN 'DEL' WHEN strand1 = '-' THEN 'DUP' ELSE 'INV' END AS kind, CASE WHEN chr1 <> chr2 THEN 'Translocation-like' WHEN strand1 = strand2 THEN 'Inversion' WHEN strand1 = '-' THEN 'Duplication-like' ELSE 'Deletion-like' END AS viewer FROM v_bps) GROUP BY 1, 2")
def e18(spark, d):
    same = c("chr1") == c("chr2")
    return view(spark, d, "v_bps").groupBy(vcf.symbolic_kind(same, c("strand1"), c("strand2")).alias("kind"), vcf.viewer_kind(same, c("strand1"), c("strand2")).alias("viewer")).agg(F.count("*").alias("n"))


@query("e19_info_field", "SELECT bp_num, concat_ws(';', 'EVENT=' || bp_num, 'MAXLOD=' || maxlod, CASE WHEN somlod >= 1 THEN 'SOMATIC' END, CASE WHEN chr1 = chr2 THEN 'SPAN=' || abs(pos2 - pos1) END, 'SVTYPE=BND', 'READ_ID=r' || bp_num % 7) AS info FROM v_bps")
def e19(spark, d):
    fields = {
        "SVTYPE": F.lit("BND"),
        "SPAN": F.when(c("chr1") == c("chr2"), F.abs(c("pos2") - c("pos1")).cast("string")),
        "SOMATIC": (c("somlod") >= 1).cast("string"),
        "READ_ID": F.concat(F.lit("r"), (c("bp_num") % 7).cast("string")),
        "MAXLOD": c("maxlod").cast("string"),
        "EVENT": c("bp_num").cast("string"),
    }
    return view(spark, d, "v_bps").select("bp_num", vcf.info(fields).alias("info"))


@query("e19_four_digits", "SELECT l_orderkey AS id, l_linenumber AS ln, printf('%.4g', sqrt(l_extendedprice) / (7 * pow(10, l_linenumber * 2 - 2))) AS x FROM lineitem")
def e19_digits(spark, d):
    x = F.sqrt("l_extendedprice") / (7 * F.pow(F.lit(10.0), c("l_linenumber") * 2 - 2))
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("ln"), vcf.significant(x).alias("x"))


@query("e20_qual_modes", "SELECT bp_num, '.' AS missing, CAST(CAST(least(99, round(10 * greatest(0, maxlod / 7::double))) AS INT) AS VARCHAR) AS maxlod, CAST(somlod AS VARCHAR) AS sum FROM v_bps")
def e20(spark, d):
    b = view(spark, d, "v_bps")
    return b.select("bp_num", *(vcf.qual(m, c("somlod"), c("maxlod") / F.lit(7.0)).alias(m) for m in ("missing", "maxlod", "sum")))


@query("e24_indel_keys", "SELECT chr1 || '_' || pos1 || '_' || abs(pos2 - pos1) || CASE WHEN strand1 = '+' THEN 'I' ELSE 'D' END AS k, count(*) AS n FROM v_bps GROUP BY 1")
def e24(spark, d):
    key = sq.indel_key(c("chr1"), c("pos1"), F.abs(c("pos2") - c("pos1")), c("strand1") == "+")
    return view(spark, d, "v_bps").groupBy(key.alias("k")).agg(F.count("*").alias("n"))


@query("e25_region_parse", "SELECT chr AS region_id, 'chr' || chr AS chrom, CAST(1234 + chr AS BIGINT) AS s, CAST(5000000 AS BIGINT) AS e FROM (SELECT DISTINCT chr FROM v_regions)")
def e25(spark, d):
    text = F.concat(F.lit("chr"), c("chr").cast("string"), F.lit(":1,"), (c("chr") + 234).cast("string"), F.lit("-5M"))
    r = view(spark, d, "v_regions").select("chr").distinct().select(c("chr").alias("region_id"), sq.parse_region(text).alias("p"))
    return r.select("region_id", c("p.chrom").alias("chrom"), c("p.start").alias("s"), c("p.end").alias("e"))


@query("e26_file_date", "SELECT strftime(o_orderdate, '%Y%m%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def e26(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"))


@query("e27_parse_likelihoods", "SELECT bp_num, alt_n AS a, alt_t AS b, cov_t AS c FROM v_bp_counts")
def e27(spark, d):
    """A PL field is exactly three integers, else null; here made and read again."""
    text = F.concat_ws(",", "alt_n", "alt_t", "cov_t")
    parts = F.split(text, ",")
    made = view(spark, d, "v_bp_counts").select("bp_num", F.when(F.size(parts) == 3, parts).alias("p"))
    return made.select("bp_num", *(F.get("p", F.lit(i)).try_cast("int").alias(n) for i, n in enumerate("abc")))


@query("e29_phase_percent", "SELECT event_type, CAST(floor(100 * sum(floor(value)) / greatest(1, (SELECT sum(floor(value)) FROM events))) AS BIGINT) AS pct FROM events GROUP BY event_type")
def e29(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.sum(F.floor("value")).alias("t"))
    return e.selectExpr("event_type", "CAST(floor(100 * t / greatest(1, sum(t) OVER ())) AS BIGINT) AS pct")


@query("prj2_event_type", "SELECT bp_num, CASE WHEN chr1 <> chr2 THEN 'translocation' WHEN abs(pos2 - pos1) < 50 THEN 'indel' WHEN strand1 = strand2 THEN 'inversion' WHEN strand1 = '-' THEN 'duplication' ELSE 'deletion' END AS event FROM v_bps")
def prj2(spark, d):
    size = F.abs(c("pos2") - c("pos1"))
    kind = F.when(c("chr1") != c("chr2"), "translocation").when(size < 50, "indel").when(c("strand1") == c("strand2"), "inversion").when(c("strand1") == "-", "duplication").otherwise("deletion")
    return view(spark, d, "v_bps").select("bp_num", kind.alias("event"))


@query("prj3_support_peak", f"SELECT id, ln, CAST(greatest(a_split, t_alt, n_alt, tcount, ncount) AS BIGINT) AS peak, CASE WHEN span = -1 THEN NULL ELSE abs(span) END AS span_abs FROM ({WIDE})")
def prj3(spark, d):
    return wide(spark, d).select("id", "ln", F.greatest("a_split", "t_alt", "n_alt", "tcount", "ncount").alias("peak"), F.when(c("span") != -1, F.abs("span")).alias("span_abs"))


@query("prj4_span", "SELECT bp_num, CAST(CASE WHEN chr1 <> chr2 THEN -1 WHEN strand1 = '+' AND strand2 = '+' THEN pos2 - pos1 ELSE abs(pos2 - pos1) END AS BIGINT) AS span FROM v_bps")
def prj4(spark, d):
    gap = c("pos2") - c("pos1")
    return view(spark, d, "v_bps").select("bp_num", F.when(c("chr1") != c("chr2"), -1).when((c("strand1") == "+") & (c("strand2") == "+"), gap).otherwise(F.abs(gap)).cast("long").alias("span"))
