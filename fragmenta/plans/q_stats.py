"""Queries on statistics: A1-A5, A8, A15-A18, A20-A28, and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fragmenta.operators import intervals as iv
from fragmenta.operators import stats
from fragmenta.plans.core import query
from fragmenta.plans.fixtures import table, view

c = F.col


@query("a1_group_counters", "SELECT rg, count(*) AS reads, CAST(sum(CASE WHEN clip > 6 THEN 1 ELSE 0 END) AS BIGINT) AS secondary, CAST(sum(CASE WHEN nm > 8 THEN 1 ELSE 0 END) AS BIGINT) AS qcfail, CAST(sum(CASE WHEN mapq = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unmapped, max(mapq) AS max_mapq, max(readlen) AS max_len FROM v_reads GROUP BY rg")
def a1(spark, d):
    return view(spark, d, "v_reads").groupBy("rg").agg(F.count("*").alias("reads"), F.count_if(c("clip") > 6).alias("secondary"), F.count_if(c("nm") > 8).alias("qcfail"), F.count_if(c("mapq") == 1).alias("unmapped"), F.max("mapq").alias("max_mapq"), F.max("readlen").alias("max_len"))


LEARN = "WITH k AS (SELECT rg, isize, row_number() OVER (PARTITION BY rg ORDER BY isize) AS rn, count(*) OVER (PARTITION BY rg) AS n FROM v_reads), t AS (SELECT * FROM k WHERE rn <= greatest(1, floor(n * 0.98::double))), m AS (SELECT rg, quantile_cont(isize, 0.5) AS med, count(*) AS n_kept FROM t GROUP BY rg), s AS (SELECT t.rg, m.n_kept, m.med, sqrt(sum(pow(isize - med, 2)) / m.n_kept) AS sd FROM t JOIN m ON t.rg = m.rg GROUP BY t.rg, m.n_kept, m.med)"


@query("a2_trimmed_location", LEARN + " SELECT rg, n_kept, med::double AS median, round(sd, 6) AS sd FROM s")
def a2(spark, d):
    return stats.trimmed_location(view(spark, d, "v_reads"), "rg", "isize").select("rg", "n_kept", c("median").cast("double").alias("median"), F.round("sd", 6).alias("sd"))


@query("a3_insert_cutoff", LEARN + ", x AS (SELECT DISTINCT sample, rg FROM v_reads) SELECT sample, x.rg, CAST(trunc(round(med + sd * CASE WHEN sample LIKE 't%' THEN 3.92::double ELSE 3.6::double END, 6)) AS INT) AS cutoff FROM x JOIN s ON x.rg = s.rg")
def a3(spark, d):
    reads = view(spark, d, "v_reads")
    learned = stats.trimmed_location(reads, "rg", "isize")
    mult = F.when(c("sample").startswith("t"), stats.TUMOUR_MULT).otherwise(stats.NORMAL_MULT)
    return reads.select("sample", "rg").distinct().join(learned, "rg").select("sample", "rg", F.round(c("median") + c("sd") * mult, 6).cast("int").alias("cutoff"))


@query("f3_insert_rescue", LEARN + " SELECT qname, mate FROM v_reads r JOIN s ON r.rg = s.rg WHERE strand = '+' AND mate_strand = '-' AND abs(isize) >= trunc(round(med + sd * CASE WHEN sample LIKE 't%' THEN 3.92::double ELSE 3.6::double END, 6))")
def f3(spark, d):
    reads = view(spark, d, "v_reads")
    learned = stats.trimmed_location(reads, "rg", "isize")  # one row a read group
    cutoff = stats.cutoff(F.round(c("median"), 6), F.round(c("sd"), 9), c("sample").startswith("t"))
    return reads.join(learned, "rg", "left").where("strand = '+' AND mate_strand = '-'").where(F.abs("isize") >= cutoff).select("qname", "mate")


@query("a4_learning_sample", "SELECT rg, qname, mate FROM (SELECT *, row_number() OVER (PARTITION BY rg ORDER BY chr, pos, qname, mate) AS rn FROM v_reads WHERE chr <= 23 AND pos BETWEEN 0 AND 500000) WHERE rn <= 10")
def a4(spark, d):
    inside = view(spark, d, "v_reads").where("chr <= 23 AND pos BETWEEN 0 AND 500000")
    return stats.top_per_group(inside, ["rg"], [c("chr"), c("pos"), c("qname"), c("mate")], 10).select("rg", "qname", "mate")


@query("a5_global_maxima", LEARN + ", g AS (SELECT max(med) AS isize_max FROM s) SELECT max(readlen) AS readlen, max(mapq) AS mapq, max(isize_max)::double AS isize_max FROM v_reads, g")
def a5(spark, d):
    reads = view(spark, d, "v_reads")
    top = stats.trimmed_location(reads, "rg", "isize").agg(F.max("median").cast("double").alias("isize_max"))
    return reads.agg(F.max("readlen").alias("readlen"), F.max("mapq").alias("mapq")).join(F.broadcast(top), F.lit(True))  # one row each


@query("a15_class_rollup", "SELECT bp_num, CASE WHEN grouping(cls) = 1 THEN 'a' ELSE cls END AS class, CAST(sum(alt) AS BIGINT) AS alt, CAST(sum(cov) AS BIGINT) AS cov FROM (SELECT bp_num, 'n' AS cls, alt_n AS alt, cov_n AS cov FROM v_bp_counts UNION ALL SELECT bp_num, 't', alt_t, cov_t FROM v_bp_counts) GROUP BY GROUPING SETS ((bp_num, cls), (bp_num))")
def a15(spark, d):
    long = view(spark, d, "v_bp_counts").select("bp_num", F.explode(F.array(F.struct(F.lit("n").alias("cls"), c("alt_n").alias("alt"), c("cov_n").alias("cov")), F.struct(F.lit("t").alias("cls"), c("alt_t").alias("alt"), c("cov_t").alias("cov")))).alias("s")).select("bp_num", "s.*")
    both = long.groupBy("bp_num", "cls").agg(F.sum("alt").alias("alt"), F.sum("cov").alias("cov"))
    classes = both.withColumn("class", F.explode(F.array(c("cls"), F.lit("a"))))
    return classes.groupBy("bp_num", "class").agg(F.sum("alt").alias("alt"), F.sum("cov").alias("cov"))


@query("a16_site_quality", "SELECT bp_num, round(lod, 6) + 0 AS lod, CAST(least(99, round(-10 * log10(greatest(1e-30::double, 1 / (1 + pow(10, lod)))))) AS INT) AS qual FROM (SELECT bp_num, (alt_n * 0.7::double - cov_n * 0.05::double) + (alt_t * 0.9::double - cov_t * 0.05::double) AS lod FROM v_bp_counts)")
def a16(spark, d):
    lod = F.expr("(alt_n * 0.7D - cov_n * 0.05D) + (alt_t * 0.9D - cov_t * 0.05D)")
    p = F.greatest(F.lit(1e-30), 1 / (1 + F.pow(F.lit(10.0), c("lod"))))
    return view(spark, d, "v_bp_counts").select("bp_num", lod.alias("lod")).select("bp_num", (F.round("lod", 6) + F.lit(0.0)).alias("lod"), F.least(F.lit(99), F.round(-10 * F.log10(p))).cast("int").alias("qual"))


@query("a17_max_lod", "SELECT chr1, greatest(0, max(somlod)) AS max_lod FROM v_bps GROUP BY chr1")
def a17(spark, d):
    return view(spark, d, "v_bps").groupBy("chr1").agg(F.greatest(F.lit(0), F.max("somlod")).alias("max_lod"))


@query("a18_pass_contigs", "SELECT pos1 AS cname, max(CASE WHEN somlod >= 1 THEN 1 ELSE 0 END) AS somatic FROM v_bps WHERE conf = 'PASS' GROUP BY pos1")
def a18(spark, d):
    return view(spark, d, "v_bps").where("conf = 'PASS'").groupBy(c("pos1").alias("cname")).agg(F.max(F.when(c("somlod") >= 1, 1).otherwise(0)).alias("somatic"))


@query("a20_count_by", "SELECT conf, count(*) AS n, CAST(sum(CASE WHEN chr1 = chr2 THEN 1 ELSE 0 END) AS BIGINT) AS same_chr FROM v_bps GROUP BY conf")
def a20(spark, d):
    return view(spark, d, "v_bps").groupBy("conf").agg(F.count("*").alias("n"), F.count_if(c("chr1") == c("chr2")).alias("same_chr"))


RUNTIME = "SELECT event_id, user_id % 24 AS chr, value AS seconds FROM events WHERE value IS NOT NULL"


@query("a21_runtime_stats", f"WITH r AS ({RUNTIME}), k AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY chr) AS n FROM r) SELECT chr, round(sum(seconds), 4) AS total, max(seconds) AS top, round(avg(seconds), 6) AS mean, max(CASE WHEN i = greatest(0, floor(0.95::double * n) - 1) THEN seconds END) AS p95, arg_max(event_id, (seconds, -event_id)) AS hottest FROM k GROUP BY chr")
def a21(spark, d):
    r = table(spark, d, "events").where("value IS NOT NULL").select("event_id", (c("user_id") % 24).alias("chr"), c("value").alias("seconds"))
    p95 = stats.ranked_picks(r, ["chr"], "seconds", {"p95": F.greatest(F.lit(0), F.floor(F.lit(0.95) * c("_n")) - 1)})
    main = r.groupBy("chr").agg(F.round(F.sum("seconds"), 4).alias("total"), F.max("seconds").alias("top"), F.round(F.avg("seconds"), 6).alias("mean"), F.max_by("event_id", F.struct(c("seconds"), -c("event_id"))).alias("hottest"))
    return main.join(p95, "chr")


@query("a22_group_spread", "WITH k AS (SELECT rg, isize, row_number() OVER (PARTITION BY rg ORDER BY isize) - 1 AS i, count(*) OVER (PARTITION BY rg) AS n FROM v_reads WHERE isize > 0) SELECT rg, count(*) AS n, round(avg(isize), 6) AS mean, quantile_cont(isize, 0.5)::double AS median, round(stddev_pop(isize), 6) AS sd, max(CASE WHEN i = floor(0.01::double * n) THEN isize END) AS p01, max(CASE WHEN i = least(floor(0.99::double * n), n - 1) THEN isize END) AS p99 FROM k GROUP BY rg")
def a22(spark, d):
    r = view(spark, d, "v_reads").where("isize > 0")
    picks = stats.ranked_picks(r, ["rg"], "isize", {"p01": F.floor(F.lit(0.01) * c("_n")), "p99": F.least(F.floor(F.lit(0.99) * c("_n")), c("_n") - 1)})
    main = r.groupBy("rg").agg(F.count("*").alias("n"), F.round(F.avg("isize"), 6).alias("mean"), F.percentile("isize", 0.5).alias("median"), F.round(F.stddev_pop("isize"), 6).alias("sd"))
    return main.join(picks, "rg")


@query("a23_histogram", "SELECT CAST(least(29, greatest(0, floor((isize - 10) / (990.0::double / 30)))) AS BIGINT) AS bin, count(*) AS n FROM v_reads GROUP BY 1")
def a23(spark, d):
    return stats.histogram(view(spark, d, "v_reads"), "isize", 30, 10, 1000)


@query("a23_log_histogram", "SELECT CAST(least(39, greatest(8, floor(log10(1 + value) * 10))) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1")
def a23_log(spark, d):
    at = F.least(F.lit(39), F.greatest(F.lit(8), F.floor(F.log10(1 + c("value")) * 10)))
    return table(spark, d, "events").where("value >= 0").groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


CONTIGS = "SELECT l_orderkey AS cname, l_linenumber AS read_id, CASE WHEN l_returnflag = 'N' THEN 'split' WHEN l_returnflag = 'A' THEN 'disc' ELSE 'both' END AS support, concat(',', l_partkey % 7, ',', l_suppkey % 7, ',') AS bps FROM lineitem"


def contigs(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS cname", "l_linenumber AS read_id", "CASE WHEN l_returnflag = 'N' THEN 'split' WHEN l_returnflag = 'A' THEN 'disc' ELSE 'both' END AS support", "concat(',', l_partkey % 7, ',', l_suppkey % 7, ',') AS bps")


@query("a24_top_contigs", f"SELECT cname, count(*) AS n FROM ({CONTIGS}) GROUP BY cname ORDER BY n DESC, cname LIMIT 200")
def a24_top(spark, d):
    return contigs(spark, d).groupBy("cname").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "cname").limit(200)


@query("a24_reads_of_breakpoint", f"SELECT cname, read_id FROM ({CONTIGS}) WHERE bps LIKE '%,3,%'")
def a24_like(spark, d):
    return contigs(spark, d).where("bps LIKE '%,3,%'").select("cname", "read_id")


@query("a24_support_breakdown", f"SELECT support, count(*) AS n, count(DISTINCT cname) AS contigs FROM ({CONTIGS}) GROUP BY support")
def a24_support(spark, d):
    return contigs(spark, d).groupBy("support").agg(F.count("*").alias("n"), F.count_distinct("cname").alias("contigs"))


@query("a24_split_disc_per_contig", f"SELECT cname, CAST(sum(CASE WHEN support IN ('split', 'both') THEN 1 ELSE 0 END) AS BIGINT) AS n_split, CAST(sum(CASE WHEN support IN ('disc', 'both') THEN 1 ELSE 0 END) AS BIGINT) AS n_disc FROM ({CONTIGS}) GROUP BY cname")
def a24_counts(spark, d):
    return contigs(spark, d).groupBy("cname").agg(F.count_if(c("support").isin("split", "both")).alias("n_split"), F.count_if(c("support").isin("disc", "both")).alias("n_disc"))


@query("j14_reads_of_pass_contigs", f"SELECT r.cname, read_id, p.somatic FROM ({CONTIGS}) r JOIN (SELECT bp_num AS cname, CASE WHEN somlod >= 1 THEN 1 ELSE 0 END AS somatic FROM v_bps WHERE conf = 'PASS') p ON r.cname = p.cname")
def j14(spark, d):
    passed = view(spark, d, "v_bps").where("conf = 'PASS'").select(c("bp_num").alias("cname"), F.when(c("somlod") >= 1, 1).otherwise(0).alias("somatic"))
    return contigs(spark, d).join(passed, "cname").select("cname", "read_id", "somatic")


@query("a25_slowest_per_chromosome", f"WITH r AS ({RUNTIME}) SELECT chr, event_id, seconds FROM (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY seconds DESC, event_id) AS rn FROM r) WHERE rn <= 10")
def a25(spark, d):
    r = table(spark, d, "events").where("value IS NOT NULL").select("event_id", (c("user_id") % 24).alias("chr"), c("value").alias("seconds"))
    return stats.top_per_group(r, ["chr"], [c("seconds").desc(), c("event_id")], 10).select("chr", "event_id", "seconds")


@query("a26_power_law_fit", "WITH s AS (SELECT abs(pos2 - pos1) AS span FROM v_bps WHERE chr1 = chr2 AND pos1 <> pos2), k AS (SELECT span, count(*) AS n FROM s GROUP BY span), e AS (SELECT span, sum(n) OVER (ORDER BY span)::double / sum(n) OVER () AS p FROM k), l AS (SELECT log10(span) AS x, log10(1 - p) AS y FROM e WHERE p < 1) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM l")
def a26(spark, d):
    spans = view(spark, d, "v_bps").where("chr1 = chr2 AND pos1 <> pos2").groupBy(F.abs(c("pos2") - c("pos1")).alias("span")).agg(F.count("*").alias("n"))
    # a sweep over the distinct spans, stretch by stretch
    dealt = iv.carried(spans.withColumn("_bin", F.floor(c("span") / iv.STRETCH)), [], F.sum("n"), F.sum, "_before")
    upto = dealt.withColumn("upto", F.coalesce("_before", F.lit(0)) + F.sum("n").over(Window.partitionBy("_bin").orderBy("span")))
    total = spans.agg(F.sum("n")).first()[0]
    ecdf = upto.select("span", (c("upto") / F.lit(total)).alias("p")).where("p < 1").select(F.log10("span").alias("x"), F.log10(1 - c("p")).alias("y"))
    return ecdf.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@query("a27_panel_of_normals", "SELECT chr1, pos1, count(DISTINCT bp_num % 12) AS samples FROM v_bps GROUP BY chr1, pos1 HAVING count(DISTINCT bp_num % 12) >= 2")
def a27(spark, d):
    return view(spark, d, "v_bps").groupBy("chr1", "pos1").agg(F.count_distinct(c("bp_num") % 12).alias("samples")).where("samples >= 2")


@query("a28_median_of_trials", "SELECT event_type, quantile_cont(value, 0.5)::double AS median FROM events GROUP BY event_type")
def a28(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"))
