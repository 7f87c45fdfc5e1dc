"""Golden values, and properties on invented rows."""

import random

import pytest
from pyspark.sql import functions as F

from fragmenta.functions import filters, model, vcf
from fragmenta.functions import sequence as sq
from fragmenta.operators import cluster, dedup, kernels, support
from fragmenta.operators import intervals as iv
from fragmenta.plans import commands
from fragmenta.sources import bps, tracks
from fragmenta.streaming import sessions

c = F.col


def one(spark, **columns):
    return spark.range(1).select(*(x.alias(k) for k, x in columns.items())).first()


@pytest.mark.parametrize(
    ("cigar", "nm", "want"),
    [("150M", 0, 150), ("80M70S", 0, 10), ("90M60S", 0, 30), ("38M3I109M", 3, 141), ("75M5I70M", 5, 139), ("75M5D75M", 5, 139), ("150M", 4, 134)],
)
def test_read_score(spark, cigar, nm, want):
    ops = sq.cigar_ops(F.lit(cigar))
    score = model.read_score(sq.cigar_sum(ops, "MI=X"), sq.cigar_sum(ops, "SH"), sq.cigar_count(ops, "ID"), sq.cigar_sum(ops, "ID"), F.lit(nm))
    # inserted bases are not aligned ones
    aligned = model.read_score(sq.cigar_sum(ops, "M=X"), sq.cigar_sum(ops, "SH"), sq.cigar_count(ops, "ID"), sq.cigar_sum(ops, "ID"), F.lit(nm))
    got = one(spark, a=score, b=aligned)
    assert want in (got.a, got.b)


@pytest.mark.parametrize(("rate", "penalty"), [(0.02, 0.10), (0.03, 0.20), (0.05, 0.40), (0.10, 0.90 + 0.075)])
def test_contig_penalty(spark, rate, penalty):
    got = one(spark, x=model.contig_confidence(F.lit(0), F.lit(0), F.lit(rate), F.lit(1.0))).x
    assert got == pytest.approx(max(0.0, 1 - penalty))


def test_shared_evidence_is_not_somatic(spark):
    d = spark.createDataFrame([(6.0, 33.0, 84.0, 90.0, 1e-3), (0.0, 40.0, 20.0, 60.0, 1e-3), (20.0, 40.0, 30.0, 60.0, 1e-3)], "an double, dn double, at double, dt double, e double")
    lods = [r.l for r in d.select(model.somatic_lod(c("an"), c("dn"), c("at"), c("dt"), c("e")).alias("l")).collect()]
    assert lods[0] < 0 < lods[1] and lods[2] < 0


def test_kinds(spark):
    got = one(spark, a=vcf.symbolic_kind(F.lit(True), F.lit("+"), F.lit("+")), b=vcf.viewer_kind(F.lit(True), F.lit("+"), F.lit("+")), x=vcf.significant(F.lit(0.00001234)), y=vcf.significant(F.lit(123456.0)), z=vcf.significant(F.lit(0.0)), w=vcf.significant(F.lit(9999.5)))
    assert tuple(got) == ("DEL", "Inversion", "1.234e-05", "1.235e+05", "0", "1e+04")


def test_pair_dedup_ignores_sides(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(1, 3), rng.randint(1, 20), rng.choice("+-"), rng.randint(1, 3), rng.randint(1, 20), rng.choice("+-"), "PASS", rng.randint(0, 9), rng.randint(0, 9)) for k in range(400)]
    schema = "bp_num long, chr1 int, pos1 long, strand1 string, chr2 int, pos2 long, strand2 string, conf string, somlod long, maxlod long"
    swapped = [(r[0], r[4], r[5], r[6], r[1], r[2], r[3], *r[7:]) if rng.random() < 0.5 else r for r in rows]
    ids = lambda x: sorted(r.bp_num for r in dedup.canonical_pairs(spark.createDataFrame(x, schema)).collect())
    assert ids(rows) == ids(swapped)
    assert len(ids(rows)) == len({frozenset([(r[1], r[2], r[3]), (r[4], r[5], r[6])]) for r in rows})
    assert dedup.fuzzy_pairs(spark.createDataFrame(rows, schema), crowd=10_000).count() <= len(rows)


def random_intervals(spark, seed, n, prefix=""):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.randint(-500, 5000)
        rows.append((k, rng.randint(1, 2), s, s + rng.choice((-1, 0, 3, 90, 4000))))
    return rows, spark.createDataFrame(rows, f"{prefix}id int, {prefix}chr int, {prefix}s long, {prefix}e long")


@pytest.mark.parametrize("width", [1, 64, 5000])
def test_overlap_join_equals_nested_loop(spark, width):
    a, left = random_intervals(spark, 2, 120)
    b, right = random_intervals(spark, 3, 80, "r_")
    args = ([("chr", "r_chr")], (c("s"), c("e")), (c("r_s"), c("r_e")))
    got = sorted((r.id, r.r_id) for r in iv.overlap_join(left, right, *args, width).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] and y[2] <= y[3])
    assert got == want
    assert sorted(r.id for r in iv.overlap_semi(left, right, *args, width).collect()) == sorted({x for x, _ in want})
    assert iv.overlap_semi(left, right, *args, width, anti=True).count() == len(a) - len({x for x, _ in want})


def test_bins_are_not_put_together(spark):
    a, left = random_intervals(spark, 22, 120)
    b, right = random_intervals(spark, 23, 80, "r_")
    met = iv.overlap_join(left, right, [("chr", "r_chr")], (c("s"), c("e")), (c("r_s"), c("r_e")), 64, parts=16)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] and y[2] <= y[3])
    assert sorted((r.id, r.r_id) for r in met.collect()) == want
    assert met.rdd.getNumPartitions() == 16


@pytest.mark.parametrize("width", [1, 64, 5000])
def test_overlaps_without_pairs_equal_nested_loops(spark, width):
    a, left = random_intervals(spark, 12, 150)
    b, right = random_intervals(spark, 13, 60, "r_")
    b += [(7, None, 0, 900), (8, 1, None, 40)]
    right = right.unionByName(spark.createDataFrame(b[-2:], right.schema))
    a += [(900, None, 5, 9), (901, 1, None, 9), (902, 2, 9, None)]
    left = left.unionByName(spark.createDataFrame(a[-3:], left.schema))
    on, ends = [("chr", "r_chr")], (c("r_s"), c("r_e"))
    usable = [y for y in b if None not in y and y[2] <= y[3]]
    hit = {x[0]: None not in x and any(x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] for y in usable) for x in a}
    assert {r.id: r.hit for r in iv.with_overlap(left, right, on, (c("s"), c("e")), ends, "hit", width).collect()} == hit
    over = lambda x: [y for y in usable if x[1] == y[1] and x[2] is not None and y[2] <= x[2] <= y[3]]
    first = {x[0]: min(over(x), key=lambda y: (y[2], y[0]))[0] for x in a if over(x)}
    assert {r.id: r.r_id for r in iv.first_overlap(left, right, on, c("s"), ends, "r_id", width).collect()} == first
    held = {y[0]: 0 for y in usable}
    for x in a:
        for y in over(x):
            held[y[0]] += 1
    assert {r.r_id: r.n for r in iv.points_within(left, right, on, c("s"), ends, "r_id", width).collect()} == held


def test_merge_is_idempotent(spark):
    _, df = random_intervals(spark, 4, 200)
    df = df.where("s <= e")
    first = iv.merge_intervals(df, ["chr"], "s", "e", 10)
    again = iv.merge_intervals(first.drop("n"), ["chr"], "s", "e", 10)
    assert sorted(map(tuple, first.select("chr", "s", "e").collect())) == sorted(map(tuple, again.select("chr", "s", "e").collect()))


def test_depth_counts_every_base(spark):
    rows, df = random_intervals(spark, 5, 60)
    runs = iv.depth(df.where("s <= e"), ["chr"], c("s"), c("e")).collect()
    assert sum((r.run_end - r.run_start + 1) * r.depth for r in runs) == sum(x[3] - x[2] + 1 for x in rows if x[2] <= x[3])


def test_capped_islands_follow_the_fold(spark):
    rng = random.Random(6)
    places = sorted(rng.choices(range(0, 9000), k=300))
    rows = [(k, 1, p) for k, p in enumerate(places)]
    rng.shuffle(rows)
    got = {r.k: (r.island, r.part) for r in cluster.capped_islands(spark.createDataFrame(rows, "k int, chr int, p long"), ["chr"], "p", ["k"]).collect()}
    island, part, start, last, want = 0, 0, None, None, {}
    for k, p in enumerate(places):
        if last is None or p - last > cluster.GAP:
            island, part, start = island + 1, 0, p
        elif last - start > cluster.WIDEST and p != last:
            part, start = part + 1, p
        want[k], last = (island, part), p
    assert got == want


def test_motifs_and_their_reverses(spark):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(80)) for _ in range(40)]
    reads = spark.createDataFrame([(k // 2, k % 2, 0x400 if k == 3 else 0, s) for k, s in enumerate(seqs)], "qname long, mate int, flag int, seq string")
    patterns = spark.createDataFrame([(seqs[3][10:31], "a"), (seqs[8][5:27], "b"), ("A" * 20, "c")], "pattern string, bp_id string")
    flipped = patterns.withColumn("pattern", sq.reverse_complement(c("pattern")))
    for p in (patterns, flipped):
        found, counts = commands.extract_pairs(reads, p, 20, counts=True)
        assert sorted({r.qname for r in found.collect()}) == [1, 4]
        assert [(r.bp_id, r.n) for r in counts.collect()] == [("b", 1)]
    both = support.with_reverse(patterns, "pattern", sq.reverse_complement(c("pattern")))
    machine = support.automaton_hits(reads, both.withColumnRenamed("bp_id", "pattern_id"), ["qname", "mate"])
    joined = support.kmer_hits(reads, both, 20).select("qname", "mate", "bp_id").distinct()
    assert sorted(map(tuple, machine.distinct().collect())) == sorted(map(tuple, joined.collect()))


def test_motifs_beyond_the_basic_plane_and_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(support, "BLOCK_PATTERNS", 2)
    monkeypatch.setattr(support, "PIECE_CHARS", 40)
    rng = random.Random(17)
    seqs = ["".join(rng.choice("AB\n\U0001f600é") for _ in range(n)) for n in (0, 3, 6, 30, 90, 200)] + [None, "A" * 30]
    seqs += seqs[4:5]
    found = [(0, "A" * 7), (1, seqs[3][-8:]), (2, seqs[4][:9]), (3, seqs[4][:9]), (4, seqs[5][50:56]), (5, seqs[3][-3:] + seqs[4][:4])]
    texts = spark.createDataFrame(list(enumerate(seqs)), "doc long, seq string")
    hits = support.kmer_hits(texts, spark.createDataFrame(found, "item long, pattern string"), 6)
    want = {(d, i) for d, t in enumerate(seqs) for i, p in found if t and p in t}
    assert {(r.doc, r.item) for r in hits.collect()} == want
    assert support.kmer_hits(texts, spark.createDataFrame([], "item long, pattern string"), 6).count() == 0
    assert "posexplode" not in hits._jdf.queryExecution().toString().lower()  # no row for each place of each text


def test_breakpoint_lines_of_all_versions(spark):
    full = [str(k) for k in range(53)]
    full[34:37] = ["NA", "1", "NA"]
    full[51], full[52] = "bp00100000000", "ACGTN"
    block = "0/1:3:20:2:1:12.5:10,0,99:nan:-1.2"
    lines = ["#chr1\tx", "\t".join(full + [block]), "\t".join(full[:52] + [block]), "\t".join(full[:51] + [block]), "\t".join(full[:41] + [block]), "too\tshort"]
    calls = bps.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = calls.collect()
    assert [r.version for r in got] == [4, 3, 2, 1]
    assert [len(r.samples) for r in got] == [1, 1, 1, 1]
    assert got[0].somlod is None or got[0].somlod == 1.0
    s = bps.sample_rows(calls.where("version = 4"), ["t001_/a.bam"], ["bp_id"]).first()
    assert (s.sample, s.gt, s.ad, s.dp, s.pl, s.lo, s.lo_n) == ("t001", "0/1", 3, 20, [10, 0, 99], 0.0, -1.2)
    assert bps.header_samples("\t".join([*("c" * 41), "t001_x", "n001_y"])) == ["t001_x", "n001_y"]
    assert [r.version for r in bps.parse(bps.lines(calls.where("version = 4"))).collect()] == [4]
    again = commands.refilter(calls.where("version = 4"), ["t001_/a.bam"])
    assert again.columns == calls.columns and again.count() == 1
    plans = commands.postprocess(calls.where("version = 4"))
    assert plans["dedup"].count() == 1


def test_tracks_round_trips(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#c\nchr1\t5\t10\tx\nchr2\t1\t3\nbad\n")
    assert sorted((r.chrom, r.start, r.end, r.label) for r in tracks.read_bed(spark, f"{tmp_path}/a.bed").collect()) == [("chr1", 5, 10, "x"), ("chr2", 1, 3, None)]
    (tmp_path / "d.vcf").write_text("##x\nchr1\t7\trs1\tA\tAT\nchr1\t9\trs2\tACG\tA\nchr1\t11\trs3\tA\tC\n")
    assert sorted((r.id, r.start, r.end) for r in tracks.read_dbsnp(spark, f"{tmp_path}/d.vcf").collect()) == [("rs1", 7, 8), ("rs2", 9, 13)]
    (tmp_path / "q.txt").write_text("# c\n acgt acgt\n\nACGTACGT\n")
    assert [r.pattern for r in tracks.read_queries(spark, f"{tmp_path}/q.txt").collect()] == ["ACGTACGT"]
    (tmp_path / "g.fa").write_text(">one x\nACGTAC\nGTTT\n>two\nGGG\n")
    fasta = tracks.read_fasta(spark, f"{tmp_path}/g.fa", 4)
    sites = spark.createDataFrame([("one", 4), ("one", 9), ("two", 1)], "chrom string, pos int")
    assert sorted((r.chrom, r.pos, r.bases) for r in tracks.fetch_bases(fasta, sites, 3, 4).collect()) == [("one", 4, "TAC"), ("one", 9, "TT"), ("two", 1, "GGG")]
    assert tracks.parse_regions("chr1:1,000-2,000", lambda p: False) == [("chr1", 1000, 2000)]
    assert tracks.parse_regions("1,2", lambda p: False) == [("1", None, None), ("2", None, None)] and tracks.parse_regions("") == []
    df = spark.createDataFrame([("t001", 1), ("n001", 2)], "sample string, x int")
    tracks.write_by_sample(df, f"{tmp_path}/by")
    assert spark.read.parquet(f"{tmp_path}/by").count() == 2
    calls = spark.createDataFrame([(1, 1, 100, "+", 1, 400, "-", "PASS", 2, 7)], "bp_num long, chr1 int, pos1 long, strand1 string, chr2 int, pos2 long, strand2 string, conf string, somlod long, maxlod long")
    commands.write_vcf(commands.breakend_records(calls), f"{tmp_path}/vcf", gzip=False)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/vcf/records").collect()]
    assert lines[0].startswith("1\t100\t1:1\tN\tN[1:400[\t70\tPASS\tEVENT=1;") and len(lines) == 2


def test_filters(spark):
    got = one(spark, a=filters.bad_flags(F.lit(0x400)), b=filters.orientation(F.lit(1), F.lit(1), F.lit(9), F.lit(3), F.lit("-"), F.lit("+")), c=sq.append_token(F.lit("a,b"), F.lit("a")), d=sq.parse_region(F.lit("chr7:1,234-5M")))
    assert (got.a, got.b, got.c, tuple(got.d)) == (True, "FR", "a,b", ("chr7", 1234, 5_000_000))


def test_kernels():
    rng = random.Random(8)
    truth = "".join(rng.choice("ACGT") for _ in range(120))
    reads = [truth[i : i + 50] for i in range(0, 71, 5)]
    assert kernels.greedy_contigs(reads, 20) == [truth]
    solid = {truth[i : i + 15] for i in range(106)}
    assert kernels.correct(truth[:30] + ("A" if truth[30] != "A" else "C") + truth[31:60], solid, 15) == truth[:60]
    assert kernels.align(truth[20:60], truth) == (40, 0, 40, 20, 60)
    assert kernels.align("GG" + truth[20:60], truth)[0] >= 40


def test_kernels_take_equal_reads_once(spark, monkeypatch):
    rng = random.Random(9)
    truth = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(2)]
    seqs = [(w, truth[w][i : i + 40]) for w in (0, 1) for i in range(0, 61, 4)]
    bad = [(w, s[:20] + ("A" if s[20] != "A" else "C") + s[21:]) for w, s in seqs[3:5] + seqs[20:21]]
    rows = [(w, n, s) for n, (w, s) in enumerate(seqs * 5 + bad * 2 + seqs[:3])]
    reads = spark.createDataFrame(rows, "win long, read_id long, seq string")
    sizes = spark.sparkContext.accumulator(0)
    plain = kernels.correct
    monkeypatch.setattr(kernels, "correct", lambda s, solid, k: sizes.add(1) or plain(s, solid, k))
    got = sorted(map(tuple, kernels.correct_reads(reads).select("win", "read_id", "seq", "corrected").collect()))
    want = []
    for w in (0, 1):
        mine = [(n, s) for v, n, s in rows if v == w]
        counts = {}
        for _, s in mine:
            for i in range(26):
                counts[s[i : i + 15]] = counts.get(s[i : i + 15], 0) + 1
        want += [(w, n, s, plain(s, {x for x, m in counts.items() if m >= 3}, 15)) for n, s in mine]
    assert got == sorted(want)
    assert 0 < sizes.value <= len(set(seqs + bad))
    contigs = kernels.assemble(reads.where("read_id < 160"))
    best = {(r.win, r.read_id): (r.cname, r.score) for r in kernels.align_reads(reads, contigs).collect()}
    targets = [(r.win, r.cname, r.contig) for r in contigs.collect()]
    assert len(best) == len(rows)
    for w, n, s in rows:
        score, name = min((-kernels.align(s, t)[0], m) for v, m, t in targets if v == w)
        assert best[w, n] == (name, -score)


def test_streams(spark, tmp_path):
    rows = [(1, "a", f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 20)] + [(1, "b", "2024-01-01 05:00:00"), (2, "c", "2024-01-01 00:00:00"), (9, "z", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, k string, t string").select("user_id", "k", F.to_timestamp("t").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    want = [(1, 3)]
    assert [(r.user_id, r.n) for r in sessions.session_clusters(df).collect()] == want
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = sessions.session_clusters(source, late="10 minutes").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.user_id, r.n) for r in spark.sql("SELECT * FROM found").collect()] == want
    q = sessions.distinct_within(source, ["user_id", "k"]).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM once").count() == 4


def test_events_a_gap_apart_are_two_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00.9"), (1, "2024-01-01 01:00:00.1"), (2, "2024-01-01 00:00:00.9"), (2, "2024-01-01 00:59:59.9")]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert [(r.user_id, r.n) for r in sessions.session_clusters(df).collect()] == [(2, 2)]


@pytest.mark.parametrize("stretch", [7, 40, 1 << 20])
def test_sweeps_do_not_depend_on_stretches(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.randint(0, 1), rng.randint(0, 300), k) for k in range(120)]
    rows = [(k, a, a + rng.randint(0, 25), i) for k, a, i in rows]
    df = spark.createDataFrame(rows, "k int, a long, b long, i int")
    want, lags = [], {}
    for key in (0, 1):
        mine = sorted((a, b) for k, a, b, _ in rows if k == key)
        for a, b in mine:
            if want and want[-1][0] == key and a <= want[-1][2] + 3:
                want[-1] = (key, want[-1][1], max(want[-1][2], b), want[-1][3] + 1)
            else:
                want.append((key, a, b, 1))
        before = None
        for _, a, b, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            lags[i] = before
            before = b
    assert sorted(map(tuple, iv.merge_intervals(df, ["k"], "a", "b", 3, stretch=stretch).collect())) == sorted(want)
    assert {r.i: r.p for r in iv.previous(df, ["k"], ["a", "i"], "b", "p", stretch).collect()} == lags
    runs = iv.depth(df, ["k"], F.col("a"), F.col("b"), stretch).collect()
    assert {(r.k, p): r.depth for r in runs for p in range(r.run_start, r.run_end + 1)} == {(k, p): n for k in (0, 1) for p in range(330) if (n := sum(x == k and a <= p <= b for x, a, b, _ in rows))}
    number, last, found = {}, {}, {}
    for k, a, _, i in sorted(rows, key=lambda r: (r[0], r[1])):
        number[k] = number.get(k, 0) + (k not in last or a - last[k] > 4)
        last[k] = a
        found[i] = number[k]
    assert {r.i: r.island for r in cluster.islands(df, ["k"], "a", [], 4, stretch).collect()} == found


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), k) for k in range(500)]
    out = commands.numbered(spark.createDataFrame(rows, "p long, k long"), [F.col("p").asc_nulls_first(), F.col("k")], "rn", F.col("p"), parts=9)
    assert [r.k for r in out.orderBy("rn").collect()] == [k for _, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [r.rn for r in out.orderBy("rn").collect()] == list(range(1, 501))


def test_paste_asserts_the_grid(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (None, 2, 7)], "chr int, bin int, n int")
    b = spark.createDataFrame([(1, 1, 3), (None, 2, 4)], "chr int, bin int, m int")
    assert sorted(((r.chr or 0), r.bin, r.n, r.m) for r in iv.paste(a, b, ["chr", "bin"]).collect()) == [(0, 2, 7, 4), (1, 0, 5, None), (1, 1, 6, 3)]
    with pytest.raises(Exception, match="coordinates of one track only: 9:9"):
        iv.paste(a, b.unionByName(spark.createDataFrame([(9, 9, 1)], b.schema)), ["chr", "bin"]).collect()
