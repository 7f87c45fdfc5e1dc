"""Likelihood models as Column expressions.

Counts are alternate (a) and total (d) reads. All likelihoods are log10.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the models.
IMPOSSIBLE, EPS, BACK_ERROR = -1e12, 1e-6, 1e-6
SPLIT_BUFFER = 5  # bases at each end of a read that cannot support a split
#: Error rate by length of the repeat at the site; longer repeats take the last.
REPEAT_ERROR = [1e-3, 1e-3, 1e-3, 1e-3, 1e-3, 2e-3, 5e-3, 1e-2, 2e-2, 3e-2, 1e-1]
LONG_REPEAT_ERROR = 0.08


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def repeat_error(length: Column) -> Column:
    """Error rate of a site in a repeat of ``length``."""
    table = F.array(*(F.lit(x) for x in REPEAT_ERROR))
    return F.when(length < len(REPEAT_ERROR), F.get(table, F.greatest(length, F.lit(0)))).otherwise(LONG_REPEAT_ERROR)


def _term(count: Column, p: Column) -> Column:
    """count * log10(p); zero counts cost nothing."""
    return F.when(p > 0, count * F.log10(p)).when(count > 0, F.lit(IMPOSSIBLE)).otherwise(0.0)


def log_likelihood(ref: Column, alt: Column, f: Column | float, e_fwd: Column | float, e_back: Column | float = BACK_ERROR) -> Column:
    """Of ref and alt counts at allele fraction ``f`` with errors towards alt (e_fwd) and back; negative counts are 0."""
    ref, alt = F.greatest(ref.cast("double"), F.lit(0.0)), F.greatest(alt.cast("double"), F.lit(0.0))
    f, e, b = _col(f), _col(e_fwd), _col(e_back)
    r = _term(ref, (1 - f) * (1 - e) + f * b)
    a = _term(alt, f * (1 - b) + (1 - f) * e)
    return F.when((r == IMPOSSIBLE) | (a == IMPOSSIBLE), F.lit(IMPOSSIBLE)).otherwise(r + a)


def somatic_lod(a_n: Column, d_n: Column, a_t: Column, d_t: Column, e: Column, e_back: float = BACK_ERROR) -> Column:
    """log10 odds that an allele is somatic rather than germline, from normal and tumour counts.

    Somatic: absent from the normal and at its own fraction in the tumour, or an artefact in both.
    Germline: one shared fraction (less likely in a clean normal, likelier the more the fractions
    agree), heterozygous, homozygous, an artefact, or a free fraction in each where the normal shows
    more than errors explain (at the price of a parameter).
    """
    d_n, d_t = F.greatest(d_n.cast("double"), F.lit(1.0)), F.greatest(d_t.cast("double"), F.lit(1.0))
    a_n, a_t = a_n.cast("double"), a_t.cast("double")
    e_n, e_t = F.least(e, F.lit(0.005)), clamp(e, 1e-4, 0.02)
    f_n, f_t = clamp(a_n / d_n, EPS, 1 - EPS), clamp(a_t / d_t, EPS, 1 - EPS)
    shared = clamp((a_n + a_t) / (d_n + d_t), EPS, 1 - EPS)
    normal = lambda f, err=e_n: log_likelihood(d_n - a_n, a_n, f, err, e_back)
    tumour = lambda f, err=e_t: log_likelihood(d_t - a_t, a_t, f, err, e_back)
    artefact = normal(clamp(e, 1e-5, 1e-2), e) + tumour(clamp(e, 1e-5, 1e-2), e)
    somatic = F.greatest(normal(0.0) + tumour(f_t), artefact)
    clean = F.exp(-3.0 * F.greatest(F.lit(0.0), a_n - d_n * e_n))
    ratio = F.least(f_n, f_t) / F.greatest(f_n, f_t)
    bonus = F.when((a_n > 0) & (a_t > 0) & (f_n < 0.15) & (f_t < 0.15), 2.0 * ratio).otherwise(0.0)
    one = normal(shared) + tumour(shared) - 2.0 * clean + (1.0 - clean) * ratio * 3.0 + bonus
    free = F.when(a_n > d_n * e_n + 1.0, normal(f_n) + tumour(f_t) - 0.5 * F.log10(d_n + d_t))
    germline = F.greatest(one, normal(0.5) + tumour(0.5), normal(1 - EPS) + tumour(1 - EPS), artefact, free)  # skips a null
    return somatic - germline


def usable_cover(cover: Column, readlen: float) -> Column:
    """Cover by reads that reach far enough over both sides of a site."""
    return F.greatest(F.lit(0.0), cover.cast("double") * F.lit(readlen - 2.0 * SPLIT_BUFFER) / F.lit(float(readlen)))


def genotype_likelihood(ref_copies: int, e: Column, alt: Column, cover: Column) -> Column:
    """Of a genotype with so many reference copies of two; counts are truncated to whole reads."""
    alt, cover = F.greatest(alt.cast("int"), F.lit(0)), F.greatest(cover.cast("int"), F.lit(0))
    e = clamp(e, 0.0, 1.0)
    p_ref = ((2 - ref_copies) * e + ref_copies * (1 - e)) / 2
    p_alt = ((2 - ref_copies) * (1 - e) + ref_copies * e) / 2
    ref = (cover - alt).cast("double")
    r, a = _term(ref, p_ref), _term(alt.cast("double"), p_alt)
    whole = -cover * F.log10(F.lit(2.0)) + r + a
    return F.when((alt > cover) | (r == IMPOSSIBLE) | (a == IMPOSSIBLE), F.lit(IMPOSSIBLE)).otherwise(whole)


def call_sample(alt: Column, cover: Column, e: Column, readlen: int) -> Column:
    """struct(af, lo, lo_n, gt, pl, gq, nh_gq) of one sample's counts."""
    d = usable_cover(cover, readlen)
    af = F.when(d > 0, F.least(F.lit(1.0), alt / d)).otherwise(1.0)
    a = F.least(alt.cast("double"), d)
    none = log_likelihood(d - a, a, 0.0, e)
    lo = log_likelihood(d - a, a, af, e) - none
    lo_n = none - log_likelihood(d - a, a, F.greatest(af, F.lit(0.5)), e)
    gl = [genotype_likelihood(g, e, a, d) for g in (2, 1, 0)]
    best = F.greatest(*gl)
    pl = F.array(*(F.round(-10.0 * (x - best)).cast("int") for x in gl))
    gt = F.when(gl[0] == best, "0/0").when(gl[1] == best, "0/1").otherwise("1/1")
    gq = F.least(F.get(F.array_sort(pl), F.lit(1)), F.lit(99))
    return F.struct(af.alias("af"), lo.alias("lo"), lo_n.alias("lo_n"), gt.alias("gt"), pl.alias("pl"), gq.alias("gq"), F.least(F.get(pl, F.lit(0)), F.lit(99)).alias("nh_gq"))


def read_score(aligned: Column, clipped: Column, indel_ops: Column, indel_bases: Column, nm: Column) -> Column:
    """Alignment score of a read; a negative NM leaves out the mismatches."""
    mismatches = F.when(nm >= 0, 4 * F.greatest(F.lit(0), nm - indel_bases)).otherwise(0)
    return aligned - clipped - 6 * indel_ops - indel_bases - mismatches


def contig_confidence(indel_ops: Column, longest_indel: Column, mismatch_rate: Column, score_per_base: Column) -> Column:
    """0 to 1: less for several indels, mismatches and a low score; a null score leaves that out."""
    many = F.when(indel_ops >= 2, 0.2 * (indel_ops - 1)).otherwise(0.0)
    noisy = F.when((indel_ops >= 2) & (longest_indel <= 20) & (mismatch_rate > 0.02), 0.25).otherwise(0.0)
    wrong = F.when(mismatch_rate > 0.01, 10.0 * (mismatch_rate - 0.01)).otherwise(0.0)
    worse = F.when(mismatch_rate > 0.05, 30.0 * (mismatch_rate - 0.05) * (mismatch_rate - 0.05)).otherwise(0.0)
    poor = F.when(score_per_base < 0.70, 2.0 * (0.70 - score_per_base)).otherwise(0.0)
    return clamp(1.0 - (many + noisy + wrong + worse + poor), 0.0, 1.0)


def site_quality(lod: Column) -> Column:
    """Phred quality of 1 / (1 + 10**lod), at most 99."""
    p = F.greatest(F.lit(1e-30), 1 / (1 + F.pow(F.lit(10.0), lod)))
    return F.least(F.lit(99), F.round(-10 * F.log10(p))).cast("int")
