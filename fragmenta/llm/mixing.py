"""Documents mixed to target totals through soft domain membership.

A naive Bayes classifier over hashed words, counted from a labelled table, gives each document
posteriors over domains. Nonnegative document rates are then fitted so that the domains'
expected token totals meet their targets: projected gradient descent on least squares, whitened
by the domains' own second moments so that a step of one is safe. A step needs only the
domains' totals, one aggregation over the documents; a document's rate follows from its
posteriors and the few past steps, so no state is kept for documents. All of it is DataFrame
functions.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmenta.llm._shared import removed, text_or_empty, written

#: Hash buckets of words; labelled documents that the classifier is counted from at most.
BUCKETS, MOST_LABELLED = 8192, 10_000
STEPS, CLOSE = 60, 1e-9
#: Steps after which the rates so far are written, so that a pass replays no more steps than that.
REPLAY = 8
#: Log odds are divided by this power of a document's length before they become posteriors.
TEMPER = 0.25


def _words(col: str) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(col)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _constant(values: list[float]) -> Column:
    """A constant array; folded into one literal before the job runs."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def _total_of(table: Column) -> Column:
    """The sum of ``table`` over a text's buckets."""
    return F.aggregate("_b", F.lit(0.0), lambda total, b: total + F.get(table, b))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], list[list[float]]]:
    """Log priors and, for each domain but the first, log odds of each bucket against the first.

    ``labelled`` has id_col and domain; of an id's several domains the least counts, unknown domains
    and nulls do not. At most MOST_LABELLED rows are used, chosen by a hash of the id. Without any
    labelled row all domains are alike.
    """
    chosen = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isin(domains)).groupBy(F.col(id_col).alias("_id")).agg(F.min("domain").alias("_domain"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELLED)
    texts = docs.select(docs[id_col].alias("_of"), docs[text_col].alias("_text"))
    found = texts.join(F.broadcast(chosen), F.col("_of") == F.col("_id"))
    counted = found.select("_domain", F.explode(F.array_distinct(F.transform(_words("_text"), _bucket))).alias("_b")).groupBy("_domain", "_b").count().collect()
    sizes = {r["_domain"]: r["count"] for r in chosen.groupBy("_domain").count().collect()}
    counts = np.full((len(domains), BUCKETS), 0.5)
    for r in counted:
        counts[domains.index(r["_domain"]), r["_b"]] += r["count"]
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    n = np.array([sizes.get(d, 0) + 1.0 for d in domains])
    return np.log(n / n.sum()).round(9).tolist(), (logs[1:] - logs[0]).round(6).tolist()


def posteriors(docs: DataFrame, domains: list[str], model: tuple[list[float], list[list[float]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, tokens, p): words of each text, and its posterior of every domain as an array.

    Texts without words have no tokens and the prior as posterior. Repeated rows are each kept.
    """
    priors, odds = model
    base = docs.select(docs[id_col], _words(text_col).alias("_w")).select(id_col, F.size("_w").cast("long").alias("tokens"), F.array_distinct(F.transform("_w", _bucket)).alias("_b"))
    scale = F.pow(F.greatest(F.size("_b"), F.lit(1)).cast("double"), F.lit(-TEMPER))
    logits = [F.lit(priors[0])]
    for prior, weights in zip(priors[1:], odds, strict=True):
        logits.append(_total_of(_constant(weights)) * scale + F.lit(prior))
    base = base.select(id_col, "tokens", F.array(*logits).alias("_l"))
    top = F.array_max("_l")
    base = base.select(id_col, "tokens", F.transform("_l", lambda x: F.exp(x - top)).alias("_e"))
    return base.select(id_col, "tokens", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def rate_of(p: Column, steps: list[list[float]], begin: Column | None = None) -> Column:
    """A document's rate after the given steps of projected gradient descent from ``begin``, or 1."""
    begin = F.lit(1.0) if begin is None else begin
    if not steps:
        return begin
    history = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    return F.aggregate(history, begin, lambda r, g: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))


def fit_rates(members: DataFrame, targets: list[float]) -> list[list[float]]:
    """The steps that bring sum(tokens * p * rate) to ``targets``, or as near as nonnegative rates allow."""
    k = range(len(targets))
    t = F.col("tokens").cast("double")
    moments = members.agg(*(F.sum(t * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"m{i}_{j}") for i in k for j in k if i <= j)).first()
    square = np.array([[moments[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k])
    inverse = np.linalg.pinv(square, rcond=1e-10, hermitian=True)
    steps: list[list[float]] = []
    state, done = members.select("tokens", "p", F.lit(1.0).alias("rate")), 0
    for _ in range(STEPS):
        if len(steps) - done == REPLAY:
            before, state = state, written(state.select("tokens", "p", rate_of(F.col("p"), steps[done:], F.col("rate")).alias("rate")), "rates")
            removed(before)
            done = len(steps)
        rate = rate_of(F.col("p"), steps[done:], F.col("rate"))
        totals = state.agg(*(F.sum(t * F.get("p", F.lit(i)) * rate).alias(f"t{i}") for i in k)).first()
        off = np.array([(totals[f"t{i}"] or 0.0) - targets[i] for i in k])
        move = inverse @ off
        if np.abs(off).max() <= CLOSE * max(targets, default=0) or np.abs(move).max() <= CLOSE:
            break
        steps.append([float(f"{x:.12g}") for x in move])
    removed(state)
    return steps


def mix(docs: DataFrame, labelled: DataFrame, shares: dict[str, float], id_col: str = "doc_id", text_col: str = "text", seed: int = 9) -> DataFrame:
    """(id_col, tokens, p, rate, copies) of every row; ``shares``: each domain's wanted total against its present one.

    ``copies`` rounds the rate up or down by a hash of the id, so its mean is the rate. Rates depend
    on posteriors only: repeated rows get equal ones. An empty table gives an empty one.
    """
    domains = list(shares)
    model = fit_classifier(docs, labelled, domains, id_col, text_col)
    members = written(posteriors(docs, domains, model, id_col, text_col), "members")
    now = members.agg(*(F.sum(F.col("tokens") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(len(domains)))).first()
    steps = fit_rates(members, [(now[f"t{i}"] or 0.0) * shares[d] for i, d in enumerate(domains)])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = members.withColumn("rate", rate_of(F.col("p"), steps))
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("long"))


#: Each domain's wanted share of its present tokens: clean text is kept and partly repeated, the others are thinned.
SHARES = {"clean": 1.25, "toxic": 0.5, "low": 0.6}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: low quality first, then toxic, else clean; null flags count as 1 and 0."""
    domain = F.when(F.coalesce("quality", F.lit(1)) == 0, "low").when(F.coalesce("toxic", F.lit(0)) == 1, "toxic").otherwise("clean")
    return labels.select("doc_id", domain.alias("domain"))
