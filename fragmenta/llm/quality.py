"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Emissions look at the line and both its neighbours, transitions tie
labels of lines that follow each other. Forward-backward gives every line's marginal; a
document's score is their mean, weighted by the lines' lengths. A line's label in training is
its document's.

The field is fitted on the driver, on a bounded sample of labelled documents: at most MOST_DOCS of
them, with at most MOST_LINES lines together. Scoring is a map over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.llm import _text
from fragmenta.llm._shared import removed, written

#: The bound of the sample that the field is fitted on.
MOST_DOCS, MOST_LINES = 4000, 300_000
#: Chains are cut after so many lines in the fit, so that a step takes as long whatever the longest document.
CHAIN = 400
STEPS, RATE, DECAY = 120, 0.15, 1e-4

#: Classes of bytes whose shares of a line are features.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "bar": b"|", "sign": b"#$%&*@^~<>{}[]\\_=+`/", "shout": b"!?", "stop": b".,;:'\"()-"}
_CLASS = np.full(256, len(CLASSES), np.uint8)  # the last: all other bytes
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k
OWN = len(CLASSES) + 1 + 6
WIDTH = 3 * OWN + 3


class Lines(NamedTuple):
    first: np.ndarray  # texts' line bounds
    length: np.ndarray  # bytes
    x: np.ndarray  # features


def line_features(data: np.ndarray, bounds: np.ndarray) -> Lines:
    """Features of all lines of a chunk of texts; an empty text has one empty line."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([bounds[1:], breaks]), kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(bounds, breaks, "right") - 1, minlength=len(bounds) - 1) + 1)])
    length = ends - starts
    kinds = _CLASS[data]
    x = np.zeros((len(starts), OWN), np.float32)
    whole = np.maximum(length, 1)
    for k in range(len(CLASSES) + 1):
        total = np.zeros(n + 1, np.int32)
        np.cumsum(kinds == k, out=total[1:])
        x[:, k] = (total[ends] - total[starts]) / whole
    found = _text.words(data, bounds)
    low, high = np.searchsorted(found.start, starts), np.searchsorted(found.start, ends)
    count = high - low

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[high] - total[low]) / np.maximum(count, 1)

    h, size = found.hash, found.end - found.start
    k = len(CLASSES) + 1
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    after = np.zeros(len(h), bool)
    after[2:] = h[2:] == h[:-2]
    x[:, k], x[:, k + 1] = share(again), share(after)
    x[:, k + 2] = np.minimum(share(size) / 20, 2)
    x[:, k + 3] = np.log1p(length) / 10
    x[:, k + 4] = np.log1p(count) / 10
    x[:, k + 5] = share(size == 1)
    return Lines(first, length, x)


def with_neighbours(lines: Lines) -> np.ndarray:
    """A line's own features, those of the line before and after in its text, and where it lacks these."""
    n = len(lines.x)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[lines.first[:-1]] = True
    tail[lines.first[1:] - 1] = True
    before, after = np.zeros_like(lines.x), np.zeros_like(lines.x)
    before[1:], after[:-1] = lines.x[:-1], lines.x[1:]
    before[head], after[tail] = 0, 0
    return np.concatenate([lines.x, before, after, head[:, None], tail[:, None], np.ones((n, 1))], axis=1, dtype=np.float32)


class Field(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of 'good' against 'bad'
    turns: np.ndarray  # 2 x 2: from, to

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def messages(e: np.ndarray, first: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all chains at once, as log odds of 'good'; the marginal's log odds are their sum."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    heads, sorted_sizes = first[:-1][order], sizes[order]
    tails = heads + sorted_sizes - 1
    forward, backward = e.astype(np.float64), np.zeros(len(e))
    for t in range(1, int(sizes.max(initial=0))):
        k = int(np.searchsorted(-sorted_sizes, -t, "left"))  # chains longer than t
        at = heads[:k] + t
        a = forward[at - 1]
        forward[at] += np.logaddexp(turns[0, 1], a + turns[1, 1]) - np.logaddexp(turns[0, 0], a + turns[1, 0])
        at = tails[:k] - t
        b = backward[at + 1] + e[at + 1]
        backward[at] = np.logaddexp(turns[1, 0], b + turns[1, 1]) - np.logaddexp(turns[0, 0], b + turns[0, 1])
    return forward, backward


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood of the label sequences, every document with the same weight, by Adam."""
    n = len(first) - 1
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    sizes = np.diff(first)
    y = np.repeat(labels, sizes).astype(np.float64)
    share = np.repeat(1.0 / sizes, sizes)
    first = np.unique(np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] + [first[-1:]]))
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    params, m, v = (np.zeros(x.shape[1] + 4) for _ in range(3))
    for step in range(1, STEPS + 1):
        w, turns = params[:-4], params[-4:].reshape(2, 2)
        e = z @ w
        forward, backward = messages(e, first, turns)
        p = 1 / (1 + np.exp(-(forward + backward)))
        grad = np.empty_like(params)
        grad[:-4] = z.T @ ((y - p) * share) / n - DECAY * w
        a, b = forward[at - 1], (e + backward)[at]
        joint = np.stack([np.broadcast_to(turns[0, 0], a.shape), turns[0, 1] + b, turns[1, 0] + a, turns[1, 1] + a + b])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        real = np.stack([(1 - y[at - 1]) * (1 - y[at]), (1 - y[at - 1]) * y[at], y[at - 1] * (1 - y[at]), y[at - 1] * y[at]])
        grad[-4:] = ((real - joint) * share[at]).sum(axis=1) / n - DECAY * params[-4:]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(mean.astype(np.float32), scale.astype(np.float32), params[:-4].astype(np.float32), params[-4:].reshape(2, 2))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, bounds in _text.chunks(batch.column(1)):
            lines = line_features(data, bounds)
            x = with_neighbours(lines)
            n = np.diff(lines.first)
            blobs = [x[a:b].tobytes() for a, b in zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(blobs, pa.binary())], ["label", "n", "x"])


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field | None:
    """The field of a bounded sample of labelled documents, chosen by a hash of the id; None where there is none.

    Of several labels of one id the greatest counts; rows with a null id, label or text are left out,
    and of rows that share an id all but the longest. Documents are taken in the order of the hash; one
    is passed over only if its lines don't fit into what is left of MOST_LINES.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(MOST_DOCS)
    texts = docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("_of"), docs[text_col].alias("_text"))
    lines = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    found = texts.join(F.broadcast(chosen), F.col("_of") == F.col("_id")).select("_id", "_label", lines.alias("_n"), "_text")
    sample = written(found.groupBy("_id").agg(F.max(F.struct("_n", "_text", "_label")).alias("s")).select("_id", "s.*"), "labelled")
    left, taken = MOST_LINES, []
    for r in sample.select("_id", "_n").orderBy(F.xxhash64("_id"), "_id").collect():
        if r["_n"] <= left:
            left -= r["_n"]
            taken.append(r["_id"])
    rows = sample.where(F.col("_id").isin(taken)).select(F.col("_label").alias("label"), F.col("_text").alias("text"))
    got = rows.mapInArrow(_feature_rows, "label int, n long, x binary").toPandas()
    removed(sample)
    if got["label"].nunique() < 2:
        return None
    got = got.sort_values(["n", "label", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH)
    return fit(x, np.concatenate([[0], np.cumsum(got["n"])]), got["label"].to_numpy())


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``, 0 to 1; no field: 0.5. Nothing is shuffled.

    Empty and null texts are one empty line of weight one. Repeated rows get equal scores. A column
    of ``docs`` named score is replaced.
    """
    others = [c for c in docs.columns if c != "score"]
    source = docs.select(*(F.col(f"`{c}`") for c in others))
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    k = others.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if field is not None:
                for row, data, bounds in _text.chunks(batch.column(k)):
                    lines = line_features(data, bounds)
                    forward, backward = messages(field.emissions(with_neighbours(lines)), lines.first, field.turns)
                    good = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
                    weight = np.maximum(lines.length, 1).astype(np.float64)
                    out[row : row + len(bounds) - 1] = np.add.reduceat(good * weight, lines.first[:-1]) / np.add.reduceat(weight, lines.first[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(out, 0, 1))], [*others, "score"])

    return source.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score and held_out: labels of ids with crc32(id) mod 5 = 0 are never learned from."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return score(docs, fit_on(docs, labels.where(~held))).withColumn("held_out", held)
