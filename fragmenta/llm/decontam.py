"""Documents that hold benchmark passages, found by spaced seeds.

Fixed masks over token positions ignore some of them, so a substituted word spoils only the masks
that look at it. Hashes of masked windows of the benchmark form a table; the windows of every
document are looked up in it, and around each hit the passage and the document are compared token
by token along the hit's diagonal, substitutions allowed.

The benchmark is read in blocks of a bounded number of items, each a pass over the documents,
so what is sent to the executors has a size bound whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm import _text
from fragmenta.llm._shared import ascii_lower, scratch, text_or_empty, written

#: Positions that each mask looks at: eight in a span of 8 to 13 tokens.
MASKS = ("11111111", "110110110011", "1011011010101", "1100111001101")
#: Lighter masks for the passages of fewer than SHORT tokens, of which a few substitutions spoil all windows of eight.
LIGHT, SHORT = ("11111", "110111", "111011", "1101011", "1011011"), 40
#: Fewest matching tokens of an overlap, and their least share of its tokens; passages of fewer tokens must match whole.
LEAST, IDENTITY = 12, 0.75
#: What the tokens are: anything but white space and ASCII signs.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Passages and characters of passages in one block.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 8_000_000

HITS = "item_id long, doc_start long, item_start long, span long, matched long, identity double"


class Seeds:
    """The masked windows of a block of passages, and a filter of one bit of a hash each before the sorted table."""

    def __init__(self, items: pd.DataFrame, masks: tuple[str, ...] = MASKS):
        self.ids = items["item_id"].to_numpy()
        texts = pa.array(items["text"], pa.string())
        parts = [_text.words(d, b, _text.SIGNS) for _, d, b in _text.chunks(texts, 1 << 62)]
        found = parts[0] if parts else _text.words(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.tokens, self.first = found.hash, found.first
        item = found.text_of_word()
        self.masks, self.tables = [], []
        for mask in masks:
            offsets = [i for i, c in enumerate(mask) if c == "1"]
            place, hashes = _text.windows(found, offsets)
            self._add(offsets, place, hashes)
        for mask in LIGHT:
            offsets = [i for i, c in enumerate(mask) if c == "1"]
            place, hashes = _text.windows(found, offsets)
            own = np.diff(self.first)[item[place]] < SHORT
            self._add(offsets, place[own], hashes[own])
        # passages shorter than the longest mask are one window of all their tokens
        sizes = np.diff(self.first)
        for n in sorted({int(x) for x in sizes if 0 < x < max(map(len, masks))}):
            place, hashes = _text.windows(found, range(n))
            own = (sizes[item[place]] == n) if len(place) else np.zeros(0, bool)
            self._add(list(range(n)), place[own], hashes[own])
        self.item = item

    def _add(self, offsets: list[int], place: np.ndarray, hashes: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        near = np.zeros(1 << 20, bool)
        near[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.masks.append(offsets)
        self.tables.append((hashes[order], place[order], near))

    def hits(self, found: _text.Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item and diagonal) of all equal windows: the documents' and the passages' places."""
        docs, items = [], []
        for offsets, (hashes, place, near) in zip(self.masks, self.tables, strict=True):
            at, h = _text.windows(found, offsets)
            keep = near[(h >> np.uint64(44)).astype(np.int64)]
            at, h = at[keep], h[keep]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = high - low
            docs.append(np.repeat(at, n))
            items.append(place[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        return np.concatenate(docs), np.concatenate(items)

    def overlaps(self, found: _text.Words, least: int, identity: float) -> list[tuple]:
        """(text, item, document place, passage place, span, matched) of the best verified overlap of each text and passage."""
        at, place = self.hits(found)
        if not len(at):
            return []
        text = found.text_of_word()[at]
        item = self.item[place]
        seen = np.unique(np.stack([text, item, at - place]), axis=1)
        best: dict[tuple[int, int], tuple] = {}
        for t, i, shift in seen.T.tolist():
            low, high = int(self.first[i]), int(self.first[i + 1])
            a = max(low, int(found.first[t]) - shift)
            b = min(high, int(found.first[t + 1]) - shift)
            same = self.tokens[a:b] == found.hash[a + shift : b + shift]
            got = _segment(same, identity)
            if got and got[2] < min(least, high - low):
                got = _longest(same, identity)
                whole = b - a == high - low >= least and same.sum() >= identity * len(same)
                got = (0, len(same), int(same.sum())) if whole and got[2] < least else got
                if got[2] < least and not whole:
                    continue
            if got:
                x = (got[2], -(a + got[0] + shift), -(a + got[0]), got[1] - got[0])
                if x > best.get((t, i), (0,)):
                    best[t, i] = x
        return [(t, i, -x[1] - int(found.first[t]), -x[2] - int(self.first[i]), x[3], x[0]) for (t, i), x in best.items()]


def _segment(same: np.ndarray, identity: float) -> tuple[int, int, int] | None:
    """The run of positions with most matches above mismatches at the given rate: (from, to, matches)."""
    gain = np.where(same, 1 - identity, -identity)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    if total[end] - low[end] <= 0:
        return None
    begin = int(np.flatnonzero(total[: end + 1] == low[end])[0])
    return begin, end, int(same[begin:end].sum())


def _longest(same: np.ndarray, identity: float) -> tuple[int, int, int]:
    """The run with most matches among those whose share of matches is at least ``identity``; then the shortest: (from, to, matches)."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - identity, -identity))])
    matched = np.concatenate([[0], np.cumsum(same)])
    # only prefix minima can begin it: an earlier place with no greater total has no fewer matches behind it
    begins = np.flatnonzero(total < np.concatenate([[np.inf], np.minimum.accumulate(total)[:-1]]))
    ends = np.arange(len(total))
    first = begins[np.searchsorted(-total[begins], -total - 1e-9)[:, None].clip(max=len(begins) - 1)][:, 0]
    n = np.where(first < ends, matched[ends] - matched[first], 0)
    end = int(np.argmax(n))
    begin = int(first[end])
    if n[end]:
        begin += int(np.argmax(same[begin:end]))  # mismatches at the border add nothing
    return begin, end, int(n[end])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """One row for each document and passage that overlap: id_col and HITS.

    Tokens are runs of letters, digits and bytes above 127, A-Z as a-z. An overlap is a run on one
    diagonal with at least ``least`` equal tokens whose matches outweigh mismatches at the rate
    ``identity`` or balance them; a passage that stands in its whole span overlaps at that rate even
    where that is fewer equal tokens; one of fewer than ``least`` tokens must stand unchanged. Empty and null texts and passages
    overlap with nothing. Repeated documents are each reported.
    item_id null is allowed; passages of equal tokens are one, under the smallest id of theirs; the place is of the best overlap: most matches, then earliest. Seeds find
    all runs of eight equal tokens, of five in passages of fewer than SHORT, and most of the others.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = None
            for batch in batches:
                seeds = seeds or Seeds(sent.value)
                rows: list[tuple] = []
                for first, data, bounds in _text.chunks(batch.column(1)):
                    found = _text.words(data, bounds, _text.SIGNS)
                    rows += [(first + t, *x) for t, *x in seeds.overlaps(found, least, identity)]
                of = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 6)]
                items = pa.array([None if pd.isna(v := seeds.ids[r[1]]) else int(v) for r in rows], pa.int64())
                share = pa.array([r[5] / r[4] for r in rows], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), items, *columns, share], ["id", "item_id", "doc_start", "item_start", "span", "matched", "identity"])

        found = source.mapInArrow(run, f"id {kind}, {HITS}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = source.sparkSession.createDataFrame([], f"id {kind}, {HITS}")
    return out.withColumnRenamed("id", id_col)


def _blocks(benchmark: DataFrame) -> Iterator[pd.DataFrame]:
    """The passages' tokens, equal ones once, in blocks of BLOCK_ITEMS items and BLOCK_CHARS characters (or one longer passage)."""
    rows: list[tuple] = []
    size = 0
    tokens = F.array_join(F.regexp_extract_all(ascii_lower(text_or_empty("text")), F.lit(TOKEN), F.lit(0)), " ")
    distinct = benchmark.select("item_id", tokens.alias("text")).where("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))
    for row in distinct.toLocalIterator():
        n = len(row.text)
        if rows and (len(rows) == BLOCK_ITEMS or size + n > BLOCK_CHARS):
            yield pd.DataFrame(rows, columns=["item_id", "text"])
            rows, size = [], 0
        rows.append((row.item_id, row.text))
        size += n
    if rows:
        yield pd.DataFrame(rows, columns=["item_id", "text"])


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no passage; a null id is never dropped."""
    with scratch() as made:
        hit = made.keep(written(find_overlaps(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_hit")).where("_hit IS NOT NULL").distinct(), "overlaps"))
    return docs.join(hit, docs[id_col] == hit["_hit"], "left_anti")
