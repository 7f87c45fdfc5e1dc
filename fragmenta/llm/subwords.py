"""Subword ids of many texts at once, exactly as the public byte-level tokenizer gives them.

Byte-level BPE never merges over the borders of its pre-tokens, so equal pre-tokens have equal
ids. The pre-tokens of a whole chunk of texts are found by array operations on code points; ids
come from a direct-mapped cache of fixed size that compares a pre-token's bytes, and what it lacks
is encoded each distinct pre-token of a chunk once: short ones by the tokenizer's merges, all of them
a merge at a time, the others by the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from fragmenta.llm import _text

#: Slots of the cache as a power of two, the bytes of a pre-token and the ids that a slot has room for.
BITS, BYTES, ROOM = 20, 16, 8
SLOTS = 1 << BITS
#: Other pre-tokens are kept by their text, so many at most and none over so many characters.
MOST_LONG, LONG_CHARS = 50_000, 200
#: Pre-tokens of letters that the tokenizer gets in one text.
JOINED = 500

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points that the pattern's \s matches (fixed values: the White_Space property).
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe to be cut off with it (fixed values).
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_kinds: np.ndarray | None = None


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    global _kinds
    if _kinds is None:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            if (k := unicodedata.category(chr(c))[0]) in "LN":
                kinds[c] = LETTER if k == "L" else NUMBER
        kinds[SPACES] = SPACE
        _kinds = kinds
    return _kinds[codes]


def pieces(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid one behind the other; every text of at least one code point begins one."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _kinds_of(codes)
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    space = kinds == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kinds[:-1]
    before[head[:n]] = 255
    blank = np.zeros(n, bool)  # a plain space stands before, in the same text
    blank[1:] = codes[:-1] == 0x20
    blank[head[:n]] = False
    begins = (before != kinds) & ~(blank & ~space)
    # the last of several white-space code points before something else begins a pre-token of its own
    final = np.zeros(n, bool)
    final[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    begins |= final
    marks = np.flatnonzero((codes == 0x27) & (before != OTHER) & ~blank)
    if len(marks):
        texts = np.searchsorted(bounds, marks, "right")
        limit = bounds[texts] - marks  # code points left in the text
        after = np.stack([codes[np.minimum(marks + k, n - 1)] for k in (1, 2)])
        taken = np.zeros(len(marks), np.int64)
        for e in reversed(ENDINGS):  # the first alternative wins
            fits = limit > len(e)
            for k, c in enumerate(e):
                fits &= after[k] == ord(c)
            taken[fits] = len(e) + 1
        at, k = marks[taken > 0], taken[taken > 0]
        begins[at + 1] = False
        nxt = at + k
        inside = nxt < bounds[np.searchsorted(bounds, at, "right")]
        nxt = nxt[inside]
        begins[nxt[(kinds[nxt] == LETTER)]] = True
    return np.flatnonzero(begins)


#: The rank of a pair that doesn't merge.
NEVER = np.int32(0x7FFFFFFF)


class Merges:
    """The merges of a plain byte-level BPE, looked up by pair in open-addressed slots."""

    def __init__(self, model: dict, size: int):
        vocab = model["vocab"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.size = np.uint64(size)
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank = {self._key(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}  # a pair that stands twice has its last rank, as in the library
        keys, ranks = np.array(list(rank), np.uint64), np.array(list(rank.values()), np.int32)
        self.drop = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys, self.ranks = np.zeros(1 << (64 - int(self.drop)), np.uint64), np.full(1 << (64 - int(self.drop)), NEVER)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # of several keys for a free slot the last has it, the others go on to the next
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.ranks[at] = ranks

    def _key(self, a: int, b: int) -> int:
        return a * int(self.size) + b + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _text.PRIME) >> self.drop).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NEVER."""
        keys = a.astype(np.uint64) * self.size + b.astype(np.uint64) + np.uint64(1)
        at = self._slot(keys)
        met = self.keys.take(at)
        other = np.flatnonzero((met != keys) & (met != 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            met = self.keys.take(at[other])
            other = other[(met != keys[other]) & (met != 0)]
        return np.where(self.keys.take(at) == keys, self.ranks.take(at), NEVER)

    def ids(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind the other, ids of each) of pre-tokens of ``size`` bytes, none empty, that lie one behind the other in ``data``.

        In each turn every pre-token makes its merge of least rank, of several equal ones the first, until none has one left.
        """
        counts = size.astype(np.int64)
        symbols, word = self.of_byte.take(data), np.arange(len(size))  # pre-tokens under way: their numbers, and how many symbols each has
        left = counts.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = np.full(len(symbols), NEVER)  # of each symbol with the next one of its pre-token
        ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
        ranks[np.cumsum(left) - 1] = NEVER
        while len(word):
            least = np.minimum.reduceat(ranks, np.cumsum(left) - left)
            on = least != NEVER
            if not on.all():
                keep = np.repeat(on, left)
                done.append((word[~on], symbols[~keep]))
                counts[word[~on]] = left[~on]
                word, left, least, symbols, ranks = word[on], left[on], least[on], symbols[keep], ranks[keep]
                if not len(word):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, left))
            ends = np.cumsum(left)
            hit = hit[np.searchsorted(hit, ends - left)]  # the first of each
            symbols[hit] = self.merged.take(least)
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, ranks = symbols[keep], ranks[keep]
            hit -= np.arange(len(hit))
            left -= 1
            ends = np.cumsum(left)
            inner = np.flatnonzero(hit < ends - 1)
            ranks[hit] = NEVER
            ranks[hit[inner]] = self._ranks(symbols[hit[inner]], symbols[hit[inner] + 1])
            inner = hit[hit > ends - left]
            ranks[inner - 1] = self._ranks(symbols[inner - 1], symbols[inner])
        place = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int64)
        for which, found in done:
            out[_ranges(place[which], counts[which])] = found
        return out, counts


class Encoder:
    """Ids of texts by the tokenizer file at ``path``; one for each worker process, its cache of a fixed size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        found = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in found.values()):
            raise ValueError("only plain added tokens can be split at")
        self.added = {t.content: i for i, t in found.items()}
        self.literals = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.heads, self.tails = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.sizes = np.zeros(SLOTS, np.uint8)  # bytes; 0: an empty slot
        self.counts = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, ROOM), np.uint16 if self.size <= 65536 else np.uint32)
        self.long: dict[str, list[int]] = {}
        model = json.loads(self.tokenizer.to_str())
        special = [model["normalizer"], *(model["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        self.merges = None if any(special) or model["model"]["type"] != "BPE" else Merges(model["model"], self.size)
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)  # a letter stands for a byte

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, whole: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind the other, ids of each) of the pre-tokens from ``start`` to ``end`` of ``size`` bytes.

        Those of letters, with a space before or a line feed put there, are pre-tokens again when they
        stand in a row, so they are encoded by JOINED; the bytes of the ids tell where each ends.
        """
        gap = codes[start] != 0x20
        plain = (_kinds_of(codes[end - 1]) == LETTER) & (~gap | (_kinds_of(codes[start]) == LETTER))
        one = np.flatnonzero(plain)
        parts = [("\n" if g else "") + whole[a:b] for a, b, g in zip(start[one].tolist(), end[one].tolist(), gap[one].tolist(), strict=True)]
        lists = self._ids_of(["".join(parts[k : k + JOINED]) for k in range(0, len(parts), JOINED)])
        flat = np.array([i for g in lists for i in g], np.int64)
        ends, wanted = np.cumsum(self.lengths[flat]), np.cumsum(size[one] + gap[one])
        last = np.searchsorted(ends, wanted)
        if len(one) and (last[-1] >= len(ends) or (ends[last] != wanted).any()):
            raise ValueError("the tokenizer does not split between words")
        first = np.concatenate([[0], last[:-1] + 1]) + gap[one] if len(one) else last
        counts = np.zeros(len(start), np.int64)
        counts[one] = last + 1 - first
        if plain.all():
            keep = np.ones(len(flat), bool)
            keep[first[gap[one]] - 1] = False
            return flat[keep], counts
        others = np.flatnonzero(~plain)
        rest = self._ids_of([whole[a:b] for a, b in zip(start[others].tolist(), end[others].tolist(), strict=True)])
        counts[others] = np.fromiter(map(len, rest), np.int64, len(rest))
        place = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int64)
        out[_ranges(place[one], counts[one])] = flat[_ranges(first, counts[one])]
        out[_ranges(place[others], counts[others])] = np.array([i for g in rest for i in g], np.int64)
        return out, counts

    def _long_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of pre-tokens that no slot has room for."""
        new = list({t for t in texts if t not in self.long})
        found = dict(zip(new, self._ids_of(new), strict=True))
        out = [found[t] if t in found else self.long[t] for t in texts]
        if len(self.long) + len(found) > MOST_LONG:
            self.long.clear()
        self.long.update((t, g) for t, g in list(found.items())[:MOST_LONG] if len(t) <= LONG_CHARS)
        return out

    def encode(self, data: np.ndarray, bounds: np.ndarray, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, texts' id bounds) of a chunk of UTF-8 texts; with ``added`` the literals of added tokens have their ids, as by the library's default."""
        whole = data.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead) != len(codes):  # not UTF-8: as its repaired form
            parts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return self.encode(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), added)
        byte_of = np.append(lead, len(data))
        bounds = np.searchsorted(lead, bounds)
        marks = np.zeros((0, 2), np.int64)
        if added and self.literals.search(whole):
            spans = (m.span() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for m in self.literals.finditer(whole, a, b))
            marks = np.array(list(spans), np.int64).reshape(-1, 2)
        start = pieces(codes, np.sort(np.concatenate([bounds, marks.ravel()])) if len(marks) else bounds)
        if len(marks):  # a literal is one piece
            mark = np.searchsorted(marks[:, 0], start, "left") - 1
            start = start[(mark < 0) | (start >= marks[mark, 1])]
        if not len(start):
            return np.zeros(0, self.ids.dtype), np.zeros(len(bounds), np.int64)
        end = np.append(start[1:], len(codes))
        first = byte_of[start]
        size = byte_of[end] - first
        padded = _text.spare(data)
        head, tail = _text.block(padded, first, size), np.zeros(len(start), np.uint64)
        more = np.flatnonzero(size > 8)
        tail[more] = _text.block(padded, first[more] + 8, size[more] - 8)
        with np.errstate(over="ignore"):
            slot = (_text.mix(_text.mix(head + size.astype(np.uint64)) ^ tail) >> np.uint64(64 - BITS)).astype(np.int64)
        known = (self.heads[slot] == head) & (self.tails[slot] == tail) & (self.sizes[slot] == size) & (size <= BYTES)
        literal = np.isin(start, marks[:, 0]) if len(marks) else np.zeros(len(start), bool)
        known &= ~literal
        counts = np.where(known, self.counts[slot], 0).astype(np.int64)
        rows = self.ids.take(slot, axis=0)
        spill: dict[int, list[int]] = {}
        miss = np.flatnonzero(~known)
        if len(miss):
            fits = (size[miss] <= BYTES) & ~literal[miss]
            short, others = miss[fits], miss[~fits]
            one, which = _distinct(head[short], tail[short], size[short])
            one = short[one]
            if self.merges is None:
                got, sizes = self._fresh(whole, codes, start[one], end[one], size[one])
            else:
                raw = np.stack([head[one], tail[one]], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16)
                got, sizes = self.merges.ids(raw[np.arange(16) < size[one][:, None]], size[one])
            place = np.cumsum(sizes) - sizes
            room = sizes <= ROOM
            table = np.zeros((len(one), ROOM), self.ids.dtype)
            table[np.arange(ROOM) < np.where(room, sizes, 0)[:, None]] = got[_ranges(place[room], sizes[room])]
            keep = np.flatnonzero(room)
            at = slot[one[keep]]
            # of several pre-tokens of one slot the last stays, in all arrays alike
            last = np.unique(at[::-1], return_index=True)
            keep, at = keep[len(at) - 1 - last[1]], last[0]
            self.heads[at], self.tails[at], self.sizes[at] = head[one[keep]], tail[one[keep]], size[one[keep]]
            self.counts[at], self.ids[at] = sizes[keep], table[keep]
            counts[short], rows[short] = sizes[which], table[which]
            if not room.all():
                far = np.flatnonzero(~room[which])
                spill = {i: got[place[w] : place[w] + sizes[w]] for i, w in zip(short[far].tolist(), which[far].tolist(), strict=True)}
            if len(others):
                plain = others[~literal[others]]
                spill.update(zip(plain.tolist(), self._long_ids([whole[a:b] for a, b in zip(start[plain].tolist(), end[plain].tolist(), strict=True)]), strict=True))
                for i in others[literal[others]].tolist():
                    spill[i] = [self.added[whole[start[i] : end[i]]]]
                counts[others] = [len(spill[i]) for i in others.tolist()]
        place = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(place[-1], self.ids.dtype)
        if spill:
            long = np.fromiter(spill, np.int64)
            mask = np.ones(len(counts), bool)
            mask[long] = False
            fill = np.ones(len(out), bool)
            for i in long.tolist():
                fill[place[i] : place[i + 1]] = False
                out[place[i] : place[i + 1]] = spill[i]
            out[fill] = rows[np.arange(ROOM) < np.where(mask, counts, 0)[:, None]]
        else:
            out[:] = rows[np.arange(ROOM) < counts[:, None]]
        return out, place[np.searchsorted(start, bounds)]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of runs of ``n`` from ``start``, one run behind the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _distinct(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct triple, each place's triple)."""
    order = np.lexsort((size, tail, head))
    new = np.ones(len(order), bool)
    new[1:] = (head[order[1:]] != head[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(column: pa.Array, path: str, added: bool = False):
    """(first row, ids, id bounds) of runs of texts."""
    own = encoder(path)
    for row, data, bounds in _text.chunks(column):
        yield row, *own.encode(data, bounds, added)
