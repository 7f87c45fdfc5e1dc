"""A small causal self-attention model of subword ids, in numpy.

The attended past gives the class of the next id; the id within its class comes from counts of
all training documents, of the pair with the id before and of the id alone. So the softmax is over
CLASSES, not the vocabulary. Classes, class pairs and the counts all come from the corpus; only the
attention's weights are learned by descent. The model carries the counts of frequent pairs; those
of the others are looked up elsewhere and come in by ``later``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from fragmenta.llm import _text

#: Width, width of the hidden layer, classes, window and the part of it that is context only; frequent ids with an embedding of their own.
DIM, HIDDEN, CLASSES, WINDOW, CONTEXT, OWN_IDS = 16, 16, 32, 32, 4, 4096
#: Frequent pairs of ids that the model carries at most, and slots of their table as a power of two.
MOST_PAIRS, SLOT_BITS = 1 << 17, 20
#: Weight of an id's share of its class against the counts behind the id before.
PRIOR = 20.0
#: Greatest logit, of attention and of classes.
STEEPEST = 50.0
#: Windows that are worked on at once when scoring and in a step of the descent.
AT_ONCE, BATCH = 128, 64


class Model(NamedTuple):
    classes: np.ndarray  # of each id
    inside: np.ndarray  # each id's share of its class
    keys: np.ndarray  # pairs by slot: before * ids + id + 1, or 0
    times: np.ndarray  # their counts
    more_keys: np.ndarray  # pairs whose slot a more frequent one has, in order
    more_times: np.ndarray
    after: np.ndarray  # (ids, CLASSES): counts of all pairs by the id before and the class after
    own: np.ndarray  # each id's row of ``embed``
    embed: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    near: np.ndarray  # bias of attention by distance
    up: np.ndarray  # the hidden layer
    down: np.ndarray
    heads: np.ndarray  # classes' output weights
    pairs: np.ndarray  # bias of a class after a class

    @property
    def end(self) -> int:
        """The id that stands before and after a text."""
        return len(self.classes) - 1


TRAINED = ("embed", "query", "key", "value", "out", "near", "up", "down", "heads", "pairs")


#: Neighbours told apart where ids are grouped: the most frequent ones; columns of an id's neighbours on both sides, and numbers of the place drawn from these.
NEIGHBOURS, PLACE = 128, 48
COLUMNS = 2 * NEIGHBOURS + 2


def neighbour_columns(counts: np.ndarray) -> np.ndarray:
    """Each id's column among neighbours; all ids but the most frequent share one."""
    order = np.argsort(-counts, kind="stable")[:NEIGHBOURS]
    column = np.full(len(counts), NEIGHBOURS)
    column[order] = np.arange(len(order))
    return column


def neighbour_cells(before: np.ndarray, ids: np.ndarray, column: np.ndarray) -> np.ndarray:
    """What pairs count for: id * COLUMNS + column, of the later id and then of the earlier."""
    return np.concatenate([ids * COLUMNS + column[before], before * COLUMNS + NEIGHBOURS + 1 + column[ids]])


def neighbour_places(features: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(place, neighbours in all) of ids by their neighbours' counts."""
    seen = features.sum(axis=1)
    z = np.sqrt(features / np.maximum(seen, 1)[:, None]).astype(np.float32)
    return z @ np.random.default_rng(seed).normal(size=(COLUMNS, PLACE)).astype(np.float32) / 7, seen


def group_ids(z: np.ndarray, seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes of ids that stand between alike neighbours: k-means over ``neighbour_places``.

    Ids without pairs go to the largest class. The last id (a text's end) has the last class alone.
    """
    usual = np.flatnonzero(seen >= 20)
    weight = np.sqrt(seen[usual])
    k = min(CLASSES - 1, max(1, len(usual)))
    out = np.zeros(len(counts), np.int64)
    if len(usual):
        centres = z[usual[np.argsort(-seen[usual], kind="stable")[:k]]].copy()
        for _ in range(15):
            near = ((z[usual] ** 2).sum(1)[:, None] - 2 * z[usual] @ centres.T + (centres**2).sum(1)).argmin(axis=1)
            for c in range(k):
                if (mine := near == c).any():
                    centres[c] = (z[usual[mine]] * weight[mine, None]).sum(0) / weight[mine].sum()
        for a in range(0, len(counts), 4096):
            out[a : a + 4096] = ((centres**2).sum(1) - 2 * z[a : a + 4096] @ centres.T).argmin(axis=1)
        out[seen == 0] = np.bincount(out[seen > 0], minlength=k).argmax()
    out[-1] = CLASSES - 1
    return out


def slot_of(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * _text.PRIME) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def begin(counts: np.ndarray, pair_keys: np.ndarray, pair_times: np.ndarray, classes: np.ndarray | None = None, after: np.ndarray | None = None, seed: int = 10) -> Model:
    """A model before its descent. ``counts``: of all ids in all training documents, texts' ends as the last;
    ``pair_keys`` (before * ids + id) and ``pair_times``: the frequent pairs, a text's end before and after it;
    ``classes`` of ids and counts of classes ``after`` ids: of all pairs, or else made of the given ones."""
    rng = np.random.default_rng(seed)
    n = len(counts)
    order = np.lexsort((pair_keys, pair_times))  # of two in a slot the more frequent stays
    keys, times = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.float32)
    at = slot_of(pair_keys[order].astype(np.uint64) + np.uint64(1))
    last = np.unique(at[::-1], return_index=True)
    order = order[len(at) - 1 - last[1]]
    keys[last[0]], times[last[0]] = pair_keys[order].astype(np.uint64) + np.uint64(1), pair_times[order]
    more = np.setdiff1d(np.arange(len(pair_keys)), order, assume_unique=True)
    more = more[np.argsort(pair_keys[more])]
    before, ids = (pair_keys // n).astype(np.int64), (pair_keys % n).astype(np.int64)
    if classes is None:
        cells = neighbour_cells(before, ids, neighbour_columns(counts))
        classes = group_ids(*neighbour_places(np.bincount(cells, np.tile(pair_times, 2), n * COLUMNS).reshape(n, COLUMNS)), counts)
    if after is None:
        after = np.bincount(before * CLASSES + classes[ids], weights=pair_times, minlength=n * CLASSES).reshape(n, CLASSES)
    totals = np.bincount(classes, weights=counts + 0.5, minlength=CLASSES)
    inside = ((counts + 0.5) / totals[classes]).astype(np.float32)
    own = np.full(n, OWN_IDS, np.int64)
    own[np.argsort(-counts, kind="stable")[:OWN_IDS]] = np.arange(min(OWN_IDS, n))
    pairs = np.full((CLASSES, CLASSES), 0.1)
    np.add.at(pairs, classes, after.astype(np.float64))
    pairs += 5 * pairs.sum(axis=0) / pairs.sum()
    pairs[:, np.bincount(classes, minlength=CLASSES) == 0] = 0  # a class without ids is never predicted
    draw = lambda *shape: rng.normal(scale=0.1, size=shape).astype(np.float32)
    return Model(
        classes, inside, keys, times, pair_keys[more].astype(np.uint64) + np.uint64(1), pair_times[more].astype(np.float32), after.astype(np.float32), own, draw(OWN_IDS + 1 + CLASSES, DIM), draw(DIM, DIM), draw(DIM, DIM), draw(DIM, DIM), draw(DIM, DIM), -0.05 * np.arange(WINDOW, dtype=np.float32),
        draw(DIM, HIDDEN), draw(HIDDEN, DIM), draw(DIM, CLASSES), np.log(np.maximum(pairs / pairs.sum(axis=1, keepdims=True), 1e-30)).astype(np.float32),
    )


#: How far each place of a window lies behind each other one, 0 for later ones, and which are not later.
_BACK = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0)
_PAST = np.tri(WINDOW, dtype=bool)


def _decay(m: Model) -> np.ndarray:
    """What attention is multiplied by: a bias by distance, and nothing of what comes later."""
    return np.where(_PAST, np.exp(m.near)[_BACK], 0).astype(m.near.dtype)


def _folded(m: Model) -> np.ndarray:
    """Query with key, and value with out: what a row is multiplied by for what it asks the rows of its window, and for what it gives them."""
    return np.concatenate([m.query @ m.key.T * m.query.dtype.type(DIM**-0.5), m.value @ m.out], axis=1)


def _grown(logits: np.ndarray) -> np.ndarray:
    """exp of logits, at most of STEEPEST, in their place; the bound costs a pass over memory only where some logit is beyond it."""
    if logits.max(initial=0) > STEEPEST:
        np.minimum(logits, STEEPEST, out=logits)
    return np.exp(logits, out=logits)


def _attention(x: np.ndarray, asks: np.ndarray, decay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What windows of embeddings attend to, and what that sums to in each row."""
    a = _grown(asks @ x.transpose(0, 2, 1))
    a *= decay
    return a, a.reshape(-1, WINDOW) @ np.ones(WINDOW, x.dtype)


def _lean(m: Model, entries: np.ndarray, decay: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What attention makes of windows of entries, before the output weights, at the given of their last places, as many as ``decay`` has rows."""
    skip = WINDOW - len(decay)
    x, asks, gives = (entries[:, :, k * DIM : (k + 1) * DIM] for k in range(3))
    a, total = _attention(x, asks[:, skip:], decay)
    h = (a @ gives).reshape(-1, DIM).take(rows, axis=0)
    h /= total.take(rows)[:, None]
    h += x[:, skip:].reshape(-1, DIM).take(rows, axis=0)
    g = h @ m.up
    np.maximum(g, 0, out=g)
    h += g @ m.down
    return h


def _within(m: Model, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's probability within its class, behind the id before it, and the places of pairs that the model doesn't carry, as if their count were 0."""
    key = before.astype(np.uint64) * np.uint64(len(m.classes)) + ids.astype(np.uint64) + np.uint64(1)
    slot = slot_of(key)
    c = m.times.take(slot)
    rare = np.flatnonzero(m.keys.take(slot) != key)
    c[rare] = 0
    if len(m.more_keys):
        at = np.minimum(np.searchsorted(m.more_keys, key[rare]), len(m.more_keys) - 1)
        hit = m.more_keys[at] == key[rare]
        c[rare[hit]] = m.more_times[at[hit]]
        rare = rare[~hit]
    return (c + np.float32(PRIOR) * m.inside[ids]) / (m.after.reshape(-1).take(before * CLASSES + m.classes[ids]) + np.float32(PRIOR)), rare


def later(inside: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the counts of pairs that the model doesn't carry add to log10 probabilities; ``inside``: the ids' shares of their classes."""
    return np.log10(1 + counts / (PRIOR * inside.astype(np.float64)))


def places(bounds: np.ndarray, number: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scored) of the windows of the given numbers, of texts of the given target bounds.

    ``starts``: windows before each text, and all. Every target is scored in one window.
    """
    text = np.searchsorted(starts, number, "right") - 1
    number = number - starts[text]
    place = (number * (WINDOW - CONTEXT))[:, None] + np.arange(WINDOW)
    size = (bounds[text + 1] - bounds[text])[:, None]
    scored = (place < size) & ((number == 0)[:, None] | (np.arange(WINDOW) >= CONTEXT))
    return np.minimum(place, size - 1) + bounds[text][:, None], scored


def window_starts(bounds: np.ndarray) -> np.ndarray:
    """Windows before each text of the given target bounds, and all."""
    n = np.maximum(1, 1 + -(-(np.diff(bounds) - WINDOW) // (WINDOW - CONTEXT)))
    return np.concatenate([[0], np.cumsum(n)])


def window_spans(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, scored from, scored to) of all windows; the latter two within the window. A text's first window is scored from its first place on."""
    starts = window_starts(bounds)
    n = np.diff(starts)
    number = np.arange(starts[-1]) - np.repeat(starts[:-1], n)
    begin = np.repeat(bounds[:-1], n) + number * (WINDOW - CONTEXT)
    return begin, np.where(number == 0, 0, CONTEXT), np.minimum(np.repeat(bounds[1:], n) - begin, WINDOW)


def windowed(values: np.ndarray) -> np.ndarray:
    """The WINDOW values from each place on. Behind a text stand the next one's and in the end zeros, where ``places`` repeats its last: later places count for nothing."""
    return np.lib.stride_tricks.sliding_window_view(np.append(values, np.zeros(WINDOW, values.dtype)), WINDOW)


def stream(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, target bounds): each text's ids behind an end, and before one."""
    inputs = np.insert(ids, bounds[:-1], end)
    targets = np.insert(ids, bounds[1:], end)
    return inputs, targets, bounds + np.arange(len(bounds))


def embeddings(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(each id's number, rows by number): an id's embedding, what it asks and what it gives; a class' ids without an embedding of their own have one number."""
    number = np.where(m.own < OWN_IDS, m.own, OWN_IDS + m.classes)
    x = np.zeros((OWN_IDS + CLASSES, DIM), m.embed.dtype)
    x[number] = m.embed[m.own] + m.embed[OWN_IDS + 1 + m.classes]
    return number, np.concatenate([x, x @ _folded(m)], axis=1)


def score_targets(m: Model, inputs: np.ndarray, targets: np.ndarray, bounds: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None = None, rare: list[np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of every target of a stream of texts; ``table``: what ``embeddings`` gives; ``rare`` gets the places that ``later`` is due."""
    out = np.zeros(len(targets))
    number, rows_of = embeddings(m) if table is None else table
    decay, ones = _decay(m), np.ones(CLASSES, rows_of.dtype)
    kinds, aims, entries = m.classes.take(inputs), m.classes.take(targets), windowed(number.take(inputs))
    begin, since, until = window_spans(bounds)
    for skip in (0, CONTEXT):
        chosen = np.flatnonzero(since == skip)
        for a in range(0, len(chosen), AT_ONCE):
            mine = chosen[a : a + AT_ONCE]
            first = begin.take(mine)
            rows = np.flatnonzero(np.arange(skip, WINDOW) < until.take(mine)[:, None])
            where = (first[:, None] + np.arange(skip, WINDOW)).reshape(-1).take(rows)
            logits = _lean(m, rows_of.take(entries[first], axis=0), decay[skip:], rows) @ m.heads
            logits += m.pairs.take(kinds.take(where), axis=0)
            one = np.minimum(logits.reshape(-1).take(np.arange(0, logits.size, CLASSES) + aims.take(where)), STEEPEST).astype(np.float64)
            out[where] = one - np.log(_grown(logits) @ ones)
    within, unknown = _within(m, inputs, targets)
    if rare is not None:
        rare.append(unknown)
    out += np.log(within)
    out /= np.log(10)
    return out


def gradients(m: Model, before: np.ndarray, aim: np.ndarray, weight: np.ndarray, into: dict | None = None) -> tuple[dict, float | None]:
    """Gradients of the loss over windows of ids whose targets' classes are ``aim``, and the loss; with arrays ``into`` which they go, no loss.

    Query and key, and value and out, are multiplied first; rows whose weight is 0 are left out behind the attention.
    """
    out = {k: np.empty_like(getattr(m, k)) for k in TRAINED} if into is None else into
    kind, n = m.embed.dtype.type, before.size
    own, kinds = m.own.take(before).reshape(-1), m.classes.take(before).reshape(-1)
    x = m.embed.take(own, axis=0)
    x += m.embed[OWN_IDS + 1 :].take(kinds, axis=0)
    deep = lambda t: t.reshape(-1, WINDOW, t.shape[1])
    folded = _folded(m)
    both = deep(x @ folded)
    asks, gives = both[:, :, :DIM], both[:, :, DIM:]
    a, total = _attention(deep(x), asks, _decay(m))
    rows = np.flatnonzero(weight.reshape(-1) != 0)
    weight, behind, k = weight.reshape(-1).take(rows), kinds.take(rows), len(rows)
    back = np.full(n, k)  # each place's row, or one of zeros
    back[rows] = np.arange(k)
    total = total.take(rows)[:, None]
    mixed = (a @ gives).reshape(-1, DIM).take(rows, axis=0)
    mixed /= total
    h = x.take(rows, axis=0)
    h += mixed
    g = h @ m.up
    np.maximum(g, 0, out=g)
    top = g @ m.down
    top += h
    p = top @ m.heads
    p += m.pairs.take(behind, axis=0)
    _grown(p)
    size = p @ np.ones(CLASSES, kind)
    hit = np.arange(0, k * CLASSES, CLASSES) + aim.reshape(-1).take(rows)
    loss = -float((np.log(p.reshape(-1).take(hit) / size + 1e-30) * weight).sum()) if into is None else None
    p *= (weight / size)[:, None]
    p.reshape(-1)[hit] -= weight
    left = np.zeros((CLASSES + DIM, k), kind)  # the classes behind which a target stands, and the rows before the output weights
    left.reshape(-1)[behind * k + np.arange(k)] = 1
    left[CLASSES:] = top.T
    found = left @ p
    out["pairs"][:], out["heads"][:] = found[:CLASSES], found[CLASSES:]
    padded = np.zeros((k + 1, DIM), kind)
    dh = np.matmul(p, m.heads.T, out=padded[:k])
    np.matmul(g.T, dh, out=out["down"])
    dg = dh @ m.down.T
    dg *= g > 0
    np.matmul(h.T, dg, out=out["up"])
    dh += dg @ m.up.T
    dx = padded.take(back, axis=0)
    dh /= total
    share = padded.take(back, axis=0)
    mixed *= dh
    ds = deep(share) @ gives.transpose(0, 2, 1)
    ds -= deep(np.append(mixed @ np.ones(DIM, kind), kind(0)).take(back)[:, None])
    ds *= a
    out["near"][:] = np.bincount(_BACK.reshape(-1), np.ones(len(a), kind) @ ds.reshape(len(a), -1), WINDOW)
    dboth = np.empty_like(both)
    np.matmul(ds, deep(x), out=dboth[:, :, :DIM])
    np.matmul(a.transpose(0, 2, 1), deep(share), out=dboth[:, :, DIM:])
    dboth = dboth.reshape(n, -1)
    found = (dboth.T @ x).T
    dasks, dgives = found[:, :DIM] * kind(DIM**-0.5), found[:, DIM:]
    out["query"][:], out["key"][:], out["value"][:], out["out"][:] = dasks @ m.key, dasks.T @ m.query, dgives @ m.out.T, m.value.T @ dgives
    dx += (ds.transpose(0, 2, 1) @ asks).reshape(-1, DIM)
    dx += dboth @ folded.T
    out["embed"].fill(0)
    two = np.result_type(kind, np.complex64)  # two values at once
    for r in (own, OWN_IDS + 1 + kinds):
        np.add.at(out["embed"].reshape(-1).view(two), _CELLS.take(r, axis=0).reshape(-1), dx.reshape(-1).view(two))
    return out, loss


#: Where each row's pairs of values lie in ``embed``.
_CELLS = np.arange((OWN_IDS + 1 + CLASSES) * DIM // 2).reshape(-1, DIM // 2)


class Descent:
    """Adam over batches of windows that come one after the other, from a model's weights; those stay as they are."""

    def __init__(self, m: Model, rate: float):
        self.weights = np.concatenate([getattr(m, k).reshape(-1) for k in TRAINED])
        self.model, self.rate, self.step = m._replace(**_parts(m, self.weights)), rate, 0
        self.first, self.second, self.moves = (np.zeros_like(self.weights) for _ in range(3))
        self.found = _parts(m, self.moves)

    def learn(self, before: np.ndarray, aim: np.ndarray, scored: np.ndarray) -> None:
        gradients(self.model, before, aim, np.multiply(scored, np.float32(1 / max(1, np.count_nonzero(scored)))), self.found)
        self.step += 1
        rate = self.rate * min(1, self.step / 20)
        # both means stand here over 0.1 and 0.01; what makes up for their beginnings at 0 is in the step's size
        g = self.moves
        self.first *= 0.9
        self.first += g
        self.second *= 0.99
        g *= g
        self.second += g
        root = (0.01 / (1 - 0.99**self.step)) ** 0.5
        np.sqrt(self.second, out=g)
        g += 1e-8 / root
        np.divide(self.first, g, out=g)
        g *= rate * 0.1 / (1 - 0.9**self.step) / root
        self.weights -= g


def chosen_windows(bounds: np.ndarray, pick: np.ndarray, one_of: int) -> np.ndarray:
    """Windows of every text: each ``one_of``-th from ``pick`` on, or a single one of a text of fewer windows; texts' windows are numbered on."""
    starts = window_starts(bounds)
    n = np.diff(starts)
    first = pick % np.minimum(n, one_of)
    k = -(-(n - first) // one_of)
    return np.repeat(starts[:-1] + first, k) + one_of * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))


def windows_at(bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scored) of the windows of the given numbers."""
    return places(bounds, numbers, window_starts(bounds))


def weights_of(m: Model) -> np.ndarray:
    """All trained weights in a row."""
    return np.concatenate([getattr(m, k).reshape(-1) for k in TRAINED]).astype(np.float64)


def with_weights(m: Model, flat: np.ndarray) -> Model:
    """``m`` with the weights that ``weights_of`` gives in a row."""
    return m._replace(**_parts(m, flat.astype(np.float32)))


def _parts(m: Model, flat: np.ndarray) -> dict[str, np.ndarray]:
    """The trained arrays by name as parts of ``flat``, in which they lie in a row."""
    parts: dict[str, np.ndarray] = {}
    at = 0
    for k in TRAINED:
        old = getattr(m, k)
        parts[k] = flat[at : at + old.size].reshape(old.shape)
        at += old.size
    return parts
