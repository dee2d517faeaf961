"""Operator 8, LM scoring: a causal self-attention model over subword ids, trained in numpy.

A text (A-Z in lower case, words joined by single spaces) becomes ids of a public byte-level vocabulary. Masked
attention looks over a window; with what the last id says by itself it gives a hidden vector, from which one softmax gives the next
id's class and another the id within its class. Windows of two blocks overlap by one: each id is scored once, in the second block
of its window (or in the first of its text), with a block of context before its own. There are no n-gram tables: the score is the
network's.

The public vocabulary knows none of the corpus's own frequent words, so pairs of ids within words that occur most are merged into ids of
their own, as a byte-pair vocabulary does: the same text in fewer ids. Spellings and counts are those of the frequent words of all
training texts.

The output biases begin with the counts of ids in all training texts, and the classes come from the ids' neighbours in all of them.
The network is then fitted twice: a start on a sample of bounded size, and a pass of local steps over all windows of all training
texts, in groups of bounded size whose changes are averaged.

Beside it stands the base score of a unigram model over words, whose counts cover all training texts: words by frequency in a
table of bounded size, and the rest by a join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, NOT_SPACE, crc_mod, cut, hash_runs, mix, need, read, runs, text_pieces, written

BLOCK, WIDTH, CLASSES, SINGLE = 16, 32, 64, 24
#: A class of more ids is cut into several, by frequency.
MOST = 96
#: Of the windows of all training texts one of so many is learned from (1: all), about so many at a time from one model.
SHARE, TASK_WINDOWS = 1, 200_000
#: Frequent words whose counts are sent to all tasks.
HEAD_WORDS = 200_000
#: Words whose ids a task keeps, at most.
CACHE = 600_000
PAD = 65535
#: Pairs of ids that become ids of their own, at most, and in how many rounds. Every task of the learning sends all arrays of the model, so more
#: ids cost disk where tasks are many.
MERGES, ROUNDS = 500, 5


class Vocabulary:
    """A rank file's pieces; `end` is the id after them, `pad` the one after that, and then come the ids of merged pairs. merges: a
    sorted table of pairs for each round, as first << 16 | second, whose ids follow each other."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = public_tokenizers.PATTERN
        self.end = max(self.ranks.values()) + 1
        self.pad = self.end + 1
        self.merges: list[np.ndarray] = []

    def merge(self, words: list[str], counts: np.ndarray, most: int = MERGES, rounds: int = ROUNDS) -> None:
        """Learn merges from words and how often they occur: in each round the pairs within words that occur most, twice or more. A text's ids
        become fewer; with too few words nothing is merged."""
        encode, words, counts = self.encoder(), words if len(words) else [], np.asarray(counts, np.float64)
        ids = [encode(" " + w) for w in words]
        flat, word = np.array([i for x in ids for i in x], np.int64), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        most = min(most, PAD - self.pad - 1)
        for _ in range(rounds):
            inside = np.flatnonzero(word[1:] == word[:-1])
            pairs, of = np.unique(flat[inside] << 16 | flat[inside + 1], return_inverse=True)
            n = np.bincount(of, counts[word[inside]], len(pairs))
            top = np.argsort(-n, kind="stable")[: most // rounds]
            table = np.sort(pairs[top[n[top] >= 2]])
            if not len(table):
                break
            flat, word = merged_once(flat, word, table, self.pad + 1 + self.n_merges)
            self.merges.append(table)

    @property
    def n_merges(self) -> int:
        return sum(map(len, self.merges))

    def merged(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and the word of each, after all merges."""
        new = self.pad + 1
        for table in self.merges:
            flat, word = merged_once(flat, word, table, new)
            new += len(table)
        return flat, word

    def encoder(self):
        import tiktoken

        return tiktoken.Encoding("roadloom", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary


def merged_once(flat: np.ndarray, word: np.ndarray, table: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, and the word of each, with the pairs of the table merged; of pairs that overlap the first, third and so on."""
    if len(flat) < 2:
        return flat, word
    pairs = flat[:-1] << 16 | flat[1:]
    at = np.minimum(np.searchsorted(table, pairs), len(table) - 1)
    hit = (table[at] == pairs) & (word[1:] == word[:-1])
    place = np.arange(len(hit))
    hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1
    out, stays = flat.copy(), np.ones(len(flat), bool)
    out[:-1][hit] = new + at[hit]
    stays[1:][hit] = False
    return out[stays], word[stays]


_ENCODERS: dict[int, object] = {}


def _encoder(number: int, vocabulary: Vocabulary):
    if number not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[number] = WordIds(vocabulary)
    return _ENCODERS[number]


def normal(text: str | None) -> str:
    """Words in lower case (A-Z only) with single spaces."""
    return b" ".join((text or "").encode().lower().split()).decode()


class WordIds:
    """The ids of words by the hash of the word with its place (first in a text or not), kept from one batch to the next: no match
    of the vocabulary's pattern crosses a space into the next word, so a text's ids are those of its words."""

    def __init__(self, vocabulary: Vocabulary):
        self.encode, self.merged, self.known = vocabulary.encoder(), vocabulary.merged, {}
        self.opens = np.zeros(vocabulary.end + 1, bool)  # pieces that begin with a space begin a word
        for piece, rank in vocabulary.ranks.items():
            self.opens[rank] = piece[:1] == b" "

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words, and how many each word has. h: hashes of the words; first: which are the first of their text."""
        keys, at, of = np.unique(h + first.astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known.clear()
        keys = keys.tolist()
        found = list(map(self.known.get, keys))
        new = [k for k, ids in enumerate(found) if ids is None]
        lower = LOWER[data].tobytes() if new else b""
        words = [lower[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
        opens = first[at[new]].tolist()
        later = [k for k, one in zip(new, opens, strict=True) if not one]
        if later:  # all in one text: much quicker than one by one
            flat = np.array(self.encode((b" " + b" ".join([w for w, one in zip(words, opens, strict=True) if not one])).decode()), np.int64)
            flat, of_word = self.merged(flat, np.cumsum(self.opens[flat]))
            flat, cuts = flat.astype("<u2").tobytes(), [0, *(2 * (np.flatnonzero(np.diff(of_word)) + 1)).tolist(), 2 * len(flat)]
            for k, a, b in zip(later, cuts[:-1], cuts[1:], strict=True):
                found[k] = self.known[keys[k]] = flat[a:b]
        for k, w, one in zip(new, words, opens, strict=True):
            if one:
                flat = np.array(self.encode(w.decode()), np.int64)
                found[k] = self.known[keys[k]] = self.merged(flat, np.zeros(len(flat), np.int64))[0].astype("<u2").tobytes()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat = np.frombuffer(b"".join(found), "<u2")
        begin = np.cumsum(size) - size
        n = size[of]
        total = int(n.sum())
        return flat[np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(total)], n


#: What steps change: arrays by input id, places, and the two softmaxes.
BY_ID, DENSE = ("query", "key", "value", "own"), ("query_place", "key_place", "class_out", "class_bias", "within", "within_bias")


class Model:
    """Arrays by input id (query, key, value, own: WIDTH each; key_bias), and by place in class order (within, within_bias).
    compact: number of each id, those without a count together; the last number is the padding's."""

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    def log10(self, sequences: list[np.ndarray], end: int) -> np.ndarray:
        """log10 probability of each sequence of ids, its end included. A sequence alone goes through in pieces."""
        if len(sequences) == 1:
            return np.array([sum(self._blocks(w, t).sum() for w, t in windows(sequences[0], end))])
        parts = [next(windows(s, end, None)) for s in sequences]
        if not parts:
            return np.zeros(0)
        text = np.repeat(np.arange(len(sequences)), [len(w) for w, _ in parts])
        return np.bincount(text, self._blocks(*(np.concatenate(x) for x in zip(*parts, strict=True))), len(sequences))

    def _blocks(self, w: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(w))
        for at in range(0, len(w), 2048):
            x, goal = self.compact[w[at : at + 2048]], t[at : at + 2048]
            own = np.flatnonzero(goal.reshape(-1) >= 0)
            goals = self.compact[goal.reshape(-1)[own]]
            # attention in parts that stay in the cache, the softmaxes in larger ones
            h = np.concatenate([forward(self, x[k : k + 128])[-1] for k in range(0, len(x), 128)])[own]
            p = np.zeros(goal.size)
            # an id without a count has its share of what all of them have together
            p[own] = self.log_p(h, goals) - np.where(goals == self.other, self.log_others, 0)
            out[at : at + 2048] = p.reshape(goal.shape).sum(axis=1) / np.log(10)
        return out

    def log_p(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target's probability from its hidden vector."""
        return _outputs(self, h, t, False)[0]


def windows(s: np.ndarray, end: int, most: int | None = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of two blocks of a text, and the targets of the second block: -1 where the text has ended. At most `most` at once."""
    n = len(s) + 1
    blocks = -(-n // BLOCK)
    step = most or blocks
    for first in range(0, blocks, step):
        stop = min(blocks, first + step)
        a, b = (first - 1) * BLOCK, stop * BLOCK  # inputs with a block before
        line, goal = np.full(b - a, PAD, np.int64), np.full(b - a - BLOCK, -1, np.int64)
        lo = max(a, 1)
        line[lo - a : min(b, n) - a] = s[lo - 1 : min(b, n) - 1]
        if a <= 0:
            line[-a] = end
        own = s[a + BLOCK : min(b, n - 1)]
        goal[: len(own)] = own
        if b >= n:
            goal[n - 1 - a - BLOCK] = end
        line = line.reshape(-1, BLOCK)
        yield np.concatenate([line[:-1], line[1:]], axis=1), goal.reshape(-1, BLOCK)


_CAUSAL = (np.arange(2 * BLOCK)[None] <= np.arange(BLOCK)[:, None] + BLOCK).astype(np.float32)


def forward(m: Model, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights, and the hidden vectors of the second block of each window, one row an id."""
    last = w[:, BLOCK:]
    q, k = m.query.take(last, axis=0), m.key.take(w, axis=0)  # take: quicker than an index
    q += m.query_place
    k += m.key_place
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -60, 60, out=a)  # a bound instead of the row's maximum; what is smaller makes numbers below the normal range, which are slow
    np.exp(a, out=a)
    a *= _CAUSAL
    # padding stands in the whole first block of a text's first window, and else only behind all targets, where the mask is
    a[m.key_bias.take(w[:, 0]) < 0, :, :BLOCK] = 0
    a *= 1 / (a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, a.dtype)).reshape(-1, BLOCK, 1)
    h = a @ m.value.take(w, axis=0)
    h += m.own.take(last, axis=0)
    return a, np.maximum(h, 0, out=h).reshape(-1, WIDTH)


def _outputs(m: Model, h: np.ndarray, t: np.ndarray, slopes: bool) -> tuple[np.ndarray, np.ndarray | None, dict[str, tuple]]:
    """Natural log p of the targets; with `slopes` also what the loss's gradient is for h and for both softmaxes, as (rows, values)."""
    # targets of a class stand together, and the classes' scores go through in parts that stay in the cache; a column of ones is for biases
    order = _sorted(m.class_of.take(t), len(m.bounds))
    t = t.take(order)
    x1, place, c = np.ones((len(t), WIDTH + 1), h.dtype), m.place.take(t), m.class_of.take(t)
    x1[:, :WIDTH] = h.take(order, axis=0)
    # scores are held within 60 of 0 where they could be beyond
    far = np.sqrt(np.einsum("ij,ij->i", h, h).max(initial=0))
    beyond = lambda w, bias: far * np.sqrt(np.einsum("ij,ij->i", w, w).max(initial=0)) + np.abs(bias).max(initial=0) > 60
    wide, wide_within = beyond(m.class_out.T, m.class_bias), beyond(m.within, m.within_bias)
    logs, back, g = np.empty(len(t), h.dtype), np.empty_like(h) if slopes else None, {}
    out, within = np.concatenate([m.class_out, m.class_bias[None]]), np.concatenate([m.within, m.within_bias[:, None]], axis=1)
    total_out, ones = np.zeros_like(out), np.ones(max(out.shape[1], MOST + 1), out.dtype)
    for at in range(0, len(t), 1024):
        x, k = x1[at : at + 1024], c[at : at + 1024]
        rows = np.arange(len(x))
        z = x @ out
        if wide:
            np.clip(z, -60, 60, out=z)
        chosen = z[rows, k]
        np.exp(z, out=z)
        total = z @ ones[: z.shape[1]]  # quicker than a sum of short rows
        logs[at : at + 1024] = chosen - np.log(total)
        if slopes:
            z *= (1 / total)[:, None]
            z[rows, k] -= 1
            total_out += x.T @ z
            back[at : at + 1024] = z @ m.class_out.T
    cuts = np.searchsorted(c, np.arange(len(m.bounds)))
    touched, changes = [np.zeros(0, np.int64)], [np.zeros((0, WIDTH + 1), h.dtype)]
    for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(m.bounds) > 1)).tolist():
        own, lo, hi = slice(cuts[k], cuts[k + 1]), m.bounds[k], m.bounds[k + 1]
        x, j = x1[own], place[own] - lo
        i, w = np.arange(len(j)), within[lo:hi]
        y = x @ w.T
        if wide_within:
            np.clip(y, -60, 60, out=y)
        chosen = y[i, j]
        np.exp(y, out=y)
        total = y @ ones[: hi - lo]
        logs[own] += chosen - np.log(total)
        if slopes:
            y *= (1 / total)[:, None]
            y[i, j] -= 1
            back[own] += y @ w[:, :WIDTH]
            touched.append(np.arange(lo, hi))
            changes.append(y.T @ x)
    if slopes:
        rows, changes = np.concatenate(touched), np.concatenate(changes)
        g = {"class_out": (slice(None), total_out[:WIDTH]), "class_bias": (slice(None), total_out[WIDTH]), "within": (rows, changes[:, :WIDTH]), "within_bias": (rows, changes[:, WIDTH])}
    first = np.empty(len(order), np.int64)
    first[order] = np.arange(len(order))
    return logs.take(first), back.take(first, axis=0) if slopes else None, g


def slopes_of(m: Model, w: np.ndarray, t: np.ndarray) -> tuple[float, dict[str, tuple]]:
    """The summed loss of the windows (numbers as in `compact`, targets -1 where there is none) and its gradient by array: (rows,
    values), as a step touches few of the ids."""
    # attention in parts that stay in the cache, the softmaxes and the sums by id in one
    cuts = [slice(k, k + 128) for k in range(0, len(w), 128)]
    parts = [forward(m, w[k]) for k in cuts]
    h, flat = np.concatenate([x for _, x in parts]), t.reshape(-1)
    own = np.flatnonzero(flat >= 0)
    logs, back, g = _outputs(m, h.take(own, axis=0), flat[own], True)
    full = np.zeros_like(h)
    full[own] = back
    full *= h > 0
    d_in, d_last = np.empty((*w.shape, 2 * WIDTH), h.dtype), np.empty((len(w), BLOCK, 2 * WIDTH), h.dtype)
    for k, (a, _) in zip(cuts, parts, strict=True):
        last, d_o = w[k, BLOCK:], full.reshape(len(w), BLOCK, WIDTH)[k]
        d_a = d_o @ m.value.take(w[k], axis=0).transpose(0, 2, 1)
        d_a -= np.einsum("bij,bij->bi", d_a, a)[:, :, None]
        d_a *= a
        d_last[k, :, :WIDTH], d_last[k, :, WIDTH:] = d_a @ (m.key.take(w[k], axis=0) + m.key_place), d_o
        d_in[k, :, :WIDTH], d_in[k, :, WIDTH:] = d_a.transpose(0, 2, 1) @ (m.query.take(last, axis=0) + m.query_place), a.transpose(0, 2, 1) @ d_o
    g |= {"query_place": (slice(None), d_last[:, :, :WIDTH].sum(axis=0)), "key_place": (slice(None), d_in[:, :, :WIDTH].sum(axis=0))}
    for names, ids, d in ((("query", "own"), w[:, BLOCK:], d_last), (("key", "value"), w, d_in)):
        rows, sums = _by_id(ids.reshape(-1), d.reshape(-1, 2 * WIDTH), len(m.key))
        g |= {name: (rows, sums[:, k * WIDTH : (k + 1) * WIDTH]) for k, name in enumerate(names)}
    return -float(logs.sum()), g


def gradients(m: Model, w: np.ndarray, t: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The loss as in slopes_of, and its gradient as whole arrays."""
    loss, g = slopes_of(m, w, t)
    whole = {name: np.zeros_like(getattr(m, name)) for name in g}
    for name, (rows, d) in g.items():
        whole[name][rows] = d
    return loss, whole


def _sorted(numbers: np.ndarray, size: int) -> np.ndarray:
    """The order of numbers below `size`, equal ones as they come."""
    return np.argsort(numbers.astype(np.uint16) if size <= 1 << 16 else numbers, kind="stable")


#: Runs of more rows are added at once.
LONG = 12


def _by_id(ids: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and the sums of their rows: those of a long run at once, those of short ones rank by rank, which is much quicker
    than reduceat."""
    order = _sorted(ids, size)
    ids = ids.take(order)
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    length = np.diff(first, append=len(ids))
    out = g.take(order.take(first), axis=0)
    for i in np.flatnonzero(length > LONG).tolist():
        np.add.reduce(g.take(order[first[i] : first[i] + length[i]], axis=0), axis=0, out=out[i])
    own = np.flatnonzero((length > 1) & (length <= LONG))
    own = own[np.argsort(-length[own], kind="stable")]
    for rank in range(1, LONG):
        own = own[: np.searchsorted(-length[own], -rank)]  # runs of more than `rank`
        if not len(own):
            break
        out[own] += g.take(order.take(first[own] + rank), axis=0)
    return ids[first], out


def train_on(m: Model, w: np.ndarray, t: np.ndarray, rng: np.random.Generator, rate: float = 0.1, batch: int = 128) -> None:
    """One pass of Adagrad over the windows, in place; m.square keeps the squared gradients."""
    for at in np.array_split(rng.permutation(len(w)), -(-len(w) // batch)) if len(w) else ():
        _, g = slopes_of(m, w[at], t[at])
        for name, (rows, d) in g.items():
            square = m.square[name][rows] + d * d
            m.square[name][rows] = square
            np.sqrt(square, out=square)
            square += 1e-6
            np.divide(d, square, out=square)
            square *= rate
            getattr(m, name)[rows] -= square


def numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(compact, weight, marks): the number of each id, the counts by number, and which of the 128 most frequent a number is, -1 for others."""
    known = np.flatnonzero(counts > 0)
    compact = np.full(PAD + 1, len(known))
    compact[known], compact[PAD] = np.arange(len(known)), len(known) + 1
    weight = np.append(counts[known], [1.0, 1e-9])
    marks = np.full(len(weight), -1)
    marks[np.argsort(-weight, kind="stable")[:128]] = np.arange(min(128, len(weight)))
    return compact, weight, marks


def count_beside(total: np.ndarray, s: np.ndarray, marks: np.ndarray) -> None:
    """Adds to total, 256 places a number, how often it follows (the first half) and precedes each of the frequent ones in a text."""
    for a, b, shift in ((s[1:], s[:-1], 0), (s[:-1], s[1:], 128)):
        ok = marks[b] >= 0
        np.add.at(total, a[ok] * 256 + marks[b[ok]] + shift, 1)


def _classes(beside: np.ndarray, seen: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each number: one of its own for the most frequent, for the others by k-means on the ids before and after them."""
    size = len(seen)
    order = np.argsort(-seen, kind="stable")
    class_of = np.full(size, CLASSES - 1)
    class_of[order[:SINGLE]] = np.arange(min(SINGLE, size))
    rest = order[SINGLE:][seen[order[SINGLE:]] >= 1]
    if not len(rest):
        return class_of
    m = beside.reshape(-1, 256)[rest].astype(np.float32)
    m = np.sqrt(m / np.maximum(m.sum(axis=1, keepdims=True), 1))
    k = min(CLASSES - 1 - SINGLE, len(rest))
    centre = m[rng.choice(len(rest), k, replace=False, p=seen[rest] / seen[rest].sum())]
    for _ in range(12):
        near = (m @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        weight = np.bincount(near, seen[rest], k)
        total = np.zeros_like(centre)
        np.add.at(total, near, m * seen[rest][:, None])
        centre = np.where(weight[:, None] > 0, total / np.maximum(weight[:, None], 1), centre).astype(np.float32)
    class_of[rest] = SINGLE + near
    return class_of


def start(sequences: list[np.ndarray], counts: np.ndarray, end: int, seed: int = 0, passes: int = 2, beside: np.ndarray | None = None, more: int = 0) -> Model:
    """A model for the ids that have a count (the end too), with biases by the counts, fitted on the sample of sequences. beside: the
    counts of neighbours in all texts, which tell the classes; without them those in the sample do. more: ids beyond the end."""
    rng = np.random.default_rng(seed)
    compact, weight, marks = numbered(counts)
    other, pad = len(weight) - 2, len(weight) - 1
    if beside is None:
        beside = np.zeros(len(weight) * 256, np.int64)
        for s in sequences:
            count_beside(beside, compact[np.concatenate([[end], s, [end]])], marks)
    class_of = _classes(beside, weight, rng)
    class_of[[other, pad]] = CLASSES
    order = np.lexsort((-weight, class_of))
    rank = np.arange(len(order)) - np.searchsorted(class_of[order], class_of[order])
    class_of[order] = class_of[order] * len(order) + rank // MOST
    _, class_of = np.unique(class_of, return_inverse=True)
    n, size = int(class_of.max()) + 1, len(weight)
    order = np.argsort(class_of, kind="stable")
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    total = np.bincount(class_of, weight, n)
    normal_ = lambda *shape, by=0.3: (by * rng.standard_normal(shape)).astype(np.float32)
    bias = np.zeros(size, np.float32)
    bias[pad] = -1e9
    m = Model(
        query=normal_(size, WIDTH), key=normal_(size, WIDTH), value=normal_(size, WIDTH), own=normal_(size, WIDTH), key_bias=bias, query_place=normal_(BLOCK, WIDTH), key_place=normal_(2 * BLOCK, WIDTH),
        class_out=normal_(WIDTH, n, by=0.05), class_bias=np.log(total / total.sum()).astype(np.float32), within=normal_(size, WIDTH, by=0.05), within_bias=np.log(weight / total[class_of])[order].astype(np.float32),
        class_of=class_of, place=place, bounds=np.searchsorted(class_of[order], np.arange(n + 1)), compact=compact, other=other, log_others=float(np.log(max(1, end + 1 + more - other))),
    )
    m.square = {name: np.zeros_like(getattr(m, name)) for name in (*BY_ID, *DENSE)}
    parts = [next(windows(s, end, None)) for s in sequences]
    if parts:
        w, t = compact[np.concatenate([w for w, _ in parts])], np.concatenate([t for _, t in parts])
        for _ in range(passes):
            train_on(m, w, np.where(t >= 0, compact[t], -1), rng)
    return m


#: Numbers of an array that travel together.
PIECE = 1 << 16


def _in_pieces(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(x), PIECE):
        if x[k : k + PIECE].any():
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE]), pa.array([x[k : k + PIECE].tobytes()], pa.binary())], ["piece", "sums"])


def added(parts: DataFrame, size: int, kind: str) -> np.ndarray:
    """The sum of arrays of `size` numbers that tasks gave in pieces, in two levels, so that no task adds those of all others."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), kind).astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype(kind).tobytes() for x in sums.values()], pa.binary())], ["piece", "sums"])

    some = parts.withColumn("part", F.spark_partition_id() % 16).repartition("piece", "part").select("piece", "sums").mapInArrow(add, "piece long, sums binary")
    total = some.repartition("piece").mapInArrow(add, "piece long, sums binary").toArrow()  # one array of a model
    out = np.zeros(size)
    for k, x in zip(total.column(0).to_pylist(), total.column(1), strict=True):
        piece = np.frombuffer(x.as_buffer(), kind)
        out[k * PIECE : k * PIECE + len(piece)] = piece
    return out


def neighbours(ids: DataFrame, counts: np.ndarray, end: int) -> np.ndarray:
    """What count_beside counts in all texts."""
    compact, weight, marks = numbered(counts)
    sent = ids.sparkSession.sparkContext.broadcast((compact, marks))  # a number an id

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compact, marks = sent.value
        total = np.zeros(len(weight) * 256, np.int64)
        for batch in batches:
            for x in batch.column(0):
                count_beside(total, compact[np.concatenate([[end], np.frombuffer(x.as_buffer(), "<u2"), [end]])], marks)
        yield from _in_pieces(total.astype("<f8"))

    return added(ids.select("ids").mapInArrow(work, "piece long, sums binary"), len(weight) * 256, "<f8")


def go_on(m: Model, ids: DataFrame, end: int, share: int = SHARE, task_windows: int = TASK_WINDOWS) -> Model:
    """The model after a pass over all windows of all texts of (key, ids), or one of `share` by a hash of key and place. Texts are dealt
    to tasks by their key, in whose order about `task_windows` windows at a time are learned from, each time from the given model;
    the changes are averaged by the number of windows. A task goes through so many windows that what it sends is no more than it read."""
    spark = ids.sparkSession
    sent = spark.sparkContext.broadcast(m)  # arrays of fixed sizes
    names = (*BY_ID, *DENSE)
    whole = sum(getattr(m, name).size for name in names)
    n = ids.agg(F.sum(F.expr(f"octet_length(ids) div {2 * BLOCK} + 1"))).first()[0]
    if not n:
        return m
    dealt = ids.select("key", "ids").repartition(-(-n // (share * max(task_windows, 2 * whole // BLOCK))), "key").sortWithinPartitions("key", "ids")

    def groups(batches: Iterator[pa.RecordBatch], numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, salt = 0, np.array([key]).view(np.uint64)
                for w, t in windows(np.frombuffer(x.as_buffer(), "<u2").astype(np.int64), end):
                    place, at = np.arange(at, at + len(w)).astype(np.uint64), at + len(w)
                    if share > 1:
                        mine = mix(place + salt) % np.uint64(share) == 0
                        w, t = w[mine], t[mine]
                    held.append((numbers[w].astype(np.int32), np.where(t >= 0, numbers[t], -1).astype(np.int32)))
                    size += len(w)
                    if size >= task_windows:
                        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                        held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        first = sent.value
        change, seen = {name: np.zeros(getattr(first, name).shape) for name in names}, 0
        for w, t in groups(batches, first.compact):
            own = copy.deepcopy(first)
            train_on(own, w, t, np.random.default_rng(1), batch=1024)
            for name in names:
                change[name] += (getattr(own, name) - getattr(first, name)) * float(len(w))
            seen += len(w)
        yield from _in_pieces(np.concatenate([*(change[name].reshape(-1) for name in names), [seen]]).astype("<f4"))

    total = added(dealt.mapInArrow(learn, "piece long, sums binary"), whole + 1, "<f4")
    at = 0
    for name in names if total[-1] else ():
        x = getattr(m, name)
        x[...] += (total[at : at + x.size] / total[-1]).reshape(x.shape)
        at += x.size
    return m


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in column]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most 500 rows and half a million ids; a longer row is a part of its own."""
    size = np.array([len(x.as_buffer()) for x in batch.column(column)], np.int64)
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + 500]), 1_000_000, "right")))
        yield batch.slice(at, n)
        at += n


def ids_counted(ids: DataFrame, end: int) -> np.ndarray:
    """How often each id, and the end, occurs in the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAD + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=PAD + 1)
                total[end] += 1
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "c"])

    rows = ids.select("ids").mapInArrow(work, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()  # a row an id
    out = np.zeros(PAD + 1)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def counts_of(training: DataFrame) -> DataFrame:
    """(h, c): how often each word occurs in all training texts, by its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            h, c = np.concatenate([w[0] for w in words]), np.concatenate([w[1] for w in words])
            h, inverse = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(inverse, c, len(h)).astype(np.int64))], ["h", "c"])

        for batch in batches:
            for _, _, data, offsets in text_pieces(batch, 0):
                starts, ends = runs(data, offsets, NOT_SPACE)
                words.append(np.unique(hash_runs(LOWER[data], starts, ends), return_counts=True))
                held += len(words[-1][0])
                if held > 2_000_000:
                    yield flush()
                    words, held = [], 0
        if words:
            yield flush()

    return cut(training.mapInArrow(work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


def encoded(docs: DataFrame, sent, number: int, head) -> DataFrame:
    """(row, doc, key, training, ids, n_words, known, logs, rest) of (doc, key, text, training): the ids of each text, two bytes each;
    its words, those in the head and the sum of their logarithms, and the hashes of the others. Written, with a number for each
    row, so that texts are encoded once and rows keep their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, (hh, hl) = _encoder(number, sent.value), head.value
        for batch in batches:
            n = batch.num_rows
            ids, rest, begun = [[] for _ in range(n)], [[] for _ in range(n)], np.zeros(n, bool)
            n_words, known, logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for row, stop, data, offsets in text_pieces(batch, 2, 1 << 19):
                starts, ends = runs(data, offsets, NOT_SPACE)
                text = np.searchsorted(offsets, starts, "right") - 1
                h = hash_runs(LOWER[data], starts, ends)
                hit, log = _in_head(h, hh, hl)
                many = stop - row
                first = np.zeros(len(h), bool)
                opens = np.flatnonzero(np.diff(text, prepend=-1))
                first[opens[~begun[row + text[opens]]]] = True
                begun[row + text[opens]] = True
                own, size = ids_of(data, starts, ends, h, first)
                n_words[row:stop] += np.bincount(text, minlength=many)
                known[row:stop] += np.bincount(text[hit], minlength=many)
                logs[row:stop] += np.bincount(text, log, many)
                away, of = h[~hit], np.searchsorted(text[~hit], np.arange(many + 1))
                cuts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(text, np.arange(many + 1))]
                for i in np.unique(text).tolist():
                    rest[row + i].append(away[of[i] : of[i + 1]])
                    ids[row + i].append(own[cuts[i] : cuts[i + 1]].tobytes())
            lists = pa.array([np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in rest], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([b"".join(x) for x in ids], pa.binary()), pa.array(n_words), pa.array(known), pa.array(logs), lists], ["doc", "key", "training", "ids", "n_words", "known", "logs", "rest"])

    kind = docs.schema["doc"].dataType.simpleString()
    out = docs.select("doc", "key", "text", "training").mapInArrow(work, f"doc {kind}, key long, training boolean, ids binary, n_words long, known long, logs double, rest array<long>")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "attention_lm", "ids")


def _least_count(words: DataFrame, most: int) -> int:
    """The smallest count that at most `most` words reach; no sort of all words is needed. As many rows as there are different
    counts come to the driver: words whose counts are all different are few, the square root of all words at most."""
    sizes = words.groupBy("c").agg(F.count("*").alias("n")).toArrow()
    c, n = sizes.column(0).to_numpy(), sizes.column(1).to_numpy()
    order = np.argsort(-c)
    fits = np.flatnonzero(np.cumsum(n[order]) <= most)
    return int(c[order][fits[-1]]) if len(fits) else int(c.max(initial=0)) + 1


def score_texts(docs: DataFrame, training: Column, rank_file: str, id_column: str = "doc_id", text_column: str = "text", sample_texts: int = 700, head_words: int = HEAD_WORDS, task_windows: int = TASK_WINDOWS) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score) for each document. training: which rows may be learned from,
    over the id column. The network starts from about `sample_texts` training texts, drawn by a hash (the bound of the sample), and goes on over all windows of all training texts; the counts of words and ids, the
    classes and the `head_words` most frequent words that merges are learned from cover all training texts.
    Null and empty texts have no word and one end. Scores are rounded to 3
    decimals, as sums of 32-bit numbers differ a little by what else a batch holds; rows that repeat come out alike but for such a step. With nothing to learn from, all counts are 0 and
    every id is as likely as any other. A long text goes through in pieces. Further columns play no part."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(rank_file)
    end = vocabulary.end
    d = need(docs, id_column, text_column).select(F.col(id_column).alias("doc"), F.xxhash64(id_column, text_column).alias("key"), F.coalesce(text_column, F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    words = counts_of(d.where("training").select("text"))
    top = words.where(F.col("c") >= _least_count(words, head_words)).toArrow()  # head_words rows at most
    head_h, head_c = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(head_h)
    head_h, head_c = head_h[order], head_c[order]
    head = spark.sparkContext.broadcast((head_h, np.log10(head_c + 1.0)))  # head_words rows
    ring = 1 << 30
    share_of = lambda n: F.pmod("key", F.lit(ring)) < int(min(ring, ring * sample_texts // max(n, 1) + 1))
    spelled = head_spelled(d.where("training").select("text"), spark.sparkContext.broadcast((head_h, head_c)))  # head_words rows
    vocabulary.merge(spelled.column(0).to_pylist(), spelled.column(1).to_numpy())
    sent = spark.sparkContext.broadcast(vocabulary)  # the rank file and MERGES pairs
    number = sent._jbroadcast.id()

    ids = encoded(d, sent, number, head)
    learned = ids.where("training")
    counts = ids_counted(learned, end)
    n_texts = int(counts[end])
    sample = learned.where(share_of(n_texts)).select("ids", "key").orderBy("key", "row").limit(2 * sample_texts).toArrow()  # rows that repeat add no more
    first = start(_sequences(sample.column(0).combine_chunks()) if sample.num_rows else [], counts, end, beside=neighbours(learned, counts, end), more=vocabulary.n_merges)
    model = spark.sparkContext.broadcast(go_on(first, learned, end, task_windows=task_windows))  # arrays of fixed sizes

    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n + n_texts, total.v + (n_texts > 0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in _slices(batch, 5):
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(np.round(m.log10(_sequences(part.column(5)), end), 3))], ["row", "doc", "n_words", "known", "logs", "score"])

    kind = d.schema["doc"].dataType.simpleString()
    own = ids.select("row", "doc", "n_words", "known", "logs", "ids").mapInArrow(scored, f"row long, doc {kind}, n_words long, known long, logs double, score double")
    tail = ids.select("row", F.explode("rest").alias("h")).join(words, "h").groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    both = own.join(tail, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs + F.lit(float(np.log10(n_texts + 1.0))) - (F.col("n_words") + 1) * F.lit(float(np.log10(n + v + 1)))
    return both.select(F.col("doc").alias(id_column), (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(n_texts > 0)).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def head_spelled(training: DataFrame, head) -> pa.Table:
    """(word, c): the words of all training texts that are in the head, each once, in the order of their bytes, and their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # words of the head
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                words, c = _head_words(batch.column(0).slice(at, 256).to_pylist(), *head.value)
                new = [k for k, w in enumerate(words) if w not in seen]
                seen.update(words[k] for k in new)
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in new], pa.string()), pa.array(c[new], pa.float64())], ["word", "c"])

    return training.mapInArrow(work, "word string, c double").groupBy("word").agg(F.max("c").alias("c")).toArrow().sort_by("word")


def _head_words(texts: list[str], head: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different words of the texts that are in the head, in the order of their bytes, and their counts there: over all training texts."""
    words = sorted({w for text in texts for w in normal(text).encode().split()})
    data = np.frombuffer(b" ".join(words), np.uint8)
    h = hash_runs(data, *runs(data, np.array([0, len(data)]), NOT_SPACE))
    hit, c = _in_head(h, head, counts.astype(np.float64))
    return [words[i].decode() for i in np.flatnonzero(hit)], c[hit]


def _in_head(h: np.ndarray, head: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are in the head, and their logarithms, 0 for others. Each distinct word is looked up once."""
    if not len(head) or not len(h):
        return np.zeros(len(h), bool), np.zeros(len(h))
    own, inverse = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(head, own), len(head) - 1)
    hit = head[at] == own
    return hit[inverse], np.where(hit, logs[at], 0)[inverse]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))  # a null id is not held out


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(read(spark, sf_dir, "documents"), ~held_out(), default_ranks())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
