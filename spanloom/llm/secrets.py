"""Secret scans: fixed patterns, and a linear-chain CRF that finds what they miss.

A line is a sequence of tokens tagged begin (of a secret), inside or outside.  The
scores depend on a token's shape, the words and marks around it and the file it
stands in; the patterns' own finds in a bounded sample of texts are the training
tags.  Decoding is exact Viterbi: tokens whose outside score beats any gain that
transitions could bring are outside on the best path, so only the short runs
between them are decoded, all runs of a batch in step.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import LOWER, prefix_hashes, small_batches, span_hashes, text_bytes

#: Fixed patterns of the base kinds, with the group and length that decide.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Sample the model is fitted on: so many texts with and without a find, of at most so many characters.
TRAIN_TEXTS = 250
TRAIN_CHARS = 10_000
EPOCHS = 20
BUCKETS = 4096

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points of every base find of a whole text."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def secret_part(text: str, span: Span) -> tuple[int, int]:
    """Where the secret itself stands in a find."""
    if span[0] != "assign":
        return span[1:]
    m = ASSIGN.match(text, span[1])
    return m.start(2), m.end(2)


_REST = re.compile(r"[0-9A-Za-z+/_.\x80-\U0010ffff-](?:.*[0-9A-Za-z+/_.\x80-\U0010ffff-])?", re.S)
_WORDED = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]")


def beside(text: str, start: int, end: int, base: list[Span]) -> list[tuple[int, int]]:
    """The parts of a learned run outside the base finds, each from its first to its
    last token character; a part of marks only is none."""
    parts = []
    for _, x, y in base:  # in order of their starts
        if x >= end:
            break
        if x > start:
            parts.append((start, x))
        start = max(start, y)
    if start < end:
        parts.append((start, end))
    found = [m.span() for a, b in parts if (m := _REST.search(text, a, b))]
    return [(a, b) for a, b in found if _WORDED.search(text, a, b)]


# --- tokens and features of a batch ---------------------------------------------------

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_TOKEN[[ord(c) for c in "+/_.-"]] = True
_DIGIT, _UPPER, _LOWER_, _HEXISH, _MARK, _WIDE = (np.zeros(256, np.int64) for _ in range(6))
_DIGIT[48:58] = 1
_UPPER[65:91] = 1
_LOWER_[97:123] = 1
_HEXISH[48:58] = _HEXISH[65:71] = _HEXISH[97:103] = 1
_MARK[[ord(c) for c in "+/_.-"]] = 1
_WIDE[128:] = 1
#: What stands next to a token: other, space, quote, equals, colon, bracket, line end.
_AROUND = np.zeros(256, np.int64)
for _k, _chars in enumerate((" \t", "\"'`", "=", ":", "()[]{}<>", "\n\r"), 1):
    _AROUND[[ord(c) for c in _chars]] = _k
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64, 128])
#: Number of values of each plain feature, in the order of ``Tokens.features``.
_SIZES = (15, 6, 6, 6, 2, 8, 8, 2, 2, 8, 49, 4, 8, 2)
_WORDS = 3  # hashed features: the word before, the one before that, the next
WIDTH = sum(_SIZES) + _WORDS * BUCKETS


class Tokens:
    """Tokens of a batch of texts, their bytes, lines and feature numbers."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        self.data, self.offsets = data, offsets
        inside = _TOKEN[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut], ends[cut - 1] = inside[cut], inside[cut - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[self.start] + self.text
        self.new = np.ones(len(line), bool)  # the first token of a line
        self.new[1:] = line[1:] != line[:-1]
        self.chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def features(self) -> np.ndarray:
        """A row of feature numbers (below WIDTH) per token."""
        data, start, end = self.data, self.start, self.end
        n = len(start)
        if not n:
            return np.zeros((0, len(_SIZES) + _WORDS), np.int32)

        def count(kind):
            total = np.concatenate([[0], np.cumsum(kind[data])])
            return total[end] - total[start]

        size = end - start
        digits, upper, lower = count(_DIGIT), count(_UPPER), count(_LOWER_)
        kind = _DIGIT[data] + 2 * (_UPPER[data] | _LOWER_[data])
        change = np.zeros(len(data) + 1, np.int64)
        change[1:-1] = np.cumsum(kind[1:] != kind[:-1])
        turns = change[end - 1] - change[start]
        share = lambda x: (x * 5 + size - 1) // size
        before = np.where(start > self.offsets[self.text], _AROUND[data[np.maximum(start - 1, 0)]], 6)
        before2 = np.where(start > self.offsets[self.text] + 1, _AROUND[data[np.maximum(start - 2, 0)]], 6)
        last = end >= self.offsets[self.text + 1]
        after = np.where(last, 6, _AROUND[data[np.minimum(end, len(data) - 1)]])
        log2 = lambda x: np.minimum(7, np.log2(1 + x).astype(np.int64))
        per_text = np.diff(self.offsets)
        code = np.concatenate([[0], np.cumsum((_AROUND[data] >= 2) & (_AROUND[data] <= 5))])
        marks = (code[self.offsets[1:]] - code[self.offsets[:-1]]) * 50 // np.maximum(per_text, 1)
        plain = (
            np.searchsorted(_LENGTHS, size, "right"),
            share(digits), share(upper), share(lower),
            (count(_HEXISH) == size).astype(np.int64),
            log2(turns), log2(turns * 8 // size),
            (count(_MARK) > 0).astype(np.int64), (count(_WIDE) > 0).astype(np.int64),
            log2(np.minimum(digits, upper + lower)),
            before * 7 + before2 % 7,
            np.minimum(marks, 3)[self.text], np.minimum(7, np.log2(1 + per_text // 256).astype(np.int64))[self.text],
            (after == 2).astype(np.int64),
        )
        out = np.empty((n, len(_SIZES) + _WORDS), np.int32)
        at = 0
        for k, (values, most) in enumerate(zip(plain, _SIZES, strict=True)):
            out[:, k] = at + np.minimum(values, most - 1)
            at += most
        word = (span_hashes(prefix_hashes(LOWER[data]), start, end) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
        previous = np.zeros(n, np.int32)
        previous[1:] = np.where(self.new[1:], 0, word[:-1])
        second = np.zeros(n, np.int32)
        second[1:] = np.where(self.new[1:], 0, previous[:-1])
        following = np.zeros(n, np.int32)
        following[:-1] = np.where(self.new[1:], 0, word[1:])
        for k, values in enumerate((previous, second, following)):
            out[:, len(_SIZES) + k] = at + values
            at += BUCKETS
        return out


# --- the model --------------------------------------------------------------------------


def _scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    out = weights[features[:, 0]].copy()
    for k in range(1, features.shape[1]):
        out += weights[features[:, k]]
    return out


def _aligned(first: np.ndarray, length: np.ndarray):
    """Sequences longest first, and per step the positions of those still running."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    running = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
    return [first[:r] + t for t, r in enumerate(running)]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fitted(features: np.ndarray, tags: np.ndarray, new: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3,
           penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) of greatest penalised likelihood, by AdaGrad on the
    exact gradient (forward-backward over all lines in step).  A line stands
    between two outside tags."""
    weights, moves = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    if not len(tags):
        weights[:, OUTSIDE] = 1.0
        return weights, moves
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(tags)))
    steps = _aligned(first, length)
    ends = np.zeros(len(tags), bool)
    ends[first + length - 1] = True
    gold = np.zeros((len(tags), 3))
    gold[np.arange(len(tags)), tags] = 1
    before = np.where(new, OUTSIDE, np.roll(tags, 1))
    seen = np.zeros((3, 3))
    np.add.at(seen, (before, tags), 1)
    np.add.at(seen, (tags[ends], np.full(ends.sum(), OUTSIDE)), 1)
    squares_w, squares_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(epochs):
        emit = _scores(weights, features)
        forth, back = np.empty_like(emit), np.empty_like(emit)
        for t, at in enumerate(steps):
            came = moves[OUTSIDE][None] if t == 0 else _sum(forth[at - 1][:, :, None] + moves[None], 1)
            forth[at] = emit[at] + came
        for at in reversed(steps):
            last = ends[at]
            ahead = at[~last] + 1
            value = np.empty((len(at), 3))
            value[last] = moves[:, OUTSIDE]
            value[~last] = _sum(moves[None] + (emit[ahead] + back[ahead])[:, None, :], 2)
            back[at] = value
        total = _sum(forth + back, 1)
        chance = np.exp(forth + back - total[:, None])
        expected = np.zeros((3, 3))
        expected[OUTSIDE] += chance[new].sum(0)
        expected[:, OUTSIDE] += chance[ends].sum(0)
        inner = np.flatnonzero(~new)
        pair = forth[inner - 1][:, :, None] + moves[None] + (emit[inner] + back[inner])[:, None, :]
        expected += np.exp(pair - total[inner][:, None, None]).sum(0)
        error = gold - chance
        slope = np.stack([
            np.bincount(features.ravel(), np.repeat(error[:, c], features.shape[1]), WIDTH) for c in range(3)
        ], 1) - penalty * weights
        slope_m = seen - expected - penalty * moves
        squares_w += slope**2
        squares_m += slope_m**2
        weights += rate * slope / np.sqrt(squares_w)
        moves += rate * slope_m / np.sqrt(squares_m)
    return weights, moves


def decoded(features: np.ndarray, new: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tag of every token (Viterbi)."""
    emit = _scores(weights, features)
    tags = np.full(len(emit), OUTSIDE, np.int8)
    gain = max(
        moves[p, x] + moves[x, n] - moves[p, OUTSIDE] - moves[OUTSIDE, n]
        for p in range(3) for n in range(3) for x in (BEGIN, INSIDE)
    )
    open_ = emit[:, OUTSIDE] - emit[:, :OUTSIDE].max(1) <= gain
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    starts = np.ones(len(at), bool)
    starts[1:] = (at[1:] != at[:-1] + 1) | new[at[1:]]
    first = np.flatnonzero(starts)
    length = np.diff(np.append(first, len(at)))
    steps, score = _aligned(first, length), emit[at]
    came = np.zeros((len(at), 3), np.int8)
    for t, now in enumerate(steps):
        if t == 0:
            score[now] += moves[OUTSIDE]
        else:
            paths = score[now - 1][:, :, None] + moves[None]
            came[now] = paths.argmax(1)
            score[now] += paths.max(1)
    ends = np.zeros(len(at), bool)
    ends[first + length - 1] = True
    best = np.empty(len(at), np.int8)
    for now in reversed(steps):
        last = ends[now]
        final = now[last]
        best[final] = (score[final] + moves[:, OUTSIDE]).argmax(1)
        inner = now[~last]
        best[inner] = came[inner + 1, best[inner + 1]]
    tags[at] = best
    return tags


def learned_model(docs: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """A model fitted on at most ``texts`` texts with a base find and as many
    without, the first in the order of a hash among those up to ``chars`` long."""
    found = F.regexp_like("text", F.lit(
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|[0-9a-f]{32}|(?-i:AKIA[A-Z0-9]{12})"""))
    short = docs.where("text IS NOT NULL").where(F.length("text") <= chars).select("text")
    order = short.withColumn("found", found).withColumn("order", F.xxhash64("text"))
    sample = [
        r[0] for hit in (True, False)
        for r in order.where(F.col("found") == hit).orderBy("order", "text").limit(texts).select("text").collect()
    ]
    tokens = Tokens(pa.array(sample, pa.string()))
    tags = np.full(len(tokens.start), OUTSIDE, np.int8)
    begin = tokens.chars[tokens.start] - tokens.chars[tokens.offsets[tokens.text]]
    stop = tokens.chars[tokens.end] - tokens.chars[tokens.offsets[tokens.text]]
    bounds = np.searchsorted(tokens.text, np.arange(len(sample) + 1))
    for k, text in enumerate(sample):
        # finds that differ from a base find in case only are secrets too
        folded = text.lower() if len(text.lower()) == len(text) else text
        for start, end in {secret_part(x, s) for x in (text, folded) for s in base_spans(x)}:
            inside = np.flatnonzero((stop[bounds[k]:bounds[k + 1]] > start) & (begin[bounds[k]:bounds[k + 1]] < end)) + bounds[k]
            inside = inside[tags[inside] == OUTSIDE]
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
    return fitted(tokens.features(), tags.astype(np.int64), tokens.new)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanned(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and n_learned per row.

    Base finds always stay; the model adds what lies outside them, also of a run
    that goes on before or behind one.  Null and empty texts have no spans.  Positions are code points, ends exclusive.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned_model(docs, **options))
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches):
        weights, moves = (x.astype(np.float32) for x in model.value)
        for batch in small_batches(batches):
            tokens = Tokens(batch.column(1))
            tags = decoded(tokens.features(), tokens.new, weights, moves)
            hits = np.flatnonzero(tags != OUTSIDE)
            opens = np.ones(len(hits), bool)
            opens[1:] = (hits[1:] != hits[:-1] + 1) | (tags[hits[1:]] == BEGIN) | tokens.new[hits[1:]]
            head = np.flatnonzero(opens)
            tail = np.append(head[1:], len(hits)) - 1 if len(hits) else head
            text = tokens.text[hits[head]]
            origin = tokens.chars[tokens.offsets[text]]
            extra: dict[int, list] = {}
            for k, a, b in zip(text.tolist(), (tokens.chars[tokens.start[hits[head]]] - origin).tolist(),
                               (tokens.chars[tokens.end[hits[tail]]] - origin).tolist(), strict=True):
                extra.setdefault(k, []).append((a, b))
            rows = []
            for k, value in enumerate(batch.column(1).to_pylist()):
                base = base_spans(value or "")
                new = [("learned", *part) for run in extra.get(k, ()) for part in beside(value, *run, base)]
                counts = [sum(s[0] == x for s in base) for x in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(sorted(base + new, key=_place)), len(new)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")
