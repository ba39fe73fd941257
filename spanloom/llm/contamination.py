"""Benchmark passages in training texts, by suffix arrays over words.

Every task turns its share of the training texts into shards of word hashes and
sorts each shard's suffixes (prefix doubling).  All test suffixes are then
binary-searched in the shard at once, which yields every verbatim match with its
place and its longest extension.  Only training words that can lie in a match are
indexed: a match of w words is a run of w - 1 word pairs that all occur in the
tests, so words outside runs of the least window's length are left out exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ALNUM, Words, mixed, small_batches

WINDOW = 13
#: Test words in one broadcast block; a larger test set is searched in several.
BLOCK_WORDS = 4_000_000
SHARD_BYTES = 4 << 20


class Tests:
    """Word hashes of a block of test items, concatenated.

    ``origin`` numbers the item of each word, ``left`` the words from there to
    the item's end.  Windows start at ``starts`` and are ``width`` words long.
    """

    def __init__(self, items: pa.Array, texts: pa.Array, window: int):
        words = Words(texts, ALNUM)
        n = words.counts()
        self.ids, self.words = items.to_pylist(), words.hash
        self.origin = np.repeat(np.arange(len(n)), n)
        self.left = np.repeat(words.first[1:], n) - np.arange(len(self.words))
        width = np.minimum(window, n)[self.origin]
        self.starts = np.flatnonzero(self.left >= width)
        self.width = width[self.starts]
        self.vocabulary = np.unique(self.words)
        inner = np.flatnonzero(self.left[:-1] > 1) if len(self.words) else np.zeros(0, int)
        self.pairs = np.unique(pair_hashes(self.words, inner))
        self.least = int(self.width.min()) if len(self.width) else 0


def pair_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(words[at] * np.uint64(3) + mixed(words[at + 1]))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``known``."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffixes of ``ranks`` (positive; 0 ends a text and sorts first) in order,
    by prefix doubling; suffixes that are equal up to their text's end stay in
    order of position."""
    n = len(ranks)
    rank, step = ranks.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[:-step] = rank[step:]
        ahead[rank == 0] = 0
        order = np.lexsort((ahead, rank))
        fresh = np.ones(n, bool)
        fresh[1:] = (rank[order[1:]] != rank[order[:-1]]) | (ahead[order[1:]] != ahead[order[:-1]])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh)
        new[ranks == 0] = 0
        if step >= n or not (~fresh & (ahead[order] > 0)).any():
            return order
        rank, step = new, 2 * step


class Shard:
    """The suffix array of the training words that can lie in a match."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, tests: Tests):
        n = len(hashes)
        known = among(hashes, tests.vocabulary)
        known_at = np.flatnonzero(known)
        linked = np.zeros(n, bool)  # whether a word and the next one follow each other in a test
        inner = known_at[(known_at + 1 < n)]
        inner = inner[known[inner + 1]]
        last = np.zeros(n + 1, bool)
        last[first[1:]] = True
        inner = inner[~last[inner + 1]]
        linked[inner] = among(pair_hashes(hashes, inner), tests.pairs)
        # runs of linked words: each word that is not linked closes a run
        run = np.zeros(n, np.int64)
        run[1:] = np.cumsum(~linked[:-1])
        length = np.bincount(run, minlength=1)[run] if n else run
        kept = np.flatnonzero(known & (length >= tests.least))
        # the kept words, with a 0 between runs
        gap = np.ones(len(kept), bool)
        gap[1:] = run[kept[1:]] != run[kept[:-1]]
        at = np.arange(len(kept)) + np.cumsum(gap)
        size = int(at[-1]) + 2 if len(at) else 0
        self.codes, self.place = np.zeros(size, np.int64), np.full(size, -1)
        self.codes[at] = np.searchsorted(tests.vocabulary, hashes[kept]) + 1
        self.place[at] = kept
        self.order = suffix_array(self.codes) if size else np.zeros(0, np.int64)

    def compared(self, suffix: np.ndarray, codes: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix sorts before, has as its beginning, or sorts after the window."""
        out, live = np.zeros(len(start), np.int8), np.arange(len(start))
        for k in range(int(width.max(initial=0))):
            live = live[width[live] > k]
            if not len(live):
                break
            at = suffix[live] + k
            mine = np.where(at < len(self.codes), self.codes[np.minimum(at, len(self.codes) - 1)], 0)
            diff = np.sign(mine - codes[start[live] + k]).astype(np.int8)
            out[live] = diff
            live = live[diff == 0]
        return out

    def ranges(self, codes: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of all windows at once: the slice of the order that begins with each."""
        found = []
        for beyond in (0, 1):
            low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order))
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                less = self.compared(self.order[mid], codes, start[open_], width[open_]) < beyond
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            found.append(low)
        return found[0], found[1]

    def matches(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test word, training word, words matched) of every window's occurrences;
        the match is extended to its longest from there."""
        if not len(self.order) or not len(tests.starts):
            return (np.zeros(0, np.int64),) * 3
        codes = np.searchsorted(tests.vocabulary, tests.words) + 1
        low, high = self.ranges(codes, tests.starts, tests.width)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        suffix = self.order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        start, length = tests.starts[which], tests.width[which].copy()
        live = np.arange(len(which))
        while len(live):
            live = live[length[live] < tests.left[start[live]]]
            at = suffix[live] + length[live]
            mine = np.where(at < len(self.codes), self.codes[np.minimum(at, len(self.codes) - 1)], 0)
            live = live[mine == codes[start[live] + length[live]]]
            length[live] += 1
        return start, self.place[suffix], length


def _blocks(tests: DataFrame, window: int, block_words: int) -> list[Tests]:
    """The test items in blocks of bounded size, each small enough to broadcast."""
    rows = tests.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // (6 * block_words) + 1
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        found = part.toArrow()
        if found.num_rows:
            out.append(Tests(found["item_id"].combine_chunks(), found["text"].combine_chunks(), window))
    return out


def matches(docs: DataFrame, tests: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim matches with their places, one row each: doc_id, word (of
    the document, from 0), item_id, item_word and n_words.

    A match cannot be extended to the left or right; items shorter than the
    window match as a whole.  Null texts match nothing.
    """
    out = None
    kind = dict(docs.dtypes)["doc_id"]
    for block in _blocks(tests, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def found(batches, shared=shared):
            test = shared.value
            for batch in small_batches(batches, SHARD_BYTES):
                words = Words(batch.column(1), ALNUM)
                start, place, length = Shard(words.hash, words.first, test).matches(test)
                doc = np.searchsorted(words.first, place, "right") - 1
                inner = (start > 0) & (place > words.first[doc])
                inner[inner] = (test.origin[start[inner] - 1] == test.origin[start[inner]]) & (
                    test.words[start[inner] - 1] == words.hash[place[inner] - 1])
                keep = np.flatnonzero(~inner)
                first = np.searchsorted(test.origin, test.origin[start[keep]])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc[keep])),
                    pa.array(place[keep] - words.first[doc[keep]], pa.int64()),
                    pa.array([test.ids[o] for o in test.origin[start[keep]]], pa.string()),
                    pa.array(start[keep] - first, pa.int64()), pa.array(length[keep], pa.int64()),
                ], ["doc_id", "word", "item_id", "item_word", "n_words"])

        part = docs.select("doc_id", "text").mapInArrow(
            found, f"doc_id {kind}, word long, item_id string, item_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select("doc_id", F.lit(0).cast("long").alias("word"), F.lit("").alias("item_id"),
                          F.lit(0).cast("long").alias("item_word"), F.lit(0).cast("long").alias("n_words")).limit(0)
    return out


def contaminated(
    docs: DataFrame, tests: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per row of docs: its columns, n_words, n_hit, items (sorted item_ids) and
    contaminated (n_hit > 0 and share * n_hit >= n_words).

    A document word is hit when it lies in an occurrence of a window of any item.
    All blocks of tests are searched in one pass over the texts; documents are
    never cut, so nothing has to be gathered afterwards.  Repeated rows are judged
    one by one, null item_ids count as hits but are not listed.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(tests, window, block_words)]
    columns = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    at = columns.index("text")

    def judged(batches):
        for batch in small_batches(batches, SHARD_BYTES):
            words = Words(batch.column(at), ALNUM)
            cover = np.zeros(len(words.hash) + 1, np.int64)
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for s in shared:
                test = s.value
                start, place, length = Shard(words.hash, words.first, test).matches(test)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + length, -1)
                doc = np.searchsorted(words.first, place, "right") - 1
                pairs = np.unique(doc * len(test.ids) + test.origin[start])
                for d, o in zip(pairs // max(1, len(test.ids)), pairs % max(1, len(test.ids)), strict=True):
                    if test.ids[o] is not None:
                        items[d].add(test.ids[o])
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words.counts(), pa.int64()),
                 pa.array(hit[words.first[1:]] - hit[words.first[:-1]], pa.int64()),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [*columns, "n_words", "n_hit", "items"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema)
    found = docs.select(columns).mapInArrow(judged, f"{kinds}, n_words long, n_hit long, items array<string>")
    return found.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    )

