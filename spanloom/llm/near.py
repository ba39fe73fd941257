"""Near duplicates: b-bit MinHash signatures and a multi-index Hamming join.

A text is a set of word shingles.  Its signature has POSITIONS minima, each cut to
16 bits; two sets of similarity s differ in about (1 - s) * POSITIONS of them, and
in more than DISTANCE with a probability of 1e-6 at the similarity asked for, less
above it.  The signature is split into CHUNKS; by pigeonhole, signatures at most
DISTANCE apart differ in at most ERRORS places of some chunk, so indexing each chunk
once per way of leaving ERRORS places out finds *every* pair within the distance.
Candidates are then confirmed on the full shingle sets.

Equal sets are folded first.  In each index bucket a star joins all members to one
of them; only members that stars leave in different components are compared with
each other.  Blocks of these meet in one task, which compares, confirms and hands
on only links that join two components, never the pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .graph import components
from .tokens import NOT_SPACE, Words, mixed, small_batches

POSITIONS = 64
CHUNKS = 15
ERRORS = 1
#: CHUNKS * (ERRORS + 1) - 1
DISTANCE = 29
BLOCK = 256
#: Shingles of a block; a longer text is a block of its own.
BLOCK_SHINGLES = 1_000_000
#: Signature pairs compared at once.
PAIRS = 50_000

_SEEDS = mixed(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and where
    each text's begin.  A shorter text is one shingle of all its words."""
    n = words.counts()
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(n)), size)
    at = words.first[:-1][text] + np.arange(first[-1]) - first[text]
    length = np.minimum(width, n)[text]
    out = length.astype(np.uint64)
    for k in range(width):
        here = np.minimum(at + k, max(0, len(words.hash) - 1))
        out = np.where(length > k, mixed(out * np.uint64(5) + words.hash[here]), out)
    order = np.lexsort((out, text))
    out = out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    text, out = text[fresh], out[fresh]
    return out, np.searchsorted(text, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of POSITIONS 16-bit values per text; zeros for an empty set."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, POSITIONS), np.uint16)
    for k in range(POSITIONS if len(full) else 0):
        least = np.minimum.reduceat((hashes ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), first[full])
        out[full, k] = mixed(least) & np.uint64(0xFFFF)
    return out


def _bounds() -> np.ndarray:
    return np.linspace(0, POSITIONS, CHUNKS + 1).round().astype(int)


def index_keys(signature: np.ndarray) -> np.ndarray:
    """All index keys of each signature: a hash per chunk and choice of ERRORS places left out."""
    bounds, wide = _bounds(), signature.astype(np.uint64) + np.uint64(1)
    keys = []
    for c in range(CHUNKS):
        places = range(bounds[c], bounds[c + 1])
        for out in combinations(places, min(ERRORS, len(places) - 1)):
            key = np.full(len(wide), np.uint64(len(keys) + 1), np.uint64)
            for p in places:
                if p not in out:
                    key = mixed(key * np.uint64(31) + wide[:, p])
            keys.append(key)
    return np.stack(keys, 1)


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(
        pa.binary(width), len(matrix), [None, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())]
    ).cast(pa.binary())


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the set and the signature."""
    kind = dict(docs.dtypes)["doc_id"]

    def sketch(batches):
        for batch in small_batches(batches):
            hashes, first = shingle_hashes(Words(batch.column(1), NOT_SPACE), width)
            prints = []
            for seed in (1, 2):
                total = np.concatenate([[0], np.cumsum(mixed(hashes + np.uint64(seed)), dtype=np.uint64)]).astype(np.uint64)
                prints.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first), pa.int64()), *map(pa.array, prints),
                 _binary(signatures(hashes, first))],
                ["doc_id", "n_shingles", "print_a", "print_b", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        sketch, f"doc_id {kind}, n_shingles long, print_a long, print_b long, signature binary"
    )


def _indexed(sets: DataFrame) -> DataFrame:
    """(key, node), one row per index key of each set."""

    def index(batches):
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            keys = index_keys(matrix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))],
                ["key", "node"],
            )

    return sets.select("node", "signature").mapInArrow(index, f"key long, node {dict(sets.dtypes)['node']}")


def _crowded(index: DataFrame) -> DataFrame:
    """Rows (key, node) of keys that several nodes have.

    Rows are sorted by key and node and read as a stream: one shuffle, and no
    bucket is ever held in memory.
    """
    kind = dict(index.dtypes)["node"]

    def several(batches):
        held = open_ = None  # the last key's row while it has one node only; else that key
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held is not None:
                key, node = np.append(held[0], key), np.append(held[1], node)
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            last = np.append(first[1:], len(key)) - 1
            shared = node[first] != node[last]
            shared[0] |= open_ is not None and key[0] == open_
            emit = shared[group] & np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            held, open_ = (None, key[-1]) if shared[-1] else ((key[-1], node[-1]), None)
            yield pa.RecordBatch.from_arrays([pa.array(key[emit]), pa.array(node[emit])], ["key", "node"])

    return index.repartition("key").sortWithinPartitions("key", "node").mapInArrow(several, f"key long, node {kind}")


def _within(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose signatures are within the distance and whose set sizes allow the similarity."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    kind = dict(sets.dtypes)["node"]

    def near(batches):
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            s_a, s_b = (_matrix(batch.column(k)) for k in (4, 5))
            keep = ((s_a != s_b).sum(1) <= DISTANCE) & (100 * np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b))
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(
        near, f"a {kind}, b {kind}")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links (a, b) among ``pairs`` (a, its centre b), confirmed on the full sets.

    A centre's members are dealt to parts of about BLOCK; each part's texts and
    the centre's come to one task, each once.
    """
    kind = dict(docs.dtypes)["node"]
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    ends = durable(placed.select("b", "part", F.explode(F.array("a", "b")).alias("node")).distinct())
    # rows that repeat a doc_id may hold other texts; a pair of any two of them counts
    texts = docs.join(ends.select(F.col("node").alias("w")).distinct(), F.col("node") == F.col("w"), "left_semi").distinct()
    sent = ends.join(texts.select("node", "text"), "node").select("b", "part", "node", "text")

    def confirm(rows):
        hashes, first = shingle_hashes(Words(rows["text"].combine_chunks(), NOT_SPACE), width)
        node, centre, size = rows["node"].to_numpy(), rows["b"][0].as_py(), np.diff(first)
        linked = np.zeros(len(node), bool)
        for h in np.flatnonzero((node == centre) & (size > 0)):
            total = np.append(0, np.cumsum(np.isin(hashes, hashes[first[h] : first[h + 1]])))
            both = total[first[1:]] - total[first[:-1]]
            linked |= (size > 0) & (100 * both >= similarity * (size + size[h] - both))
        a = np.unique(node[linked & (node != centre)])
        return pa.table({"a": pa.array(a), "b": pa.array(np.full(len(a), centre, node.dtype))})

    return sent.groupBy("b", "part").applyInArrow(confirm, f"a {kind}, b {kind}")


def _meetings(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(low, high, node, component, block): the nodes that two blocks compare.

    A node lives in one block only, among those whose most crowded bucket is its
    own; two blocks meet when some bucket has members in both, and a node is sent
    there when one of its own buckets is such.  So a pair meets exactly once,
    however many keys it shares, and a block is bounded in nodes and shingles.
    """
    homes = durable(members.groupBy("node").agg(
        F.max_by("key", F.struct("n", "key")).alias("home"), F.first("component").alias("component")))
    blocks = homes.join(sets.select("node", "n_shingles"), "node").groupBy("home").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    placed = homes.join(blocks, "home").select(
        "node", "component", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
    rows = durable(members.select("key", "node").join(placed, "node"))
    present = rows.select("key", F.col("block").alias("other")).distinct()
    return rows.join(present, "key").select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component", "block"
    ).distinct()


def _unsettled(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Rows of :func:`_meetings` that have a partner of another component within the distance.

    Signatures are compared as matrices; what leaves a task are nodes, not pairs.
    """
    kind = dict(members.dtypes)["node"]
    meeting = _meetings(members, sets).join(sets.select("node", "n_shingles", "signature"), "node").select(
        "low", "high", "node", "component", "block", "n_shingles", "signature")

    def compare(batches):
        for rows in _whole_groups(batches, ("low", "high")):
            low, high, part, block, size = (rows[c].to_numpy() for c in ("low", "high", "component", "block", "n_shingles"))
            matrix = _matrix(rows["signature"])
            first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            end = np.repeat(np.append(first[1:], len(low)), np.diff(np.append(first, len(low))))
            later = end - np.arange(len(low)) - 1  # every row meets those after it in its group
            total, wanted = np.cumsum(later), np.zeros(len(low), bool)
            for at in np.split(np.arange(len(low)), np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS))):
                x = np.repeat(at, later[at])
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[at]) - later[at], later[at])
                keep = (part[x] != part[y]) & ((low[x] == high[x]) | (block[x] != block[y]))
                keep &= 100 * np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
                x, y = x[keep], y[keep]
                near = (matrix[x] != matrix[y]).sum(1) <= DISTANCE
                wanted[x[near]] = wanted[y[near]] = True
            yield from rows.filter(pa.array(wanted)).select(list(range(5))).to_batches()

    return meeting.repartition("low", "high").sortWithinPartitions("low", "high").mapInArrow(
        compare, f"low long, high long, node {kind}, component {kind}, block long").distinct()


def _joining(rows: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links (a, b) that join components, confirmed on the full sets of ``rows`` (:func:`_unsettled`).

    Two blocks' texts come to one task, which compares and confirms: it starts
    from the known components, passes over pairs already joined, and hands on at
    most one link less than it has components, however many pairs are alike.
    """
    kind = dict(docs.dtypes)["node"]
    # rows that repeat a doc_id may hold other texts; a pair of any two of them counts
    texts = docs.join(rows.select(F.col("node").alias("w")).distinct(), F.col("node") == F.col("w"), "left_semi").distinct()

    def confirm(rows):
        hashes, first = shingle_hashes(Words(rows["text"].combine_chunks(), NOT_SPACE), width)
        matrix, size = signatures(hashes, first), np.diff(first)
        node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
        one = bool(rows["low"][0].as_py() == rows["high"][0].as_py())
        _, part = np.unique(rows["component"].to_numpy(), return_inverse=True)
        _, shingle = np.unique(hashes, return_inverse=True)
        marked = np.zeros(len(hashes) + 1, bool)
        full = np.flatnonzero(size)  # a repeated doc_id may have an empty text as well
        a, b = [], []
        for x in full:
            y = full[full > x]
            y = y[(part[y] != part[x]) & (one | (block[y] != block[x]))]
            y = y[100 * np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])]
            y = y[(matrix[y] != matrix[x]).sum(1) <= DISTANCE]
            if not len(y):
                continue
            own = shingle[first[x] : first[x + 1]]
            marked[own] = True
            both = np.array([np.count_nonzero(marked[shingle[first[k] : first[k + 1]]]) for k in y])
            marked[own] = False
            for k in y[100 * both >= similarity * (size[x] + size[y] - both)]:
                if part[k] != part[x]:
                    part[part == part[k]] = part[x]
                    a.append(x)
                    b.append(k)
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])}) if a else pa.table(
            {"a": pa.array([], rows.schema.field("node").type), "b": pa.array([], rows.schema.field("node").type)})

    return rows.join(texts, "node").groupBy("low", "high").applyInArrow(confirm, f"a {kind}, b {kind}")


def _whole_groups(batches, columns, rows: int = 4096):
    """Sorted batches as tables of at least ``rows`` rows that never part a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        if table.num_rows < rows:
            continue
        keys = [table[c].to_numpy() for c in columns]
        last = np.ones(table.num_rows, bool)
        for k in keys:
            last &= k == k[-1]
        at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if at:
            for start in _cuts(keys, at, rows):
                yield table.slice(*start)
            held = table.slice(at).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            for start in _cuts([table[c].to_numpy() for c in columns], table.num_rows, rows):
                yield table.slice(*start)


def _cuts(keys: list[np.ndarray], end: int, rows: int) -> list[tuple[int, int]]:
    """(offset, length) of pieces of about ``rows`` rows up to ``end``, cut between groups."""
    new = np.zeros(end, bool)
    for k in keys:
        new[1:] |= k[1:end] != k[: end - 1]
    starts = np.append(0, np.flatnonzero(new))
    picked = starts[np.searchsorted(starts, np.arange(0, end, rows), "left").clip(max=len(starts) - 1)]
    picked = np.unique(np.append(0, picked))
    return list(zip(picked.tolist(), np.diff(np.append(picked, end)).tolist(), strict=True))


def _weights(buckets: DataFrame) -> DataFrame:
    """(node, weight): how many nodes a node's buckets hold.

    A text that copies were made from shares more keys with them than they
    share with each other, so a star at the heaviest leaves few components.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"))
    return buckets.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's members a with its centre b, the heaviest, the least of several.

    ``members`` holds key, node and weight.
    """
    best = F.max_by("node", F.struct("weight", (-F.col("node")).alias("early")))
    centres = members.groupBy("key").agg(best.alias("centre"))
    return members.join(centres, "key").where("node <> centre").select(
        F.col("node").alias("a"), F.col("centre").alias("b")).distinct()


def grouped(docs: DataFrame, width: int = 4, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id an integer).

    Documents are linked when ``100 * intersection >= similarity * union`` of their
    sets of ``width``-word shingles (A-Z folded); component_id is the least doc_id
    reachable.  Null and wordless texts have an empty set and link with nothing.
    Rows that repeat a doc_id are judged one by one and reach the same component
    when their texts do; rows with a null doc_id are in no component (null) and
    kept.
    """
    docs = docs.select("doc_id", "text")
    base = durable(sketched(docs, width))
    full = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = durable(full.groupBy("print_a", "print_b", "n_shingles").agg(
        F.min("doc_id").alias("least"), F.min_by(F.struct("signature"), "doc_id").alias("s")
    ).select("print_a", "print_b", "n_shingles", F.col("least").alias("node"), F.col("s.signature").alias("signature")))
    buckets = durable(_crowded(_indexed(sets)))
    texts = docs.select(F.col("doc_id").alias("node"), "text")

    weights = durable(_weights(buckets))

    pairs = durable(_within(_stars(buckets.join(weights, "node")), sets, similarity))
    links = durable(_confirmed(pairs, texts, width, similarity))
    labels = durable(components(links))
    members = durable(_open(buckets, labels))
    rest = durable(_unsettled(members, sets, similarity))
    if not rest.isEmpty():
        labels = durable(components(links.unionByName(_joining(rest, texts, width, similarity))))
    of_set = sets.select("print_a", "print_b", "n_shingles", "node").join(labels, "node", "left").select(
        "print_a", "print_b", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    out = base.drop("signature").join(of_set, ["print_a", "print_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component, n) of buckets with members in several components; n is a bucket's size."""
    marked = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = marked.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")
    ).where("x < y").select("key", "n")
    return marked.join(several, "key")
