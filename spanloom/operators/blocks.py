"""All pairs of contents that share enough, block against block.

At a low floor most texts are related through their common terms, so a join on terms
makes far more rows than there are pairs.  Contents are dealt into blocks of bounded
size instead, each stored once; each two blocks meet in one task, which reads them
from where they are stored and goes through them tile by tile: common terms as a
matrix product, the others posting by posting.  Only pairs that reach the floor leave
a task, and what is stored grows with the contents, not with the meetings.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Postings of a block; small tables are cut into up to FEW blocks all the same.
POSTINGS, FEW = 3_000_000, 6
#: Contents of a tile.
TILE = 1024
#: A term counts as common where more than 1/DENSE of a tile pair's cells hold it.
DENSE = 512
#: Terms by which the rows of a block are laid side by side.
LIKE = 3
#: Columns of a matrix, and posting pairs, at once.
WIDE, EXPANDED = 2048, 2_000_000
#: Rows of a batch handed on.
ROWS = 65_536
#: Shared rare terms are counted below this, those that anchor above.
ANCHOR = 2.0**26
#: How far rounding to six places can lift a score.
SLACK = 1e-6


class _Tile:
    """Postings of the rows ``start`` to ``end`` by term."""

    def __init__(self, start: int, end: int, first: np.ndarray, code: np.ndarray, grade: np.ndarray, n_terms: int):
        own = slice(first[start], first[end])
        order = np.argsort(code[own], kind="stable")
        self.start, self.end, self.n = start, end, end - start
        self.code, self.grade = code[own][order], grade[own][order]
        self.row = np.repeat(np.arange(self.n), np.diff(first[start : end + 1]))[order]
        self.count = np.bincount(self.code, minlength=n_terms)
        self.first = np.cumsum(self.count) - self.count

    def matrix(self, slot: np.ndarray, wide: int, value: np.ndarray) -> np.ndarray:
        """Rows by ``slot``, a column per term or -1; ``value`` is a posting's."""
        at = slot[self.code]
        out = np.zeros((self.n, wide))
        out[self.row[at >= 0], at[at >= 0]] = value[at >= 0]
        return out


def _measured(x: _Tile, y: _Tile, idf: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of rows the shared mass, and shared rare terms counted with their anchors."""
    cells = x.count * y.count
    common = cells * DENSE > x.n * y.n
    shared, told = np.zeros((x.n, y.n)), np.zeros((x.n, y.n))
    many = np.flatnonzero(common)
    for at in range(0, len(many), WIDE):
        some = many[at : at + WIDE]
        slot = np.full(len(idf), -1)
        slot[some] = np.arange(len(some))
        shared += x.matrix(slot, len(some), idf[x.code]) @ y.matrix(slot, len(some), np.ones(len(y.code))).T
        some = some[rare[some]]
        if len(some):
            slot = np.full(len(idf), -1)
            slot[some] = np.arange(len(some))
            kinds = lambda t: [t.matrix(slot, len(some), (t.grade >= g).astype(float)) for g in range(3)]  # noqa: E731, B023
            (xa, xc, xe), (ya, yc, ye) = kinds(x), kinds(y)
            told += xa @ ya.T + ANCHOR * (xe @ yc.T + xc @ ye.T)
    own = np.flatnonzero((cells > 0)[x.code] & ~common[x.code])
    partners = y.count[x.code[own]]
    total = np.cumsum(partners)
    cuts = np.searchsorted(total, np.arange(EXPANDED, total[-1], EXPANDED)) if len(own) else []
    for at in np.split(np.arange(len(own)), cuts):
        if not len(at):
            continue
        posting, n = own[at], partners[at]
        code = np.repeat(x.code[posting], n)
        other = np.arange(len(code)) - np.repeat(np.cumsum(n) - n - y.first[x.code[posting]], n)
        pair = np.repeat(x.row[posting], n) * y.n + y.row[other]
        shared += np.bincount(pair, idf[code], x.n * y.n).reshape(x.n, y.n)
        of = rare[code]
        if of.any():
            a, b = np.repeat(x.grade[posting], n)[of], y.grade[other[of]]
            anchored = (np.maximum(a, b) == 2) & (np.minimum(a, b) >= 1)
            told += np.bincount(pair[of], 1 + ANCHOR * anchored, x.n * y.n).reshape(x.n, y.n)
    return shared, told


def _ranks(ids: pa.Array, beside: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each id, equal for equal ids, and the pairs of rows that ``beside`` lists."""
    known = pc.unique(ids)
    known = known.take(pc.sort_indices(known))
    rank = pc.index_in(ids, known).to_numpy()
    row = np.repeat(np.arange(len(ids)), np.diff(beside.offsets.to_numpy()))
    at = pc.index_in(beside.flatten(), known)
    row, at = row[at.is_valid().to_numpy(zero_copy_only=False)], at.drop_null().to_numpy()
    order = np.argsort(rank, kind="stable")
    low, high = np.searchsorted(rank[order], at, "left"), np.searchsorted(rank[order], at, "right")
    n = high - low
    other = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]
    row = np.repeat(row, n)
    return rank, np.minimum(row, other), np.maximum(row, other)


def _likeness(terms: pa.ListArray) -> list[np.ndarray]:
    """Sort keys that bring rows with the same commonest terms (numbers come in that order where
    the vocabulary rides along) into the same tiles, whose terms are then common or absent."""
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.chunk(0) if terms.num_chunks else pa.array([], terms.type)
    flat, offsets = terms.flatten().to_numpy(), terms.offsets.to_numpy() - (terms.offsets[0].as_py() if len(terms) else 0)
    size = np.diff(offsets)
    keys = []
    for k in reversed(range(LIKE)):
        key = np.full(len(size), -1)
        key[size > k] = flat[offsets[:-1][size > k] + k]
        keys.append(key)
    return keys


def _met(low: pa.Table, high: pa.Table | None, floor: float, n: int, ceiling: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks' rows, or of one's; (src, dst, score, apart, beside, story) and what is carried."""
    one = high is None
    upper = np.zeros(len(low), bool) if one else np.repeat([False, True], [len(low), len(high)])
    table = low if one else pa.concat_tables([low, high])
    table = table.take(pa.array(np.lexsort((*_likeness(table["terms"].combine_chunks()), upper)))).combine_chunks()
    upper = np.sort(upper)
    column = lambda c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0)
    terms = column("terms")
    size = np.diff(terms.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    names, code = np.unique(terms.flatten().to_numpy(), return_inverse=True)
    fact = column("facts").flatten().to_numpy()
    # a term that a repeated id brings twice counts once, at its highest grade
    last = np.append((code[1:] != code[:-1]) | (row[1:] != row[:-1]), True)[: len(code)]
    row, code, fact = row[last], code[last], fact[last]
    first = np.searchsorted(row, np.arange(len(size) + 1))
    df = np.zeros(len(names), np.int64)
    df[code] = fact // 4
    idf, rare, grade = np.log((n + 1) / (df + 1)) + 1.0, (df >= 2) & (df <= ceiling), (fact % 4).astype(np.int8)
    mass, own = column("mass").to_numpy(), column("own").to_numpy()
    rank, p, q = _ranks(column("chunk_id"), column("beside"))
    repeated = len(np.unique(rank)) < len(rank)
    middle = len(size) if one else int(np.count_nonzero(~upper))
    spans = [(a, min(a + TILE, middle)) for a in range(0, middle, TILE)]
    n_low = len(spans)
    spans += [(a, min(a + TILE, len(size))) for a in range(middle, len(size), TILE)]
    tiles = [_Tile(*s, first, code, grade, len(names)) for s in spans]
    home = np.repeat(np.arange(len(spans)), [b - a for a, b in spans])
    of = home[p] * len(spans) + home[q]
    order = np.argsort(of, kind="stable")
    p, q, of = p[order], q[order], of[order]
    for s, x in enumerate(tiles[:n_low]):
        for t in range(s, n_low) if one else range(n_low, len(tiles)):
            y = tiles[t]
            shared, told = _measured(x, y, idf, rare)
            x_mass, y_mass = mass[x.start : x.end, None], mass[None, y.start : y.end]
            score = shared / np.minimum(x_mass, y_mass)
            wanted = (score >= floor - SLACK) & (shared > 0)
            marked = slice(*np.searchsorted(of, [s * len(spans) + t, s * len(spans) + t + 1]))
            beside = np.zeros(wanted.shape, bool)
            beside[p[marked] - x.start, q[marked] - y.start] = True
            wanted |= beside
            if s == t:
                wanted = np.triu(wanted, 1)
            if repeated:
                wanted &= (rank[x.start : x.end, None] != rank[None, y.start : y.end]) | (x_mass != y_mass)
            i, j = np.nonzero(wanted)
            a, b = i + x.start, j + y.start
            apart = shared[i, j] / np.minimum(mass[a] * own[a], mass[b] * own[b])
            swap = rank[a] > rank[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            rest = [score[i, j], apart, beside[i, j], (told[i, j] % ANCHOR >= 2) & (told[i, j] >= ANCHOR)]
            for at in range(0, len(a), ROWS):
                piece = slice(at, at + ROWS)
                src, dst = pa.array(a[piece]), pa.array(b[piece])
                yield pa.RecordBatch.from_arrays(
                    [column("chunk_id").take(src), column("chunk_id").take(dst), *[pa.array(c[piece]) for c in rest]]
                    + [column(c).take(k) for c in carried for k in (src, dst)],
                    ["src", "dst", "score", "apart", "beside", "story", *[f"{k}_{c}" for c in carried for k in ("src", "dst")]],
                )


def _joined(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` with equal ids."""
    known = pc.unique(left)
    mine, theirs = (pc.index_in(x, known).fill_null(-1).to_numpy() for x in (left, right))
    order = np.argsort(theirs, kind="stable")
    low, high = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(mine)), n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]


def _stored(rows: DataFrame, blocks: int, of_docs: list[str], of_sides: list[str]) -> DataFrame:
    """Blocks as partitions of a checkpoint, each a row of compressed bytes: the rows of
    ``rows`` with ``doc``, beside the others of the same chunk_id if there are any."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batch) if (batch := list(batches)) else None
        if table is None or not len(table):
            return
        docs = table.filter(table["doc"]).select(of_docs).combine_chunks()
        if of_sides:
            sides = table.filter(pc.invert(table["doc"])).select(["chunk_id", *of_sides]).combine_chunks()
            i, j = _joined(*(x["chunk_id"].combine_chunks() for x in (docs, sides)))
            docs, sides = docs.take(pa.array(i)), sides.take(pa.array(j))
            for c in of_sides:
                docs = docs.append_column(c, sides[c])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(docs)
        yield pa.RecordBatch.from_arrays([table["block"].chunk(0)[:1], pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "body"])

    return durable(rows.repartitionById(blocks, "block").mapInArrow(pack, "block int, body binary"))


def _each_two(stored: DataFrame, blocks: int) -> DataFrame:
    """(a, a_body, b, b_body) of each two blocks and of each with itself, a partition each, read
    from the checkpoint: a product of its partitions without those that would be its lower half."""
    spark = stored.sparkSession
    left, right = (stored.select(F.col("block").alias(k), F.col("body").alias(f"{k}_body")) for k in "ab")
    both = left.crossJoin(right.hint("shuffle_replicate_nl"))
    product = both._jdf.queryExecution().toRdd()
    if product.getNumPartitions() != blocks * blocks:
        raise RuntimeError("the blocks are not met partition by partition")
    upper = spark._jvm.java.util.HashSet()
    for a in range(blocks):
        for b in range(a, blocks):
            upper.add(a * blocks + b)
    wanted = spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(upper).toSet()
    kept = spark._jvm.org.apache.spark.rdd.PartitionPruningRDD.create(product, wanted)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept, both._jdf.schema(), False), spark)


def met(
    docs: DataFrame, floor: float, n: int, ceiling: int, carried: list[str], sides: DataFrame | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """Pairs of ``docs`` that share ``floor`` of the lighter mass, or that ``beside`` lists.

    docs: chunk_id, mass, terms (ascending numbers) and facts (4 * df + grade of each);
    sides: chunk_id, own (rows that bear the id), beside (chunk_ids), any number of rows for an
    id, each of which stands beside each of ``docs`` (none: one for each, own 1, nothing beside).
    sizes: chunk_id, held (number of terms) of ``docs`` where they are known already.
    The ``carried`` columns of either come back as src_ and dst_; n: all chunks; ceiling: df
    up to which a term is rare.  The score is unrounded, so pairs up to SLACK below the floor
    come along; ``apart`` is the score when each row of an id brings its mass; story: at least
    two rare terms are shared, one entity-grade on one side and capitalised on the other.
    """
    docs = docs.where("chunk_id IS NOT NULL")
    of_docs = ["chunk_id", "mass", "terms", "facts", *[c for c in carried if c in docs.columns]]
    of_sides = ["own", "beside", *[c for c in carried if c not in docs.columns]] if sides is not None else []
    kinds = dict(docs.dtypes) | dict(sides.dtypes if sides is not None else [])
    held, times = docs.select("chunk_id", F.size("terms").alias("held")) if sizes is None else sizes.where("chunk_id IS NOT NULL"), F.lit(1)
    if sides is not None:
        held, times = held.join(sides.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("times")), "chunk_id"), F.col("times")
    total = held.agg(F.sum(F.col("held") * times)).first()[0] or 0
    blocks = max(ceil(total / POSTINGS), min(FEW, ceil(total / 100_000)), 1)
    rows = docs.select(F.lit(True).alias("doc"), *of_docs)
    if sides is not None:
        rows = rows.unionByName(sides.where("chunk_id IS NOT NULL").select(F.lit(False).alias("doc"), "chunk_id", *of_sides), allowMissingColumns=True)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    stored = _stored(rows, blocks, of_docs, of_sides)

    def opened(body: pa.BinaryScalar) -> pa.Table:
        table = pa.ipc.open_stream(body.as_buffer()).read_all()
        if "own" not in table.column_names:
            table = table.append_column("own", pa.array(np.ones(len(table), np.int64)))
            table = table.append_column("beside", pa.array([[]] * len(table), pa.list_(pa.string())))
        return table

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, b, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                low, high = opened(x), None if a == b else opened(y)
                if len(low) and (high is None or len(high)):
                    yield from _met(low, high, floor, n, ceiling, carried)

    fields = ["src string, dst string, score double, apart double, beside boolean, story boolean"]
    fields += [f"{k}_{c} {kinds[c]}" for c in carried for k in ("src", "dst")]
    return _each_two(stored, blocks).mapInArrow(meet, ", ".join(fields))
