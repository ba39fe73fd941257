"""Vector codes: product quantisation by Lloyd rounds over cover trees.

Components become integers, so sums, ties and results do not depend on how the
rows are dealt out.  Every block of rows builds one cover tree per part position,
once: a cell of radius r splits into cells of radius r / 2 around points of its own
that lie farther than r / 2 apart.  The points of a cell stand next to each other,
so a cumulative sum gives the sum of any cell.  A round sends the codebooks to the
blocks; a cell goes whole to an entry that is nearer than all others for every point
it may hold (triangle inequality), cells in doubt open, and points left over are
compared exactly.  Per round Spark adds up at most 8 x 16 sums a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checked_broadcast, durable

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components beyond this count as this, so that squared distances and sums stay within 64 bits.
LIMIT = 1 << 27
#: Rows of one block, components of one block, and points up to which a cell stays whole.
BLOCK = 16_384
BLOCK_COMPONENTS = 1 << 22
LEAF = 16


# --- one block ----------------------------------------------------------------------


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


class Cells:
    """The cover trees of all parts of one block.

    ``points`` (int64, one row per part and distinct subvector), in tree order;
    ``mass`` rows of the block at each; cell c holds points first[c]:last[c] within
    ``radius[c]`` of points[centre[c]]; its children are cells child[c]:child_end[c].
    """

    def __init__(self, points: np.ndarray, part: np.ndarray):
        n = len(points)
        order = np.arange(n)                       # points in tree order so far
        first = np.searchsorted(part, np.arange(PARTS))
        last = np.searchsorted(part, np.arange(PARTS), "right")
        centre = first.copy()                      # in input numbers
        owner = part.copy()                        # cell of each place of ``order``
        radius = self._spread(points, order, centre, owner, PARTS)
        cells = [(first, last, centre, radius)]
        child = [np.zeros(PARTS, np.int64)]
        child_end = [np.zeros(PARTS, np.int64)]
        total, here = PARTS, 0                     # cells so far, number of the level's first
        while True:
            first, last, centre, radius = cells[-1]
            splits = (last - first > LEAF) & (radius > 0)
            if not splits.any():
                break
            places = np.flatnonzero(owner >= here)
            places = places[splits[owner[places] - here]]
            member, parent = order[places], owner[places] - here
            new, centres, parents = self._divided(points, member, parent, centre, radius)
            again = np.argsort(new, kind="stable")  # children of a parent are numbered in a row
            order[places] = member[again]
            owner[places] = new[again] + total
            at = np.searchsorted(new[again], np.arange(len(centres)))
            to = np.searchsorted(new[again], np.arange(len(centres)), "right")
            child[-1][:] = total + np.searchsorted(parents, np.arange(len(first)))
            child_end[-1][:] = total + np.searchsorted(parents, np.arange(len(first)), "right")
            here, total = total, total + len(centres)
            spread = self._spread(points, order[places], centres, new[again], len(centres))
            cells.append((places[at], places[to - 1] + 1, centres, spread))
            child.append(np.zeros(len(centres), np.int64))
            child_end.append(np.zeros(len(centres), np.int64))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.order = order
        self.first, self.last = (np.concatenate([c[k] for c in cells]) for k in (0, 1))
        self.centre = rank[np.concatenate([c[2] for c in cells])]
        self.radius = np.concatenate([c[3] for c in cells])
        self.child, self.child_end = np.concatenate(child), np.concatenate(child_end)

    @staticmethod
    def _spread(points, member, centre, cell, cells) -> np.ndarray:
        far = np.zeros(cells)
        np.maximum.at(far, cell, np.sqrt(_squares(points[member], points[centre[cell]]).astype(np.float64)))
        return far

    @staticmethod
    def _divided(points, member, parent, centre, radius):
        """(new cell of each member, centre of each cell, parent of each cell), cells by
        parent.  In every turn each parent with uncovered points opens one more cell, at
        its own centre first and then at the first uncovered point."""
        bound = (radius / 2) ** 2
        open_ = np.arange(len(member))
        cell = np.full(len(member), -1, np.int64)
        turn_centre, turn_parent = [], []
        count = 0
        while len(open_):
            owners = parent[open_]
            heads = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            seeds = member[open_[heads]] if count else centre[owners[heads]]
            of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(owners))))
            near = _squares(points[member[open_]], points[seeds[of]]) <= bound[owners]
            if count:
                near[heads] = True
            cell[open_[near]] = count + of[near]
            turn_centre.append(seeds)
            turn_parent.append(owners[heads])
            count += len(heads)
            open_ = open_[~near]
        centres, parents = np.concatenate(turn_centre), np.concatenate(turn_parent)
        by = np.argsort(parents, kind="stable")
        number = np.empty(count, np.int64)
        number[by] = np.arange(count)
        return number[cell], centres[by], parents[by]


def _distinct(vectors: np.ndarray):
    """Distinct subvectors by part: (points, part, which point each row has in each part)."""
    rows, width = vectors.shape[0], vectors.shape[1] // PARTS
    points, parts, which, so_far = [], [], np.empty((PARTS, rows), np.int64), 0
    for p in range(PARTS):
        own, back = np.unique(vectors[:, p * width : (p + 1) * width], axis=0, return_inverse=True)
        which[p] = back.ravel() + so_far
        points.append(own)
        parts.append(np.full(len(own), p))
        so_far += len(own)
    return np.concatenate(points), np.concatenate(parts), which


class Block:
    """A block's trees and cumulative sums, read back from its stored columns."""

    def __init__(self, rows: int, width: int, stored: dict[str, bytes]):
        get = lambda name, kind: np.frombuffer(stored[name], kind)
        self.points = get("points", np.int32).astype(np.int64).reshape(-1, width)
        self.part = get("part", np.int8)
        self.which = get("which", np.int32).reshape(PARTS, rows)
        self.first, self.last, self.centre, self.child, self.child_end = get("cells", np.int32).astype(np.int64).reshape(5, -1)
        self.radius = get("radius", np.float64)

    @staticmethod
    def stored(vectors: np.ndarray) -> dict[str, bytes]:
        points, part, which = _distinct(vectors)
        tree = Cells(points, part)
        rank = np.empty(len(points), np.int32)
        rank[tree.order] = np.arange(len(points))
        cells = np.stack([tree.first, tree.last, tree.centre, tree.child, tree.child_end])
        return {
            "points": points[tree.order].astype(np.int32).tobytes(), "part": part.astype(np.int8).tobytes(),
            "which": rank[which].tobytes(), "cells": cells.astype(np.int32).tobytes(), "radius": tree.radius.tobytes(),
        }

    def nearest(self, books: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of every point: books is part x entry x position, ``sizes`` entries a part."""
        out = np.zeros(len(self.points), np.int64)
        entry = np.arange(books.shape[1])
        now = np.arange(PARTS)
        now = now[self.last[now] > self.first[now]]
        while len(now):
            part = self.part[self.first[now]]
            away = np.sqrt(_squares(self.points[self.centre[now]][:, None], books[part]).astype(np.float64))
            away[entry[None] >= sizes[part][:, None]] = np.inf
            best = away.argmin(1)
            least = away[np.arange(len(now)), best]
            away[np.arange(len(now)), best] = np.inf
            # strictly nearer than any other for every point of the cell, rounding allowed for
            sure = (least + self.radius[now]) * (1 + 1e-9) < (away.min(1) - self.radius[now]) * (1 - 1e-9)
            self._fill(out, now[sure], best[sure])
            doubt = now[~sure]
            leaf = doubt[self.child_end[doubt] == self.child[doubt]]
            at = _ranges(self.first[leaf], self.last[leaf])
            exact = _squares(self.points[at][:, None], books[self.part[at]])
            exact[entry[None] >= sizes[self.part[at]][:, None]] = np.iinfo(np.int64).max
            out[at] = exact.argmin(1)
            now = _ranges(self.child[doubt], self.child_end[doubt])
        return out

    def _fill(self, out, cells, entries) -> None:
        at = _ranges(self.first[cells], self.last[cells])
        out[at] = np.repeat(entries, self.last[cells] - self.first[cells])

    def sums(self, books: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, component sums) per part and entry, from differences of cumulative sums."""
        entry = self.nearest(books, sizes)
        mass = np.bincount(self.which.ravel(), minlength=len(self.points)).astype(np.int64)
        total = np.zeros((len(self.points) + 1, self.points.shape[1] + 1), np.int64)
        np.cumsum(np.column_stack([mass, self.points * mass[:, None]]), axis=0, out=total[1:])
        key = self.part.astype(np.int64) * books.shape[1] + entry
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        runs = total[np.append(edge[1:], len(key))] - total[edge]
        out = np.zeros((PARTS * books.shape[1], runs.shape[1]), np.int64)
        np.add.at(out, key[edge], runs)
        return out[:, 0], out[:, 1:]

    def coded(self, books: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of every row by part, squared distance of every row)."""
        entry = self.nearest(books, sizes)
        error = _squares(self.points, books[self.part, entry])
        return entry[self.which].T, error[self.which].sum(0)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of start[0]:end[0], start[1]:end[1], ..."""
    size = end - start
    return np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


# --- the job ------------------------------------------------------------------------


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector as integers ``v``, of rows without a null or
    non-finite component whose length is that of the first row and a multiple of 8."""
    value = F.col("embedding").cast("array<double>")
    sound = ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(value) > 0) & (F.size(value) % PARTS == 0)
    whole = F.transform(
        value, lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    )
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def _first(rows: DataFrame) -> list[list[int]]:
    """The vectors of the 16 smallest ids, nulls last; of equal ids the least vector.
    Every task hands on its own 16, so vectors are not shuffled."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def least(batches):
        best: dict = {}
        for batch in batches:
            ids = batch.column("vec_id")
            held = pc.unique(pa.concat_arrays([ids, pa.array(list(best), ids.type)]))
            lead = held.take(pc.sort_indices(held)[:ENTRIES])  # nulls come last
            near = batch.filter(pc.is_in(ids, lead))
            for k, v in zip(near.column("vec_id").to_pylist(), near.column("v").to_pylist(), strict=True):
                best[k] = min(best.get(k, v), v)
            best = {k: best[k] for k in lead.to_pylist()}
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), rows_type), pa.array(list(best.values()), pa.list_(pa.int32()))], ["vec_id", "v"])

    rows_type = to_arrow_type(rows.schema["vec_id"].dataType)
    per_id = rows.select("vec_id", "v").mapInArrow(least, f"vec_id {kind}, v array<int>").groupBy("vec_id").agg(F.min("v").alias("v"))
    return [list(r.v) for r in per_id.orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    most = max(1, min(BLOCK, BLOCK_COMPONENTS // width))
    ids, labels = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def build(batches):
        waiting: list[pa.RecordBatch] = []

        def block():
            held = pa.Table.from_batches(waiting).combine_chunks()
            vectors = held.column("v").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, width)
            stored = Block.stored(vectors)
            one = lambda c: pa.array([held.column(c).to_pylist()], pa.list_(held.schema.field(c).type))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(vectors)], pa.int32()), one("vec_id"), one("label"), *(pa.array([b], pa.binary()) for b in stored.values())],
                ["rows", "vec_ids", "labels", *stored],
            )

        for batch in batches:
            while batch.num_rows:
                room = most - sum(b.num_rows for b in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in waiting) == most:
                    yield block()
                    waiting = []
        if waiting:
            yield block()

    return rows.mapInArrow(
        build, f"rows int, vec_ids array<{ids}>, labels array<{labels}>, points binary, part binary, which binary, cells binary, radius binary"
    )


STORED = ("points", "part", "which", "cells", "radius")


def _opened(batch: pa.RecordBatch, width: int):
    for k in range(batch.num_rows):
        yield k, Block(batch.column("rows")[k].as_py(), width // PARTS, {c: batch.column(c)[k].as_py() for c in STORED})


def _round(blocks: DataFrame, books: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The codebooks of the next round; unused entries stay."""
    size = books.shape[1]

    def tally(batches):
        n = np.zeros(PARTS * size, np.int64)
        sums = np.zeros((PARTS * size, width // PARTS), np.int64)
        for batch in batches:
            for _, block in _opened(batch, width):
                more_n, more = block.sums(books, sizes)
                n += more_n
                sums += more
        key = np.flatnonzero(n)
        position = np.tile(np.arange(width // PARTS), len(key))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(key, width // PARTS)), pa.array(position), pa.array(np.repeat(n[key], width // PARTS)), pa.array(sums[key].ravel())],
            ["key", "position", "n", "total"],
        )

    means = (
        blocks.select("rows", *STORED).mapInArrow(tally, "key long, position long, n long, total long")
        .groupBy("key", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    )  # at most parts x entries x positions rows, whatever the input
    out = books.copy()
    for key, position, n, total in means:
        out[key // size, key % size, position] = total // n
    return out


def coded(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept row of
    ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null, empty, of a length that is no multiple of 8 or not that
    of the smallest kept id, or holds a null or non-finite component are left out.
    Repeated rows all count and are all returned; null ids come after all others for the
    first codebooks; fewer than 16 ids make fewer entries; components are held within
    +-2**27; an empty table gives no rows.  Other columns are not read.
    """
    rows = kept(vectors)
    lead = rows.where("vec_id IS NOT NULL").agg(F.min(F.struct("vec_id", "v")).alias("m")).first().m or (
        rows.agg(F.min(F.struct("v")).alias("m")).first().m)
    if lead is None:
        return rows.select(
            "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"),
        ).limit(0)
    width = len(lead.v)
    rows = rows.where(F.size("v") == width)
    seeds = np.array(_first(rows), np.int64).reshape(-1, PARTS, width // PARTS)
    books = seeds.transpose(1, 0, 2).copy()
    sizes = np.full(PARTS, books.shape[1])
    blocks = durable(_blocks(rows, width))
    for _ in range(rounds):
        books = _round(blocks, books, sizes, width)
    ids, labels = (blocks.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels"))
    digits = np.array([f"{k:02x}" for k in range(256)])

    def code(batches):
        for batch in batches:
            for k, block in _opened(batch, width):
                entry, error = block.coded(books, sizes)
                text = digits[entry[:, 0]]
                for p in range(1, PARTS):
                    text = np.char.add(text, digits[entry[:, p]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_ids").slice(k, 1).flatten(), batch.column("labels").slice(k, 1).flatten(),
                     pa.array(text.tolist(), pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    out = blocks.mapInArrow(code, f"vec_id {ids}, label {labels}, code string, error long")
    per_label = checked_broadcast(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    spelled = ",".join(map(str, books.ravel().tolist()))
    return out.join(per_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of").withColumn(
        "codebooks_sha256", F.lit(hashlib.sha256(spelled.encode()).hexdigest())
    )
