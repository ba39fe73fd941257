"""Terms of a text with their grades, and a text's terms weighed by a small enough vocabulary.

The same tokens and grades as ``functions/text`` gives by columns; a plain loop over a
text is some ten times as fast as the chain of patterns and array functions there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import text as T

#: Terms that ride along with the texts they weigh; a larger vocabulary meets them by a join.
VOCABULARY = 2_000_000

_SPACE = r"[ \t\n\x0b\f\r]"
_TOKEN = re.compile("[a-z0-9]+")
_LEAD, _GAP = re.compile(f"^{_SPACE}+"), re.compile(rf"([.!?]){_SPACE}*|\n")
_NOTABLE, _ENTITY = re.compile(T.NOTABLE), re.compile(T.ENTITY)
_CALENDAR = frozenset(T.CALENDAR_WORDS)


def _folded(token: str) -> str:
    return token[:-1] if len(token) > 3 and token[-1] == "s" and token[-2] != "s" else token


def graded_terms(text: str, graded: bool = True) -> dict[str, int]:
    """Distinct folded terms: 2 entity-grade, 1 capitalised, 0 neither (all 0 unless ``graded``)."""
    found = dict.fromkeys(map(_folded, set(_TOKEN.findall(text.lower()))), 0)
    if graded:
        marked = T.ENTRY + _GAP.sub("\\1" + T.ENTRY, _LEAD.sub("", text))
        for occurrence in set(_NOTABLE.findall(marked)):
            term = _folded(occurrence.replace(T.ENTRY, "").lower())
            if term in found and term not in _CALENDAR:
                found[term] = max(found[term], 2 if _ENTITY.search(occurrence) else 1)
    return found


def with_cells(contents: DataFrame, graded: bool) -> DataFrame:
    """``contents`` with ``cells`` (term, grade) in place of the text; none for a null text."""
    kept = [c for c in contents.columns if c != "text"]
    kinds = dict(contents.dtypes)
    cell = pa.struct([("term", pa.string()), ("grade", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                texts = [None if x is None else x.decode("utf-8", "replace") for x in rows["text"].to_pylist()]
                found = [{} if x is None else graded_terms(x, graded) for x in texts]
                flat = pa.StructArray.from_arrays([
                    pa.array([t for f in found for t in f], pa.string()), pa.array([g for f in found for g in f.values()], pa.int32())], fields=list(cell))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays([*[rows[c] for c in kept], pa.ListArray.from_arrays(ends, flat)], [*kept, "cells"])

    raw = contents.select(*kept, contents["text"].cast("binary").alias("text"))
    return raw.mapInArrow(scan, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "cells array<struct<term:string,grade:int>>"]))


def vocabulary(df: DataFrame, most: int = VOCABULARY) -> pa.Table | None:
    """(term, df) of terms held more than once, frequent ones first, if there are at most ``most``."""
    table = df.where("df > 1").limit(most + 1).toArrow()
    return table.sort_by([("df", "descending")]).combine_chunks() if table.num_rows <= most else None


def weighed(contents: DataFrame, known: pa.Table, n: int) -> DataFrame:
    """``contents`` with cells as mass, terms (numbers in ``known``, ascending) and facts (4 * df + grade).

    known: (term, df) of every term held more than once by the ``n`` chunks.
    """
    kept = [c for c in contents.columns if c != "cells"]
    kinds = dict(contents.dtypes)
    shared = contents.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, df = (shared.value[c].combine_chunks() for c in ("term", "df"))
        df = df.to_numpy()
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch["cells"]), 0))
            cells = batch["cells"]
            row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten()
            code = pc.index_in(flat.field("term"), names).fill_null(-1).to_numpy()
            grade = flat.field("grade").to_numpy()
            idf = np.log((n + 1) / (np.where(code < 0, 1, df[code] if len(df) else 1) + 1)) + 1.0
            mass = np.bincount(row, idf, len(cells))
            order = np.lexsort((code, row))
            order = order[code[order] >= 0]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[order], minlength=len(cells)))]), pa.int32())
            number = code[order]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (number.astype(np.int32), df[number] * 4 + grade[order] if len(df) else np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(mass), *lists], [*kept, "mass", "terms", "facts"])

    return contents.mapInArrow(scan, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "mass double, terms array<int>, facts array<bigint>"]))


def _side(terms, facts) -> tuple[np.ndarray, np.ndarray]:
    """Terms once each, ascending, at their highest fact."""
    terms, facts = np.asarray(terms), np.asarray(facts)
    order = np.lexsort((facts, terms))
    terms, facts = terms[order], facts[order]
    last = np.append(terms[1:] != terms[:-1], True)[: len(terms)]
    return terms[last], facts[last]


def compared(pairs: DataFrame, n: int, ceiling: int) -> DataFrame:
    """(src, dst, score, story) of pairs that bring src_ and dst_ mass, terms and facts; score unrounded."""

    def one(r) -> tuple[float, bool]:
        (a, x), (b, y) = _side(r.src_terms, r.src_facts), _side(r.dst_terms, r.dst_facts)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        df, x, y = x[i] // 4, x[i] % 4, y[j] % 4
        rare = (df >= 2) & (df <= ceiling)
        anchored = rare & (np.maximum(x, y) == 2) & (np.minimum(x, y) >= 1)
        shared = float(np.sum(np.log((n + 1) / (df + 1)) + 1.0))
        return shared / min(r.src_mass, r.dst_mass), bool(rare.sum() >= 2 and anchored.any())

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(r) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"src": batch.src, "dst": batch.dst, "score": [float(s) for s, _ in found], "story": [t for _, t in found]})

    return pairs.mapInPandas(scan, "src string, dst string, score double, story boolean")
