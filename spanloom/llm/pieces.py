"""Fill-in-middle by piece tables.

A document is a table of descriptors (buffer, start, end) over immutable buffers:
its own UTF-8 bytes and the sentinels.  Cutting splits descriptors, an arrangement
permutes them and sets sentinels between them, the inverse permutation restores the
document, and hashes read descriptor after descriptor, so no arrangement is copied
to be hashed.  Documents are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .tokens import small_batches, text_bytes

#: The sentinels, and what stands where in each arrangement.
SENTINELS = (b"<P>", b"<S>", b"<M>")
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
ORDER = {
    "psm": ((b"<P>", PREFIX), (b"<S>", SUFFIX), (b"<M>", MIDDLE)),
    "spm": ((b"<S>", SUFFIX), (b"<P>", PREFIX), (b"<M>", MIDDLE)),
}
FORMS = ("plain", "psm", "spm")

Piece = tuple[memoryview, int, int]


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and behind byte ``at``; a piece it falls into is split."""
    left: list[Piece] = []
    for k, (buffer, start, end) in enumerate(pieces):
        if at < end - start:
            return [*left, (buffer, start, start + at)], [(buffer, start + at, end), *pieces[k + 1 :]]
        left.append((buffer, start, end))
        at -= end - start
    return left, []


def arranged(parts: tuple[list[Piece], ...], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
    out: list[Piece] = []
    for sentinel, part in ORDER[form]:
        out += [(memoryview(sentinel), 0, len(sentinel)), *parts[part]]
    return out


def restored(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that spell the document ``form`` was made of.

    Each sentinel stands once: no document with one is arranged, and a piece and a
    sentinel can't make another between them.
    """
    whole = memoryview(output)
    if form == "plain":
        return [(whole, 0, len(output))]
    places = [output.index(sentinel) for sentinel, _ in ORDER[form]] + [len(output)]
    parts: list[Piece] = [(whole, 0, 0)] * 3
    for k, (sentinel, part) in enumerate(ORDER[form]):
        parts[part] = (whole, places[k] + len(sentinel), places[k + 1])
    return parts


def read(pieces: list[Piece]) -> Iterator[memoryview]:
    return (buffer[start:end] for buffer, start, end in pieces)


def digest(pieces: list[Piece]) -> str:
    state = hashlib.sha256()
    for run in read(pieces):
        state.update(run)
    return state.hexdigest()


def draws(seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers of a row, from its doc_id (null: as if empty)."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _byte_places(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The byte at which code point ``chars`` of text ``row`` starts, from the text's start."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(starts, offsets)
    at = first[row] + chars
    return np.where(at < first[row + 1], np.append(starts, len(data))[np.minimum(at, len(starts))], offsets[row + 1]) - offsets[row]


def _planned(column: pa.Array, h: np.ndarray, rate: int, spm: int):
    """Per row: its piece (the whole text), code points, form and the bytes and code points of both cuts."""
    data, offsets = text_bytes(column)
    n = np.add.reduceat(np.append((data & 0xC0) != 0x80, False).astype(np.int64), offsets[:-1]) if len(column) else np.zeros(0, np.int64)
    n[offsets[1:] == offsets[:-1]] = 0
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    rows = np.arange(len(column))
    places = [_byte_places(data, offsets, rows, cuts[:, k]).tolist() for k in (0, 1)]
    buffer = memoryview(data.tobytes())
    for k, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = bytes(buffer[start:end])
        plain = not text or any(s in text for s in SENTINELS) or h[k, 2] % 100 >= rate
        form = "plain" if plain else "spm" if h[k, 3] % 100 < spm else "psm"
        yield memoryview(text), int(n[k]), form, [p[k] for p in places], cuts[k].tolist()


def transformed(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, output: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and
    (``output``) the arranged text, one row per row of ``docs`` (doc_id, text).

    ``rate`` per cent of the documents are arranged, ``spm`` per cent of these with
    the suffix first.  A null text is empty, an empty text and one that holds a
    sentinel is plain; rows that repeat a doc_id draw alike; a null doc_id draws as
    an empty id.  Other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if output:
        names.append("output")
        types.append(pa.string())

    def arrange(batches):
        for batch in small_batches(batches):
            h = np.array(batch.column(2).to_pylist(), np.int64).reshape(-1, 4)
            rows = []
            for text, n, form, (a, b), (ca, cb) in _planned(batch.column(1), h, rate, spm):
                pieces = [(text, 0, len(text))]
                if form != "plain":
                    left, suffix = cut(pieces, b)
                    prefix, middle = cut(left, a)
                    pieces = arranged((prefix, middle, suffix), form)
                spelled = b"".join(read(pieces))
                row = [n, form, *((None, None) if form == "plain" else (ca, cb - ca)), digest(pieces), digest(restored(spelled, form))]
                rows.append([*row, spelled.decode()] if output else row)
            columns = zip(zip(*rows, strict=True), types[1:], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in columns)], names)

    fields = [f"doc_id {kind}", "n long", "form string", "prefix_chars long", "middle_chars long", "output_sha256 string",
              "restored_sha256 string", *(["output string"] if output else [])]
    return docs.select("doc_id", "text", draws(seed).alias("h")).mapInArrow(arrange, ", ".join(fields))


def rebuilt(arranged_docs: DataFrame) -> DataFrame:
    """``arranged_docs`` (output, form and any other columns but text) with ``text``, the
    document each output was made of; a null output has a null text, a null form is plain."""
    schema = arranged_docs.schema
    at = {name: schema.fieldNames().index(name) for name in ("output", "form")}

    def rebuild(batches):
        for batch in small_batches(batches):
            outputs, forms = (batch.column(at[c]).to_pylist() for c in ("output", "form"))
            texts = [
                None if o is None else b"".join(read(restored(o.encode(), f or "plain"))).decode()
                for o, f in zip(outputs, forms, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*schema.fieldNames(), "text"])

    return arranged_docs.mapInArrow(rebuild, StructType([*schema.fields, StructField("text", StringType())]))
