"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line goes when an earlier line of the corpus (by doc_id, then place in the text)
equals it or is one insertion, deletion or substitution of a code point away.

Two lines within one edit share a variant with at most one code point deleted, so
joining equal variant hashes finds all pairs.  Equal lines are folded to one
first, and variants are emitted only for lines that can have a partner: of two
lines within one edit, the shorter of length q, either the first q/2 or the last q/2
code points agree, so a line whose halves occur nowhere else has none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, durable
from .tokens import mixed, powers, small_batches

#: Lines that may have a partner are broadcast up to this many (four numbers each), else joined by shuffle.
LIKELY_ROWS = 500_000
_BLANK = re.compile(r"[\x20\x09-\x0D]*")
WORD = r"[^\x20\x09-\x0D]"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the row's text), line (its number from 0), text
    and two hashes of every line with a word."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
        .where(F.regexp_like("text", F.lit(WORD)))
        .withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    )


def half_keys(text: Column, length: Column) -> Column:
    """Hashes of the beginning and end for the line as the longer and as the shorter of a pair."""
    keys = []
    for q in (length, length - 1):
        half = (q / 2).cast("int")
        keys += [
            F.xxhash64(F.lit("b"), q, F.substr(text, F.lit(1), half)),
            F.xxhash64(F.lit("e"), q, F.substr(text, length - half + 1, half)),
        ]
    return F.array(keys)


def variant_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the line itself and of the line without each of its code points, distinct."""
    up, down = powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=prefix[1:])
    whole, size = prefix[-1:], np.uint64(len(codes))
    without = prefix[:-1] + (whole - prefix[1:]) * down[1:2]
    return np.unique(np.concatenate([mixed(whole + size), mixed(without + (size - np.uint64(len(codes) > 0)))]))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, h1, h2) for every variant of lines (h1, h2, text)."""

    def emit(batches):
        for batch in small_batches(batches, 1 << 20):
            found = [
                variant_hashes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
                for t in batch.column(2).to_pylist()
            ]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)],
                ["key", "h1", "h2"],
            )

    return lines.select("h1", "h2", "text").mapInArrow(emit, "key long, h1 long, h2 long")


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, version and removed, the numbers of a row's lines that go; rows
    that keep all their lines are absent."""
    lines = occurrences(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")
    halves = half_keys(F.col("text"), F.length("text"))
    narrow = durable(lines.select("doc_id", "version", "line", "h1", "h2", halves.alias("halves")))
    firsts = durable(
        narrow.groupBy("h1", "h2", *[F.col("halves")[k].alias(f"half{k}") for k in range(4)]).agg(F.min(place).alias("first"))
    )
    keys = firsts.select("h1", "h2", F.explode(F.array(*[f"half{k}" for k in range(4)])).alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    likely = keys.join(shared, "half").select("h1", "h2").distinct()
    # the text of each such line, from its first place
    at = durable(firsts.join(likely, ["h1", "h2"]).select(
        "h1", "h2", F.col("first.doc_id").alias("d"), F.col("first.line").alias("n")))
    at = checked_broadcast(at, LIKELY_ROWS)
    texts = durable(
        lines.select("doc_id", "line", F.col("h1").alias("g1"), F.col("h2").alias("g2"), "text")
        .join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line") == F.col("n"))
              & (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")))
        .select("h1", "h2", place.alias("first"), "text").dropDuplicates(["h1", "h2"])
    )
    variants = _variants(texts)
    several = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = durable(variants.join(several, "key"))
    a, b = met.alias("a"), met.alias("b")
    pairs = a.join(b, "key").where("(a.h1, a.h2) < (b.h1, b.h2)").selectExpr(
        "a.h1 AS a1", "a.h2 AS a2", "b.h1 AS b1", "b.h2 AS b2").distinct()
    side = lambda x: texts.select(
        F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("first").alias(f"first_{x}"), F.col("text").alias(f"text_{x}"))
    near = (
        pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
        .where(F.levenshtein("text_a", "text_b", 1) >= 0)
        .select(F.when(F.col("first_a") > F.col("first_b"), F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")))
                .when(F.col("first_b") > F.col("first_a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).alias("late"))
        .where("late IS NOT NULL").select("late.h1", "late.h2").distinct().withColumn("near", F.lit(True))
    )
    kept = firsts.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    gone = narrow.select("doc_id", "version", "line", "h1", "h2").join(kept, ["h1", "h2"]).where(
        F.coalesce("near", F.lit(False)) | (place != F.col("first"))
    )
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with what is left of text, and n_lines and n_removed.

    n_lines counts lines with a word; others are never removed.  Lines are
    judged on the input: a removed line still stands for later ones.  A null text
    stays null.  Rows that repeat a doc_id with the same text count as one
    document (their copies of a kept line stay); a null doc_id comes after all others.
    """
    gone = decisions(docs).select(F.col("doc_id").alias("__d"), F.col("version").alias("__v"), F.col("removed").alias("__r"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(columns).withColumn("__w", F.xxhash64("text")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__w") == F.col("__v")), "left"
    ).select(*columns, "__r")
    at = columns.index("text")

    def rebuilt(batches):
        for batch in small_batches(batches):
            texts, left, kept, n_lines = batch.column(at).to_pylist(), [], [], []
            gone = batch.column(len(columns)).to_pylist()
            for text, out in zip(texts, gone, strict=True):
                lines = text.split("\n") if text is not None else []
                n_lines.append(sum(not _BLANK.fullmatch(x) for x in lines))
                kept.append(len(out or ()))
                if out:
                    dropped = set(out)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in dropped)
                left.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.string()) if k == at else batch.column(k) for k in range(len(columns))]
                + [pa.array(n_lines, pa.int64()), pa.array(kept, pa.int64())],
                [*columns, "n_lines", "n_removed"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema)
    return joined.mapInArrow(rebuilt, f"{kinds}, n_lines long, n_removed long")
