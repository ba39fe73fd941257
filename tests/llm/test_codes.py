"""Vector codes and fill-in-middle against plain versions, odd rows included."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import codes, pieces, queries


def lloyd(rows, rounds=6):
    """rows of (vec_id, vector, label); the contract, vector after vector."""
    sound = [
        r for r in rows
        if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % 8 == 0
    ]
    last = lambda k: (k is None, k or 0)
    ints = [(k, [math.floor(4096 * float(np.float32(x))) for x in v], c) for k, v, c in sound]
    if not ints:
        return []
    width = len(min(ints, key=lambda r: (last(r[0]), r[1]))[1])
    ints = [r for r in ints if len(r[1]) == width]
    step = width // 8
    least = {}
    for k, v, _ in ints:
        least[k] = min(least.get(k, v), v)
    seeds = [least[k] for k in sorted(least, key=last)[:16]]
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for v in seeds] for p in range(8)]
    near = lambda v, p: min(
        (sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[near(v, p)[1] for p in range(8)] for _, v, _ in ints]
        for p in range(8):
            for k in range(len(seeds)):
                mine = [cut(v, p) for (_, v, _), g in zip(ints, got, strict=True) if g[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [[near(v, p) for p in range(8)] for _, v, _ in ints]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, _, c), e in zip(ints, errors, strict=True):
        by_label[c] = by_label.get(c, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((k, "".join(f"{g:02x}" for _, g in f), e, by_label[c], digest) for (k, _, c), f, e in zip(ints, final, errors, strict=True)),
        key=str)


def vectors(n=300, width=16, seed=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    rows = [
        (k, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)] if k % 7 else [rng.choice((0.0, 0.5, -0.5)) for _ in range(width)],
         rng.choice((1, 2, None)))
        for k in range(n)
    ]
    return rows + [(n + k, rows[0][1], 1) for k in range(n // 3)]  # a hot vector


ODD = [
    (-1, None, 1), (-2, [], 1), (-3, [1.0, None] * 8, 1), (-4, [float("nan")] * 16, 1), (-5, [float("inf")] * 16, None),
    (9_000, [0.25] * 24, 1), (9_001, [0.1] * 7, 1), (None, [0.5] * 16, 2), (3, [-2.0] * 16, 1), (3, [-2.0] * 16, 1),
]
VECTORS = "vec_id long, embedding array<float>, label int"


def coded(spark, rows, parts=3):
    got = codes.coded(spark.createDataFrame(rows, VECTORS).repartition(parts)).drop("label")
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("leaf, block", [(16, 16_384), (1, 64), (3, 10_000)])
def test_codes(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(codes, "LEAF", leaf)
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = vectors() + ODD
    assert coded(spark, rows) == lloyd(rows)


def test_codes_of_few_and_no_rows(spark):
    few = vectors(5)
    assert coded(spark, few) == lloyd(few)
    assert coded(spark, [(None, [1.0] * 8, None)] * 3) == lloyd([(None, [1.0] * 8, None)] * 3)
    assert coded(spark, ODD[:5]) == [] and coded(spark, ODD[:1]) == []
    clashing = spark.createDataFrame(few, VECTORS).withColumns({c: F.lit(1) for c in ("v", "code", "error", "of", "rows", "n")})
    assert sorted((tuple(r) for r in codes.coded(clashing).drop("label").collect()), key=str) == lloyd(few)


def test_large_components_are_held(spark):
    rows = [(k, [3e38 if k % 2 else -3e38] * 8, 0) for k in range(4)]
    got = codes.coded(spark.createDataFrame(rows, VECTORS)).collect()
    assert [r.error for r in got] == [0] * 4


def test_trees_agree_with_exact_search_at_depth():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 1000, (6_000, 32)) * np.exp(rng.normal(0, 2, (6_000, 1)))).astype(np.int64)
    block = codes.Block(len(v), 4, codes.Block.stored(v))
    books = v[:16].reshape(16, 8, 4).transpose(1, 0, 2).copy()
    away = ((v.reshape(-1, 8, 1, 4) - books[None]) ** 2).sum(-1)
    entry, error = block.coded(books, np.full(8, 16))
    assert (entry == away.argmin(2)).all() and (error == away.min(2).sum(1)).all()
    n, sums = block.sums(books, np.full(8, 16))
    assert n.sum() == 8 * len(v) and (sums.reshape(8, 16, 4).sum(1).ravel() == v.sum(0)).all()


def test_registered_codes(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.QUERIES["op13_vector_codes"](spark, tiny)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows)


# --- fill in middle ---------------------------------------------------------------------


def filled(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    prefix, middle, suffix = t[:a], t[a:b], t[b:]
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(t), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(8)
    odd = [None, "", "x", "<", "<P", "<S><M>", "a<M>b", "\U0001f600é" * 40, "\x00\n", "<<<>>>SPM" * 30, "lang " * 30_000]
    rows = [(k, t) for k, t in enumerate(odd * 12)]
    rows += [(1000 + k, "".join(rng.choice("ab<>PSMé\U0001f600\n") for _ in range(rng.randint(0, 40)))) for k in range(600)]
    rows += [(5, "twice"), (5, "twice"), (None, "no id"), (2**62, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {c: F.lit("z") for c in ("h", "n", "form", "output")})
    got = pieces.transformed(docs).collect()
    want = [(d, *filled(d, t)[:4], hashlib.sha256(filled(d, t)[4].encode()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest(), filled(d, t)[4]) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == set(pieces.FORMS)
    back = pieces.rebuilt(pieces.transformed(docs).select("doc_id", "form", "output"))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((d or 0, t or "") for d, t in rows)
    assert pieces.transformed(docs.limit(0)).count() == 0


def test_pieces_split_and_join():
    text = memoryview(b"abcdef")
    for at in range(7):
        left, right = pieces.cut([(text, 0, 2), (text, 2, 6)], at)
        assert b"".join(pieces.read(left)) == b"abcdef"[:at] and b"".join(pieces.read(right)) == b"abcdef"[at:]


def test_registered_fill_in_middle(spark, tiny):
    out = queries.QUERIES["op12_fill_in_middle"](spark, tiny)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in out.collect():
        *plain_part, output = filled(r.doc_id, texts[r.doc_id])
        assert list(tuple(r)[1:5]) == plain_part
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
