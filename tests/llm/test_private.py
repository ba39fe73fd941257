"""Personal data: base finds and disclosing terms against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import plain
from spanloom.llm import private, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = [*PATTERNS, "term"]
ANY = "|".join((r"(?<![A-Za-z0-9._%+-])" + PATTERNS["email"], "(?<![0-9])" + PATTERNS["ip"], r"[0-9](?:[\x20-]?[0-9]){11,}", PATTERNS["phone"]))


def luhn(digits):
    worth = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in worth) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    spans = [
        (m.start(), ORDER.index(k), m.end(), m[0])
        for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])
    ]
    return sorted(spans)


def spelled(spans):
    return ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b, *_ in spans)


def words(text, spans):
    return [
        (m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text or "")
        if not any(s[0] < m.end() and m.start() < s[2] for s in spans)
    ]


def entity(span):
    _, k, _, v = span
    digits = re.sub("[^0-9]", "", v)
    name = v.lower() if k == 0 else v if k == 1 else digits
    general = (v.lower().split("@")[-1], v.rsplit(".", 1)[0], digits[:6], digits[:-7])[k]
    return (k, name), (k, general)


def told(texts):
    """{term: (chance, action)} by the definitions, text after text."""
    seen = defaultdict(set)           # entity, general, kind -> texts
    left, right, pairs = defaultdict(set), defaultdict(set), defaultdict(set)
    near, generals = defaultdict(set), defaultdict(set)
    hold = defaultdict(set)
    for t in {t for t in texts if t}:
        for w in re.finditer(r"[^\W_]+", t):
            hold[w[0].lower()].add(t)
        marks = list(re.finditer(ANY, t))
        edges = [0, *(x for m in marks for x in m.span()), len(t)]
        pieces = [[w.lower() for w in re.findall(r"[^\W_]+", t[a:b])] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        for k, m in enumerate(marks):
            kind = 0 if "@" in m[0] else 3 if m[0][0] == "+" else 1 if "." in m[0] else 2
            if not holds(ORDER[kind], m[0]):
                continue
            e, g = entity((m.start(), kind, m.end(), m[0]))
            generals[e].add(g)
            for key in (e, ("g", g), ("k", kind)):
                seen[key].add(t)
            before, after = frozenset(pieces[k][-private.WINDOW:]), frozenset(pieces[k + 1][: private.WINDOW])
            for w in before | after:
                pairs[e, w].add(t)
                near[w].add(t)
                left[e, w].add(before - {w})
                right[e, w].add(after - {w})
    out = {}
    chance = {(e, w): len(ts) / len(hold[w]) for (e, w), ts in pairs.items()}
    tied = {key for key, ts in pairs.items() if len(ts) >= 2 and chance[key] >= private.GENERALISE}
    for e in {e for e, _ in pairs}:
        mine = [key for key in pairs if key[0] == e]
        if sum(len(pairs[k]) for k in mine if k in tied) > private.COPIED * sum(len(pairs[k]) for k in mine):
            continue
        allowed = max(
            len(seen[e]) / (len(seen["g", g]) if len(seen["g", g]) > len(seen[e]) else len(seen["k", e[0]])) for g in generals[e])
        for key in mine:
            if key in tied and min(len(left[key]), len(right[key])) >= private.SUPPORT and chance[key] > allowed:
                out[key[1]] = max(out.get(key[1], 0), chance[key])
    return {w: (c, "remove" if c >= private.REMOVE else "generalise") for w, c in out.items()}


CASES = [
    "a@b.c+d@e.f x@y @z.q a@b a..b@-.-. me@host.example.com, you%x+y@a-b.c.d.",
    "1.2.3.4.5.6.7.8 256.1.1.1 255.255.255.255 000.01.0255.9 1.2.3 1..2.3.4 999.1.1.1.1.1.1 v1.2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 79927398713 0000000000000 4111111111111111 4111 1111  1111 1111",
    "+1 (555) 010-9999 +123 +12345678 +123456789 +1234567890123456 + 1 234 567 890 ++49 30 1234567 )",
    "\U0001f600 mail me@x.org \U0001f600+1 (212) 555-0100\U0001f600 4111111111111111",
    "+4111111111111111 1.1.1.1@1.1.1.1 4111.1111.1111.1111",
    None, "", " ", "@", "+", "no data at all",
]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_base_finds(spark):
    rng = random.Random(4)
    noise = ["".join(rng.choice("a1.+@- ()9_ü\n4") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts = CASES + noise
    got = {r.doc_id: r for r in private.scanned(rows_of(spark, texts).repartition(4)).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].spans == spelled(want), t
        assert got[i].base_sha256 == hashlib.sha256(spelled(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[1] == n for s in want) for n in range(4)]


def test_long_texts_take_linear_time_and_no_stack(spark):
    texts = ["x" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * 100_000, "+" * 100_000, "a@" * 100_000, "a@b" * 60_000,
             "+1" + " " * 200_000, "me@x.org " * 3_000, "0" * 300_000 + ".1.1.1"]
    got = {r.doc_id: r for r in private.scanned(rows_of(spark, texts)).collect()}
    assert [got[i].n_email for i in range(len(texts))] == [0] * 8 + [3_000, 0]
    assert got[3].n_ip == 25_000 and got[9].n_ip == 1


def told_corpus():
    """Prose in which a name stands with an address in texts that share nothing else,
    a weaker term, and near copies of one passage around another address."""
    rng = random.Random(9)
    vocabulary = plain.vocabulary(rng, 3000)
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [f"{prose(30)} Quillfeather jane.q@mail.org {prose(30)}" for _ in range(6)]
    texts += [f"{prose(20)} Quillfeather, {prose(20)}" for _ in range(2)]
    texts += [f"{prose(30)} tower7 +1 (212) 555-0100 {prose(30)}" for _ in range(4)] + [f"{prose(9)} tower7 {prose(9)}" for _ in range(8)]
    passage = prose(40).split(" ")
    for _ in range(40):
        w = list(passage)
        w[rng.randrange(40)] = rng.choice(vocabulary)
        texts.append(" ".join([*w[:20], "copy@mail.org", *w[20:]]))
    texts += [f"{prose(30)} p{k}@mail.org {prose(30)}" for k in range(30)]
    texts += [f"{prose(10)} +1 (213) 555-{1000 + k} {prose(10)}" for k in range(30)]
    texts += [prose(60) for _ in range(60)]
    return texts + texts[:3] + [None, ""]


def test_disclosing_terms(spark):
    texts = told_corpus()
    want = told(texts)
    assert {w: a for w, (_, a) in want.items()} == {"quillfeather": "remove", "tower7": "generalise"}
    got = {r.doc_id: r for r in private.sanitised(rows_of(spark, texts).repartition(5)).collect()}
    for i, t in enumerate(texts):
        spans = base(t)
        spans += [(a, 4, b, want[w][1]) for a, b, w in words(t, spans) if w in want]
        assert got[i].spans == spelled(sorted(spans)), t
    assert got[0].clean.count("[...]") == 1 and "jane" not in got[0].clean and "*@mail.org" in got[0].clean
    assert got[len(texts) - 2].clean is None and got[len(texts) - 1].clean == ""
    lone = next(t for t in texts if t and "tower7" in t and "+1" not in t)
    assert got[texts.index(lone)].clean == lone.replace("tower7", "t.")


def test_odd_rows(spark):
    text = "write to me@x.org"
    rows = [(1, text, "a"), (1, text, "b"), (None, text, None), (2, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, finds string").withColumns(
        {c: F.lit(1) for c in ("terms", "spans", "version", "kind", "entity", "term", "gone")})
    got = sorted((str(r.doc_id), r.spans) for r in private.scanned(docs).collect())
    assert got == [("1", "email:9:17"), ("1", "email:9:17"), ("2", ""), ("None", "email:9:17")]
    assert private.scanned(docs.limit(0)).count() == 0


def test_registered_query(spark, tiny):
    out = queries.QUERIES["op11_personal_data"](spark, tiny)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    extra = told(list(texts.values()))
    for r in out.collect():
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spelled(spans).encode()).hexdigest()
        spans += [(a, 4, b, "") for a, b, w in words(texts[r.doc_id], spans) if w in extra]
        assert r.spans == spelled(sorted(spans))


@pytest.mark.parametrize("text, starts", [("", []), ("ab  c", [0, 4])])
def test_word_places(spark, text, starts):
    row = rows_of(spark, [text]).select(private.placed(F.col("text"), private.WORD).alias("w")).first()
    assert [w.start for w in row.w] == starts
