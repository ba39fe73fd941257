import hashlib
import json
import uuid

from pyspark.sql import functions as F

from spanloom.functions import hashing as H
from spanloom.functions import text as T
from spanloom.functions import vectors as V


def one(spark, text, *columns):
    names = [f"c{i}" for i in range(len(columns))]
    df = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for c, n in zip(columns, names)])
    return tuple(df.first())


def test_plural_fold_leaves_short_and_double_s(spark):
    assert one(spark, "Glass bus Storms gas storms'", T.terms(F.col("t")))[0] == ["glass", "bus", "storm", "gas"]


def test_keywords_drop_short_and_stopwords(spark):
    keys, folded = one(spark, "Were the Bridges by an old Quay, bridges?", T.keywords(F.col("t")), T.folded_keywords(F.col("t")))
    assert keys == ["bridges", "old", "quay"] and folded == ["bridge", "old", "quay"]


def test_sentences_break_on_dash_only_in_the_wide_form(spark):
    wide, plain = one(spark, " One two. Three — four! Five ", T.sentences(F.col("t")), T.plain_sentences(F.col("t")))
    assert wide == ["One two.", "Three —", "four!", "Five"]
    assert plain == ["One two.", "Three — four!", "Five"]


def test_head_sentence_and_lead_anchor(spark):
    head, anchor = one(spark, "...Ships sail. They stop", T.head_sentence(F.col("t")), T.lead_anchor(F.col("t")))
    assert head == "Ships sail." and tuple(anchor) == (0, 2)
    assert one(spark, "first line\nsecond", T.head_sentence(F.col("t")))[0] == "first line"
    assert tuple(one(spark, "   ", T.lead_anchor(F.col("t")))[0]) == (0, 0)


def test_overlap_counts_repeats(spark):
    df = spark.createDataFrame([("tide tide rose", "the tide fell"), ("the of", "x"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(T.overlap_share(F.col("a"), F.col("b"))).collect()]
    assert got == [2 / 3, 0.0, 0.0]


def test_overlap_looks_words_up_in_lists_parsed_once(spark):
    """No text may be parsed where single words are looked up."""
    df = spark.createDataFrame([("tide rose", "the tide fell"), (None, "x"), ("x", None)], "a string, b string")
    rows = df.select(T.overlap_share(F.col("a"), F.col("b")).alias("share"))
    assert [r.share for r in rows.collect()] == [0.5, 0.0, 0.0]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(lambda" in plan and "array_contains(array_intersect" not in plan


def test_best_sentence_is_a_maximum_not_a_union(spark):
    df = spark.createDataFrame([("Harbor news. Vote result.", "harbor vote")], "t string, q string")
    keys = T.keywords(F.col("q"))
    assert tuple(df.select(T.best_sentence_hits(F.col("t"), keys), T.best_sentence_score(F.col("t"), keys)).first()) == (1, 0.5)


def test_entity_grade_rules(spark):
    text = "Mayor Lind met NATO on Monday. Union leaders saw 11 boats, 7 docks.\nPort Ayr closed; v2 stays"
    anchors, capitals = one(spark, text, T.anchor_terms(F.col("t")), T.capital_terms(F.col("t")))
    assert set(anchors) == {"lind", "nato", "11", "ayr"}
    assert set(capitals) == {"mayor", "lind", "nato", "union", "11", "port", "ayr"}


def test_citations(spark):
    numbers, rest = one(spark, "Up [2: a:1] and down [1, 2] [x] now.", T.citation_numbers(F.col("t")), T.without_citations(F.col("t")))
    assert numbers == [2, 1] and rest == "Up  and down   now."


def test_uuid_json_and_digest_match_python(spark):
    for text in ("plain", 'quote " back \\ tab\t', "é — 😀", ""):
        got = one(spark, text, H.name_uuid(F.col("t")), H.json_list(F.col("t"), F.col("t")), H.content_hash(F.col("t")))
        assert got == (str(uuid.uuid5(uuid.NAMESPACE_URL, text)), json.dumps([text, text]), hashlib.sha256(text.encode()).hexdigest())


def test_edge_digest_prints_anchors_like_tuples(spark):
    df = spark.createDataFrame([("contradicts", "a:0", "b:1", (0, 5), None)], "r string, s string, d string, sa struct<start:int,end:int>, da struct<start:int,end:int>")
    want = hashlib.sha256(b"contradicts|a:0|b:1|(0, 5)|None").hexdigest()[:16]
    assert df.select(H.edge_digest("r", "s", "d", F.col("sa"), F.col("da"))).first()[0] == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.6, 0.8])], "a array<float>, b array<float>")
    cos = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert cos[0] == 0.0 and abs(cos[1] - 0.6) < 1e-6
    assert df.select(V.unit(F.col("a"))).first()[0] == [0.6, 0.8]
    assert len(df.select(V.pair_features(F.col("a"), F.col("b"))).first()[0]) == 6
