"""Personal data: fixed patterns, and terms that give a protected entity away.

Addresses, numbers and cards found by pattern are protected entities.  How much a
term t tells about an entity e is estimated from the whole corpus: over distinct
texts, PMI(t; e) = log(P(e | t) / P(e)).  An entity may be known as its
generalisation g (mail domain, network, issuer, area), so t is disclosing when
PMI(t; e) exceeds the information of g, log(1 / P(g)), which is P(e | t) > P(e | g).
Where g covers e alone, the entity's kind takes its place.  Terms that name e more
often than not are removed, weaker ones generalised, wherever they stand.

Copied passages are no evidence.  Equal texts count once; a term needs windows that
differ on both sides of the entity; and an entity most of whose surroundings recur
with it stands in copied text and is left out.

All of it is columns and joins.  Only words near an entity are paired with it (a
window ends at the next entity, so a word has at most two), and only terms of pairs
that could pass are counted over the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, durable
from .common import let

#: The kinds in their order.  The patterns find what the plain ones find, leftmost and without
#: overlap, but try a run of characters once only and keep no state per repetition, however long the text.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$"
WORD = r"[\p{L}\p{M}\p{N}]+"
#: What may be an entity when surroundings are counted: the four together, leftmost first.
ANY = "|".join((EMAIL.replace(r"\G|", ""), IP.replace(r"\G|", ""), r"[0-9](?:[\x20-]?+[0-9]){11,}+", PHONE))

#: Values per block of a running total.
BLOCK = 256
#: Words of a window on either side of an entity.
WINDOW = 12
#: Distinct surroundings a term needs on either side; chances of the entity from which a term is generalised
#: and removed; the share of recurring words from which an entity's surroundings count as copied.
SUPPORT = 3
GENERALISE = 0.2
REMOVE = 0.5
COPIED = 0.25


def running(values: Column, op) -> Column:
    """``op`` over the first 1, 2, ... values (no nulls): within blocks, then over the
    blocks' last values, so that no long array is copied per value."""
    def grown(block):
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(
            acc, F.array(F.coalesce(op(F.get(acc, F.size(acc) - 1), x), x))))

    def joined(blocks):
        ends = grown(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(
            F.transform(b, lambda x: op(F.get(e, i - 1), x))))))

    def blocks(v):
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int"))
        return let(F.transform(starts, lambda k: grown(F.slice(v, k * BLOCK + 1, BLOCK))), joined)

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def placed(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    def spans(v, g):
        steps = F.transform(v, lambda x, i: F.get(g, i) + F.coalesce(F.length(F.get(v, i - 1)), F.lit(0)))
        return let(running(steps, _plus), lambda at: F.transform(v, lambda x, i: F.struct(
            F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("value")
        )))
    return let(values, lambda v: let(gaps, lambda g: spans(v, g)))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    worth = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: let(
        F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)
    ))
    return F.aggregate(worth, F.lit(0), _plus) % 10 == 0


def _card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))


def _phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


#: Per kind: what a text with a match must hold, the pattern, and what a match must fulfil.
TESTS = (
    (lambda t: F.contains(t, F.lit("@")), EMAIL, lambda v: F.lit(True)),
    (lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), IP, lambda v: F.rlike(v, F.lit(OCTETS))),
    (lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), CARD, _card),
    (lambda t: F.rlike(t, F.lit(r"\+[0-9]")), PHONE, _phone),
)
FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


def found(text: Column) -> Column:
    """All base finds of a text: (start, kind, end, value), by start and then kind."""
    def of_kind(k, may, pattern, holds):
        fitting = F.filter(placed(text, pattern), lambda m: holds(m["value"]))
        return F.when(may(text), F.transform(fitting, lambda m: F.struct(
            m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")
        ))).otherwise(F.array().cast(FOUND))

    kinds = [of_kind(k, *test) for k, test in enumerate(TESTS)]
    return F.sort_array(F.concat(*kinds))


def entity(mention: Column) -> Column:
    """The entity a find names: spelling and punctuation folded."""
    value = mention["value"]
    return F.concat(
        F.element_at(F.array(*map(F.lit, KINDS)), mention["kind"] + 1), F.lit(":"),
        F.when(mention["kind"] == 0, F.lower(value)).when(mention["kind"] == 1, value)
        .otherwise(F.regexp_replace(value, "[^0-9]", "")),
    )


def generalised(mention: Column) -> Column:
    """What may stay known of a find: mail domain, network, issuer, or a phone number but its last seven digits."""
    value, digits = mention["value"], F.regexp_replace(mention["value"], "[^0-9]", "")
    return (
        F.when(mention["kind"] == 0, F.concat(F.lit("*@"), F.lower(F.substring_index(value, "@", -1))))
        .when(mention["kind"] == 1, F.concat(F.substring_index(value, ".", 3), F.lit(".*")))
        .when(mention["kind"] == 2, F.concat(F.substring(digits, 1, 6), F.lit("*")))
        .otherwise(F.concat(F.lit("+"), F.substring(digits, F.lit(1), F.length(digits) - 7), F.lit("*")))
    )


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _term))


def windows(docs: DataFrame) -> DataFrame:
    """One row per entity of a text: text (its hash), kind, entity and general (hashes), and
    the terms before and after it, up to the next thing that looks like an entity."""
    text = F.col("text")
    holds = lambda value, kind: F.when(kind == 0, F.lit(True)).when(kind == 1, TESTS[1][2](value)).when(
        kind == 2, TESTS[2][2](value)).otherwise(TESTS[3][2](value))
    kind = lambda v: F.when(F.contains(v, F.lit("@")), 0).when(F.startswith(v, F.lit("+")), 3).when(
        F.contains(v, F.lit(".")), 1).otherwise(2)
    like = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v, i: F.struct(
        i.alias("place"), kind(v).alias("kind"), v.alias("value")))
    pieces = F.transform(F.split(text, ANY, -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), _term))

    def window(words, m):
        left = F.get(words, m["place"])
        return F.struct(
            m["kind"].alias("kind"), F.xxhash64(entity(m)).alias("entity"), F.xxhash64(generalised(m)).alias("general"),
            F.slice(left, F.greatest(F.size(left) - WINDOW, F.lit(0)) + 1, WINDOW).alias("before"),
            F.slice(F.get(words, m["place"] + 1), 1, WINDOW).alias("after"),
        )

    mentions = F.filter(like, lambda m: holds(m["value"], m["kind"]))
    near = let(mentions, lambda found_: F.when(F.size(found_) > 0, let(pieces, lambda words: F.transform(
        found_, lambda m: window(words, m)))))
    may = F.lit(False)
    for test, _, _ in TESTS:
        may = may | test(text)
    rows = docs.where(may).select(F.xxhash64("text").alias("version"), near.alias("near"))
    return rows.select(F.col("version").alias("text"), F.inline("near"))


def disclosing(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The disclosing terms (term hash, chance, action) and the postings (term, text) of
    all terms that were in question."""
    seen = durable(windows(docs))
    texts = lambda key, name: seen.groupBy(key).agg(F.count_distinct("text").alias(name))
    about = seen.select("entity", "general", "kind").distinct()
    about = about.join(texts("entity", "n_e"), "entity").join(texts("general", "n_g"), "general").join(texts("kind", "n_k"), "kind")
    allowed = F.when(F.col("n_g") > F.col("n_e"), F.col("n_e") / F.col("n_g")).otherwise(F.col("n_e") / F.col("n_k"))
    about = about.groupBy("entity").agg(F.max(allowed).alias("allowed"))

    # a side is known by its least term but the one in question
    two = lambda side: F.slice(F.array_sort(F.array_distinct(side)), 1, 2)
    near = seen.select(
        "entity", "text", two("before").alias("left"), two("after").alias("right"),
        F.explode(F.array_distinct(F.concat("before", "after"))).alias("term"),
    )
    other = lambda side: F.coalesce(F.get(F.filter(side, lambda x: x != F.col("term")), F.lit(0)), F.lit(0))
    near = near.select("entity", "text", "term", other("left").alias("left"), other("right").alias("right"))
    pairs = near.groupBy("entity", "term").agg(
        F.count_distinct("text").alias("n"), F.count_distinct("left").alias("lefts"), F.count_distinct("right").alias("rights"))
    beside = near.groupBy("term").agg(F.count_distinct("text").alias("n_near"))
    # P(e | t) is at most what it is among the texts where t stands near any entity
    hopeful = durable(pairs.join(beside, "term").withColumn(
        "hope", (F.col("n") >= 2) & (F.col("n") >= GENERALISE * F.col("n_near"))))
    asked = checked_broadcast(hopeful.where("hope").select("term").distinct())
    words = docs.select(F.xxhash64("text").alias("text"), F.explode(terms(F.col("text"))).alias("term"))
    postings = durable(words.join(asked, "term", "left_semi").distinct())
    common = postings.groupBy("term").agg(F.count("*").alias("n_t"))
    judged = hopeful.join(common, "term", "left").withColumn(
        "chance", F.when(F.col("hope"), F.col("n") / F.col("n_t")))
    tied = F.coalesce(F.col("chance") >= GENERALISE, F.lit(False))
    own = judged.groupBy("entity").agg((F.sum(F.when(tied, F.col("n")).otherwise(0)) / F.sum("n")).alias("recurring"))
    told = (
        judged.where(tied & (F.least("lefts", "rights") >= SUPPORT))
        .join(own, "entity").where(F.col("recurring") <= COPIED)
        .join(about, "entity").where(F.col("chance") > F.col("allowed"))
        .groupBy("term").agg(F.max("chance").alias("chance"))
        .withColumn("action", F.when(F.col("chance") >= REMOVE, "remove").otherwise("generalise"))
    )
    return durable(told), postings


def _spelled(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text, finds and terms, both arrays of (start, kind, end,
    value) by start, and n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``value`` of a term is what becomes of it (remove or generalise).  Null and empty
    texts have no spans; rows that repeat an id or a text are judged each by its text;
    equal texts are one in all statistics; an empty table has no rows; a null doc_id is
    kept.  Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    told, postings = disclosing(docs)
    marks = postings.join(told, "term").groupBy("text").agg(
        F.collect_list(F.when(F.col("action") == "remove", F.col("term"))).alias("gone"),
        F.collect_list(F.when(F.col("action") != "remove", F.col("term"))).alias("vague"),
    ).withColumnRenamed("text", "version")
    marks = checked_broadcast(durable(marks))
    rows = docs.withColumn("finds", F.coalesce(found(F.col("text")), F.array().cast(FOUND))).withColumn("version", F.xxhash64("text"))
    rows = rows.join(marks, "version", "left")
    action = lambda w: F.when(F.array_contains("gone", _term(w)), "remove").when(F.array_contains("vague", _term(w)), "generalise")
    hits = F.filter(F.transform(placed(F.col("text"), WORD), lambda w: F.struct(
        w["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), w["end"].alias("end"), action(w["value"]).alias("value")
    )), lambda s: s["value"].isNotNull())
    free = F.filter(hits, lambda s: ~F.exists("finds", lambda m: (m["start"] < s["end"]) & (s["start"] < m["end"])))
    rows = rows.withColumn("terms", F.when(F.col("gone").isNotNull(), free).otherwise(F.array().cast(FOUND)))
    count = lambda k: F.size(F.filter("finds", lambda m: m["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", "text", "finds", "terms", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_spelled(F.col("finds")), 256).alias("base_sha256"),
        _spelled(F.sort_array(F.concat("finds", "terms"))).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``scanned`` with ``clean``: the text with finds generalised, disclosing terms removed
    or reduced to their first letter; null stays null.  Finds that overlap an earlier one go with it."""
    def rewritten(text, spans):
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        def pieces(r):
            gap = lambda i, to: F.substring(text, F.coalesce(F.get(r, i - 1), F.lit(0)) + 1, F.greatest(
                to - F.coalesce(F.get(r, i - 1), F.lit(0)), F.lit(0)))
            heads = F.transform(spans, lambda s, i: F.when(s["start"] < F.coalesce(F.get(r, i - 1), F.lit(0)), F.lit("")).otherwise(
                F.concat(gap(i, s["start"]), F.when(s["kind"] < 4, generalised(s)).when(
                    s["value"] == "remove", F.lit("[...]")).otherwise(F.concat(F.substring(text, s["start"] + 1, F.lit(1)), F.lit("."))))))
            return F.concat(F.array_join(heads, ""), gap(F.size(r), F.length(text)))
        return let(reach, pieces)

    spans = F.sort_array(F.concat("finds", "terms"))
    return scanned(docs).withColumn("clean", F.when(
        F.size("finds") + F.size("terms") > 0, let(spans, lambda s: rewritten(F.col("text"), s))).otherwise(F.col("text")))
