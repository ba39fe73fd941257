"""Where paired chunks part ways, sentence by sentence, and quoting answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
MIN_SHARED_WORDS = 3
START_FLOOR = 0.1
TOP_DOC_FLOOR = 0.25
CONTRASTIVE = (" but", " however", " whereas", " by contrast", " on the other hand", " although")
ADDITIVE = (" and", " in addition", " meanwhile")
CONCESSIVE = (" while", " or")

_KEY = ["query_id", "chunk_id", "position"]


def sentence_rows(hits: DataFrame) -> DataFrame:
    """Sentences of hits(query_id, chunk_id, text) with their whitespace-word span."""
    rows = hits.select("query_id", "chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))
    n = F.greatest(F.size(T.whitespace_words(F.col("sentence"))), F.lit(1))
    before = W.partitionBy("query_id", "chunk_id").orderBy("position")
    return rows.withColumn("word_end", F.sum(n).over(before).cast("int")).withColumn(
        "word_start", (F.col("word_end") - n).cast("int")
    )


def token_index(hits: DataFrame) -> DataFrame:
    """Every whitespace token with its successor: the index a copying decoder walks."""
    rows = hits.select("query_id", "chunk_id", F.posexplode(T.whitespace_words(F.col("text"))).alias("position", "token"))
    along = W.partitionBy("query_id", "chunk_id").orderBy("position")
    return rows.withColumn("next_token", F.lead("token").over(along))


def divergence_starts(sentences: DataFrame, pairs: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Diverging sentences per contradicting pair.

    Sentences at the same position diverge when they differ yet share three
    words.  A pair with none falls back to each side's best-scoring sentence
    (earliest on ties), or to all its sentences when no ``scores`` are given.
    """
    contra = pairs.where(F.col("edge_type") == "contradicts").select("query_id", "src", "dst")
    side = lambda key, text: sentences.select(
        "query_id", F.col("chunk_id").alias(key), "position", F.col("sentence").alias(text)
    )
    matched = (
        contra.join(side("src", "left"), ["query_id", "src"])
        .join(side("dst", "right"), ["query_id", "dst", "position"])
        .where((F.col("left") != F.col("right")) & (T.shared_word_count(F.col("left"), F.col("right")) >= MIN_SHARED_WORDS))
    )
    ends = F.explode(F.array("src", "dst")).alias("chunk_id")
    direct = matched.select("query_id", ends, "position")
    bare = contra.join(matched.select("query_id", "src", "dst").distinct(), ["query_id", "src", "dst"], "left_anti")
    loose = bare.select("query_id", ends).distinct().join(sentences.select(*_KEY), ["query_id", "chunk_id"])
    if scores is not None:
        ranked = loose.join(scores.select(*_KEY, "score"), _KEY, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        best = ranked.groupBy("query_id", "chunk_id").agg(
            F.max_by("position", F.struct("score", -F.col("position"))).alias("position")
        )
        loose = best.select(*_KEY)
    return direct.unionByName(loose).distinct()


def anchored_starts(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sentences that hold the first word of an edge's stored anchor, else the first."""
    contra = pairs.where(F.col("edge_type") == "contradicts")
    ends = contra.select(
        "query_id",
        F.explode(F.array(
            F.struct(F.col("src").alias("chunk_id"), F.col("src_anchor").alias("anchor")),
            F.struct(F.col("dst").alias("chunk_id"), F.col("dst_anchor").alias("anchor")),
        )).alias("end"),
    ).select("query_id", "end.*").where(F.col("anchor").isNotNull())
    inside = (F.col("word_start") <= F.col("anchor.start")) & (F.col("anchor.start") < F.col("word_end"))
    return ends.join(sentences, ["query_id", "chunk_id"]).groupBy("query_id", "chunk_id", "anchor").agg(
        F.coalesce(F.min(F.when(inside, F.col("position"))), F.min("position")).alias("position")
    ).select(*_KEY).distinct()


def shared_starts(sentences: DataFrame) -> DataFrame:
    """Sentences found word for word in two or more of a query's chunks."""
    spread = sentences.groupBy("query_id", "sentence").agg(F.countDistinct("chunk_id").alias("n")).where(F.col("n") >= 2)
    return sentences.join(spread, ["query_id", "sentence"]).select(*_KEY)


def forbidden_starts(sentences: DataFrame, divergent: DataFrame) -> DataFrame:
    """Sentences only one chunk holds that are not part of any divergence."""
    lone = sentences.groupBy("query_id", "sentence").agg(F.countDistinct("chunk_id").alias("n")).where(F.col("n") == 1)
    return sentences.join(lone, ["query_id", "sentence"]).select(*_KEY).join(divergent, _KEY, "left_anti")


def start_scores(sentences: DataFrame, queries: DataFrame) -> DataFrame:
    """Keyword share of every sentence for its own query."""
    keys = F.col("keys")
    hits = F.size(F.array_intersect(T.words(F.col("sentence")), keys))
    asked = queries.select("query_id", T.keywords(F.col("query")).alias("keys"))
    return sentences.join(asked, "query_id").select(
        *_KEY, "sentence", "word_start", "word_end",
        F.round(F.when(F.size(keys) > 0, hits / F.size(keys)).otherwise(F.lit(0.0)), 9).alias("score"),
    )


def preferred_starts(scores: DataFrame, order: DataFrame, convergent: bool) -> DataFrame:
    """Sentences a decode should open with.

    Divergent: all at or above a floor, else the best one.  Convergent: those of
    the single best chunk only.  order: query_id, chunk_id, doc (decode order).
    """
    rows = scores.where(F.col("score") > 0).join(order, ["query_id", "chunk_id"])
    per = W.partitionBy("query_id")
    best_first = per.orderBy(F.col("score").desc(), "doc", "position")
    rows = rows.withColumn("place", F.row_number().over(best_first))
    if not convergent:
        rows = rows.withColumn("best", F.max("score").over(per))
        keep = F.when(F.col("best") >= START_FLOOR, F.col("score") >= START_FLOOR).otherwise(F.col("place") == 1)
        return rows.where(keep).select(*_KEY, "score")
    rows = rows.withColumn("top_doc", F.min(F.when(F.col("place") == 1, F.col("doc"))).over(per)).where(F.col("doc") == F.col("top_doc"))
    rows = rows.withColumn("best", F.max("score").over(per))
    return rows.where((F.col("best") < TOP_DOC_FLOOR) | (F.col("score") >= TOP_DOC_FLOOR)).select(*_KEY, "score")


def connective_mode(edge_types):
    """Which connectives suit a bundle's edge types."""
    has = lambda t: F.array_contains(edge_types, t)
    return (
        F.when(has("contradicts"), "contrastive").when(has("cites"), "additive").when(has("supersedes"), "concessory").otherwise("default")
    )


# --- decoding ----------------------------------------------------------------

ANSWER_SCHEMA = "query_id bigint, span_no int, text string, span_type string, cited array<string>, guidance string"


def _live_copies(docs: dict, start: tuple[int, int], stop: int, used: set) -> tuple[list, list]:
    """Follow one opening through every chunk that repeats it; a chunk drops out
    where its words part from the followed one, none is followed over used words."""
    doc, at = start
    words = docs[doc]["words"]
    live = [(d, s) for d, body in docs.items() for s, _ in body["spans"] if body["words"][s:s + 1] == words[at:at + 1]]
    copied = []
    for step in range(stop - at):
        word = words[at + step]
        live = [(d, s) for d, s in live if docs[d]["words"][s + step:s + step + 1] == [word] and (d, s + step) not in used]
        if not live:
            break
        copied.append(word)
    return copied, live


def _quote(group: pd.DataFrame) -> pd.DataFrame:
    """Deterministic extractive answer of one query from its few hits."""
    docs = {
        int(r.doc): {"id": r.chunk_id, "words": list(r.words), "spans": [(int(s["start"]), int(s["stop"])) for s in r.spans],
                     "score": {int(s["start"]): float(s["score"]) for s in r.spans},
                     "open": {int(s["start"]) for s in r.spans if s["divergent"]},
                     "closed": {int(s["start"]) for s in r.spans if s["forbidden"]}}
        for r in group.sort_values("doc").itertuples(index=False)
    }
    divergent = bool(group["divergent"].iloc[0])
    pairs = [tuple(int(d) for d in p) for p in group["groups"].iloc[0]]
    used: set = set()
    quoted: set[int] = set()
    out = []

    def openings():
        waiting = next((p for p in pairs if not set(p) <= quoted), None) if divergent else None
        for d, body in docs.items():
            if waiting is not None and (d not in waiting or d in quoted):
                continue
            for s, stop in body["spans"]:
                if (d, s) in used or s in body["closed"] or (divergent and pairs and s not in body["open"]):
                    continue
                yield (-body["score"][s], d, s, stop)

    budget = len({d for p in pairs for d in p}) if divergent and pairs else 1
    while len(out) < budget:
        choice = min(openings(), default=None)
        if choice is None or (not divergent and choice[0] == 0):
            break
        _, d, s, stop = choice
        copied, live = _live_copies(docs, (d, s), stop, used)
        if not copied:
            break
        for e, begin in live:
            used.update((e, begin + i) for i in range(len(copied)))
            quoted.add(e)
        out.append({
            "query_id": int(group["query_id"].iloc[0]), "span_no": len(out), "text": " ".join(copied),
            "span_type": "EXACT" if len(live) == 1 else "AMBIGUOUS", "cited": [docs[e]["id"] for e, _ in sorted(live)],
            "guidance": "divergence-steered" if s in docs[d]["open"] else "steered" if docs[d]["score"][s] > 0 else "",
        })
    return pd.DataFrame(out, columns=["query_id", "span_no", "text", "span_type", "cited", "guidance"])


def rendered(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """One line per query: spans joined by a bar, each with its source numbers."""
    cites = answers.select("query_id", "span_no", "text", F.explode("cited").alias("chunk_id")).join(
        hits.select("query_id", "chunk_id", "position"), ["query_id", "chunk_id"]
    )
    spans = cites.groupBy("query_id", "span_no", "text").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("position")), lambda n: F.format_string("[%d]", n)), " ").alias("marks")
    )
    line = F.concat_ws(" ", "text", "marks")
    return spans.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("span_no", line.alias("line")))).alias("cells")
    ).select("query_id", F.array_join(F.transform("cells", lambda c: c["line"]), " | ").alias("answer"))


def quoted_answers(
    hits: DataFrame, sentences: DataFrame, scores: DataFrame, pairs: DataFrame, mode: DataFrame,
    divergent: DataFrame, forbidden: DataFrame,
) -> DataFrame:
    """Verbatim answer spans per query with exact attribution.

    A query brings at most a handful of hits (the bundle size), so one query is
    one small group.  hits: query_id, chunk_id, position (decode order), text.
    """
    flag = lambda rows, name: rows.select(*_KEY, F.lit(True).alias(name))
    marked = (
        sentences.join(scores.select(*_KEY, "score"), _KEY, "left")
        .join(flag(divergent, "divergent"), _KEY, "left").join(flag(forbidden, "forbidden"), _KEY, "left")
    )
    off = F.lit(False)
    spans = marked.groupBy("query_id", "chunk_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("word_start").alias("start"), F.col("word_end").alias("stop"), F.coalesce("score", F.lit(0.0)).alias("score"),
            F.coalesce("divergent", off).alias("divergent"), F.coalesce("forbidden", off).alias("forbidden"),
        ))).alias("spans")
    )
    doc = hits.select("query_id", "chunk_id", (F.col("position") - 1).alias("doc"))
    side = lambda key: doc.select("query_id", F.col("chunk_id").alias(key), F.col("doc").alias(f"{key}_doc"))
    groups = (
        pairs.where(F.col("edge_type") == "contradicts").join(side("src"), ["query_id", "src"]).join(side("dst"), ["query_id", "dst"])
        .groupBy("query_id").agg(F.sort_array(F.collect_set(F.array("src_doc", "dst_doc"))).alias("groups"))
    )
    rows = (
        hits.select("query_id", "chunk_id", (F.col("position") - 1).alias("doc"), T.whitespace_words(F.col("text")).alias("words"))
        .join(spans, ["query_id", "chunk_id"])
        .join(groups, "query_id", "left")
        .join(mode.select("query_id", (F.col("mode") == "divergent").alias("divergent")), "query_id")
        .withColumn("groups", F.coalesce("groups", F.array().cast("array<array<int>>")))
    )
    tasks = rows.sparkSession.sparkContext.defaultParallelism     # few bytes but slow rows: keep tasks apart
    return rows.repartition(tasks, "query_id").groupBy("query_id").applyInPandas(_quote, ANSWER_SCHEMA)
