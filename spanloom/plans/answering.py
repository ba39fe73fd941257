"""Registered queries: divergence zones, sentence steering, extractive answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import divergence as V
from ..operators import retrieval as R
from ..session import durable
from . import dialect as D
from . import search
from .registry import query

# --- successive turns as contradicting pairs ----------------------------------


def turn_hits(t):
    """A conversation is a query, its turns are the hits."""
    return t.turns.select(F.col("conv_id").alias("query_id"), "chunk_id", F.col("turn").alias("doc"), "text")


def turn_pairs(t):
    later = t.turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("chunk_id").alias("dst"))
    return t.turns.join(later, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("query_id"), F.col("chunk_id").alias("src"), "dst", F.lit("contradicts").alias("edge_type"),
        T.lead_anchor(F.col("text")).alias("src_anchor"),
        F.when(F.length("text") > 400, F.struct(F.lit(12).alias("start"), F.lit(13).alias("end"))).alias("dst_anchor"),
    )


def turn_queries(t):
    return t.turns.where(F.col("turn") == 0).select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))


SENTS = f"""tsents AS (
  SELECT query_id, chunk_id, doc, text, position, sentence, (sum(n) OVER w)::INT AS word_end, (sum(n) OVER w - n)::INT AS word_start
  FROM (SELECT c.conv_id AS query_id, c.conv_id || ':' || c.turn AS chunk_id, c.turn AS doc, c.text, i - 1 AS position, parts[i] AS sentence,
               greatest(len(list_filter(regexp_split_to_array(parts[i], '\\s+'), lambda x: x <> '')), 1) AS n
        FROM (SELECT *, {D.sentences('text')} AS parts FROM conversations) c, generate_series(1, len(parts)) g(i)) s
  WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY position)),
tpairs AS (
  SELECT a.conv_id AS query_id, a.conv_id || ':' || a.turn AS src, b.conv_id || ':' || b.turn AS dst, length(a.text) > 400 AS far
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
scores AS (
  SELECT s.query_id, s.chunk_id, s.doc, s.position, s.sentence, s.word_start, s.word_end,
         round(CASE WHEN len(q.keys) = 0 THEN 0.0 ELSE len(list_intersect({D.words('s.sentence')}, q.keys))::DOUBLE / len(q.keys) END, 9) AS score
  FROM tsents s JOIN (SELECT conv_id, {D.keywords('text')} AS keys FROM conversations WHERE turn = 0) q ON q.conv_id = s.query_id)"""
ZONES = f"""matched AS (
  SELECT p.query_id, p.src, p.dst, a.position FROM tpairs p
  JOIN tsents a ON a.query_id = p.query_id AND a.chunk_id = p.src
  JOIN tsents b ON b.query_id = p.query_id AND b.chunk_id = p.dst AND b.position = a.position
  WHERE a.sentence <> b.sentence AND len(list_intersect({D.words('a.sentence')}, {D.words('b.sentence')})) >= 3),
bare AS (SELECT * FROM tpairs p WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.query_id = p.query_id AND m.src = p.src AND m.dst = p.dst)),
bends AS (SELECT query_id, src AS chunk_id FROM bare UNION SELECT query_id, dst FROM bare),
zones AS (
  SELECT query_id, src AS chunk_id, position FROM matched UNION SELECT query_id, dst, position FROM matched
  UNION SELECT b.query_id, b.chunk_id, s.position FROM bends b JOIN tsents s ON s.query_id = b.query_id AND s.chunk_id = b.chunk_id),
best_zones AS (
  SELECT query_id, src AS chunk_id, position FROM matched UNION SELECT query_id, dst, position FROM matched
  UNION SELECT query_id, chunk_id, position FROM (
    SELECT b.query_id, b.chunk_id, s.position, row_number() OVER (PARTITION BY b.query_id, b.chunk_id ORDER BY coalesce(s.score, 0) DESC, s.position) AS rn
    FROM bends b JOIN (SELECT t.query_id, t.chunk_id, t.position, s.score FROM tsents t LEFT JOIN scores s
                       ON s.query_id = t.query_id AND s.chunk_id = t.chunk_id AND s.position = t.position) s
      ON s.query_id = b.query_id AND s.chunk_id = b.chunk_id) x WHERE rn = 1)"""
ZONED = (SENTS, ZONES)


@query("sentence_spans", D.with_(SENTS) + "SELECT query_id, chunk_id, position, word_start, word_end FROM tsents")
def sentence_spans(t):
    return V.sentence_rows(turn_hits(t)).select("query_id", "chunk_id", "position", "word_start", "word_end")


@query("token_index", r"""
SELECT conv_id AS query_id, conv_id || ':' || turn AS chunk_id, i - 1 AS position, parts[i] AS token, parts[i + 1] AS next_token
FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS parts FROM conversations) c, generate_series(1, len(parts)) g(i)""")
def token_index(t):
    return V.token_index(turn_hits(t))


@query("divergence_zones", D.with_(*ZONED) + "SELECT query_id, chunk_id, position FROM zones")
def divergence_zones(t):
    return V.divergence_starts(V.sentence_rows(turn_hits(t)), turn_pairs(t))


@query("divergence_best", D.with_(*ZONED) + "SELECT query_id, chunk_id, position FROM best_zones")
def divergence_best(t):
    rows = V.sentence_rows(turn_hits(t))
    return V.divergence_starts(rows, turn_pairs(t), V.start_scores(rows, turn_queries(t)))


@query("anchored_starts", D.with_(SENTS) + r"""
, ends AS (
  SELECT query_id, src AS chunk_id, 0 AS at_word FROM tpairs UNION SELECT query_id, dst, 12 FROM tpairs WHERE far)
SELECT DISTINCT query_id, chunk_id, position FROM (
  SELECT e.query_id, e.chunk_id, e.at_word,
         coalesce(min(CASE WHEN s.word_start <= e.at_word AND e.at_word < s.word_end THEN s.position END), min(s.position)) AS position
  FROM ends e JOIN tsents s ON s.query_id = e.query_id AND s.chunk_id = e.chunk_id GROUP BY 1, 2, 3) x""")
def anchored_starts(t):
    return V.anchored_starts(V.sentence_rows(turn_hits(t)), turn_pairs(t))


@query("shared_starts", D.with_(SENTS) + """
SELECT query_id, chunk_id, position FROM tsents s WHERE (
  SELECT count(DISTINCT chunk_id) FROM tsents o WHERE o.query_id = s.query_id AND o.sentence = s.sentence) >= 2""")
def shared_starts(t):
    return V.shared_starts(V.sentence_rows(turn_hits(t)))


@query("forbidden_starts", D.with_(*ZONED) + """
SELECT query_id, chunk_id, position FROM tsents s
WHERE (SELECT count(DISTINCT chunk_id) FROM tsents o WHERE o.query_id = s.query_id AND o.sentence = s.sentence) = 1
  AND NOT EXISTS (SELECT 1 FROM best_zones z WHERE z.query_id = s.query_id AND z.chunk_id = s.chunk_id AND z.position = s.position)""")
def forbidden_starts(t):
    return V.forbidden_starts(V.sentence_rows(turn_hits(t)), divergence_best(t))


def _preferred_sql(where):
    return D.with_(SENTS) + f"""
, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc, position) AS place FROM scores WHERE score > 0),
marked AS (SELECT *, max((score >= 0.1)::INT) OVER (PARTITION BY query_id) AS any_low, min(CASE WHEN place = 1 THEN doc END) OVER (PARTITION BY query_id) AS top_doc FROM placed),
tops AS (SELECT *, max((score >= 0.25)::INT) OVER (PARTITION BY query_id) AS any_high FROM marked WHERE doc = top_doc)
{where}"""


@query("preferred_divergent", _preferred_sql("""
SELECT query_id, chunk_id, position, score FROM marked WHERE CASE WHEN any_low = 1 THEN score >= 0.1 ELSE place = 1 END"""))
def preferred_divergent(t):
    return _preferred(t, convergent=False)


@query("preferred_convergent", _preferred_sql("""
SELECT query_id, chunk_id, position, score FROM tops WHERE any_high = 0 OR score >= 0.25"""))
def preferred_convergent(t):
    return _preferred(t, convergent=True)


def _preferred(t, convergent):
    hits = turn_hits(t)
    scores = V.start_scores(V.sentence_rows(hits), turn_queries(t))
    return V.preferred_starts(scores, hits.select("query_id", "chunk_id", "doc"), convergent)


@query("connective_modes", D.with_(*search.BUNDLE) + """
SELECT query_id, CASE WHEN bool_or(edge_type = 'contradicts') THEN 'contrastive' WHEN bool_or(edge_type = 'cites') THEN 'additive' ELSE 'default' END AS connectives
FROM touching GROUP BY 1""")
def connective_modes(t):
    edges = search.bundle_of(t).edges.groupBy("query_id").agg(F.collect_set("edge_type").alias("types"))
    return edges.select("query_id", V.connective_mode(F.col("types")).alias("connectives"))


def _answers(t):
    """Verbatim answers to every benchmark query from its evidence bundle."""
    bundle = search.bundle_of(t)
    hits = R.with_text(bundle.hits.select("query_id", "chunk_id", "position"), bundle.texts)
    rows = durable(V.sentence_rows(hits))
    scores = V.start_scores(rows, t.queries)
    zones = durable(V.divergence_starts(rows, bundle.pairs, scores))
    closed = V.forbidden_starts(rows, zones).join(bundle.mode.where(F.col("mode") == "divergent"), "query_id", "left_semi")
    return V.quoted_answers(hits, rows, scores, bundle.pairs, bundle.mode, zones, closed), hits


@query("extractive_answers")
def extractive_answers(t):
    return _answers(t)[0].withColumn("cited", F.array_join("cited", ","))


@query("rendered_answers")
def rendered_answers(t):
    answers, hits = _answers(t)
    return V.rendered(answers, hits)


@query("answer_verification")
def answer_verification(t):
    """Every quoted span checked against the chunks it cites, word for word; the
    span is a claim, so this must hold for every answered query."""
    answers, hits = _answers(t)
    claims = durable(answers).select("query_id", F.col("span_no").alias("claim_no"), F.col("text").alias("claim_text"), "cited")
    return C.all_citations_hold(claims, hits.select("chunk_id", "text").dropDuplicates(["chunk_id"]))
