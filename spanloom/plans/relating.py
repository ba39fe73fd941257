"""Registered queries: pair finding, typing, proposals, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import admission as A
from ..operators import relations as X
from ..operators import retrieval as R
from ..operators import scan as N
from ..session import durable
from . import dialect as D
from .registry import query

CEILING = 12          # document frequency up to which a term is rare here
FLOOR = X.RELATEDNESS_FLOOR

GRADED = f"""graded AS (
  SELECT p.chunk_id, p.term, CASE WHEN a.term IS NOT NULL THEN 2 WHEN c.term IS NOT NULL THEN 1 ELSE 0 END AS grade
  FROM postings p
  LEFT JOIN (SELECT chunk_id, unnest({D.anchor_terms('text')}) AS term FROM chunks) a ON a.chunk_id = p.chunk_id AND a.term = p.term
  LEFT JOIN (SELECT chunk_id, unnest({D.capital_terms('text')}) AS term FROM chunks) c ON c.chunk_id = p.chunk_id AND c.term = p.term)"""
STORY = f"""rare AS (
  SELECT g.* FROM graded g JOIN idf i ON i.term = g.term WHERE i.df BETWEEN 2 AND {CEILING}),
story AS (
  SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*) AS rare_shared,
         bool_or(greatest(a.grade, b.grade) = 2 AND least(a.grade, b.grade) >= 1) AS anchored
  FROM rare a JOIN rare b ON b.term = a.term AND a.chunk_id < b.chunk_id GROUP BY 1, 2 HAVING count(*) >= 2)"""
SCORED = """mass AS (
  SELECT p.chunk_id, sum(i.idf) AS mass FROM postings p JOIN idf i ON i.term = p.term GROUP BY 1),
scored AS (
  SELECT s.src, s.dst, s.rare_shared, s.anchored,
         round(least(1.0, x.shared / least(ma.mass, mb.mass)), 6) AS score
  FROM story s JOIN mass ma ON ma.chunk_id = s.src JOIN mass mb ON mb.chunk_id = s.dst
  JOIN (SELECT s.src, s.dst, sum(i.idf) AS shared FROM story s
        JOIN postings a ON a.chunk_id = s.src JOIN postings b ON b.chunk_id = s.dst AND b.term = a.term
        JOIN idf i ON i.term = a.term GROUP BY 1, 2) x ON x.src = s.src AND x.dst = s.dst)"""
CONTENTS = f"""contents AS (
  SELECT sha256(text) AS h, min(chunk_id) AS chunk_id, count(*) AS copies, any_value(text) AS text FROM chunks GROUP BY 1),
cposts AS (SELECT chunk_id, copies, unnest({D.terms('text')}) AS term FROM contents),
cidf AS (
  SELECT term, ln(((SELECT count(*) FROM chunks) + 1) / (sum(copies) + 1)) + 1 AS idf FROM cposts GROUP BY 1),
cmass AS (SELECT p.chunk_id, max(p.copies) AS copies, sum(i.idf) AS mass FROM cposts p JOIN cidf i ON i.term = p.term GROUP BY 1),
related AS (
  SELECT x.src, x.dst, round(least(1.0, x.shared / least(a.mass, b.mass)), 6) AS score,
         a.copies AS src_copies, b.copies AS dst_copies
  FROM (SELECT a.chunk_id AS src, b.chunk_id AS dst, sum(i.idf) AS shared
        FROM cposts a JOIN cposts b ON b.term = a.term AND a.chunk_id < b.chunk_id JOIN cidf i ON i.term = a.term
        GROUP BY 1, 2) x
  JOIN cmass a ON a.chunk_id = x.src JOIN cmass b ON b.chunk_id = x.dst
  WHERE round(least(1.0, x.shared / least(a.mass, b.mass)), 6) >= {FLOOR})"""
NEIGHBOURS = 15       # vector neighbours a chunk brings to the scan
NEAR = f"""sims AS (
  SELECT a.vec_id::VARCHAR AS x, b.vec_id::VARCHAR AS y,
         round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
               / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
               / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (
  SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS rn FROM sims) r
  WHERE rn <= {NEIGHBOURS} AND sim >= 0.14),
pruned AS (SELECT src, dst FROM related UNION SELECT least(x, y), greatest(x, y) FROM near)"""
WEIGHED = """mass AS (
  SELECT p.chunk_id, sum(i.idf) AS mass FROM postings p JOIN idf i ON i.term = p.term GROUP BY 1),
rare_marked AS (
  SELECT g.* FROM graded g JOIN idf i ON i.term = g.term WHERE i.df BETWEEN 2 AND greatest(2, (SELECT count(*) FROM chunks) // 30)),
evidence AS (
  SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*) AS rare_shared,
         bool_or(greatest(a.grade, b.grade) = 2 AND least(a.grade, b.grade) >= 1) AS anchored
  FROM rare_marked a JOIN rare_marked b ON b.term = a.term AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
weighed AS (
  SELECT p.src, p.dst, coalesce(e.rare_shared >= 2 AND e.anchored, false) AS story,
         round(least(1.0, coalesce(x.shared, 0) / least(ma.mass, mb.mass)), 6) AS score
  FROM pruned p JOIN mass ma ON ma.chunk_id = p.src JOIN mass mb ON mb.chunk_id = p.dst
  LEFT JOIN evidence e ON e.src = p.src AND e.dst = p.dst
  LEFT JOIN (SELECT p.src, p.dst, sum(i.idf) AS shared FROM pruned p
        JOIN postings a ON a.chunk_id = p.src JOIN postings b ON b.chunk_id = p.dst AND b.term = a.term
        JOIN idf i ON i.term = a.term GROUP BY 1, 2) x ON x.src = p.src AND x.dst = p.dst)"""
SIGNALS = """signals AS (
  SELECT s.src, s.dst, s.score AS cos, round(1 - s.score, 6) AS p_contra,
         CASE WHEN a.eval_layer = b.eval_layer THEN s.story END AS same_story,
         CASE WHEN la.quality IS NULL OR lb.quality IS NULL THEN NULL
              WHEN la.toxic <> lb.toxic THEN 'partial' WHEN la.quality <> lb.quality THEN 'conflict'
              ELSE 'agreement' END AS stance
  FROM weighed s JOIN chunks a ON a.chunk_id = s.src JOIN chunks b ON b.chunk_id = s.dst
  LEFT JOIN labels la ON la.doc_id::VARCHAR = s.src LEFT JOIN labels lb ON lb.doc_id::VARCHAR = s.dst)"""
VERDICTS = """verdicts AS (
  SELECT *, CASE
    WHEN cos < 0.14 THEN ['unrelated', 'gate']
    WHEN p_contra >= 0.686 AND same_story IS NULL THEN ['contradicts', 'nli']
    WHEN p_contra >= 0.686 AND same_story AND (stance IS NULL OR stance = 'conflict') THEN ['contradicts', 'nli']
    WHEN p_contra >= 0.686 AND same_story THEN ['related_untyped', 'abstain']
    WHEN same_story AND stance IS NULL THEN ['contradicts', 'band']
    WHEN same_story AND stance = 'conflict' THEN ['contradicts', 'stance']
    WHEN same_story AND stance = 'agreement' AND cos >= 0.486 THEN ['corroborates', 'band']
    WHEN same_story THEN ['related_untyped', 'abstain']
    WHEN cos >= 0.486 THEN ['corroborates', 'band']
    ELSE ['related_untyped', 'band'] END AS v
  FROM signals),
assessed AS (
  SELECT src, dst, v[1] AS relation, 'combined_relation:' || v[2] AS method,
         CASE WHEN (v[1] = 'contradicts' AND v[2] = 'band') OR v[2] = 'gate' OR same_story = false
              THEN cos ELSE p_contra END AS confidence
  FROM verdicts)"""
TYPED = (D.CHUNKS, D.POSTINGS, D.IDF, GRADED, CONTENTS, NEAR, WEIGHED, SIGNALS, VERDICTS)


# --- pairs -------------------------------------------------------------------


@query("story_pairs", D.with_(D.CHUNKS, D.POSTINGS, D.IDF, GRADED, STORY) + "SELECT src, dst, rare_shared, anchored FROM story")
def story_pairs(t):
    return X.story_pairs(t.chunks, CEILING)


@query("cross_outlet_pairs", D.with_(D.CHUNKS, D.POSTINGS, D.IDF, GRADED, STORY) + """
SELECT s.src, s.dst, s.rare_shared FROM story s JOIN chunks a ON a.chunk_id = s.src JOIN chunks b ON b.chunk_id = s.dst
WHERE a.outlet <> b.outlet""")
def cross_outlet_pairs(t):
    return X.across_outlets(story_pairs(t), t.chunks).select("src", "dst", "rare_shared")


@query("pair_relatedness", D.with_(D.CHUNKS, D.POSTINGS, D.IDF, GRADED, STORY, SCORED) + "SELECT src, dst, score FROM scored")
def pair_relatedness(t):
    return X.pair_relatedness(story_pairs(t), t.chunks).select("src", "dst", "score")


@query("related_pairs", D.with_(D.CHUNKS, CONTENTS) + "SELECT src, dst, score, src_copies, dst_copies FROM related")
def related_pairs(t):
    return X.related_pairs(t.chunks, FLOOR)


@query("relatedness_gate_counts", D.with_(D.CHUNKS, CONTENTS) + """
SELECT r.related::BIGINT AS related, (n.n * (n.n - 1) / 2 - r.related)::BIGINT AS unrelated
FROM (SELECT coalesce((SELECT sum(src_copies * dst_copies) FROM related), 0)
           + (SELECT sum(copies * (copies - 1) / 2) FROM contents) AS related) r, (SELECT count(*) AS n FROM chunks) n""")
def relatedness_gate_counts(t):
    return X.relatedness_counts(t.chunks, related_pairs(t))


# --- typing ------------------------------------------------------------------


def near_pairs(t):
    """Vector neighbours past the gate."""
    asked = t.vectors.select(F.col("chunk_id").cast("bigint").alias("query_id"), F.col("vector").alias("query_vector"))
    found = R.dense_candidates(asked, t.vectors, NEIGHBOURS + 1).where(F.col("query_id").cast("string") != F.col("chunk_id"))
    near = R.top_per_query(found, NEIGHBOURS, F.col("similarity").desc(), F.col("chunk_id"))
    x, y = F.col("query_id").cast("string"), F.col("chunk_id")
    return near.where(F.col("similarity") >= X.CALIBRATED.gate).select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")).distinct()


def _facts(t, *more):
    """Language and labels of every chunk and what is ``more`` asked of it, a row for each of its labels."""
    labels = t.table("labels").select(F.col("doc_id").cast("string").alias("chunk_id"), "quality", "toxic")
    return t.chunks.select("chunk_id", F.col("eval_layer").alias("layer"), *more).join(labels, "chunk_id", "left")


def signals(t):
    """Pair signals of all pairs stage one keeps: relatedness stands in for cosine and its
    complement for the NLI score; story evidence, a flag, exists within one language;
    labels give the stance."""
    return _signals(t, _facts(t))


def split_signals(t, *kept, more=()):
    """:func:`signals` with ``kept`` (facts of an end, like ``src_layer``, or what is ``more`` asked of
    chunks), of pairs that are one row and alone between their documents, and of pairs that may be several
    since an end is the id of several chunks, has several labels or is a part of a document.

    The former know of each other's columns what a join on the pair would bring.
    """
    facts = _facts(t, *more)
    one = facts.groupBy("chunk_id").agg(((F.count(F.lit(1)) == 1) & ~F.col("chunk_id").contains(":")).alias("one"))
    facts = durable(facts.join(one, "chunk_id"))
    rows = _signals(t, facts, *kept, (F.col("src_one") & F.col("dst_one")).alias("once"))
    repeated = not facts.where("NOT one").isEmpty()
    several = rows.where("NOT once") if repeated else rows.limit(0)      # not looked for in vain
    return rows.where("once").drop("once"), several.drop("once")


def _signals(t, facts, *kept):
    rows = X.scan_pairs(t.chunks, near_pairs(t), facts, FLOOR)
    return rows.select(
        "src", "dst", *kept, F.col("score").alias("cos"), F.round(1 - F.col("score"), 6).alias("p_contra"),
        F.when(F.col("src_layer") == F.col("dst_layer"), F.col("story")).alias("same_story"),
        F.when(F.col("src_quality").isNull() | F.col("dst_quality").isNull(), F.lit(None))
        .when(F.col("src_toxic") != F.col("dst_toxic"), "partial")
        .when(F.col("src_quality") != F.col("dst_quality"), "conflict")
        .otherwise("agreement").alias("stance"),
    )


@query("relation_assessments", D.with_(*TYPED) + "SELECT src, dst, relation, method, confidence FROM assessed")
def relation_assessments(t):
    return X.assessed(signals(t))


PROPOSED = """proposed AS (
  SELECT row_number() OVER (ORDER BY src, dst) AS seq, * FROM assessed WHERE relation IN ('contradicts', 'supersedes'))"""


@query("nli_only_relations", D.with_(*TYPED) + """
SELECT src, dst, CASE WHEN p_contra >= 0.5 THEN 'contradicts' WHEN cos >= 0.5 THEN 'corroborates' ELSE 'related_untyped' END AS relation
FROM signals""")
def nli_only_relations(t):
    return signals(t).select("src", "dst", X.nli_relation(F.col("p_contra"), F.col("cos")).alias("relation"))


@query("nli_cascade")
def nli_cascade(t):
    """p_contra asked only of pairs the cheap stages leave open; the stand-in
    scorer is the share of the hypothesis's terms the premise lacks."""
    scorer = lambda premise, hypothesis: F.size(F.array_except(T.terms(hypothesis), T.terms(premise))) / F.greatest(
        F.size(T.terms(hypothesis)), F.lit(1)
    )
    rows = X.with_nli(signals(t), t.chunks, scorer, X.CALIBRATED)
    return rows.select("src", "dst", F.round("p_contra", 6).alias("p_contra"), "same_story")


@query("quantity_mentions")
def quantity_mentions(t):
    return X.quantity_mentions(t.chunks).select("chunk_id", F.posexplode("mentions").alias("position", "m")).select(
        "chunk_id", "position", "m.value", "m.unit_class", "m.revised", "m.as_of", "m.start", "m.end",
        F.array_join("m.measure", " ").alias("measure"), F.array_join("m.scope", " ").alias("scope"),
    )


@query("quantity_stance")
def quantity_stance(t):
    return X.with_stance(story_pairs(t), X.quantity_mentions(t.chunks)).select("src", "dst", "stance")


@query("escalation_candidates", D.with_(*TYPED) + """
SELECT src, dst, cos FROM signals WHERE NOT coalesce(same_story, false) AND cos >= 0.30
ORDER BY cos DESC, src, dst LIMIT 400""")
def escalation_candidates(t):
    return X.escalation_candidates(signals(t)).select("src", "dst", "cos")


JUDGED = """judged AS (
  SELECT a.conv_id || ':' || a.turn AS src, b.conv_id || ':' || b.turn AS dst,
         CASE WHEN a.role = b.role THEN 'first UNRELATED then' || chr(10) || 'final: agree' WHEN length(b.text) > length(a.text)
              THEN 'not AGREE but DIVERGENT' ELSE b.text END AS answer
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
labelled AS (
  SELECT src, dst, coalesce(regexp_extract_all(upper(answer), 'FINAL:\\s*\\W*(DIVERGENT|AGREE|UNRELATED)', 1)[-1],
                            regexp_extract_all(upper(answer), '(DIVERGENT|AGREE|UNRELATED)', 1)[-1], 'UNRELATED') AS label
  FROM judged)"""


def judged_turns(t):
    """Successive turns with a judge's answer built from their roles and lengths."""
    later = t.turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("chunk_id").alias("dst"),
        F.col("role").alias("dst_role"), F.col("text").alias("dst_text"),
    )
    answer = (
        F.when(F.col("role") == F.col("dst_role"), "first UNRELATED then\nfinal: agree")
        .when(F.length("dst_text") > F.length("text"), "not AGREE but DIVERGENT")
        .otherwise(F.col("dst_text"))
    )
    return t.turns.join(later, ["conv_id", "turn"]).select(
        F.col("chunk_id").alias("src"), "dst", X.judge_label(answer).alias("label")
    )


@query("judge_labels", D.with_(JUDGED) + "SELECT src, dst, label FROM labelled")
def judge_labels(t):
    return judged_turns(t)


@query("escalated_proposals", D.with_(JUDGED) + """
SELECT src, dst, 'contradicts' AS relation, 'llm_frame_judge:escalation:turns' AS method, 0.7::DOUBLE AS confidence
FROM labelled WHERE label = 'DIVERGENT'""")
def escalated_proposals(t):
    return X.escalated_proposals(judged_turns(t), "turns")


# --- proposals ---------------------------------------------------------------

LINE_PAIRS = f"""sents AS (
  SELECT chunk_id, text FROM lines),
longw AS (SELECT chunk_id, unnest({D.terms('text')}) AS term FROM sents),
ldf AS (SELECT term, count(*) AS df FROM longw GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
lpairs AS (
  SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*) AS shared
  FROM longw a JOIN ldf d ON d.term = a.term JOIN longw b ON b.term = a.term AND a.chunk_id < b.chunk_id GROUP BY 1, 2
  HAVING count(*) >= 2),
lprops AS (
  SELECT src, dst, CASE WHEN shared = 3 THEN 'supersedes' ELSE 'contradicts' END AS relation,
         'combined_relation:' || CASE WHEN shared % 2 = 0 THEN 'nli' ELSE 'band' END AS method,
         round(1 - 1.0 / shared, 6) AS confidence FROM lpairs)"""


def line_proposals(t):
    """Proposals between lines that share terms found in two to four lines."""
    pairs = X.story_pairs(t.lines, 4)
    return pairs.select(
        "src", "dst",
        F.when(F.col("rare_shared") == 3, "supersedes").otherwise("contradicts").alias("relation"),
        F.concat(F.lit("combined_relation:"), F.when(F.col("rare_shared") % 2 == 0, "nli").otherwise("band")).alias("method"),
        F.round(1 - F.lit(1.0) / F.col("rare_shared"), 6).alias("confidence"),
    )


def sequenced(rows):
    """A total order over proposals as a sortable number (hash of the pair)."""
    return rows.withColumn(
        "seq", F.conv(F.substring(H.content_hash(F.concat_ws("|", "src", "dst")), 1, 12), 16, 10).cast("bigint")
    )


SEQ = "('0x' || left(sha256(src || '|' || dst), 12))::BIGINT"


@query("doc_pair_dedup", D.with_(D.LINES, LINE_PAIRS) + f"""
SELECT src, dst, relation, method, confidence FROM (
  SELECT *, row_number() OVER (
    PARTITION BY least(split_part(src, ':', 1), split_part(dst, ':', 1)), greatest(split_part(src, ':', 1), split_part(dst, ':', 1))
    ORDER BY method LIKE '%:nli' DESC, confidence DESC, seq) AS rn
  FROM (SELECT *, {SEQ} AS seq FROM lprops WHERE relation = 'contradicts') p) x WHERE rn = 1
UNION ALL SELECT src, dst, relation, method, confidence FROM lprops WHERE relation <> 'contradicts'""")
def doc_pair_dedup(t):
    return X.one_per_doc_pair(sequenced(line_proposals(t))).drop("seq")


@query("uncovered_pairs", D.with_(*TYPED, D.LINES, LINE_PAIRS) + """
SELECT s.src, s.dst FROM signals s WHERE NOT EXISTS (
  SELECT 1 FROM lprops p WHERE least(split_part(p.src, ':', 1), split_part(p.dst, ':', 1)) = least(s.src, s.dst)
                           AND greatest(split_part(p.src, ':', 1), split_part(p.dst, ':', 1)) = greatest(s.src, s.dst))""")
def uncovered_pairs(t):
    return X.uncovered(signals(t), line_proposals(t)).select("src", "dst")


# --- the whole scan ------------------------------------------------------------


@query("corpus_scan", D.with_(*TYPED, r"""scanned AS (
  SELECT a.src, a.dst, a.relation, a.method, a.confidence, s.text AS src_text, d.text AS dst_text
  FROM assessed a JOIN chunks s ON s.chunk_id = a.src JOIN chunks d ON d.chunk_id = a.dst WHERE a.relation = 'contradicts')""") + r"""
SELECT src, dst, method, CASE
    WHEN confidence < CASE WHEN method LIKE '%:band' THEN 0.35 ELSE 0.5 END THEN 'denied_low_confidence'
    WHEN NOT regexp_matches(src_text, '\S') OR NOT regexp_matches(dst_text, '\S') THEN 'denied_invalid_anchor'
    ELSE 'admitted' END AS code
FROM scanned""")
def corpus_scan(t):
    return scan_codes(t).select("src", "dst", "method", "code")


def scan_codes(t, entailed=None):
    """Codes of the whole scan; pairs that are alone between their documents are judged where
    they are found.  ``entailed`` adds entailment scores to signals."""
    tokens, end = F.size(T.whitespace_words(F.col("text"))), T.lead_anchor(F.col("text"))["end"]
    ends = [f"{k}_{c}" for k in ("src", "dst") for c in ("tokens", "end")]
    once, several = split_signals(t, *ends, more=(tokens.alias("tokens"), end.alias("end")))
    several = several.drop(*ends)
    scores = () if entailed is None else ("entail_ab", "entail_ba")
    lone = N.lone_proposals(once if entailed is None else entailed(once), scores)
    more = None if entailed is None else entailed(several).select("src", "dst", *scores)
    return N.admitted_scan(N.proposals(several, t.chunks), t.chunks, more, lone=lone)


def scan_entailment(signals):
    """Pairs of one quality stand for texts that entail each other."""
    return signals.withColumns({
        "entail_ab": F.when(F.col("stance") == "agreement", 0.9).otherwise(0.1),
        "entail_ba": F.when(F.col("stance").isin("agreement", "partial"), 0.9).otherwise(0.1),
    })


@query("corpus_scan_counts", D.with_(*TYPED) + """
SELECT CASE WHEN a.confidence < CASE WHEN a.method LIKE '%:band' THEN 0.35 ELSE 0.5 END THEN 'denied_low_confidence'
            WHEN s.stance = 'agreement' THEN 'denied_relation_mismatch' ELSE 'admitted' END AS code, count(*) AS n
FROM assessed a JOIN signals s ON s.src = a.src AND s.dst = a.dst WHERE a.relation = 'contradicts' GROUP BY 1""")
def corpus_scan_counts(t):
    return A.code_counts(scan_codes(t, scan_entailment))


@query("pruned_pairs", D.with_(D.CHUNKS, CONTENTS, NEAR) + "SELECT src, dst FROM pruned")
def pruned_pairs(t):
    """Pairs above the relatedness floor, or vector neighbours past the gate."""
    return N.pruned(t.chunks, near_pairs(t), FLOOR)


# --- admission ---------------------------------------------------------------

GATE = r"""base AS (
  SELECT a.conv_id, a.turn, b.turn AS dst_turn, a.role, a.conv_id || ':' || a.turn AS src, b.conv_id || ':' || b.turn AS dst,
         len(list_filter(regexp_split_to_array(a.text, '\s+'), lambda w: w <> '')) AS n,
         length(a.text) AS la, length(b.text) AS lb
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
props AS (
  SELECT conv_id * 1000 + turn * 3 + k AS seq, conv_id, turn, k, la, lb, n,
         CASE WHEN k = 2 THEN dst ELSE src END AS src,
         CASE WHEN k = 2 AND turn % 4 = 3 THEN conv_id || ':gone' WHEN k = 2 THEN src WHEN k = 1 AND turn % 5 = 4 THEN src ELSE dst END AS dst,
         CASE WHEN role = 'user' THEN 'contradicts' ELSE 'supersedes' END AS relation,
         'turns:' || CASE WHEN k = 0 THEN 'band' ELSE 'nli' END AS method,
         round(least(1.0, lb / 400.0), 6) AS confidence,
         CASE WHEN k = 1 AND turn % 3 = 2 THEN n + 1 ELSE n END AS anchor_end
  FROM base, generate_series(0, 2) g(k)),
coded AS (
  SELECT p.*, CASE
    WHEN confidence < CASE WHEN relation = 'contradicts' AND method LIKE '%:band' THEN 0.35 ELSE 0.5 END THEN 'denied_low_confidence'
    WHEN dst LIKE '%:gone' THEN 'denied_unknown_chunk'
    WHEN src = dst THEN 'denied_self_loop'
    WHEN NOT (0 < anchor_end AND anchor_end <= s.n) THEN 'denied_invalid_anchor' END AS row_code,
    relation = 'contradicts' AND la % 7 < 3 AND lb % 5 < 3 AS failed,
    relation || '|' || CASE WHEN relation = 'contradicts' THEN least(src, dst) || '|' || greatest(src, dst) ELSE src || '|' || dst END AS key
  FROM props p LEFT JOIN (SELECT conv_id || ':' || turn AS id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n
                          FROM conversations) s ON s.id = p.src),
firsts AS (SELECT key, min(seq) AS first_seq FROM coded WHERE row_code IS NULL AND NOT failed GROUP BY 1),
orders AS (SELECT src, dst, min(seq) AS seq FROM coded WHERE row_code IS NULL AND relation = 'supersedes' GROUP BY 1, 2),
codes AS (
  SELECT c.*, CASE WHEN row_code IS NOT NULL THEN row_code
    WHEN relation = 'supersedes' AND EXISTS (SELECT 1 FROM orders f, orders o WHERE f.src = c.dst AND f.dst = c.src
           AND o.src = c.src AND o.dst = c.dst AND f.seq < o.seq) THEN 'denied_cycle'
    WHEN seq > first_seq THEN 'denied_duplicate' WHEN failed THEN 'denied_relation_mismatch' ELSE 'admitted' END AS code
  FROM coded c LEFT JOIN firsts f ON f.key = c.key)"""


def turn_proposals(t):
    """Three proposals per answered turn (forward, again, backward), with faults
    at fixed turn numbers so that every admission code occurs."""
    n_words = F.size(T.whitespace_words(F.col("text")))
    later = t.turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("chunk_id").alias("next_id"), F.length("text").alias("lb")
    )
    base = t.turns.join(later, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", "chunk_id", "next_id", n_words.alias("n"), F.length("text").alias("la"), "lb",
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"),
    )
    k, turn = F.col("k"), F.col("turn")
    entail = lambda cond: F.when(cond, F.lit(0.9)).otherwise(F.lit(0.1))
    return base.select(
        (F.col("conv_id") * 1000 + turn * 3 + k).alias("seq"),
        F.when(k == 2, F.col("next_id")).otherwise(F.col("chunk_id")).alias("src"),
        F.when((k == 2) & (turn % 4 == 3), F.concat_ws(":", "conv_id", F.lit("gone")))
        .when((k == 2) | ((k == 1) & (turn % 5 == 4)), F.col("chunk_id"))
        .otherwise(F.col("next_id")).alias("dst"),
        F.when(F.col("role") == "user", "contradicts").otherwise("supersedes").alias("relation"),
        F.concat(F.lit("turns:"), F.when(k == 0, "band").otherwise("nli")).alias("method"),
        F.round(F.least(F.lit(1.0), F.col("lb") / 400.0), 6).alias("confidence"),
        F.struct(
            F.lit(0).alias("start"),
            (F.col("n") + F.when((k == 1) & (turn % 3 == 2), 1).otherwise(0)).alias("end"),
        ).alias("src_anchor"),
        F.lit(None).cast("struct<start:int,end:int>").alias("dst_anchor"),
        entail(F.col("la") % 7 < 3).alias("entail_ab"),
        entail(F.col("lb") % 5 < 3).alias("entail_ba"),
    )


def turn_admissions(t):
    registry = t.turns.select("chunk_id", F.size(T.whitespace_words(F.col("text"))).alias("n_tokens"))
    return A.admissions(turn_proposals(t), registry, min_confidence=0.5)


@query("admission_codes", D.with_(GATE) + "SELECT seq, src, dst, relation, code FROM codes")
def admission_codes(t):
    return turn_admissions(t).select("seq", "src", "dst", "relation", "code")


@query("admission_counts", D.with_(GATE) + "SELECT code, count(*) AS n FROM codes GROUP BY 1")
def admission_counts(t):
    return A.code_counts(turn_admissions(t))


@query("admitted_edges", D.with_(GATE) + """
SELECT src, dst, relation, method AS proposer, confidence,
       left(sha256(relation || '|' || src || '|' || dst || '|(0, ' || anchor_end || ')|None'), 16) AS content_hash
FROM codes WHERE code = 'admitted'""")
def admitted_edges(t):
    return A.stamped(turn_admissions(t), F.current_timestamp()).select(
        "src", "dst", "relation", "proposer", "confidence", "content_hash"
    )


ORDERED = """turns AS (
  SELECT conv_id, turn, role, conv_id || ':' || turn AS id, lead(conv_id || ':' || turn) OVER w AS nxt,
         first_value(conv_id || ':' || turn) OVER w AS root
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query("supersedes_cycles", "WITH RECURSIVE " + ORDERED + """,
forward AS (SELECT id AS src, nxt AS dst FROM turns WHERE nxt IS NOT NULL),
back AS (SELECT id AS src, root AS dst FROM turns WHERE role = 'assistant' AND id <> root),
reach AS (
  SELECT src, dst FROM forward UNION SELECT r.src, f.dst FROM reach r JOIN forward f ON f.src = r.dst)
SELECT b.src, b.dst FROM back b JOIN reach r ON r.src = b.dst AND r.dst = b.src""")
def supersedes_cycles(t):
    """Each turn supersedes the next; then assistant turns point at the opening."""
    opening = t.turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    rows = t.turns.join(opening, "conv_id")
    later = t.turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("chunk_id").alias("dst"))
    forward = t.turns.join(later, ["conv_id", "turn"]).select(
        F.col("chunk_id").alias("src"), "dst", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    )
    back = rows.where((F.col("role") == "assistant") & (F.col("turn") != F.col("first"))).select(
        F.col("chunk_id").alias("src"), F.concat_ws(":", "conv_id", "first").alias("dst"),
        (F.col("conv_id") * 1000 + 500 + F.col("turn")).alias("seq"),
    )
    return A.cycle_edges(forward.unionByName(back))
