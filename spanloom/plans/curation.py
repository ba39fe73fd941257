"""Registered queries: the label log, backlogs, datasets and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as K
from ..operators import labels as L
from ..operators import relations as X
from . import dialect as D
from . import relating
from .registry import query

# --- carrier: an event is a labelling act on a pair of chunks ------------------

LOG = """log AS (
  SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id::VARCHAR AS src,
         CASE WHEN json_extract_string(props, '$.k')::BIGINT = user_id THEN 'x' ELSE json_extract_string(props, '$.k') END AS dst,
         CASE event_type WHEN 'error' THEN 'contradicts' WHEN 'signup' THEN 'contradicts' WHEN 'purchase' THEN 'corroborates'
              WHEN 'click' THEN 'unrelated' WHEN 'view' THEN CASE WHEN value < 100 THEN 'related_untyped' ELSE 'supersedes' END END AS relation,
         CASE event_type WHEN 'error' THEN 'issue_frame' WHEN 'signup' THEN 'story' END AS relation_class
  FROM events),
gold AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts DESC, seq DESC) AS rn FROM log) x
  WHERE rn = 1)"""


def log(t):
    """user_id and the number in props name the pair; the type names the label."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return t.table("events").select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.col("user_id").cast("string").alias("src"),
        F.when(k.cast("bigint") == F.col("user_id"), "x").otherwise(k).alias("dst"),
        F.when(kind.isin("error", "signup"), "contradicts").when(kind == "purchase", "corroborates").when(kind == "click", "unrelated")
        .when(F.col("value") < 100, "related_untyped").otherwise("supersedes").alias("relation"),
        F.when(kind == "error", "issue_frame").when(kind == "signup", "story").alias("relation_class"),
    )


TEXTS = "texts AS (SELECT doc_id::VARCHAR AS chunk_id, text FROM documents)"
BAR = """bar_ids AS (SELECT DISTINCT doc_id::VARCHAR AS chunk_id FROM labels WHERE toxic = 1),
bar_texts AS (SELECT DISTINCT d.text FROM documents d JOIN bar_ids b ON b.chunk_id = d.doc_id::VARCHAR),
barred AS (SELECT t.chunk_id FROM texts t WHERE t.text IN (SELECT text FROM bar_texts)),
bar_pairs AS (SELECT src, dst FROM log WHERE relation = 'supersedes')"""


def texts(t):
    return t.chunks.select("chunk_id", "text")


def bar(t):
    """Documents labelled toxic form the held-out bar."""
    ids = t.table("labels").where(F.col("toxic") == 1).select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()
    return ids, texts(t).join(ids, "chunk_id", "left_semi").select("text")


@query("label_fold", D.with_(LOG) + "SELECT seq, ts, src, dst, relation, relation_class FROM gold")
def label_fold(t):
    return L.folded(log(t))


@query("label_merge", D.with_(LOG) + "SELECT seq, ts, src, dst, relation, relation_class FROM gold")
def label_merge(t):
    """Folding two overlapping copies of the log changes nothing."""
    return L.folded(L.merged(log(t), log(t).where(F.col("relation") != "unrelated")))


@query("seed_missing", D.with_(LOG) + """
SELECT a.seq, a.src, a.dst FROM log a WHERE relation = 'contradicts' AND NOT EXISTS (
  SELECT 1 FROM log b WHERE b.relation <> 'contradicts' AND least(a.src, a.dst) = least(b.src, b.dst) AND greatest(a.src, a.dst) = greatest(b.src, b.dst))""")
def seed_missing(t):
    rows = log(t)
    return L.absent_from(rows.where(F.col("relation") == "contradicts"), rows.where(F.col("relation") != "contradicts")).select("seq", "src", "dst")


@query("relabel_changes", D.with_(LOG) + """
SELECT n.seq, n.src, n.dst FROM log n JOIN gold g ON least(n.src, n.dst) = least(g.src, g.dst) AND greatest(n.src, n.dst) = greatest(g.src, g.dst)
WHERE (n.relation, n.relation_class) IS DISTINCT FROM (g.relation, g.relation_class)""")
def relabel_changes(t):
    return L.changed_against(log(t), log(t)).select("seq", "src", "dst")


@query("curator_agreement", D.with_(LOG) + """
, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts DESC, seq DESC) AS rn
          FROM log WHERE src > dst) x WHERE rn = 1),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts DESC, seq DESC) AS rn
        FROM log WHERE src <= dst) x WHERE rn = 1)
SELECT least(a.src, a.dst) AS src, greatest(a.src, a.dst) AS dst, a.relation AS relation_one, b.relation AS relation_two,
       (a.relation, a.relation_class) IS NOT DISTINCT FROM (b.relation, b.relation_class) AS agrees
FROM one a JOIN two b ON least(a.src, a.dst) = least(b.src, b.dst) AND greatest(a.src, a.dst) = greatest(b.src, b.dst)""")
def curator_agreement(t):
    """Curator one labels pairs larger id first, curator two the other way."""
    rows = log(t)
    return L.agreement(rows.where(F.col("src") > F.col("dst")), rows.where(F.col("src") <= F.col("dst")))


@query("readiness_counts", D.with_(LOG, TEXTS, BAR) + """
SELECT issue_frame, agree, unrelated, story, issue_frame >= 20 AND agree >= 20 AND unrelated >= 20 AND story >= 20 AS ready
FROM (SELECT count(*) FILTER (relation = 'contradicts' AND relation_class = 'issue_frame') AS issue_frame,
             count(*) FILTER (relation = 'corroborates') AS agree, count(*) FILTER (relation = 'unrelated') AS unrelated,
             count(*) FILTER (relation = 'contradicts' AND relation_class = 'story') AS story
      FROM gold g WHERE src NOT IN (SELECT chunk_id FROM barred) AND dst NOT IN (SELECT chunk_id FROM barred)
        AND NOT EXISTS (SELECT 1 FROM bar_pairs p WHERE least(p.src, p.dst) = least(g.src, g.dst) AND greatest(p.src, p.dst) = greatest(g.src, g.dst))) x""")
def readiness_counts(t):
    rows = log(t)
    _, bar_texts = bar(t)
    return L.readiness(L.folded(rows), texts(t), rows.where(F.col("relation") == "supersedes"), bar_texts)


DATASET = """dataset AS (
  SELECT src, dst, label, CASE WHEN label IS NULL THEN 'schema'
    WHEN src IN (SELECT chunk_id FROM bar_ids) OR dst IN (SELECT chunk_id FROM bar_ids) THEN 'bar_chunk'
    WHEN src NOT IN (SELECT chunk_id FROM texts) OR dst NOT IN (SELECT chunk_id FROM texts) THEN 'text_unresolved'
    WHEN src IN (SELECT chunk_id FROM barred) OR dst IN (SELECT chunk_id FROM barred) THEN 'bar_text_alias' END AS drop_reason
  FROM (SELECT *, CASE WHEN relation = 'contradicts' AND relation_class = 'issue_frame' THEN 'DIVERGENT'
                       WHEN relation = 'corroborates' THEN 'AGREE' WHEN relation = 'related_untyped' THEN 'RELATED_UNTYPED'
                       WHEN relation = 'unrelated' THEN 'UNRELATED' END AS label FROM gold) g)"""


def dataset(t):
    ids, bar_texts = bar(t)
    return L.dataset_rows(L.folded(log(t)), texts(t), ids, bar_texts)


@query("dataset_rows", D.with_(LOG, TEXTS, BAR, DATASET) + "SELECT src, dst, label, drop_reason FROM dataset")
def dataset_rows(t):
    return dataset(t)


@query("dataset_drops", D.with_(LOG, TEXTS, BAR, DATASET) + "SELECT drop_reason, count(*) AS n FROM dataset GROUP BY 1")
def dataset_drops(t):
    return L.drop_counts(dataset(t))


@query("calibration_export", D.with_(LOG, TEXTS, BAR, *relating.TYPED) + """
SELECT g.src, g.dst, g.relation, s.cos, s.p_contra, s.same_story, s.stance,
       CASE WHEN g.relation NOT IN ('contradicts', 'corroborates', 'related_untyped', 'unrelated') THEN 'not_a_classifier_output'
            WHEN g.src NOT IN (SELECT chunk_id FROM texts) OR g.dst NOT IN (SELECT chunk_id FROM texts) THEN 'text_unresolved'
            WHEN EXISTS (SELECT 1 FROM bar_pairs p WHERE least(p.src, p.dst) = least(g.src, g.dst) AND greatest(p.src, p.dst) = greatest(g.src, g.dst))
            THEN 'eval_pair' END AS drop_reason
FROM gold g LEFT JOIN signals s ON least(s.src, s.dst) = least(g.src, g.dst) AND greatest(s.src, s.dst) = greatest(g.src, g.dst)""")
def calibration_export(t):
    rows = log(t)
    return L.calibration_rows(L.folded(rows), texts(t), relating.signals(t), rows.where(F.col("relation") == "supersedes"))


# --- backlogs ----------------------------------------------------------------


@query("label_backlog", D.with_(*relating.TYPED, LOG) + """
SELECT src, dst, cos, CASE WHEN p_contra >= 0.5 AND cos >= 0.45 THEN 2.0::DOUBLE WHEN cos >= 0.13 AND cos < 0.45 THEN 1.0 ELSE 0.0 END AS tier
FROM signals s WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE least(g.src, g.dst) = least(s.src, s.dst) AND greatest(g.src, g.dst) = greatest(s.src, s.dst))""")
def label_backlog(t):
    return L.backlog(relating.signals(t), L.folded(log(t))).select("src", "dst", "cos", "tier")


@query("residue_ranking", D.with_(*relating.TYPED) + """
, residue AS (SELECT *, row_number() OVER (ORDER BY cos DESC, src, dst) AS cos_rank FROM signals WHERE NOT coalesce(same_story, false) AND cos >= 0.30),
hinted AS (SELECT *, coalesce(cos_rank <= 400 AND cos >= 0.45 AND p_contra >= 0.4, false) AS hint FROM residue)
SELECT src, dst, hint, position FROM (
  SELECT *, row_number() OVER (ORDER BY hint DESC, CASE WHEN hint THEN p_contra END DESC NULLS LAST, cos DESC, src, dst) AS position FROM hinted) x
WHERE position <= 400""")
def residue_ranking(t):
    from ..operators.relations import ESCALATION_FLOOR

    open_pairs = relating.signals(t).where(~F.coalesce("same_story", F.lit(False)) & (F.col("cos") >= ESCALATION_FLOOR))
    return L.residue_ranking(open_pairs, ceiling=0.45, contra=0.4).select("src", "dst", "hint", "position")


@query("story_band", D.with_(*relating.TYPED) + """
, ranked AS (SELECT *, row_number() OVER (ORDER BY p_contra DESC, src, dst) AS hi, row_number() OVER (ORDER BY p_contra, src DESC, dst DESC) AS lo
             FROM signals WHERE same_story)
SELECT src, dst, p_contra FROM ranked WHERE hi <= 1000 OR lo <= 1000""")
def story_band(t):
    return L.story_band(relating.signals(t)).select("src", "dst", "p_contra")


@query("authored_ranks", D.with_(*relating.TYPED) + """
, offered AS (SELECT src, dst, row_number() OVER (ORDER BY cos DESC, src, dst) AS position FROM signals WHERE NOT coalesce(same_story, false) AND cos >= 0.30),
authored AS (SELECT src, dst FROM signals WHERE stance = 'conflict')
SELECT a.src, a.dst, CASE WHEN o.position <= 400 THEN o.position END AS position FROM authored a LEFT JOIN offered o ON o.src = a.src AND o.dst = a.dst""")
def authored_ranks(t):
    """Where pairs a curator typed as conflicts stand in the escalation ranking."""
    rows = relating.signals(t)
    open_pairs = rows.where(~F.coalesce("same_story", F.lit(False)) & (F.col("cos") >= 0.30))
    offered = L.residue_ranking(open_pairs, ceiling=2.0, contra=2.0)
    return L.authored_ranks(offered, rows.where(F.col("stance") == "conflict").select("src", "dst"))


# --- calibration -------------------------------------------------------------

SAMPLES = """samples AS (
  SELECT ((round(cos * 1e6)::BIGINT + 5000) // 10000) / 100.0::DOUBLE AS cos,
         ((round(p_contra * 1e6)::BIGINT * 7 + CASE WHEN la.quality = 1 THEN 2000000 ELSE 0 END + 500000) // 1000000) / 10.0::DOUBLE AS p_contra, same_story,
         CASE stance WHEN 'conflict' THEN 'contradicts' WHEN 'agreement' THEN 'corroborates' WHEN 'partial' THEN 'related_untyped' ELSE 'unrelated' END AS relation
  FROM signals s LEFT JOIN labels la ON la.doc_id::VARCHAR = s.src),
cells AS (SELECT cos, p_contra, same_story, relation, count(*) AS w FROM samples GROUP BY ALL),
cv AS (SELECT cos AS v, row_number() OVER (ORDER BY cos) AS i, lead(cos) OVER (ORDER BY cos) AS nv FROM (SELECT DISTINCT cos FROM cells) x),
pv AS (SELECT p_contra AS v, row_number() OVER (ORDER BY p_contra) AS i, lead(p_contra) OVER (ORDER BY p_contra) AS nv FROM (SELECT DISTINCT p_contra FROM cells) x),
ccut AS (SELECT 0 AS i, min(v) - 1e-6 AS cut FROM cv UNION ALL SELECT i, coalesce((v + nv) / 2, v + 1e-6) FROM cv),
pcut AS (SELECT 0 AS i, min(v) - 1e-6 AS cut FROM pv UNION ALL SELECT i, coalesce((v + nv) / 2, v + 1e-6) FROM pv),
cm AS (SELECT i, cut, round((SELECT min(abs(cut - v)) FROM cv), 9) AS margin FROM ccut),
pm AS (SELECT i, cut, round((SELECT min(abs(cut - v)) FROM pv), 9) AS margin FROM pcut),
grid AS (
  SELECT g.cut AS gate, c.cut AS ceiling, k.cut AS contra, round(g.margin + c.margin + k.margin, 9) AS margin
  FROM cm g JOIN cm c ON c.i >= g.i CROSS JOIN pm k),
graded AS (
  SELECT gate, ceiling, contra, margin, sum(CASE WHEN relation = CASE WHEN cos < gate THEN 'unrelated'
           WHEN same_story OR (same_story IS NULL AND p_contra >= contra) THEN 'contradicts'
           WHEN cos >= ceiling THEN 'corroborates' ELSE 'related_untyped' END THEN w ELSE 0 END)::BIGINT AS n_right
  FROM grid CROSS JOIN cells GROUP BY ALL)"""


def samples(t):
    """Signals with both scores rounded (in whole millionths, so that halves round alike
    everywhere); the pair's stance gives the gold relation."""
    millionths = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    raised = F.when(F.col("quality") == 1, 2_000_000).otherwise(0)
    stance = F.col("stance")
    once, several = relating.split_signals(t, "src_quality")      # a label stands beside most pairs already
    quality = t.table("labels").select(F.col("doc_id").cast("string").alias("src"), "quality")
    rows = once.withColumnRenamed("src_quality", "quality").unionByName(several.drop("src_quality").join(quality, "src", "left"))
    return rows.select(
        (F.floor((millionths("cos") + 5_000) / 10_000) / 100.0).alias("cos"),
        (F.floor((millionths("p_contra") * 7 + raised + 500_000) / 1_000_000) / 10.0).alias("p_contra"),
        "same_story",
        F.when(stance == "conflict", "contradicts").when(stance == "agreement", "corroborates")
        .when(stance == "partial", "related_untyped").otherwise("unrelated").alias("relation"),
    )


@query("calibrated_thresholds", D.with_(*relating.TYPED, SAMPLES.replace("graded AS (", "outcome AS (")) + """
SELECT round(gate, 9) AS gate, round(ceiling, 9) AS ceiling, round(contra, 9) AS contra, n_right, margin
FROM outcome ORDER BY n_right DESC, margin DESC, gate, ceiling, contra LIMIT 1""")
def calibrated_thresholds(t):
    best = K.calibrated(samples(t))
    return best.select(*[F.round(c, 9).alias(c) for c in ("gate", "ceiling", "contra")], "n_right", "margin")


FOLDS = """spots AS (
  SELECT v, i, coalesce((lag(v) OVER (ORDER BY v) + nv) / 2, nv - 1e-6, lag(v) OVER (ORDER BY v) + 1e-6) AS at FROM cv),
pspots AS (
  SELECT v, i, coalesce((lag(v) OVER (ORDER BY v) + nv) / 2, nv - 1e-6, lag(v) OVER (ORDER BY v) + 1e-6) AS at FROM pv),
held AS (
  SELECT c.*, row_number() OVER () AS h, s.i AS ci, q.i AS qi, s.at AS c_at, q.at AS p_at,
         round((SELECT min(abs(s.at - v)) FROM cv WHERE v <> c.cos), 9) AS c_margin,
         round((SELECT min(abs(q.at - v)) FROM pv WHERE v <> c.p_contra), 9) AS p_margin,
         sum(w) OVER (PARTITION BY c.cos) = 1 AS c_alone, sum(w) OVER (PARTITION BY c.p_contra) = 1 AS p_alone
  FROM cells c JOIN spots s ON s.v = c.cos JOIN pspots q ON q.v = c.p_contra),
counted AS (
  SELECT g.i AS gi, c.i AS ci, k.i AS ki, g.cut AS gate, c.cut AS ceiling, k.cut AS contra, g.margin AS gm, c.margin AS cm, k.margin AS km,
         sum(CASE WHEN relation = CASE WHEN cos < g.cut THEN 'unrelated'
           WHEN same_story OR (same_story IS NULL AND p_contra >= k.cut) THEN 'contradicts'
           WHEN cos >= c.cut THEN 'corroborates' ELSE 'related_untyped' END THEN w ELSE 0 END)::BIGINT AS n
  FROM cm g JOIN cm c ON c.i >= g.i CROSS JOIN pm k CROSS JOIN cells GROUP BY ALL),
options AS (
  SELECT h, n - (relation = CASE WHEN cos < gate THEN 'unrelated'
           WHEN same_story OR (same_story IS NULL AND p_contra >= contra) THEN 'contradicts'
           WHEN cos >= ceiling THEN 'corroborates' ELSE 'related_untyped' END)::BIGINT AS n,
         CASE WHEN c_alone AND gi IN (x.ci - 1, x.ci) THEN c_at ELSE gate END AS gate,
         CASE WHEN c_alone AND o.ci IN (x.ci - 1, x.ci) THEN c_at ELSE ceiling END AS ceiling,
         CASE WHEN p_alone AND ki IN (qi - 1, qi) THEN p_at ELSE contra END AS contra,
         round(CASE WHEN c_alone AND gi IN (x.ci - 1, x.ci) THEN c_margin ELSE gm END
             + CASE WHEN c_alone AND o.ci IN (x.ci - 1, x.ci) THEN c_margin ELSE cm END
             + CASE WHEN p_alone AND ki IN (qi - 1, qi) THEN p_margin ELSE km END, 9) AS margin
  FROM held x CROSS JOIN counted o),
most AS (SELECT h, max(n) AS n FROM options GROUP BY 1),
widest AS (SELECT o.h, o.n, max(margin) AS margin FROM options o JOIN most m ON m.h = o.h AND m.n = o.n GROUP BY 1, 2),
fitted AS (
  SELECT o.h, arg_min({'gate': gate, 'ceiling': ceiling, 'contra': contra}, (gate, ceiling, contra)) AS t
  FROM options o JOIN widest m ON m.h = o.h AND m.n = o.n AND m.margin = o.margin GROUP BY 1),
folds AS (
  SELECT cos, p_contra, same_story, relation, w AS weight, round(t.gate, 9) AS gate, round(t.ceiling, 9) AS ceiling, round(t.contra, 9) AS contra,
         CASE WHEN cos < t.gate THEN 'unrelated' WHEN same_story OR (same_story IS NULL AND p_contra >= t.contra) THEN 'contradicts'
              WHEN cos >= t.ceiling THEN 'corroborates' ELSE 'related_untyped' END AS predicted
  FROM held JOIN fitted USING (h))"""


@query("leave_one_out", D.with_(*relating.TYPED, SAMPLES.replace("graded AS (", "outcome AS ("), FOLDS) + "SELECT * FROM folds")
def leave_one_out(t):
    return K.leave_one_out(samples(t)).withColumns({c: F.round(c, 9) for c in ("gate", "ceiling", "contra")})


@query("leave_one_out_scores", D.with_(*relating.TYPED, SAMPLES.replace("graded AS (", "outcome AS ("), FOLDS) + """
SELECT round(sum(weight) FILTER (relation = predicted) / sum(weight), 6) AS accuracy,
       round(coalesce(sum(weight) FILTER (relation = 'contradicts' AND predicted = 'contradicts'), 0)
             / nullif(coalesce(sum(weight) FILTER (predicted = 'contradicts'), 0), 0), 6) AS contradicts_precision,
       round(coalesce(sum(weight) FILTER (relation = 'contradicts' AND predicted = 'contradicts'), 0)
             / nullif(coalesce(sum(weight) FILTER (relation = 'contradicts'), 0), 0), 6) AS contradicts_recall,
       round(coalesce(sum(weight) FILTER (relation = 'corroborates' AND predicted <> 'contradicts'), 0)
             / nullif(coalesce(sum(weight) FILTER (relation = 'corroborates'), 0), 0), 6) AS class_c_discrimination
FROM folds""")
def leave_one_out_scores(t):
    return K.fold_scores(K.leave_one_out(samples(t)))


SWEPT = f"""occ AS (
  SELECT chunk_id, {D.occurrences('text')} AS o FROM chunks),
names AS (
  SELECT DISTINCT chunk_id, {D.bare('word')} AS term FROM (
    SELECT chunk_id, o[i] AS word, o[i + 1] AS next FROM (SELECT chunk_id, o, unnest(generate_series(1, len(o))) AS i FROM occ) x) y
  WHERE regexp_matches(word, '^\x01+[A-Z]') AND regexp_matches(next, '^\x01*[A-Z][A-Z0-9]*[a-z]') AND {D.bare('word')} NOT IN ({D.CALENDAR})),
marked AS (
  SELECT g.chunk_id, g.term, g.grade, g.grade = 2 OR n.term IS NOT NULL AS named, i.df FROM graded g JOIN idf i ON i.term = g.term
  LEFT JOIN names n ON n.chunk_id = g.chunk_id AND n.term = g.term WHERE i.df BETWEEN 2 AND 12),
met AS (
  SELECT s.src, s.dst, s.score >= 0.3 AS gold, a.df,
         CASE m.mode WHEN 'union' THEN greatest(a.grade, b.grade) = 2 WHEN 'inter' THEN least(a.grade, b.grade) = 2
                     WHEN 'inter_cap' THEN a.named AND b.named ELSE greatest(a.grade, b.grade) = 2 AND least(a.grade, b.grade) >= 1 END AS anchors, m.mode
  FROM scored s JOIN marked a ON a.chunk_id = s.src JOIN marked b ON b.chunk_id = s.dst AND b.term = a.term,
       (VALUES ('union'), ('inter'), ('inter_cap'), ('mixed')) m(mode)),
outcomes AS (
  SELECT gold, mode, f, c, n >= f AND anchored AS typed
  FROM (SELECT src, dst, gold, mode, c, count(*) FILTER (df <= c) AS n, coalesce(bool_or(anchors) FILTER (df <= c), false) AS anchored
        FROM met, (VALUES (4), (6), (7), (9), (12)) y(c) GROUP BY ALL) z, (VALUES (2), (3), (4)) x(f))"""


@query("story_sweep", D.with_(D.CHUNKS, D.POSTINGS, D.IDF, relating.GRADED, relating.STORY, relating.SCORED, SWEPT) + """
SELECT f AS story_floor, c AS ceiling, mode AS anchor_mode, count(*) FILTER (typed AND gold) AS tp, count(*) FILTER (typed AND NOT gold) AS fp,
       count(*) FILTER (NOT typed AND gold) AS fn FROM outcomes GROUP BY 1, 2, 3""")
def story_sweep(t):
    """Every floor, ceiling and anchor mode over the story pairs, whose relatedness stands for gold."""
    rows = X.story_evidence(relating.pair_relatedness(t), t.chunks, relating.CEILING)
    return K.story_sweep(rows.withColumn("gold", F.col("score") >= 0.3))
