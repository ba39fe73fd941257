"""The registered query of every operator; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, contamination, language, lines, mixing, near, pages, pieces, private, quality, repeats, secrets, urls
from .common import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents"))).drop("source", "copies")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(spread(table(spark, sf_dir, "pages")))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.grouped(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), width=4, similarity=80)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    docs = docs.withColumn("held_out", language.held_out())
    return language.identified(docs.drop("lang"), docs.where("NOT held_out")).drop("text")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.deduplicated(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op7_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS l
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
), worded AS (
  SELECT * FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), firsts AS (
  SELECT l, min((doc_id, line)) AS f FROM worded GROUP BY l
), halves AS (
  SELECT l, f, q, 'b' AS side, substr(l, 1, q // 2) AS h FROM firsts, LATERAL (SELECT unnest([length(l), length(l) - 1]) AS q)
  UNION ALL
  SELECT l, f, q, 'e', substr(l, length(l) - q // 2 + 1, q // 2) FROM firsts, LATERAL (SELECT unnest([length(l), length(l) - 1]) AS q)
), late AS (
  SELECT DISTINCT b.l FROM halves a JOIN halves b USING (q, side, h)
  WHERE a.f < b.f AND length(a.l) - length(b.l) BETWEEN -1 AND 1 AND len(list_filter(
    generate_series(1, greatest(length(a.l), length(b.l))),
    lambda i: substr(a.l, 1, i - 1) || substr(a.l, i + (length(a.l) >= length(b.l))::INT)
            = substr(b.l, 1, i - 1) || substr(b.l, i + (length(b.l) >= length(a.l))::INT))) > 0
), marked AS (
  SELECT w.doc_id, w.line, (f.f <> (w.doc_id, w.line) OR f.l IN (SELECT l FROM late)) AS gone
  FROM worded w JOIN firsts f USING (l)
)
SELECT x.doc_id, count(m.line) AS n_lines, count(*) FILTER (WHERE m.gone) AS n_removed,
       sha256(coalesce(string_agg(x.l, chr(10) ORDER BY x.line) FILTER (WHERE NOT coalesce(m.gone, false)), '')) AS kept_sha256
FROM lines x LEFT JOIN marked m USING (doc_id, line) GROUP BY x.doc_id
"""


@query
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.cleaned(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return cleaned.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extracted(spread(table(spark, sf_dir, "pages")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.transformed(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), output=False)


ORACLES["op12_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT *, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::UBIGINT::BIGINT) AS d FROM drawn
), cuts AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain'
         WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cuts
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
         WHEN 'psm' THEN split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
         ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(substr(output, 4), '<P>', 1)
       END) AS restored_sha256
FROM made
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return codes.coded(spread(vectors)).drop("label")


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Lloyd rounds as chained common table expressions over single components."""
    nearest = """
near{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
    FROM comps c JOIN book{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
    step = """
book{n} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT c.part, g.entry, c.pos, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x
    FROM comps c JOIN near{k} g ON g.rid = c.rid AND g.part = c.part GROUP BY 1, 2, 3) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
    chain = [nearest.format(k=0)]
    for k in range(rounds):
        chain += [step.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    return f"""
WITH sound AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), comps AS MATERIALIZED (
  SELECT rid, (i - 1) // (len(e) // {codes.PARTS}) AS part, (i - 1) % (len(e) // {codes.PARTS}) AS pos,
         floor({codes.SCALE} * e[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT rid, e, unnest(generate_series(1, len(e))) AS i FROM sound)
), seeds AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM sound ORDER BY vec_id LIMIT {codes.ENTRIES}
), book0 AS MATERIALIZED (
  SELECT c.part, s.entry, c.pos, c.x FROM comps c JOIN seeds s USING (rid)
), {",".join(chain)},
coded AS (
  SELECT rid, lower(string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part)) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid
)
SELECT s.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY s.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM sound s JOIN coded c USING (rid)
"""


ORACLES["op13_vector_codes"] = _codes_sql()


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.scanned(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text", "finds", "terms")
