"""Fragments of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import CALENDAR_WORDS, CLAIM_STOPWORDS, KEYWORD_STOPWORDS


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def fold(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 3 AND right({w}, 1) = 's' AND right({w}, 2) <> 'ss' "
        f"THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def folded_words(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: {fold('w')})"


def terms(x: str) -> str:
    return f"list_distinct({folded_words(x)})"


def keywords(x: str) -> str:
    return (
        f"list_distinct(list_filter({words(x)}, lambda w: length(w) > 2 "
        f"AND w NOT IN ({quoted(KEYWORD_STOPWORDS)})))"
    )


def folded_keywords(x: str) -> str:
    return f"list_distinct(list_transform({keywords(x)}, lambda w: {fold('w')}))"


def claim_words(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: w NOT IN ({quoted(CLAIM_STOPWORDS)}))"


def overlap_share(claim: str, chunk: str) -> str:
    mine, theirs = claim_words(claim), claim_words(chunk)
    return (
        f"CASE WHEN len({mine}) = 0 THEN 0.0 ELSE "
        f"len(list_filter({mine}, lambda c: list_contains({theirs}, c)))::DOUBLE / len({mine}) END"
    )


def sentences(x: str, dash: bool = True) -> str:
    ends = "[.!?—]" if dash else "[.!?]"
    return (
        rf"list_filter(string_split(regexp_replace({trimmed(x)}, '({ends})\s+', '\1' || chr(1), 'g'), chr(1)), "
        "lambda s: s <> '')"
    )


def best_sentence_hits(text: str, keys: str, all_words=words) -> str:
    return (
        f"coalesce(list_max(list_transform({sentences(text)}, "
        f"lambda s: len(list_intersect({keys}, {all_words('s')})))), 0)"
    )


def squeezed(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


CALENDAR = quoted(CALENDAR_WORDS)


def occurrences(x: str) -> str:
    marked = rf"(chr(1) || regexp_replace({trimmed(x)}, '([.!?])\s*|\n', '\1' || chr(1), 'g'))"
    return rf"regexp_extract_all({marked}, '\x01*[A-Za-z0-9]+')"


def bare(o: str) -> str:
    return fold(f"lower(replace({o}, chr(1), ''))")


def entity_grade(o: str) -> str:
    return (
        rf"(regexp_full_match({o}, '\x01*[0-9]{{2,}}') "
        rf"OR (regexp_full_match({o}, '\x01*[A-Z0-9]{{3,}}') AND regexp_matches({o}, '[A-Z]')) "
        rf"OR regexp_full_match({o}, '[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*'))"
    )


def anchor_terms(x: str, extra: str = "false") -> str:
    return (
        f"list_filter(list_distinct(list_transform(list_filter({occurrences(x)}, "
        f"lambda o: {entity_grade('o')} OR {extra}), lambda o: {bare('o')})), "
        f"lambda t: t NOT IN ({CALENDAR}))"
    )


def capital_terms(x: str) -> str:
    return anchor_terms(x, r"regexp_matches(o, '^\x01*[A-Z]')")


# Corpus roles as CTE bodies (see Tables).
CHUNKS = """chunks AS (
  SELECT doc_id::VARCHAR AS chunk_id, doc_id::VARCHAR AS doc_id, text, source AS outlet, lang AS eval_layer
  FROM documents)"""
LINES = """lines AS (
  SELECT doc_id || ':' || (i - 1) AS chunk_id, doc_id, source AS outlet, lang, i - 1 AS position, parts[i] AS text
  FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents) d,
       generate_series(1, len(parts)) g(i)
  WHERE trim(parts[i]) <> '')"""
QUERYSET = "queryset AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
EDGES = """edges AS (
  SELECT a.doc_id::VARCHAR AS src, b.doc_id::VARCHAR AS dst,
         CASE WHEN a.lang = b.lang THEN 'contradicts' WHEN a.lang < b.lang THEN 'cites' ELSE 'supersedes' END AS edge_type
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""
POSTINGS = f"""postings AS (
  SELECT chunk_id, unnest({terms('text')}) AS term FROM chunks)"""
IDF = """idf AS (
  SELECT term, count(*) AS df, ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) + 1 AS idf
  FROM postings GROUP BY term)"""
ANCHORS = """anchors AS (
  SELECT doc_id::VARCHAR AS chunk_id, sha256(text) AS content_hash, source AS outlet, lang AS title FROM documents)"""
REMOTE = """remote AS (
  SELECT a.chunk_id, a.content_hash, a.outlet,
         CASE WHEN l.quality = 0 THEN a.title || '*' ELSE a.title END AS title
  FROM anchors a LEFT JOIN labels l ON l.doc_id::VARCHAR = a.chunk_id
  WHERE coalesce(l.toxic, 0) = 0
  UNION ALL
  SELECT 'p' || page_id, sha256(html), 'web', 'page' FROM pages)"""


def leaf_hash(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    cells = " || '\", \"' || ".join(f"{p}{c}" for c in ("chunk_id", "content_hash", "outlet", "title"))
    return f"sha256('[\"' || {cells} || '\"]')"


def digest_tree(source: str, item: str, stop: int) -> str:
    """(path, digest, n) of a digest tree of four levels, folded up to ``stop`` digits."""
    level = (
        f"SELECT left(sha256(chunk_id), 4) AS path, sha256(string_agg({item}, '|' ORDER BY chunk_id)) AS digest, "
        f"count(*) AS n FROM {source} GROUP BY 1"
    )
    for width in range(3, stop - 1, -1):
        level = (
            f"SELECT left(path, {width}) AS path, sha256(string_agg(digest, '|' ORDER BY path)) AS digest, "
            f"sum(n)::BIGINT AS n FROM ({level}) l{width} GROUP BY 1"
        )
    return level


def buckets(source: str, name: str) -> str:
    """Bucket digests of an anchor table."""
    return f"""{name} AS (
  SELECT b.bucket, coalesce(h.digest, sha256('empty')) AS bucket_hash, coalesce(h.n, 0) AS n
  FROM (SELECT i AS bucket FROM generate_series(0, 15) g(i)) b
  LEFT JOIN ({digest_tree(source, leaf_hash(), 1)}) h ON strpos('0123456789abcdef', h.path) - 1 = b.bucket)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
