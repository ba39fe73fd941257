"""Text expressions: tokens, keywords, sentences and overlap, all as Columns.

Every token class is ASCII ``[a-z0-9]+`` of the lower-cased text, so accented
letters split words.  Nothing here leaves the JVM.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a search keyword may not be.
KEYWORD_STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "for", "on", "at", "by",
    "with", "from", "is", "was", "were", "be", "been", "being",
)

# Words ignored when a claim is compared with a chunk.
CLAIM_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have",
    "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were",
    "will", "with",
)

# Weekday and month names, never entity-grade.
CALENDAR_WORDS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)

_NOT_TOKEN = "[^a-z0-9]+"
# One trailing "s" of a token longer than three letters whose neighbour is not "s".
_PLURAL_S = "s(?![a-z0-9])(?<=[a-z0-9]{2}[a-rt-z0-9]s)"
_CLAIM_STOP = "(?<![a-z0-9])(?:" + "|".join(CLAIM_STOPWORDS) + ")(?![a-z0-9])"
_SENTENCE_GAP = r"(?<=[.!?])\s+|(?<=—)\s+"
_PLAIN_SENTENCE_GAP = r"(?<=[.!?])\s+"


def _literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", "")


def squeezed(text: Column) -> Column:
    """Lower case with whitespace runs collapsed, for substring tests."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def words(text: Column) -> Column:
    """All tokens in order, repeats kept."""
    return F.array_remove(F.split(F.lower(text), _NOT_TOKEN), "")


def fold_plural(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _PLURAL_S, "")


def folded_words(text: Column) -> Column:
    """All plural-folded tokens in order, repeats kept."""
    return F.array_remove(F.split(fold_plural(text), _NOT_TOKEN), "")


def terms(text: Column) -> Column:
    """Distinct plural-folded tokens."""
    return F.array_distinct(folded_words(text))


def keywords(text: Column) -> Column:
    """Distinct raw tokens longer than two letters that are not stopwords."""
    kept = F.array_except(words(text), _literal_array(KEYWORD_STOPWORDS))
    return F.filter(kept, lambda w: F.length(w) > 2)


def folded_keywords(text: Column) -> Column:
    return F.array_distinct(F.transform(keywords(text), fold_plural))


def sentences(text: Column) -> Column:
    """Sentences; a long dash also ends one."""
    return F.array_remove(F.split(trimmed(text), _SENTENCE_GAP), "")


def plain_sentences(text: Column) -> Column:
    """Sentences ended by . ! ? only (claims and quantities use these)."""
    return F.array_remove(F.split(trimmed(text), _PLAIN_SENTENCE_GAP), "")


def head_sentence(text: Column) -> Column:
    """The first run closed by . ! or ?, else the first line."""
    body = trimmed(text)
    head = F.regexp_extract(body, r"^[.!?]*([^.!?]++[.!?])", 1)
    return trimmed(F.when(head != "", head).otherwise(F.element_at(F.split(body, "\n"), 1)))


def whitespace_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def lead_anchor(text: Column) -> Column:
    """Half-open whitespace-word span of the first sentence, as a struct."""
    parts = whitespace_words(text)
    closes = F.transform(parts, lambda w: w.rlike("[.!?]$"))
    first = F.array_position(closes, F.lit(True)).cast("int")
    return F.struct(
        F.lit(0).alias("start"),
        F.when(first > 0, first).otherwise(F.size(parts)).alias("end"),
    )


def claim_words(text: Column) -> Column:
    """Tokens minus claim stopwords; repeats count."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), _CLAIM_STOP, " "), _NOT_TOKEN), "")


def word_share(mine: Column, theirs: Column) -> Column:
    """Share of ``mine`` (with repeats) found in ``theirs``.

    The hashed intersection is no longer than the claim, so looking every word
    up in it stays cheap however long the chunk is.  Both lists are bound by a
    lambda of their own: one that looked up words would parse the texts per word.
    """
    sides = F.array(F.struct(mine.alias("mine"), F.array_intersect(mine, theirs).alias("both")))
    hits = lambda s: F.size(F.filter(s["mine"], lambda w: F.array_contains(s["both"], w)))
    share = lambda s: F.when(F.size(s["mine"]) > 0, hits(s) / F.size(s["mine"])).otherwise(F.lit(0.0))
    return F.element_at(F.transform(sides, share), 1)


def overlap_share(claim: Column, chunk: Column) -> Column:
    """Share of the claim's content words (with repeats) the chunk contains."""
    return word_share(claim_words(claim), claim_words(chunk))


def best_sentence_hits(text: Column, keys: Column) -> Column:
    """Most of ``keys`` found in any one sentence."""
    per_sentence = F.transform(
        sentences(text), lambda s: F.size(F.array_intersect(words(s), keys))
    )
    return F.coalesce(F.array_max(per_sentence), F.lit(0))


def best_sentence_score(text: Column, keys: Column) -> Column:
    n = F.size(keys)
    return F.when(n > 0, best_sentence_hits(text, keys) / n).otherwise(F.lit(0.0))


def shared_word_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(words(a), words(b)))


def shares_keyword(text: Column, query: Column) -> Column:
    return F.arrays_overlap(folded_keywords(query), terms(text))


def jaccard(a: Column, b: Column) -> Column:
    """0 when either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / F.size(F.array_union(a, b))
    )


# --- entity-grade tokens -----------------------------------------------------

ENTRY = _ENTRY = "\u0001"
#: A capitalised or numeric word occurrence in marked text, with its marks.
NOTABLE = f"(?:{_ENTRY}+|(?<![A-Za-z0-9{_ENTRY}]))(?:[A-Z][A-Za-z0-9]*|[0-9]{{2,}}(?![A-Za-z0-9]))"
#: Of these, a number of 2+ digits, an all-caps word of 3+, or one capitalised inside a sentence.
ENTITY = f"^{_ENTRY}*(?:[0-9]{{2,}}|(?=[A-Z0-9]*[A-Z])[A-Z0-9]{{3,}})$|^[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*$"


def _marked(text: Column) -> Column:
    """Text in which a mark sits right before every sentence-initial position."""
    gap = F.regexp_replace(trimmed(text), r"([.!?])\s*|\n", "$1" + _ENTRY)
    return F.concat(F.lit(_ENTRY), gap)


def _bare(occurrence: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(occurrence, _ENTRY, "")), _PLURAL_S, "")


def _entity_grade(occurrence: Column) -> Column:
    """Number of 2+ digits, all-caps word of 3+, or capitalised inside a sentence."""
    return occurrence.rlike(ENTITY)


def _without_calendar(tokens: Column) -> Column:
    return F.array_except(tokens, _literal_array(CALENDAR_WORDS))


def notable_occurrences(text: Column) -> Column:
    """Capitalised or numeric word occurrences, each still bearing its marks."""
    return F.regexp_extract_all(_marked(text), F.lit(NOTABLE), 0)


def anchors_among(occurrences: Column) -> Column:
    """Folded tokens with an entity-grade occurrence."""
    return _without_calendar(F.transform(F.filter(occurrences, _entity_grade), _bare))


def capitals_among(occurrences: Column) -> Column:
    """Folded tokens with a capitalised or entity-grade occurrence."""
    return _without_calendar(F.transform(occurrences, _bare))


def initial_names(text: Column) -> Column:
    """Folded tokens that open a sentence capitalised, with a capitalised word next."""
    opening = F.regexp_extract_all(
        _marked(text), F.lit(f"{_ENTRY}+[A-Z][A-Za-z0-9]*(?=[^A-Za-z0-9]+[A-Z][A-Z0-9]*[a-z])"), 0
    )
    return _without_calendar(F.transform(opening, _bare))


def anchor_terms(text: Column) -> Column:
    return anchors_among(notable_occurrences(text))


def capital_terms(text: Column) -> Column:
    return capitals_among(notable_occurrences(text))


# --- citations ---------------------------------------------------------------


def citation_numbers(sentence: Column) -> Column:
    """Distinct source numbers of all ``[n]``, ``[n: id]``, ``[n, m]`` marks."""
    blocks = F.regexp_extract_all(sentence, F.lit(r"\[([^\]]+)\]"), 1)
    parts = F.flatten(F.transform(blocks, lambda b: F.split(b, ",")))
    numbers = F.transform(parts, lambda p: F.regexp_extract(trimmed(p), r"^(\d+)", 1))
    return F.transform(
        F.array_remove(F.array_distinct(numbers), ""), lambda n: n.cast("int")
    )


def without_citations(sentence: Column) -> Column:
    return trimmed(F.regexp_replace(sentence, r"\[[^\]]+\]", ""))
