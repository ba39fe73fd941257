"""Language by compression: the dictionary that shortens a text most names it."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import small_batches

#: Bytes of text in a language's dictionary; the sample it is fitted on is bounded by this.
DICTIONARY_BYTES = 65_536
#: Documents per language that may fill a dictionary.
DICTIONARY_DOCS = 400
#: Texts are compressed in pieces of this many bytes, so that the dictionary counts all the way through.
PIECE_BYTES = 8_192
LEVEL = 6
UNDETERMINED = "und"

_NO_LETTERS = re.compile(r"[\x00-@\[-`{-\x7f]+")


def letters(text: str) -> bytes:
    """Lower case, ASCII digits, marks and spaces as single spaces."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def dictionaries(
    labelled: DataFrame, size: int = DICTIONARY_BYTES, most: int = DICTIONARY_DOCS
) -> list[tuple[str, bytes, int]]:
    """(language, dictionary, documents) of ``labelled`` (doc_id, text, lang), most documents first.

    Whole texts of at most a quarter of ``size`` fill a dictionary in an order given by a
    hash; a language whose texts are all longer has the beginnings of some as its
    dictionary.  What reaches the driver is bounded by languages x 5/4 ``size``.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = dict(rows.groupBy("lang").count().collect())
    order = W.partitionBy("lang").orderBy(F.length("text") > size // 4, F.xxhash64("doc_id", "text"))
    picked = (
        rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        .select("lang", "place", F.substring("text", 1, size // 4).alias("text"))
        .withColumn("before", F.sum(F.length("text")).over(
            W.partitionBy("lang").orderBy("place").rowsBetween(W.unboundedPreceding, -1)))
        .where(F.coalesce("before", F.lit(0)) < size)
    )
    texts: dict[str, list] = {}
    for lang, place, text, _ in picked.collect():
        texts.setdefault(lang, []).append((place, text))
    joined = {k: b"".join(letters(t) + b" " for _, t in sorted(v))[:size] for k, v in texts.items()}
    return sorted(((k, v, counts[k]) for k, v in joined.items() if v.strip()), key=lambda x: (-x[2], x[0]))


class Classifier:
    """Compressed sizes of a text under every language's dictionary."""

    def __init__(self, learned: list[tuple[str, bytes, int]], level: int = LEVEL, piece: int = PIECE_BYTES):
        self.piece, self.coders = piece, []
        for lang, content, _ in learned:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            self.coders.append((lang, zstandard.ZstdCompressor(
                level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest size (of more documents in a tie) and the
        margin to the next, as a share of the next; no letter, no language."""
        data = letters(text) if text else b""
        if not data.strip() or not self.coders or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.coders[0][0], 1.0
        following = min(s for k, s in enumerate(sizes) if k != best)
        return self.coders[best][0], (following - sizes[best]) / following


def identified(docs: DataFrame, labelled: DataFrame, margin: float = 0.02, **options) -> DataFrame:
    """Every row of ``docs`` with lang_pred, score and rejected.

    ``labelled`` (doc_id, text, lang) is all that is learned from.  A null text, a
    text without a letter, or no labels at all give ``und`` with score 0; a
    prediction whose margin is under ``margin`` is marked rejected.
    """
    learned = docs.sparkSession.sparkContext.broadcast(dictionaries(labelled, **options))
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = columns.index("text")

    def predicted(batches):
        classify = Classifier(learned.value)
        for batch in small_batches(batches):
            found = [classify(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*columns, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema)
    return docs.select(columns).mapInArrow(predicted, f"{kinds}, lang_pred string, score double").withColumn(
        "rejected", F.col("score") < margin
    )


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
