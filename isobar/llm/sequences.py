"""Native search for word sequences: rare anchor words by equi-join, then exact comparison in place.

Built-in expressions only. A document is (doc_id, text_key, words): ``text_key`` is a hash of the text, so the pair
names a row's content and rows equal in both have equal results. The pattern side is broadcast only after its size has
been measured; beyond :data:`BROADCAST_BYTES` the words are shuffled without their documents and meet them again as
candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import alnum_words, split_words

BROADCAST_BYTES = 16 << 20
KEY = ("doc_id", "text_key")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def word_arrays(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    return docs.select(doc_id.alias("doc_id"), text_key(text).alias("text_key"), alnum_words(text).alias("words"))


def word_total(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def kept_rows(docs: DataFrame, doc_id: Column, text: Column, keep: list[str] | None) -> DataFrame:
    """(row, doc_id, text_key, n_words); ``row`` has the columns ``keep`` (all if None), so others are not shuffled."""
    row = F.struct("*") if keep is None else F.struct(*keep)
    return docs.select(row.alias("row"), doc_id.alias("doc_id"), text_key(text).alias("text_key"), word_total(text).alias("n_words"))


def measured(rows: DataFrame, *text: Column) -> tuple[DataFrame, bool]:
    """The table, hinted for broadcast if its measured bytes allow it."""
    size = rows.agg(F.sum(sum((F.octet_length(t) + 8 for t in text), F.lit(64)))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    return (F.broadcast(rows) if small else rows), small


def corpus_frequency(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): occurrences in all documents of the words of ``vocabulary`` (word), 0 included."""
    wanted, _ = measured(vocabulary, F.col("word"))
    counted = (
        documents.select(F.explode("words").alias("word"))
        .join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def slice_at(words: Column, start: Column, length: Column) -> Column:
    """``length`` words from the 0-based ``start``; starts before the document are moved to it."""
    return F.slice(words, F.greatest(start, F.lit(0)).cast("int") + 1, length.cast("int"))


def match_anchors(
    documents: DataFrame, patterns: DataFrame, condition: Column, pattern_id: str = "pattern_id", places: str | None = None
) -> DataFrame:
    """Rows of ``documents`` words (doc_id, text_key, words, pos, word) that meet a pattern's anchor and the condition.

    ``patterns`` has ``pattern_id``, ``anchor`` and what the condition uses. Words may be numbers. ``places`` names a column
    with the (pos, word) to look at; without it these are all words.
    """
    if places is None:
        spread = documents.select(*KEY, "words", F.posexplode("words").alias("pos", "word"))
    else:
        spread = documents.select(*KEY, "words", F.explode(places).alias("place")).select(*KEY, "words", "place.pos", "place.word")
    anchors, small = measured(patterns, F.col("anchor").cast("string"), F.array_join(F.col("seq").cast("array<string>"), " "))
    if small:
        return spread.join(anchors, (F.col("word") == F.col("anchor")) & condition)
    narrow = patterns.select("anchor", pattern_id)
    met = spread.select(*KEY, "pos", "word").join(narrow, F.col("word") == F.col("anchor")).drop("anchor")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key"))
    back = met.alias("m").join(documents.dropDuplicates(KEY).alias("d"), same).select("d.*", "m.pos", "m.word", f"m.{pattern_id}")
    return back.join(patterns, pattern_id).where(condition)
