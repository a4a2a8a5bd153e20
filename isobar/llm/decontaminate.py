"""Benchmark decontamination as a prefix-filtered join, with built-in expressions only.

An item gives windows of ``window`` consecutive words; a shorter item is one window. A window is contained in a text
only if all its words are, so for full containment the necessary prefix of its words, ordered by their number in the
whole corpus, is the rarest one. Documents join on that word alone. Length and position bound what follows: the window
has to begin in the text and to end in it, with its rarest word at the place of the match. Then the words of that
window-sized stretch are compared exactly.

Nulls: a null text or item has no words; an item without id marks words but is neither counted nor listed; documents
without id are judged like others. Repeated documents and items change nothing. Without items nothing is contaminated.
The input's columns are in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isobar.llm import sequences
from isobar.llm.common import alnum_words
from isobar.session import materialize


def item_windows(items: DataFrame, item_id: Column, text: Column, window: int = 10) -> DataFrame:
    """(seq, item_id): the windows of every item."""
    words = alnum_words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return (
        items.select(item_id.cast("string").alias("item_id"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("seq"))
        .distinct()
    )


def anchored(windows: DataFrame, documents: DataFrame) -> DataFrame:
    """(pattern_id, seq, anchor, at): distinct windows with their rarest word, the first one among equals."""
    distinct = windows.select("seq").distinct().withColumn("pattern_id", F.xxhash64("seq"))
    spread = distinct.select("pattern_id", F.posexplode("seq").alias("at", "word"))
    frequency = sequences.corpus_frequency(documents, spread.select("word").distinct())
    rarest = spread.join(frequency, "word").groupBy("pattern_id").agg(
        F.min_by(F.struct(F.col("word").alias("anchor"), "at"), F.struct("n", "at")).alias("best")
    )
    return distinct.join(rarest, "pattern_id").select("pattern_id", "seq", "best.anchor", "best.at")


def contained_windows(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, length, pattern_id) of every place where a window occurs."""
    start, length = F.col("pos") - F.col("at"), F.size("seq")
    fits = (F.col("pos") >= F.col("at")) & (start + length <= F.size("words"))
    equal = sequences.slice_at(F.col("words"), start, length) == F.col("seq")
    return (
        sequences.match_anchors(documents, patterns, fits & equal)
        .select(*sequences.KEY, start.alias("start"), length.alias("length"), "pattern_id").distinct()
    )


def covered(places: DataFrame) -> DataFrame:
    """Words inside any place, per document: places in order add what reaches beyond all before them."""
    order = Window.partitionBy(*sequences.KEY).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    added = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(order), F.lit(0))))
    return places.withColumn("added", added).groupBy(*sequences.KEY).agg(F.sum("added").cast("long").alias("n_hit"))


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: Column, text: Column, item_id: Column, item_text: Column, window: int = 10,
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, n_words, n_hit, items, contaminated); ``items`` are the sorted ids whose windows occur, ``row`` has the
    columns ``keep``."""
    documents = sequences.word_arrays(docs, doc_id, text)
    windows = materialize(item_windows(items, item_id, item_text, window), "benchmark-windows")
    patterns = materialize(anchored(windows, documents), "benchmark-anchors")
    places = materialize(contained_windows(documents, patterns), "benchmark-places")
    found = (
        places.select(*sequences.KEY, "pattern_id").distinct()
        .join(windows.withColumn("pattern_id", F.xxhash64("seq")), "pattern_id")
        .groupBy(*sequences.KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    hits = covered(places).alias("c").join(found.alias("f"), _same("c", "f")).select("c.*", "f.items")
    rows = sequences.kept_rows(docs, doc_id, text, keep)
    return rows.alias("d").join(hits.alias("h"), _same("d", "h"), "left").select(
        "d.row", "d.n_words", F.coalesce("h.n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("h.items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("h.n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
