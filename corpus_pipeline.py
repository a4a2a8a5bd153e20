"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds what the mix takes.

* ``language_id`` drops texts without letters and texts in which no language has half of the letters.
* ``near_duplicates`` keeps the document with the smallest id of each class; texts without words are in no class.
* ``suffix_dedup`` takes repeated passages out of ``text`` and updates ``n_chars``; characters cut in two are dropped.
* ``decontamination`` drops documents that contain a window of a benchmark item.
* ``mixing`` keeps the documents that the mix takes words of, with size, source_size, target and taken.

Nulls, ties, empty texts and empty tables: see the operators. Rows equal in id and text count as one document from the
second stage on. Columns beyond those of documents are kept; one called like a result of the last stage is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isobar.llm import chosen_path, decontaminate, langid, mixing, suffix_dedup
from isobar.llm.common import table
from isobar.session import materialize

#: Least share of the letters in the main language.
MAIN_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    wrapped = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    spans = langid.label_spans(wrapped, F.col("text"), model)
    lang_pred, score = langid.main_language(F.col("spans"))
    return spans.where((lang_pred != "und") & (score >= MAIN_SHARE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = chosen_path.jaccard_classes(docs, F.col("doc_id"), F.col("text"))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("first_key"))
    kept = classes.where(F.col("first_key").isNull() | first).select("doc_id", "text_key", F.col("first_key").isNotNull().alias("classed")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key"))
    copy = F.row_number().over(Window.partitionBy("k.doc_id", "k.text_key").orderBy(F.hash("d.row.lang", "d.row.source")))
    chosen = rows.alias("d").join(kept.alias("k"), same).withColumn("copy", copy)
    return chosen.where(~F.col("classed") | (F.col("copy") == 1)).select("d.row.*")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, F.col("doc_id"), F.col("text"), as_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = cut.select("row", "n_removed", text.alias("text"))
    new = {
        "text": F.col("text"),
        "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return changed.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.decontaminate(docs, items, F.col("doc_id"), F.col("text"), F.col("item_id"), F.col("text"))
    return found.where(~F.col("contaminated")).select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = ("size", "source_size", "target", "taken")
    words = mixing.word_count(F.col("text"))
    mixed = mixing.mix_sources(docs, F.col("source"), words, mixing.text_quality(F.col("text"), words), F.col("doc_id"))
    return mixed.where("taken > 0").select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
]

#: Hash-drawn samples, learned labels and sampled paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
