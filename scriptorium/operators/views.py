"""Document catalogue, and the views an annotation service shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import tokens as T
from scriptorium.operators.dictionary import new_words


def held_documents(catalog: DataFrame) -> DataFrame:
    """One row per document: the last of its rows, flags without NULL."""
    keyed = catalog.where("doc_id IS NOT NULL").select("doc_id", "added_at", "removed_at", "ext", "original_path", "gold_path", "is_done")
    return T.latest(keyed, ["doc_id"], ["added_at", "removed_at"]).withColumn("is_done", F.coalesce("is_done", F.lit(False)))


def select_documents(documents: DataFrame, ext: str | None = None, done: bool | None = None, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Documents by type, state and name; a condition that is None or False selects all."""
    if ext:
        documents = documents.where(F.col("ext") == ext)
    if done:
        documents = documents.where("is_done")
    if only:
        documents = documents.where(F.col("doc_id").isin(only))
    if exclude:
        documents = documents.where(~F.col("doc_id").isin(exclude))
    return documents


def tokens_of(tokens: DataFrame, documents: DataFrame) -> DataFrame:
    """The tokens of the documents chosen, for reports, alignments or training over these only."""
    return tokens.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def index_page(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents with open work, finished ones last: not done, tokens left, not all corrected or wrong."""
    joined = documents.select("doc_id", "is_done").join(stats, "doc_id")
    open_ = ~F.col("is_done") & (F.col("token_count") > 0) & (F.col("uncorrected_count") > 0) & (F.col("corrected_count") + F.col("error_count") < F.col("token_count"))
    return joined.where(open_).select("doc_id", "done", "token_count", "corrected_count", "uncorrected_count", "error_count").orderBy("done", "doc_id")


def stats_list(stats: DataFrame, ready: DataFrame) -> DataFrame:
    return stats.join(ready, "doc_id").select("doc_id", "token_count", "corrected_count", "error_count", "done", "ready", "last_modified")


def random_token(tokens: DataFrame, qualifies: Column, seed: int) -> DataFrame:
    """One qualifying token, each with equal chance; a partial top-1 per task, no full sort."""
    order = F.struct(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "doc_id", "doc_index")).alias("h"), "doc_id", "doc_index")
    return tokens.where(qualifies).agg(F.min(order).alias("m")).where("m IS NOT NULL").select("m.doc_id", "m.doc_index")


def random_document(documents: DataFrame, seed: int) -> DataFrame:
    """One document, each with equal chance."""
    return documents.agg(F.min(F.struct(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), "doc_id")).alias("h"), "doc_id")).alias("m")).where("m IS NOT NULL").select("m.doc_id")


def add_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue with the new documents whose id it does not hold yet."""
    return documents.unionByName(new.dropDuplicates(["doc_id"]).join(documents.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)


def mark_done(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """The catalogue with the state of documents taken from their counts, where there are any."""
    state = stats.select("doc_id", F.col("done").alias("now_done"))
    return documents.join(state, "doc_id", "left").withColumn("is_done", F.coalesce("now_done", "is_done")).drop("now_done")


def finished(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """``(doc_id)`` of finished documents: marked so in the catalogue, or complete by their counts."""
    return documents.where("is_done").select("doc_id").unionByName(stats.where("done").select("doc_id")).distinct()


def session_metrics(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per document: tokens, those a human corrected, and words they wrote the dictionary lacks."""
    counts = tokens.groupBy("doc_id").agg(F.count_if(~F.col("is_discarded")).alias("token_count"), F.count_if((F.col("heuristic") == "annotator") & F.col("gold").isNotNull()).alias("human_count"))
    fresh = new_words(T.consolidated(tokens), dictionary).groupBy(F.expr("substring(group_name, 6)").alias("doc_id")).agg(F.count("*").alias("new_words"))
    return counts.join(fresh, "doc_id", "left").select("doc_id", "token_count", "human_count", F.coalesce("new_words", F.lit(0)).alias("new_words"))
