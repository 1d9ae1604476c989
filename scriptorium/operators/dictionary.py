"""The dictionary: named groups of words, membership, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X


def add_words(raw: DataFrame, ignore_case: bool = False) -> DataFrame:
    """``(group_name, word)``, distinct: cleaned words with a letter, parted at blanks."""
    word = X.clean(F.col("word"))
    parts = raw.select("group_name", word.alias("word")).where((F.col("word") != "") & (X.letters(F.col("word")) > 0))
    parts = parts.select("group_name", F.explode(F.split("word", " ")).alias("word")).where("word <> ''")
    if ignore_case:
        parts = parts.withColumn("word", F.lower("word"))
    return parts.distinct()


def membership(words: DataFrame, dictionary: DataFrame, word: str = "word", ignore_case: bool = False) -> DataFrame:
    """Adds ``known``: the cleaned word has at most one letter, or some group holds it.

    ``words`` should hold distinct words; the dictionary side is joined on its distinct words, and
    Spark decides by their size whether to broadcast them.
    """
    key = X.clean(F.col(word))
    entries = dictionary.select("word").where("word IS NOT NULL")
    if ignore_case:
        key, entries = F.lower(key), entries.select(F.lower("word").alias("word"))
    entries = entries.distinct().select(F.col("word").alias("__key"), F.lit(True).alias("__hit"))
    joined = words.withColumn("__key", key).join(entries, "__key", "left")
    known = (F.col("__key") == "") | (X.letters(F.col("__key")) <= 1) | F.coalesce("__hit", F.lit(False))
    return joined.withColumn("known", known).drop("__key", "__hit")


def known_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(word, known)`` of the distinct values of the one column ``word``."""
    return membership(words.where("word IS NOT NULL").distinct(), dictionary)


def new_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(group_name, word)`` annotators wrote that no group holds: group ``gold-<doc_id>``. ``words`` are
    those of a consolidated sequence, so that broken words count joined."""
    gold = words.where((F.col("heuristic") == "annotator") & (F.col("gold") != "")).select(F.concat(F.lit("gold-"), "doc_id").alias("group_name"), X.clean(F.col("gold")).alias("word")).distinct()
    gold = gold.where(X.letters(F.col("word")) > 1)
    return gold.join(dictionary.select("word").distinct(), "word", "left_anti").select("group_name", "word")


def has_group(dictionary: DataFrame, name: str | None) -> bool:
    """Whether the dictionary has a group of that name; at most one row is read beyond the filter."""
    return not dictionary.where(F.col("group_name").eqNullSafe(F.lit(name))).isEmpty()


def cleared(dictionary: DataFrame, name: str | None = None) -> DataFrame:
    """The dictionary without one group, or without any word if none is named."""
    return dictionary.where(~F.col("group_name").eqNullSafe(F.lit(name))) if name is not None else dictionary.limit(0)


def group_sizes(dictionary: DataFrame) -> DataFrame:
    """Distinct words per group, and of the union of all groups as the group ``*``."""
    per = dictionary.groupBy("group_name").agg(F.countDistinct("word").alias("n_words"))
    return per.unionByName(dictionary.agg(F.countDistinct("word").alias("n_words")).withColumn("group_name", F.lit("*")))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one of two sets."""
    return a.subtract(b).union(b.subtract(a))
