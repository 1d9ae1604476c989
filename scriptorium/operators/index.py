"""Term index: where runs of listed terms occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators.tokens import RANGE_BITS, consolidated


def terms(raw: DataFrame) -> DataFrame:
    """``(tag, term)``, distinct: normalised terms of one word."""
    return raw.select("tag", X.term_key(F.col("term")).alias("term")).where("term <> ''").distinct()


def tagged(tokens: DataFrame, listed: DataFrame) -> DataFrame:
    """The consolidated sequence with ``word`` and ``tags``: all tags of its word, in order, NULL if none."""
    words = consolidated(tokens).withColumn("word", X.effective(F.col("gold"), F.col("original"))).withColumn("key", X.term_key(F.col("word")))
    tags = listed.groupBy("term").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return words.join(tags, words["key"] == tags["term"], "left").select("doc_id", "doc_index", "word", "tags")


def runs(sequence: DataFrame, longer_than: int = 1) -> DataFrame:
    """``(doc_id, first_index, last_index, tokens, tags)``: maximal stretches of consecutive tagged
    words, a stretch open at the end of a document included.

    A stretch is known by the number of untagged words before it, counted inside key ranges and
    carried over them by a summary with one row per range; only tagged rows are grouped.
    """
    rows = sequence.withColumn("rng", F.shiftright("doc_index", RANGE_BITS))
    w = Window.partitionBy("doc_id", "rng").orderBy("doc_index").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("doc_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("tags").isNull().cast("long")
    sums = rows.groupBy("doc_id", "rng").agg(F.sum(gap).alias("gaps"))
    base = sums.select("doc_id", "rng", F.coalesce(F.sum("gaps").over(over), F.lit(0)).alias("base"))
    numbered = rows.withColumn("gaps", F.sum(gap).over(w)).where("tags IS NOT NULL").join(base, ["doc_id", "rng"]).withColumn("run", F.col("base") + F.col("gaps"))
    entry = F.array_sort(F.collect_list(F.struct("doc_index", "word", "tags")))
    found = numbered.groupBy("doc_id", "run").agg(entry.alias("e")).where(F.size("e") > longer_than)
    return found.select(
        "doc_id",
        F.element_at("e", 1)["doc_index"].alias("first_index"),
        F.element_at("e", -1)["doc_index"].alias("last_index"),
        F.array_join(F.transform("e", lambda x: x["word"]), " ").alias("tokens"),
        F.array_join(F.transform("e", lambda x: F.array_join(x["tags"], "+")), " ").alias("tags"),
    )


def highlights(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(doc_id, page, x0, y0, x1, y1, tags)``: what to mark on the pages, one row a token."""
    near = found.withColumn("doc_index", F.explode(F.sequence("first_index", "last_index")))
    return near.join(boxes.drop("original", "gold"), ["doc_id", "doc_index"]).select("doc_id", "doc_index", "page", "x0", "y0", "x1", "y1", "tags")
