"""Decision bins: which heuristic a token gets, by its reading, its candidates and the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.dictionary import known_words
from scriptorium.operators.tokens import with_pairs

# Short forms of the heuristics.
CODES = {"a": "annotator", "o": "original", "k": "kbest", "d": "kdict"}


def settings(raw: DataFrame) -> DataFrame:
    """``(bin, heuristic)``, one row a bin from 1 to 10: names or short forms, ``annotator`` where unset."""
    spark = raw.sparkSession
    every = spark.range(1, 11).select(F.col("id").cast("int").alias("bin"))
    named = raw.where("bin IS NOT NULL").groupBy("bin").agg(F.max("heuristic").alias("heuristic"))
    long = F.lower(F.btrim("heuristic"))
    for short, name in CODES.items():
        long = F.when(F.lower(F.btrim("heuristic")) == short, name).otherwise(long)
    return every.join(F.broadcast(named), "bin", "left").select("bin", F.coalesce(F.nullif(long, F.lit("")), F.lit("annotator")).alias("heuristic"))


def with_knowledge(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``o_known`` and ``k_known`` (the places of candidates in the dictionary) to rows with
    ``original`` and ``kbest``. Distinct words are looked up once; candidates are exploded for the
    join only, and return as one short array per token."""
    words = tokens.select(F.col("original").alias("word")).unionByName(tokens.select(F.explode("kbest.candidate").alias("word")))
    known = known_words(words, dictionary).where("known").select("word")
    exploded = tokens.select("doc_id", "doc_index", F.explode("kbest").alias("c")).select("doc_id", "doc_index", "c.k", F.col("c.candidate").alias("word"))
    hits = exploded.join(known, "word").groupBy("doc_id", "doc_index").agg(F.array_sort(F.collect_list("k")).alias("k_known"))
    originals = known.select(F.col("word").alias("original"), F.lit(True).alias("o_hit"))
    return (
        tokens.join(hits, ["doc_id", "doc_index"], "left")
        .join(originals, "original", "left")
        .withColumns({"o_known": F.coalesce("o_hit", F.lit(False)), "k_known": F.coalesce("k_known", F.array().cast("array<int>"))})
        .drop("o_hit")
    )


def looked_up(tokens: DataFrame, kbest: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same from the rows of the candidates, before they are lists: distinct words are looked up
    once, every candidate row is marked, and the list of a token arrives with its marks."""
    words = tokens.select(F.col("original").alias("word")).unionByName(kbest.select(F.col("candidate").alias("word")))
    known = known_words(words, dictionary).where("known").select("word")
    marked = kbest.join(known.select(F.col("word").alias("candidate"), F.lit(True).alias("hit")), "candidate", "left")
    lists = marked.groupBy("doc_id", "doc_index").agg(F.array_sort(F.collect_list(F.struct("k", "candidate", "probability", "hit"))).alias("all"))
    originals = known.select(F.col("word").alias("original"), F.lit(True).alias("o_hit"))
    plain = F.transform("all", lambda c: F.struct(c["k"].alias("k"), c["candidate"].alias("candidate"), c["probability"].alias("probability")))
    places = F.transform(F.filter("all", lambda c: c["hit"].isNotNull()), lambda c: c["k"])
    return (
        tokens.join(lists, ["doc_id", "doc_index"], "left")
        .join(originals, "original", "left")
        .withColumns({"kbest": F.coalesce(plain, F.array().cast("array<struct<k:int,candidate:string,probability:double>>")), "k_known": F.coalesce(places, F.array().cast("array<int>")), "o_known": F.coalesce("o_hit", F.lit(False))})
        .drop("all", "o_hit")
    )


def bin_number() -> Column:
    """The bin of rows with ``original, kbest, o_known, k_known``; the first that matches."""
    k1 = F.try_element_at("kbest", F.lit(1))["candidate"]
    same, o = F.col("original").eqNullSafe(k1), F.col("o_known")
    top = F.array_contains("k_known", 1)
    none, some = F.size("k_known") == 0, F.size("k_known") > 0
    return (
        F.when(F.size("kbest") == 0, F.lit(10))
        .when(same & o, 1)
        .when(same & ~o & none, 2)
        .when(same & ~o & some, 3)
        .when(~same & ~o & top, 4)
        .when(~same & ~o & none, 5)
        .when(~same & ~o & ~top & some, 6)
        .when(~same & o & top, 7)
        .when(~same & o & none, 8)
        .when(~same & o & ~top & some, 9)
        .otherwise(10)
    )


def selection_of(heuristic: Column) -> Column:
    """What the heuristic selects, as text: the reading, the place of a candidate, or the places an
    annotator may choose from; NULL where a dictionary candidate is asked for and there is none."""
    return (
        F.when(heuristic == "original", F.col("original"))
        .when(heuristic == "kbest", F.lit("1"))
        .when(heuristic == "kdict", F.try_element_at("k_known", F.lit(1)).cast("string"))
        .when(heuristic == "annotator", F.concat(F.lit("["), F.array_join(F.col("k_known").cast("array<string>"), ", "), F.lit("]")))
    )


def bin_tokens(tokens: DataFrame, dictionary: DataFrame, raw_settings: DataFrame) -> DataFrame:
    """``(doc_id, doc_index, original, gold, kbest, k_known, o_known, bin, heuristic, selection)``.

    ``tokens`` as in ``tokens.current`` joined with their candidates, or as ``looked_up`` gives them. A
    consumed second half gets the decision of its head.
    """
    ready = tokens if "k_known" in tokens.columns else with_knowledge(tokens, dictionary)
    known = ready.withColumn("bin", bin_number())
    decided = known.drop("heuristic", "selection").join(F.broadcast(settings(raw_settings)), "bin")
    decided = decided.withColumn("selection", selection_of(F.col("heuristic")))
    paired = with_pairs(decided, F.col("is_hyphenated") & ~F.col("is_discarded"), ["doc_index"])
    heads = paired.where("head AND next_doc_index IS NOT NULL").select("doc_id", F.col("next_doc_index").alias("doc_index"), F.struct("bin", "heuristic", "selection").alias("h"))
    out = paired.join(heads, ["doc_id", "doc_index"], "left")
    take = lambda c: F.when(F.col("h").isNotNull(), F.col("h")[c]).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", "doc_index", "original", "gold", "kbest", "o_known", "k_known", "is_hyphenated", "is_discarded", take("bin"), take("heuristic"), take("selection"))


def autocorrect(binned: DataFrame) -> DataFrame:
    """``(doc_id, doc_index, gold)``: the correction a heuristic gives where there is none yet."""
    place = F.col("selection").try_cast("int")
    pick = F.when(place.isNotNull(), F.coalesce(F.try_element_at("kbest", place)["candidate"], F.lit("")))
    new = F.when(F.col("heuristic") == "original", F.col("original")).when(F.col("heuristic").isin("kbest", "kdict"), pick)
    gold = F.when(F.col("gold") != "", F.col("gold")).otherwise(F.coalesce(new, F.col("gold")))
    return binned.select("doc_id", "doc_index", gold.alias("gold"))


def histogram(binned: DataFrame) -> DataFrame:
    return binned.groupBy("bin", "heuristic").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("heuristic") == "annotator").alias("n_annotator"))

