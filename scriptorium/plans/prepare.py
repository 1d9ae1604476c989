"""The preparation of documents as one lazy plan: each step builds on those before it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.common import stage_table
from scriptorium.operators import align, bins, hmm
from scriptorium.operators import tokens as T

# The steps and what they build on.
STEPS = {"tokenize": None, "rehyphenate": None, "autocrop": "tokenize", "dehyphenate": "tokenize", "kbest": "dehyphenate", "bin": "kbest", "autocorrect": "bin", "server": "autocorrect", "all": "autocorrect"}


@dataclass
class Options:
    """What changes results. ``model``: a trained character model, needed from the step kbest on."""

    dictionary: DataFrame
    settings: DataFrame
    model: hmm.Model | None = None
    k: int = 4
    dehyphenate: bool = True
    multichars: dict[str, list[str]] = field(default_factory=dict)
    force: bool = False


def blank_tokens(words: DataFrame) -> DataFrame:
    """Fresh tokens from ``(doc_id, doc_index, original)``: nothing decided, never edited."""
    no = F.lit(False)
    empty = {"gold": "string", "heuristic": "string", "selection": "string", "bin": "int", "last_modified": "timestamp_ntz"}
    return words.select("doc_id", "doc_index", "original", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], no.alias("is_hyphenated"), no.alias("is_discarded"), no.alias("has_error"))


def with_dehyphenation(tokens: DataFrame) -> DataFrame:
    changed = T.dehyphenate(tokens).select("doc_id", "doc_index", "is_hyphenated", "gold")
    return tokens.drop("is_hyphenated", "gold").join(changed, ["doc_id", "doc_index"])


def with_kbest(tokens: DataFrame, options: Options) -> DataFrame:
    """Candidates of the joined words, computed once per distinct word, kept on the head."""
    words = T.consolidated(tokens).select("doc_id", "doc_index", F.col("original").alias("word"))
    found = hmm.kbest_words(words, options.model, options.k, options.multichars)
    lists = words.join(found, "word").select("doc_id", "doc_index", F.col("kbest").alias("new_kbest"))
    joined = tokens.join(lists, ["doc_id", "doc_index"], "left")
    none = F.array().cast(hmm.KBEST)
    if "kbest" not in tokens.columns:
        return joined.withColumn("kbest", F.coalesce("new_kbest", none)).drop("new_kbest")
    keep = F.lit(not options.force) & (F.size("kbest") == options.k)
    return joined.withColumn("kbest", F.when(keep, F.col("kbest")).otherwise(F.coalesce("new_kbest", "kbest", none))).drop("new_kbest")


def with_bins(tokens: DataFrame, options: Options) -> DataFrame:
    """Decisions; a bin a token has already stays, unless ``force`` is set."""
    made = bins.bin_tokens(tokens, options.dictionary, options.settings)
    if options.force or "bin" not in tokens.columns:
        return made
    names = ("bin", "heuristic", "selection")
    old = tokens.where("bin IS NOT NULL").select("doc_id", "doc_index", F.struct(*names).alias("old"))
    kept = made.join(old, ["doc_id", "doc_index"], "left")
    return kept.withColumns({c: F.when(F.col("old").isNotNull(), F.col("old")[c]).otherwise(F.col(c)) for c in names}).drop("old")


def apply_corrections(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """The tokens with the corrections of a file: rows ``(doc_id, doc_index, gold, is_discarded)``, of
    which the later columns may be missing, replace what the tokens hold. Rows without a token, or with
    a NULL key, are passed over; of repeated rows the one with the greatest text counts."""
    flag = F.col("is_discarded") if "is_discarded" in rows.columns else F.lit(None).cast("boolean")
    new = rows.where("doc_id IS NOT NULL AND doc_index IS NOT NULL").groupBy("doc_id", "doc_index").agg(F.max(F.struct(F.col("gold").alias("gold"), flag.alias("gone"))).alias("c"))
    joined = tokens.join(new, ["doc_id", "doc_index"], "left")
    there = F.col("c").isNotNull()
    return joined.withColumns({"gold": F.when(there, F.col("c.gold")).otherwise(F.col("gold")), "is_discarded": F.coalesce("c.gone", "is_discarded")}).drop("c")


def corrected_texts(tokens: DataFrame, only_done: bool = True) -> DataFrame:
    """``(doc_id, text)`` of the corrected documents, rows discarded left out; those complete by their
    counts, or all."""
    if only_done:
        tokens = tokens.join(T.doc_stats(tokens).where("done").select("doc_id"), "doc_id", "left_semi")
    return T.document_texts(tokens.where("NOT is_discarded"))


def prepare(words: DataFrame, step: str, options: Options) -> DataFrame:
    """Runs all steps up to ``step`` on ``(doc_id, doc_index, original)`` or on tokens."""
    if step not in STEPS:
        raise ValueError(f"unknown step {step}; known: {', '.join(STEPS)}")
    chain, at = [], step
    while at:
        chain.append(at)
        at = STEPS[at]
    tokens = words if "gold" in words.columns else blank_tokens(words)
    for name in reversed(chain):
        if name == "rehyphenate" or (name == "dehyphenate" and options.dehyphenate):
            tokens = with_dehyphenation(tokens)
        elif name == "autocrop":
            found = T.boxes(tokens)
            tokens = T.cropped(tokens, T.outside_edges(found, T.edges_or(found)))
        elif name == "kbest":
            tokens = with_kbest(tokens, options)
        elif name == "bin":
            tokens = with_bins(tokens, options)
        elif name == "autocorrect":
            gold = bins.autocorrect(tokens)
            tokens = tokens.drop("gold").join(gold, ["doc_id", "doc_index"])
    return tokens


def training_words(tokens: DataFrame, finished: DataFrame) -> DataFrame:
    """``(word, n)`` of the corrected words of finished documents, broken ones joined."""
    return training_pairs(tokens, finished).where("gold <> ''").groupBy(F.col("gold").alias("word")).agg(F.sum("n").alias("n"))


def training_pairs(tokens: DataFrame, finished: DataFrame) -> DataFrame:
    """``(original, gold, n)`` of the words of the documents ``(doc_id)``."""
    words = T.consolidated(tokens.join(finished.select("doc_id"), "doc_id", "left_semi"))
    return words.where("gold IS NOT NULL").groupBy("original", "gold").agg(F.count("*").alias("n"))


def train_model(tokens: DataFrame, finished: DataFrame, dictionary: DataFrame | None = None, required: str = hmm.CHARACTERS, smoothing: float = hmm.SMOOTHING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three model tables from the corrected words of the documents ``finished``."""
    pairs = stage_table(training_pairs(tokens, finished), "pairs")
    words = pairs.where("gold <> ''").groupBy(F.col("gold").alias("word")).agg(F.sum("n").alias("n"))
    return hmm.train(align.pair_counts(pairs.where("original IS NOT NULL")), words, dictionary, required, smoothing)
