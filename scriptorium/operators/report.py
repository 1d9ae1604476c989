"""Quality report: totals, counts per bin, changes of bins, corrections seen before."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X


def row_class() -> Column:
    """What the report counts a row as; the first that holds."""
    original, gold = F.col("original"), F.col("gold")
    return (
        F.when(original.isNull() | ((original == "") & gold.isNull()), "malformed")
        .when(X.is_punctuation(original), "punctuation")
        .when((original == "") & (gold != ""), "undersegmented")
        .when((gold == "") & (original != ""), "oversegmented")
        .when(gold.isNull() | (gold == ""), "nogold")
        .otherwise("counted")
    )


def totals(tokens: DataFrame) -> DataFrame:
    """One row: all rows, hyphenated ones, each class, and the tokens that count (gold or not)."""
    t = tokens.withColumn("class", row_class())
    of = lambda c: F.count_if(F.col("class") == c)
    return t.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_hyphenated")).alias("hyphenated"),
        of("punctuation").alias("punctuation"),
        of("undersegmented").alias("undersegmented"),
        of("oversegmented").alias("oversegmented"),
        of("nogold").alias("nogold"),
        of("malformed").alias("malformed"),
        F.count_if(F.col("class").isin("nogold", "counted")).alias("token_count"),
    )


def per_bin(binned: DataFrame) -> DataFrame:
    """``(bin, total, gold_is_original, gold_is_top, gold_is_lower, by_<heuristic>, annotator_*)`` over
    the rows that count; for annotators, in this order: the reading, the first candidate, a lower
    candidate of the dictionary, something new."""
    t = binned.withColumn("class", row_class()).where("class IN ('nogold', 'counted') AND bin IS NOT NULL")
    k1 = F.try_element_at("kbest", F.lit(1))["candidate"]
    lower = F.exists("kbest", lambda c: (c["k"] > 1) & F.array_contains("k_known", c["k"]) & (c["candidate"] == F.col("gold")))
    same, top, low = F.coalesce(F.col("gold") == F.col("original"), F.lit(False)), F.coalesce(F.col("gold") == k1, F.lit(False)), F.coalesce(lower, F.lit(False))
    hand = F.col("heuristic") == "annotator"
    count = F.count_if
    return t.groupBy("bin").agg(
        F.count("*").alias("total"),
        count(same).alias("gold_is_original"),
        count(top).alias("gold_is_top"),
        count(low).alias("gold_is_lower"),
        *[count(F.col("heuristic") == h).alias(f"by_{h}") for h in ("original", "kbest", "kdict", "annotator")],
        count(hand & same).alias("annotator_original"),
        count(hand & ~same & top).alias("annotator_top"),
        count(hand & ~same & ~top & low).alias("annotator_lower"),
        count(hand & ~same & ~top & ~low & F.col("gold").isNotNull()).alias("annotator_novel"),
    )


def summary(bins: DataFrame) -> DataFrame:
    """Counters added up over all bins, one row each."""
    names = [c for c in bins.columns if c != "bin"]
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names]))
    return bins.select(stacked.alias("s")).groupBy("s.name").agg(F.sum("s.n").alias("n"))


def rebin_moves(stored: DataFrame, binned: DataFrame) -> DataFrame:
    """``(old_bin, new_bin, n)``: how a new decision moves tokens between bins."""
    old = stored.select("doc_id", "doc_index", F.col("bin").alias("old_bin"))
    new = binned.select("doc_id", "doc_index", F.col("bin").alias("new_bin"))
    return old.join(new, ["doc_id", "doc_index"]).groupBy("old_bin", "new_bin").agg(F.count("*").alias("n"))


def first_examples(binned: DataFrame) -> DataFrame:
    """``(bin, doc_id, doc_index, original)``: the first longer word with a letter of every bin."""
    fit = binned.where((F.length("original") > 3) & (X.letters(F.col("original")) > 0) & F.col("bin").isNotNull())
    return fit.groupBy("bin").agg(F.min(F.struct("doc_id", "doc_index", "original")).alias("e")).select("bin", "e.*")


def tracked(tokens: DataFrame) -> DataFrame:
    """How often each reading was corrected to each text."""
    return tokens.where("original IS NOT NULL AND gold IS NOT NULL").groupBy("original", "gold").agg(F.count("*").alias("n"))


def by_count(counts: DataFrame) -> DataFrame:
    """Corrections, the most frequent first."""
    return counts.orderBy(F.desc("n"), "original", "gold")


def memoized(counts: DataFrame, least_frequent: bool = False) -> DataFrame:
    """``(original, gold)``: the correction a reading got most often (or least often, for parity
    with tools that overwrite in order of count); ties go to the greater text."""
    order = F.struct((-F.col("n") if least_frequent else F.col("n")).alias("n"), "gold")
    return counts.groupBy("original").agg(F.max(order).alias("m")).select("original", "m.gold")


def lines(total: dict, bins: list[dict]) -> list[str]:
    """The report as text, from the few rows of ``totals`` and ``per_bin``."""
    share = lambda n: f"{n / max(1, total['token_count']):.2%}"
    out = [f"tokens: {total['token_count']}", *[f"{name}: {n}" for name, n in sorted(total.items()) if name != "token_count"]]
    for b in sorted(bins, key=lambda r: r["bin"]):
        out.append(f"bin {b['bin']}: {b['total']} ({share(b['total'])})")
        out.extend(f"  {name}: {n}" for name, n in sorted(b.items()) if name not in ("bin", "total"))
        best = max(("original", "gold_is_original"), ("kbest", "gold_is_top"), ("kdict", "gold_is_lower"), key=lambda x: b[x[1]])
        out.append(f"  heuristic for bin {b['bin']}: {best[0] if b[best[1]] * 2 > b['total'] else 'annotator'}")
    return out


def settings_of(report: list[str]) -> dict[int, str]:
    """The heuristic of every bin as the report names it."""
    found = (re.match(r"\s*heuristic for bin (\d+): (\w+)", line) for line in report)
    return {int(m[1]): m[2] for m in found if m}
