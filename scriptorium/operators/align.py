"""Alignment of read and corrected text, character by character and token by token."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.common import stage_table
from scriptorium.functions import text as X


def apart(pairs: DataFrame) -> DataFrame:
    """``(original, gold, position, orig_char, gold_char, n)``: the characters of pairs ``(original, gold,
    n)``, cut to the shorter of the two; a frequent pair is taken apart once."""
    zipped = F.arrays_zip(X.characters(F.col("original")).alias("o"), X.characters(F.col("gold")).alias("g"))
    cut = F.slice(zipped, F.lit(1), F.least(F.length("original"), F.length("gold")))
    return pairs.select("original", "gold", "n", F.posexplode(cut).alias("position", "c")).select("original", "gold", "position", F.col("c.o").alias("orig_char"), F.col("c.g").alias("gold_char"), "n")


def read_counts(words: DataFrame) -> DataFrame:
    """How often a character was read for a character meant, over all documents (summed)."""
    return pair_counts(full_alignments(words))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``read_counts`` of pairs ``(original, gold, n)``."""
    return apart(pairs).groupBy("orig_char", "gold_char").agg(F.sum("n").alias("n"))


def full_alignments(words: DataFrame) -> DataFrame:
    """Distinct aligned pairs of words with their number."""
    return words.where("original IS NOT NULL AND gold IS NOT NULL").groupBy("original", "gold").agg(F.count("*").alias("n"))


def word_alignments(words: DataFrame) -> DataFrame:
    """``(original, doc_id, doc_index, gold)``: which correction each reading got where."""
    return words.where("original IS NOT NULL AND gold IS NOT NULL").select("original", "doc_id", "doc_index", "gold")


GOLD_SCHEMA = "doc_id string, doc_index int, original string, gold string, is_discarded boolean"
GRAM = 4
SPARSE = 512
SEGMENT = 4096


def cut_points(left: DataFrame, right: DataFrame, sparse: int, bits: int) -> DataFrame:
    """``(doc_id, place, r_place)`` where both sides surely agree: runs of ``GRAM`` words found once on
    either side, as far as no other of them crosses; about one run in ``sparse``, chosen by its hash,
    so that the choice depends on the words alone."""

    def once(rows: DataFrame) -> DataFrame:
        grams = with_following(rows, GRAM, bits).where("gram IS NOT NULL")
        return grams.groupBy("doc_id", "gram").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n = 1").drop("n")

    both = once(left).join(once(right).withColumnRenamed("place", "r_place"), ["doc_id", "gram"]).where(F.pmod("gram", F.lit(sparse)) == 0)
    rows = both.select("doc_id", "place", "r_place", F.shiftright("place", bits).alias("rng"))
    inside, over = Window.partitionBy("doc_id", "rng").orderBy("place"), Window.partitionBy("doc_id").orderBy("rng")
    up, down = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    edges = rows.groupBy("doc_id", "rng").agg(F.max("r_place").alias("most"), F.min("r_place").alias("least"))
    edges = edges.select("doc_id", "rng", F.max("most").over(over.rowsBetween(*up)).alias("most"), F.min("least").over(over.rowsBetween(*down)).alias("least"))
    seen = rows.withColumns({"before": F.max("r_place").over(inside.rowsBetween(*up)), "behind": F.min("r_place").over(inside.rowsBetween(*down))}).join(edges, ["doc_id", "rng"])
    clean = (F.coalesce(F.greatest("before", "most"), F.lit(-1)) < F.col("r_place")) & (F.coalesce(F.least("behind", "least"), F.lit((1 << 63) - 1)) > F.col("r_place"))
    return seen.where(clean).select("doc_id", "place", "r_place")


def with_place(rows: DataFrame, bits: int) -> DataFrame:
    """Adds ``place``, the number of the row in its document from 0."""
    ranged = rows.withColumn("rng", F.shiftright("doc_index", bits))
    over = Window.partitionBy("doc_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("doc_id", "rng").agg(F.count("*").alias("size")).select("doc_id", "rng", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("base"))
    numbered = ranged.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "rng").orderBy("doc_index", "original")))
    return numbered.join(base, ["doc_id", "rng"]).withColumn("place", F.col("base") + F.col("rn") - 1).select(*rows.columns, "place")


def with_following(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """Adds ``gram``, a hash of the word and the ``size - 1`` behind it; NULL at the end of the document.
    The first rows of a range of places also go to the range before."""
    home, inside = F.shiftright("place", bits), F.pmod("place", F.lit(1 << bits))
    parts = F.array_compact(F.array(home, F.when((inside < size - 1) & (home > 0), home - 1)))
    spread = rows.select("doc_id", "place", "original", home.alias("home"), F.explode(parts).alias("part"))
    w = Window.partitionBy("doc_id", "part").orderBy("place")
    ahead = [F.lead("original", k).over(w) for k in range(1, size)]
    gram = F.when(F.lead("place", size - 1).over(w).isNotNull(), F.xxhash64("original", *ahead))
    return spread.withColumn("gram", gram).where("part = home").select("doc_id", "place", "gram")


def with_segment(rows: DataFrame, cuts: DataFrame, bits: int) -> DataFrame:
    """Adds ``segment``: how many cuts ``(doc_id, place)`` lie at or before the row."""
    flagged = rows.join(cuts.select("doc_id", "place", F.lit(1).alias("cut")), ["doc_id", "place"], "left").withColumn("rng", F.shiftright("place", bits))
    w = Window.partitionBy("doc_id", "rng").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("doc_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    base = flagged.groupBy("doc_id", "rng").agg(F.count("cut").alias("n")).select("doc_id", "rng", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    return flagged.withColumn("within", F.count("cut").over(w)).join(base, ["doc_id", "rng"]).withColumn("segment", F.col("base") + F.col("within")).select(*rows.columns, "segment")


def opcodes(x: list[str], y: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Differences of two sequences; long ones are parted at words found once on either side first."""
    if max(len(x), len(y)) <= SEGMENT:
        return SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    count_x, count_y = Counter(x), Counter(y)
    where = {w: j for j, w in enumerate(y) if count_y[w] == 1}
    pairs = [(i, where[w]) for i, w in enumerate(x) if count_x[w] == 1 and w in where]
    cuts, last = [], (0, 0)
    for i, j in rising(pairs):
        if i - last[0] >= SEGMENT // 4 and j > last[1]:
            last = (i, j)
            cuts.append(last)
    if not cuts:
        return SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    out, edges = [], [(0, 0), *cuts, (len(x), len(y))]
    for (a, c), (b, d) in zip(edges, edges[1:], strict=False):
        out += [(tag, i + a, j + a, k + c, m + c) for tag, i, j, k, m in SequenceMatcher(None, x[a:b], y[c:d], autojunk=False).get_opcodes()]
    return out


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the pairs, rising in the first, that rises in the second as well."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        ends[k:k + 1] = [j]
        at[k:k + 1] = [n]
        back.append(at[k - 1] if k else -1)
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def apply_as_gold(left: DataFrame, right: DataFrame, bits: int = 13, strict: bool = True, sparse: int = SPARSE) -> DataFrame:
    """Takes over the words of ``right`` as corrections of ``left``, both ``(doc_id, doc_index,
    original)``: equal words and words replaced one for one get a gold, words missing on the right
    are discarded, excess words on the left stay untouched; a word only on the right is an error,
    or is passed over if not ``strict``.

    Both sides are parted where they surely agree (``cut_points``) and compared part by part, so no
    document meets in one task unless its sides have hardly a run of words in common. ``bits``, the
    width of the key ranges that carry numbers, has no influence on the result. A document without
    right side is discarded word by word; one without left side is an error, or nothing. Rows with a
    NULL key are left out; a NULL word is an empty one.
    """

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            if strict:
                raise ValueError(f"{key[0]}: {b['r_original'].tolist()[:10]} have no counterpart")
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("doc_id", object), ("doc_index", "int32"), ("original", object), ("gold", object), ("is_discarded", bool))})
        a = a.sort_values("place")
        x, y = a["original"].tolist(), b.sort_values("r_place")["r_original"].tolist() if len(b) else []
        gold: list[str | None] = [None] * len(x)
        gone = [False] * len(x)
        for tag, i, j, k, m in opcodes(x, y):
            if tag == "insert" and strict:
                raise ValueError(f"{key[0]}: {y[k:m][:10]} have no counterpart")
            for p, q in zip(range(i, j), range(k, m), strict=False):
                gold[p] = y[q]
            if tag == "delete":
                gone[i:j] = [True] * (j - i)
                gold[i:j] = [""] * (j - i)
        return pd.DataFrame({"doc_id": a["doc_id"].to_numpy(), "doc_index": a["doc_index"].to_numpy(), "original": x, "gold": gold, "is_discarded": gone})

    keyed = lambda df: df.where("doc_id IS NOT NULL AND doc_index IS NOT NULL").select("doc_id", "doc_index", F.coalesce("original", F.lit("")).alias("original"))
    a, b = (stage_table(with_place(keyed(side), bits), "sides") for side in (left, right))
    cuts = stage_table(cut_points(a, b, sparse, bits), "cuts")
    a = with_segment(a, cuts, bits)
    b = with_segment(b, cuts.select("doc_id", F.col("r_place").alias("place")), bits)
    b = b.select(F.col("doc_id").alias("r_doc"), F.col("segment").alias("r_segment"), F.col("place").alias("r_place"), F.col("original").alias("r_original"))
    return a.groupBy("doc_id", "segment").cogroup(b.groupBy("r_doc", "r_segment")).applyInPandas(one, GOLD_SCHEMA)
