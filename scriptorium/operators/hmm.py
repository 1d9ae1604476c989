"""The character model: training, validity, k-best candidates, Viterbi.

Training is a DataFrame job over counts; its result has at most alphabet x alphabet rows. Inference
collects these three tables, whose size does not depend on the text, and runs a beam over the
*distinct* words as NumPy matrix steps in an Arrow UDF; results return to the tokens by a join.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.common import stage_table
from scriptorium.functions import text as X

SMOOTHING = 0.0001
# Characters never part of a word.
REMOVED = " \t\n\r﻿\x00"
# The character set a model is trained for unless another is given.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÆØÅæøåÄËÏÖÜÁÉÍÓÚÀÈÌÒÙäëïöüáéíóúàèìòù"
MOST_CHARACTERS = 4096
#: Cells of a matrix of one step of a beam over several words.
STEP_CELLS = 4_000_000


def check_alphabet(n: int) -> None:
    """Tables of alphabet x alphabet are made and collected only for what is an alphabet."""
    if n > MOST_CHARACTERS:
        raise ValueError(f"{n} states: an alphabet has at most {MOST_CHARACTERS}")


def _kept(c: Column) -> Column:
    return (F.length(c) == 1) & ~c.isin(*REMOVED)


def char_counts(words: DataFrame, charset: str = "") -> DataFrame:
    """``(ch, n)`` over rows ``(word, n)``; only characters of ``charset`` if given."""
    ch = F.col("ch")
    wanted = _kept(ch) & ch.isin(sorted(set(charset))) if charset else _kept(ch)
    return words.where("word IS NOT NULL").select(F.explode(X.characters(F.col("word"))).alias("ch"), "n").where(wanted).groupBy("ch").agg(F.sum("n").alias("n"))


def first_letters(words: DataFrame) -> DataFrame:
    return words.where("word <> ''").groupBy(F.substring("word", 1, 1).alias("ch")).agg(F.sum("n").alias("n"))


def bigrams(words: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    two = words.where("length(word) > 1").select(F.explode(pairs).alias("p"), "n")
    return two.groupBy(F.substring("p", 1, 1).alias("src"), F.substring("p", 2, 1).alias("dst")).agg(F.sum("n").alias("n"))


def confusion(read_counts: DataFrame) -> DataFrame:
    """Cleaned counts ``(state, obs, n)``: single characters, none of the removed ones; the state is
    the character meant, the observation the one read."""
    return read_counts.where(_kept(F.col("gold_char")) & _kept(F.col("orig_char"))).select(F.col("gold_char").alias("state"), F.col("orig_char").alias("obs"), "n")


def alphabet(conf: DataFrame, counts: DataFrame, required: str = "") -> DataFrame:
    """The states: required characters, those counted, and those confused; a bounded set."""
    spark = conf.sparkSession
    base = spark.createDataFrame([(c,) for c in sorted(set(required))], "ch string")
    return base.unionByName(counts.select("ch")).unionByName(conf.select(F.col("state").alias("ch"))).distinct()


def initial(letters: DataFrame, states: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """``(state, p)``: smoothed share of each first letter; letters outside the states count below the line."""
    total = letters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).crossJoin(states.agg(F.count("*").alias("size")))
    joined = states.join(letters, "ch", "left").crossJoin(F.broadcast(total))  # one row on the right
    return joined.select(F.col("ch").alias("state"), ((F.coalesce("n", F.lit(0)) + smoothing) / (F.col("total") + smoothing * F.col("size"))).alias("p"))


def _grid(states: DataFrame) -> DataFrame:
    """All pairs of states: alphabet x alphabet rows, whatever the text."""
    return states.select(F.col("ch").alias("src")).crossJoin(F.broadcast(states.select(F.col("ch").alias("dst"))))


def transitions(pairs: DataFrame, states: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """``(src, dst, p)``: smoothed share of each following character."""
    totals = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    size = states.agg(F.count("*").alias("size"))
    joined = _grid(states).join(pairs, ["src", "dst"], "left").join(totals, "src", "left").crossJoin(F.broadcast(size))
    return joined.select("src", "dst", ((F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("total", F.lit(0)) + smoothing * F.col("size"))).alias("p"))


def emissions(conf: DataFrame, counts: DataFrame, states: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """``(state, obs, p)``: smoothed share of each reading of a character; 1 on the diagonal; 0 for
    states never seen and for readings never made. A character counted but never confused has its
    own count as its only reading."""
    own = counts.join(conf.select(F.col("state").alias("ch")).distinct(), "ch", "left_anti").select(F.col("ch").alias("state"), F.col("ch").alias("obs"), "n")
    rows = conf.unionByName(own)
    totals = rows.groupBy("state").agg(F.sum("n").alias("total"))
    made = rows.select("obs").distinct()
    size = made.agg(F.count("*").alias("size"))
    grid = _grid(states).select(F.col("src").alias("state"), F.col("dst").alias("obs"))
    joined = grid.join(rows, ["state", "obs"], "left").join(totals, "state", "left").join(made.withColumn("made", F.lit(True)), "obs", "left").crossJoin(F.broadcast(size))
    share = (F.coalesce("n", F.lit(0)) + smoothing) / (F.col("total") + smoothing * F.col("size"))
    p = F.when(F.col("state") == F.col("obs"), F.lit(1.0)).when(F.col("total").isNotNull() & F.col("made"), share).otherwise(F.lit(0.0))
    return joined.select("state", "obs", p.alias("p"))


def validity(init: DataFrame, tran: DataFrame, emis: DataFrame) -> DataFrame:
    """One row: whether the three tables have the same states and all rows are full."""
    n = init.count()
    same = lambda df, c: init.select("state").exceptAll(df.select(F.col(c).alias("state")).distinct()).union(df.select(F.col(c).alias("state")).distinct().exceptAll(init.select("state"))).isEmpty()
    full = tran.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") != n).isEmpty()
    return init.sparkSession.createDataFrame([(n, same(tran, "src"), same(emis, "state"), full)], "n_states long, tran_states_equal boolean, emis_states_equal boolean, tran_rows_full boolean")


class Model:
    """The three tables as matrices over the sorted states."""

    def __init__(self, init: dict[str, float], tran: dict[tuple[str, str], float], emis: dict[tuple[str, str], float]):
        check_alphabet(len(init))
        self.states = sorted(init)
        self.index = {c: i for i, c in enumerate(self.states)}
        n = len(self.states)
        self.init = np.array([init[c] for c in self.states])
        self.tran = np.zeros((n, n))
        for (a, b), p in tran.items():
            if a in self.index and b in self.index:
                self.tran[self.index[a], self.index[b]] = p
        # a row per character read; the last one for characters never read
        self.read = {c: i for i, c in enumerate(sorted({b for _, b in emis}))}
        self.emis = np.zeros((len(self.read) + 1, n))
        for (a, b), p in emis.items():
            if a in self.index:
                self.emis[self.read[b], self.index[a]] = p

    @classmethod
    def collect(cls, init: DataFrame, tran: DataFrame, emis: DataFrame) -> Model:
        """From the three tables, once it is sure that they are of the size of an alphabet."""
        check_alphabet(init.count())
        return cls({r.state: r.p for r in init.collect()}, {(r.src, r.dst): r.p for r in tran.collect()}, {(r.state, r.obs): r.p for r in emis.collect()})

    def _codes(self, words: list[str]) -> np.ndarray:
        """The rows of ``emis`` for words of one length."""
        none = len(self.read)
        return np.array([[self.read.get(c, none) for c in w] for w in words], dtype=np.int64)

    @staticmethod
    def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
        """Per row the places of the k greatest scores, greatest first, equal ones by key."""
        k = min(k, scores.shape[1])
        chosen = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(scores, chosen, axis=1).min(axis=1)
        for row in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > k):  # equal to the last one
            tied = np.flatnonzero(scores[row] >= least[row])
            chosen[row] = tied[np.lexsort((keys[row, tied], -scores[row, tied]))][:k]
        by_key = np.argsort(np.take_along_axis(keys, chosen, axis=1), axis=1)
        chosen = np.take_along_axis(chosen, by_key, axis=1)
        return np.take_along_axis(chosen, np.argsort(-np.take_along_axis(scores, chosen, axis=1), axis=1, kind="stable"), axis=1)

    def beams(self, words: list[str], k: int) -> list[list[tuple[str, float]]]:
        """k-best readings of words of one length, taken together: all pairs of states for the first two
        characters, then k x states a step. Greatest first, equal ones by text."""
        size, n = len(words[0]), len(self.states)
        if not size or not n:
            return [[("", 0.0)] * k for _ in words]
        codes = self._codes(words)
        w = np.arange(len(words))[:, None]
        if size == 1:
            first = self.init * self.emis[codes[:, 0]]
            keys = np.broadcast_to(np.arange(n), first.shape)
            chosen = self._best(first, keys, k)
            return [[(self.states[i], float(first[r, i])) for i in row] for r, row in enumerate(chosen.tolist())]
        # words that begin alike share their first step, which is by far the widest
        starts, owner = np.unique(codes[:, :2], axis=0, return_inverse=True)
        parts = []
        for at in range(0, len(starts), self.step()):
            a, b = starts[at : at + self.step()].T
            scores = ((self.init * self.emis[a])[:, :, None] * self.tran[None]).reshape(len(a), n * n) * np.tile(self.emis[b], n)
            chosen = self._best(scores, np.broadcast_to(np.arange(n * n), scores.shape), k)
            parts.append((chosen, np.take_along_axis(scores, chosen, axis=1)))
        chosen, p = (np.concatenate(c)[owner.ravel()] for c in zip(*parts, strict=True))
        paths = np.stack([chosen // n, chosen % n], axis=2)
        rank = np.argsort(np.argsort(chosen, axis=1), axis=1)  # of the texts so far
        for step in range(2, size):
            scores = ((p[:, :, None] * self.tran[paths[:, :, -1]]) * self.emis[codes[:, step]][:, None, :]).reshape(len(words), -1)
            keys = (rank[:, :, None] * n + np.arange(n)).reshape(len(words), -1)
            chosen = self._best(scores, keys, k)
            p = np.take_along_axis(scores, chosen, axis=1)
            paths = np.concatenate([paths[w, chosen // n], (chosen % n)[:, :, None]], axis=2)
            rank = np.argsort(np.argsort(np.take_along_axis(keys, chosen, axis=1), axis=1), axis=1)
        text = np.array(self.states, dtype=object)
        return [[("".join(text[path]), float(x)) for path, x in zip(paths[r], p[r], strict=True)] for r in range(len(words))]

    def beam(self, word: str, k: int) -> list[tuple[str, float]]:
        return self.beams([word], k)[0]

    def readings(self, words: list[str]) -> list[str]:
        """The one best reading of words of one length, by dynamic programming; ties go to the first state."""
        size, n = len(words[0]), len(self.states)
        if not size or not n:
            return [""] * len(words)
        codes = self._codes(words)
        p = self.init * self.emis[codes[:, 0]]
        back = []
        for step in range(1, size):
            scores = p[:, :, None] * self.tran[None]
            back.append(scores.argmax(axis=1))
            p = scores.max(axis=1) * self.emis[codes[:, step]]
        at = p.argmax(axis=1)
        out = [at]
        for b in reversed(back):
            at = b[np.arange(len(words)), at]
            out.append(at)
        text = np.array(self.states, dtype=object)
        return ["".join(text[row]) for row in np.stack(out[::-1], axis=1)]

    def viterbi(self, word: str) -> str:
        return self.readings([word])[0]

    def step(self) -> int:
        """How many matrices of state x state keep a step small."""
        return max(1, STEP_CELLS // max(1, len(self.states)) ** 2)

    def together(self, words: list[str], one: Callable[[list[str]], list], most: int) -> dict[str, object]:
        """``one`` over distinct words, those of one length together, ``most`` at a time."""
        groups: dict[int, list[str]] = {}
        for w in sorted(set(words)):
            groups.setdefault(len(w), []).append(w)
        out: dict[str, object] = {}
        for group in groups.values():
            for at in range(0, len(group), most):
                part = group[at : at + most]
                out.update(zip(part, one(part), strict=True))
        return out

    def kbests(self, words: list[str], k: int, multichars: dict[str, list[str]]) -> list[list[tuple[str, float]]]:
        """k-best readings of words and of all their variants with a character group replaced."""
        others = {w: [v for group, replacements in multichars.items() if w and group in w for v in variants(w, group, replacements)] for w in dict.fromkeys(words)}
        found = self.together([x for w, more in others.items() for x in (w, *more)], lambda part: self.beams(part, k), max(1, STEP_CELLS // max(1, k * len(self.states))))
        merged = {w: sorted((r for x in (w, *more) for r in found[x]), key=lambda r: (-r[1], r[0]))[:k] if more else found[w] for w, more in others.items()}
        return [merged[w] for w in words]

    def kbest(self, word: str, k: int, multichars: dict[str, list[str]]) -> list[tuple[str, float]]:
        return self.kbests([word], k, multichars)[0]


def variants(word: str, group: str, replacements: list[str]) -> list[str]:
    """All ways to leave or replace every occurrence of a group, without the word itself."""
    pieces = word.split(group)
    out = {"".join(a + b for a, b in zip(pieces, [*choice, ""], strict=True)) for choice in product([group, *replacements], repeat=len(pieces) - 1)}
    return sorted(out - {word})


KBEST = "array<struct<k:int,candidate:string,probability:double>>"


def _distinct(words: DataFrame) -> DataFrame:
    """The distinct words, spread over as many tasks as a shuffle has: they are few bytes and much work,
    so that their number must not follow their size."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.select("word").where("word IS NOT NULL").distinct().repartition(parts)


def kbest_words(words: DataFrame, model: Model, k: int = 4, multichars: dict[str, list[str]] | None = None) -> DataFrame:
    """``(word, kbest)`` of the distinct values of the column ``word``."""
    shared = words.sparkSession.sparkContext.broadcast(model)
    groups = multichars or {}

    @F.pandas_udf(KBEST)
    def run(column: pd.Series) -> pd.Series:
        found = shared.value.kbests(column.tolist(), k, groups)
        return pd.Series([[{"k": i + 1, "candidate": t, "probability": p} for i, (t, p) in enumerate(row)] for row in found])

    return _distinct(words).select("word", run("word").alias("kbest"))


def viterbi_words(words: DataFrame, model: Model) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        words = column.tolist()
        found = shared.value.together(words, shared.value.readings, shared.value.step())
        return pd.Series([found[w] for w in words], dtype=object)

    return _distinct(words).select("word", run("word").alias("reading"))


def train(read_counts: DataFrame, gold_words: DataFrame, dictionary: DataFrame | None = None, required: str = "", smoothing: float = SMOOTHING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(initial, transitions, emissions)`` from character counts and rows ``(word, n)`` of corrected
    words; the distinct words of the dictionary count once each if given. Characters are counted as far
    as they are ``required`` (all if none is); the states are those required, counted and confused."""
    words = gold_words.select("word", "n")
    if dictionary is not None:
        words = words.unionByName(dictionary.select("word").distinct().withColumn("n", F.lit(1).cast("long")))
    # read by all three tables: counted once
    words = stage_table(words, "words")
    conf, counts = stage_table(confusion(read_counts), "confusion"), stage_table(char_counts(words, required), "characters")
    states = stage_table(alphabet(conf, counts, required), "states")
    check_alphabet(states.count())
    return initial(first_letters(words), states, smoothing), transitions(bigrams(words), states, smoothing), emissions(conf, counts, states, smoothing)


def compare(words: DataFrame, one: Model, other: Model, k: int = 4) -> DataFrame:
    """``(word, k, candidate, other_candidate)``: the candidates of two models side by side."""
    flat = lambda m: kbest_words(words, m, k).select("word", F.explode("kbest").alias("c")).select("word", "c.k", "c.candidate")
    return flat(one).join(flat(other).withColumnRenamed("candidate", "other_candidate"), ["word", "k"])


def save(tables: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Writes the three tables, unless they do not fit together."""
    v = validity(*tables).first()
    if not (v.tran_states_equal and v.emis_states_equal and v.tran_rows_full):
        raise ValueError("the model is not valid")
    for name, table in zip(("init", "tran", "emis"), tables, strict=True):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Model:
    return Model.collect(*(spark.read.parquet(f"{path}/{name}") for name in ("init", "tran", "emis")))
