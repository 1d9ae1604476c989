"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Method: shortest-pack-first over the histogram of lengths. Lengths are placed longest first; the
copies of one length go to the open packing pattern with the most room (the shortest pack) that
they fit, many at a time, and only the pattern counts change. Two refinements keep the waste low:
a length that closes a pattern without any rest is placed there first, and a pattern is left open
only while the shortest length present still fits. The histogram has at most ``capacity`` entries
whatever the number of texts, so the patterns are made on the driver; they return to the texts by
rank: the r-th text of a length takes the r-th place the patterns hold for this length.

The rank is computed in two steps, counts per (length, bucket) and ranks inside buckets, so that a
length shared by a third of all texts is spread over ``BUCKETS`` windows.

Defined results: a text is divided only if it alone exceeds the capacity, into full pieces and one
rest. NULL and empty texts have no tokens and take no place. Ties are broken by ``doc_id`` and
piece number within a bucket.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.common import env_path, stage_table

TOKENIZER = env_path("SCRIPTORIUM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
BUCKETS = 64
# Fixed value: the usual pre-split pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a ``.tiktoken``, ``.json`` or ``.model`` file as a function text -> ids."""
    if path not in _ENCODERS:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.encode_special_tokens = True
            _ENCODERS[path] = lambda text: made.encode(text, add_special_tokens=False).ids
        else:
            import sentencepiece

            _ENCODERS[path] = sentencepiece.SentencePieceProcessor(model_file=path).encode
    return _ENCODERS[path]


#: Longer texts are tokenized in pieces cut before a blank, where no token of the pattern is divided.
PIECE = 1 << 16


def count_tokens(text: str, encode, divisible: bool = True) -> int:
    if len(text) <= PIECE or not divisible:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = end
            # a blank between two other characters starts a token of the pattern
            while cut < len(text) - 1 and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1].isspace()):
                cut += 1
            end = cut if cut < len(text) - 1 else len(text)
        total += len(encode(text[at:end]))
        at = end
    return total


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of every text; NULL and empty texts have 0."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, divisible = encoder(tokenizer), tokenizer.endswith(".tiktoken")
        for texts in parts:
            yield pd.Series([0 if t is None else count_tokens(t, encode, divisible) for t in texts], dtype="int64")

    return documents.select("doc_id", count("text").alias("n_tokens"))


# ---------------------------------------------------------------------------------------------
# Patterns


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ``(copies per length, number of containers)`` that hold the whole histogram.

    Work and result are bounded by the number of distinct lengths, not by the counts: a step either
    uses up a length or divides one open pattern into a part that took the length and a rest.
    """
    open_by_room: dict[int, list] = defaultdict(list)  # room left -> [(count, pattern)]
    rooms: list[int] = []  # heap of -room
    done: list[tuple[dict[int, int], int]] = []
    lengths = sorted((n for n, c in histogram.items() if c > 0), reverse=True)
    shortest = lengths[-1] if lengths else 0

    def put(pattern: dict[int, int], count: int, room: int) -> None:
        if room < shortest:
            done.append((pattern, count))
        else:
            if not open_by_room[room]:
                heappush(rooms, -room)
            open_by_room[room].append((count, pattern))

    def take(room: int) -> tuple[int, dict[int, int]]:
        return open_by_room[room].pop()

    for length in lengths:
        left = histogram[length]
        while left:
            room = 0
            if open_by_room.get(length):
                room = length  # closes a pattern without rest
            else:
                while rooms and not open_by_room[-rooms[0]]:
                    heappop(rooms)
                if rooms and -rooms[0] >= length:
                    room = -rooms[0]
            if not room:
                per = capacity // length
                if left >= per:
                    put({length: per}, left // per, capacity - per * length)
                    left %= per
                else:
                    put({length: left}, 1, capacity - left * length)
                    left = 0
                continue
            count, pattern = take(room)
            per = min(room // length, left)
            used = min(count, left // per)
            put({**pattern, length: pattern.get(length, 0) + per}, used, room - per * length)
            if count > used:
                if not open_by_room[room]:
                    heappush(rooms, -room)
                open_by_room[room].append((count - used, pattern))
            left -= per * used
    for entries in open_by_room.values():
        done.extend((pattern, count) for count, pattern in entries)
    return done


def place_table(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int]]:
    """``(length, first rank, first container, containers)``: the ranks of a length from the first
    on go round the containers of one pattern, as often as the pattern holds the length."""
    rows, base, next_rank = [], 0, defaultdict(int)
    for pattern, count in patterns:
        for length, copies in pattern.items():
            rows.append((length, next_rank[length], base, count))
            next_rank[length] += copies * count
        base += count
    return rows


# ---------------------------------------------------------------------------------------------
# Assignment


def pieces(counts: DataFrame, plans: DataFrame) -> DataFrame:
    """``(plan_id, capacity, doc_id, piece_no, length)``: one piece per text and plan, more only if
    the text alone exceeds the capacity. ``plans`` is a few rows (its size is checked)."""
    listed = [(r.plan_id, r.capacity_tokens) for r in plans.select("plan_id", "capacity_tokens").where("plan_id IS NOT NULL AND capacity_tokens > 0").distinct().limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("pack_plan has more than 1000 plans")
    if not listed:
        listed = [(0, 0)]
    plan = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("long").alias("capacity")) for p, c in listed]))
    last = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")
    return (
        counts.where("n_tokens > 0")
        .select("doc_id", "n_tokens", plan.alias("plan"))
        .select("plan.*", "doc_id", "n_tokens")
        .where("capacity > 0")
        .select("plan_id", "capacity", "doc_id", F.col("n_tokens"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
        .select("plan_id", "capacity", "doc_id", "piece_no", F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).cast("int").alias("length"))
    )


def pack(documents: DataFrame, plans: DataFrame, tokenizer: str = TOKENIZER, buckets: int = BUCKETS) -> DataFrame:
    """``(plan_id, container_id, doc_id, piece_no, tok_start, length)``: where every piece lies."""
    spark = documents.sparkSession
    counts = stage_table(token_counts(documents, tokenizer), "lengths")
    bucketed = pieces(counts, plans).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    sizes = stage_table(bucketed.groupBy("plan_id", "capacity", "length", "bucket").agg(F.count("*").alias("n")), "sizes")
    # At most capacity x plans rows, since a length never exceeds the capacity.
    histogram: dict = defaultdict(dict)
    for r in sizes.groupBy("plan_id", "capacity", "length").agg(F.sum("n").alias("n")).collect():
        histogram[r.plan_id, r.capacity][r.length] = r.n
    places: dict = {}
    for (plan_id, capacity), lengths in histogram.items():
        by_length: dict = defaultdict(list)
        for length, rank, base, count in place_table(pack_histogram(lengths, capacity)):
            by_length[length].append((rank, base, count))
        places[plan_id] = {n: np.array(rows, dtype="int64").T for n, rows in by_length.items()}
    shared = spark.sparkContext.broadcast(places)

    @F.pandas_udf("long")
    def container(plan_id: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(rank), dtype="int64")
        keys = pd.DataFrame({"p": plan_id.to_numpy(), "n": length.to_numpy()})
        for (p, n), at in keys.groupby(["p", "n"], sort=False).indices.items():
            first, base, count = shared.value[p][n]
            r = rank.to_numpy()[at]
            k = np.searchsorted(first, r, side="right") - 1
            out[at] = base[k] + (r - first[k]) % count[k]
        return pd.Series(out)

    before = Window.partitionBy("plan_id", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("plan_id", "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("plan_id", "length", "bucket").orderBy("doc_id", "piece_no")
    ranked = bucketed.withColumn("local", F.row_number().over(inside) - 1).join(offsets, ["plan_id", "length", "bucket"])
    return ranked.select(
        "plan_id",
        container("plan_id", "length", (F.col("local") + F.col("offset")).cast("long")).alias("container_id"),
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).cast("long").alias("tok_start"),
        "length",
    )


def fill_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan: containers, tokens, the fewest containers that could hold them, and unused room."""
    used = packed.groupBy("plan_id", "container_id").agg(F.sum("length").alias("used"))
    per_plan = used.groupBy("plan_id").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    caps = plans.select("plan_id", "capacity_tokens").distinct()
    return per_plan.join(caps, "plan_id").select(
        "plan_id",
        "capacity_tokens",
        "n_containers",
        "n_tokens",
        "fullest",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest"),
        F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )
