"""Evaluation passages inside training texts, whole or in part.

Method: size-partitioned MinHash containment search, verified by exact shingle containment. Sets are
shingles of ``SHINGLE`` consecutive words in a form that ignores case, punctuation, spacing, line
breaks, hyphens at line ends and Unicode variants. A long document would drown a short item, so it
is searched as windows of two blocks of ``BLOCK`` shingles: any passage of up to ``BLOCK + 1``
shingles lies whole in one window. Items are cut into queries of at most ``QUERY`` words and
partitioned by size; as in an LSH ensemble, each partition turns the containment to be found
(``NEEDED`` shingles, what a shortest passage with a misread word keeps) into a Jaccard bound, and
from it the number of one-row bands that reach ``RECALL``. The minima of all queries are a table, the
index. A window and a query that share a minimum are a candidate, found by a join; candidates with
``SHARED`` exact shingles in common go on, and their words are aligned: a case is ``MIN_WORDS``
consecutive words of the item, of which one in ten may be misread (look similar, or be divided). No
candidate is capped.

The corpus is read once, whatever the number of items. Of its windows only those go to the join that
have a minimum in a Bloom filter of the index, with the words around them, as far as the longest item
may reach. The filter has ``FILTER_BITS`` bits at most (8 MB); when it fills up more windows go to the
join, with the same result. Neither items nor candidates are ever collected.

Shingles of three words instead of five: a passage of 15 words with a misread one keeps at least
ten of 13 shingles of three, but possibly five of 11 of five.

Defined results: NULL or empty texts on either side give nothing; items of fewer than ``MIN_WORDS``
words give nothing; rows that share an id count as one document or item; NULL ids are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.common import stage_table
from scriptorium.llm.normalize import CYRILLIC, GREEK, IGNORABLE, LATIN, STROKED, STROKES

SHINGLE = 3
BLOCK = 16
QUERY = 48
STRIDE = 24
MIN_WORDS = 15
NEEDED = 10
SHARED = 6
RECALL = 1 - 1e-6
FILTER_BITS = 1 << 26
SLOTS = 3
MISREAD_SHARE = 0.1
ALIKE = 0.5
FURNITURE_WORDS = 8
BATCH_WORDS = 150_000

BROKEN = re.compile("[-­¬⸗‐‑－]+[ \t]*\r?\n\\s*")
MARKS = re.compile(r"[^\w\s]+|_")
ALIEN = {ord(k): v for k, v in {**GREEK, **CYRILLIC, **LATIN}.items()}
ALIEN_SEARCH = re.compile("[" + "".join(map(chr, ALIEN)) + "]")


def words_of(text: str) -> list[str]:
    """The words of a text in the form compared."""
    text = BROKEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", IGNORABLE.sub("", text))
        if STROKED.search(text):
            text = STROKED.sub(lambda m: STROKES[m[1]], text)
        if ALIEN_SEARCH.search(text):
            text = text.translate(ALIEN)
    return MARKS.sub("", text.casefold()).split()


class WordHash(dict):
    """32-bit hashes of words, remembered; the memory is emptied when it grows beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint32, count=len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of all runs of SHINGLE words."""
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    s = h[:n].astype(np.uint64)
    for k in range(1, SHINGLE):
        s = (s * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + n]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return (s >> np.uint64(32)).astype(np.uint32)


def bands_needed(query_shingles: int, window_shingles: int = 2 * BLOCK, needed: int = NEEDED, recall: float = RECALL) -> int:
    """How many one-row bands find a containment of ``needed`` shingles with the wanted recall."""
    jaccard = needed / (query_shingles + window_shingles - needed)
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard))


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def queries_of(words: list[str], hashes: WordHash) -> Iterator[np.ndarray]:
    """The shingle sets an item is searched by."""
    s = shingles(hashes.of(words))
    for at in range(0, max(1, len(words) - QUERY + STRIDE), STRIDE):
        part = np.unique(s[at : at + QUERY - SHINGLE + 1])
        if len(part):
            yield part


def bands_of(query_shingles: int) -> int:
    """Bands of the size partition of a query: powers of two of the number of shingles."""
    return bands_needed(1 << max(0, int(query_shingles - 1).bit_length()))


def index_keys(words: list[str], hashes: WordHash, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minima of all queries of an item, each with the number of its band in the upper half."""
    a, b = functions
    found = []
    for part in queries_of(words, hashes):
        n = bands_of(len(part))
        least = (part[None, :] * a[:n, None] + b[:n, None]).min(axis=1)
        found.append((np.arange(n, dtype=np.uint64) << np.uint64(32)) | least.astype(np.uint64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def filter_slots(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k``-th place of each key in a filter of ``bits`` bits, a power of two."""
    h = (keys + np.uint64((k + 1) * 0xD1342543DE82EF95 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)) & np.uint64(bits - 1)


def windows_of(docs: list[np.ndarray], present: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, list[int]]]:
    """``(document number, first block, keys)`` of the windows with minima in the filter ``present``."""
    padded, owner = [], []
    for d, s in enumerate(docs):
        if len(s):
            blocks = -(-len(s) // BLOCK)
            padded.append(np.concatenate([s, np.full(blocks * BLOCK - len(s), s[-1], dtype=np.uint32)]))
            owner.append(np.full(blocks, d))
    if not padded:
        return
    flat, doc_of = np.concatenate(padded), np.concatenate(owner)
    rows = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
    follows = np.append(doc_of[1:] == doc_of[:-1], False)
    at, keys = [], []
    for j, (a, b) in enumerate(zip(*functions, strict=True)):
        least = (rows * a + b).min(axis=0)
        after = np.append(least[1:], np.uint32(0xFFFFFFFF))
        least = np.where(follows, np.minimum(least, after), least).astype(np.uint64) | np.uint64(j << 32)
        hit = np.arange(len(least))
        for k in range(SLOTS):
            hit = hit[present[filter_slots(least[hit], len(present), k)]]
        at.append(hit)
        keys.append(least[hit])
    every, values = np.concatenate(at), np.concatenate(keys).view("int64")
    order = np.argsort(every, kind="stable")
    every, values = every[order], values[order]
    if not len(every):
        return
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    for low, high in zip(starts, [*starts[1:], len(every)], strict=True):
        w = int(every[low])
        d = int(doc_of[w])
        yield d, w - int(np.searchsorted(doc_of, d)), values[low:high].tolist()


def alike(x: str, y: str) -> bool:
    """Whether two stretches of letters may be readings of one another."""
    if x == y:
        return True
    longest = max(len(x), len(y))
    if longest <= 3:
        return bool(set(x) & set(y)) or longest == 1
    return SequenceMatcher(None, x, y, autojunk=False).ratio() >= ALIKE


def longest_passage(item: list[str], words: list[str]) -> int:
    """Most consecutive words of the item found in order in ``words``, misread ones included as long
    as they are one in ten (one is always allowed). Words of the document between two neighbouring
    words of the item, up to a line of page furniture, do not end the passage."""
    blocks = [b for b in SequenceMatcher(None, item, words, autojunk=False).get_matching_blocks() if b.size]
    best = 0
    chain: list[tuple[int, int, int]] = []  # (item from, item to, misread words before it)
    for n, b in enumerate(blocks):
        cost = None
        if n:
            p = blocks[n - 1]
            gap_i, gap_d = item[p.a + p.size : b.a], words[p.b + p.size : b.b]
            if not gap_i:
                cost = 0 if len(gap_d) <= FURNITURE_WORDS else None
            elif len(gap_d) <= 2 * len(gap_i) + FURNITURE_WORDS and len(gap_i) <= 4 and _gap_alike(gap_i, gap_d):
                cost = len(gap_i)
        if cost is None:
            chain = []
        chain.append((b.a, b.a + b.size, cost or 0))
        end_run = b.a + b.size
        misread = 0
        tail = _edge(item, words, end_run, b.b + b.size, 1)
        for k in range(len(chain) - 1, -1, -1):
            start = chain[k][0]
            head_block = blocks[n - (len(chain) - 1 - k)]
            head = _edge(item, words, head_block.a - 1, head_block.b - 1, -1)
            for extra in {0, head} | {tail, head + tail}:
                size = end_run - start + extra
                if misread + extra <= max(1, int(size * MISREAD_SHARE)):
                    best = max(best, size)
            misread += chain[k][2]
    return best


def _gap_alike(gap_i: list[str], gap_d: list[str]) -> bool:
    """Whether the words between two matching runs may be misread: one for one, or similar letters."""
    return bool(gap_d) and (len(gap_i) == len(gap_d) == 1 or alike("".join(gap_i), "".join(gap_d)))


def _edge(item: list[str], words: list[str], i: int, d: int, step: int) -> int:
    """1 if the word next to a matching run is a misread form of the item's word there."""
    return int(0 <= i < len(item) and 0 <= d < len(words) and alike(item[i], words[d]))


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id, words, n)`` of the items long enough to hold a passage; words parted by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([" ".join(w) for w in words], pa.string()), pa.array([len(w) for w in words], pa.int32())], names=["item_id", "words", "n"])

    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return known.mapInArrow(run, "item_id bigint, words string, n int").where(F.col("n") >= MIN_WORDS)


def index_of(items: DataFrame, functions: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The index ``(key, item_id)`` of ``item_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                keys = index_keys(words.split(" "), hashes, functions).view("int64")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), item, dtype="int64"))], names=["key", "item_id"])

    return items.mapInArrow(run, "key bigint, item_id bigint").distinct()


def filter_of(index: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys: at least 128 bits for each, ``FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, 1 << (128 * index.count()).bit_length())
    bits = max(64, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            keys = batch.column("key").to_numpy().view("uint64")
            for k in range(SLOTS):
                slots = filter_slots(keys, bits, k)
                np.bitwise_or.at(mine, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
        used = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), pa.array(mine[used].view("int64"))], names=["word", "bits"])

    # at most FILTER_BITS / 64 rows, however many the keys
    parts = index.select("key").mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[parts["word"].to_numpy()] = parts["bits"].to_numpy().astype("int64").view("uint64")
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


HIT_SCHEMA = "doc_id bigint, place int, keys array<bigint>, inside int, words string"


def matching_windows(documents: DataFrame, packed: np.ndarray, functions: tuple[np.ndarray, np.ndarray], margin: int) -> DataFrame:
    """``(doc_id, place, keys, inside, words)``: the windows with minima in the filter, with ``margin`` words
    around; ``place`` is the window's first word in the document, ``inside`` that in ``words``."""
    shared = documents.sparkSession.sparkContext.broadcast(packed)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, present = WordHash(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                words, size, end = [], 0, at
                while end < len(texts) and size < BATCH_WORDS:
                    words.append(words_of(texts[end]))
                    size += len(words[-1])
                    end += 1
                out: list[list] = [[], [], [], [], []]
                for d, block, keys in windows_of([shingles(hashes.of(w)) for w in words], present, functions):
                    place = block * BLOCK
                    low = max(0, place - margin)
                    around = words[d][low : place + 2 * BLOCK + SHINGLE + margin]
                    for column, value in zip(out, (ids[at + d], place, keys, place - low, " ".join(around)), strict=True):
                        column.append(value)
                if out[0]:
                    types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "place", "keys", "inside", "words"])
                at = end

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return texts.mapInArrow(run, HIT_SCHEMA)


def verified(candidates: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_words)`` of the candidates ``(doc_id, item_id, item, inside, words)`` that hold
    a passage: exact shingle containment in the window first, then the alignment of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, item_id, item, inside, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "item", "inside", "words")), strict=True):
                item_list, around = item.split(" "), words.split(" ")
                s = known.get(item)
                if s is None:
                    if len(known) > 10_000:
                        known.clear()
                    s = known[item] = np.unique(shingles(hashes.of(item_list)))
                window = np.unique(shingles(hashes.of(around[inside : inside + 2 * BLOCK + SHINGLE - 1])))
                if np.isin(window, s, assume_unique=True).sum() < SHARED:
                    continue
                best = longest_passage(item_list, around)
                if best >= MIN_WORDS:
                    for column, value in zip(out, (doc, item_id, best), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "n_words"])

    return candidates.select("doc_id", "item_id", "item", "inside", "words").mapInArrow(run, "doc_id bigint, item_id bigint, n_words int")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_words)`` of every document that holds a passage of an item."""
    queries = stage_table(item_words(items), "items")
    longest = queries.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    functions = hash_functions(bands_of(max(1, min(longest, QUERY) - SHINGLE + 1)))
    index = stage_table(index_of(queries, functions), "index")
    margin = longest + FURNITURE_WORDS + 2 * BLOCK
    hits = stage_table(matching_windows(documents, filter_of(index), functions, margin), "windows")
    pairs = hits.select("doc_id", "place", F.explode("keys").alias("key")).join(index, "key").select("doc_id", "place", "item_id").distinct()
    candidates = pairs.join(hits.select("doc_id", "place", "inside", "words"), ["doc_id", "place"]).join(queries.select("item_id", F.col("words").alias("item")), "item_id")
    return verified(candidates).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: in how many documents it leaked and the longest passage; 0 for clean items."""
    counts = found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))
    return items.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))
