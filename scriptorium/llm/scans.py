"""Repairing text from scanned pages: furniture, broken words, misread characters, paragraphs.

Two averaged perceptrons are trained on the collection itself. One weighs page-position features of
a token (``pages``) and decides what is furniture; the other is a character editor (``editor``) that
predicts keep, replace, delete, insert and line-join for every character of a word. The editor works
on *units*, the distinct combinations of a word, the word that may continue it on the next line, and
the hyphen mark between; so the cost follows the distinct spellings, not the text.

What the editor sees of a word is counted over the whole collection: whether the dictionary holds
it, how often it occurs, how often correctors left or changed it, and its likeliest neighbour. The
neighbours come from an equi-join on spellings in which confusable characters are one, with at most
one character left out; the join is on distinct words and needs no broadcast.

Sequences are read in key ranges of ``2**RANGE_BITS`` tokens with ``HALO`` tokens of the neighbours,
so that a document of any size is spread over many tasks; nothing is held beyond one range.

Training uses at most ``TRAIN_TOKENS`` labelled tokens, chosen by hash; all counts use all rows.

Defined results: of repeated and older versions of a token the current one counts (greatest
``last_modified``, then ``loaded_at``); tokens with NULL key, NULL or empty ``original`` are no
cases; unknown positions are treated as in plain text; an empty table gives an empty result. Without
labelled tokens nothing is trained and no token is misread or broken.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.common import stage_table
from scriptorium.llm import editor as E
from scriptorium.llm import pages as P
from scriptorium.llm.normalize import visible_form

RANGE_BITS = 12
HALO = 384
TRAIN_TOKENS = 25_000
SALTS = 16
BROADCAST_UNITS, BROADCAST_BYTES = 400_000, 16 << 20
FREQUENT = 4
ROUNDS, SEEDS = 8, (7, 11)
NUMERAL = re.compile(r"^[0-9]+([.,/–-][0-9]+)*[º²½¼]?$")

MIXED = re.compile(r"[0-9][^\W\dº]|[^\W\dº][0-9]")

# ---------------------------------------------------------------------------------------------
# Reading the sequences


NEWEST = ["doc_id", "doc_index", "original", "gold", "hyphenated", "discarded", "page", "line", "last_modified", "loaded_at", "block"]
NEWEST_SCHEMA = "doc_id string, doc_index int, original string, gold string, hyphenated boolean, discarded boolean, page int, line int, last_modified timestamp_ntz, loaded_at timestamp_ntz, block int"


def newest_rows(tokens: DataFrame, bits: int, halo: int) -> DataFrame:
    """The rows of every key range and of its margins, with page and line taken from ``token_info``.

    Of the versions of a token that meet in one batch only the newest goes on, so that a token
    delivered very often is thinned out before any shuffle; the rest is decided where its range is
    read.
    """
    size = 1 << bits

    def number(info: pa.Array, pattern: str) -> pa.Array:
        return pc.cast(pc.struct_field(pc.extract_regex(info, pattern), "n"), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").dictionary_encode().indices.to_numpy().astype("int64")
            if len(np.unique((names << 32) | batch.column("doc_index").to_numpy())) < batch.num_rows:
                order = pc.sort_indices(pa.Table.from_batches([batch]), sort_keys=[(c, "ascending") for c in ("doc_id", "doc_index", "last_modified", "loaded_at", "gold")], null_placement="at_start")
                batch = batch.take(order)
                doc, index = batch.column("doc_id"), batch.column("doc_index")
                same = pc.and_(pc.equal(doc[1:], doc[:-1]), pc.equal(index[1:], index[:-1])).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(np.append(~same, True)))
            place = batch.column("doc_index").to_numpy()
            block, inside = place >> bits, place & (size - 1)
            before, after = np.flatnonzero((inside < halo) & (block > 0)), np.flatnonzero(inside >= size - halo)
            if len(before) or len(after):
                batch = batch.take(pa.array(np.concatenate([np.arange(batch.num_rows), before, after])))
                block = np.concatenate([block, block[before] - 1, block[after] + 1])
            info = batch.column("token_info")
            page = pc.coalesce(number(info, r"^\[\s*(?P<n>[0-9]{1,8})\s*,"), number(info, r'^\{.*"page":\s*(?P<n>[0-9]{1,8})'))
            line = pc.coalesce(number(info, r"^\[.*,\s*(?P<n>[0-9]{1,8})\s*,\s*[0-9]+\s*\]\s*$"), number(info, r'^\{.*"line":\s*(?P<n>[0-9]{1,8})'))
            columns = [batch.column(c) for c in ("doc_id", "doc_index", "original", "gold", "hyphenated", "discarded")]
            yield pa.RecordBatch.from_arrays([*columns, page, line, batch.column("last_modified"), batch.column("loaded_at"), pa.array(block, pa.int32())], names=NEWEST)

    kept = tokens.where("doc_id IS NOT NULL AND doc_index >= 0 AND original IS NOT NULL AND original <> ''").select(
        "doc_id", "doc_index", "original", "gold", "hyphenated", "discarded", "token_info", F.col("last_modified").cast("timestamp_ntz").alias("last_modified"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at")
    )
    return kept.mapInArrow(run, NEWEST_SCHEMA)


def in_ranges(tokens: DataFrame, bits: int = RANGE_BITS, halo: int = HALO) -> DataFrame:
    """The rows of every key range and of its margins, together and in order, the newest version of a
    token last. The order starts with a hash of the range, which compares faster than its name."""
    rows = newest_rows(tokens, bits, halo).repartition("doc_id", "block")
    return rows.sortWithinPartitions(F.xxhash64("doc_id", "block"), "doc_index", "last_modified", "loaded_at", "gold")


READ_SCHEMA = """doc_id string, doc_index int, code int, word string, next string, mark int, follow int, labelled boolean, gold_left string,
 gold_right string, gold_split boolean, bad_left boolean, bad_right boolean, discarded boolean, ends int, hint string, shown string, next_shown string"""
READ_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string())


def _spelling(text: str) -> tuple[str, int, str, str]:
    visible = visible_form(text)
    soft = P.SOFT in text
    marked = visible_form(text.replace(P.SOFT, "¬")) if soft else visible
    mark = P.mark_of_visible(marked)
    raw = P.bare_key(marked[:-1].replace("¬", "") if mark else visible)
    return visible or text, mark, raw, P.plain_case(raw)


class Spellings(dict):
    """Visible form, hyphen mark, key and key in plain case of a token; remembered, and emptied when large."""

    def __missing__(self, text: str) -> tuple[str, int, str, str]:
        if len(self) > 100_000:
            self.clear()
        r = _spelling(text)
        if len(text) <= 64:
            self[text] = r
        return r


# What a corrector made of a token, as the editor gets to see it: the kind, the word, and the word after.
ALONE, BESIDE, BROKEN, PARTS, UNKNOWN = "a", "b", "s", "\x1f", "\x1e"


def read_sequence(index: list, originals: list, golds: list, hyphenated: list, discarded: list, pages: list, lines: list, first: int, last: int, known: Spellings, with_text: bool = True) -> list[list]:
    """Measure one range, given as columns in order; gives back the columns of ``READ_SCHEMA`` after
    ``doc_id`` for the tokens with index in ``[first, last)``; the last two only ``with_text``."""
    texts, marks, raw, words = map(list, zip(*[known[t] for t in originals], strict=True))
    code = P.measure(texts, raw, pages, lines)
    follow = P.continuations(marks, code, hyphenated, pages, lines)
    low, high = bisect_left(index, first), bisect_left(index, last)
    size = high - low
    empty = [None] * size
    left, right, split, bad_left, bad_right, ends, behind, hints = list(empty), list(empty), list(empty), list(empty), list(empty), list(empty), [""] * size, [""] * size
    for i in range(low, high):
        k, j, gold = i - low, follow[i], golds[i]
        if j >= 0:
            behind[k] = words[j]
            # only a pair asks whether its first word ends a line
            if lines[i] is not None and lines[i + 1] is not None:
                ends[k] = int(lines[i] != lines[i + 1] or pages[i] != pages[i + 1])
        if gold:
            key, word = known[gold][3], words[i]
            left[k] = key
            if j < 0:
                bad_left[k] = key != word
                if bad_left[k]:
                    hints[k] = ALONE + key
                continue
            nxt = words[j]
            shy = gold.rstrip().endswith(P.SOFT)
            if not shy and golds[j] == "" and len(key) > len(word) + len(nxt) // 2:
                right[k], split[k] = "", True  # the whole word, to be held against word + next
                whole_right = key == word + nxt
                bad_left[k], bad_right[k] = not (whole_right or key.startswith(word)), not (whole_right or key.endswith(nxt))
                hints[k] = BROKEN + key
            else:
                split[k] = shy
                bad_left[k] = key != word
                if golds[j]:
                    right[k] = known[golds[j]][3]
                    bad_right[k] = right[k] != nxt
                if shy or bad_left[k] or bad_right[k]:
                    hints[k] = (BROKEN if shy else BESIDE) + key + PARTS + (right[k] or UNKNOWN)
    at = [index[j] if j >= 0 else -1 for j in follow[low:high]]
    shown, next_shown = (texts[low:high], [texts[j] if j >= 0 else None for j in follow[low:high]]) if with_text else (empty, empty)
    return [index[low:high], code[low:high], words[low:high], behind, marks[low:high], at, [bool(g) for g in golds[low:high]], left, right, split, bad_left, bad_right, discarded[low:high], ends, hints, shown, next_shown]


def listed(column: pa.Array) -> list:
    """The values of a column as Python ones; faster than ``to_pylist``."""
    if not pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count:
        return column.to_numpy().tolist()
    values = column.fill_null(0).to_numpy().astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def read_ranges(tokens: DataFrame, bits: int = RANGE_BITS, halo: int = HALO, with_text: bool = True) -> DataFrame:
    names = ["doc_index", "original", "gold", "hyphenated", "discarded", "page", "line"]
    out_names = [c.split()[0] for c in READ_SCHEMA.replace("\n", " ").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Spellings()
        held: list[list] = [[] for _ in names]
        key: tuple | None = None
        out: list[list] = [[] for _ in out_names]

        def finish() -> None:
            columns = held
            index = held[0]
            if len(set(index)) < len(index):  # versions of a token: the newest is the last
                keep = [i for i in range(len(index)) if i + 1 == len(index) or index[i] != index[i + 1]]
                columns = [[c[i] for i in keep] for c in held]
            first = key[1] << bits
            made = read_sequence(*columns, first, first + (1 << bits), known, with_text)
            out[0].extend([key[0]] * len(made[0]))
            for c, values in zip(out[1:], made, strict=True):
                c.extend(values)

        def pack() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, READ_TYPES, strict=True)], names=out_names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column("doc_id").dictionary_encode()
            codes, blocks = docs.indices.to_numpy(), batch.column("block").to_numpy()
            starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]).tolist()
            columns = [listed(batch.column(n)) for n in names]
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = (docs.dictionary[int(codes[a])].as_py(), int(blocks[a]))
                if here != key:
                    if key is not None:
                        finish()
                        if len(out[0]) >= 10_000:
                            yield pack()
                    held, key = [[] for _ in names], here
                for c, values in zip(held, columns, strict=True):
                    c.extend(values[a:b])
        if key is not None:
            finish()
        if out[0]:
            yield pack()

    return in_ranges(tokens, bits, halo).select("doc_id", "block", *names).mapInArrow(run, READ_SCHEMA)


# ---------------------------------------------------------------------------------------------
# The lexicon


def dictionary_keys(dict_words: DataFrame) -> DataFrame:
    """The distinct words of the dictionary in the compared form; JVM only, a few look-alikes aside."""
    word = F.translate(F.translate(F.lower(F.col("word")), "ſ", "s"), "­", "")
    return dict_words.where("word IS NOT NULL").select(F.btrim(word, F.lit(P.OUTER + " ")).alias("text")).where("text <> ''").distinct()


def whole(word: Column, nxt: Column) -> Column:
    return F.concat(word, nxt)


def word_counts(read: DataFrame) -> DataFrame:
    """``(text, n, n_same, n_changed, spread)`` of every word and of every joined form behind a mark."""
    alone = F.col("mark") == 0
    text = F.when(alone, F.col("word")).when(F.col("next") != "", whole(F.col("word"), F.col("next")))
    split = F.coalesce("gold_split", F.lit(False))
    same = F.when(alone, F.col("gold_left") == F.col("word")).otherwise(split & (F.col("gold_left") == text))
    return (
        read.select(F.lower(text).alias("text"), same.alias("same"), (alone & ~same & ~split).alias("changed"), F.xxhash64("doc_id").alias("doc"))
        .where("text <> ''")
        .groupBy("text")
        .agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.count_if("changed").alias("n_changed"), (F.min("doc") != F.max("doc")).alias("spread"))
    )


# Groups of characters a reader of scans confuses, the first standing for all.
GROUPS = ("oceaæøåäöéè0d", "irtfsslj1|!5", "nuvyü", "hkb6", "gqp9", "xz2", "b8", "m")
PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"))
CONFUSED = {ord(c): g[0] for g in reversed(GROUPS) for c in g}
NOISE = re.compile(r"[^\w]|_")


def rough(text: str) -> str:
    """A spelling in which confusable characters are one."""
    t = NOISE.sub("", text.lower()) or text
    for pair, one in PAIRS:
        t = t.replace(pair, one)
    return t.translate(CONFUSED)


def rough_variants(text: str) -> set[str]:
    """Spellings under which a word meets its readings: the rough one, for longer words with any one
    character left out, and for short ones the exact one with any one character left out."""
    t = rough(text)
    out = {t}
    if len(t) >= 6:
        out.update(t[:i] + t[i + 1 :] for i in range(len(t)))
    elif len(text) >= 3:
        out.add("=" + text)
        out.update("=" + text[:i] + text[i + 1 :] for i in range(len(text)))
    return out


def _variants(df: DataFrame, role: str) -> DataFrame:
    """``(variant hash, text, n)`` of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, t, n = [], [], []
            for text, count in zip(batch.column("text").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                for x in rough_variants(text):
                    v.append(x)
                    t.append(text)
                    n.append(count)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(t, pa.string()), pa.array(n, pa.int64())], names=["v", "t", "n"])

    return df.select("text", F.col("weight").cast("long").alias("weight")).mapInArrow(run, "v string, t string, n bigint").select(F.xxhash64("v").alias("v"), F.col("t").alias(role), F.col("n").alias(f"{role}_n"))


def unseen_pairs(units: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct joined forms of two words at a line end without mark that occur nowhere as a word."""
    joined = units.where("mark = 0 AND next <> ''").select(F.lower(whole(F.col("word"), F.col("next"))).alias("text")).distinct()
    return joined.join(words.select("text"), "text", "left_anti")


def neighbours(words: DataFrame, unseen: DataFrame) -> DataFrame:
    """``(text, near, near_n, near_dict, gap)``: the likeliest word a word outside the dictionary, or an
    ``unseen`` text, may stand for.

    ``words`` has ``text, n, n_changed, spread, in_dict``. Candidates are dictionary words and words
    at least ``FREQUENT`` times in more than one document; nearest first, then dictionary, then most frequent.
    """
    lexicon = words.where(F.col("in_dict") | ((F.col("n") >= FREQUENT) & F.col("spread") & (F.col("n_changed") * 4 <= F.col("n"))))
    base = lexicon.select("text", (F.col("n") * 2 + F.col("in_dict").cast("long")).alias("weight")).where("length(text) > 1")
    asked = words.where("NOT in_dict").select("text", F.col("n").alias("weight")).unionByName(unseen.select("text", F.lit(1).cast("long").alias("weight")))
    asked = asked.where("NOT text RLIKE '^[0-9.,/]+$' AND length(text) > 1")
    # The lexicon is the smaller side and spread by hash: it is held, not sorted.
    pairs = _variants(asked, "text").join(_variants(base, "near").hint("shuffle_hash"), "v").where("text <> near").select("text", "near", "text_n", "near_n")
    size = F.length("text")
    limit = F.when(size < 4, 1).when(size < 7, 2).when(size < 11, 3).otherwise(4)
    scored = pairs.withColumn("gap", F.levenshtein("text", "near")).where(F.col("gap") <= limit)
    in_dict = F.pmod("near_n", F.lit(2)) == 1
    # A word is no reading of one much rarer than itself, unless the dictionary holds that one.
    likely = scored.where(in_dict | (F.shiftright("near_n", 1) > F.col("text_n") * 2))
    order = F.struct((-F.col("gap")).alias("less"), in_dict.alias("near_dict"), F.shiftright("near_n", 1).alias("near_n"), "near")
    best = likely.groupBy("text").agg(F.max(order).alias("b"))
    return best.select("text", "b.near", "b.near_n", "b.near_dict", (-F.col("b.less")).alias("gap"))


# ---------------------------------------------------------------------------------------------
# Units and their features

UNIT = ("word", "next", "mark", "ends", "hint")


#: In place of what the lexicon holds of a neighbour: a corrector changed the word to it, or left it.
CORRECTED, LEFT = "G", "="


def bucket(n: int) -> int:
    return min(n, 4) if n <= 4 else min(3 + int(n).bit_length(), 12)


def known_of(text: str, n: int, same: int, changed: int, spread: bool, in_dict: bool) -> str:
    """A short description of what the lexicon holds of a word."""
    if in_dict:
        return "D"
    if NUMERAL.match(text):
        return "N"
    if P.ROMAN.match(text):
        return "R"
    if MIXED.search(text):
        return "M"
    seen = same + changed
    # What occurs often and was never corrected word by word is furniture, printed alike on every page.
    trust = ("?" if n < 6 else "2") if not seen else "0" if same * 4 <= seen else "1" if same * 4 < 3 * seen else "2" if seen < 4 else "3"
    return f"{trust}{bucket(n)}{'s' if spread else ''}"


def unit_item(u: dict, joined_form: bool, own_same: int = 0, own_changed: int = 0) -> E.Item:
    """A unit as the editor sees it, taken as one broken word or as its first word alone. ``own_*``
    is what a training token itself added to the counts of corrections, to be left out. Where a
    corrector changed the word, their reading stands in the place of the neighbour."""
    word, nxt, mark = u["word"], u["next"], u["mark"]
    left = known_of(word, u["l_n"] or 0, max(0, (u["l_same"] or 0) - own_same), max(0, (u["l_changed"] or 0) - own_changed), bool(u["l_spread"]), bool(u["l_dict"]))
    hint = u["hint"]
    if not joined_form:
        if hint and hint[0] != BROKEN:
            meant = hint[1:].split(PARTS)[0]
            return E.Item(word, 0, mark, left, meant, CORRECTED if meant != word else LEFT, "-")
        return E.Item(word, 0, mark, left, u["l_near"], near_of(u, "l"), "-")
    both = known_of(word + nxt, u["j_n"] or 0, max(0, (u["j_same"] or 0) - own_same), u["j_changed"] or 0, bool(u["j_spread"]), bool(u["j_dict"]))
    near, near_word = near_of(u, "j"), u["j_near"]
    right = known_of(nxt, u["r_n"] or 0, u["r_same"] or 0, u["r_changed"] or 0, bool(u["r_spread"]), bool(u["r_dict"]))
    common = lambda k: k == "D" or k[:1] in "23"
    joined = f"{'D' if both == 'D' else 'n' if near != '-' else 'o' if common(both) else '-'}{'K' if common(left) else '-'}{'K' if common(right) else '-'}{'c' if (u['r_n'] or 0) > 200 else '-'}{u['ends']}"
    if hint:
        meant, _, behind = hint[1:].partition(PARTS)
        if behind != UNKNOWN:
            near_word = meant + behind
            near = CORRECTED if near_word != word + nxt else LEFT
        elif meant != word:  # of the half not corrected the lexicon may know more
            near_word = near_word if near_word and near_word.startswith(meant) else meant + nxt
            near = CORRECTED
        joined = hint[0] if hint[0] == BROKEN else hint[0] + joined
    return E.Item(word + nxt, len(word), mark, both, near_word, near, joined)


def near_of(u: dict, side: str) -> str:
    """A short description of the neighbour of a word."""
    if u[f"{side}_near"] is None:
        return "-"
    return f"{'D' if u[f'{side}_near_dict'] else 'f'}{u[f'{side}_gap']}{min(6, bucket((u[f'{side}_near_n'] or 0) // max(1, u[f'{side}_n'] or 1)))}"


def unit_id(word: Column, nxt: Column, mark: Column, ends: Column, hint: Column) -> Column:
    return F.xxhash64(word, nxt, mark, ends, hint)


def single_id(word: Column, hint: Column) -> Column:
    """The id of a word without mark taken alone."""
    return unit_id(word, F.lit(""), F.lit(0), F.lit(None).cast("int"), hint)


def units_with_lexicon(units: DataFrame, words: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(known, plain)``: the units to be edited, joined with what is known of the word, of the word
    with its continuation, and of the continuation; and ``(uid, single)`` of the pairs that are not.

    Two words of a line end without mark are a pair only if their joined form is a word somewhere or
    has a neighbour; the others stand for their first word alone.
    """
    stats = stage_table(words.join(near, "text", "full_outer"), "lexicon")

    def side(prefix: str, with_near: bool) -> DataFrame:
        names = {"n": "n", "n_same": "same", "n_changed": "changed", "spread": "spread", "in_dict": "dict"} | ({"near": "near", "near_n": "near_n", "near_dict": "near_dict", "gap": "gap"} if with_near else {})
        return stats.select(F.col("text").alias(f"{prefix}_text"), *[F.col(k).alias(f"{prefix}_{v}") for k, v in names.items()])

    u = units.withColumns({"l_text": F.lower("word"), "j_text": F.when(F.col("next") != "", F.lower(whole(F.col("word"), F.col("next")))), "r_text": F.when(F.col("next") != "", F.lower("next"))})
    bare = u.where("mark = 0 AND next <> ''")
    known = stats.select(F.col("text").alias("j_text"))
    marked = F.startswith("hint", F.lit(BROKEN))
    matched = bare.where(~marked).join(known, "j_text", "left_semi").unionByName(bare.where(marked).select("j_text", *[c for c in u.columns if c != "j_text"]))
    plain = bare.where(~marked).join(known, "j_text", "left_anti").select("uid", single_id(F.col("word"), F.col("hint")).alias("single"))
    alone = u.where("mark > 0 AND next = ''").select("uid", *UNIT, "l_text")
    first = u.where("mark = 0").select(single_id(F.col("word"), F.col("hint")).alias("uid"), "word", F.lit("").alias("next"), F.lit(0).alias("mark"), F.lit(None).cast("int").alias("ends"), "hint", "l_text").distinct()
    single = alone.unionByName(first).join(side("l", True), "l_text", "left")
    double = u.where("mark > 0 AND next <> ''").unionByName(matched).select("uid", *UNIT, "l_text", "j_text", "r_text")
    double = double.join(side("j", True), "j_text", "left").join(side("l", True), "l_text", "left").join(side("r", False), "r_text", "left")
    return single.unionByName(double, allowMissingColumns=True).drop("l_text", "j_text", "r_text"), plain


def target_operations(text: str, split: int, row: dict) -> np.ndarray:
    """The operations the correction of a training token asks for."""
    if not split:
        return np.array(E.operations(text, row["gold_left"])[0])
    if row["gold_split"] and row["gold_right"] == "":
        ops, _ = E.operations(text, row["gold_left"])
    else:
        a, _ = E.operations(text[:split], row["gold_left"])
        b, _ = E.operations(text[split:], row["gold_right"] or text[split:])
        ops = a + b
    out = np.array(ops)
    if row["gold_split"]:
        out[split - 1] = E.JOIN
    return out


def practice() -> tuple[list[E.Item], list[np.ndarray]]:
    """Made-up corrections, so that the editor knows what a corrector's reading means before it has seen
    any, and in collections with hardly one: an operation in a word of random letters, a break."""
    rng = np.random.default_rng(5)
    letter = lambda: "abcdefghijklmnopqrstuvwxyzæøåäöü"[rng.integers(32)]
    items, targets = [], []
    for k in range(2400):
        size = int(rng.integers(2, 14))
        word = "".join(letter() for _ in range(size))
        at, op = int(rng.integers(size)), int(rng.integers(4))
        meant = word if op == E.KEEP else word[:at] + (letter() if op == E.REPLACE else letter() + word[at] if op == E.INSERT else "") + word[at + 1 :]
        known = "D" if k % 8 == 7 else f"{'?0123'[k % 5]}{int(rng.integers(1, 9))}{'s' * (k % 2)}"
        split = int(rng.integers(1, size)) if k % 3 == 0 and size > 2 else 0
        ops = np.array(E.operations(word, meant)[0])
        if split:
            ops[split - 1] = E.JOIN
        items.append(E.Item(word, split, k % 2 + k % 4 // 2 if split else 0, known, meant, CORRECTED if meant != word else LEFT, BROKEN if split else "-"))
        targets.append(ops)
    return items, targets


def train_editor(sample: list[dict], grams: np.ndarray, practised: bool = True) -> E.Editor | None:
    """The mean of the perceptrons of two orders of training, which moves the result less than one.

    Of a token a corrector changed the editor learns twice: without their reading, as other tokens come,
    and, for one in four, with it."""
    items, targets = practice() if practised else ([], [])
    pairs = []
    for n, r in enumerate(sample):
        split_gold = bool(r["gold_split"])
        same = int(r["gold_left"] == (r["word"] + r["next"] if split_gold and r["gold_right"] == "" else r["word"]))
        changed = (1 - same) * (not split_gold)
        for joined_form in {bool(r["next"]), split_gold}:
            for hint in {"", r["told"] if n % 16 == 0 else ""}:
                item = unit_item({**r, "hint": hint}, joined_form, own_same=same, own_changed=changed)
                if item.text:
                    items.append(item)
                    targets.append(target_operations(item.text, item.split, r))
        if not split_gold:
            pairs.append((r["word"], r["gold_left"]))
    if not items:
        return None
    x, ends = E.Featurizer(grams).features(items)
    data = [(x[end - len(t) : end], t) for t, end in zip(targets, ends.tolist(), strict=True)]
    return E.Editor(sum(E.train(data, ROUNDS, seed).weights for seed in SEEDS) / len(SEEDS), E.letters_brought(pairs))


def stands_cut(u: dict) -> bool:
    """Whether a mark alone shows a broken word whose other part was not recognised: a mark no word
    ends in, or a hyphen before something that is no word."""
    if u["mark"] != P.HYPHEN:
        return u["mark"] == P.SOFT_MARK
    return len(u["next"]) >= 4 and not trusted(known_of(u["next"], u["r_n"] or 0, u["r_same"] or 0, u["r_changed"] or 0, bool(u["r_spread"]), bool(u["r_dict"])))


def trusted(known: str) -> bool:
    return known == "D" or known[:1] in "23NR"


JOIN_ABOVE = 0.0
EDIT_SCHEMA = "uid bigint, cut boolean, joins boolean, m_join float, m_left float, m_right float, repaired string"


def edit_units(units: DataFrame, model: E.Editor | None, grams: np.ndarray) -> DataFrame:
    """``(uid, cut, joins, m_join, m_left, m_right, repaired)``: whether a unit begins with the first part
    of a broken word, whether it is one broken word, the margins by which its first and second half
    are misread, and its text after all operations."""
    if model is None:
        return units.select("uid").limit(0).select("uid", F.lit(False).alias("cut"), F.lit(False).alias("joins"), *[F.lit(0.0).cast("float").alias(c) for c in ("m_join", "m_left", "m_right")], F.lit("").alias("repaired"))
    shared = units.sparkSession.sparkContext.broadcast((model.weights, model.brings, grams))  # of fixed size, and of the size of the alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = E.Featurizer(shared.value[2]), E.Editor(*shared.value[:2])

        def scored(part: list[dict], joined_form: bool) -> Iterator[tuple[dict, np.ndarray, E.Item]]:
            items = [unit_item(r, joined_form) for r in part]
            x, ends = f.features(items)
            scores = m.scores(x)
            for r, item, end in zip(part, items, ends.tolist(), strict=True):
                yield r, scores[end - len(item.text) : end], item

        for batch in batches:
            rows = [dict(zip(batch.schema.names, r, strict=True)) for r in zip(*map(listed, batch.columns), strict=True)]
            for at in range(0, len(rows), 4000):
                part = rows[at : at + 4000]
                out = []
                pairs = [r for r in part if r["next"]]
                m_join: dict[int, float] = {}
                for r, s, item in scored(pairs, True):
                    split = item.split
                    join = float(s[split - 1, E.JOIN] - s[split - 1, E.KEEP])
                    m_join[r["uid"]] = join
                    if join <= JOIN_ABOVE:
                        continue
                    margin = s[:, 1:4].max(axis=1) - s[:, 0]
                    margin[split - 1] = min(margin[split - 1], s[split - 1, 1:4].max() - s[split - 1, E.JOIN])
                    out.append((r["uid"], True, True, join, float(margin[:split].max()), float(margin[split:].max()), m.edited(item.text, s, item.near)))
                alone = [r for r in part if m_join.get(r["uid"], -99.0) <= JOIN_ABOVE]
                distinct = {(r["word"], r["mark"], r["hint"]): r for r in alone}
                single = {}
                for r, s, item in scored(list(distinct.values()), False):
                    single[r["word"], r["mark"], r["hint"]] = (float((s[:, 1:4].max(axis=1) - s[:, 0]).max()), m.edited(item.text, s, item.near))
                for r in alone:
                    margin, text = single[r["word"], r["mark"], r["hint"]]
                    out.append((r["uid"], stands_cut(r), False, m_join.get(r["uid"], -99.0), margin, -99.0, text))
                types = (pa.int64(), pa.bool_(), pa.bool_(), pa.float32(), pa.float32(), pa.float32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in EDIT_SCHEMA.split(", ")])

    return units.mapInArrow(run, EDIT_SCHEMA)


# ---------------------------------------------------------------------------------------------
# Furniture


def train_furniture(counts: list[tuple[int, int, int]], rounds: int = 30) -> np.ndarray:
    """Averaged perceptron over position codes ``(code, rows discarded, rows corrected)``; pairs of
    bits are features too. Correctors discard some ordinary words and forget some furniture, so a
    code is taken for furniture if they discarded more than three in ten of its rows they handled."""
    w = np.zeros(P.BITS * (P.BITS + 1) // 2 + 1)
    total = np.zeros_like(w)
    step = 1
    for _ in range(rounds):
        for code, out, kept in sorted(counts):
            rate = out / max(1, out + kept)
            weight = min(1.0, (out + kept) / 20)
            want = 1 if rate > 0.3 else -1
            x = furniture_features(code)
            if want * (w[x].sum()) <= 0:
                w[x] += want * weight
                total[x] += want * weight * step
            step += 1
    return w - total / step


def furniture_features(code: int) -> list[int]:
    on = [i for i in range(P.BITS) if code >> i & 1]
    pairs = [P.BITS + 1 + i * (i - 1) // 2 + j for i in on for j in on if j < i]
    return [P.BITS, *on, *pairs]


def _special() -> Column:
    """Whether a corrector changed or broke the word."""
    return (F.col("gold_left") != F.col("word")) | F.coalesce("gold_split", F.lit(False))


def read_totals(read: DataFrame) -> list[dict]:
    """Per position code the rows discarded and corrected, and how many of those corrected are special or
    not; at most ``2**BITS`` rows whatever the input."""
    worded = F.col("labelled") & (F.col("word") != "")
    sums = {"gone": F.col("discarded") & ~F.col("labelled"), "kept": F.col("labelled"), "special": worded & _special(), "plain": worded & ~_special()}
    return [r.asDict() for r in read.groupBy("code").agg(*[F.count_if(c).alias(n) for n, c in sums.items()]).collect()]


def furniture_codes(totals: list[dict]) -> tuple[list[int], list[int]]:
    """The position codes of headers and of page numbers, by the model trained on all rows."""
    counts = [(r["code"], r["gone"], r["kept"]) for r in totals if r["code"]]
    w = train_furniture(counts)
    chosen = [c for c, _, _ in counts if w[furniture_features(c)].sum() > 0]
    return [c for c in chosen if not c & P.NUMERIC], [c for c in chosen if c & P.NUMERIC]


# ---------------------------------------------------------------------------------------------
# The whole


def _train_sample(read: DataFrame, totals: list[dict], bound: int) -> DataFrame:
    """At most about ``bound`` labelled tokens by hash: half of them changed or broken, as far as there are."""
    sizes = {True: sum(r["special"] for r in totals), False: sum(r["plain"] for r in totals)}
    special = min(sizes[True], bound // 2)
    share = {True: special, False: bound - special}
    limit = lambda k: min(1 << 20, (1 << 20) * share[k] // max(1, sizes[k]))
    draw = F.pmod(F.xxhash64("doc_id", "doc_index"), F.lit(1 << 20))
    return read.where("labelled AND word <> ''").where(draw < F.when(_special(), limit(True)).otherwise(limit(False)))


def letter_groups(words: DataFrame) -> np.ndarray:
    """How often every group of three characters occurs in the distinct words of the dictionary: all of
    them, in a sketch of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, n = np.unique(E.gram_slots(batch.column("text").to_pylist()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(n, pa.int64())], names=["slot", "n"])

    # at most GRAM_SLOTS rows
    counts = words.where("in_dict").select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    return E.gram_sketch(counts["slot"].to_numpy(), counts["n"].to_numpy())


def repaired_tokens(tokens: DataFrame, dict_words: DataFrame, train_tokens: int = TRAIN_TOKENS, with_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(read, edits, plain)``: the measured tokens with ``uid, is_header, is_pageno``, the edits per
    ``uid``, and the units that have those of another."""
    read = stage_table(read_ranges(tokens, with_text=with_text).withColumn("uid", unit_id(*map(F.col, UNIT))), "read")
    totals = read_totals(read)
    headers, numbers = furniture_codes(totals)
    among = lambda codes: F.col("code").isin(codes) if codes else F.lit(False)
    words = word_counts(read).join(dictionary_keys(dict_words).withColumn("in_dict", F.lit(True)), "text", "full_outer")
    words = stage_table(
        words.select("text", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_same", "n_changed")], F.coalesce("spread", F.lit(False)).alias("spread"), F.coalesce("in_dict", F.lit(False)).alias("in_dict")),
        "words",
    )
    # The sample is bounded by ``train_tokens``: it is sent to the units, not they to it. Its tokens are
    # looked up as they are without the corrector's reading.
    no_hint = F.lit("")
    bare_pair = (F.col("mark") == 0) & (F.col("next") != "") & ~F.coalesce("gold_split", F.lit(False))
    sample = stage_table(
        _train_sample(read, totals, train_tokens).select(
            *[c for c in UNIT if c != "hint"], no_hint.alias("hint"), F.col("hint").alias("told"), "gold_left", "gold_right", "gold_split",
            unit_id(*[F.col(c) if c != "hint" else no_hint for c in UNIT]).alias("uid"), F.when(bare_pair, single_id(F.col("word"), no_hint)).alias("single"),
        ),
        "sample",
    )
    units = stage_table(read.where("word <> ''").select("uid", *UNIT).unionByName(sample.select("uid", *UNIT)).distinct(), "distinct")
    known, plain = units_with_lexicon(units, words, neighbours(words, unseen_pairs(units, words)))
    known = stage_table(known, "units")
    labels = ("told", "gold_left", "gold_right", "gold_split")
    chosen = known.join(F.broadcast(sample.select("uid", *labels)), "uid").unionByName(known.join(F.broadcast(sample.where("single IS NOT NULL").select(F.col("single").alias("uid"), *labels)), "uid"))
    rows = [r.asDict() for r in chosen.orderBy(F.xxhash64("uid", "gold_left"), "uid", *labels).collect()]
    grams = letter_groups(words)
    edits = edit_units(known, train_editor(rows, grams), grams)
    return read.withColumns({"is_header": among(headers), "is_pageno": among(numbers)}), edits, plain


def for_all_units(edits: DataFrame, plain: DataFrame) -> DataFrame:
    """Edits of the pairs that stand for their first word alone, beside the others."""
    copies = edits.where("NOT cut").withColumnRenamed("uid", "single").join(plain, "single").drop("single")
    return edits.unionByName(copies)


def join_edits(rows: DataFrame, edits: DataFrame, how: str) -> DataFrame:
    """Tokens with the edits of their unit. Up to ``BROADCAST_UNITS`` edits of ``BROADCAST_BYTES`` of text,
    counted first, go to the tokens; more are joined by a shuffle in which a frequent unit is spread over
    ``SALTS`` tasks, and over more where Spark sees skew."""
    edits = stage_table(edits, "edits")
    text = F.octet_length("repaired") if "repaired" in edits.columns else F.lit(0)
    size = edits.agg(F.count("*").alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    if size.n <= BROADCAST_UNITS and size.bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(edits), "uid", how)
    salted = edits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("doc_index", F.lit(SALTS))).join(salted, ["uid", "salt"], how).drop("salt")


#: A page number, its label or ornaments as they are printed; anything else in their place is misread.
WELL_FORMED = r"^[—–\-]*([0-9]+|(?=.)(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})|" + "|".join(sorted(P.LABELS)) + r")?[—–\-]*$"

# Margins above which a word is misread: without correction, where a corrector left it, where one changed it.
EDIT_ABOVE, SAME_ABOVE, TOLD_ABOVE = -2.0, 8.0, -2.0


def noisy_tokens(tokens: DataFrame, dict_words: DataFrame, train_tokens: int = TRAIN_TOKENS) -> DataFrame:
    """``(doc_id, doc_index, kind)``: header, pageno, split, misread; a token once for each kind.

    Every word is judged by the editor, which sees what a corrector made of it, if one did; where one
    left it, it needs a wider margin. The second half of a broken word is judged as part of it, a page
    number by its form.
    """
    read, edits, plain = repaired_tokens(tokens, dict_words, train_tokens, with_text=False)
    edits = stage_table(edits.where(f"cut OR m_left > {EDIT_ABOVE}").drop("repaired", "m_join"), "edits")
    rows = read.where("word <> ''").select("doc_id", "doc_index", "uid", "follow", "bad_left", "bad_right", "is_pageno")
    hit = join_edits(rows, for_all_units(edits, plain), "inner")
    # Of a part whose other half was not recognised, little can be said from the lexicon.
    part = F.col("cut") & ~F.col("joins")
    limit = lambda bad: F.when(bad, F.lit(TOLD_ABOVE)).when(bad.isNull() & ~part, F.lit(EDIT_ABOVE)).otherwise(F.lit(SAME_ABOVE))
    judged = lambda bad, margin: F.col(margin) > limit(bad)
    joins = F.col("joins") & ~F.col("is_pageno")
    case = lambda index, kind, tail, holds: F.struct(index.alias("doc_index"), F.lit(kind).alias("kind"), F.lit(tail).alias("tail"), F.coalesce(holds, F.lit(False)).alias("holds"))
    cases = F.array(
        case(F.col("doc_index"), "misread", 0, judged(F.col("bad_left"), "m_left")),
        F.when(F.col("cut") & ~F.col("is_pageno"), case(F.col("doc_index"), "split", 0, F.lit(True))),
        F.when(joins | (part & (F.col("follow") >= 0)), case(F.col("follow"), "misread", 1, judged(F.col("bad_right"), "m_right"))),
    )
    number = F.when(F.col("is_pageno"), case(F.col("doc_index"), "misread", 2, ~F.lower("word").rlike(WELL_FORMED)))
    furniture = F.array_compact(F.array(number, F.when(F.col("is_header"), case(F.col("doc_index"), "header", 0, F.lit(True))), F.when(F.col("is_pageno"), case(F.col("doc_index"), "pageno", 0, F.lit(True)))))
    every = hit.select("doc_id", F.explode(F.array_compact(cases)).alias("c")).unionByName(read.where("is_header OR is_pageno").select("doc_id", F.explode(furniture).alias("c")))
    # The verdict on the second half of a broken word goes before that on the token alone.
    strength = F.col("c.tail") * 2 + F.col("c.holds").cast("int")
    return every.groupBy("doc_id", "c.doc_index", "c.kind").agg(F.max(strength).alias("s")).where("s % 2 = 1").select("doc_id", "doc_index", "kind")


def dressed(word: Column, first: Column, last: Column) -> Column:
    """A repaired word with the punctuation and capitals of the tokens it was read from."""
    lead = F.regexp_extract(first, r"^[^\p{L}\p{N}]*", 0)
    close = F.regexp_replace(F.regexp_extract(last, r"[^\p{L}\p{N}]*$", 0), "^[¬⸗=\\x{ad}-]+", "")
    letters = F.regexp_replace(first, r"[^\p{L}]", "")
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    cased = F.when((F.length(letters) > 1) & (letters == F.upper(letters)), F.upper(word)).when(letters.rlike(r"^\p{Lu}"), capital).otherwise(word)
    return F.concat(lead, cased, close)


def paragraphs(tokens: DataFrame, dict_words: DataFrame, train_tokens: int = TRAIN_TOKENS) -> DataFrame:
    """``(doc_id, first_index, n_tokens, text)``: the paragraphs of each document, in whole sentences,
    furniture removed, broken words joined and misread ones repaired.

    A corrector's reading of a word is used where there is one, and a word a corrector marked as broken
    is joined whatever the editor says. A paragraph ends at the end of a sentence, the first at or
    after each ``PARAGRAPH`` tokens of the sequence; so no document, however long, is put together in
    one value. Only a text without any end of a sentence in ``2**RANGE_BITS`` tokens is parted inside one.
    """
    read, edits, plain = repaired_tokens(tokens, dict_words, train_tokens)
    edits = stage_table(edits.where(f"joins OR m_left > {EDIT_ABOVE}"), "edits")
    rows = join_edits(read, for_all_units(edits, plain), "left")
    split = F.coalesce("gold_split", F.lit(False))
    joins = split | (F.coalesce("joins", F.lit(False)) & ~F.col("is_pageno"))
    # Of a half without correction the editor's reading counts where it agrees on the other half.
    agreed = F.when(F.col("joins") & F.startswith("repaired", "gold_left"), F.col("repaired")).otherwise(whole(F.col("gold_left"), F.col("next")))
    corrected = F.when(split, F.coalesce(whole(F.col("gold_left"), F.col("gold_right")), agreed))
    joined = dressed(F.coalesce(corrected, F.col("repaired")), F.col("shown"), F.col("next_shown"))
    by_hand = dressed(F.col("gold_left"), F.col("shown"), F.col("shown"))
    by_editor = dressed(F.col("repaired"), F.col("shown"), F.col("shown"))
    shown = (
        F.when(joins, joined)
        .when(F.col("bad_left"), by_hand)
        .when(~F.col("labelled") & (F.col("m_left") > EDIT_ABOVE) & (F.col("repaired") != F.col("word")), by_editor)
        .otherwise(F.col("shown"))
    )
    kept = rows.where("NOT is_header AND NOT is_pageno").select("doc_id", "doc_index", shown.alias("shown"), F.when(joins, F.col("follow")).alias("tail"))
    kept = stage_table(kept, "shown")
    tails = kept.where("tail IS NOT NULL").select("doc_id", F.col("tail").alias("doc_index")).distinct()
    words = kept.join(tails, ["doc_id", "doc_index"], "left_anti").select("doc_id", "doc_index", "shown")
    ordered = F.array_sort(F.collect_list(F.struct("doc_index", "shown")))
    return (
        with_paragraph(words)
        .groupBy("doc_id", "paragraph")
        .agg(F.min("doc_index").alias("first_index"), F.count("*").alias("n_tokens"), ordered.alias("w"))
        .select("doc_id", "first_index", "n_tokens", F.concat_ws(" ", F.transform("w", lambda x: x["shown"])).alias("text"))
    )


PARAGRAPH = 128
SENTENCE_END = r"[.!?…][)\]»“”\"'’]*$"


def with_paragraph(words: DataFrame) -> DataFrame:
    """Adds ``paragraph``, the index of the token that closes the paragraph (of its range, where none does).

    A token closes one if it ends a sentence and is the first to do so in its stretch of ``PARAGRAPH``
    indexes. The next closing token is looked for in the range of the token; where there is none, in a
    summary with one row per range: the first closing token of a later range, the next one only.
    """
    stretch = F.floor(F.col("doc_index") / PARAGRAPH)
    ends = F.col("shown").rlike(SENTENCE_END) & ~F.col("shown").rlike(r"^\p{L}{0,3}\.$")
    closing = words.where(ends).groupBy("doc_id", stretch.alias("stretch")).agg(F.min("doc_index").alias("close"))
    rng = F.shiftright("doc_index", RANGE_BITS)
    rows = words.withColumns({"stretch": stretch, "rng": rng}).join(closing, ["doc_id", "stretch"], "left")
    inside = Window.partitionBy("doc_id", "rng").orderBy("stretch").rangeBetween(1, Window.unboundedFollowing)
    over = Window.partitionBy("doc_id").orderBy("rng")
    first = closing.groupBy("doc_id", F.shiftright("close", RANGE_BITS).alias("rng")).agg(F.min("close").alias("first"))
    ranges = words.select("doc_id", rng.alias("rng")).distinct().join(first, ["doc_id", "rng"], "left").select("doc_id", "rng", F.lead("first").over(over).alias("later"))
    own = F.when(F.col("doc_index") <= F.col("close"), F.col("close"))
    behind = F.min("close").over(inside)
    last = (F.col("rng") + 1) * (1 << RANGE_BITS) - 1  # no sentence ends here nor in the next range
    return rows.withColumn("behind", behind).join(ranges, ["doc_id", "rng"]).withColumn("paragraph", F.coalesce(own, "behind", "later", last)).select(*words.columns, "paragraph")
