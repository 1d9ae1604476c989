"""One consistent form for text that looks the same but is stored with different characters.

Method: compatibility normalisation in composed form (NFKC), full case folding, white space mapped
to one blank and default-ignorable characters removed, computed once per distinct value of an Arrow
batch (repeated values are looked up). Beyond NFKC, overlaid strokes are composed and letters of
other alphabets that look like Latin ones are mapped. In a word that also has Latin letters every
letter counts that the Unicode data of confusable characters give for a Latin one (``look_alikes``);
a word wholly in another alphabet is mapped only if all its letters look exactly like Latin ones.

A value is a *variant*, as problem 1 reports it, if normalising it changes more than may be changed:
if its ``visible_form`` without blanks is not its ``settled_form``, which is the value itself without
the signs that look different anyway (soft hyphen, long s, fractions, superscripts, ordinal and
number signs), folded as NFKC does, and without accents stored apart from their letter. So both the
form and the verdict come from the same normalisation, computed together.

Defined results: NULL stays NULL and is no variant; '' stays ''; a value of blanks only becomes ''
and is a variant. The form is idempotent. Texts are processed whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from py4j.java_gateway import JavaPackage
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that look like a Latin letter in usual type, by alphabet.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov", strict=True))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԚԜӀаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXQWIaesijopcyxhdqwl", strict=True))
LATIN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ȷ": "j"}
HYPHENS = {"‐": "-", "‑": "-", "⁃": "-", "˗": "-"}
STROKES = {"o": "ø", "O": "Ø", "d": "đ", "D": "Đ", "l": "ł", "L": "Ł", "h": "ħ", "H": "Ħ", "t": "ŧ", "T": "Ŧ"}
STROKE_MARKS = "̵̶̷̸"
SOFT_HYPHEN = "­"

IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
BLANKS = regex.compile(r"[\s\p{Z}\x1c-\x1f]+")
STROKED = re.compile(f"([oOdDlLhHtT])[{STROKE_MARKS}]")
FOREIGN = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
WORD = regex.compile(r"[\p{L}\p{M}]+")
LIGATURES = range(0xFB00, 0xFB07)
ASCII_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
NONE: dict[str, str] = {}
PLAIN = "^[\\x21-\\x7e]*$"


SCRIPTS = [(regex.compile(r"\p{Greek}"), GREEK), (regex.compile(r"\p{Cyrillic}"), CYRILLIC)]


LATIN_LETTER = regex.compile(r"\p{Latin}")
OTHER = regex.compile(r"[^\P{L}\p{Latin}\p{Greek}\p{Cyrillic}]")


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """The letters that Unicode's data of confusable characters give for an ASCII letter, from the ICU
    library Spark brings: those with the same skeleton, capitals for capitals. Some hundred entries,
    whatever the data. Where the library is missing or fails that is an error: with fewer look-alikes the
    result would be smaller, and look whole."""
    letters = [c for c in map(chr, [*range(0x250, 0x3400), *range(0xA000, 0xAC00), *range(0xFB00, 0xFE00), *range(0x10000, 0x1F000)]) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c) == c]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker
    if isinstance(checker, JavaPackage):
        raise RuntimeError("look-alikes need ICU (icu4j, com.ibm.icu.text.SpoofChecker) among the jars of Spark")
    skeletons = checker.Builder().build().getSkeleton("\n".join([*ASCII_LETTERS, *letters])).split("\n")
    known: dict[str, list[str]] = {}
    for c, skeleton in zip(ASCII_LETTERS, skeletons, strict=False):
        known.setdefault(skeleton, []).append(c)
    out = {}
    for c, skeleton in zip(letters, skeletons[len(ASCII_LETTERS) :], strict=True):
        options = known.get(skeleton)
        if options:
            upper = unicodedata.category(c) == "Lu"
            out[c] = next((o for o in options if o.isupper() == upper), options[0])
    return out


def map_look_alikes(text: str, wide: dict[str, str] = NONE) -> str:
    """Latin letters for look-alikes, word by word; words truly in another alphabet stay. ``wide`` are the
    look-alikes that count beside Latin letters."""
    if FOREIGN.search(text) or (wide and OTHER.search(text)):

        def word(match: regex.Match) -> str:
            w = match.group()
            beside = wide if wide and LATIN_LETTER.search(w) else NONE
            for script, table in SCRIPTS:
                letters = script.findall(w)
                if letters and all(c in table or c in beside for c in letters):
                    w = "".join(table.get(c) or beside[c] if script.match(c) else c for c in w)
            return "".join(beside.get(c, c) if OTHER.match(c) else c for c in w) if beside else w

        text = WORD.sub(word, text)
    if wide:
        text = "".join(wide.get(c, c) if c > "\u024f" and LATIN_LETTER.match(c) else c for c in text)
    return text.translate(_SINGLE)


_SINGLE = {ord(k): v for k, v in {**LATIN, **HYPHENS}.items()}


#: Characters that are their own visible form.
SETTLED = re.compile("[!-~À-ÖØ-öø-ÿ–—]+")


def visible_form(text: str, wide: dict[str, str] = NONE) -> str:
    """The text with variants replaced by the usual characters, its case kept."""
    if SETTLED.fullmatch(text):
        return text
    if text.isascii():
        return BLANKS.sub(" ", text).strip(" ")
    text = IGNORABLE.sub("", text)
    text = map_look_alikes(text, wide)
    text = unicodedata.normalize("NFKC", text)
    text = STROKED.sub(lambda m: STROKES[m[1]], text)
    text = map_look_alikes(text, wide)
    return BLANKS.sub(" ", text).strip(" ")


def consistent_form(text: str, wide: dict[str, str] = NONE) -> str:
    """The one form under which look-alike texts are equal: ``visible_form`` with case folded."""
    return folded(visible_form(text, wide))


def folded(visible: str) -> str:
    text = unicodedata.normalize("NFKC", visible.casefold())
    return BLANKS.sub(" ", unicodedata.normalize("NFKC", text.casefold())).strip(" ")


@lru_cache(maxsize=4096)
def is_variant_character(c: str) -> bool:
    """Whether one character, seen alone, is a presentation, width or look-alike variant."""
    if c in HYPHENS or c in LATIN or ord(c) in LIGATURES:
        return True
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<circle>", "<square>"):
        return True
    if kind == "<compat>":  # letters put together from usual letters, but not long s or number signs
        return c != "ſ" and unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c).isalpha()
    return bool(kind) and kind[0] != "<" and " " not in unicodedata.decomposition(c)  # another code for the same letter


@lru_cache(maxsize=4096)
def settled(c: str) -> str:
    """What one character contributes to the settled form."""
    if c == SOFT_HYPHEN or unicodedata.combining(c):
        return ""
    if c <= "\x7f" or is_variant_character(c) or BLANKS.match(c):
        return c
    return BLANKS.sub("", unicodedata.normalize("NFKC", c))


def settled_form(text: str) -> str:
    """The value with only that folded that is no variant: see the head of the module."""
    return "".join(map(settled, text))


def normalize(text: str, wide: dict[str, str] = NONE) -> tuple[str, bool]:
    """The consistent form of a value, and whether the value is a variant."""
    visible = visible_form(text, wide)
    return folded(visible), BLANKS.sub("", visible) != settled_form(text)


def has_variant(text: str, wide: dict[str, str] = NONE) -> bool:
    """Whether a value holds a case of problem 1."""
    return normalize(text, wide)[1]


def normalizer(wide: dict[str, str]) -> Callable[[Column], Column]:
    """The vectorised normalisation ``value -> (form, variant)``, once per distinct value of a batch."""

    @F.pandas_udf("form string, variant boolean")
    def normalized_values(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str, bool]] = {}
        for values in parts:
            codes, distinct = pd.factorize(values)
            out = []
            for v in distinct:
                r = seen.get(v) or normalize(v, wide)
                if len(v) <= 64:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen[v] = r
                out.append(r)
            forms, verdicts = (np.array([*(r[k] for r in out), None], dtype=object) for k in (0, 1))
            yield pd.DataFrame({"form": forms[codes], "variant": verdicts[codes]})

    return normalized_values


def field_values(tokens: DataFrame, fields: tuple[str, ...] = ("original", "gold")) -> DataFrame:
    """Rows ``(doc_id, doc_index, field_name, value)`` of all fields that are not NULL."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    return tokens.select("doc_id", "doc_index", F.explode(pairs).alias("p")).select("doc_id", "doc_index", "p.*").where("value IS NOT NULL")


def normalized(rows: DataFrame) -> DataFrame:
    """Adds ``form`` and ``variant`` to rows with a ``value``; plain ASCII without blanks, its own form but
    for the case, never leaves the JVM."""
    plain = F.col("value").rlike(PLAIN)
    n = normalizer(look_alikes(rows.sparkSession))(F.when(~plain, F.col("value")))
    form = F.when(F.col("value").isNull(), F.lit(None)).when(plain, F.lower("value")).otherwise(F.col("__normal.form"))
    return rows.withColumn("__normal", n).select(*rows.columns, form.alias("form"), F.coalesce("__normal.variant", F.lit(False)).alias("variant"))


def variant_tokens(tokens: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, doc_index, field_name)`` where the value of at least one row is a variant."""
    return normalized(field_values(tokens)).where("variant").select("doc_id", "doc_index", "field_name").distinct()


def form_table(tokens: DataFrame) -> DataFrame:
    """Each distinct consistent form with the number of spellings it unites, of those that are variants, and of its rows."""
    rows = field_values(tokens).groupBy("field_name", "value").agg(F.count("*").alias("n"))
    return normalized(rows).groupBy("field_name", "form").agg(F.count("*").alias("n_spellings"), F.count_if("variant").alias("n_variants"), F.sum("n").alias("n_rows"))
