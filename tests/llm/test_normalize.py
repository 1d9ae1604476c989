import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import normalize as N

SHY = "­"


@pytest.mark.parametrize(
    ("value", "form"),
    [
        ("Ｆｏｒ", "for"),
        ("bla\u030a", "bl\u00e5"),
        ("fro̸er", "frøer"),
        ("ﬆarken", "starken"),
        ("k‍nu‍e", "knue"),
        (" om  nu ", "om nu"),
        ("Ѕеin", "sein"),
        ("Νår", "når"),
        ("κριδος", "κριδοσ"),
        ("ɡrɑs", "gras"),
        ("\u212aløltederup", "kløltederup"),
        ("weiß", "weiss"),
        ("huſ", "hus"),
        ("føk－", "føk-"),
        (f"ti{SHY}me", "time"),
        ("", ""),
        ("   ", ""),
    ],
)
def test_forms(value, form):
    assert N.consistent_form(value) == form


@pytest.mark.parametrize("value", ["ｄｅｒ", "ﬁl", "\u212bt", "ma\u030althed", "o̸g", "a﻿s", "om ", "fyvn søelse", "оg", "Νår", "ɑt", "klas‑", "bre－", "kri‍δος", "ӏiԁ"])
def test_variants(value):
    assert N.has_variant(value)


@pytest.mark.parametrize("value", ["", "og", f"ti{SHY}", "gen⸗", "kæ¬", "huſ", "½", "m²", "4º", "№", "—", "„", "κριδος", "гридла", "шардо;", "Зембу", "δελ⸗", "weiß", "på", "0g", "Å"])
def test_no_variants(value):
    assert not N.has_variant(value)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12))
def test_the_form_is_stable_and_composed(value):
    form = N.consistent_form(value)
    assert N.consistent_form(form) == form
    assert unicodedata.normalize("NFKC", form) == form


def test_look_alikes_of_other_alphabets(spark):
    wide = N.look_alikes(spark)
    assert 200 < len(wide) < 5000
    for mixed, form in [("h\u0585lm", "holm"), ("\u13aaf", "af"), ("\u2c9fg", "og"), ("d\ua4d0", "db"), ("\u1d0fg", "og"), ("t\u0269l", "til"), ("p\u03b1a", "paa")]:
        assert N.consistent_form(mixed, wide) == form
        assert N.has_variant(mixed, wide)
        assert N.consistent_form(N.consistent_form(mixed, wide), wide) == form
    # words wholly in another alphabet stay, but for those whose letters all look exactly like Latin ones
    for kept in ["\u0585\u0578\u0582", "\u13aa\u13a0", "\u03b1\u03bd\u03b1", "κριδος", "гридла"]:
        assert not N.has_variant(kept, wide)


class Broken:
    """A gateway on which every call fails; or one on which the class is missing."""

    def __init__(self, spark=None):
        self.spark = spark

    def __getattr__(self, name):
        if name == "SpoofChecker" and self.spark:
            return self.spark.sparkContext._jvm.com.ibm.icu.text.no_such_package
        return self

    def __call__(self, *args):
        raise ConnectionError("gateway lost")


def test_a_failure_to_find_look_alikes_is_no_result(spark):
    with pytest.raises(ConnectionError):
        N.look_alikes(Broken())
    with pytest.raises(RuntimeError, match="ICU"):
        N.look_alikes(Broken(spark))


def test_the_plan_holds_the_normalisation(spark):
    plan = N.variant_tokens(rows(spark, [("d", 0, "оg", None, "", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "normalized_values" in plan


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2fff), max_size=8))
def test_a_settled_form_is_no_variant(value):
    """What normalisation leaves is no variant any more, unless it holds accents without a composed letter."""
    visible = N.visible_form(value).replace(" ", "")
    if not any(unicodedata.combining(c) for c in visible):
        assert not N.has_variant(visible)


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id string, doc_index int, original string, gold string, value string, form int")


def test_tokens(spark):
    found = N.variant_tokens(
        rows(spark, [("d", 0, "оg", None, "x", 1), ("d", 0, "og", "og", "x", 1), ("d", 0, "оg", "og", "x", 1), ("d", 1, None, "ｄer", None, None), (None, 2, "Ｘ", "", None, None), ("d", None, "ok", "ok", "", 1), ("e", 3, "x" * 200_000 + "Ａ", "y" * 100_000, "", 0)])
    ).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("d", 0, "original"), ("d", 1, "gold"), (None, 2, "original"), ("e", 3, "original")], key=str)


def test_empty(spark):
    assert N.variant_tokens(rows(spark, [])).count() == 0


def test_columns_agree_with_the_function(spark):
    values = ["Og", "Ｏg", "", None, "å", "ÅB", "a b", "ſ"]
    got = N.normalized(N.field_values(rows(spark, [("d", i, v, None, "", 0) for i, v in enumerate(values)]))).collect()
    assert {r.value: (r.form, r.variant) for r in got} == {v: (N.consistent_form(v), N.has_variant(v)) for v in values if v is not None}


def test_spellings_of_a_form(spark):
    got = N.form_table(rows(spark, [("d", 0, "og", None, "", 0), ("d", 1, "оg", None, "", 0), ("d", 2, "og", None, "", 0)])).collect()
    assert [tuple(r) for r in got] == [("original", "og", 2, 1, 3)]
