import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import tokens as T
from scriptorium.plans import prepare

SHY = "­"
SCHEMA = "doc_id string, doc_index int, original string, gold string, is_hyphenated boolean, is_discarded boolean, has_error boolean, heuristic string, bin int, selection string, last_modified timestamp"


def tokens(spark, text, doc="d", **flags):
    rows = []
    for i, w in enumerate(text.split(" ")):
        f = {k: v.get(i) for k, v in flags.items()}
        rows.append((doc, i, w, f.get("gold"), bool(f.get("hyphenated")), bool(f.get("discarded")), bool(f.get("error")), f.get("heuristic"), None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return " ".join(r.text for r in T.render(df).orderBy("piece").collect())


@pytest.mark.parametrize(
    ("text", "rendered"),
    [("Str- ing Te-st", "String Te-st"), (f"Str{SHY} ing Te{SHY}st", f"String Te{SHY}st"), ("Str-", "Str-")],
)
def test_dehyphenation(spark, text, rendered):
    t = tokens(spark, text)
    d = T.dehyphenate(t)
    assert shown(t.drop("is_hyphenated", "gold").join(d.select("doc_id", "doc_index", "is_hyphenated", "gold"), ["doc_id", "doc_index"])) == rendered


@pytest.mark.parametrize("seed", range(3))
def test_pairing_is_greedy_and_crosses_ranges(spark, monkeypatch, seed):
    monkeypatch.setattr(T, "RANGE_BITS", 2)
    rnd = random.Random(seed)
    rows = [(d, i * rnd.choice([1, 1, 3]) + i * 3, rnd.random() < 0.7) for d in "abc" for i in range(60)]
    rows = sorted({(d, i): e for d, i, e in rows}.items())
    df = spark.createDataFrame([(d, i, e) for (d, i), e in rows], "doc_id string, doc_index int, e boolean")
    got = {(r.doc_id, r.doc_index): (r.head, r.consumed, r.next_doc_index) for r in T.with_pairs(df, F.col("e"), ["doc_index"]).collect()}
    want, last = {}, None
    for k, ((d, i), e) in enumerate(rows):
        same = last is not None and last[0] == d
        consumed = same and want[last][0]
        following = rows[k + 1][0] if k + 1 < len(rows) and rows[k + 1][0][0] == d else None
        want[d, i] = (e and not consumed, consumed, following[1] if following else None)
        last = (d, i)
    assert got == want


def test_neighbours_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE_BITS", 1)
    df = spark.createDataFrame([("d", i, f"w{i}") for i in (0, 1, 2, 9, 10, 31)], "doc_id string, doc_index int, original string")
    got = T.with_neighbours(df, ["original"], ["original"]).orderBy("doc_index").collect()
    assert [(r.prev_original, r.original, r.next_original) for r in got] == list(zip([None, "w0", "w1", "w2", "w9", "w10"], ["w0", "w1", "w2", "w9", "w10", "w31"], ["w1", "w2", "w9", "w10", "w31", None], strict=True))


def test_context_counts_places_not_indexes(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE_BITS", 4)
    df = spark.createDataFrame([("d", i * i, f"w{i}") for i in range(100)], "doc_id string, doc_index int, original string")
    got = T.context(df, F.lit(True)).orderBy("doc_index").collect()
    words = [f"w{i}" for i in range(100)]
    assert [(r.left_context, r.right_context) for r in got] == [(" ".join(words[max(0, i - 7) : i]), " ".join(words[i + 1 : i + 8])) for i in range(100)]


def test_consolidated(spark):
    t = tokens(spark, f"Once upen a ti{SHY} me gone ti-", hyphenated={3: 1, 6: 1}, discarded={5: 1}, gold={3: "ti", 4: "me"})
    got = [(r.doc_index, r.original, r.gold) for r in T.consolidated(t).orderBy("doc_index").collect()]
    assert got == [(0, "Once", None), (1, "upen", None), (2, "a", None), (3, f"ti{SHY}me", "time"), (6, "ti--", None)]


def test_stats(spark):
    t = tokens(spark, f"Once upen a ti{SHY} me", hyphenated={3: 1}, gold={0: "Once"}, heuristic={0: "original", 1: "annotator"})
    s = T.doc_stats(t).collect()[0]
    assert (s.index_count, s.token_count, s.corrected_count, s.corrected_by_model_count, s.hyphenated_count, s.done) == (5, 4, 1, 1, 1, False)
    v = T.validate_stats(T.doc_stats(t)).collect()[0]
    assert (v.parts_add_up, v.tokens_add_up, v.rows_add_up) == (True, True, True)


def test_latest_takes_whole_rows(spark, at):
    rows = [("d", 0, "x", at(1), at(5)), ("d", 0, "y", None, at(9)), ("d", 0, "z", at(1), at(6)), ("e", 0, None, None, None)]
    got = T.latest(spark.createDataFrame(rows, "doc_id string, doc_index int, v string, last_modified timestamp, loaded_at timestamp"), ["doc_id", "doc_index"], ["last_modified", "loaded_at"]).collect()
    assert {(r.doc_id, r.v) for r in got} == {("d", "z"), ("e", None)}


@pytest.mark.parametrize(("word", "cleaned"), [("(wo-rd)", "word"), (f"»wo{SHY}rd«", "word"), (" word ", "word"), ("", ""), (".", ""), ("wo!rd", "wo!rd"), ("A4", "A4")])
def test_clean(spark, word, cleaned):
    assert spark.range(1).select(X.clean(F.lit(word))).first()[0] == cleaned


@pytest.mark.parametrize(("word", "hyphen", "punctuation"), [("abc-", True, False), (f"Politi{SHY}", True, False), ("abc-def", False, False), ("Nørreherred", False, False), ("»–§", False, True), ("$+", False, False), ("–", False, True)])
def test_classes(spark, word, hyphen, punctuation):
    w = F.lit(word)
    assert tuple(spark.range(1).select(X.ends_in_hyphen(w), X.is_punctuation(w)).first()) == (hyphen, punctuation)


def test_tokenize_splits_at_all_white_space(spark):
    df = spark.createDataFrame([(1, "a b c\x1cd\n\ne "), (2, None), (3, ""), (4, "  ")], "doc_id long, text string")
    assert [(r.doc_index, r.original) for r in T.tokenize(df).orderBy("doc_index").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]


def test_crop(spark):
    rows = [("d", i, 1, 50 + 10 * (i % 10), 60 + 10 * (i % 10)) for i in range(200)] + [("d", 900, 1, 1, 4)]
    found = spark.createDataFrame(rows, "doc_id string, doc_index int, page int, x0 int, x1 int")
    edges = T.crop_edges(found)
    e = edges.first()
    assert 4 <= e.left_edge <= 50
    assert [r.doc_index for r in T.outside_edges(found, edges).collect()] == [900]


def test_written_form(spark):
    assert spark.range(1).select(T.text_sink_form(F.lit("Corrected: No _NEWLINE_N_ a"))).first()[0] == "Corrected: Yes\na"


def test_renumbering(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE_BITS", 2)
    df = spark.createDataFrame([("d", i * 1.5, f"w{i}") for i in range(20)] + [("e", 7.0, "x")], "doc_id string, doc_index double, original string")
    got = sorted((r.doc_id, r.doc_index, r.original) for r in T.renumbered(df).collect())
    assert got == sorted([("d", i, f"w{i}") for i in range(20)] + [("e", 0, "x")])


def test_given_edges(spark):
    found = spark.createDataFrame([("d", 0, 1, 10, 20), ("d", 1, 1, 30, 40), ("d", 2, 1, 90, 99)], "doc_id string, doc_index int, page int, x0 int, x1 int")
    out = lambda **k: sorted(r.doc_index for r in T.outside_edges(found, T.edges_or(found, **k)).collect())
    assert out(left=25) == [0]
    assert out(right=80) == [2]
    assert out(left=25, right=80) == [0, 2]


def test_cropping_empties_the_gold(spark):
    t = tokens(spark, "a b", gold={0: "a", 1: "b"})
    got = T.cropped(t, spark.createDataFrame([("d", 1, 1)], "doc_id string, doc_index int, page int")).orderBy("doc_index").collect()
    assert [(r.gold, r.is_discarded) for r in got] == [("a", False), ("", True)]


def test_records_round_trip(spark, at):
    row = ("d", 1, 'a"b', "", True, False, False, 3, "kdict", "[1, 2]", "PDFToken", None, '[{"x": 1}]', at(3))
    df = spark.createDataFrame([row], T.RECORD)
    assert [tuple(r) for r in T.from_records(T.to_records(df)).collect()] == [row]


KBEST = "array<struct<k:int,candidate:string,probability:double>>"


def test_detail_shows_candidates(spark):
    rows = [("abc", 3, "ti\u00ad", None, False, [(1, "ti\u00adme", 1.0)]), ("abc", 4, "me", None, False, []), ("abc", 5, "a", None, False, [(1, "a\u00adb", 0.5)])]
    got = {r.doc_index: r for r in T.token_detail(spark.createDataFrame(rows, f"doc_id string, doc_index int, original string, gold string, is_hyphenated boolean, kbest {KBEST}")).collect()}
    assert got[3].candidates[0].candidate == "ti-me"
    assert got[3].original == "ti-"
    assert got[4].candidates == []
    assert got[5].candidates[0].candidate == "a\u00adb"


def test_lookup(spark):
    t = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "doc_id string, doc_index int, original string")
    keys = spark.createDataFrame([("d", 1), ("d", 9), ("x", 0), ("d", 1)], "doc_id string, doc_index int")
    assert {(r.doc_id, r.doc_index, r.original, r.status) for r in T.lookup(t, keys).collect()} == {("d", 1, "b", 200), ("d", 9, None, 404), ("x", 0, None, 404)}


@pytest.mark.parametrize("seed", range(4))
def test_crop_edges_against_columns_of_pixels(spark, seed):
    rnd = random.Random(seed)
    boxes = [("d", p, x, x + rnd.randint(0, 60)) for p in range(5) for x in [rnd.randint(0, 300 if p else 0) for _ in range(rnd.randint(1, 12))]]
    got = {r.page: (r.left_edge, r.right_edge) for r in T.crop_edges(spark.createDataFrame(boxes, "doc_id string, page int, x0 int, x1 int")).collect()}
    for page in range(5):
        columns = Counter(x for _, p, a, b in boxes if p == page for x in range(a, b))
        if not columns:
            assert page not in got
            continue
        lo, hi = min(columns), max(columns)
        bins = Counter()
        for x, n in columns.items():
            bins[51 if hi == lo else min(100, (x - lo) * 100 // (hi - lo) + 1)] += n
        low = [b for b in range(1, 101) if bins[b] <= 0.1 * max(bins.values())]
        left, right = [b for b in low if b <= 20], [b for b in low if b > 80]
        assert got[page] == (round(lo + (max(left) - 1) * (hi - lo) / 100, 6) if left else 0.0, round(lo + max(right) * (hi - lo) / 100, 6) if right else hi + 1.0)


def test_snippets_stay_inside_the_page(spark):
    rows = [("d", 0, 1, 10, 5, 50, 20), ("d", 1, 1, 500, 400, 900, 420)]
    got = {r.doc_index: tuple(r)[3:] for r in T.snippets(spark.createDataFrame(rows, "doc_id string, doc_index int, page int, x0 int, y0 int, x1 int, y1 int")).collect()}
    assert got == {0: (0, 0, 350, 35), 1: (200, 385, 900, 420)}


def test_corrections_of_a_file(spark):
    t = spark.createDataFrame([("d", 0, "a", None, False), ("d", 1, "b", "B", False), ("d", 2, "c", None, False)], "doc_id string, doc_index int, original string, gold string, is_discarded boolean")
    rows = spark.createDataFrame([("d", 0, "A", False), ("d", 0, "A", False), ("d", 2, "", True), ("x", 9, "z", None), (None, 1, "q", None)], "doc_id string, doc_index int, gold string, is_discarded boolean")
    assert [(r.gold, r.is_discarded) for r in prepare.apply_corrections(t, rows).orderBy("doc_index").collect()] == [("A", False), ("B", False), ("", True)]
    bare = rows.drop("is_discarded").where("gold <> ''")
    assert [r.gold for r in prepare.apply_corrections(t, bare).orderBy("doc_index").collect()] == ["A", "B", None]
