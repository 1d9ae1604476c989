import random
from itertools import product

import pytest

from scriptorium.operators import align, bins, dictionary, hmm
from scriptorium.operators import tokens as T
from scriptorium.plans import prepare

SHY = "­"
REQUIRED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz()-" + SHY


@pytest.fixture(scope="module")
def model(spark):
    counts = [(c, c, 1000) for c in "Sriæng-" + SHY] + [("t", "t", 999), ("l", "t", 1), (")", "(", 1000)]
    read = spark.createDataFrame(counts, "orig_char string, gold_char string, n long")
    words = spark.createDataFrame([("String", 1), ("Stræng", 1)], "word string, n long")
    return hmm.Model.collect(*hmm.train(read, words, words.select("word"), REQUIRED))


@pytest.mark.parametrize(("word", "best"), [("Slring", "String"), ("Str-ing", "Str-ing"), (f"Str{SHY}ing", f"Str{SHY}ing"), ("(String)", "(String)"), ("String", "String")])
def test_best_reading(model, word, best):
    assert model.kbest(word, 4, {})[0][0] == best


def test_groups_of_characters(model):
    assert model.kbest("Strceng", 4, {"ce": ["æ"]})[0][0] == "Stræng"


def test_empty_word(model):
    assert model.kbest("", 3, {}) == [("", 0.0)] * 3


def brute_model(seed):
    rnd = random.Random(seed)
    states = "abc"
    share = lambda: rnd.choice([0.0, 0.25, 0.5, 0.125])
    return hmm.Model({c: share() for c in states}, {(a, b): share() for a in states for b in states}, {(a, b): share() for a in states for b in "abcx"})


def emission(m, c):
    return m.emis[m.read.get(c, len(m.read))]


def test_words_together_as_one_by_one():
    rnd = random.Random(1)
    m = brute_model(2)
    words = ["".join(rnd.choice("abcx") for _ in range(rnd.randint(0, 6))) for _ in range(200)]
    groups = {"ab": ["c", ""], "x": ["a"]}
    together = m.kbests(words, 3, groups)
    assert together == [m.kbest(w, 3, groups) for w in words]
    assert m.together(words, m.readings, 7) == {w: m.viterbi(w) for w in words}


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_and_wide_beam_against_all_paths(seed):
    m = brute_model(seed)
    for word in ("a", "bx", "abc", "cabx"):
        scored = []
        for path in product(range(3), repeat=len(word)):
            p = m.init[path[0]] * emission(m, word[0])[path[0]]
            for i in range(1, len(word)):
                p = p * m.tran[path[i - 1], path[i]] * emission(m, word[i])[path[i]]
            scored.append((-p, "".join("abc"[s] for s in path)))
        scored.sort()
        assert [(-p, t) for p, t in scored[:5]] == [(p, t) for t, p in m.beam(word, 81)][:5]
        best = m.viterbi(word)
        assert dict((t, p) for p, t in scored)[best] == scored[0][0]


def test_variants():
    assert hmm.variants("acaca", "c", ["x", "yy"]) == sorted({"ac" + "axa", "acayya", "axaca", "axaxa", "axayya", "ayyaca", "ayyaxa", "ayyayya"})


def test_validity(spark):
    one = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "state string, p double")
    tran = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, p double")
    emis = spark.createDataFrame([("a", "a", 1.0)], "state string, obs string, p double")
    assert tuple(hmm.validity(one, tran, emis).first()) == (2, True, False, False)


def test_read_counts(spark):
    words = spark.createDataFrame([("t3st", "test"), ("t3st", "test"), ("is", "is"), ("abc", "ab"), (None, "x"), ("x", None)], "original string, gold string")
    got = {(r.orig_char, r.gold_char): r.n for r in align.read_counts(words).collect()}
    assert got["3", "e"] == 2
    assert got["t", "t"] == 4
    assert ("c", None) not in got


def test_apply_as_gold(spark):
    columns = "doc_id string, doc_index int, original string"
    make = lambda text: spark.createDataFrame([("d", i, w) for i, w in enumerate(text.split())], columns)
    got = align.apply_as_gold(make("This is a t3st"), make("This is a test")).orderBy("doc_index").collect()
    assert [r.gold for r in got] == ["This", "is", "a", "test"]
    got = align.apply_as_gold(make("This is x a t3st"), make("This is a test")).orderBy("doc_index").collect()
    assert [(r.gold, r.is_discarded) for r in got] == [("This", False), ("is", False), ("", True), ("a", False), ("test", False)]
    with pytest.raises(Exception, match="no counterpart"):
        align.apply_as_gold(make("a b"), make("a x y b")).collect()


@pytest.mark.parametrize("bits", [2, 5, 13])
def test_apply_as_gold_does_not_depend_on_ranges(spark, bits):
    rnd = random.Random(3)
    words = [f"w{rnd.randint(0, 400)}" for _ in range(900)]
    right, want = [], {}
    for i, w in enumerate(words):
        kind = "delete" if i % 40 == 7 else "replace" if i % 40 == 20 else "insert" if i % 40 == 30 else ""
        right += [] if kind == "delete" else [f"new{i}"] if kind == "replace" else [f"more{i}", w] if kind == "insert" else [w]
        want[i] = "" if kind == "delete" else f"new{i}" if kind == "replace" else w
    columns = "doc_id string, doc_index int, original string"
    left = spark.createDataFrame([("d", 3 * i, w) for i, w in enumerate(words)] + [("alone", 0, "x"), (None, 1, "y")], columns)
    other = spark.createDataFrame([("d", i, w) for i, w in enumerate(right)] + [("other", 5000, "z")], columns)
    got = {(r.doc_id, r.doc_index): r.gold for r in align.apply_as_gold(left, other, bits, strict=False, sparse=8).collect()}
    assert got.pop(("alone", 0)) == ""
    assert got == {("d", 3 * i): g for i, g in want.items()}


def test_parting_of_long_stretches():
    rnd = random.Random(5)
    x = [f"w{rnd.randint(0, 20_000)}" for _ in range(12_000)]
    y = x[:3000] + ["new"] * 40 + x[3000:9000] + x[9100:]
    ops = [o for o in align.opcodes(x, y) if o[0] != "equal"]
    assert ops == [("insert", 3000, 3000, 3000, 3040), ("delete", 9000, 9100, 9040, 9040)]
    assert align.opcodes(["a"] * 5000, []) == [("delete", 0, 5000, 0, 0)]


def test_training_rows(spark):
    """Only finished documents, and only required characters, are counted; broken words count joined."""
    rows = [("a", 0, "Str-", "Str", True, False), ("a", 1, "ing", "ing", False, False), ("b", 0, "x", "q", False, False), ("a", 2, "9", "9", False, False)]
    tokens = spark.createDataFrame(rows, "doc_id string, doc_index int, original string, gold string, is_hyphenated boolean, is_discarded boolean").selectExpr("*", "'annotator' AS heuristic", "cast(null as int) AS bin", "cast(null as string) AS selection")
    done = spark.createDataFrame([("a",)], "doc_id string")
    assert {r.word: r.n for r in prepare.training_words(tokens, done).collect()} == {"String": 1, "9": 1}
    init, _, _ = prepare.train_model(tokens, done, required="Stringz")
    # the 9 is no required character, but one that was read
    assert {r.state for r in init.collect()} == set("Stringz9")
    words = T.consolidated(tokens)
    assert {tuple(r) for r in dictionary.new_words(words, spark.createDataFrame([("g", "q")], "group_name string, word string")).collect()} == {("gold-a", "String")}


def test_groups(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "group_name string, word string")
    assert dictionary.has_group(d, "a") and dictionary.has_group(d, None) and not dictionary.has_group(d, "c")
    assert sorted(r.word for r in dictionary.cleared(d, "a").collect()) == ["y", "z"]
    assert dictionary.cleared(d).count() == 0


# dictionary ---------------------------------------------------------------------------------


def test_strange_words(spark):
    raw = spark.createDataFrame([("g", "word"), ("g", "test testing"), (None, "1.")], "group_name string, word string")
    d = dictionary.add_words(raw)
    assert {r.word for r in d.collect()} == {"word", "test", "testing"}
    asked = ["123", ".", "", "A4", "[word", "word! ", " word ", f"wo{SHY}rd", "wo-rd", f"(wo{SHY}rd)", "(wo-rd)", "»word«", "wo!rd", "test´testing"]
    got = {r.word: r.known for r in dictionary.known_words(spark.createDataFrame([(w,) for w in asked], "word string"), d).collect()}
    assert [w for w in asked if not got[w]] == ["wo!rd", "test´testing"]


def test_dictionary_differences(spark):
    a, b = (spark.createDataFrame([(w,) for w in t], "word string") for t in ("xy", "yz"))
    assert sorted(r.word for r in dictionary.symmetric_difference(a, b).collect()) == ["x", "z"]


# bins ---------------------------------------------------------------------------------------


def decision(original, kbest, words):
    """The table of bins, in words."""
    known = lambda w: w in words or sum(c.isalpha() for c in w) <= 1
    if not kbest:
        return 10
    o, k1, hits = known(original), kbest[0], [k for k in kbest if known(k)]
    if original == k1:
        return 1 if o else 3 if hits else 2
    if not o:
        return 4 if known(k1) else 6 if hits else 5
    return 7 if known(k1) else 9 if hits else 8


def test_all_bins(spark):
    words = ["ab", "cd", "ef"]
    rows, want = [], {}
    for i, (original, n) in enumerate(product(["ab", "xx", "cd", "9"], range(40))):
        rnd = random.Random(i)
        kbest = [rnd.choice(["ab", "cd", "xx", "yy"]) for _ in range(n % 5)]
        rows.append(("d", i, original, None, [(k + 1, c, 0.5) for k, c in enumerate(kbest)], False, False))
        want[i] = decision(original, kbest, words)
    tokens = spark.createDataFrame(rows, "doc_id string, doc_index int, original string, gold string, kbest array<struct<k:int,candidate:string,probability:double>>, is_hyphenated boolean, is_discarded boolean")
    tokens = tokens.selectExpr("*", "cast(null as string) as heuristic", "cast(null as string) as selection", "cast(null as int) as bin")
    settings = spark.createDataFrame([(1, "o"), (3, "d"), (4, "k"), (6, "KDICT"), (7, "original")], "bin int, heuristic string")
    got = bins.bin_tokens(tokens, spark.createDataFrame([("g", w) for w in words], "group_name string, word string"), settings)
    out = {r.doc_index: r for r in got.collect()}
    assert {i: r.bin for i, r in out.items()} == want
    assert set(want.values()) == set(range(1, 11))
    names = {1: "original", 3: "kdict", 4: "kbest", 6: "kdict", 7: "original"}
    assert all(r.heuristic == names.get(r.bin, "annotator") for r in out.values())
    fixed = {r.doc_index: r.gold for r in bins.autocorrect(got).collect()}
    for i, r in out.items():
        if r.heuristic == "original":
            assert fixed[i] == r.original
        elif r.heuristic == "kbest":
            assert fixed[i] == r.kbest[0].candidate
        elif r.heuristic == "kdict":
            assert fixed[i] in words
        else:
            assert fixed[i] is None


def test_words_looked_up_before_they_are_lists(spark):
    tokens = spark.createDataFrame([("d", 0, "ab"), ("d", 1, "xx"), ("d", 2, None)], "doc_id string, doc_index int, original string")
    kbest = spark.createDataFrame([("d", 0, 2, "ab", 0.1), ("d", 0, 1, "xx", 0.2), ("d", 0, 3, "cd", 0.0), ("d", 1, 1, None, 0.2), ("e", 0, 1, "ab", 0.2)], "doc_id string, doc_index int, k int, candidate string, probability double")
    words = spark.createDataFrame([("g", "ab"), ("g", "cd")], "group_name string, word string")
    got = {r.doc_index: (r.o_known, r.k_known, [c.candidate for c in r.kbest]) for r in bins.looked_up(tokens, kbest, words).collect()}
    assert got == {0: (True, [2, 3], ["xx", "ab", "cd"]), 1: (False, [], [None]), 2: (False, [], [])}
    slow = bins.with_knowledge(T.with_candidates(tokens, kbest), words)
    assert {r.doc_index: (r.o_known, r.k_known, [c.candidate for c in r.kbest]) for r in slow.collect()} == got


def test_prepare_end_to_end(spark, model):
    words = spark.createDataFrame([("d", i, w) for i, w in enumerate(["Slring", "String", "Str-", "ing"])], "doc_id string, doc_index int, original string")
    options = prepare.Options(spark.createDataFrame([("g", "String")], "group_name string, word string"), spark.createDataFrame([(1, "o"), (4, "k")], "bin int, heuristic string"), model)
    out = prepare.prepare(words, "all", options).orderBy("doc_index").collect()
    assert [(r.bin, r.heuristic) for r in out[:2]] == [(4, "kbest"), (1, "original")]
    assert [r.gold for r in out[:2]] == ["String", "String"]
    assert out[2].is_hyphenated
    assert (out[3].bin, out[3].heuristic) == (out[2].bin, out[2].heuristic)
    with pytest.raises(ValueError, match="unknown step"):
        prepare.prepare(words, "print", options)


def test_candidates_in_order(spark):
    tokens = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, doc_index int")
    kbest = spark.createDataFrame([("d", 0, 2, "b", 0.1), ("d", 0, 1, "a", 0.2), ("e", 0, 1, "x", 0.2)], "doc_id string, doc_index int, k int, candidate string, probability double")
    got = {r.doc_index: [c.candidate for c in r.kbest] for r in T.with_candidates(tokens, kbest).collect()}
    assert got == {0: ["a", "b"], 1: []}


def test_comparison_and_storage(spark, model, tmp_path):
    words = spark.createDataFrame([("Slring",)], "word string")
    got = hmm.compare(words, model, model, 2).collect()
    assert all(r.candidate == r.other_candidate for r in got)
    counts = spark.createDataFrame([("a", "a", 3), ("b", "a", 1)], "orig_char string, gold_char string, n long")
    tables = hmm.train(counts, spark.createDataFrame([("ab", 2)], "word string, n long"))
    hmm.save(tables, str(tmp_path / "model"))
    assert hmm.load(spark, str(tmp_path / "model")).states == ["a", "b"]
    with pytest.raises(ValueError, match="not valid"):
        hmm.save((tables[0], tables[1].where("src = 'a'"), tables[2]), str(tmp_path / "other"))
