import json
import random

import numpy as np
import pytest

from scriptorium.llm import editor as E
from scriptorium.llm import pages as P
from scriptorium.llm import scans as S
from scriptorium.llm.normalize import visible_form

SHY = "­"
TOKEN = "doc_id string, doc_index int, original string, hyphenated boolean, discarded boolean, gold string, token_info string, last_modified timestamp, loaded_at timestamp, uid string, code string"
STEMS = ["kla", "bro", "sven", "nør", "timel", "gråd", "fru", "hvid", "stork", "mel"]
ENDS = ["ning", "else", "hed", "skab", "dom", "erne", "lig", "mose", "ede", "ende"]
WORDS = [a + m + b for a in STEMS for m in ("", "ta", "vå", "re") for b in ENDS]
SMALL = ["og", "i", "at", "det", "som", "en"]
CONFUSIONS = [("n", "u"), ("e", "c"), ("d", "cl"), ("r", "t"), ("m", "rn"), ("l", "1"), ("o", "0"), ("k", "h")]


def document(rnd, name, pages, start=1):
    """Rows of a scanned document with its true cases."""
    rows, truth, index = [], set(), 0
    for page in range(pages):
        line_no = 0

        def put(line, y, kinds=(), gold=True):
            nonlocal index
            for k, (shown, meant, kind) in enumerate(line):
                info = json.dumps([start + page, 60 + 50 * k, 70 + 19 * y, 90 + 50 * k, 84 + 19 * y, shown, 1, y, k + 1])
                correct = None if rnd.random() < 0.5 or not gold else meant
                rows.append((name, index, shown, None, False, correct, info, None, None, "", ""))
                truth.update((name, index, k2) for k2 in (*kinds, *kind))
                index += 1

        line_no += 1
        put([("Sogneblad", "", ()), ("for", "", ()), ("Vesterlund", "", ())], line_no, ["header"], gold=False)
        for i in range(len(rows) - 3, len(rows)):
            if rnd.random() < 0.5:
                rows[i] = (*rows[i][:4], True, "", *rows[i][6:])
        for _ in range(10):
            line = []
            for _ in range(rnd.randint(6, 8)):
                w = rnd.choice(SMALL) if rnd.random() < 0.4 else rnd.choice(WORDS)
                shown, kind = w, []
                if len(w) > 4 and rnd.random() < 0.08:
                    a, b = rnd.choice(CONFUSIONS)
                    if a in w:
                        shown, kind = w.replace(a, b, 1), ["misread"]
                line.append((shown, w, kind))
            line_no += 1
            put(line, line_no)
        put([(f"[{start + page}]", "", ())], line_no + 1, ["pageno"], gold=False)
        if rnd.random() < 0.5:
            rows[-1] = (*rows[-1][:4], True, "", *rows[-1][6:])
        # break some words over line ends
    return rows, truth


def broken(rnd, rows, truth):
    """Break some words at line ends: the last word of a line in two, the second half opening the next."""
    out, index, shifted = [], 0, {}
    for i, r in enumerate(rows):
        shifted[r[1]] = index
        info = json.loads(r[6])
        nxt = json.loads(rows[i + 1][6]) if i + 1 < len(rows) else None
        word = r[2]
        if nxt and nxt[7] == info[7] + 1 and nxt[0] == info[0] and word in WORDS and word.isalpha() and len(word) > 6 and not rows[i + 1][2].startswith("[") and info[7] > 1 and rnd.random() < 0.6:
            cut = rnd.randint(2, len(word) - 2)
            gold = None if r[5] is None else word
            out.append((r[0], index, word[:cut] + rnd.choice("-¬" + SHY), True, False, gold, r[6], *r[7:]))
            truth.add((r[0], ("new", index)))
            tail = [*nxt[:5], word[cut:], 1, nxt[7], 0]
            out.append((r[0], index + 1, word[cut:], None, False, None if gold is None else "", json.dumps(tail), *r[7:]))
            index += 2
        else:
            out.append((r[0], index, *r[2:]))
            index += 1
    cases = {(d, shifted[i], k) for d, i, k in (t for t in truth if len(t) == 3)}
    cases |= {(d, mark[1], "split") for d, mark in (t for t in truth if len(t) == 2)}
    return out, cases


@pytest.fixture(scope="module")
def collection():
    rnd = random.Random(12)
    rows, truth = [], set()
    for d in range(60):
        r, t = document(rnd, f"doc_{d}", rnd.randint(3, 8), rnd.choice([1, 41]))
        r, t = broken(rnd, r, t)
        rows += r
        truth |= t
    return rows, truth


def scores(found, truth, kind):
    f, t = {x for x in found if x[2] == kind}, {x for x in truth if x[2] == kind}
    return len(f & t) / max(1, len(f)), len(f & t) / max(1, len(t))


def test_held_out_accuracy(spark, collection):
    rows, truth = collection
    words = [("d", w) for w in WORDS[::2] + SMALL]
    found = {tuple(r) for r in S.noisy_tokens(spark.createDataFrame(rows, TOKEN), spark.createDataFrame(words, "group_name string, word string")).collect()}
    for kind, least in (("header", 0.97), ("pageno", 0.97), ("split", 0.9), ("misread", 0.8)):
        precision, recall = scores(found, truth, kind)
        assert precision >= least, (kind, precision, recall)
        assert recall >= least, (kind, precision, recall)


def test_paragraphs(spark, collection):
    rows, _ = collection
    some = [r for r in rows if r[0] in {f"doc_{i}" for i in range(20)}]
    out = S.paragraphs(spark.createDataFrame(some, TOKEN), spark.createDataFrame([("d", w) for w in WORDS], "group_name string, word string")).collect()
    joined = " ".join(r.text for r in out)
    assert "Sogneblad" not in joined
    assert "¬" not in joined
    whole = sum(w in set(WORDS) for w in joined.split())
    assert whole > 0.55 * len(joined.split())


def test_paragraphs_are_whole_sentences(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_BITS", 6)
    monkeypatch.setattr(S, "PARAGRAPH", 8)
    rnd = random.Random(7)
    words = [("d", 3 * i, "ende." if rnd.random() < 0.15 else "kap." if rnd.random() < 0.05 else f"w{i}") for i in range(400)] + [("e", i, "ord") for i in range(200)] + [("f", 0, "slut.")]
    rows = S.with_paragraph(spark.createDataFrame(words, "doc_id string, doc_index int, shown string")).orderBy("doc_id", "doc_index").collect()
    d = [r for r in rows if r.doc_id == "d"]
    assert len(rows) == len(words)
    assert all(a.paragraph <= b.paragraph for a, b in zip(d, d[1:], strict=False))
    closed = [a.shown for a, b in zip(d, d[1:], strict=False) if a.paragraph != b.paragraph]
    assert set(closed) == {"ende."}
    assert len(closed) > 20
    assert len({r.paragraph for r in rows if r.doc_id == "e"}) == 4


def test_empty_and_dirty_tables(spark):
    words = spark.createDataFrame([("g", None), ("g", "og")], "group_name string, word string")
    assert S.noisy_tokens(spark.createDataFrame([], TOKEN), words).count() == 0
    dirty = [("d", 0, "x" * 100_000, None, None, None, "{bad", None, None, "", ""), ("d", 1, "", None, None, None, None, None, None, "", ""), ("d", None, "a", None, None, None, None, None, None, "", ""), (None, 3, "a", None, None, None, None, None, None, "", ""), ("d", 4, "og", True, None, "og", '{"page": 1}', None, None, "", ""), ("d", 4, "og", True, None, "og", '{"page": 1}', None, None, "", ""), ("d", 2**31 - 1, "at-", None, None, None, "[1,2", None, None, "", "")]
    got = S.noisy_tokens(spark.createDataFrame(dirty, TOKEN), words).collect()
    assert {r.kind for r in got} <= {"header", "pageno", "split", "misread"}
    assert len(got) == len({tuple(r) for r in got})


def two_lines(spark, lines, golds):
    """One page of lines of words."""
    rows = [(w, n, k) for n, line in enumerate(lines) for k, w in enumerate(line.split())]
    return spark.createDataFrame([("d", i, w, None, False, golds.get(i), json.dumps([1, 60, 70 + 19 * n, 90, 84 + 19 * n, w, 1, n, k + 1]), None, None, "", "") for i, (w, n, k) in enumerate(rows)], TOKEN)


def test_a_break_the_corrector_marked_is_split_whatever_the_editor_says(spark):
    tokens = two_lines(spark, ["det var saa fretbvnl", "elſſe som det var"], {3: "frethvul" + SHY, 4: "elſe"})
    words = spark.createDataFrame([("g", "og")], "group_name string, word string")
    found = {tuple(r)[1:] for r in S.noisy_tokens(tokens, words, train_tokens=0).collect()}
    assert {(3, "split"), (3, "misread"), (4, "misread")} <= found


def test_paragraphs_join_what_the_corrector_marked(spark):
    words = spark.createDataFrame([("g", "og")], "group_name string, word string")
    lines = ["det var saa fretbvnl", "elſſe som det var"]
    for golds, whole in (({3: "frethvul" + SHY, 4: "else"}, "frethvulelse"), ({3: "frethvulelse", 4: ""}, "frethvulelse"), ({3: "frethvul" + SHY}, "frethvulelsse")):
        (got,) = S.paragraphs(two_lines(spark, lines, golds), words, train_tokens=0).collect()
        assert got.text == f"det var saa {whole} som det var"


def test_an_unmarked_break_with_a_misread_half_is_a_pair(spark):
    tokens = two_lines(spark, ["det var saa kirkesa", "uger som det var"], {})
    words = spark.createDataFrame([("g", "kirkesanger"), ("g", "som")], "group_name string, word string")
    read, _, plain = S.repaired_tokens(tokens, words, train_tokens=0)
    pair = read.where("word = 'kirkesa' AND next = 'uger'").select("uid")
    assert pair.count() == 1
    assert pair.join(plain, "uid").count() == 0


def test_the_newest_version_counts(spark, at):
    rows = [("d", 0, "og", None, False, g, None, at(m), at(n), "", "") for g, m, n in ((None, None, 9), ("a", 1, 3), ("b", 2, 1), ("c", 2, 0))]
    read = S.read_ranges(spark.createDataFrame(rows, TOKEN)).collect()
    assert [(r.doc_index, r.gold_left) for r in read] == [(0, "b")]


def test_ranges_meet_as_one_document(spark):
    rng = random.Random(3)
    rows, _ = document(rng, "long", 12)
    df = spark.createDataFrame(rows, TOKEN)
    one = S.read_ranges(df).orderBy("doc_index").collect()
    many = S.read_ranges(df, bits=9, halo=255).orderBy("doc_index").collect()
    assert [(r.doc_index, r.word, r.next, r.follow) for r in one] == [(r.doc_index, r.word, r.next, r.follow) for r in many]


# the editor ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("read", "meant"), [("fom", "som"), ("oclså", "også"), ("ogsså", "også"), ("tl", "til"), ("rned", "med"), ("abc", "abc"), ("xyz", "qrstu"), ("a", ""), ("br0ugelse", "brongelse"), ("hjælpcr", "hjælpere")])
def test_operations_lead_to_the_word(read, meant):
    ops, letters = E.operations(read, meant)
    assert E.apply_operations(read, ops, letters) == meant


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    f = E.Featurizer(E.gram_sketch(E.gram_slots(["som", "s"]), np.array([3, 1, 1, 1, 9, 2, 1, 1])))
    items = [E.Item("som", 0, 0, "D", None, "-", "-"), E.Item("", 0, 0, "D", None, "-", "-"), E.Item("fom", 0, 0, "?1", "som", "D12", "-"), E.Item("kla" + "ning", 3, 1, "D", None, "-", "DKK-1")]
    together, ends = f.features(items)
    alone = [f.features([i])[0] for i in items]
    assert np.array_equal(together, np.concatenate(alone))
    assert ends.tolist() == [3, 3, 6, 13]


def test_the_perceptron_learns():
    f = E.Featurizer()
    good = [E.Item(w, 0, 0, "?1", None, "-", "-") for w in ("hus", "mus", "lus", "bus")]
    bad = [E.Item(w, 0, 0, "?1", w.replace("q", "u"), "D11", "-") for w in ("hqs", "mqs", "lqs")]
    data = []
    for i in good + bad:
        x, _ = f.features([i])
        data.append((x, np.array(E.operations(i.text, i.near or i.text)[0])))
    m = E.train(data)
    x, _ = f.features([E.Item("bqs", 0, 0, "?1", "bus", "D11", "-")])
    assert m.scores(x).argmax(axis=1).tolist() == [E.KEEP, E.REPLACE, E.KEEP]


# furniture ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "value"), [("41", 41), ("[4Z]", 42), ("-46-", 46), ("xlii.", 42), ("vii.", 7), ("(5)", 5), ("og", None), ("1884,5", None), ("—", None), ("[[3]]", 3)])
def test_page_numbers(text, value):
    assert P.number_value(text) == value


@pytest.mark.parametrize(("text", "mark"), [("klo-", 1), ("klo¬", 2), (f"klo{SHY}", 2), ("klo⸗", 2), ("klo=", 2), ("-46-", 0), ("—", 0), ("-", 0), ("klo", 0), ("klo－", 1)])
def test_hyphen_marks(text, mark):
    assert P.mark_of_visible(visible_form(text.replace(SHY, "¬"))) == mark
