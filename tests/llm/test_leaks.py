import random

import pytest

from scriptorium.llm import leaks as L

VOCABULARY = [a + b + c for a in ("kla", "bro", "sve", "nør", "tim", "gråd") for b in ("ver", "sel", "ning", "kom") for c in ("", "en", "hed", "s", "dom")] + ["og", "i", "at", "det"] * 8


def text(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def misread(rnd, word):
    i = rnd.randrange(len(word))
    return word[:i] + rnd.choice("cox1") + word[i + 1 :]


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    items = [(i, text(rnd, rnd.randint(24, 43))) for i in range(60)]
    docs, truth = [], set()
    for d in range(400):
        body = text(rnd, rnd.choice([0, 5, 60, 400, 3000]))
        if d % 3 == 0:
            i, words = rnd.choice(items)
            n = rnd.randint(15, len(words))
            at = rnd.randrange(len(words) - n + 1)
            part = list(words[at : at + n])
            for k in rnd.sample(range(1, n - 1), n // 10 if d % 2 else 0):
                part[k] = misread(rnd, part[k])
            part[n // 2] = part[n // 2].upper() + ","
            k = rnd.randint(0, len(body))
            body[k:k] = part
            truth.add((d, i))
        elif d % 3 == 1:
            i, words = rnd.choice(items)
            body[2:2] = words[:9] if d % 2 else rnd.sample(words, len(words))
        docs.append((d, "\n".join(" ".join(body[k : k + 9]) for k in range(0, len(body), 9))))
    return items, docs, truth


def test_every_passage_is_found_and_nothing_else(spark, case):
    items, docs, truth = case
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == truth


def test_forms_that_may_differ(spark):
    words = [f"{a}{b}" for a in ("knæ", "blå", "stor", "lang") for b in ("ning", "else", "hed", "dom", "skab")]
    plain = " ".join(words)
    broken = plain.upper().replace(" ", "  \n", 3).replace("BLÅNING", "BLÅ-\nNING").replace("STORHED", "„STOR­HED“;").replace("LANGDOM", "ＬＡＮＧＤＯＭ")
    docs = [(1, broken), (2, plain), (2, plain), (3, None), (4, ""), (5, " ".join(words[:14])), (None, plain), (6, " ".join(reversed(words)))]
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, plain), (8, None), (9, "kort"), (None, plain), (10, plain)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_words) for r in found.collect()) == [(d, i, 20) for d in (1, 2) for i in (7, 10)]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert L.leaks(docs, items).count() == 0
    assert L.leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items).count() == 0


def test_bands_reach_the_recall():
    for size in (16, 32, 64):
        jaccard = L.NEEDED / (size + 2 * L.BLOCK - L.NEEDED)
        assert 1 - (1 - jaccard) ** L.bands_needed(size) >= L.RECALL


def test_passage_lengths():
    item = [f"w{i}ord" for i in range(30)]
    assert L.longest_passage(item, ["x", *item[3:20], "y"]) == 17
    assert L.longest_passage(item, [*item[:10], "w10otd", *item[11:20]]) == 20
    assert L.longest_passage(item, [*item[:10], "helt", "andre", "ting", "her", *item[14:20]]) < 15
    assert L.longest_passage(item, item[::-1]) <= 2


def test_other_columns_do_not_matter(spark):
    words = " ".join(f"{a}{b}" for a in ("knæ", "blå", "stor", "lang") for b in ("ning", "else", "hed", "dom", "skab"))
    docs = spark.createDataFrame([(1, words, 5, "x"), (2, "y " * 300_000 + words, None, None)], "doc_id long, text string, item_id int, n_words string")
    items = spark.createDataFrame([(7, words, 3)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()) == [(1, 7), (2, 7)]
    assert [tuple(r) for r in L.leak_report(L.leaks(docs, items), items).collect()] == [(7, 2, 20)]
