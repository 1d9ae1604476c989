import random

import pytest

from scriptorium.operators import references as R

TOKEN = "doc_id string, doc_index int, loaded_at timestamp, k string"
KBEST = "doc_id string, doc_index int, k int, loaded_at timestamp, rng int"
CATALOG = "doc_id string, added_at timestamp, removed_at timestamp, found boolean"


def brute(tokens, kbest, catalog):
    held, first = {}, {}
    for doc, added, removed, _ in catalog:
        if doc is not None:
            a, r = held.get(doc, (None, False))
            held[doc] = (min(x for x in (a, added) if x is not None) if a or added else None, r or removed is not None)
    for doc, i, at, _ in tokens:
        old = first.get((doc, i))
        first[doc, i] = at if old is None else old if at is None else min(old, at)
    out = set()
    for (doc, i), at in first.items():
        if doc is None:
            continue
        if doc not in held:
            out.add(("token", doc, i, 0, "missing"))
        elif held[doc][1]:
            out.add(("token", doc, i, 0, "deleted"))
        elif at is not None and held[doc][0] is not None and at < held[doc][0]:
            out.add(("token", doc, i, 0, "late"))
    ours = {}
    for doc, i, k, at, _ in kbest:
        if doc is not None and i is not None:
            old = ours.get((doc, i, k))
            ours[doc, i, k] = at if old is None else old if at is None else min(old, at)
    for (doc, i, k), at in ours.items():
        if (doc, i) not in first:
            out.add(("kbest", doc, i, k, "missing"))
        elif at is not None and first[doc, i] is not None and at < first[doc, i]:
            out.add(("kbest", doc, i, k, "late"))
    return out


def run(spark, tokens, kbest, catalog, bits=2):
    rows = R.orphans(spark.createDataFrame(tokens, TOKEN), spark.createDataFrame(kbest, KBEST), spark.createDataFrame(catalog, CATALOG), bits).collect()
    found = [(r.ref_table, r.doc_id, r.doc_index, r.k, r.reason) for r in rows]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", range(3))
def test_random_tables_against_brute_force(spark, at, seed):
    rnd = random.Random(seed)
    names = ["a_1", "a_2", "a_02", "a_12", "b", "b 3", "", "12", "012", "x_12345678901234567890123", "a_1\n", None]
    when = lambda: at(rnd.choice([None, 1, 2, 3, 4]))
    tokens = [(rnd.choice(names), rnd.choice([*range(12), None]), when(), "x") for _ in range(150)]
    kbest = [(rnd.choice(names), rnd.choice([*range(14), None, -3]), rnd.randint(1, 3), when(), 0) for _ in range(200)]
    catalog = [(rnd.choice(names), when(), rnd.choice([None, None, at(9)]), True) for _ in range(7)]
    assert run(spark, tokens, kbest, catalog) == brute(tokens, kbest, catalog)


def test_empty_tables(spark, at):
    assert run(spark, [], [], []) == set()
    assert run(spark, [("d_1", 0, at(1), "")], [("d_1", 0, 1, at(1), 0), ("d_1", 1, 1, at(1), 0)], []) == {("token", "d_1", 0, 0, "missing"), ("kbest", "d_1", 1, 1, "missing")}


def test_runs_are_compressed_and_split_at_range_ends(spark, at):
    rows = [("d", i, at(1)) for i in range(10)] + [("d", 11, at(1)), ("d", 12, at(2))]
    runs = R.key_runs(spark.createDataFrame(rows, "doc_id string, doc_index int, first_at timestamp"), "doc_id", "doc_index", ["first_at"], bits=3)
    assert sorted((r.run_start, r.run_end) for r in runs.collect()) == [(0, 7), (8, 9), (11, 11), (12, 12)]


def test_counts_by_month(spark, at):
    found = spark.createDataFrame([("token", at(1), "late"), ("token", at(2), "late"), ("token", None, "late")], "ref_table string, loaded_at timestamp, reason string")
    assert sorted(map(tuple, R.orphans_by_month(found).collect()), key=str) == sorted([("token", "2024-01", "late", 2), ("token", None, "late", 1)], key=str)
