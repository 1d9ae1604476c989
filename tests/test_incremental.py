import random

import pytest
from pyspark.sql import DataFrameWriter

from scriptorium.operators import incremental as M

TOKEN = "doc_id string, doc_index int, gold string, last_modified timestamp, loaded_at timestamp, node string, seen string"
LOG = "doc_id string, read_upto timestamp, state string"


def brute(tokens, log):
    seen = {}
    for doc, upto, state in log:
        if state == "ok" and upto is not None and doc is not None:
            seen[doc] = max(seen.get(doc, upto), upto)
    key = lambda v: (v[1] is not None, v[1] or 0, v[2] is not None, v[2] or 0, v[0] is not None, v[0] or "")
    out, versions = set(), {}
    for doc, i, gold, modified, loaded, *_ in tokens:
        if doc is not None and i is not None:
            versions.setdefault((doc, i), []).append((gold, modified and modified.timestamp(), loaded and loaded.timestamp()))
    for (doc, i), rows in versions.items():
        mark = seen[doc].timestamp() if doc in seen else None
        old = [r for r in rows if mark is not None and r[2] is not None and r[2] <= mark]
        if not old or max(rows, key=key)[:2] != max(old, key=key)[:2]:
            out.add((doc, i))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, at, seed):
    rnd = random.Random(seed)
    docs = ["a", "b", "c", "hot", None]
    tokens = [
        (rnd.choice([*docs, "hot", "hot"]), rnd.choice([0, 1, 127, 128, 40000, 2**31 - 1, None]), rnd.choice([None, "", "x", "y"]), at(rnd.choice([None, 1, 2])), at(rnd.choice([None, 1, 2, 3, 4])), "", "")
        for _ in range(120)
    ]
    log = [(rnd.choice(docs[:2] + ["hot"]), at(rnd.choice([None, 1, 2, 3])), rnd.choice(["ok", "failed", "running"])) for _ in range(8)]
    rows = M.changed_tokens(spark.createDataFrame(tokens, TOKEN), spark.createDataFrame(log, LOG)).collect()
    found = [(r.doc_id, r.doc_index) for r in rows]
    assert len(found) == len(set(found))
    assert set(found) == brute(tokens, log)


def test_empty(spark):
    assert M.changed_tokens(spark.createDataFrame([], TOKEN), spark.createDataFrame([], LOG)).count() == 0


STATE = "doc_id string, doc_index int, content string"


def test_runs_publish_exactly_the_differences(spark, tmp_path):
    root = str(tmp_path / "store")
    first = [("d", i, f"v{i}") for i in range(300)] + [("e", 5, None), ("long", 1, "x" * 200_000)]
    assert M.run_once(spark.createDataFrame(first, STATE), root).count() == 302
    second = [("d", i, "new" if i == 150 else f"v{i}") for i in range(299)] + [("e", 5, ""), ("f", 0, "z"), ("long", 1, "x" * 200_000)]
    got = sorted((r.doc_id, r.doc_index, r.content, r.kind) for r in M.run_once(spark.createDataFrame(second, STATE), root).collect())
    assert got == [("d", 150, "new", "changed"), ("d", 299, None, "gone"), ("e", 5, "", "changed"), ("f", 0, "z", "new")]
    assert M.run_once(spark.createDataFrame(second, STATE), root).count() == 0


class Death(Exception):
    pass


@pytest.mark.parametrize("step", range(4))
def test_a_run_may_die_between_any_two_steps(spark, tmp_path, monkeypatch, step):
    """Before output, records, tree or marker are written: the next run gives the same rows as if it were the first."""
    root = str(tmp_path / "store")
    M.run_once(spark.createDataFrame([("d", 0, "a"), ("d", 500, "b"), ("e", 1, "c")], STATE), root)
    last = M.published(spark, root)
    state = spark.createDataFrame([("d", 0, "A"), ("d", 500, "b"), ("f", 1, "c")], STATE)
    written = []
    original = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        if path.startswith(root):
            if len(written) == step:
                raise Death
            written.append(path)
        return original(self, path, *args, **kwargs)

    def publish(*args):
        raise Death

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", parquet)
        if step == 3:
            m.setattr(M, "publish", publish)
        with pytest.raises(Death):
            M.run_once(state, root)
    assert M.published(spark, root) == last
    got = sorted((r.doc_id, r.doc_index, r.kind) for r in M.run_once(state, root).collect())
    assert got == [("d", 0, "changed"), ("e", 1, "gone"), ("f", 1, "new")]
    assert M.run_once(state, root).count() == 0


def test_of_two_runs_at_once_one_publishes(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    M.run_once(spark.createDataFrame([("d", 0, "a")], STATE), root)
    one, other = (spark.createDataFrame([("d", 0, c)], STATE) for c in "bc")
    original = M.publish

    def late(*args):
        monkeypatch.setattr(M, "publish", original)
        assert [r.content for r in M.run_once(other, root).collect()] == ["c"]
        original(*args)

    monkeypatch.setattr(M, "publish", late)
    with pytest.raises(M.AlreadyPublished):
        M.run_once(one, root)
    assert len(M.published(spark, root)) == 2
    assert [(r.content, r.kind) for r in M.run_once(one, root).collect()] == [("b", "changed")]


def test_a_run_writes_and_reads_only_changed_leaves(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("d", i, "x") for i in range(2000)]
    M.run_once(spark.createDataFrame(rows, STATE), root)
    M.run_once(spark.createDataFrame([*rows[:700], ("d", 700, "y"), *rows[701:]], STATE), root)
    last = M.published(spark, root)[-1]
    assert spark.read.parquet(f"{last}/state").count() == 1 << M.LEAF_BITS
    assert spark.read.parquet(f"{last}/tree").count() == M.LEVELS
    # from the version before and the last one
    third = [*rows[:10], ("d", 10, "z"), *rows[11:700], ("d", 700, "y"), ("d", 701, "y"), *rows[702:]]
    assert sorted((r.doc_index, r.content) for r in M.run_once(spark.createDataFrame(third, STATE), root).collect()) == [(10, "z"), (701, "y")]


def test_paired_trees_descend_to_the_same_leaves(spark):
    rows = [("d", i, None if i == 5 else ("x",), None if i == 300 else ("y" if i == 700 else "x",)) for i in range(1000)]
    state = spark.createDataFrame(rows, "doc_id string, doc_index int, now struct<v:string>, then struct<v:string>")
    assert sorted(r.node for r in M.descend(M.paired_levels(state)).collect()) == [5 >> M.LEAF_BITS, 300 >> M.LEAF_BITS, 700 >> M.LEAF_BITS]


def test_descent_reaches_only_changed_leaves(spark):
    a = spark.createDataFrame([("d", i, "x") for i in range(1000)], STATE)
    b = spark.createDataFrame([("d", i, "y" if i == 700 else "x") for i in range(1000)], STATE)
    assert [tuple(r) for r in M.changed_leaves(M.build_tree(a), M.build_tree(b)).collect()] == [("d", 700 >> M.LEAF_BITS)]
