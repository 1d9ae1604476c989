import os
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from scriptorium.common import local_path, scratch_dir
from scriptorium.llm import frequency as Q


def brute(rows):
    n, docs = Counter(), defaultdict(set)
    for field, term, doc in rows:
        if term:
            n[field, term] += 1
            docs[field, term].update([doc] if doc is not None else [])
    return {(f, t, c, len(docs[f, t])) for (f, t), c in n.items()}


def sample(seed, size=3000):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["hot"] * 100 + ["", None, "x" * 5000, "'; DROP", "hot ", "Hot", "\x00"]
    return [(rnd.choice(["original", "gold"]), rnd.choice(words), rnd.choice(["d1", "d1", "d2", "d3", None])) for _ in range(size)]


def spills(spark):
    root = local_path(scratch_dir(spark))
    return [f for d, _, names in os.walk(root) if "radix-" in d for f in names]


@pytest.mark.parametrize("limit", [32 << 20, 4000])
def test_against_brute_force_with_and_without_spilling(spark, limit):
    rows = sample(1)
    df = spark.createDataFrame(rows, "field_name string, term string, doc_id string").repartition(3)
    got = Q.term_frequencies(df, limit=limit, partitions=2).collect()
    assert len(got) == len({(r.field_name, r.term) for r in got})
    assert {tuple(r) for r in got} == brute(rows)
    assert spills(spark) == []  # nothing is left behind


def parted(uri, h, limit):
    spill = Q.Spill(uri)
    con = Q._connection("", 64)
    batches = [pa.RecordBatch.from_pydict({"h": pa.array(h[i : i + 100], pa.int64()), "n": [1] * len(h[i : i + 100])}) for i in range(0, len(h), 100)]
    unite = Q._aggregate(con, "SELECT h, sum(n)::BIGINT AS n FROM leaf GROUP BY ALL")
    leaves = list(Q._leaves(iter(batches), spill, Q.ROOT_BITS, limit, unite))
    spill.close()
    return leaves, spill


@pytest.mark.parametrize("uri", ["local", "mock:///shared"])
def test_spilling_over_several_levels_on_any_file_system(tmp_path, uri):
    rnd = random.Random(4)
    h = [rnd.getrandbits(47) - (1 << 46) for _ in range(20_000)] + [7] * 5000
    leaves, spill = parted(f"file://{tmp_path}" if uri == "local" else uri, h, 2000)
    assert spill.files > 16 + 256  # three levels
    owner = {}
    total = Counter()
    for k, leaf in enumerate(leaves):
        for key, n in zip(leaf["h"].to_pylist(), leaf["n"].to_pylist(), strict=True):
            assert owner.setdefault(key, k) == k
            total[key] += n
    assert total == Counter(h)
    assert all(leaf.nbytes <= 8000 for leaf in leaves)
    assert os.listdir(tmp_path) == []


def test_equal_hash_bits_end_the_recursion(tmp_path):
    """A key found over and over, and keys that agree in all bits, are united and not parted for ever."""
    leaves, spill = parted(f"file://{tmp_path}", [7] * 5000, 1000)
    assert sum(sum(t["n"].to_pylist()) for t in leaves) == 5000
    assert spill.files == 0


@pytest.mark.parametrize("distinct", [40, 20_000])
def test_columns_marked_as_without_null(tmp_path, distinct):
    """Spark marks the hash as never NULL, DuckDB does not: what is united and kept, and what is left when
    the input ends, goes into one table or file with batches as Spark sends them."""
    schema = pa.schema([pa.field("h", pa.int64(), nullable=False), pa.field("n", pa.int64())])
    h = [random.Random(k % distinct).getrandbits(47) for k in range(20_030)]
    batches = [pa.RecordBatch.from_arrays([pa.array(h[i : i + 100]), pa.array([1] * len(h[i : i + 100]))], schema=schema) for i in range(0, len(h), 100)]
    spill = Q.Spill(f"file://{tmp_path}")
    unite = Q._aggregate(Q._connection("", 64), "SELECT h, sum(n)::BIGINT AS n FROM leaf GROUP BY ALL")
    total = Counter()
    for leaf in Q._leaves(iter(batches), spill, Q.ROOT_BITS, 5000, unite):
        for key, n in zip(leaf["h"].to_pylist(), leaf["n"].to_pylist(), strict=True):
            total[key] += n
    assert total == Counter(h)
    assert (spill.files > 0) == (distinct > 40)
    spill.close()
    assert os.listdir(tmp_path) == []


def test_duckdb_and_the_spill_write_to_one_folder(tmp_path):
    """DuckDB, short of memory, makes the folder before the first spill file, and removes it at its end."""
    words = [f"{k:050d}" for k in range(400_000)]
    batches = [pa.RecordBatch.from_pydict({"h": pa.array([(k * 0x9E3779B97F4A7C15) % (1 << 47) for k in range(i, i + 10_000)], pa.int64()), "term": words[i : i + 10_000], "n": pa.array([1] * 10_000, pa.int64())}) for i in range(0, len(words), 10_000)]
    sql = "SELECT h, term, sum(n)::BIGINT AS n FROM leaf GROUP BY ALL"
    got = list(Q._radix_aggregate(sql, sql, f"file://{tmp_path}", 16 << 20, 30)(iter(batches)))
    assert sum(b.num_rows for b in got) == len(words)
    assert os.listdir(tmp_path) == []


def test_marks(spark):
    token = [(f"d{i}", "og", "og" if i < 3 else None, 0) for i in range(10)] + [("d0", "sjælden", "", 0), (None, "sjælden", None, 0)]
    kbest = [("d0", "og", "x"), ("d1", "", "x"), ("d2", None, "x")]
    got = Q.marked_terms(spark.createDataFrame(token, "doc_id string, original string, gold string, n int"), spark.createDataFrame(kbest, "doc_id string, candidate string, term string"))
    assert {tuple(r) for r in got.collect()} == {("original", "og", 10, 10, "common"), ("original", "sjælden", 2, 1, "rare"), ("gold", "og", 3, 3, None), ("candidate", "og", 1, 1, "rare")}


def test_empty(spark):
    none = spark.createDataFrame([], "field_name string, term string, doc_id string")
    assert Q.term_frequencies(none).count() == 0
