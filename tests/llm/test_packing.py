import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing as K


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=30))
def test_patterns_hold_the_histogram(histogram):
    patterns = K.pack_histogram(histogram, 64)
    got = Counter()
    for pattern, count in patterns:
        assert count > 0
        assert sum(n * c for n, c in pattern.items()) <= 64
        for n, c in pattern.items():
            got[n] += c * count
    assert got == Counter({n: c for n, c in histogram.items() if c})


def test_little_room_is_left():
    rnd = random.Random(3)
    histogram = Counter(min(1024, max(1, int(rnd.lognormvariate(5.5, 0.9)))) for _ in range(20_000))
    patterns = K.pack_histogram(histogram, 1024)
    used, containers = sum(n * c for n, c in histogram.items()), sum(c for _, c in patterns)
    assert used / (containers * 1024) > 0.995


def test_work_follows_lengths_not_counts():
    assert len(K.pack_histogram({n: 10**12 for n in range(1, 513)}, 512)) < 5000


def test_counting_in_pieces_is_exact(monkeypatch):
    encode = K.encoder(K.TOKENIZER)
    text = " ".join(f"ord{i} søgning, 12{i}\n" for i in range(400))
    whole = len(encode(text))
    monkeypatch.setattr(K, "PIECE", 100)
    assert K.count_tokens(text, encode) == whole


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_kinds_of_tokenizers(name):
    assert len(K.encoder(f"/opt/tokenizers/{name}")("Der var engang en mand.")) > 4


DOCS = "doc_id long, text string, length int"


def packed(spark, docs, plans):
    d = spark.createDataFrame(docs, DOCS)
    p = spark.createDataFrame(plans, "plan_id int, capacity_tokens int")
    return K.pack(d, p).collect(), {r.doc_id: r.n_tokens for r in K.token_counts(d).collect()}


def test_every_text_once_within_capacity(spark):
    docs = [(i, "ord " * (i % 37), 0) for i in range(300)] + [(1000, None, 0), (1001, "", 0), (1002, "lang " * 5000, 0)] + [(2000 + i, "samme tekst her", 0) for i in range(200)]
    rows, sizes = packed(spark, docs, [(1, 64), (2, 500), (2, 500), (None, 3)])
    for plan, capacity in ((1, 64), (2, 500)):
        fill, parts = Counter(), defaultdict(list)
        for r in rows:
            if r.plan_id == plan:
                fill[r.container_id] += r.length
                parts[r.doc_id].append((r.piece_no, r.tok_start, r.length))
        assert max(fill.values()) <= capacity
        assert sorted(fill) == list(range(len(fill)))
        assert set(parts) == {d for d, n in sizes.items() if n}
        for d, pieces in parts.items():
            pieces.sort()
            assert sum(n for _, _, n in pieces) == sizes[d]
            assert len(pieces) == -(-sizes[d] // capacity)
            assert [s for _, s, _ in pieces] == [i * capacity for i in range(len(pieces))]


def test_empty(spark):
    assert packed(spark, [], [(1, 64)])[0] == []
    assert packed(spark, [(1, "a", 0)], [])[0] == []
