import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotate as A
from scriptorium.operators import index, report
from scriptorium.streaming import annotations, ingest

SHY = "­"
SCHEMA = "doc_id string, doc_index int, original string, gold string, is_hyphenated boolean, is_discarded boolean, has_error boolean, heuristic string, bin int, selection string, last_modified timestamp_ntz"


def tokens(spark, text):
    return spark.createDataFrame([("abc", i, w, None, False, False, False, None, None, None, None) for i, w in enumerate(text.split())], SCHEMA)


def after(spark, events, text=f"Once upen a ti{SHY} me"):
    rows = [(i, "abc", *e, at) for i, (*e, at) in enumerate(events)]
    reduced = A.reduce_updates(A.row_updates(spark.createDataFrame(rows, A.EVENT)))
    return {r.doc_index: r for r in A.apply_updates(tokens(spark, text), reduced).collect()}


def test_hyphenation_from_both_sides(spark, at):
    for index_, action in ((4, "hyphenate-left"), (3, "hyphenate-right")):
        t = after(spark, [(index_, action, "ti-me", at(1))])
        assert (t[3].gold, t[4].gold, t[3].is_hyphenated, t[4].is_hyphenated) == (f"ti{SHY}", "me", True, False)
        assert t[3].last_modified == at(1)
        assert t[0].last_modified is None


def test_void_hyphenation(spark, at):
    t = after(spark, [(3, "hyphenate-right", "t-i-me", at(1)), (3, "hyphenate-right", "time", at(1)), (3, "hyphenate-right", None, at(1))])
    assert t[3].gold is None
    assert t[3].last_modified is None


def test_the_last_decision_wins(spark, at):
    t = after(spark, [(1, "gold", "upan", at(2)), (1, "gold", "upon", at(3)), (1, "gold", "open", at(1)), (0, "discard", None, at(1)), (2, "error", None, at(1))])
    assert (t[1].gold, t[1].last_modified) == ("upon", at(3))
    assert (t[0].gold, t[0].is_discarded) == ("", True)
    assert t[2].has_error


def test_order_of_actions(spark):
    df = spark.createDataFrame([(True, "left", "g", True), (False, "left", "g", True), (False, None, "g", True), (False, None, None, True), (False, None, None, False)], "e boolean, h string, g string, d boolean")
    got = [r[0] for r in df.select(A.event_action(df.e, df.h, df.g, df.d)).collect()]
    assert got == ["error", "hyphenate-left", "gold", "discard", None]


def event(folder, n, doc_index, gold):
    (folder / f"{n}.json").write_text(json.dumps({"event_id": n, "doc_id": "abc", "doc_index": doc_index, "action": "gold", "gold": gold, "made_at": f"2024-01-01T00:0{n}:00"}))


def golds(spark, table):
    return [r.gold for r in annotations.read(spark, table).orderBy("doc_index").collect()]


def test_stream(spark, tmp_path):
    table, events = str(tmp_path / "table"), tmp_path / "events"
    events.mkdir()
    with pytest.raises(ValueError, match="no version"):
        annotations.newest(spark, table)
    annotations.create(tokens(spark, "a b c"), table)
    for n, (doc_index, gold) in enumerate(((0, "x"), (1, "y"))):
        event(events, n, doc_index, gold)
        annotations.start(spark, str(events), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert annotations.newest(spark, table)[0] == 3
    assert golds(spark, table) == ["x", "y", None]
    # another stream with a checkpoint of its own begins with batch 0 and changes what is newest
    more = tmp_path / "more"
    more.mkdir()
    event(more, 5, 2, "z")
    annotations.start(spark, str(more), table, str(tmp_path / "other")).awaitTermination()
    assert golds(spark, table) == ["x", "y", "z"]
    # a batch that comes again after a restart changes nothing
    again = spark.read.schema(annotations.EVENT_SCHEMA).json(str(more))
    annotations.upsert_batch(table, str(tmp_path / "other"))(again, 0)
    assert annotations.newest(spark, table)[0] == 4


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = tokens(spark, "a").crossJoin(spark.range(30).select((F.col("id") * 5000).cast("int").alias("at"))).withColumn("doc_index", F.col("at")).drop("at")
    annotations.create(rows, table)
    events = tmp_path / "events"
    events.mkdir()
    event(events, 1, 5000, "x")
    annotations.upsert_batch(table, "s")(spark.read.schema(annotations.EVENT_SCHEMA).json(str(events)), 0)
    last = annotations.published(spark, table)[-1]
    assert spark.read.parquet(f"{last}/rows").count() < 5
    assert annotations.read(spark, table).count() == 30


def test_new_documents_as_a_stream(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "tokens")
    folder.mkdir()
    for name, text in (("a", "en to"), ("b", "tre")):
        (folder / f"{name}.txt").write_text(text)
        ingest.start(spark, str(folder), table, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(table).orderBy("doc_id", "doc_index").collect()
    assert [(r.doc_id, r.doc_index, r.original) for r in got] == [("a", 0, "en"), ("a", 1, "to"), ("b", 0, "tre")]


def test_runs_of_terms(spark):
    rows = [("d", i, w, t) for i, (w, t) in enumerate([("New", ["p"]), ("York", ["p", "q"]), ("is", None), ("York", ["p"]), ("and", None), ("Old", ["q"]), ("Town", ["q"])])]
    found = index.runs(spark.createDataFrame(rows, "doc_id string, doc_index int, word string, tags array<string>")).orderBy("first_index").collect()
    assert [tuple(r) for r in found] == [("d", 0, 1, "New York", "p p+q"), ("d", 5, 6, "Old Town", "q q")]


def test_report_and_its_settings(spark):
    rows = [("aa", "aa", False), (".", None, False), ("b", "", False), ("", "x", False), ("c", None, True), ("", None, False), (None, "x", False)]
    total = report.totals(spark.createDataFrame(rows, "original string, gold string, is_hyphenated boolean")).first().asDict()
    assert total == {"total": 7, "hyphenated": 1, "punctuation": 1, "undersegmented": 1, "oversegmented": 1, "nogold": 1, "malformed": 2, "token_count": 2}
    bins = [{"bin": 2, "total": 10, "gold_is_original": 9, "gold_is_top": 1, "gold_is_lower": 0}, {"bin": 1, "total": 10, "gold_is_original": 2, "gold_is_top": 1, "gold_is_lower": 0}]
    assert report.settings_of(report.lines(total, bins)) == {1: "annotator", 2: "original"}


def test_memoized(spark):
    counts = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("d", "e", 1)], "original string, gold string, n long")
    assert {tuple(r) for r in report.memoized(counts).collect()} == {("a", "b"), ("d", "e")}
    assert {tuple(r) for r in report.memoized(counts, least_frequent=True).collect()} == {("a", "c"), ("d", "e")}


def test_commands_of_a_session(spark, at):
    tokens_ = spark.createDataFrame([("d", i, w, [(1, "k1", 0.5), (2, "k2", 0.1)]) for i, w in enumerate("abcdefg")], "doc_id string, doc_index int, original string, kbest array<struct<k:int,candidate:string,probability:double>>")
    commands = [(0, "original", None), (1, "shell", "ny"), (2, "kbest", "1"), (3, "kdict", "2"), (4, "memoized", None), (5, "linefeed", None), (6, "defer", None), (6, "quit", None), (6, "kbest", "9"), (6, "kbest", "x")]
    df = spark.createDataFrame([(n, "d", i, c, a, at(n)) for n, (i, c, a) in enumerate(commands)], "event_id long, doc_id string, doc_index int, command string, arg string, made_at timestamp_ntz")
    memory = spark.createDataFrame([("e", "husket")], "original string, gold string")
    got = {r.doc_index: r.gold for r in A.command_updates(df, tokens_, memory).collect()}
    assert got == {0: "a", 1: "ny", 2: "k1", 3: "k2", 4: "husket", 5: "_NEWLINE_N_"}
