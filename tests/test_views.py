from scriptorium.operators import views as V

CATALOG = "doc_id string, ext string, original_path string, gold_path string, is_done boolean, added_at timestamp, removed_at timestamp, r string"


def test_catalogue(spark, at):
    rows = [("a", ".txt", "o", "", None, at(1), None, ""), ("a", ".txt", "o", "", None, at(1), None, ""), ("b", ".pdf", "o", "g", True, at(2), None, ""), (None, ".pdf", "o", "g", True, at(2), None, "")]
    held = V.held_documents(spark.createDataFrame(rows, CATALOG))
    assert {r.doc_id: r.is_done for r in held.collect()} == {"a": False, "b": True}
    names = lambda **k: {r.doc_id for r in V.select_documents(held, **k).collect()}
    assert (names(), names(ext=".pdf"), names(done=True), names(done=False), names(only=["a"]), names(exclude=["a"])) == ({"a", "b"}, {"b"}, {"b"}, {"a", "b"}, {"a"}, {"b"})
    more = V.add_documents(held, spark.createDataFrame([("a", ".png"), ("c", ".png"), ("c", ".png")], "doc_id string, ext string"))
    assert {(r.doc_id, r.ext) for r in more.collect()} == {("a", ".txt"), ("b", ".pdf"), ("c", ".png")}
    done = V.mark_done(held, spark.createDataFrame([("a", True)], "doc_id string, done boolean"))
    assert {r.doc_id: r.is_done for r in done.collect()} == {"a": True, "b": True}
    assert V.random_document(held, 3).count() == 1


def test_random_token_is_spread(spark):
    df = spark.createDataFrame([("d", i) for i in range(20)], "doc_id string, doc_index int")
    drawn = {V.random_token(df, df.doc_index % 2 == 0, seed).first().doc_index for seed in range(12)}
    assert len(drawn) > 3
    assert all(i % 2 == 0 for i in drawn)
    assert V.random_token(df, df.doc_index > 99, 1).count() == 0
