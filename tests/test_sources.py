import io
import zipfile

from scriptorium.sources import files as S


def test_texts_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Header: x\nså blå\nord".encode())
    (tmp_path / "b.txt").write_bytes("Header: y\nsmør".encode("cp1252"))
    got = {r.doc_id: (r.header, r.text) for r in S.read_texts(spark, str(tmp_path), 1).collect()}
    assert got == {"a": ("Header: x", "så blå\nord"), "b": ("Header: y", "smør")}


def test_reader_by_type(spark, tmp_path):
    (tmp_path / "doc.txt").write_text("en to\ntre")
    assert [r.original for r in S.reader_for(".txt")(spark, str(tmp_path)).orderBy("doc_index").collect()] == ["en", "to", "tre"]


def test_hocr(spark):
    xml = """<p><span class='ocrx_word' id='word_1_1' title='bbox 1 2 30 40; x_wconf 90'>Once</span>
    <span class="ocrx_word" title="x_wconf 3"><em>up&amp;en</em></span><span class='ocrx_word' title='bbox 5 6 7 8'> </span></p>"""
    got = S.parse_hocr(spark.createDataFrame([("d", xml), ("e", None)], "doc_id string, xml string")).orderBy("doc_index").collect()
    assert [tuple(r) for r in got] == [("d", 0, 1, 2, 30, 40, "Once"), ("d", 1, 0, 0, 0, 0, "up&en")]


def test_words_of_hocr_hold_nested_elements_and_come_back(spark):
    xml = """<div><span class='ocr_line'><span class='x ocrx_word' title='bbox 1 2 3 4'>a<span>b<br>c</span>d</span> <span class='ocrx_word' title='bbox 5 6 7 8'>&lt;e&gt; &amp;</span></span></div>"""
    got = S.parse_hocr(spark.createDataFrame([("d", xml), ("x", ""), ("y", "no words <b")], "doc_id string, xml string")).orderBy("doc_index")
    assert [tuple(r) for r in got.collect()] == [("d", 0, 1, 2, 3, 4, "abcd"), ("d", 1, 5, 6, 7, 8, "<e> &")]
    pages = S.to_hocr(got.withColumn("page", got.doc_index * 0 + 1))
    assert sorted(S.parse_hocr(pages).collect()) == sorted(got.collect())


def test_readers_of_scans(spark, tmp_path):
    words = spark.createDataFrame([("d", 1, 0, 0, 1, 1, "a", 1, 1, 1)], "doc_id string, page int, x0 int, y0 int, x1 int, y1 int, word string, block int, line int, word_no int")
    words.write.parquet(str(tmp_path / "words"))
    assert [r.original for r in S.reader_for(".pdf")(spark, str(tmp_path / "words")).collect()] == ["a"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "page.hocr").write_text("<span class='ocrx_word'>ord</span>")
    assert [(r.doc_id, r.original) for r in S.reader_for(".hocr")(spark, str(tmp_path / "p")).collect()] == [("page", "ord")]


def test_documents_of_any_size_are_written_in_order(spark, tmp_path):
    rows = [("d", i, f"w{i}", None, False) for i in range(9000)] + [("e", 0, "x-", None, True), ("e", 1, "y", None, False)]
    S.write_documents(spark.createDataFrame(rows, "doc_id string, doc_index int, original string, gold string, is_hyphenated boolean"), str(tmp_path / "out"))
    text = lambda d: "".join(p.read_text() for p in sorted((tmp_path / "out" / f"doc_id={d}").glob("part-*")))
    assert text("d").split() == [f"w{i}" for i in range(9000)]
    assert text("e") == "xy "


def test_word_table_in_reading_order(spark):
    rows = [("d", 2, 0, 0, 1, 1, "c", 1, 1, 1), ("d", 1, 0, 0, 1, 1, "b", 1, 1, 2), ("d", 1, 0, 0, 1, 1, "a", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id string, page int, x0 int, y0 int, x1 int, y1 int, word string, block int, line int, word_no int")
    assert [(r.doc_index, r.original) for r in S.from_word_table(df).orderBy("doc_index").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_dictionary_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("places", "By"), ("places", "ås"), ("a/b", "ord"), ("places", "By")], "group_name string, word string")
    S.write_dictionary(d, str(tmp_path / "dict"))
    assert {tuple(r) for r in S.read_dictionary(spark, str(tmp_path / "dict")).collect()} == {("places", "By"), ("places", "ås"), ("a/b", "ord")}


def test_csv_round_trip_keeps_null_and_empty(spark, tmp_path):
    rows = [("d", 0, "a\tb", None), ("d", 1, "", ""), ("d", 2, None, "x")]
    schema = "doc_id string, doc_index int, original string, gold string"
    S.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "t.csv"))
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "t.csv"), schema).collect()), key=lambda r: r[1]) == rows


def test_saving_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    first, second = S.save(df, f"{tmp_path}/x.parquet"), S.save(spark.range(5), f"{tmp_path}/x.parquet")
    assert first != second
    assert S.load(spark, first).count() == 3
    assert S.load(spark, second).count() == 5
    assert S.load(spark, f"{tmp_path}/none.json", default=df).count() == 3


def test_corpus_and_lists(spark):
    files = spark.createDataFrame([("c/a.txt", "så er det"), ("c/.b.txt", "nej"), ("c/c.xml", "<p>ja <i>ord</i></p>"), ("c/d.bin", "x")], "path string, text string")
    assert sorted(r.word for r in S.corpus_words(files, ["e.txt"]).collect()) == ["det", "er", "ja", "ord", "så"]
    lines = spark.createDataFrame([("# list",), ("",), ("x/doc_1.pdf",), ("doc_2.txt",)], "value string")
    assert {(r.doc_id, r.ext) for r in S.document_list(lines).collect()} == {("doc_1", ".pdf"), ("doc_2", ".txt")}


def test_columns_of_ink(spark):
    ink = spark.createDataFrame([("d", x, 9 if x in (10, 50, 90) else 1) for x in range(100)], "doc_id string, x int, ink int")
    assert {(r.section, r.x) for r in S.split_columns(ink).collect()} == {(1, 10), (2, 50), (3, 90)}


def test_ids_get_their_page(spark):
    df = spark.createDataFrame([("word_1_2",)], "id string")
    assert df.select(S.renumber_ids(df.id, 7)).first()[0] == "word_7_2"


def test_corpora_in_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/x.xml", "<p>dyb</p>")
        z.writestr("x.bin", b"no")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("b.txt", "flad")
    (tmp_path / "c.txt").write_text("fri")
    assert sorted(r.text for r in S.read_corpus(spark, str(tmp_path)).collect()) == ["<p>dyb</p>", "flad", "fri"]
    assert sorted(r.word for r in S.corpus_words(S.read_corpus(spark, str(tmp_path))).collect()) == ["dyb", "flad", "fri"]
