"""Readers and writers: running texts, scans' word lists, dictionaries, resources, token tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import tokens as T

SNIFF_BYTES = 500 * 1024


def decode(content: bytes) -> str:
    """Text in UTF-8 or else Windows-1252, decided on the first half MiB; stray bytes are replaced."""
    head = content[:SNIFF_BYTES]
    for encoding in ("utf-8", "cp1252"):
        try:
            # a character cut in two at the end of the sample is no error
            head[: len(head) - 3].decode(encoding) if len(content) > SNIFF_BYTES else content.decode(encoding)
            return content.decode(encoding, errors="replace")
        except UnicodeDecodeError:
            continue
    return content.decode("cp1252", errors="replace")


def decoded(raw: DataFrame, header_lines: int = 0) -> DataFrame:
    """``(path, header, text)`` of files ``(path, content)`` of any supported encoding."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [decode(c) for c in part["content"]]
            lines = [t.split("\n", header_lines) for t in texts]
            yield pd.DataFrame({"path": part["path"], "header": ["\n".join(x[:header_lines]) for x in lines], "text": [x[header_lines] if len(x) > header_lines else "" for x in lines]})

    return raw.mapInPandas(run, "path string, header string, text string")


def read_texts(spark: SparkSession, path: str, header_lines: int = 0) -> DataFrame:
    """``(doc_id, header, text)`` of text files of any supported encoding; the id is the file stem."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return decoded(raw, header_lines).select(X.stem(F.col("path")).alias("doc_id"), "header", "text")


class _Words(HTMLParser):
    """The words of one page: elements of class ``ocrx_word`` with all they contain."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words: list[tuple[list[int], str]] = []
        self.depth, self.box, self.text = 0, [0, 0, 0, 0], ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.depth:
            self.depth += tag not in VOID
        elif "ocrx_word" in (dict(attrs).get("class") or "").split():
            found = re.search(r"bbox (\d+) (\d+) (\d+) (\d+)", dict(attrs).get("title") or "")
            self.depth, self.text = 1, ""
            self.box = [int(x) for x in found.groups()] if found else [0, 0, 0, 0]

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag not in VOID:
            self.depth -= 1
            if not self.depth and self.text.strip():
                self.words.append((self.box, self.text.strip()))

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.text += data


# Elements that have no end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def parse_hocr(pages: DataFrame) -> DataFrame:
    """``(doc_id, doc_index, x0, y0, x1, y1, original)`` of the words of hOCR pages ``(doc_id, xml)``;
    blank words are left out, a box that does not parse is 0. Elements inside a word belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, xml in zip(batch.column("doc_id").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                parser = _Words()
                parser.feed(xml)
                rows = [(doc, i, *(min(x, 2**31 - 1) for x in box), text) for i, (box, text) in enumerate(parser.words)]
                if rows:
                    types = (pa.string(), *[pa.int32()] * 5, pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "doc_index", "x0", "y0", "x1", "y1", "original"])

    known = pages.where("xml IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "xml")
    return known.mapInArrow(run, "doc_id string, doc_index int, x0 int, y0 int, x1 int, y1 int, original string")


def to_hocr(found: DataFrame) -> DataFrame:
    """``(doc_id, page, xml)``: the words of each page ``(doc_id, doc_index, page, x0, y0, x1, y1, original)``
    as an hOCR document."""
    plain = F.col("original")
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        plain = F.replace(plain, F.lit(c), F.lit(entity))
    word = F.format_string("<span class='ocrx_word' id='word_%d' title='bbox %d %d %d %d'>%s</span>", "doc_index", "x0", "y0", "x1", "y1", plain)
    words = F.transform(F.array_sort(F.collect_list(F.struct("doc_index", word.alias("w")))), lambda x: x["w"])
    page = found.where("original IS NOT NULL").groupBy("doc_id", "page").agg(F.array_join(words, "\n").alias("body"))
    return page.select("doc_id", "page", F.concat(F.lit("<html><body><div class='ocr_page'>\n"), "body", F.lit("\n</div></body></html>")).alias("xml"))


def renumber_ids(ids, page: int):
    """Element ids of a page get its number: ``word_1`` becomes ``word_<page>``."""
    return F.regexp_replace(ids, r"(\w)_1", f"$1_{page}")


def split_columns(ink: DataFrame) -> DataFrame:
    """``(doc_id, section, x)``: the fullest column of ink in the outer quarters and the middle."""
    width = F.max("x").alias("w")
    sized = ink.join(ink.groupBy("doc_id").agg(width), "doc_id")
    section = F.when(F.col("x") * 4 < F.col("w"), 1).when(F.col("x") * 4 < F.col("w") * 3, 2).otherwise(3)
    return sized.groupBy("doc_id", section.alias("section")).agg(F.max(F.struct("ink", (-F.col("x")).alias("x"))).alias("m")).select("doc_id", "section", (-F.col("m.x")).alias("x"))


def from_word_table(words: DataFrame) -> DataFrame:
    """Tokens from words extracted elsewhere: ``(doc_id, page, x0, y0, x1, y1, word, block, line,
    word_no)``, numbered in reading order per document and page, so that no window spans a document."""
    w = Window.partitionBy("doc_id", "page").orderBy("block", "line", "word_no", "x0", "word")
    over = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    base = words.groupBy("doc_id", "page").agg(F.count("*").alias("n")).select("doc_id", "page", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    return words.withColumn("rn", F.row_number().over(w)).join(base, ["doc_id", "page"]).select(
        "doc_id", (F.col("base") + F.col("rn") - 1).cast("int").alias("doc_index"), F.col("word").alias("original"), F.struct("page", "x0", "y0", "x1", "y1", "word", "block", "line", "word_no").alias("token_info")
    )


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of scans whose words were extracted elsewhere, stored as a table of words in Parquet."""
    return from_word_table(spark.read.parquet(path))


def read_hocr(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of hOCR files; the id is the file stem."""
    return parse_hocr(read_texts(spark, path).select("doc_id", F.col("text").alias("xml")))


#: Reader per file type; register others under their suffix.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".txt": lambda spark, path: T.tokenize(read_texts(spark, path)),
    ".hocr": read_hocr,
    ".pdf": read_word_table,
    ".tiff": read_word_table,
    ".png": read_word_table,
}


def reader_for(suffix: str) -> Callable[[SparkSession, str], DataFrame]:
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix}; known: {', '.join(sorted(READERS))}")
    return READERS[suffix]


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(group_name, word)`` from a folder with one word list per group, or one written by us."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("word"), F.col("_metadata.file_path").alias("path"))
    # the path is a URI, and the name of a partition folder is escaped before that
    group = F.coalesce(F.nullif(F.url_decode(F.regexp_extract("path", "group_name=([^/]+)/", 1)), F.lit("")), X.stem(F.col("path")))
    return lines.where("word <> ''").select(F.url_decode(group).alias("group_name"), "word")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """One folder per group, its words in order, case ignored; only the groups present are replaced."""
    ordered = dictionary.select("group_name", "word").distinct().repartitionByRange("group_name", F.lower("word")).sortWithinPartitions("group_name", F.lower("word"), "word")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_name").text(path)


def token_csv(tokens: DataFrame, k: int = 4) -> DataFrame:
    """The flat form written as tab-separated values: candidates side by side."""
    at = lambda i, f: F.try_element_at("kbest", F.lit(i))[f]
    flat = [c for i in range(1, k + 1) for c in (at(i, "candidate").alias(f"{i}-best"), at(i, "probability").alias(f"{i}-best prob."))]
    return tokens.select("doc_id", "doc_index", "original", "gold", *flat, "bin", "heuristic", "selection")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("sep", "\t").option("header", True).option("nullValue", "\\N").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "\\N").csv(path)


def load(spark: SparkSession, path: str, schema: str | None = None, default: DataFrame | None = None) -> DataFrame:
    """A table by the suffix of its path: .json, .csv, .txt or .parquet; ``default`` if it is missing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if default is not None and not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return default
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "json":
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if kind == "csv":
        return read_csv(spark, path, schema or "")
    if kind == "txt":
        return spark.read.text(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


def save(df: DataFrame, path: str) -> str:
    """Writes a table by its suffix without touching an existing one: a counter is added to the name."""
    jvm = df.sparkSession.sparkContext._jvm
    base, kind = path.rstrip("/").rsplit(".", 1)
    target, n = path, 0
    while True:
        p = jvm.org.apache.hadoop.fs.Path(target)
        if not p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p):
            break
        n += 1
        target = f"{base}.{n:03d}.{kind}"
    if kind == "csv":
        write_csv(df, target)
    else:
        getattr(df.write, {"txt": "text"}.get(kind, kind))(target)
    return target


def unpacked(name: str, content: bytes, depth: int = 4) -> Iterator[tuple[str, bytes]]:
    """The files in a file: itself, or what an archive holds, archives in archives included."""
    if not name.lower().endswith(".zip"):
        yield name, content
    elif depth:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in sorted(archive.namelist()):
                if not member.endswith("/"):
                    yield from unpacked(f"{name}/{member}", archive.read(member), depth - 1)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of the texts below a folder, those in archives included; one file a row, read
    where Spark places it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows = [(n, decode(c)) for n, c in unpacked(name, content) if n.lower().endswith((".txt", ".xml"))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "text"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, text string")


def corpus_words(files: DataFrame, ignore: list[str] = (), present: DataFrame | None = None) -> DataFrame:
    """``(group_name, word)`` of corpus texts ``(path, text)``: hidden and ignored files are left out,
    groups already present too; a group is named by the digest of its path. Tags are dropped."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    kept = files.where(~name.startswith(".") & ~name.isin(*ignore) & F.regexp_extract("path", r"\.([^./]*)$", 1).isin("txt", "xml"))
    kept = kept.withColumn("group_name", F.md5("path"))
    if present is not None:
        kept = kept.join(present.select("group_name").distinct(), "group_name", "left_anti")
    body = F.regexp_replace("text", "<[^>]*>", " ")
    return kept.select("group_name", F.explode(F.regexp_extract_all(body, F.lit("[\\p{L}\\p{M}\\p{N}'-]+"), F.lit(0))).alias("word"))


def document_list(lines: DataFrame, most: int | None = None) -> DataFrame:
    """``(doc_id, ext, original_path)`` from lines that name files; comments and blank lines are left out."""
    path = F.btrim("value")
    named = lines.where((path != "") & ~path.startswith("#")).select(path.alias("original_path")).distinct()
    out = named.select(X.stem(F.col("original_path")).alias("doc_id"), X.suffix(F.col("original_path")).alias("ext"), "original_path")
    return out.orderBy("doc_id").limit(most) if most is not None else out


def write_documents(tokens: DataFrame, path: str) -> None:
    """The printed text of documents of any size: a folder per document, whose files follow one another
    in the order of their names, each piece with a blank behind it."""
    pieces = T.render(tokens).select("doc_id", "piece", F.col("text").alias("value"))
    ordered = pieces.repartitionByRange("doc_id", "piece").sortWithinPartitions("doc_id", "piece").select("doc_id", "value")
    ordered.write.mode("error").option("lineSep", " ").partitionBy("doc_id").text(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Writes texts ``(doc_id, header, text)``, one folder per document: the header lines, then the body."""
    body = F.when(F.col("header") != "", F.concat("header", F.lit("\n"), "text")).otherwise(F.col("text"))
    texts.select("doc_id", T.text_sink_form(body).alias("value")).write.mode("error").partitionBy("doc_id").text(path)
