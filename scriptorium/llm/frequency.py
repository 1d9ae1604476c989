"""Occurrences and records of every distinct value, by recursive radix spilling.

Two rounds of the same operator. Round one partitions rows by the top hash bits of
``(field, value, record)`` and counts them; round two partitions the partial sums by the top hash
bits of ``(field, value)`` and adds them up. A value found in a third of all rows is spread over all
partitions in round one and arrives in round two as at most one row per partition of round one, so
neither a hot value nor a hot record ever meets in one task.

Inside a task the rows of its partition stream in. While they fit into ``limit`` bytes they are one
leaf; beyond that equal keys are united first, and if that does not halve them they are spilled to
files by the next ``FAN_BITS`` hash bits, and every file is treated the same way again, down to the
last bit. A leaf is aggregated by DuckDB, which works out of core beside the files where that is a
path it can open. Before the first shuffle runs of input batches are aggregated by DuckDB as well.
Spill files lie in the shared folder the cluster names, on whatever file system that is, one folder
per task attempt, removed when the attempt ends either way.

Defined results: NULL and '' are no values. A NULL record adds an occurrence, but no record.
Values are compared exactly as stored. Empty input gives an empty result.
"""

from __future__ import annotations

import posixpath
import shutil
import uuid
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.common import scratch_dir

LIMIT_BYTES = 32 << 20
FAN_BITS = 4
MEMORY_MB = 256
CHUNK_ROWS = 200_000
RARE_BELOW = 3
COMMON_ABOVE_PERCENT = 30

# hash bits are taken from the top: the first ROOT_BITS choose the partition, then FAN_BITS a level
ROOT_BITS = 16

Aggregate = Callable[[pa.Table], pa.Table]
Batches = Iterator[pa.RecordBatch]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder, as the cluster names it."""
    scheme, colon, rest = uri.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    if colon and scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _connection(folder: str, memory_mb: int) -> duckdb.DuckDBPyConnection:
    """``folder``: where DuckDB may write, '' for nowhere."""
    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute(f"SET memory_limit = '{memory_mb}MB'")
    con.execute("SET temp_directory = '" + folder.replace("'", "''") + "'")
    con.execute("SET preserve_insertion_order = false")
    return con


def _aggregate(con: duckdb.DuckDBPyConnection, sql: str) -> Aggregate:
    """``sql`` over a table named ``leaf``."""

    def run(table: pa.Table) -> pa.Table:
        con.register("leaf", table)
        try:
            return con.sql(sql).to_arrow_table()
        finally:
            con.unregister("leaf")

    return run


class Spill:
    """A folder for the files of one task attempt; made, and its file system opened, when the first file
    is written; removed with all."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs: pafs.FileSystem | None = None
        self.folder = ""
        self.name = f"radix-{uuid.uuid4().hex}"
        self.files = 0

    def local(self) -> str:
        """The folder, if DuckDB can open it."""
        scheme, colon, rest = self.uri.partition(":")
        return posixpath.join("/" + rest.lstrip("/") if colon else self.uri, self.name) if scheme == "file" or not colon else ""

    def new(self) -> str:
        if self.fs is None:
            self.fs, base = file_system(self.uri)
            self.folder = posixpath.join(base, self.name)
            self.fs.create_dir(self.folder, recursive=True)
        self.files += 1
        return posixpath.join(self.folder, f"{self.files:06d}.arrow")

    def close(self) -> None:
        if self.fs is not None:
            # where DuckDB spilled first, the folder is its own, and gone when its connection is closed
            if self.fs.get_file_info(self.folder).type != pafs.FileType.NotFound:
                self.fs.delete_dir(self.folder)
        elif self.local():
            shutil.rmtree(self.local(), ignore_errors=True)  # of DuckDB


class Parts:
    """The spill files of one level, by the next hash bits."""

    def __init__(self, spill: Spill, shift: int):
        self.spill, self.shift = spill, shift
        self.open: dict[int, tuple[str, pa.NativeFile, pa.RecordBatchStreamWriter]] = {}

    def write(self, table: pa.Table) -> None:
        digits = (table.column("h").to_numpy().view("uint64") >> np.uint64(self.shift)) & np.uint64((1 << FAN_BITS) - 1)
        order = np.argsort(digits, kind="stable")
        table, digits = table.take(pa.array(order)), digits[order]
        starts = np.flatnonzero(np.r_[True, digits[1:] != digits[:-1]])
        for a, b in zip(starts, [*starts[1:], len(digits)], strict=True):
            d = int(digits[a])
            if d not in self.open:
                path = self.spill.new()
                sink = self.spill.fs.open_output_stream(path)
                self.open[d] = path, sink, pa.ipc.new_stream(sink, table.schema)
            self.open[d][2].write_table(table.slice(a, b - a))

    def read(self) -> Iterator[Batches]:
        for _, sink, writer in self.open.values():
            writer.close()
            sink.close()
        for d in sorted(self.open):
            path = self.open[d][0]
            with self.spill.fs.open_input_stream(path) as source:
                yield iter(pa.ipc.open_stream(source))
            self.spill.fs.delete_file(path)


def _leaves(batches: Batches, spill: Spill, used_bits: int, limit: int, unite: Aggregate) -> Iterator[pa.Table]:
    """Tables of at most about ``limit`` bytes in which no key is divided; recursive over the hash bits.

    What is held is united by key before it is spilled, so a key found over and over takes one row.
    Spark marks columns that hold no NULL, DuckDB does not, and Arrow neither joins nor writes tables that
    differ in such marks; so all take the schema without them.
    """
    held: list[pa.RecordBatch] = []
    size, parts = 0, None
    shift = 64 - used_bits - FAN_BITS
    for batch in batches:
        schema = pa.schema([pa.field(f.name, f.type) for f in batch.schema])
        held.append(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
        size += batch.nbytes
        if size > limit:
            table = unite(pa.Table.from_batches(held)).cast(schema)
            if shift >= 0 and table.nbytes * 2 > limit:
                parts = parts or Parts(spill, shift)
                parts.write(table)
                held, size = [], 0
            else:
                # keys that agree in all 64 bits cannot be parted: they are few, and stay united
                held, size = table.to_batches(), table.nbytes if shift >= 0 else 0
    if parts is None:
        if held:
            yield pa.Table.from_batches(held)
        return
    if held:
        parts.write(pa.Table.from_batches(held))
    for part in parts.read():
        yield from _leaves(part, spill, used_bits + FAN_BITS, limit, unite)


def _radix_aggregate(sql: str, unite: str, spill_uri: str, limit: int, memory_mb: int) -> Callable[[Batches], Batches]:
    """A ``mapInArrow`` function: leaves of the partition, each aggregated by ``sql`` over ``leaf``;
    ``unite`` adds up the rows of equal keys and keeps the columns."""

    def run(batches: Batches) -> Batches:
        spill = Spill(spill_uri)
        con = _connection(spill.local(), memory_mb)
        try:
            for leaf in _leaves(batches, spill, ROOT_BITS, limit, _aggregate(con, unite)):
                yield from _aggregate(con, sql)(leaf).to_batches(max_chunksize=50_000)
        finally:
            con.close()
            spill.close()

    return run


def _batch_aggregate(sql: str, limit: int, memory_mb: int) -> Callable[[Batches], Batches]:
    """Aggregate runs of rows as they stream in; keys may recur between runs."""

    def run(batches: Batches) -> Batches:
        con, held, rows, size = _connection("", memory_mb), [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= CHUNK_ROWS or size > limit:
                yield from _aggregate(con, sql)(pa.Table.from_batches(held)).to_batches(max_chunksize=50_000)
                held, rows, size = [], 0, 0
        if held:
            yield from _aggregate(con, sql)(pa.Table.from_batches(held)).to_batches(max_chunksize=50_000)
        con.close()

    return run


def _by_radix(df: DataFrame, partitions: int) -> DataFrame:
    """Rows with the same top ROOT_BITS of ``h`` in one partition."""
    return df.repartition(partitions, F.shiftrightunsigned("h", 64 - ROOT_BITS))


def term_frequencies(values: DataFrame, limit: int = LIMIT_BYTES, memory_mb: int = MEMORY_MB, partitions: int | None = None) -> DataFrame:
    """``(field_name, term, n, n_docs)`` from rows ``(field_name, term, doc_id)``."""
    spark = values.sparkSession
    spill = scratch_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = values.where("term IS NOT NULL AND term <> ''").select("field_name", "term", "doc_id")
    first = rows.mapInArrow(
        _batch_aggregate("SELECT field_name, term, doc_id, count(*)::BIGINT AS n FROM leaf GROUP BY ALL", limit, memory_mb),
        "field_name string, term string, doc_id string, n bigint",
    )
    pairs = first.withColumn("h", F.xxhash64("field_name", "term", "doc_id"))
    inner = "SELECT field_name, term, doc_id, sum(n)::BIGINT AS n, h FROM leaf GROUP BY ALL"
    counted = _by_radix(pairs, parts).mapInArrow(
        _radix_aggregate(f"SELECT field_name, term, sum(n)::BIGINT AS n, count(doc_id)::BIGINT AS n_docs FROM ({inner}) GROUP BY ALL", inner, spill, limit, memory_mb),
        "field_name string, term string, n bigint, n_docs bigint",
    )
    sums = counted.withColumn("h", F.xxhash64("field_name", "term"))
    outer = "sum(n)::BIGINT AS n, sum(n_docs)::BIGINT AS n_docs"
    return _by_radix(sums, parts).mapInArrow(
        _radix_aggregate(f"SELECT field_name, term, {outer} FROM leaf GROUP BY ALL", f"SELECT field_name, term, {outer}, h FROM leaf GROUP BY ALL", spill, limit, memory_mb),
        "field_name string, term string, n bigint, n_docs bigint",
    )


def field_terms(tokens: DataFrame, kbest: DataFrame) -> DataFrame:
    """Rows ``(field_name, term, doc_id)`` of the two token fields and of the candidates."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("term")) for f in ("original", "gold")])
    a = tokens.select("doc_id", F.explode(pairs).alias("p")).select("p.field_name", "p.term", "doc_id")
    return a.unionByName(kbest.select(F.lit("candidate").alias("field_name"), F.col("candidate").alias("term"), "doc_id"))


def record_counts(tokens: DataFrame, kbest: DataFrame) -> DataFrame:
    """``(field_name, n_records)``: distinct ``doc_id`` of the table each field belongs to."""
    docs = tokens.select("doc_id").distinct().select(F.lit("token").alias("t"), "doc_id").unionByName(kbest.select("doc_id").distinct().select(F.lit("kbest").alias("t"), "doc_id"))
    totals = docs.groupBy("t").agg(F.count("doc_id").alias("n_records"))
    names = F.when(F.col("t") == "token", F.array(F.lit("original"), F.lit("gold"))).otherwise(F.array(F.lit("candidate")))
    return totals.select(F.explode(names).alias("field_name"), "n_records")


def marked_terms(tokens: DataFrame, kbest: DataFrame, rare_below: int = RARE_BELOW, common_above_percent: int = COMMON_ABOVE_PERCENT, **options) -> DataFrame:
    """``(field_name, term, n, n_docs, mark)`` of every distinct value; ``mark`` is ``rare``,
    ``common`` or NULL. The three totals joined are three rows, whatever the input."""
    counts = term_frequencies(field_terms(tokens, kbest), **options)
    totals = F.broadcast(record_counts(tokens, kbest))
    mark = F.when(F.col("n_docs") < rare_below, "rare").when(F.col("n_docs") * 100 > F.col("n_records") * common_above_percent, "common")
    return counts.join(totals, "field_name").select("field_name", "term", "n", "n_docs", mark.alias("mark"))
