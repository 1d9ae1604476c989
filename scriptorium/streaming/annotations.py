"""Annotation events as a stream: each micro-batch is reduced and upserted into a versioned table.

The table lies in buckets of key ranges. A batch reads and writes only the buckets its events touch; a
version is a list of the folder of every bucket, with the last batch of every stream applied so far.
It becomes the newest by a marker under its number that only one writer can create
(``incremental.publish``); so a batch repeated after a restart is passed over, a stream with a new
checkpoint goes on from the newest version, and of two writers at once the second fails and, being
started again, applies its batch to the version of the first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators import annotate
from scriptorium.operators.incremental import BUCKETS, _fs, publish, published

EVENT_SCHEMA = annotate.EVENT
RANGE_BITS = 12


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.shiftright("doc_index", RANGE_BITS)), F.lit(BUCKETS)).cast("int")


def _publish(spark: SparkSession, table: str, number: int, name: str, rows: DataFrame, buckets: dict[str, str], seen: dict[str, int]) -> None:
    """Write the rows of some buckets and the list of all, and make them version ``number``."""
    rows.withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(f"{table}/{name}/rows")
    fs, path = _fs(spark, table)
    out = fs.create(path(f"{table}/{name}/list.json"), False)
    out.write(bytearray(json.dumps({"buckets": buckets, "seen": seen}).encode()))
    out.close()
    publish(spark, table, number, name)


def create(tokens: DataFrame, table: str) -> None:
    """The first version of a table."""
    name = f"v{1:09d}-{uuid.uuid4().hex}"
    every = {str(b): name for b in range(BUCKETS)}
    _publish(tokens.sparkSession, table, 1, name, tokens, every, {})


def newest(spark: SparkSession, table: str) -> tuple[int, dict[str, str], dict[str, int]]:
    """Number, buckets and batches of the newest version."""
    versions = published(spark, table)
    if not versions:
        raise ValueError(f"{table} has no version to begin with")
    known = json.loads(spark.read.text(f"{versions[-1]}/list.json", wholetext=True).first()[0])
    return len(versions), known["buckets"], known["seen"]


def read(spark: SparkSession, table: str, only: list[int] | None = None) -> DataFrame:
    """The newest version of the table, or some of its buckets; a folder is listed once for all of its."""
    _, buckets, _ = newest(spark, table)
    folders: dict[str, list[int]] = {}
    for b, name in buckets.items():
        if only is None or int(b) in only:
            folders.setdefault(name, []).append(int(b))
    parts = None
    for name, some in sorted(folders.items()):
        rows = spark.read.parquet(f"{table}/{name}/rows").where(F.col("bucket").isin(some)).drop("bucket")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def upsert_batch(table: str, source: str):
    """A ``foreachBatch`` function that applies a batch of the stream ``source`` to the newest version."""

    def apply(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        number, buckets, seen = newest(spark, table)
        if seen.get(source, -1) >= batch:
            return  # applied before the restart
        reduced = annotate.reduce_updates(annotate.row_updates(events)).persist()
        touched = sorted(r.b for r in reduced.select(_bucket().alias("b")).distinct().collect() if r.b is not None)  # at most BUCKETS
        if touched:
            name = f"v{number + 1:09d}-{uuid.uuid4().hex}"
            rows = annotate.apply_updates(read(spark, table, touched), reduced)
            _publish(spark, table, number + 1, name, rows, {**buckets, **{str(b): name for b in touched}}, {**seen, source: batch})
        reduced.unpersist()

    return apply


def start(spark: SparkSession, events: str, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Reads JSON events from a folder and keeps ``table`` up to date."""
    stream = spark.readStream.schema(EVENT_SCHEMA).json(events)
    writer = stream.writeStream.foreachBatch(upsert_batch(table, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
