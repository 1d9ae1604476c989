"""New documents as a stream: texts that arrive in a folder become token rows, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions import text as X
from scriptorium.operators import tokens as T
from scriptorium.sources.files import decoded


def start(spark: SparkSession, folder: str, table: str, checkpoint: str, header_lines: int = 0, available_now: bool = True) -> StreamingQuery:
    """Appends ``(doc_id, doc_index, original, loaded_at)`` of every new text file to a Parquet table; the
    id is the file stem. The file sink writes each batch exactly once."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    texts = decoded(raw.select("path", "content"), header_lines).select(X.stem(F.col("path")).alias("doc_id"), "text")
    rows = T.tokenize(texts).withColumn("loaded_at", F.current_timestamp())
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
