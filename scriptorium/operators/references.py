"""Orphan references: rows that name a key which is absent, removed, or arrived only later.

Method. The parent keys are integers inside a group. Sorted, they are compressed into contiguous
runs ``[run_start, run_end]`` whose members share the same attributes; a reference is matched as-of
to the run with the greatest ``run_start`` not above it, and is an orphan if it lies beyond
``run_end``. Runs never cross a range of ``2**bits`` keys, so the as-of match is a window over
``(group, range)``: a group that holds a third of all rows is spread over as many tasks as it has
ranges, both sides use one hash partitioning, and no side is broadcast.

Nulls: a reference with a NULL group or key names nothing and is no orphan; NULL parent keys are
ignored. Repeated rows collapse before any window. Empty parents make every reference ``missing``;
empty references give an empty result. Only the named columns are read, so other columns, whatever
their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.common import block_of

RANGE_BITS = 10


def key_runs(parents: DataFrame, group: str, key: str, attributes: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """Compress distinct integer keys into runs ``(group, rng, run_start, run_end, *attributes)``.

    ``parents`` has one row per ``(group, key)``. Neighbours join a run if the keys are consecutive,
    lie in the same range and all attributes are equal (NULL equals NULL).
    """
    where = Window.partitionBy("grp", "rng").orderBy("key")
    same: Column = F.col("key") == F.lag("key").over(where) + 1
    for name in attributes:
        same = same & F.col(name).eqNullSafe(F.lag(name).over(where))
    return (
        parents.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("key"), *attributes)
        .where(F.col("grp").isNotNull() & F.col("key").isNotNull())
        .withColumn("rng", block_of(F.col("key"), bits))
        .withColumn("opens", F.when(same, 0).otherwise(1))
        .withColumn("run", F.sum("opens").over(where.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("grp", "rng", "run")
        .agg(
            F.min("key").alias("run_start"),
            F.max("key").alias("run_end"),
            *[F.first(name).alias(name) for name in attributes],
        )
        .drop("run")
    )


def asof_runs(references: DataFrame, runs: DataFrame, attributes: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """Match references ``(grp, key, payload)`` to runs; adds ``found`` and the run's ``attributes``.

    The match is the run with the greatest start not above the key; ``found`` is false if there is
    none or the key lies beyond its end.
    """
    run = F.struct("run_start", "run_end", *attributes)
    refs = references.withColumn("rng", block_of(F.col("key"), bits))
    empty = F.lit(None).cast(runs.select(run.alias("r")).schema["r"].dataType)
    payload_type = refs.schema["payload"].dataType
    both = refs.select("grp", "rng", F.col("key").cast("long").alias("key"), "payload", F.lit(1).alias("kind"), empty.alias("run")).unionByName(
        runs.select("grp", "rng", F.col("run_start").alias("key"), F.lit(None).cast(payload_type).alias("payload"), F.lit(0).alias("kind"), run.alias("run"))
    )
    where = Window.partitionBy("grp", "rng").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("run", F.last("run", ignorenulls=True).over(where)).where(F.col("kind") == 1)
    return matched.select(
        "grp",
        "rng",
        "key",
        "payload",
        F.coalesce(F.col("run.run_end") >= F.col("key"), F.lit(False)).alias("found"),
        *[F.col(f"run.{name}").alias(name) for name in attributes],
    )


def split_identifier(identifier: Column) -> tuple[Column, Column]:
    """A text key as ``(group, integer)``, without loss: the closing digits (18 at most) are the
    integer; the group is what precedes them and the number of digits, so leading zeros count.
    """
    digits = F.regexp_extract(identifier, r"([0-9]{1,18})\z", 1)
    size = F.length(digits)
    group = F.concat(F.substring(identifier, F.lit(1), F.length(identifier) - size), F.lit("#"), size.cast("string"))
    return group, F.coalesce(digits.try_cast("long"), F.lit(0))


def catalog_orphans(tokens: DataFrame, catalog: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """``(doc_id, doc_index, loaded_at, reason)`` of tokens whose document is missing, deleted or late.

    The earliest ``loaded_at`` of a token counts. A document is deleted if any of its rows has
    ``removed_at``; its earliest ``added_at`` counts. NULL stamps are never late.
    """
    keys = (
        tokens.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id", "doc_index")
        .agg(F.min("loaded_at").alias("loaded_at"))
        .withColumn("part", block_of(F.col("doc_index"), bits))
    )
    held = (
        catalog.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("added_at").alias("added_at"), F.max(F.col("removed_at").isNotNull()).alias("removed"))
    )
    group, number = split_identifier(F.col("doc_id"))
    runs = key_runs(held.select(group.alias("grp"), number.alias("key"), "added_at", "removed"), "grp", "key", ["added_at", "removed"], bits)
    # One reference per document and key range, not per token: the answer returns by the same two columns.
    parts = tokens.where(F.col("doc_id").isNotNull()).select("doc_id", block_of(F.col("doc_index"), bits).alias("part")).distinct()
    refs = parts.select(group.alias("grp"), number.alias("key"), F.struct("doc_id", "part").alias("payload"))
    status = asof_runs(refs, runs, ["added_at", "removed"], bits).select("payload.doc_id", "payload.part", "found", "added_at", "removed")
    reason = F.when(~F.col("found"), "missing").when(F.col("removed"), "deleted").when(F.col("loaded_at") < F.col("added_at"), "late")
    return keys.join(status, ["doc_id", "part"]).withColumn("reason", reason).where("reason IS NOT NULL").select("doc_id", "doc_index", "loaded_at", "reason")


def token_orphans(kbest: DataFrame, tokens: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """``(doc_id, doc_index, k, loaded_at, reason)`` of candidates whose token is missing or late."""
    parents = tokens.groupBy("doc_id", "doc_index").agg(F.min("loaded_at").alias("first_at"))
    runs = key_runs(parents, "doc_id", "doc_index", ["first_at"], bits)
    refs = (
        kbest.where(F.col("doc_id").isNotNull() & F.col("doc_index").isNotNull())
        .groupBy("doc_id", "doc_index", "k")
        .agg(F.min("loaded_at").alias("loaded_at"))
        .select(F.col("doc_id").alias("grp"), F.col("doc_index").alias("key"), F.struct("k", "loaded_at").alias("payload"))
    )
    reason = F.when(~F.col("found"), "missing").when(F.col("payload.loaded_at") < F.col("first_at"), "late")
    return (
        asof_runs(refs, runs, ["first_at"], bits)
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .select(F.col("grp").alias("doc_id"), F.col("key").cast("int").alias("doc_index"), "payload.k", "payload.loaded_at", "reason")
    )


def orphans(tokens: DataFrame, kbest: DataFrame, catalog: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """All orphan references as ``(ref_table, doc_id, doc_index, k, loaded_at, reason)``; k is 0 for token."""
    columns = ("ref_table", "doc_id", "doc_index", "k", "loaded_at", "reason")
    a = catalog_orphans(tokens, catalog, bits).withColumns({"ref_table": F.lit("token"), "k": F.lit(0)})
    b = token_orphans(kbest, tokens, bits).withColumn("ref_table", F.lit("kbest"))
    return a.select(*columns).unionByName(b.select(*columns))


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Orphans counted per referring table, month of ``loaded_at`` (``yyyy-MM``, NULL if unknown) and reason."""
    return found.groupBy("ref_table", F.date_format("loaded_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
