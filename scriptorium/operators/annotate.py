"""Annotators' decisions as events: reduced in order, exploded to the rows they touch, upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X

EVENT = "event_id long, doc_id string, doc_index int, action string, gold string, made_at timestamp_ntz"


def event_action(error: Column, hyphenate: Column, gold: Column, discard: Column) -> Column:
    """What a request does: error before hyphenation before gold before discarding."""
    return F.when(error, "error").when(hyphenate.isNotNull(), F.concat(F.lit("hyphenate-"), hyphenate)).when(gold.isNotNull(), "gold").when(discard, "discard")


def row_updates(events: DataFrame) -> DataFrame:
    """``(doc_id, doc_index, event_id, made_at, set_gold, set_hyphenated, set_discarded, set_error)``: one
    row for every token an event changes.

    ``hyphenate-left`` joins the token with the one before it, ``-right`` with the one after: the
    first is flagged and gets the part before the hyphen with a soft one, the second the rest.
    A gold that does not have exactly one hyphen makes the event void.
    """
    left = F.when(F.col("action") == "hyphenate-left", F.col("doc_index") - 1).otherwise(F.col("doc_index"))
    parts = F.split("gold", "-")
    two = F.col("action").startswith("hyphenate-")
    none_s, none_b = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def update(index: Column, gold: Column = none_s, hyphenated: Column = none_b, discarded: Column = none_b, error: Column = none_b) -> Column:
        return F.struct(index.alias("doc_index"), gold.alias("set_gold"), hyphenated.alias("set_hyphenated"), discarded.alias("set_discarded"), error.alias("set_error"))

    yes = F.lit(True)
    updates = (
        F.when(two & (F.size(parts) == 2), F.array(update(left, F.concat(F.try_element_at(parts, F.lit(1)), F.lit(X.SOFT_HYPHEN)), yes), update(left + 1, F.try_element_at(parts, F.lit(2)))))
        .when(F.col("action") == "gold", F.array(update(F.col("doc_index"), F.col("gold"))))
        .when(F.col("action") == "error", F.array(update(F.col("doc_index"), error=yes)))
        .when(F.col("action") == "discard", F.array(update(F.col("doc_index"), F.lit(""), discarded=yes)))
    )
    return events.select("doc_id", "event_id", "made_at", F.explode(updates).alias("u")).select("doc_id", "u.doc_index", "event_id", "made_at", "u.set_gold", "u.set_hyphenated", "u.set_discarded", "u.set_error")


def reduce_updates(updates: DataFrame) -> DataFrame:
    """One row per token: of every field the value set last, in order of ``made_at`` and ``event_id``."""
    order = F.struct("made_at", "event_id")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return updates.groupBy("doc_id", "doc_index").agg(*[last(f"set_{c}") for c in ("gold", "hyphenated", "discarded", "error")], F.max("made_at").alias("made_at"), F.count("*").alias("n_updates"))


def apply_updates(tokens: DataFrame, reduced: DataFrame) -> DataFrame:
    """The tokens after the updates; a change bumps ``last_modified``, other rows stay as they are."""
    t = tokens.join(reduced, ["doc_id", "doc_index"], "left")
    touched = F.col("n_updates").isNotNull()
    put = lambda new, old: F.coalesce(F.col(new), F.col(old)).alias(old)
    changed = {"gold": put("set_gold", "gold"), "is_hyphenated": put("set_hyphenated", "is_hyphenated"), "is_discarded": put("set_discarded", "is_discarded"), "has_error": put("set_error", "has_error")}
    changed["last_modified"] = F.when(touched, F.col("made_at")).otherwise(F.col("last_modified")).alias("last_modified")
    return t.select(*[changed.get(c, F.col(c)) for c in tokens.columns])


def touched_rows(tokens: DataFrame, reduced: DataFrame) -> DataFrame:
    """Only the tokens an update changes, after the change."""
    return apply_updates(tokens.join(reduced.select("doc_id", "doc_index"), ["doc_id", "doc_index"], "left_semi"), reduced)


def command_updates(commands: DataFrame, tokens: DataFrame, memory: DataFrame) -> DataFrame:
    """Events from the commands of a correction session ``(event_id, doc_id, doc_index, command, arg,
    made_at)``: ``original`` takes the reading, ``shell`` the argument, ``kbest`` and ``kdict`` the
    candidate of that number, ``memoized`` what the reading was mostly corrected to, ``linefeed`` a
    line mark; ``defer`` and ``quit`` change nothing. ``tokens`` has ``kbest``, ``memory`` is
    ``report.memoized``."""
    t = tokens.select("doc_id", "doc_index", "original", "kbest")
    known = memory.select("original", F.col("gold").alias("remembered"))
    joined = commands.join(t, ["doc_id", "doc_index"]).join(known, "original", "left")
    place = F.col("arg").try_cast("int")
    gold = (
        F.when(F.col("command") == "original", F.col("original"))
        .when(F.col("command") == "shell", F.col("arg"))
        .when(F.col("command").isin("kbest", "kdict") & (place > 0), F.try_element_at("kbest", place)["candidate"])
        .when(F.col("command") == "memoized", F.col("remembered"))
        .when(F.col("command") == "linefeed", F.lit("_NEWLINE_N_"))
    )
    return joined.select("event_id", "doc_id", "doc_index", F.lit("gold").alias("action"), gold.alias("gold"), "made_at").where("gold IS NOT NULL")
