"""Processing only new or changed records, found through a Merkle tree over key ranges.

A *state table* has one row per record: ``(doc_id, doc_index, content)`` where ``content`` is any
value to be compared. ``leaf_digests`` hashes the records of every key range of ``2**LEAF_BITS``
indexes of a document; ``build_tree`` hashes digests of ``2**FAN_BITS`` neighbouring ranges into
their parent until one root per document remains. Comparing a current with a saved tree starts at
the roots and descends only below nodes whose digests differ; the leaves reached are the only key
ranges whose records are read and compared one by one.

Digests are two independent 64-bit hashes combined by XOR over distinct keys, so they need no
sorting, aggregate before the shuffle, and no range is ever collected into one value.

Where the saved records lie in the same table as the current ones, both digests of a node are kept
side by side (``paired_levels``), so that nodes are compared without a join.

Between runs a version keeps its output, the records of the leaves that changed, and the nodes of the
tree that changed; a leaf names the version that holds its records. So a run writes in proportion to
the change, and of the saved records it reads only the buckets that hold changed leaves. Output and
tree are published together by one marker under the number of the version, which only one run can
create: a run that dies anywhere, or comes second, leaves the last published version as it is, and
the next run finds exactly the same differences again. Nothing is skipped or repeated.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.common import local_path, stage_table

LEAF_BITS = 7
FAN_BITS = 8
LEVELS = 4  # 7 + 3 * 8 = 31 bits: every non-negative int index is below one root
SALTS = 32


def content_hash(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of the columns; NULL, '' and column positions are told apart."""
    parts = [x for c in columns for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (17, 40503)]


def leaf_digests(state: DataFrame, content: str = "content") -> DataFrame:
    """Level 0 of the tree: ``(doc_id, level, node, h1, h2)`` per key range that holds records."""
    h1, h2 = content_hash(F.col("doc_index"), F.col(content))
    return (
        state.select("doc_id", F.shiftright("doc_index", LEAF_BITS).alias("node"), h1.alias("h1"), h2.alias("h2"))
        .groupBy("doc_id", "node")
        .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        .select("doc_id", F.lit(0).alias("level"), "node", "h1", "h2")
    )


def parent_level(nodes: DataFrame, level: int) -> DataFrame:
    """Digests of level ``level`` from those of the level below."""
    h1, h2 = content_hash(F.col("node"), F.col("h1"), F.col("h2"))
    return (
        nodes.select("doc_id", F.shiftright("node", FAN_BITS).alias("up"), h1.alias("h1"), h2.alias("h2"))
        .groupBy("doc_id", "up")
        .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
        .select("doc_id", F.lit(level).alias("level"), F.col("up").alias("node"), "h1", "h2")
    )


def build_tree(state: DataFrame, content: str = "content", levels: int = LEVELS) -> list[DataFrame]:
    """The levels of the tree, leaves first; the last level has one root per document.

    The leaves are written to the shared folder, since every level above and the descent read them.
    """
    tree = [stage_table(leaf_digests(state, content), "tree")]
    for level in range(1, levels):
        tree.append(parent_level(tree[-1], level))
    return tree


def differing(current: DataFrame, saved: DataFrame) -> DataFrame:
    """``(doc_id, node)`` present in only one of the two levels or with other digests."""
    a = current.select("doc_id", "node", F.struct("h1", "h2").alias("now"))
    b = saved.select("doc_id", "node", F.struct("h1", "h2").alias("then"))
    return a.join(b, ["doc_id", "node"], "full_outer").where(~F.col("now").eqNullSafe(F.col("then"))).select("doc_id", "node")


def changed_nodes(current: list[DataFrame], saved: list[DataFrame]) -> list[DataFrame]:
    """``(doc_id, node)`` of the nodes that differ, level by level, leaves first. Descends from the roots:
    at each level only children of nodes that differ above are compared."""
    top = differing(current[-1], saved[-1])
    found = [top]
    for now, then in zip(current[-2::-1], saved[-2::-1], strict=True):
        def below(level: DataFrame, top: DataFrame = top) -> DataFrame:
            up = level.withColumn("up", F.shiftright("node", FAN_BITS))
            return up.join(top.select("doc_id", F.col("node").alias("up")), ["doc_id", "up"], "left_semi")

        top = differing(below(now), below(then))
        found.append(top)
    return found[::-1]


def changed_leaves(current: list[DataFrame], saved: list[DataFrame]) -> DataFrame:
    return changed_nodes(current, saved)[0]


def rows_of_leaves(state: DataFrame, leaves: DataFrame) -> DataFrame:
    """The records of the named key ranges."""
    keyed = state.withColumn("node", F.shiftright("doc_index", LEAF_BITS))
    return keyed.join(leaves, ["doc_id", "node"], "left_semi").drop("node")


def read_marks(sync_log: DataFrame) -> DataFrame:
    """``(doc_id, seen)``: up to which load stamp a successful run has read each document."""
    return (
        sync_log.where((F.col("state") == "ok") & F.col("read_upto").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("read_upto").alias("seen"))
    )


def token_states(tokens: DataFrame, sync_log: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(doc_id, doc_index, now, then)``: the current row of each token, over all delivered rows and
    over those the last successful run could see; ``then`` is NULL if it saw none.

    The current row has the greatest ``last_modified`` (NULL lowest), then ``loaded_at``, then, for
    a defined result, ``gold``. The read marks are joined on the document and a salt taken from the
    key range, so the rows of a very large document go to ``salts`` tasks. Rows with a NULL key are
    no records. A row with NULL ``loaded_at`` was not seen by any run.
    """
    salt = F.pmod(F.shiftright("doc_index", LEAF_BITS), F.lit(salts))
    rows = tokens.where(F.col("doc_id").isNotNull() & F.col("doc_index").isNotNull()).select(
        "doc_id", "doc_index", "gold", "last_modified", "loaded_at", salt.alias("salt")
    )
    marks = read_marks(sync_log).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    order = F.struct("last_modified", "loaded_at", "gold")
    content = F.struct("row.gold", "row.last_modified")
    return (
        rows.join(marks, ["doc_id", "salt"], "left")
        .groupBy("doc_id", "doc_index")
        .agg(F.max(order).alias("a"), F.max(F.when(F.col("loaded_at") <= F.col("seen"), order)).alias("b"))
        .select("doc_id", "doc_index", F.struct("a.gold", "a.last_modified").alias("now"), F.when(F.col("b").isNotNull(), F.struct("b.gold", "b.last_modified")).alias("then"))
    )


def paired_levels(state: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The levels ``(doc_id, node, now, then)`` of the trees of both states of ``(doc_id, doc_index, now,
    then)``, leaves first. A digest is ``(h1, h2, n)``, with the number of records or nodes in it."""

    def level(rows: DataFrame, node: Column, parts: dict[str, list[Column]], present: dict[str, Column]) -> DataFrame:
        hashes = [F.when(present[side], h).otherwise(F.lit(0)).alias(f"{side}{i}") for side, pair in parts.items() for i, h in enumerate(pair)]
        counted = [present[side].cast("int").alias(f"{side}_n") for side in parts]
        sums = [F.struct(F.bit_xor(f"{side}0").alias("h1"), F.bit_xor(f"{side}1").alias("h2"), F.sum(f"{side}_n").alias("n")).alias(side) for side in parts]
        return rows.select("doc_id", node.alias("node"), *hashes, *counted).groupBy("doc_id", "node").agg(*sums)

    sides = ("now", "then")
    out = [stage_table(level(state, F.shiftright("doc_index", LEAF_BITS), {c: content_hash(F.col("doc_index"), F.col(c)) for c in sides}, {c: F.col(c).isNotNull() for c in sides}), "leaves")]
    for _ in range(1, levels):
        below = out[-1]
        out.append(stage_table(level(below, F.shiftright("node", FAN_BITS), {c: content_hash(F.col("node"), F.col(f"{c}.h1"), F.col(f"{c}.h2")) for c in sides}, {c: F.col(f"{c}.n") > 0 for c in sides}), "level"))
    return out


def descend(levels: list[DataFrame]) -> DataFrame:
    """``(doc_id, node)`` of the leaves whose digests differ, looked for only below nodes that differ."""
    differs = lambda df: df.where("now <> then").select("doc_id", "node")
    top = differs(levels[-1])
    for below in levels[-2::-1]:
        children = below.withColumn("up", F.shiftright("node", FAN_BITS)).join(top.withColumnRenamed("node", "up"), ["doc_id", "up"], "left_semi")
        top = differs(children)
    return top


def changed_tokens(tokens: DataFrame, sync_log: DataFrame) -> DataFrame:
    """``(doc_id, doc_index, gold, last_modified, kind)`` of tokens new or changed since the last
    successful run over their document; ``kind`` is ``new`` or ``changed``.

    The saved tree is that of the state the last successful run saw, so failed and running attempts
    and runs out of order have no influence. Differing leaves name the only key ranges compared
    token by token.
    """
    state = stage_table(token_states(tokens, sync_log), "states")
    leaves = stage_table(descend(paired_levels(state)), "changed")
    kind = F.when(F.col("then").isNull(), "new").otherwise("changed")
    return (
        rows_of_leaves(state, leaves)
        .where(~F.col("now").eqNullSafe(F.col("then")))
        .select("doc_id", "doc_index", "now.gold", "now.last_modified", kind.alias("kind"))
    )


# ---------------------------------------------------------------------------------------------
# State kept between runs

BUCKETS = 256
#: File systems where a file appears whole when it is closed, and where a rename is no single step.
OBJECT_STORES = {"s3", "s3a", "gs", "abfs", "abfss", "wasb", "wasbs"}


class AlreadyPublished(RuntimeError):
    """Another run has published the version this one was to become."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def published(spark: SparkSession, root: str) -> list[str]:
    """The folders of the published versions below ``root``, the first first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    marks = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path(root))) if n.startswith("v") and n.endswith(".ok"))
    return [f"{root}/{spark.read.text(f'{root}/{m}').first()[0]}" for m in marks]


def publish(spark: SparkSession, root: str, number: int, name: str) -> None:
    """Make the finished folder ``name`` version ``number``, by a marker that holds its name and that
    exists whole or not at all; raises ``AlreadyPublished`` if another run has taken the number."""
    fs, path = _fs(spark, root)
    marker, draft = f"{root}/v{number:09d}.ok", f"{root}/{name}.draft"

    def written(target: str, overwrite: bool) -> None:
        out = fs.create(path(target), overwrite)
        out.write(bytearray(name.encode()))
        out.close()

    if fs.exists(path(marker)):
        raise AlreadyPublished(marker)
    try:
        if fs.getScheme() in OBJECT_STORES:
            written(marker, False)
            return
        written(draft, True)
        if fs.getScheme() == "file":
            os.link(local_path(draft), local_path(marker))
            fs.delete(path(draft), False)
        else:
            jvm = spark.sparkContext._jvm
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path(draft), path(marker), options)
    except (FileExistsError, Py4JJavaError) as e:
        if fs.exists(path(marker)):
            raise AlreadyPublished(marker) from e
        raise


TREE_SCHEMA = "doc_id string, level int, node int, h1 bigint, h2 bigint, version string, gone boolean"


def load_tree(spark: SparkSession, versions: list[str], levels: int = LEVELS) -> list[DataFrame]:
    """The last tree: of every node the row of the last version that changed it. ``version`` names the
    folder of that version, which for a leaf holds its records."""
    rows = None
    for n, version in enumerate(versions):
        part = spark.read.schema(TREE_SCHEMA).parquet(f"{version}/tree").withColumn("n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    last = rows.groupBy("doc_id", "level", "node").agg(F.max_by(F.struct("h1", "h2", "version", "gone"), "n").alias("r"))
    last = stage_table(last.where("NOT r.gone").select("doc_id", "level", "node", "r.h1", "r.h2", "r.version"), "saved")
    return [last.where(F.col("level") == level) for level in range(levels)]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id", "node"), F.lit(BUCKETS)).cast("int").alias("bucket")


def rows_of_saved_leaves(spark: SparkSession, root: str, leaves: DataFrame) -> DataFrame:
    """The saved records ``(doc_id, doc_index, content)`` of leaves ``(doc_id, node, version)``; only the
    buckets that hold one are read. The list of them has at most ``BUCKETS`` entries a version."""
    places: dict[str, list[int]] = {}
    for r in leaves.select("version", _bucket()).distinct().collect():
        places.setdefault(r.version, []).append(r.bucket)
    parts = None
    for version, buckets in sorted(places.items()):
        rows = spark.read.parquet(f"{root}/{version}/state").where(F.col("bucket").isin(sorted(buckets)))
        rows = rows.join(leaves.where(F.col("version") == version).select("doc_id", "node"), ["doc_id", "node"], "left_semi").select("doc_id", "doc_index", "content")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def run_once(state: DataFrame, root: str, content: str = "content") -> DataFrame:
    """One incremental run over ``(doc_id, doc_index, content)``: the records new, changed or gone
    since the last published version, published together with what changed in the tree.

    Returns the published output ``(doc_id, doc_index, content, kind)``. Raises ``AlreadyPublished`` if
    another run was faster; nothing of this one is then seen, and the next run starts from that.
    """
    spark = state.sparkSession
    versions = published(spark, root)
    number = len(versions) + 1
    name = f"v{number:09d}-{uuid.uuid4().hex}"
    folder = f"{root}/{name}"
    rows = state.select("doc_id", "doc_index", F.shiftright("doc_index", LEAF_BITS).alias("node"), F.col(content).alias("content"))
    tree = build_tree(rows)
    if versions:
        saved = load_tree(spark, versions)
        changed = [stage_table(df, "changed") for df in changed_nodes(tree, saved)]
        leaves = changed[0]
        now_rows = rows.join(leaves, ["doc_id", "node"], "left_semi")
        old = rows_of_saved_leaves(spark, root, saved[0].join(leaves, ["doc_id", "node"], "left_semi"))
        one = lambda df, c: df.select("doc_id", "doc_index", F.struct(F.col("content").alias("v")).alias(c))
        then = one(old, "then") if old is not None else one(rows.limit(0), "then")
        kind = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed")
        output = one(now_rows, "now").join(then, ["doc_id", "doc_index"], "full_outer").where(~F.col("now").eqNullSafe(F.col("then"))).select("doc_id", "doc_index", F.col("now.v").alias("content"), kind.alias("kind"))
        nodes = None
        for level, (current, ids) in enumerate(zip(tree, changed, strict=True)):
            part = ids.join(current.drop("level"), ["doc_id", "node"], "left").select("doc_id", F.lit(level).alias("level"), "node", "h1", "h2", F.col("h1").isNull().alias("gone"))
            nodes = part if nodes is None else nodes.unionByName(part)
    else:
        now_rows, nodes = rows, None
        output = rows.select("doc_id", "doc_index", "content", F.lit("new").alias("kind"))
        for current in tree:
            part = current.withColumn("gone", F.lit(False))
            nodes = part if nodes is None else nodes.unionByName(part)
    output.write.parquet(f"{folder}/output")
    now_rows.select("*", _bucket()).write.partitionBy("bucket").parquet(f"{folder}/state")
    nodes.select("doc_id", "level", "node", "h1", "h2", F.lit(name).alias("version"), "gone").write.parquet(f"{folder}/tree")
    publish(spark, root, number, name)
    return spark.read.parquet(f"{folder}/output")
