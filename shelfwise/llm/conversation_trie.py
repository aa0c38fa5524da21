"""Prefix trie of conversations, built as a burst trie.

A conversation is the list of its turns' ids: 20 bytes, the MD5 of role and text and the text's length in UTF-8 bytes, so equal
turns have equal ids and a node knows its text's size.

1. *Classes.* Conversations of equal turns become one class with their number, smallest id, and a digest of their ids. The
   digest is taken in one pass over ids sorted within partitions; no list of ids is ever held.
2. *Bursting.* All classes start in the container of the root. A container that holds more than ``BURST`` turns bursts: the
   turns that all of its classes still share become trie heads (a chain, in one step), classes that end there
   stay with the last head, and the others move to new containers by their next turn's id. Small containers are set aside,
   oversized ones burst again, and only classes of oversized containers are read again. Sizes and shared turns are aggregates
   (sum, smallest and largest suffix) that Spark combines before it moves anything.
3. *Sweeping.* Shards are partitions of whole containers sorted by suffix. One sweep over a shard keeps the nodes on the way
   to the current suffix on a stack and gives out a container's nodes when it ends.
4. *Heads.* A head's totals are the sums of the containers and heads below it, taken by ancestors in two aggregations.

A container is at most ``BURST`` turns or one class, and only one container is in a sweep's memory. There are at most
``turns / BURST`` oversized containers in each round; a round goes at least one turn deeper, and past
all that a container shares.

Defined cases: NULL role or text is the empty string. Turns of one number (or of none, which come first) are ordered by the MD5 of role
and text; repeated rows are repeated turns. Rows of NULL conversation id belong to no conversation. A rebuilt
conversation without turns is a member of the root only. Other columns are ignored. An empty table gives an empty result.
A conversation's ids must fit one row (20 MB for a million turns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialize, ship
from shelfwise.session import scratch_path

#: Turns of a container from which on it bursts.
BURST = 20_000
#: Bytes of a turn's id.
WIDTH = 20
#: Nodes that the sweep gives out at a time.
_OUT = 20_000
_CLASS = "conv_id long, n_convs long, ends_sha256 string"
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, under binary")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- conversations as lists of turn ids

def _turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    of_both = F.md5(F.encode(F.concat_ws("", F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    return F.concat(of_both, F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, g, turns``: every conversation's turn ids in order; conversations of one ``g`` share a partition."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), (F.col("conv_id") - F.col("conv_id") % 5).cast("long").alias("g"),
        F.col("turn").cast("long").alias("turn"), _turn_id(F.col("role"), F.col("text")).alias("id"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "id")))
    return rows.repartition("g").groupBy("g", "conv_id").agg(listed.alias("l")) \
        .select("conv_id", "g", F.unhex(F.array_join(F.transform("l", lambda t: t["id"]), "")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first ``h`` turns of conversation ``c - c % 5``, then ``c``'s own after its first ``h``."""
    own = conversations(turns)
    source = F.max(F.when(F.col("conv_id") == F.col("g"), F.col("turns"))).over(Window.partitionBy("g"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int") * WIDTH
    kept = F.coalesce(F.substring(source, F.lit(1), h), F.lit(b""))
    return own.select("conv_id", F.concat(kept, F.substring(F.col("turns"), h + 1, F.length("turns"))).alias("turns"))


# ---------------------------------------------------------------- classes

def _digest_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by content and id become one row per content: smallest id, number, SHA-256 of the ids' decimals."""
    content, least, n, sha = None, 0, 0, hashlib.sha256()
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != content:
                if n:
                    for column, value in zip(out, (least, n, sha.hexdigest())):
                        column.append(value)
                content, least, n, sha = key, conv_id, 1, hashlib.sha256(str(conv_id).encode())
            else:
                n += 1
                sha.update(b",%d" % conv_id)
        if out[0]:
            yield _class_rows(*out)
    if n:
        yield _class_rows([least], [n], [sha.hexdigest()])


def _class_rows(least: list, n: list, sha: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                      names=["conv_id", "n_convs", "ends_sha256"])


def classes(convs: DataFrame) -> DataFrame:
    """``conv_id`` (smallest), ``n_convs``, ``ends_sha256``, ``turns`` of every distinct list of turns."""
    keyed = convs.select(F.unhex(F.sha2("turns", 256)).alias("content"), "conv_id")
    named = keyed.repartition("content").sortWithinPartitions("content", "conv_id").mapInArrow(_digest_classes, _CLASS)
    return named.join(convs, "conv_id")


# ---------------------------------------------------------------- bursting

def _shared(a: Column, b: Column) -> Column:
    """Turns that two lists have in common at their beginning."""
    most = (F.least(F.length(a), F.length(b)) / WIDTH).cast("int")
    same = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))),
                       lambda i: F.substring(a, (i - 1) * WIDTH + 1, F.lit(WIDTH)) == F.substring(b, (i - 1) * WIDTH + 1, F.lit(WIDTH)))
    first_apart = F.array_position(same, False).cast("int")
    return F.when(most == 0, 0).when(first_apart == 0, most).otherwise(first_apart - 1)


def _head(turns: Column, depth: Column) -> Column:
    return F.unhex(F.md5(F.substring(turns, F.lit(1), depth * WIDTH)))


class _Burst:
    """Containers after bursting: ``closed`` classes by container, ``heads``, and classes that end at a head (``ends``)."""

    def __init__(self, rows: DataFrame, burst: int):
        spark = rows.sparkSession
        self.closed, self.heads, self.ends, self.rounds = [], [], [], 0
        root = F.unhex(F.md5(F.lit(b"")))
        # a container is named by the digest of its prefix; ``above`` lists the containers that burst on the way
        now = rows.withColumn("head", root).withColumn("at", F.lit(0)).withColumn("above", F.array().cast("array<binary>"))
        while True:
            sizes = now.groupBy("head").agg(
                F.sum(F.length("turns") / WIDTH - F.col("at") + 1).alias("size"), F.count("*").alias("rows"), F.first("at").alias("from"),
                F.min("turns").alias("low"), F.max("turns").alias("high"), F.first("above").alias("path"))
            over = sizes.where((F.col("size") > burst) & (F.col("rows") > 1)) \
                .withColumn("to", _shared(F.col("low"), F.col("high")))
            over = materialize(over.select("head", "from", "to", "path", F.substring(F.col("low"), F.lit(1), F.col("to") * WIDTH).alias("prefix")), "trie-heads")
            if over.isEmpty():
                self.closed.append(now)
                break
            self.rounds += 1
            self.heads.append(over)
            marked = now.join(over.select("head", "to"), "head", "left")
            place = scratch_path(spark, "trie-round")
            state = F.when(F.col("to").isNull(), "closed").when(F.length("turns") == F.col("to") * WIDTH, "ends").otherwise("open")
            marked.withColumn("state", state).write.partitionBy("state").parquet(place)
            kept = spark.read.schema(marked.schema.add("state", "string")).parquet(place)
            self.closed.append(kept.where("state = 'closed'").select(*now.columns))
            self.ends.append(kept.where("state = 'ends'").select("conv_id", "n_convs", "ends_sha256", "head", "above"))
            step = F.col("to") + 1
            now = kept.where("state = 'open'").select(
                "conv_id", "n_convs", "ends_sha256", "turns", _head(F.col("turns"), step).alias("head"), step.alias("at"),
                F.concat("above", F.array("head")).alias("above"))


# ---------------------------------------------------------------- sweeping

class _Node:
    __slots__ = ("depth", "conv", "n", "children", "leaves", "saved", "size", "ends", "below")

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.below = EMPTY_SHA, []

    def take(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None or conv < self.conv else self.conv
        self.n += n

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size

    def row(self, parent: int | None, under: bytes | None) -> tuple:
        return self.conv, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.ends, under


def _sizes(turns: bytes) -> np.ndarray:
    """UTF-8 bytes of every turn's text."""
    return np.frombuffer(turns, ">u4").reshape(-1, WIDTH // 4)[:, -1]


class _Container:
    """The nodes of one container, from classes in order of their turns; the top node is the container's own head."""

    def __init__(self, at: int, above: list, out: list):
        self.at, self.under, self.out = at, above[-1] if above else None, out
        self.stack: list[_Node] = []
        self.before = b""

    def add(self, conv: int, n: int, sha: str, turns: bytes) -> None:
        size = _sizes(turns)
        same = self.at
        if self.stack:
            most = min(len(turns), len(self.before)) // WIDTH
            a = np.frombuffer(turns, np.uint8, most * WIDTH).reshape(-1, WIDTH)
            b = np.frombuffer(self.before, np.uint8, most * WIDTH).reshape(-1, WIDTH)
            apart = (a != b).any(1)
            same = int(apart.argmax()) if apart.any() else most
            self._down_to(same)
        else:
            self.stack.append(_Node(same, int(size[same - 1]) if same else 0))
        for depth in range(same + 1, len(size) + 1):
            self.stack[-1].children += 1
            self.stack.append(_Node(depth, int(size[depth - 1])))
        self.stack[-1].ends = sha
        self.stack[-1].take(conv, n)
        self.before = turns

    def _down_to(self, depth: int) -> None:
        while self.stack[-1].depth > depth:
            node = self.stack.pop()
            node.close()
            self._give(node)
            top = self.stack[-1]
            top.take(node.conv, node.n)
            top.leaves += node.leaves
            top.saved += node.saved
            top.below.append(node)

    def _give(self, node: _Node) -> None:
        """The children of a finished node: their parent's smallest member is known now."""
        self.out.extend(child.row(node.conv, None) for child in node.below)
        node.below = []

    def end(self) -> None:
        if self.stack:
            self._down_to(self.at)
            top = self.stack.pop()
            top.close()
            self._give(top)
            self.out.append(top.row(None, self.under))


def _node_rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
    names = [c.split()[0] for c in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list = []
    head, container = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "at", "above", "conv_id", "n_convs", "ends_sha256", "turns")]
        for key, at, above, conv, n, sha, turns in zip(*columns):
            if container is None or key != head:
                if container is not None:
                    container.end()
                head, container = key, _Container(at, above, out)
            container.add(conv, n, sha, turns)
            if len(out) >= _OUT:
                yield _node_rows(out)
                out.clear()
    if container is not None:
        container.end()
    if out:
        yield _node_rows(out)


# ---------------------------------------------------------------- the trie

def _head_nodes(tops: DataFrame, burst: _Burst) -> DataFrame:
    """Nodes of all heads, with the key of the container each lies under (``under``) for the first of a chain."""
    heads, ends = burst.heads[0], burst.ends[0]
    for more in burst.heads[1:]:
        heads = heads.unionAll(more)
    for more in burst.ends[1:]:
        ends = ends.unionAll(more)
    ends = materialize(ends, "trie-ends")
    members = tops.select(F.explode("above").alias("head"), "conv_id", "n_convs", "n_leaves", "saved_tokens").unionAll(
        ends.select(F.explode(F.concat("above", F.array("head"))).alias("head"), "conv_id", "n_convs", F.lit(0), F.lit(0)))
    total = members.groupBy("head").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                                        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    direct = tops.select(F.element_at("above", -1).alias("head")).unionAll(
        heads.where(F.size("path") > 0).select(F.element_at("path", -1).alias("head"))).groupBy("head").agg(F.count("*").alias("n_children"))
    sizes = F.transform(F.sequence(F.col("from"), F.col("to")), lambda d: F.when(d == 0, F.lit(0).cast("long")).otherwise(
        F.conv(F.hex(F.substring(F.col("prefix"), d * WIDTH - 3, F.lit(4))), 16, 10).cast("long")))
    nodes = heads.withColumn("sizes", sizes).join(total, "head").join(direct, "head") \
        .join(ends.select("head", "ends_sha256"), "head", "left")
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))
    nodes = materialize(nodes.drop("prefix"), "trie-head-nodes")
    lower = nodes.select(F.explode("path").alias("head"), "own").groupBy("head").agg(F.sum("own").alias("lower"))
    nodes = nodes.join(lower, "head", "left").withColumn("below", F.col("saved") + F.coalesce("lower", F.lit(0)))
    # a chain of heads: all have the same members, and only the last one branches
    each = nodes.select("*", F.explode(F.sequence(F.col("from"), F.col("to"))).alias("depth"))
    last, first = F.col("depth") == F.col("to"), F.col("depth") == F.col("from")
    rest = F.aggregate(F.slice("sizes", F.col("depth") - F.col("from") + 1, F.col("to") - F.col("depth") + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return each.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(~first, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"),
        F.when(first & (F.size("path") > 0), F.element_at("path", -1)).alias("under"), "head")


def prefix_trie(convs: DataFrame, burst: int = BURST) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs`` holds ``conv_id`` (unique) and ``turns``, as ``conversations`` and ``rebuilt`` give them.
    """
    spark = convs.sparkSession
    ship(spark)
    convs = materialize(convs.select("conv_id", "turns"), "trie-conversations")
    containers = _Burst(materialize(classes(convs), "trie-classes"), burst)
    closed = containers.closed[0]
    for more in containers.closed[1:]:
        closed = closed.unionAll(more)
    swept = closed.repartition("head").sortWithinPartitions("head", "turns").mapInArrow(_sweep, _NODE)
    nodes = materialize(swept, "trie-nodes")
    columns = [c.split()[0] for c in _NODE.split(", ")][:-1]
    if not containers.rounds:
        return nodes.select(*columns)
    above = _paths(containers)
    tops = nodes.where(F.col("under").isNotNull()).join(above, "under")
    heads = materialize(_head_nodes(tops, containers), "trie-heads-done")
    parents = heads.groupBy(F.col("head").alias("under")).agg(F.first("conv_id").alias("parent"))
    every = nodes.select(*columns, "under").unionAll(heads.select(*columns, "under"))
    inner = every.where(F.col("under").isNull()).select(*columns)
    outer = every.where(F.col("under").isNotNull()).join(parents, "under", "left").withColumn("parent_conv_id", F.col("parent")).select(*columns)
    return inner.unionAll(outer)


def _paths(containers: _Burst) -> DataFrame:
    """For every head, the heads from the root down to itself."""
    found = None
    for heads in containers.heads:
        own = heads.select(F.col("head").alias("under"), F.concat("path", F.array("head")).alias("above"))
        found = own if found is None else found.unionAll(own)
    return found
