"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

Turns are numbered within their conversation and carry two running sums of checksums of (place, role,
text); the sums after d turns name the node that these turns lead to, so equal beginnings meet in one
grouping, without a step per turn.

Totals over subtrees take rounds of joins, each over what is left of the tree.  Rake: all leaves add
their totals to their parents and go.  Compress: of chains of nodes with one child, every second node
or so, by coin, is taken up by its parent.  A chain of n nodes thus takes about log n rounds, not n.  The
way back re-expands: a node taken up has its parent's total less what the parent held then.  Both ways
work on tables that shrink by a part of their rows in every round.

A turn of a NULL conversation belongs to none and is left out; NULL role or text counts as empty; NULL
turns come first; equal turns of one conversation are ordered by checksum, and repeated rows are turns
of their own.  Conversations are told apart by integer ids.  A conversation of any length is numbered
in segments, a node with any number of children or ends is spread over tasks.  Texts of any length
enter as checksums and lengths only.  Other columns are not read, whatever their names.  Empty table:
no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from importflow.llm import rows
from importflow.operators.ordered import Timeline, number_rows
from importflow.operators.skew import spread_join

GRAFTED = 6             # a conversation takes over fewer turns than this
ENDS_A_ROW = 1 << 16    # ids of one node's ends that travel as one string
_WIDE = "decimal(20,0)"


def _key(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, a, b)))


def numbered(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    limit: int | None = None,
) -> DataFrame:
    """conv, pos (1-based), two checksums of role and text, n_chars of the text."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    turns = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(*said).alias("a"),
        F.xxhash64(F.lit("again"), *said).alias("b"), F.length(said[1]).cast("long").alias("n_chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    return number_rows(turns, ["conv"], order, "pos", limit).drop("turn")


def grafted(turns: DataFrame) -> DataFrame:
    """Every conversation c anew: the first h turns of conversation c - c % 100, then its own after its
    first h, h = crc32(c) % 6; with ``part`` 0 or 1 the order of its turns is (part, pos)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % GRAFTED
    others = F.col("conv") - F.col("conv") % 100
    heads = turns.where((F.col("pos") < GRAFTED) & (others == F.col("conv")))
    firsts = heads.groupBy(F.col("conv").alias("other")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "n_chars"))).alias("head")     # five at most
    )
    convs = turns.where("pos = 1").select("conv", others.alias("other"), h.cast("int").alias("h")).where("h > 0")
    taken = convs.join(firsts, "other").select("conv", F.explode(F.slice("head", 1, F.col("h"))).alias("t"))
    return taken.select("conv", F.lit(0).alias("part"), "t.pos", "t.a", "t.b", "t.n_chars").unionByName(
        turns.where(F.col("pos") > h).withColumn("part", F.lit(1))
    )


def prefixes(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """conv, depth, n_chars, key of the node that the first ``depth`` turns lead to, and its parent's."""
    line = Timeline.of(turns, ["conv"], ["part", "pos"], limit).before(d=("sum", F.lit(1)))
    here = [F.xxhash64("d", *pair).cast(_WIDE) for pair in (("a", "b"), ("b", "a"))]
    told = line.before(pa=("sum", here[0]), pb=("sum", here[1])).table()
    depth = F.col("d") + 1
    return told.select(
        "conv", depth.alias("depth"), "n_chars",
        _key(depth, F.col("pa") + here[0], F.col("pb") + here[1]).alias("key"),
        _key(F.col("d"), F.col("pa"), F.col("pb")).alias("parent"),
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One checksum for the consecutive strings of each key, joined by commas."""
    current, running = None, None
    for part in batches:
        keys, told = [], []
        for key, ids in zip(part.column("key").to_pylist(), part.column("ids").to_pylist()):
            if key == current:
                running.update(b",")
            else:
                if running is not None:
                    keys.append(current)
                    told.append(running.hexdigest())
                current, running = key, hashlib.sha256()
            running.update(ids.encode())
        if keys:
            yield rows.batch(key=pa.array(keys, pa.binary()), ends_sha256=told)
    if running is not None:
        yield rows.batch(key=pa.array([current], pa.binary()), ends_sha256=[running.hexdigest()])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of consecutive rows of one key as one string, cut at ENDS_A_ROW."""
    key, ids = None, []

    def told():
        return rows.batch(key=pa.array([key], pa.binary()), first=[ids[0]], ids=[",".join(map(str, ids))])

    for part in batches:
        done = []
        for k, c in zip(part.column("key").to_pylist(), part.column("conv").to_pylist()):
            if ids and (k != key or len(ids) == ENDS_A_ROW):
                done.append(told())
                ids = []
            key = k
            ids.append(c)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield told()


def ends_checksums(ends: DataFrame) -> DataFrame:
    """key, SHA-256 of the ids (conv) that end there, ascending, joined by commas.

    The ids of one node may lie in many ranges; what one task hashes in the end is their strings.
    """
    laid = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    strings = laid.mapInArrow(_strings, "key binary, first long, ids string")
    return strings.repartition("key").sortWithinPartitions("key", "first").mapInArrow(
        _checksums, "key binary, ends_sha256 string")


def subtree_totals(nodes: DataFrame, scratch: rows.Scratch, values: list[str]) -> DataFrame:
    """``nodes``: node, parent (NULL at the top), ``values`` (long).  node and, under the same names, the
    sums of the values over its subtree, by rake and compress."""
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")

    def told(node, parent=none, sums=None, kids=zero, only=none, to=none, following=none, gone=F.lit(False)):
        """What a node is told: all of it is summed or the one value that is not NULL."""
        return F.struct(
            node.alias("node"), parent.alias("parent"), *[(sums(v) if sums else zero).alias(v) for v in values],
            kids.alias("kids"), only.alias("only"), to.alias("to"), following.alias("following"), gone.alias("gone"))

    def heard(*messages: DataFrame) -> DataFrame:
        """One row per node from all that it is told."""
        whole = messages[0]
        for more in messages[1:]:
            whole = whole.unionAll(more)
        return scratch.store(whole.select("m.*").groupBy("node").agg(
            F.coalesce(F.max("to"), F.max("parent")).alias("parent"), *[F.sum(v).alias(v) for v in values],
            F.sum("kids").alias("kids"), F.coalesce(F.max("following"), F.max("only")).alias("only"), F.max("gone").alias("gone"),
        ).where("not gone").drop("gone"))

    me, parent = F.col("node"), F.col("parent")
    to_parent = nodes.where("parent is not null").select(told(parent, kids=F.lit(1).cast("long"), only=me).alias("m"))
    state = heard(nodes.select(told(me, parent, F.col).alias("m")), to_parent)
    rounds = []
    while True:
        leaf = F.col("kids") == 0
        raked = state.where(leaf).select("node", *values)
        up = F.when(leaf, told(parent, sums=F.col)).otherwise(told(parent, kids=F.lit(1).cast("long"), only=me))
        live = heard(
            state.where(~leaf).select(told(me, parent, F.col).alias("m")),
            state.where("parent is not null").select(up.alias("m")),
        )
        if live.isEmpty():
            break
        chain = live.where("kids = 1")
        coin = F.xxhash64("node", F.lit(len(rounds))).bitwiseAND(1) == 1
        taken = chain.where(coin).select(
            F.col("node").alias("only"), F.col("only").alias("following"), *[F.col(v).alias(f"add_{v}") for v in values])
        merged = chain.where(~coin).select("node", "only", *values).join(taken, "only")
        changes = F.array(
            told(me, sums=lambda v: F.col(f"add_{v}"), following=F.col("following")),   # it takes up its child,
            told(F.col("following"), to=me),                                            # whose child comes to it
            told(F.col("only"), gone=F.lit(True)))
        state = heard(
            live.select(told(me, parent, F.col, F.col("kids"), F.col("only")).alias("m")),
            merged.select(F.explode(changes).alias("m")),
        )
        rounds.append((raked, merged))
    totals = raked
    for raked, merged in reversed(rounds):
        above = totals.select("node", *[F.col(v).alias(f"all_{v}") for v in values])
        back = merged.join(above, "node").select(
            F.col("only").alias("node"), *[(F.col(f"all_{v}") - F.col(v)).alias(v) for v in values])
        totals = scratch.store(totals.unionByName(back).unionByName(raked))
    return totals


def trie(turns: DataFrame, scratch: rows.Scratch, limit: int | None = None) -> DataFrame:
    """All nodes of the rebuilt conversations in ``turns`` (see ``numbered``); columns as the query returns."""
    turns = scratch.store(turns)
    steps = scratch.store(prefixes(grafted(turns), limit))
    root = _key(F.lit(0), F.lit(0), F.lit(0))
    convs = turns.where("pos = 1").select("conv")
    whole = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"),
        "n_convs", F.lit(0).cast("long").alias("n_chars"))
    nodes = steps.groupBy(F.col("key").alias("node")).agg(
        F.min("parent").alias("parent"), F.min("conv").alias("conv_id"), F.min("depth").cast("long").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars"),
    )
    kids = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.store(nodes.unionByName(whole).join(kids, "node", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    last = steps.groupBy("conv").agg(F.max(F.struct("depth", "key")).alias("last"))
    ends = convs.join(last, "conv", "left").select("conv", F.coalesce("last.key", root).alias("key"))
    own = nodes.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    totals = subtree_totals(own, scratch, ["n_leaves", "saved_tokens"])
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    linked = spread_join(nodes, parents.where("n_children > 0").withColumnRenamed("n_children", "__rows"),
                         "parent", "__rows", ["node"])
    return linked.join(totals, "node").join(
        ends_checksums(ends).withColumnRenamed("key", "node"), "node", "left"
    ).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    limit: int | None = None,
) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations of ``df``.

    ``limit``: turns of one conversation beyond which it is numbered in segments.
    """
    scratch = rows.Scratch(df.sparkSession, "trie")
    return trie(numbered(df, conv_id, turn, role, text, limit), scratch, limit)
