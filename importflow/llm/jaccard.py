"""N-gram Jaccard join: every link between texts whose shingle sets are alike, whole and exact.

A text's set holds its distinct ``SHINGLE``-word shingles, as 64-bit hashes in order.  Texts of one
set are one class.  Classes are compared in tiles: sizes fall in bands, and for each band the hash
space is cut into so many parts that two sets which may link (their difference is bounded by their
sizes) have at least one part with shingles in common whole.  A tile is a part's content; a class
joins the tiles of its own band and of the next, where a larger partner may lie.

Within a tile every class is paired with the least one and, in an order of the tile's own, with
the next.  Pairs are checked by hashed bitmaps first (bits that one has and the other lacks bound
the overlap from above), then by exact intersection of the sorted sets.  Where a tile then still
holds several components, its classes are compared by bitmaps, and a class that may link with one
of another component is held against that whole component, in blocks of it: so no link between
components is missed, and only links leave the tasks.  A tile of two classes is done with its pair.

What travels for every class is narrow: its size and its bitmap, made in the first reading.  Sorted
sets are made again, from the text, of just the classes that the bitmaps leave room for.

Hot tiles: a task sends the least class of each tile among the texts it works on and ties the
others to it, so a group of near copies of any size sends one entry for each unit of text.

NULL and empty texts, or texts without words: the empty set, linked with nothing.  NULL ids: the
set size, and NULL as component.  Repeated rows: one node for each id.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from importflow.llm import graph, rows, words
from importflow.operators.skew import checked_broadcast
from importflow.session import store

SHINGLE = 4
PERCENT = 85            # of the union that the overlap must reach
BAND = 1.2              # largest to smallest size of a band
BLOCK = 2048            # classes of a tile or component that are compared at once
RING = 4                # classes from which on a tile pairs neighbours
BUCKET_ENTRIES = 1_500_000
WANTED = 1_000_000      # (node, id) rows, 16 bytes each, to which a broadcast of wanted classes is held
BITS_OF_SHINGLE = 2    # of a bitmap, about
MOST_BITS = 1 << 20


def sets(unit: pa.RecordBatch, text: str, shingle: int):
    """Sorted distinct shingle hashes of all texts, the text of each, where each text's begin, and
    a hash of each whole set."""
    data, offsets = rows.text_bytes(unit.column(text))
    data = words.LOWER[data]
    starts, ends, first = words.word_spans(data, offsets)
    hashes = words.span_hashes(data, starts, ends)
    texts, count = len(offsets) - 1, np.diff(first)
    whole = words.whole_windows(first, shingle)
    values = words.windows(hashes, shingle)[whole]
    owner = words.owner(first)[:len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        few = []
        for i in short.tolist():
            h = np.array([count[i]], np.uint64)
            for w in hashes[first[i]:first[i + 1]]:
                h = words.chain(h, w[None])
            few.append(h[0])
        values = np.concatenate([values, np.array(few, np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    begins = np.searchsorted(owner, np.arange(texts + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(values), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        digest = words.mix((sums[begins[1:]] - sums[begins[:-1]]) ^ words.mix(np.diff(begins).astype(np.uint64)))
    return values, owner, begins, digest.astype(np.int64)


@lru_cache(maxsize=None)
def scheme(band: int, percent: int) -> tuple[int, int, int]:
    """Of a band: its largest size, its parts, and how many parts of a set may be empty before the
    set is sparse.

    Sets of at most ``top`` shingles that link differ in ``differ`` at most, so of ``differ + 1 +
    spare`` parts more than ``spare`` are equal, and one of them holds a shingle unless more than
    ``spare`` parts of both are empty: such sparse sets join the tiles of empty parts as well.
    """
    top = int(BAND ** (band + 1))
    differ = 2 * top * (100 - percent) // (100 + percent)
    least = percent / 100 * top / BAND
    spare = 0
    for _ in range(4):
        parts = differ + 1 + spare
        empty = parts * exp(-least / parts)
        spare = ceil(empty + 3 * sqrt(empty))
    return top, differ + 1 + spare, spare


def bands_of(sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The band of each size, and the band of its largest possible partner."""
    limits = np.array([scheme(b, percent)[0] for b in range(160)])
    own = np.searchsorted(limits, sizes)
    return [own, np.searchsorted(limits, sizes * 100 // percent)]


def signatures(values: np.ndarray, owner: np.ndarray, begins: np.ndarray, percent: int):
    """(tile, text) of all tiles that each text's set joins."""
    sizes = np.diff(begins)
    own, other = bands_of(sizes, percent)
    tiles, texts = [], []
    for step in range(int((other - own).max(initial=0)) + 1):
        band = own + step
        used = (sizes > 0) & (band <= other)
        if not used.any():
            continue
        plan = np.array([scheme(int(b), percent)[1:] if u else (1, 0) for b, u in zip(band.tolist(), used.tolist())])
        parts, spare = plan[:, 0].astype(np.uint64), plan[:, 1]
        mine = used[owner]
        at, who = values[mine], owner[mine]
        part = ((at >> np.uint64(32)) * parts[who]) >> np.uint64(32)
        cut = np.ones(len(at), bool)
        cut[1:] = (part[1:] != part[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(cut)
        content = np.add.reduceat(words.mix(at), first)
        who, part = who[first], part[first]
        seed = words.mix(band.astype(np.uint64) << np.uint64(32))
        tiles.append(words.mix(content ^ words.mix(seed[who] + part)))
        texts.append(who)
        empty = np.where(used, parts.astype(np.int64) - np.bincount(who, minlength=len(sizes)), 0)
        for i in np.flatnonzero(empty > spare).tolist():
            left = np.setdiff1d(np.arange(int(parts[i]), dtype=np.uint64), part[who == i])
            tiles.append(words.mix(words.mix(seed[i] + left)))
            texts.append(np.full(len(left), i))
    if not tiles:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(tiles), np.concatenate(texts)


def entries(unit: pa.RecordBatch, text: str, shingle: int, percent: int, buckets: int) -> pa.RecordBatch | None:
    """By bucket, the tiles of the unit's classes: one class of each tile (kind 0), and the ties of
    the others to it (kind 1)."""
    values, owner, begins, digest = sets(unit, text, shingle)
    first = np.zeros(len(digest), bool)
    first[np.unique(digest, return_index=True)[1]] = True       # a class once
    chosen = first[owner]
    sizes = np.where(first, np.diff(begins), 0)
    tile, who = signatures(values[chosen], owner[chosen], np.concatenate([[0], np.cumsum(sizes)]), percent)
    if not len(tile):
        return None
    tile, node = (tile >> np.uint64(16)).astype(np.int64), digest[who]     # 6 bytes tell tiles apart
    order = np.lexsort((node, tile))
    tile, node = tile[order], node[order]
    head = np.ones(len(tile), bool)
    head[1:] = tile[1:] != tile[:-1]
    least = node[np.flatnonzero(head)[np.cumsum(head) - 1]]
    out = [(0, tile[head], node[head], node[head])]
    tied = ~head & (least != node)
    if tied.any():
        around = ring(tile, node)
        out.append((1, *(np.concatenate(c) for c in zip((tile[tied], least[tied], node[tied]), around))))
    result = []
    for kind, t, a, b in out:
        bucket = t % buckets
        ranked = np.argsort(bucket, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[ranked])) + 1, [len(ranked)]])
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            mine = ranked[x:y]
            blob = _narrow(t[mine], a[mine]) if kind == 0 else _raw([t[mine], a[mine], b[mine]])
            result.append((int(bucket[mine[0]]), kind, blob))
    return rows.batch(
        bucket=[r[0] for r in result], kind=[r[1] for r in result], blob=pa.array([r[2] for r in result], pa.binary())
    )


def ring(tile: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in each tile of ``RING`` classes or more, in an order that differs by tile."""
    turn = words.mix(tile.astype(np.uint64) ^ words.mix(node.astype(np.uint64)))
    order = np.lexsort((turn, tile))
    tile, node = tile[order], node[order]
    first = np.searchsorted(tile, tile)
    many = np.searchsorted(tile, tile, "right") - first >= RING
    at = np.flatnonzero(many[:-1] & (tile[1:] == tile[:-1]))
    return tile[at], np.minimum(node[at], node[at + 1]), np.maximum(node[at], node[at + 1])


def _raw(columns: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes, as they are: hashes hardly compress."""
    return b"".join(c.astype("<i8").tobytes() for c in columns)


def _narrow(tile: np.ndarray, node: np.ndarray) -> bytes:
    """Entries in order of the node: the nodes, how many tiles each has, and 6 bytes of each tile."""
    nodes, uses = np.unique(node, return_counts=True)
    tile = tile[np.argsort(node, kind="stable")]
    return b"".join([
        np.array([len(nodes)], "<i8").tobytes(), nodes.astype("<i8").tobytes(), uses.astype("<u4").tobytes(),
        tile.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_LOW].tobytes(),
    ])


def _widen(blob: bytes) -> np.ndarray:
    size = int(np.frombuffer(blob, "<i8", 1)[0])
    nodes = np.frombuffer(blob, "<i8", size, 8)
    uses = np.frombuffer(blob, "<u4", size, 8 + 8 * size)
    return np.stack([stretch(blob[8 + 12 * size:]).astype(np.int64), np.repeat(nodes, uses)])


def tiles(docs: DataFrame, shingle: int, percent: int, entries_of_bucket: int) -> DataFrame:
    """tile, a, b: pairs of the least class of a tile (of the unit, or of all) with its others.

    The pairs of a tile connect all its classes, so a tile of one pair has two: NULL stands for it.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // 12 // entries_of_bucket) + 16     # an entry for each 12 bytes of text, about

    def pair(batches):
        for _, group in rows.by_group(batches, "bucket"):
            kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
            sole = [_widen(b) for k, b in zip(kinds, blobs) if k == 0]
            found = [np.frombuffer(b, "<i8").reshape(3, -1) for k, b in zip(kinds, blobs) if k == 1]
            if sole:
                t, node = np.concatenate(sole, axis=1)
                order = np.lexsort((node, t))
                t, node = t[order], node[order]
                head = np.ones(len(t), bool)
                head[1:] = t[1:] != t[:-1]
                least = node[np.flatnonzero(head)[np.cumsum(head) - 1]]
                again = np.zeros(len(t), bool)
                again[1:] = ~head[1:] & (node[1:] == node[:-1])
                keep = ~again & (node != least)
                found.append((t[keep], least[keep], node[keep]))
                found.append(ring(t[~again], node[~again]))
            _, place, uses = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True, return_counts=True)
            alone = np.split(uses[place] == 1, np.cumsum([len(f[0]) for f in found])[:-1])
            for (t, x, y), one in zip(found, alone):
                yield rows.batch(tile=pa.array(t, mask=one), a=x, b=y)

    found = rows.map_units(
        docs.select("text"), "text", lambda unit: entries(unit, "text", shingle, percent, buckets),
        "bucket long, kind long, blob binary",
    )
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pair, "tile long, a long, b long")


def bitmap(values: np.ndarray) -> bytes:
    bits = 64
    while bits < BITS_OF_SHINGLE * len(values) and bits < MOST_BITS:
        bits *= 2
    marks = np.zeros(bits, np.uint8)
    marks[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap brought down to ``size`` bytes: bits that fall together are joined."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def may_link(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether sizes and bitmaps leave room for a link."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= percent * (n + m - most)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact, for sorted sets."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


_LOW = 6    # bytes kept of a hash: sets of a pair are small against 2 ** 48


def squeeze(values: np.ndarray) -> bytes:
    low = np.sort(values & np.uint64((1 << 8 * _LOW) - 1)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :_LOW].tobytes()


def stretch(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, _LOW)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :_LOW] = raw
    return wide.view("<u8").ravel()


def shingles_of(nodes: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, scratch: rows.Scratch) -> DataFrame:
    """node, shingles of the classes ``nodes``, each from the text of its head (node, doc_id)."""
    wanted = scratch.store(nodes.distinct().join(heads, "node").select("doc_id", "node"))
    texts = docs.join(checked_broadcast(wanted, WANTED), "doc_id").select("node", "text")

    def work(unit):
        values, _, begins, digest = sets(unit, "text", shingle)
        each = [squeeze(values[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
        own = digest == unit.column("node").to_numpy()      # rows of one id may have other texts
        return rows.batch(node=digest, shingles=pa.array(each, pa.binary())).filter(pa.array(own))

    found = rows.map_units(texts, "text", work, "node long, shingles binary")
    return scratch.store(found.dropDuplicates(["node"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def check(pairs: DataFrame, known: DataFrame, fetch: Callable, percent: int, scratch: rows.Scratch) -> DataFrame:
    """The pairs a, b that link.  Bitmaps travel first, whole sets (which ``fetch`` gives for nodes)
    only to pairs they leave room for."""
    def sides(found, of, *columns):
        for name in ("b", "a"):
            mine = of.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
            found = found.join(mine, name)
        return found

    def likely(batches):
        for unit in batches:
            names = ("a_n", "b_n", "a_bits", "b_bits")
            keep = [may_link(*each, percent) for each in zip(*(unit.column(c).to_pylist() for c in names))]
            yield rows.batch(a=unit.column("a"), b=unit.column("b")).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for unit in batches:
            keep, last, own = [], None, None
            for a, s, t in zip(*(unit.column(c).to_pylist() for c in ("a", "a_shingles", "b_shingles"))):
                if last != a:
                    last, own = a, stretch(s)
                keep.append(linked(own, stretch(t), percent))
            yield rows.batch(a=unit.column("a"), b=unit.column("b")).filter(pa.array(keep, pa.bool_()))

    room = scratch.store(sides(pairs, known, "n", "bits").mapInArrow(likely, "a long, b long"))
    return scratch.store(sides(room, fetch(_ends(room)), "shingles").mapInArrow(exact, "a long, b long"))


def _table(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and bitmaps of a group, the bitmaps brought down to the least size."""
    bits = [np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()]
    size = min(map(len, bits))
    return group.column("n").to_numpy(), np.stack([fold(b, size) for b in bits])


def room_for(i: int, at: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``at`` that may link with ``i``."""
    at = at[100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i])]
    here = n[i] - np.bitwise_count(bits[i] & ~bits[at]).sum(axis=1, dtype=np.int64)
    there = n[at] - np.bitwise_count(bits[at] & ~bits[i]).sum(axis=1, dtype=np.int64)
    most = np.minimum(here, there)
    return at[100 * most >= percent * (n[i] + n[at] - most)]


def across(members: DataFrame, percent: int, block: int) -> DataFrame:
    """node, root: a class and another component that has a class in its tile it may link with.

    ``members``: tile, many (classes of the tile), node, root, n, bits.  A tile of more than
    ``block`` classes is compared in pairs of blocks, each a group of its own.
    """
    blocks = F.ceil(F.col("many") / block)
    cut = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.xxhash64("tile", F.least("mine", "other"), F.greatest("mine", "other"))
    cut = cut.select(part.alias("part"), "node", "root", "n", "bits").repartition("part").sortWithinPartitions("part")

    def run(batches):
        nodes, roots = [], []
        for _, group in rows.by_group(batches, "part"):
            node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
            n, bits = _table(group)
            _, place, uses = np.unique(root, return_inverse=True, return_counts=True)
            if len(uses) < 2:
                continue
            order = np.argsort(uses[place], kind="stable")      # the small component asks the large one
            for k, i in enumerate(order[:-1].tolist()):
                rest = order[k + 1:]
                found = np.unique(root[room_for(i, rest[root[rest] != root[i]], n, bits, percent)])
                nodes += [int(node[i])] * len(found)
                roots += found.tolist()
            if len(nodes) > 10_000:
                yield rows.batch(node=nodes, root=roots)
                nodes, roots = [], []
        if nodes:
            yield rows.batch(node=nodes, root=roots)

    return cut.mapInArrow(run, "node long, root long").distinct()


def against_components(
    asked: DataFrame, roots: DataFrame, known: DataFrame, fetch: Callable, percent: int, block: int
) -> DataFrame:
    """a, b: a link of each asked class (node) to the component (root), if it has any."""
    wanted = asked.select("root").distinct()
    inside = wanted.join(roots.select("root", F.col("node").alias("__n")), "root", "left").select(
        "root", F.coalesce("__n", "root").alias("node")
    )
    inside = inside.unionByName(wanted.select("root", F.col("root").alias("node"))).distinct()
    blocks = inside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    held = inside.join(blocks, "root").select(
        "root", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("part"), F.lit(False).alias("asks")
    )
    asking = asked.join(blocks, "root").select(
        "root", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"),
        F.lit(True).alias("asks"),
    )
    both = held.unionByName(asking).withColumn("part", F.xxhash64("root", "part"))
    known = known.join(fetch(inside.select("node").unionByName(asked.select("node"))), "node")
    both = both.select("part", "node", "asks").join(known, "node").repartition("part").sortWithinPartitions("part")

    def run(batches):
        for _, group in rows.by_group(batches, "part"):
            node, asks = group.column("node").to_numpy(), group.column("asks").to_numpy()
            n, bits = _table(group)
            shingles = group.column("shingles")
            own, left, right = {}, [], []
            members = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks).tolist():
                mine = stretch(shingles[i].as_py())
                for j in room_for(i, members, n, bits, percent).tolist():
                    if j not in own:
                        own[j] = stretch(shingles[j].as_py())
                    if linked(mine, own[j], percent):
                        left.append(node[i])
                        right.append(node[j])
                        break
            if left:
                yield rows.batch(a=left, b=right)

    return both.mapInArrow(run, "a long, b long")


def links_of_tiles(
    tile: DataFrame, pairs: DataFrame, known: DataFrame, fetch: Callable, ties: DataFrame, percent: int, block: int,
    scratch: rows.Scratch,
) -> DataFrame:
    """node, root of all classes with links.  ``tile``: tile, a, b; ``pairs``: a, b, shared (tiles);
    ``known``: node, n, bits; ``ties``: further links.

    First each class is checked against the one it shares most tiles with; then the pairs that are
    not in one component by that; then what lies across components in a tile.
    """
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    links = check(best, known, fetch, percent, scratch).unionByName(ties)
    roots = graph.components(links, scratch)

    def rooted(df, name, root):
        mine = roots.select(F.col("node").alias(name), F.col("root").alias(root))
        return df.join(mine, name, "left").withColumn(root, F.coalesce(root, name))

    apart = rooted(rooted(pairs.select("a", "b"), "a", "x"), "b", "y").where("x <> y").select("a", "b")
    links = links.unionByName(check(apart, known, fetch, percent, scratch))
    roots = graph.components(links, scratch)
    tile = tile.where("tile IS NOT NULL")       # the others are done with their pair
    nodes = tile.select("tile", F.col("a").alias("node")).unionByName(tile.select("tile", F.col("b").alias("node")))
    members = scratch.store(rooted(nodes.distinct(), "node", "root"))
    mixed = members.groupBy("tile").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("many")
    ).where("x <> y").select("tile", "many")
    members = members.join(mixed, "tile").join(known, "node")
    asked = scratch.store(across(members, percent, block))
    more = scratch.store(against_components(asked, roots, known, fetch, percent, block))
    return graph.components(links.unionByName(more), scratch) if more.take(1) else roots


def join_components(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    block: int = BLOCK, entries_of_bucket: int = BUCKET_ENTRIES,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    scratch = rows.Scratch(df.sparkSession, "jaccard")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def classes(unit):
        values, _, begins, digest = sets(unit, "text", shingle)
        bits = [bitmap(values[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
        return rows.batch(
            doc_id=unit.column("doc_id"), n=np.diff(begins), node=digest, bits=pa.array(bits, pa.binary())
        )

    table = scratch.store(rows.map_units(docs, "text", classes, "doc_id long, n long, node long, bits binary"))
    # ids tie classes too: rows of one id are one node
    usable = table.where("n > 0 AND doc_id IS NOT NULL")
    heads = scratch.store(usable.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    several = usable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    several = scratch.store(several.select("doc_id", "a"))
    same_id = usable.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    tile = scratch.store(tiles(docs, shingle, percent, entries_of_bucket))
    pairs = scratch.store(tile.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    known = usable.select("node", "n", "bits").dropDuplicates(["node"])
    known = scratch.store(known.join(_ends(pairs).distinct(), "node", "left_semi"))

    def fetch(nodes):
        return shingles_of(nodes, docs, heads, shingle, scratch)

    roots = links_of_tiles(tile, pairs, known, fetch, same_id, percent, block, scratch)
    named = heads.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes_ = named.join(least, "root").select("node", "component_id")
    joined = table.join(classes_, "node", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    result = store(joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "components")
    scratch.drop()
    return result


def keep_one(df: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose document is the least of its component, one row for each id; rows
    without an id stay."""
    found = join_components(df, doc_id, **options)
    other = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"))
    kept = df.join(checked_broadcast(other.distinct()), F.col(doc_id) == F.col("__id"), "left_anti")
    twice = store(found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("__id")), "repeated-ids")
    if not twice.take(1):
        return kept
    many = checked_broadcast(twice)
    once = kept.join(many, F.col(doc_id) == F.col("__id"), "left_semi").dropDuplicates([doc_id])
    return kept.join(many, F.col(doc_id) == F.col("__id"), "left_anti").unionByName(once)
