"""SimHash near-duplicates: blocks that close pairs share by the pigeonhole principle, joins on blocks, verified distances, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_arrow, cut, cut_table, emit_arrow, freed, texts
from .components import connected_components
from .substring_dedup import mix

#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def _shingles(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all ``width``-word shingles of the A-Z-lowered text, in blocks; of fewer words all are one shingle."""
    run = text.encode().lower().split() if text else []  # bytes: only A-Z, and only 9-13 and 32
    if not run:
        return
    line = b" ".join(run)
    n = max(1, len(run) - width + 1)
    size = np.fromiter(map(len, run), np.int64, len(run))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = (ends[width - 1 :] if len(run) >= width else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)


def distinct_shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted digests of the distinct shingles; none for no word."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, width, seed)]))


def _majority(blocks: Iterator[np.ndarray], words: int) -> list[int]:
    n, ones = 0, np.zeros((words, 64), np.int64)
    for h in blocks:
        n += len(h)
        for k in range(words):
            own = mix(h * np.uint64(2 * k + 1) + np.uint64(k)) if k else h
            ones[k] += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1).view(">u8").ravel().tolist()


def fingerprint(text: str | None, width: int = 3, seed: int = 42, words: int = 1) -> list[int]:
    """``words`` times 64 majority bits over hashes of all ``width``-word shingles of the A-Z-lowered text.

    The first 64 bits are over XXH64, the others over keyed mixtures of it. No word: zeros.
    """
    return _majority(_shingles(text, width, seed), words)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None, width: int = 3, words: int = 1) -> DataFrame:
    """Appends the fingerprint: a long, or an array of longs for more than 64 bits."""

    def kernel(batch: pa.RecordBatch) -> list:
        bits = np.array([fingerprint(t, width, words=words) for t in texts(batch, text)], np.uint64).reshape(-1, words).view(np.int64)
        return [bits[:, 0].copy() if words == 1 else list(bits)]

    return append_arrow(docs, kernel, f"{out} {'long' if words == 1 else 'array<long>'}", keep)


def _apart(a: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of ``a`` and ``f``."""
    total = np.zeros((len(a), len(f)), np.int32)
    for k in range(f.shape[1]):
        total += np.bitwise_count(a[:, None, k] ^ f[None, :, k])
    return total


def _near(f: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint (a row) the smallest index of its component within the group.

    All that are close to the first one are linked through it, so only the rest is compared with all.
    """
    close = (_apart(f[:1], f) <= distance)[0]
    rest = np.flatnonzero(~close)
    label = np.where(close, 0, np.arange(len(f)))
    if not len(rest):
        return label
    near = np.concatenate([_apart(f[rest[at : at + 256]], f) <= distance for at in range(0, len(rest), 256)])
    label[rest[near[:, close].any(axis=1)]] = 0
    among = near[:, rest]
    while True:
        new = np.where(among, label[rest][None, :], len(f)).min(axis=1)
        if (new == label[rest]).all():
            return label
        label[rest] = new


def _star_links(distance: int, words: int):
    """Links of each run of equal (key, i, j): every node to the first of its component in the group."""

    def links(g: np.ndarray, out: list) -> None:
        if len(g) == 2:
            if _apart(g[:1, 1:], g[1:, 1:])[0, 0] <= distance:
                out.append(g[:, 0])
        elif len(g) > 2:
            root = _near(g[:, 1:], distance)
            far = np.flatnonzero(root != np.arange(len(g)))
            if len(far):
                out.append(np.column_stack([g[root[far], 0], g[far, 0]]).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros((0, words + 1), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
            key = np.column_stack([col(k) for k in range(3)])
            g = np.column_stack([col(k).view(np.uint64) for k in range(3, 4 + words)])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            parts = np.split(g, cuts)
            firsts = key[np.concatenate([[0], cuts])]
            out: list = []
            if held_key is not None and (held_key == firsts[0]).all():
                parts[0] = np.concatenate([held, parts[0]])
            elif held_key is not None:
                links(held, out)
            for p in parts[:-1]:
                links(p, out)
            held_key, held = firsts[-1], parts[-1]
            yield from _edges(out)
        out = []
        links(held, out)
        yield from _edges(out)

    return run


def _edges(out: list) -> Iterator[pa.RecordBatch]:
    if out:
        pairs = np.concatenate(out).view(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks that keep ``blocks - distance`` of the blocks: fingerprints within ``distance`` bits agree under one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(kept) for kept in combinations(parts, blocks - distance)]


def _links(rows: DataFrame, prints: DataFrame | None, words: int, distance: int, group: int) -> DataFrame:
    """Links among the nodes that share a key: ``rows`` (key, node), ``prints`` (node, f0, f1, ...), or None
    where a node is its own fingerprint.

    Groups of more than ``group`` are dealt to chunk pairs, so that no task holds one whole; within a group only links
    to the first of each component come out, never all pairs.
    """
    f = [f"f{k}" for k in range(words)]
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(many, "key").withColumn("chunks", F.ceil(F.col("n") / group).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
    met = met.select("key", "own", "node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    met = met.withColumn("f0", F.col("node")) if prints is None else met.join(prints, "node").select("key", "i", "j", "node", *f)
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(_star_links(distance, words), "a long, b long").distinct()


def near_links(prints: DataFrame, distance: int = 3, blocks: int = 6, group: int = 2000) -> DataFrame:
    """(a, b) links that join all distinct fingerprints ``fp`` within ``distance`` bits, transitively.

    Each fingerprint goes once under every mask; rows that share a masked value meet.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, distance)]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])
    rows = prints.select(F.col("fp").alias("node"), F.explode(keys).alias("key"))
    return _links(rows, None, 1, distance, group)


#: Similar texts: 64-bit words of the fingerprint, and differing bits beyond which sets are not compared. Sets of a Jaccard
#: similarity of 0.8 differ in 39 of 256 bits on average, with a deviation of 6: one pair in 10**9 lies beyond.
WORDS, DISTANCE = 4, 76
#: Least similarity of linked texts, as a fraction.
SIMILAR = (4, 5)
#: Bits of the maps by which executors pick texts and shingles before the exact joins (2 MB), whatever their number.
MAP_BITS = 1 << 24
#: Shingles that a task counts before they are sent on.
COUNT_AT_ONCE = 1 << 20
#: Rows up to which all pairs of a block are compared at once, the rows that stand for a larger one, and their growth.
FEW, PIVOTS, GROWTH = 3, 4, 8
#: Turns that join rows; the later ones compare chunks of a block, of so many rows, and so many shingles at a time.
JOINED_TURNS, CHUNK, SHINGLES_AT_ONCE = 2, 512, 4096


def bit_map(keys: DataFrame, key: str) -> np.ndarray:
    """A map of MAP_BITS bits, those of all ``key`` set: what it lacks is not among the keys."""
    at = F.pmod(F.col(key), F.lit(MAP_BITS)).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(pmod({key}, {MAP_BITS}) & 63 as int))")
    words = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def in_map(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = key % MAP_BITS
    return (bits[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def counted_once(sets: list[np.ndarray]) -> pa.RecordBatch:
    g, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int32))], names=["g", "n"])


def most_that_differ(n):
    """One more than the shingles that a set of ``n`` may have beside those of a similar set."""
    part, whole = SIMILAR
    return n - -(-n * part // whole) + 1


def blocks_of_similar(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, size, f0, ..., shared, keys) of the sets that may have a similar one; ``docs`` (key, text), ``classes``
    (node, size, key), nodes distinct.

    Pigeonhole: a set of n shingles shares all but ``most_that_differ(n) - 1`` with any similar set, so the first
    ``most_that_differ(n)`` in an order of all shingles hold a common one. The order is by the number of sets, rarest
    first, so shingles of widespread passages make no block, and a set whose first ones are all its own has none.
    ``shared`` are all shingles that other sets have, too. Maps of a fixed size only spare the joins work.
    """
    spark = docs.sparkSession
    of_class = spark.sparkContext.broadcast(bit_map(classes, "key"))

    def chosen(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(in_map(of_class.value, key)).tolist():
            yield int(key[k]), distinct_shingles(batch.column(1)[k].as_py(), width).view(np.int64)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, g in chosen(batch):
                held.append(g)
                n += len(g)
                if n >= COUNT_AT_ONCE:
                    yield counted_once(held)
                    held, n = [], 0
        yield counted_once(held)

    # counted before they move, so that of a shingle in very many texts few rows meet; without a map in the JVM's memory,
    # for most shingles are in one text only
    shared = docs.mapInArrow(counts, "g long, n int").repartition("g").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    shared = cut_table(shared)
    known = spark.sparkContext.broadcast(bit_map(shared, "g"))

    def may_have(batch: pa.RecordBatch) -> list:
        cols: list[list] = [[] for _ in range(2 + WORDS)]
        for key, g in chosen(batch):
            own = g[in_map(known.value, g)]
            if len(g) - len(own) < most_that_differ(len(g)):
                bits = _majority(iter(np.split(g.view(np.uint64), range(BLOCK, len(g), BLOCK))), WORDS)
                for col, x in zip(cols, (key, own, *np.array(bits, np.uint64).view(np.int64).tolist()), strict=True):
                    col.append(x)
        return cols

    f = [f"f{k}" for k in range(WORDS)]
    rows = emit_arrow(docs, may_have, "key long, own array<long>, " + ", ".join(f"{x} long" for x in f))
    rows = cut_table(rows.dropDuplicates(["key"]).join(classes, "key"))
    counted = rows.select("node", F.explode("own").alias("g")).join(shared, "g")
    counted = counted.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("by"))
    part, whole = SIMILAR
    most = F.col("size") - F.ceil(F.col("size") * part / whole) + 1
    take = (most - (F.col("size") - F.size("by"))).cast("int")
    rows = rows.select("node", "size", *f).join(counted, "node").where(take > 0)
    return cut_table(rows.select("node", "size", *f, F.col("by.g").alias("shared"), F.slice(F.col("by.g"), F.lit(1), take).alias("keys")))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have a Jaccard similarity of ``SIMILAR`` or more."""
    part, whole = SIMILAR
    side = lambda p: sets.select(F.col("node").alias(p), F.col("shared").alias(f"g{p}"), F.col("size").alias(f"n{p}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.select("a", "b", (F.col("na") + F.col("nb")).alias("total"), F.size(F.array_intersect("ga", "gb")).alias("common"))
    return both.where(F.col("common") * whole >= (F.col("total") - F.col("common")) * part).select("a", "b")


def simhash_links(sets: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) of similar sets that SimHash finds; ``sets`` as of ``blocks_of_similar``.

    Fingerprints within ``distance`` bits meet under the masks of ``near_links``, of which links to the first of each
    component come out, and equal ones link to the least node; an exact check of the sets follows. Links grow with the
    sets, not with the pairs of a group.
    """
    first = cut(sets.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("first")))
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    equal = sets.select(F.col("f0").alias("fp"), "node").join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = near_links(first.select("fp"), distance).join(end("a"), "a").join(end("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return cut(verified(equal.unionByName(close), sets))


def _common(shared: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles the sets ``x`` have in common with the sets ``y``, by products of a few shingles' columns."""
    total = np.zeros((len(x), len(y)), np.int64)
    sides = []
    for side in (x, y):
        own = shared.take(pa.array(side))
        n = np.diff(own.offsets.to_numpy())
        sides.append((np.repeat(np.arange(len(side)), n), own.flatten().to_numpy(zero_copy_only=False)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    placed = []
    for row, g in sides:
        known = np.isin(g, both)
        row, at = row[known], np.searchsorted(both, g[known])
        by = np.argsort(at, kind="stable")
        placed.append((row[by], at[by]))
    for first in range(0, len(both), SHINGLES_AT_ONCE):
        parts = []
        for (row, at), n in zip(placed, (len(x), len(y)), strict=True):
            part = slice(*np.searchsorted(at, [first, first + SHINGLES_AT_ONCE]))
            held = np.zeros((n, min(SHINGLES_AT_ONCE, len(both) - first)), np.float32)
            held[row[part], at[part] - first] = 1
            parts.append(held)
        total += (parts[0] @ parts[1].T).astype(np.int64)
    return total


def _similar_in_chunks(rows: pa.Table) -> pa.Table:
    """(a, b) links among the rows of chunk ``i`` of a block and those of chunk ``j``: each to the first of its component."""
    part, whole = SIMILAR
    rows = rows.combine_chunks()
    node, label, size, own = (rows[c].to_numpy() for c in ("node", "label", "size", "own"))
    f = np.column_stack([rows[f"f{k}"].to_numpy() for k in range(WORDS)])
    x, y = (np.flatnonzero(own == rows[c][0].as_py()) for c in ("i", "j"))
    fits = (label[x][:, None] != label[y][None, :]) & (np.minimum(size[x][:, None], size[y][None, :]) * whole >= np.maximum(size[x][:, None], size[y][None, :]) * part) & (_apart(f[x], f[y]) <= DISTANCE)
    some_x, some_y = fits.any(axis=1), fits.any(axis=0)
    x, y, fits = x[some_x], y[some_y], fits[some_x][:, some_y]
    root = np.arange(len(node))
    if len(x):
        common = _common(rows["shared"].chunk(0), x, y)
        alike = fits & (common * whole >= (size[x][:, None] + size[y][None, :] - common) * part)
        while True:
            before = root.copy()
            root[x] = np.minimum(root[x], np.where(alike, root[y][None, :], len(node)).min(axis=1))
            root[y] = np.minimum(root[y], np.where(alike, root[x][:, None], len(node)).min(axis=0))
            if (root == before).all():
                break
    far = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": pa.array(node[root[far]], pa.int64()), "b": pa.array(node[far], pa.int64())})


def chunk_links(met: DataFrame, sets: DataFrame, first: int, end: int) -> DataFrame:
    """(a, b) links that join the similar sets of each block of ``met``, of which one lies in the chunks from ``first`` to before ``end``.

    A block is dealt to pairs of chunks of about ``CHUNK`` rows. A task compares a pair of them and sends on a link a row at
    most, never all pairs; no join sees a block, so a block of many rows is not cut in very many tasks.
    """
    last = F.ceil(F.col("n") / CHUNK).cast("int") - 1
    dealt = met.withColumn("own", F.least(F.floor(F.col("place") / CHUNK).cast("int"), last))
    with_ones = F.filter(F.sequence(F.lit(0), last), lambda other: (F.least("own", other) >= first) & (F.least("own", other) < end))
    dealt = dealt.select("key", "node", "label", "own", F.explode(with_ones).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    rows = dealt.join(sets.select("node", "size", *[f"f{k}" for k in range(WORDS)], "shared"), "node")
    return rows.groupBy("key", "i", "j").applyInArrow(_similar_in_chunks, "a long, b long").distinct()


def similar_links(sets: DataFrame, few: int = FEW, pivots: int = PIVOTS, growth: int = GROWTH, found: DataFrame | None = None) -> DataFrame:
    """(a, b) links that join all similar sets, transitively; ``sets`` as of ``blocks_of_similar``, ``found`` links known so far.

    Blocks whose rows the links found so far already join are done.
    Sets that share a block are compared: sizes, then fingerprints, then the sets themselves. A block of few rows is
    compared at once. In a larger one some rows, picked by hash, are compared with all; if it then still holds rows of
    several components, ``growth`` times as many, until none does or all pairs were compared; from the third turn on chunks
    of rows are compared (``chunk_links``). No row is ever copied but to those rows, and no pair is left out that could
    change a component. A block of many rows that are close but hardly similar costs their pairs in the end.
    """
    part, whole = SIMILAR
    f = [f"f{k}" for k in range(WORDS)]
    rows = sets.select("node", "size", *f, F.explode("keys").alias("key"))
    blocks = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    place = F.shiftrightunsigned(F.xxhash64("node"), 11) / float(1 << 53)
    met = rows.join(blocks, "key").withColumn("place", place * F.col("n"))
    if found is None:
        met = cut(met.withColumn("label", F.col("node")))
    else:
        met = cut(met.join(labelled(sets, found, "node"), "node"))
        met = cut(met.join(mixed_blocks(met), "key"))
        if met.isEmpty():
            return found
    links, seen, turn, done = found, None, 0, 0
    while True:
        if turn < JOINED_TURNS:
            x = met.where((F.col("n") <= few) | (F.col("place") < pivots)).alias("x")
            y = met.alias("y")
            c = lambda side, name: F.col(f"{side}.{name}")
            before = (c("x", "place") < c("y", "place")) | (c("x", "place") == c("y", "place")) & (c("x", "node") < c("y", "node"))
            apart = sum((F.bit_count(c("x", k).bitwiseXOR(c("y", k))) for k in f), F.lit(0))
            fits = before & (c("x", "label") != c("y", "label")) & (F.least(c("x", "size"), c("y", "size")) * whole >= F.greatest(c("x", "size"), c("y", "size")) * part) & (apart <= DISTANCE)
            pairs = x.join(y, (c("x", "key") == c("y", "key")) & fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
            pairs = cut(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
            good = cut(verified(pairs, sets))
            seen = pairs if seen is None else seen.unionByName(pairs)
        else:
            ends = -(-pivots // CHUNK)
            good, done, pivots = cut(chunk_links(met, sets, done, ends)), ends, ends * CHUNK
        links = good if links is None else links.unionByName(good)
        rest = met.where((F.col("n") > few) & (F.col("n") > pivots) & (F.col("place") >= pivots)).drop("label")
        if rest.isEmpty():
            return links
        rest = cut(rest.join(labelled(rest, links, "node"), "node"))
        met, pivots, turn = cut(rest.join(cut(mixed_blocks(rest)), "key")), pivots * growth, turn + 1
        x = y = pairs = rest = None
        freed(sets.sparkSession)
        if met.isEmpty():
            return links


def mixed_blocks(rows: DataFrame) -> DataFrame:
    """The ``key`` of blocks with more than one ``label``."""
    return rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")


def labelled(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """Distinct ``node`` -> (node, label): the smallest node reached over links."""
    found = connected_components(links)
    return nodes.select(node).distinct().join(found.withColumnRenamed("node", node), node, "left").select(node, F.coalesce("label", node).alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, blocks: int = 6, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each input row.

    Words are runs of other than bytes 9-13 and 32, A-Z lowered; null and empty texts have fingerprint zero and link
    like any other. ``component_id`` is the smallest non-null id reached over links of at most ``distance`` bits (null
    only if every id is). Equal fingerprints are one node, whatever the number of copies; repeated rows stay. Other
    columns are not read.
    """
    prints = cut(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", ["doc_id"], width))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = labelled(classes, near_links(classes.select("fp"), distance, blocks), "fp").join(classes, "fp")
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = labels.join(least, "label").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` without near-copies: of each component the row with the smallest id (nulls last), then text digest.

    Texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash joins the sets whose
    64-bit fingerprints differ in 3 bits at most (``simhash_links``); an exact step then compares the sets that share a
    block and are not yet joined, for similar sets may differ in more bits. Null and empty texts are copies of each
    other. Columns stay as they are; of repeated equal rows one stays.
    """
    cols = docs.columns
    keyed = docs.withColumn("__key", F.xxhash64(F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text))

    def kernel(batch: pa.RecordBatch) -> list:
        sets = [distinct_shingles(t, width) for t in texts(batch, "text")]
        node = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in sets], np.uint64).view(np.int64)
        return [pa.array(node), pa.array([len(g) for g in sets], pa.int64())]

    slim = keyed.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col("__key").alias("key"), F.col(text).alias("text"))
    slim = append_arrow(slim, kernel, "node long, size long", ["id", "h", "key"])
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("h").alias("h"), F.col("key").alias("key"))
    classes = cut(slim.groupBy("node").agg(F.min(order).alias("first"), F.min("size").alias("size")))
    sets = blocks_of_similar(keyed.select(F.col("__key").alias("key"), F.col(text).alias("text")), classes.select("node", "size", "first.key"), width)
    labels = labelled(classes, similar_links(sets, found=simhash_links(sets)), "node").join(classes.select("node", "first"), "node")
    freed(docs.sparkSession)
    kept = labels.groupBy("label").agg(F.min("first").alias("k")).select(F.col("k.key").alias("__key"))
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*cols)
