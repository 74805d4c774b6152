"""Merkle manifest of a dataset by time-forward processing, with an inclusion proof for every row.

Nodes are labelled (level, place) and treated in the order of their labels. What a node computes travels forward to its
parent through a priority queue ordered by label. The queue's external part is Spark's shuffle: levels are cut into
bands, and a band's digests reach the next one sorted by label, through files that spill. Inside a band, blocks of
``2 ** BAND`` neighbours are independent, and the front of the queue is a heap of at most that many messages. A reversed
sweep, band by band from the root, sends each node's proof suffix (the siblings between it and the root) to its children.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_table

#: Levels of a band; a block of a band has at most 2 ** BAND nodes.
BAND = 10
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256 of the parts put together."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def forward(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """Digests of all levels above ``nodes``, neighbours of one block, lowest first.

    The heap hands out children in the order of their labels, so both children of a node come one after the other.
    """
    base = len(nodes)
    queue: list[tuple[int, bytes]] = [(k, d) for k, d in enumerate(nodes)]  # label: level * base + place
    out: list[list[bytes]] = [[] for _ in range(levels + 1)]
    while queue:
        label, one = heapq.heappop(queue)
        level, place = divmod(label, base)
        out[level].append(one)
        if level == levels:
            continue
        own = [one]
        if queue and queue[0][0] == label + 1 and place + 1 < base:
            own.append(heapq.heappop(queue)[1])
            out[level].append(own[1])
        heapq.heappush(queue, ((level + 1) * base + place // 2, digest(*own)))
    return out


def backward(levels: list[list[bytes]], suffix: list[bytes]) -> list[list[bytes]]:
    """The proof of each lowest node, from that of the block's top node: labels in falling order, parents before children.

    A step of a proof is ``l`` or ``r`` (the side of the sibling) and its digest, or ``-`` where the node has none.
    """
    top = len(levels) - 1
    queue: list[tuple[int, int, list[bytes]]] = [(-top, 0, suffix)]
    out: list[list[bytes]] = [[]] * len(levels[0])
    while queue:
        level, place, proof = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            out[place] = proof
            continue
        below = levels[level - 1]
        a, b = 2 * place, 2 * place + 1
        if b < len(below):
            heapq.heappush(queue, (1 - level, -a, [b"r" + below[b], *proof]))
            heapq.heappush(queue, (1 - level, -b, [b"l" + below[a], *proof]))
        else:
            heapq.heappush(queue, (1 - level, -a, [b"-", *proof]))
    return out


def fold(leaf: bytes, proof: list[bytes]) -> bytes:
    """The root that a leaf and its proof give."""
    for step in proof:
        leaf = digest(leaf) if step == b"-" else digest(leaf, step[1:]) if step[:1] == b"r" else digest(step[1:], leaf)
    return leaf


def placed(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their number from 0 within ``tree`` in ``order``, and ``n``, the size of the tree.

    One range sort over all trees; equal rows are told apart by a running number, so no key or tree has to lie in one
    task. Of each part of a tree only the count is put in order.
    """
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*tree, *order, "tie"]]
    dealt = tie.repartitionByRange(*by).sortWithinPartitions(*by)
    part = dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    part = cut_table(part.drop("tie"))
    counts = part.groupBy(*tree, "part").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    w = Window.partitionBy(*tree)
    counts = counts.withColumn("before", F.sum("own").over(w.orderBy("part")) - F.col("own")).withColumn("n", F.sum("own").over(w))
    counts = counts.select(*[F.col(c).alias(f"t_{c}") for c in tree], F.col("part").alias("t_part"), "first", "before", "n")
    same = F.col("part") == F.col("t_part")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    both = part.join(counts, same)
    return both.withColumn("place", F.col("at") - F.col("first") + F.col("before")).select(*rows.columns, "place", "n")


def levels_of(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: the bits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    slim = nodes.select("tree", F.shiftright("place", BAND).alias("block"), "place", "digest", "depth", *extra)
    return slim.groupBy("tree", "block")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``nodes``: tree long, place long, digest string, depth int (levels to go), as a table.

    Gives the nodes that enter each band, lowest first, and (tree, root). The driver sees the largest depth only.
    """
    deep = nodes.agg(F.max("depth")).first()[0] or 0
    bands = [nodes]

    def sweep(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        depth = block.column("depth")[0].as_py()
        up = min(BAND, depth)
        top = forward([d.encode() for d in block.column("digest").to_pylist()], up)[up][0]
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "digest": [top.decode()], "depth": pa.array([depth - up], pa.int32())})

    while deep > 0:
        up = _blocks(bands[-1], []).applyInArrow(sweep, "tree long, place long, digest string, depth int")
        bands.append(cut_table(up))
        deep -= BAND
    return bands, bands[-1].select("tree", F.col("digest").alias("root"))


def descend(bands: list[DataFrame], suffix: DataFrame) -> DataFrame:
    """(tree, place, proof array<string>) of the nodes of the lowest band, from (tree, proof) of the roots."""
    tops = bands[-1].select("tree", "place").join(suffix, "tree")

    def sweep(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        levels = forward([d.encode() for d in block.column("digest").to_pylist()], min(BAND, block.column("depth")[0].as_py()))
        proofs = backward(levels, [s.encode() for s in block.column("proof")[0].as_py()])
        return pa.table({"tree": block.column("tree"), "place": block.column("place"), "proof": pa.array([[s.decode() for s in p] for p in proofs], pa.list_(pa.string()))})

    for k in range(len(bands) - 2, -1, -1):
        here = bands[k].withColumn("block", F.shiftright("place", BAND)).join(tops.withColumnRenamed("place", "block"), ["tree", "block"]).drop("block")
        tops = _blocks(here, ["proof"]).applyInArrow(sweep, "tree long, place long, proof array<string>")
        tops = tops if k == 0 else cut_table(tops)
    return tops


def _checked(rows: DataFrame) -> DataFrame:
    """Appends proof_sha256 and folded_root to (leaf, changed, proof)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("proof")
            proofs = [[s.encode() for s in p] for p in batch.column(at).to_pylist()]
            leaves = [(b or a).encode() for a, b in zip(batch.column("leaf").to_pylist(), batch.column("changed").to_pylist(), strict=True)]
            made = [[digest(*[s[1:] for s in p]).decode() for p in proofs], [fold(x, p).decode() for x, p in zip(leaves, proofs, strict=True)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=[*batch.schema.names, "proof_sha256", "folded_root"])

    slim = rows.select("doc_id", "leaf", "changed", "subroot", "root", "proof")
    return slim.mapInArrow(run, "doc_id long, leaf string, changed string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string")


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, with_proof: bool = False) -> DataFrame:
    """Leaf, subtree root, root and proof of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Languages are subtrees, their leaves in the order of ``doc_id``; rows of one id are ordered by their leaf, equal rows
    are leaves of their own, and null ids and a null language come first. ``tampered``: rows whose ``n_chars`` is read as
    one more when their leaf is recomputed and folded with the proof (a null stays, and so does the leaf). Gives doc_id,
    leaf, subroot, root, proof_sha256, folded_root, verified and, with ``with_proof``, ``proof``: for each level from the
    leaf to the root ``l`` or ``r`` (the sibling's side) and its digest, or ``-``. Other columns are not read. An empty
    table has no row, and a table of one row is its own root.

    Texts are read once and leave the scan as digests. Rows move three times, at about a hundred bytes each: to their
    place, and to their block in each sweep. A block's digests are computed anew in the reversed sweep, which costs less
    than keeping them.
    """
    altered = F.when(F.lit(False) if tampered is None else tampered, F.col("n_chars") + 1)
    v = {c: F.col(c) for c in FIELDS}
    leaves = docs.select("doc_id", "lang", leaf_digest(*v.values()).alias("leaf"), F.when(altered.isNotNull(), leaf_digest(*(v | {"n_chars": altered}).values())).alias("changed"))
    rows = placed(cut_table(leaves), ["lang"], ["doc_id", "leaf"])
    # languages, numbered in their order, are leaves of the tree on top
    langs = placed(rows.where("place = 0").select("lang"), [], ["lang"]).toDF("lang", "tree", "langs")
    langs = cut_table(langs)
    rows = rows.join(langs.select(F.col("lang").alias("l"), "tree"), F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    rows = cut_table(rows.select("tree", "place", F.col("leaf").alias("digest"), levels_of(F.col("n")).alias("depth"), "doc_id", "changed"))
    bands, subroots = climb(rows)
    subroots = cut_table(subroots)
    tops = subroots.join(langs, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("root").alias("digest"), levels_of(F.col("langs")).alias("depth"))
    over, root = climb(cut_table(tops))
    none = F.array().cast("array<string>")
    suffix = descend(over, root.select("tree", none.alias("proof"))).select(F.col("place").alias("tree"), "proof")
    roots = subroots.withColumnRenamed("root", "subroot").crossJoin(F.broadcast(root.select("root")))  # one row
    proofs = descend(bands, suffix)
    both = rows.withColumnRenamed("digest", "leaf").join(proofs, ["tree", "place"]).join(roots, "tree")
    out = _checked(both).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select("doc_id", "leaf", "subroot", "root", *["proof"] * with_proof, "proof_sha256", "folded_root", "verified")


def _crc(text: str) -> str:
    """CRC-32 of the bytes of an ASCII text, bit by bit."""
    step = "CASE WHEN x.c & 1 = 1 THEN xor(x.c >> 1, 3988292384) ELSE x.c >> 1 END"
    byte = f"list_reduce(list_prepend({{'c': xor(a.c, b.c)}}, [{{'c': 0::BIGINT}} for _ in range(8)]), lambda x, y: {{'c': {step}}})"
    bytes_ = f"[{{'c': ascii(s)::BIGINT}} for s in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend({{'c': 4294967295::BIGINT}}, {bytes_}), lambda a, b: {byte}).c, 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


_UP = "list_transform(generate_series(1, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i - 1] || coalesce(nodes[2 * i], '')))"
#: Trees level by level as lists; a leaf's siblings are looked up in the lists.
MANIFEST_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, * FROM (
    SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc('doc_id::VARCHAR')} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql('n_chars + 1')} END AS changed FROM documents)),
trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM rows GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_UP} FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_place FROM trees WHERE len(nodes) = 1),
over AS (
  SELECT 0 AS level, list(subroot ORDER BY lang_place) AS nodes FROM subroots HAVING count(*) > 0
  UNION ALL SELECT level + 1, {_UP} FROM over WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM over WHERE len(nodes) = 1),
steps AS (
  SELECT r.lang, r.place, t.level, nodes[xor(r.place >> t.level, 1) + 1] AS sib, (r.place >> t.level) & 1 AS odd FROM rows r JOIN trees t ON r.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT r.lang, r.place, s.depth + o.level, nodes[xor(s.lang_place >> o.level, 1) + 1], (s.lang_place >> o.level) & 1 FROM rows r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang CROSS JOIN over o WHERE len(nodes) > 1),
proofs AS (SELECT lang, place, list({{'sib': sib, 'odd': odd}} ORDER BY level) AS proof FROM steps GROUP BY lang, place),
made AS (
  SELECT r.doc_id, r.leaf, s.subroot, root.root, coalesce(r.changed, r.leaf) AS start, coalesce(p.proof, []) AS proof FROM rows r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root
  LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM r.lang AND p.place = r.place),
folded AS (
  SELECT *, list_reduce(list_prepend({{'sib': start, 'odd': 0}}, proof), lambda a, b: {{'sib': CASE WHEN b.sib IS NULL THEN sha256(a.sib) WHEN b.odd = 1 THEN sha256(b.sib || a.sib) ELSE sha256(a.sib || b.sib) END, 'odd': 0}}).sib AS folded_root FROM made)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate([s.sib for s in proof if s.sib IS NOT NULL], 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
