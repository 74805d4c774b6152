"""Ranked lexical search of a table of items over all documents by branch and bound on document FP-trees.

A document is restricted to the terms of the items, most frequent first, so documents of like vocabulary share a path in
a trie. Documents are range-sorted by that path and cut into blocks; each block is a trie whose nodes hold the maxima of
term frequencies and the minimum of ``m`` in their subtrees. Per item the trie is searched depth first: a node whose bound,
the score that its maxima and minimum would give, is below the item's tenth best score is left out. Blocks of one task go
on with the best of those before. Scores are integers, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_arrow, cut_table, emit_arrow, texts

#: Terms of a group of items; a group's terms and items are broadcast, and each group is searched over all documents.
GROUP_TERMS = 1 << 14
#: Nodes of a trie that are opened together.
TOGETHER = 64
#: Integers in the table of maxima of one trie.
CELLS = 1 << 23
#: The term rule's characters, as bytes; every byte of a character above U+007F belongs to terms.
KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a UTF-8 text in order: runs of ASCII letters and digits and of all other characters, A-Z lowered."""
    return text.translate(KEPT).split() if text else []


def scores(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The score of each row of counts: rises with ``tf``, falls with ``m``.

    Doubles divide integers below 2**52 as exactly as integers do, once rounded down, and sum integers below 2**53 exactly.
    """
    if tf.max(initial=0) < 1 << 22 and len(weight) < 1 << 18:
        tf = tf.astype(np.float64)
        return (np.floor(1e9 * tf / (1000.0 * tf + 8.0 * m[:, None])) @ weight.astype(np.float64)).astype(np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 8 * m[:, None])) @ weight


@dataclass
class Trie:
    """Nodes of one block: the documents first, in the order of their paths, then inner nodes; the last one is the root."""

    maxima: np.ndarray  # node x term: the most occurrences in the subtree
    least_m: np.ndarray
    children: list[np.ndarray]  # of the inner nodes
    n_docs: int


def build(paths: list[bytes], tfs: list[np.ndarray], m: np.ndarray, n_terms: int) -> Trie:
    """The trie of documents whose ``paths`` (four bytes a term) are sorted; chains of single children are one node."""
    n = len(paths)
    maxima = np.zeros((2 * n + 1, n_terms), np.int32)
    paths = [np.frombuffer(p, ">u4").astype(np.int64) for p in paths]
    for k, (p, t) in enumerate(zip(paths, tfs, strict=True)):
        maxima[k, p] = t
    least = np.zeros(2 * n + 1, np.int64)
    least[:n] = m
    children: list[np.ndarray] = []

    def close(own: list[int]) -> int:
        if len(own) == 1:
            return own[0]
        at = n + len(children)
        kids = np.array(own)
        maxima[at] = maxima[kids].max(axis=0)
        least[at] = least[kids].min()
        children.append(kids)
        return at

    open_: list[tuple[int, list[int]]] = [(0, [])]  # (terms of the path, nodes below), the root first
    before = np.zeros(0, np.int64)
    for k, p in enumerate(paths):
        upto = min(len(p), len(before))
        parted = np.flatnonzero(p[:upto] != before[:upto])
        shared = int(parted[0]) if len(parted) else upto
        while open_[-1][0] > shared:
            node = close(open_.pop()[1])
            if open_[-1][0] < shared:
                open_.append((shared, []))
            open_[-1][1].append(node)
        if open_[-1][0] < shared:  # the last document was a child of a shorter path
            open_.append((shared, [open_[-1][1].pop()]))
        open_[-1][1].append(k)
        before = p
    while len(open_) > 1:
        _, own = open_.pop()
        open_[-1][1].append(close(own))
    root = open_[0][1]
    if len(root) > 1 or root[0] < n:  # else the one inner node below it was made last and takes its place
        kids = np.array(root)
        maxima[n + len(children)], least[n + len(children)] = maxima[kids].max(axis=0), least[kids].min()
        children.append(kids)
    used = n + len(children)
    return Trie(maxima[:used], least[:used], children, n)


class Best:
    """The best documents of one item so far: (score, smaller id first)."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], 1

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows)[: self.k]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def search(trie: Trie, terms: np.ndarray, weight: np.ndarray, best: Best, ids: list) -> int:
    """Depth first, the node of the highest bound first; a bound equal to the last kept score may hide a smaller id and stays.

    The next few nodes of the stack are opened together, so that one call bounds all their children. Gives the number of
    nodes that were bounded.
    """
    seen, n = 0, trie.n_docs
    bounds, nodes = np.full(1, np.iinfo(np.int64).max), np.array([len(trie.maxima) - 1])
    while len(nodes):
        live = bounds >= best.floor
        bounds, nodes = bounds[live], nodes[live]
        now, bounds, nodes = nodes[-TOGETHER:], bounds[:-TOGETHER], nodes[:-TOGETHER]
        if not len(now):
            break
        kids = np.concatenate([trie.children[k] for k in (now - n).tolist()])
        score = scores(weight, trie.maxima[kids[:, None], terms], trie.least_m[kids])
        seen += len(kids)
        keep = score >= best.floor
        kids, score = kids[keep], score[keep]
        docs = kids < n
        if docs.any():
            best.add([(-s, *ids[k]) for s, k in zip(score[docs].tolist(), kids[docs].tolist(), strict=True)])
        kids, score = kids[~docs], score[~docs]
        order = np.argsort(score, kind="stable")
        bounds, nodes = np.concatenate([bounds, score[order]]), np.concatenate([nodes, kids[order]])
    return seen


def _restricted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms binary, tfs binary) of documents with a term: places in ``vocabulary`` and counts, as int32."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def kernel(batch: pa.RecordBatch) -> list:
        place = known.value
        n, terms, tfs = [], [], []
        for text in batch.column(batch.schema.get_field_index("utf8")).to_pylist():
            words = terms_of(text)
            count = Counter(words)
            own = [(place[t], c) for t, c in count.items() if t in place]
            n.append(len(words))
            terms.append(np.array([p for p, _ in own], np.int32).tobytes())
            tfs.append(np.array([c for _, c in own], np.int32).tobytes())
        return [n, terms, tfs]

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("utf8"))
    return append_arrow(slim, kernel, "n long, terms binary, tfs binary", keep=["doc_id"]).where("n > 0")


def _paths(rows: DataFrame, rank: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """(doc_id, m, path, tfs): terms as their ranks by frequency (four bytes, the most frequent first), counts beside them."""
    shared = rows.sparkSession.sparkContext.broadcast(rank)

    def kernel(batch: pa.RecordBatch) -> list:
        paths, tfs = [], []
        for t, c in zip(batch.column(batch.schema.get_field_index("terms")).to_pylist(), batch.column(batch.schema.get_field_index("counts")).to_pylist(), strict=True):
            r = shared.value[np.frombuffer(t, np.int32)]
            order = np.argsort(r)
            paths.append(r[order].astype(">u4").tobytes())
            tfs.append(np.frombuffer(c, np.int32)[order].tobytes())
        return [paths, tfs]

    m = F.expr(f"10 + (90L * n * {n_docs}L) div {n_words}L")
    slim = rows.where("length(terms) > 0").select("doc_id", m.alias("m"), "terms", F.col("tfs").alias("counts"))
    return append_arrow(slim, kernel, "path binary, tfs binary", keep=["doc_id", "m"])


def _best_of_blocks(paths: DataFrame, items: list[tuple[int, np.ndarray]], weight: np.ndarray, k: int) -> DataFrame:
    """(item long, doc_id, score): of each partition, which is sorted by path, the best ``k`` documents of each item."""
    shared = paths.sparkSession.sparkContext.broadcast((items, weight))
    size = max(16, CELLS // (2 * len(weight) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                get = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
                ids = [(i is not None, i) for i in get("doc_id")]
                trie = build(get("path"), [np.frombuffer(t, np.int32) for t in get("tfs")], np.array(get("m"), np.int64), len(weights))
                for (_, terms), own in zip(asked, best, strict=True):
                    search(trie, terms, weights[terms], own, ids)
        out = [(item, row[2], -row[0]) for (item, _), own in zip(asked, best, strict=True) for row in own.rows]
        cols = [[r[c] for r in out] for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

    return paths.mapInArrow(run, "item long, doc_id long, score long")


def _groups(items: DataFrame) -> list[list[tuple[int, list[bytes]]]]:
    """Items and their distinct terms, in groups of at most GROUP_TERMS terms in sum (one item may have more)."""
    groups: list[list[tuple[int, list[bytes]]]] = []
    held = GROUP_TERMS + 1
    for row in items.select("item", F.col("text").cast("binary").alias("utf8")).orderBy("item").toLocalIterator():
        terms = sorted(set(terms_of(bytes(row["utf8"] or b""))))
        if not terms:
            continue
        if held + len(terms) > GROUP_TERMS:
            groups.append([])
            held = 0
        groups[-1].append((row["item"], terms))
        held += len(terms)
    return groups


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    ``docs``: doc_id, text; ``items``: item_id, text. Weights, lengths and scores are those of the ``op12`` contract. An
    item row is an item of its own, also if its id is null or repeated. Rows of ``docs`` with a null or a repeated id are
    documents of their own; of equal scores null ids come first, then smaller ones. Texts that are null or have no term
    rank nowhere and count for nothing; an item without terms, or whose terms are in no document, has no row.

    Items are the query set: their terms and theirs alone are gathered in the driver, in groups of bounded size, and each
    group is searched against all documents. Texts are read once a group, into vectors of the group's terms; the vectors
    are range-sorted by path, ties by a running number, so copies of one document may lie in many tasks.
    """
    numbered = cut_table(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    found = None
    for group in _groups(numbered):
        vocabulary = sorted({t for _, terms in group for t in terms})
        rows = cut_table(_restricted(docs, vocabulary))
        n_docs, n_words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in _frequencies(rows).collect():  # at most GROUP_TERMS rows
            df[term] = n
        order = np.lexsort((np.arange(len(df)), -df))
        rank = np.empty(len(df), np.int64)
        rank[order] = np.arange(len(df))
        place = {t: r for t, r in zip(vocabulary, rank.tolist(), strict=True)}
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df[order].tolist()], np.int64)
        asked = [(item, np.array(sorted(place[t] for t in terms), np.int64)) for item, terms in group]
        by = ["path", "tie"]
        paths = _paths(rows, rank, n_docs, max(n_words, 1)).withColumn("tie", F.monotonically_increasing_id())
        paths = paths.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
        own = _best_of_blocks(paths, asked, weight, k)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _frequencies(rows: DataFrame) -> DataFrame:
    """(term, df) over restricted vectors; counted in each task before the shuffle."""

    def kernel(batch: pa.RecordBatch) -> list:
        found = [np.zeros(0, np.int32), *(np.frombuffer(t, np.int32) for t in texts(batch, "terms"))]
        term, n = np.unique(np.concatenate(found), return_counts=True)
        return [pa.array(term, pa.int32()), pa.array(n, pa.int64())]

    return emit_arrow(rows.select("terms"), kernel, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Every item against every document that shares a term.
RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT d, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM d) GROUP BY d, term),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM items),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df CROSS JOIN total),
m AS (SELECT d, doc_id, 10 + (90 * n * nn) // ll AS m FROM sized CROSS JOIN total),
scored AS (
  SELECT i, item_id, tf.d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.d = tf.d GROUP BY i, item_id, tf.d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
