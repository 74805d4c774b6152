"""Merkle manifest, ranked lexical search and token shards against SQL, brute force and the tokenizers library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geotrail.llm import lexical_search, merkle, token_shards
from geotrail.llm.queries import ORACLE_SQL, QUERIES

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
LONG = ("lorem ipsum dolor sit amet the quick brown fox " * 3000).strip()
TEXTS = ["The quick brown fox", None, "", "  \t\n ", "Été à l'école <|endoftext|> ok", "The quick brown fox", LONG, "x" * 20_000, "漢字かな交じり文 🙂 \x1c\x85 z", "a  b   c \n\n d​ e\0f"]
CLASH = {"digest": "d", "place": 1, "tree": 2, "n": 3, "leaf": "l", "score": 4, "rank": 5, "path": "p", "key": 6, "shard": 7, "m": 8, "tie": 9, "changed": "c", "utf8": "u"}


def rows(df):
    cols = sorted(df.columns)
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted([tuple(r[i] for i in at) for r in rel.fetchall()], key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    data = [(i if i != 3 else None, t, None if i % 5 == 0 else "en" if i % 2 else "déjà", None if i % 4 == 0 else f"s{i % 3}", None if i == 8 else i) for i, t in enumerate(TEXTS)]
    data += [data[0], data[0], data[6], (0, "another text of document 0", "en", "s", 4), (None, "second of a null id", None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def tampered():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0


@pytest.mark.parametrize("name", ["op11_merkle", "op12_lexical"])
def test_sql_on_tables(spark, duck, sf, name):
    rel = duck.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert rows(QUERIES[name](spark, sf)) == sorted([tuple(r[i] for i in at) for r in rel.fetchall()], key=str)


# --- manifest


def test_manifest_on_odd_rows(odd, none):
    slim = odd.select("doc_id", "text", "lang", "source", "n_chars")
    out = merkle.merkle_manifest(odd, tampered())
    assert rows(out) == by_sql(merkle.MANIFEST_SQL, documents=slim)
    assert out.count() == odd.count()
    assert merkle.merkle_manifest(none, tampered()).count() == 0


def test_lone_document_is_its_own_root(odd):
    one = merkle.merkle_manifest(odd.where("doc_id = 2")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"]
    assert one["proof_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("band", [1, 2, 5])
def test_bands_and_sizes(spark, monkeypatch, band):
    """Any band gives the trees that plain levels give, whatever their sizes; every proof leads to its root."""
    monkeypatch.setattr(merkle, "BAND", band)
    leaves, roots = {}, {}
    for n in (1, 2, 3, 7, 8, 9, 37):
        level = leaves[n] = [hashlib.sha256(f"{n} {i}".encode()).hexdigest() for i in range(n)]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
        roots[n] = level[0]
    nodes = spark.createDataFrame([(n, i, d) for n, own in leaves.items() for i, d in enumerate(own)], "tree long, place long, digest string").withColumn("depth", merkle.levels_of(F.col("tree")))
    bands, root = merkle.climb(nodes)
    assert {r.tree: r.root for r in root.collect()} == roots
    proofs = merkle.descend(bands, root.select("tree", F.array().cast("array<string>").alias("proof"))).collect()
    assert len(proofs) == sum(leaves)
    assert all(merkle.fold(leaves[r["tree"]][r["place"]].encode(), [s.encode() for s in r["proof"]]).decode() == roots[r["tree"]] for r in proofs)


def test_tampering_shows(odd):
    everything = merkle.merkle_manifest(odd, F.lit(True)).join(odd.groupBy("doc_id").agg(F.max("n_chars").alias("n")), "doc_id")
    assert everything.where("verified and n is not null").count() == 0
    assert everything.where("n is null").count() == everything.where("n is null and verified").count() > 0


# --- search


def test_search_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the QUICK fox"), (1, "lorem, amet"), (None, "école à"), (3, None), (4, ""), (5, "absent"), (6, LONG + " fox")], "item_id long, text string").withColumns({"item": F.lit(1), "score": F.lit(2)})
    slim = odd.select("doc_id", "text")
    out = lexical_search.ranked_documents(odd, items)
    assert rows(out) == by_sql(lexical_search.RANKED_SQL, documents=slim, benchmark=items.select("item_id", "text"))
    assert lexical_search.ranked_documents(none, items).count() == 0
    assert lexical_search.ranked_documents(odd, items.limit(0)).count() == 0


def test_search_in_groups_and_blocks(spark, monkeypatch):
    """Small groups of items and small tries give the rows of large ones; ties go to the smaller id."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("a b c d e f g h i j k l m n".split()) for _ in range(rng.choice([1, 3, 9, 40])))) for i in range(400)] + [(1000 + i, "a b c") for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(i, " ".join(rng.sample("a b c d e f g h i j k l m n".split(), 4))) for i in range(12)], "item_id long, text string")
    exact = by_sql(lexical_search.RANKED_SQL, documents=docs, benchmark=items)
    assert rows(lexical_search.ranked_documents(docs, items)) == exact
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", 9)
    monkeypatch.setattr(lexical_search, "CELLS", 300)
    monkeypatch.setattr(lexical_search, "TOGETHER", 2)
    assert rows(lexical_search.ranked_documents(docs, items)) == exact


def test_bounds_leave_nodes_out():
    """The trie's documents are those given, every bound is at least the scores below it, and few nodes are opened."""
    rng = np.random.default_rng(5)
    vectors = [np.sort(rng.choice(60, size=rng.integers(1, 12), replace=False, p=np.arange(60, 0, -1) / 1830)) for _ in range(900)]
    vectors.sort(key=lambda v: v.astype(">u4").tobytes())
    tfs, m = [rng.integers(1, 9, len(v)).astype(np.int32) for v in vectors], rng.integers(10, 900, 900)
    trie = lexical_search.build([v.astype(">u4").tobytes() for v in vectors], tfs, m, 60)
    seen, stack = [], [len(trie.maxima) - 1]
    while stack:
        node = stack.pop()
        for kid in trie.children[node - trie.n_docs].tolist():
            assert (trie.maxima[kid] <= trie.maxima[node]).all() and trie.least_m[kid] >= trie.least_m[node]
            (seen if kid < trie.n_docs else stack).append(kid)
    assert sorted(seen) == list(range(900))
    weight, terms = np.arange(60) * 100 + 1, np.array([40, 50, 55])
    best = lexical_search.Best(10)
    opened = lexical_search.search(trie, terms, weight[terms], best, [(True, i) for i in range(900)])
    tf = np.zeros((900, 60), int)
    for i, (v, t) in enumerate(zip(vectors, tfs, strict=True)):
        tf[i, v] = t
    score = lexical_search.scores(weight[terms], tf[:, terms], m)
    want = sorted((-s, True, i) for i, s in enumerate(score.tolist()) if s > 0)[:10]
    assert best.rows == want and opened < len(trie.maxima) / 2


def test_scores_in_doubles_are_those_in_integers():
    rng = np.random.default_rng(1)
    tf, m, weight = rng.integers(0, 1 << 22, (500, 7)), rng.integers(10, 10**12, 500), rng.integers(0, 30_000, 7)
    whole = (10**9 * tf // (1000 * tf + 8 * m[:, None])) @ weight
    assert (lexical_search.scores(weight, tf, m) == whole).all()
    large = tf.copy()
    large[0, 0] = 1 << 22  # beyond what doubles divide exactly
    assert (lexical_search.scores(weight, large, m)[1:] == whole[1:]).all()


# --- shards


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def expected(library, texts):
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    starts = np.cumsum([0, *map(len, ids)])
    return [(int(a), len(x), zlib.crc32(x.tobytes())) for a, x in zip(starts, ids, strict=False)]


def test_shards_of_a_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(d["doc_id"], *e) for d, e in zip(docs, expected(library, [d["text"] for d in docs]), strict=True)]
    assert sorted(map(tuple, QUERIES["op13_token_ids"](spark, sf).collect())) == want


def test_shards_on_odd_rows(odd, none, library, monkeypatch):
    """Every row comes back once, also of repeated and null ids and over several shards of two documents."""
    for limit in (1 << 22, 2):
        monkeypatch.setattr(token_shards, "SHARD_DOCS", limit)
        shards = token_shards.write_shards(odd, VOCAB)
        out = token_shards.lookup(shards, odd.select("doc_id").distinct(), with_ids=True).collect()
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *e[1:]) for r in odd.collect() for e in expected(library, [r["text"]]))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
        in_order = sorted(out, key=lambda r: r["start"])
        assert [r["start"] for r in in_order] == np.cumsum([0, *(r["n_tokens"] for r in in_order)])[:-1].tolist()
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in in_order]
        assert keys == sorted(keys)
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)
    shards = token_shards.write_shards(none, VOCAB)
    assert shards.names == [] and token_shards.lookup(shards, odd.select("doc_id").distinct()).count() == 0


def test_keys_that_are_not_there(spark, odd):
    shards = token_shards.write_shards(odd.where("doc_id is not null"), VOCAB)
    asked = spark.createDataFrame([(k,) for k in (-5, 3, 77, 10**15, None)], "k long")
    assert token_shards.lookup(shards, asked).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n)) if n != 5000 else np.arange(5000)
    code = token_shards.codes(keys)
    index = token_shards.PerfectHash.of(code)
    assert sorted(index.slots(code).tolist()) == list(range(len(keys)))
    assert len(index.words) * 64 <= 5 * n + 64 * 40


def test_chunks_have_the_ids_of_whole_texts(library):
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "a", "'s", "é", "漢", "1", "<|endoftext|>", "\0", "\x1c", "\x85", "​", "᠎", "﻿", ".", "\r\n", "🙂", "ab", "ſ", "́", "\xa0", "　", ".", ",", "ñ", "ß.", "ʰ", "ª", "“"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)]
    encoder = token_shards.ChunkEncoder.from_json(open(VOCAB, "rb").read())
    assert encoder.in_chunks
    for _ in range(2):  # from the library, then from what was kept
        assert [np.frombuffer(r, "<u2").tolist() for r in encoder.encode_all([t.encode() for t in texts])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
