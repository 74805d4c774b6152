"""Media columns by content-defined chunking: payloads cut at rolling gear hashes, chunks shared between payloads stored
once, and ordered chunk lists from which the stored bytes are put together and verified.

The stored form of a payload is its manifest: ``CDC1``, the number of chunks, and the length and SHA-256 of each, in order.
It is written, read back, and all that names the chunks. Samples of chunks that other payloads have, too, lie with one
owner, found by joins on chunk digests; all others lie with their payload. Bodies are compressed at rest and in shuffles.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_arrow, cut_table, emit_arrow, ensure_checkpoint_dir, heavy_keys, join_dealt, texts

BLOCK, FILL = 576, b"\xff"
#: Chunk lengths: no cut before LEAST bytes, one at MOST, and in between where the top MASK_BITS of the hash are zero.
LEAST, MOST, MASK_BITS = 512, 8192, 11
#: Compression at rest: level, size of the dictionary, and the texts (of at most so many characters) that it is trained on.
LEVEL, DICTIONARY, DICTIONARY_TEXTS, DICTIONARY_CHARS = 6, 1 << 16, 1000, 20_000
SEED = 23

_NAME = "p1 long, p2 long"
_STORED = f"{_NAME}, n_bytes long, manifest binary, n_refs int, refs array<int>, owned array<int>, body binary, shared array<struct<d1: long, d2: long, body: binary>>"
_FEATURES = f"{_NAME}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@lru_cache(1)
def gear_table() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text (null: empty) filled with bytes 255 to a positive multiple of BLOCK, and its own length."""
    raw = (text or "").encode()
    return raw + FILL * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def chunk_ends(payload: bytes) -> list[int]:
    """Ends of the chunks: a gear hash of the last 32 bytes at each place, summed by doubling."""
    h = gear_table()[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    ends, start = [], 0
    for end in [*(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist(), len(payload)]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST or end == len(payload) and end > start:
            ends.append(end)
            start = end
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    ends = chunk_ends(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def name_of(payload: bytes) -> tuple[int, int]:
    """128 bits of SHA-256 as two longs."""
    d = hashlib.sha256(payload).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:16], "big", signed=True)


#: Bytes of a manifest before its entries, and of an entry's length and digest.
HEAD, LENGTH, DIGEST = 8, 4, 32
ENTRY = LENGTH + DIGEST


def manifest_of(chunks: list[bytes]) -> bytes:
    return b"CDC1" + len(chunks).to_bytes(4, "big") + b"".join(len(c).to_bytes(LENGTH, "big") + hashlib.sha256(c).digest() for c in chunks)


def entries_of(manifest: bytes) -> list[tuple[int, bytes]]:
    """Length and digest of each chunk."""
    if manifest[:4] != b"CDC1" or len(manifest) != HEAD + ENTRY * int.from_bytes(manifest[4:HEAD], "big"):
        raise ValueError("not a manifest")
    return [(int.from_bytes(manifest[a : a + LENGTH], "big"), manifest[a + LENGTH : a + ENTRY]) for a in range(HEAD, len(manifest), ENTRY)]


def features(chunks: list[bytes], manifest: bytes) -> list:
    """Of the bytes read back: sizes, digests and, as ``feature``, counts of the upper four bits of the samples."""
    if any(len(c) != n or hashlib.sha256(c).digest() != d for c, (n, d) in zip(chunks, entries_of(manifest), strict=True)):
        raise ValueError("a stored chunk does not have the length and digest of its manifest")
    payload = b"".join(chunks)
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(manifest), hashlib.sha256(manifest).hexdigest(), ",".join(map(str, counts))]


class Codec:
    """zstd with the dictionary of one store."""

    def __init__(self, dictionary: bytes):
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_dict_id=False).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=d).decompress


_codecs: dict[bytes, Codec] = {}


def codec(dictionary: bytes) -> Codec:
    key = hashlib.sha256(dictionary).digest()
    if key not in _codecs:
        _codecs[key] = Codec(dictionary)
    return _codecs[key]


def train_dictionary(docs: DataFrame, text: str) -> bytes:
    """From a bounded sample by hash order; results never depend on it. Too little to train on: none."""
    fit = docs.select(F.col(text).alias("t")).where(F.length("t").between(1, DICTIONARY_CHARS))
    # a hash threshold keeps a few times the sample, so what meets in one task to be ordered does not grow with the input
    share = min(1.0, 4 * DICTIONARY_TEXTS / max(1, fit.count()))
    fit = fit.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = fit.orderBy(F.xxhash64("t"), "t").limit(DICTIONARY_TEXTS).toArrow()
    raw = [t.encode() for t in some["t"].to_pylist()]
    try:
        return zstandard.train_dictionary(DICTIONARY, raw).as_bytes() if sum(map(len, raw)) > 20 * DICTIONARY else b""
    except zstandard.ZstdError:
        return b""


def write_media(docs: DataFrame, path: str, text: str = "text") -> None:
    """Stores the payloads of all texts under ``path``, each distinct one once, and the dictionary beside them.

    Only digests are joined: a chunk that several places have belongs to the one with the least hash. Places of a chunk
    that very many have are dealt to many tasks. The payloads themselves move once, compressed, and copies are dropped
    before they move.
    """
    dictionary = train_dictionary(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)

    def recipes(batch: pa.RecordBatch) -> list:
        cols: list[list] = [[], [], [], [], []]
        for t in texts(batch, "t"):
            payload = payload_of(t)[0]
            name = name_of(payload)
            for k, c in enumerate(chunks_of(payload)):
                for col, x in zip(cols, (*name, k, *name_of(c)), strict=True):
                    col.append(x)
        return cols

    def packed(batch: pa.RecordBatch) -> list:
        made = [payload_of(t) for t in texts(batch, "t")]
        names = [name_of(p) for p, _ in made]
        pack = codec(sent.value).pack
        return [[n[0] for n in names], [n[1] for n in names], [n for _, n in made], [pack(p) for p, _ in made]]

    def stored(batch: pa.RecordBatch) -> list:
        own = codec(sent.value)
        cols: list[list] = [[] for _ in range(6)]
        for z, marks in zip(texts(batch, "z"), texts(batch, "marks"), strict=True):
            chunks = chunks_of(own.unpack(z))
            refs = sorted(m >> 1 for m in marks or [] if not m & 1)
            owned = sorted(m >> 1 for m in marks or [] if m & 1)
            away = {*refs, *owned}
            body = own.pack(b"".join(c for k, c in enumerate(chunks) if k not in away))
            shared = [dict(zip(("d1", "d2", "body"), (*name_of(chunks[k]), own.pack(chunks[k])), strict=True)) for k in owned]
            for col, x in zip(cols, (manifest_of(chunks), len(refs), refs, owned, body, shared), strict=True):
                col.append(x)
        return [batch.column("p1"), batch.column("p2"), batch.column("n_bytes"), *cols]

    own = docs.select(F.col(text).alias("t"))
    recipe = emit_arrow(own, recipes, f"{_NAME}, k int, d1 long, d2 long").withColumn("o", F.xxhash64("p1", "p2", "k"))
    shared = recipe.groupBy("d1", "d2").agg(F.min("o").alias("owner"), F.max("o").alias("other"), F.count("*").alias("n")).where("owner <> other")
    shared = cut_table(shared.select("d1", "d2", "owner", "n"))
    marks = join_dealt(recipe, shared, ["d1", "d2"], heavy_keys(shared, ["d1", "d2"])).select("p1", "p2", (F.col("k") * 2 + (F.col("o") == F.col("owner")).cast("int")).alias("mark")).distinct()
    marks = marks.groupBy("p1", "p2").agg(F.collect_list("mark").alias("marks"))
    whole = emit_arrow(own, packed, f"{_NAME}, n_bytes long, z binary").dropDuplicates(["p1", "p2"]).join(marks, ["p1", "p2"], "left")
    emit_arrow(whole, stored, _STORED).write.option("compression", "none").parquet(f"{path}/media")
    docs.sparkSession.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Features of every stored payload, computed from the bytes read back; a chunk that fails its digest is an error.

    Payloads that have all their chunks are read where they lie; only those with chunks elsewhere meet them in joins.
    """
    sent = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()[0]))
    media = spark.read.parquet(f"{path}/media")

    def assembled(batch: pa.RecordBatch) -> list:
        unpack = codec(sent.value).unpack
        cols: list[list] = [[] for _ in range(6)]
        for row in batch.select(["manifest", "refs", "owned", "body", "shared", "pieces"]).to_pylist():
            away = {k: unpack(s["body"]) for k, s in zip(row["owned"], row["shared"], strict=True)}
            away |= {p["k"]: unpack(p["body"]) for p in row["pieces"] or []}
            body, at, chunks = unpack(row["body"]), 0, []
            for k, (n, _) in enumerate(entries_of(row["manifest"])):
                if k in away:
                    chunks.append(away[k])
                else:
                    chunks.append(body[at : at + n])
                    at += n
            for col, x in zip(cols, features(chunks, row["manifest"]), strict=True):
                col.append(x)
        return [batch.column("p1"), batch.column("p2"), batch.column("n_bytes"), *cols]

    chunks = media.where("size(owned) > 0").select(F.explode("shared").alias("s")).select("s.*")
    part = media.where("n_refs > 0")
    wanted = part.select("p1", "p2", F.explode("refs").alias("k"), "manifest")
    d = F.hex(F.col("manifest").substr(F.col("k") * ENTRY + (HEAD + LENGTH + 1), F.lit(DIGEST)))
    long_of = lambda a: F.shiftleft(F.conv(F.substring(d, a, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(d, a + 8, 8), 16, 10).cast("long"))
    wanted = wanted.select("p1", "p2", "k", long_of(1).alias("d1"), long_of(17).alias("d2"))
    counted = cut_table(wanted.groupBy("d1", "d2").agg(F.count("*").alias("n")))
    pieces = join_dealt(wanted, chunks, ["d1", "d2"], heavy_keys(counted, ["d1", "d2"])).groupBy("p1", "p2").agg(F.collect_list(F.struct("k", "body")).alias("pieces"))
    none = F.lit(None).cast("array<struct<k:int,body:binary>>")
    whole = media.where("n_refs = 0").withColumn("pieces", none)
    return emit_arrow(whole, assembled, _FEATURES).unionByName(emit_arrow(part.join(pieces, ["p1", "p2"]), assembled, _FEATURES))


def media_features(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row.

    Stores the payloads under ``path`` (a new folder in the shared checkpoint folder, if None), then reads them back.
    Null and empty texts are one payload of 576 bytes 255. Equal texts are one stored payload, so repeated rows and
    groups of copies cost a row of digests each; ``media_bytes`` and ``media_sha256`` are of the stored manifest, which names all
    samples by length and digest; rows keep their ids, also null ones. Other columns are not read.
    """
    path = path or f"{ensure_checkpoint_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write_media(docs, path, text)

    def names(batch: pa.RecordBatch) -> list:
        made = [name_of(payload_of(t)[0]) for t in texts(batch, text)]
        return [[a for a, _ in made], [b for _, b in made]]

    own = append_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text)), names, _NAME, ["doc_id"])
    return own.join(read_media(docs.sparkSession, path), ["p1", "p2"]).drop("p1", "p2")
