"""Token ids as raw binary shards, each with a minimal perfect hash index from document keys to places.

Documents are range-sorted by key; each task encodes its range and writes shard files. A shard is the raw ids of its
documents, then an index: where each document starts, its key, and a minimal perfect hash of the distinct keys (levels of
bits: a key that is alone at its place of a level sets that bit, others go on to the next level; the number of bits set
before it is its slot), with a fingerprint, the first document and the number of documents in each slot. So access by key
reads a few fixed places of one shard, whatever its size.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import ENTRY_BYTES
from .common import cut_table, emit_arrow, ensure_checkpoint_dir, texts
from .substring_dedup import mix

#: A shard is closed beyond so many documents or ids.
SHARD_DOCS, SHARD_IDS = 1 << 22, 1 << 31
#: Bits of a level for each key that comes to it, and the salt between levels.
GAMMA, LEVEL_SALT, PRINT_SALT = 2, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes that a Python worker spends on the ids of chunks of text, and bytes of a chunk that is kept.
CHUNK_BYTES, CHUNK_SIZE = 384 << 20, 48
#: Bytes of texts that are encoded together.
SLICE_SIZE = 1 << 21
#: Shards that a task reads, and bytes of neighbouring documents that one read takes.
TASK_SHARDS, READ_BYTES = 4, 16 << 20
END_ID = 0
MAGIC = b"IDSHARD1"
#: Size of an id, documents, distinct keys, ids, documents with a null key, words of bits, levels.
FOOTER = struct.Struct("<8sBQQQQQQ")

# Borders are found in UTF-8. A border left out puts two chunks in one, which is right in any case, so these rules may count
# too much as white space, but never too little.
_SPACE = rb"(?:[\x00-\x20]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf)"
#: A space with white space or the end behind it, and the places of other spaces.
_DOUBLE = re.compile(rb"[ ](?:%s|\Z)" % _SPACE)
_BORDER = re.compile(rb"(?=[ ](?!%s|\Z))" % _SPACE)
#: A space, letters of ASCII and of the Latin blocks that hold nothing else, and one sign that stands alone.
_SIGNED = re.compile(rb"[ ](?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc9][\x80-\xbf]|\xca[\x80-\xaf])+[.,;:!?]")


@dataclass
class ChunkEncoder:
    """The library's encoder over chunks of text that it splits in any case, with the ids of short chunks kept.

    The byte-level rule takes at most one space before a word, number or sign into its token, so a token starts at every
    space that other than white space follows, whatever stands around. Whole texts, their chunks, and any chunks put
    together have the same ids, so all new chunks of a slice are encoded as one text and parted by the bytes of their ids.
    """

    library: Tokenizer
    in_chunks: bool
    dtype: np.dtype
    #: bytes of text that each id stands for
    size: np.ndarray
    kept: dict[bytes, bytes] = field(default_factory=dict)
    used: int = 0

    @classmethod
    def from_json(cls, data: bytes) -> ChunkEncoder:
        spec = json.loads(data)
        library = Tokenizer.from_str(data.decode())
        library.no_truncation()
        library.no_padding()
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added)
        in_chunks = plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        vocab = library.get_vocab()
        size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            size[i] = len(token)  # a character of the byte alphabet is a byte
        for t in added:
            size[t["id"]] = len(t["content"].encode())
        return cls(library, in_chunks, np.dtype("<u2" if len(size) <= 1 << 16 else "<u4"), size)

    def chunks(self, text: bytes) -> list[bytes]:
        if not self.in_chunks:
            return [text]
        return _BORDER.split(text) if b"\0" in text or _DOUBLE.search(text) else text.replace(b" ", b"\0 ").split(b"\0")

    def encode_all(self, batch: list[bytes | None]) -> list[bytes]:
        """Of each UTF-8 text the ids in bytes; null: none."""
        kept = self.kept
        split = [self.chunks(t) if t else [] for t in batch]
        flat = list(chain.from_iterable(split))
        found = list(map(kept.get, flat))
        holes = [k for k, raw in enumerate(found) if raw is None]
        new = {flat[k] for k in holes}
        signed = {}
        if self.in_chunks:
            # a word and a sign behind it are two tokens or more, so the word's ids serve both with and without
            signed = {c: (c[:-1], c[-1:]) for c in filter(_SIGNED.fullmatch, new)}
            wanted = new.difference(signed).union(*signed.values()).difference(kept)
            together = [c for c in wanted if c[:1] == b" " and not _DOUBLE.match(c)]
            kept.update(self._parted(together))
            alone = list(wanted.difference(together))
        else:
            wanted, alone = new, list(new)
        for c, e in zip(alone, self.library.encode_batch_fast([c.decode() for c in alone], add_special_tokens=False) if alone else [], strict=True):
            kept[c] = np.array(e.ids, self.dtype).tobytes()
        for c, (word, sign) in signed.items():
            kept[c] = kept[word] + kept[sign]
        for k in holes:
            found[k] = kept[flat[k]]
        ends = [0, *accumulate(map(len, split))]
        out = [b"".join(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for c in [c for c in wanted if len(c) > CHUNK_SIZE]:
            del kept[c]
        self.used += sum(len(own) * ENTRY_BYTES + sum(map(len, own)) * (1 + self.dtype.itemsize) for own in (wanted, signed))
        if self.used > CHUNK_BYTES:
            self.kept, self.used = {}, 0
        return out

    def _parted(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        if not chunks:
            return {}
        ids = np.array(self.library.encode_batch_fast([b"".join(chunks).decode()], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(self.size[ids])
        upto = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        cut = np.searchsorted(ends, upto) + 1
        if cut[-1] != len(ids) or (ends[cut - 1] != upto).any():
            raise RuntimeError("the library's ids do not part at chunks")
        raw, at = ids.astype(self.dtype).tobytes(), (cut * self.dtype.itemsize).tolist()
        return {c: raw[a:b] for c, a, b in zip(chunks, [0, *at], at, strict=False)}


def parts_of(batch: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """``batch`` in parts of about SLICE_SIZE bytes at most; a longer text is a part of its own."""
    part, chars = [], 0
    for t in batch:
        if part and chars + len(t or "") > SLICE_SIZE:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t or "")
    if part:
        yield part


_encoders: dict[bytes, ChunkEncoder] = {}


def encoder(data: bytes) -> ChunkEncoder:
    """The encoder of a vocabulary file's bytes, built once a worker; tasks are the only threads."""
    if data not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[data] = ChunkEncoder.from_json(data)
    return _encoders[data]


def codes(keys: np.ndarray) -> np.ndarray:
    """A number for each int64 key, different for different keys."""
    return mix(keys.astype(np.int64).view(np.uint64))


def prints(code: np.ndarray) -> np.ndarray:
    return (mix(code ^ np.uint64(PRINT_SALT)) >> np.uint64(32)).astype(np.uint32)


def places(code: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(code + np.uint64((level + 1) * LEVEL_SALT & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


@dataclass
class PerfectHash:
    """Level sizes in bits (multiples of 64), the bits of all levels as words, and the bits set before each word."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray) -> PerfectHash:
        """From distinct numbers."""
        sizes, words = [], []
        while len(code):
            size = -(-len(code) * GAMMA // 64) * 64
            at = places(code, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            code = code[~alone]
        words = np.concatenate([np.zeros(0, "<u8"), *words])
        set_ = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, np.int64), words, np.cumsum(set_) - set_)

    def slots(self, code: np.ndarray) -> np.ndarray:
        """The slot of each number that is in the index; of another any slot or -1."""
        out = np.full(len(code), -1, np.int64)
        go, base = np.arange(len(code)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = places(code[go], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            lower = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[go[hit]] = self.before[word[hit]] + np.bitwise_count(lower)
            go, base = go[~hit], base + size
        return out


class ShardWriter:
    """One file: ids as they come, the index at the end."""

    def __init__(self, folder: str, name: str, dtype: np.dtype):
        self.name, self.dtype = name, dtype
        files, path = fs.FileSystem.from_uri(folder)
        self.out = files.open_output_stream(f"{path}/{name}")
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.ids = 0

    def add(self, key: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.keys.append(key)
        self.sizes.append(len(raw) // self.dtype.itemsize)
        self.ids += self.sizes[-1]

    def close(self) -> tuple:
        """Writes the index; (name, documents, ids, documents with a null key, least key, largest key)."""
        nulls = sum(k is None for k in self.keys)  # they come first
        keys = np.array(self.keys[nulls:], np.int64)
        distinct, first, run = np.unique(keys, return_index=True, return_counts=True)
        code = codes(distinct)
        index = PerfectHash.of(code)
        slot = index.slots(code)
        table = np.zeros(len(distinct), "<u4,<u4,<u4")
        table["f0"][slot], table["f1"][slot], table["f2"][slot] = prints(code), first + nulls, run
        starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        for part in (starts.astype("<i8"), keys.astype("<i8"), index.sizes.astype("<i8"), index.words, index.before.astype("<i8"), table):
            self.out.write(part.tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.dtype.itemsize, len(self.keys), len(distinct), self.ids, nulls, len(index.words), len(index.sizes)))
        self.out.close()
        return self.name, len(self.keys), self.ids, nulls, int(keys[0]) if len(keys) else None, int(keys[-1]) if len(keys) else None


class ShardReader:
    """Constant-time access to the documents of a key; the index is read once, ids as they are asked for."""

    def __init__(self, folder: str, name: str):
        files, path = fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        size = self.file.size()
        magic, self.width, docs, distinct, ids, self.nulls, words, levels = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard")
        at = ids * self.width

        def part(n: int, dtype: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(self.file.read_at(n * np.dtype(dtype).itemsize, at), dtype)
            at += n * np.dtype(dtype).itemsize
            return got

        self.starts, self.keys = part(docs + 1, "<i8"), part(docs - self.nulls, "<i8")
        sizes = part(levels, "<i8")
        self.index = PerfectHash(sizes, part(words, "<u8"), part(words, "<i8"))
        self.table = part(distinct, "<u4,<u4,<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 of a key that the shard lacks."""
        code = codes(keys)
        slot = self.index.slots(code)
        there = slot >= 0
        there[there] = self.table["f0"][slot[there]] == prints(code[there])
        first, run = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[there], run[there] = self.table["f1"][slot[there]], self.table["f2"][slot[there]]
        there[there] = self.keys[first[there] - self.nulls] == keys[there]  # a fingerprint of a key that is not there
        return first, np.where(there, run, 0)

    def ids(self, docs: list[int]) -> list[np.ndarray]:
        """The ids of each document, as unsigned 32-bit integers; neighbours are read together."""
        out, at = [], 0
        while at < len(docs):
            upto, first = at + 1, self.starts[docs[at]]
            while upto < len(docs) and docs[upto] == docs[upto - 1] + 1 and (self.starts[docs[upto] + 1] - first) * self.width <= READ_BYTES:
                upto += 1
            ends = (self.starts[docs[at] : docs[upto - 1] + 2] - first).tolist()
            own = np.frombuffer(self.file.read_at(ends[-1] * self.width, int(first) * self.width), f"<u{self.width}").astype("<u4")
            out += [own[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            at = upto
        return out


@dataclass
class Shards:
    """The shards of a table in the order of keys: one row a task, a SHARD_DOCS or a SHARD_IDS, so the driver can hold it."""

    folder: str
    names: list[str]
    docs: np.ndarray
    starts: np.ndarray  # ids before each shard
    nulls: np.ndarray
    least: np.ndarray  # keys; a shard of null keys alone has the least key twice
    most: np.ndarray


def write_shards(docs: DataFrame, vocab_path: str, text: str = "text", key: str = "doc_id") -> Shards:
    """Encodes every whole text, appends END_ID and writes all ids in ascending order of ``key`` (an integer).

    Null keys come first. Rows of one key follow each other by a digest of the text, equal rows in the order of the
    table; they may lie in several shards, since a task gets a range of keys, digests and running numbers. Null and empty
    texts are END_ID alone. Other columns are not read. An empty table has no shard.

    Files lie in the shared folder of ``spark.checkpoint.dir``, which must be of a kind that Arrow opens. A task that runs
    again writes files of new names, and only those of the run that ends well are listed; others are never read.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    with open(vocab_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(data.value)
        end = np.array([END_ID], codec.dtype).tobytes()
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        made, now = [], None
        for batch in batches:
            keys = iter(batch.column(batch.schema.get_field_index("key")).to_pylist())
            for part in parts_of(texts(batch, "text")):
                for raw in codec.encode_all(part):
                    now = now or ShardWriter(folder, f"{task:08d}-{len(made):05d}-{attempt}.ids", codec.dtype)
                    now.add(next(keys), raw + end)
                    if len(now.keys) >= SHARD_DOCS or now.ids >= SHARD_IDS:
                        made.append(now.close())
                        now = None
        if now:
            made.append(now.close())
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = [[task] * len(made), range(len(made)), *(zip(*made, strict=True) if made else [[]] * 6)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.int64(), *types], strict=True)], names="task seq name docs ids nulls least most".split())

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    slim = slim.withColumn("digest", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    by = [F.asc_nulls_first("key"), "digest", "tie"]
    ordered = slim.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "text")
    made = cut_table(ordered.mapInArrow(run, "task long, seq long, name string, docs long, ids long, nulls long, least long, most long"))
    rows = made.orderBy("task", "seq").collect()
    low = np.iinfo(np.int64).min
    edge = [(r["least"] if r["least"] is not None else low, r["most"] if r["most"] is not None else low) for r in rows]
    if any(a[1] > b[0] for a, b in zip(edge, edge[1:], strict=False)):
        raise RuntimeError("tasks did not come in the order of their ranges")
    ids = np.array([r["ids"] for r in rows], np.int64)
    return Shards(folder, [r["name"] for r in rows], np.array([r["docs"] for r in rows], np.int64), np.cumsum(ids) - ids, np.array([r["nulls"] for r in rows], np.int64), np.array([a for a, _ in edge], np.int64), np.array([b for _, b in edge], np.int64))


def lookup(shards: Shards, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of ``keys`` (one long column, each key once), read from the files by their indexes.

    Gives doc_id, ``start`` (ids of all documents before it), n_tokens (END_ID included), ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, with ``with_ids``, ``ids``. A key of several documents gives all of them;
    a key that is not there none; null finds those with a null key. Keys go to the shards whose ranges hold them, so each
    shard's index is opened by one task, once.
    """
    held = keys.sparkSession.sparkContext.broadcast(shards)
    name = keys.columns[0]

    def route(batch: pa.RecordBatch) -> list:
        s = held.value
        col = batch.column(0)
        asked = col.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = np.searchsorted(s.most, asked, "left"), np.searchsorted(s.least, asked, "right")
        n = np.maximum(b - a, 0)
        shard = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of_null = np.flatnonzero(s.nulls) if col.null_count else np.zeros(0, np.int64)
        return [pa.array(np.concatenate([shard, of_null]), pa.int64()), pa.concat_arrays([pa.array(np.repeat(asked, n), pa.int64()), pa.nulls(len(of_null), pa.int64())])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, opened, reader = held.value, None, None
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for at, upto in zip(cuts, cuts[1:], strict=False):
                if at == upto:
                    continue
                if number[at] != opened:
                    opened = int(number[at])
                    reader = ShardReader(s.folder, s.names[opened])
                asked = batch.column(1).slice(at, upto - at)
                out = [(None, d) for d in range(reader.nulls)] if asked.null_count else []
                known = asked.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                first, n = reader.find(known)
                out += [(k, d) for k, a, c in zip(known.tolist(), first.tolist(), n.tolist(), strict=True) for d in range(a, a + c)]
                for part in range(0, len(out), 256):
                    yield _rows(reader, int(s.starts[opened]), out[part : part + 256], with_ids)

    routed = emit_arrow(keys.select(F.col(name).cast("long").alias("key")), route, "shard long, key long")
    # keys are few bytes, what they find is not: tasks are dealt by shards, not by the size of the keys
    dealt = routed.repartition(1 + len(shards.names) // TASK_SHARDS, "shard").sortWithinPartitions("shard", F.asc_nulls_first("key"))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _rows(reader: ShardReader, before: int, docs: list[tuple], with_ids: bool) -> pa.RecordBatch:
    ids = reader.ids([d for _, d in docs])
    cols = [pa.array([k for k, _ in docs], pa.int64()), pa.array(before + reader.starts[[d for _, d in docs]], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)
