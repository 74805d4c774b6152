"""Exact BPE encoding by backtracking over longest token matches, and decoding by an offset table.

The vocabulary is that of a public tokenizer file (BPE with word ends). A word is encoded left to right: an
Aho-Corasick automaton gives the longest token at each place; a token may follow another only if the pair is
compatible, i.e. no merge across their border would have come first; a place from which no compatible token leads on is
marked and left for a shorter token. Places are marked once, so the work is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import append_arrow, texts

#: One character that stands for the word-end suffix; the byte alphabet has none of this plane.
END = "\ue000"
#: Bytes that a Python worker spends on the ids of space-separated pieces, and of words that pieces are made of.
PIECE_BYTES, WORD_BYTES = 72 << 20, 16 << 20
#: Bytes of an entry besides its key and value: two objects and a slot of a table.
ENTRY_BYTES = 180
#: Words of at most so many characters are encoded together.
TOGETHER = 40
#: Slots (a power of two) of the table that keeps whether a pair of tokens is compatible.
PAIR_BITS = 20
#: Characters of texts that are encoded together.
SLICE_CHARS = 1 << 19
#: Lower-case mappings of the library's Unicode tables that Python's lack, as (first, last, first target).
LATE_LOWER = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DC, 0xA7DC, 0x019B), (0x16EA0, 0x16EB8, 0x16EBB), (0x10D50, 0x10D65, 0x10D70))

#: Letters of this regex module that are unassigned in the library's Unicode tables, as (first, last).
LATE_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies use for each byte: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Cache:
    """A table of bytes in two generations of at most half of ``room`` bytes each: what is asked for again stays."""

    def __init__(self, room: int):
        self.room, self.used = room // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: Iterable[str]) -> tuple[dict[str, bytes], list[str]]:
        """Values of the distinct ``keys`` that are held, and the other keys."""
        found, other = {}, []
        for k in set(keys):
            v = self.young.get(k)
            if v is None:
                v = self.old.get(k)
                if v is None:
                    other.append(k)
                    continue
                self.put(k, v)
            found[k] = v
        return found, other

    def put(self, key: str, value: bytes) -> None:
        if self.used >= self.room:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[key] = value
        self.used += len(key) + len(value) + ENTRY_BYTES


def blob_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``parts`` in one array of bytes, with the offset and length of each."""
    length = np.array([len(p) for p in parts], np.int32)
    return np.frombuffer(b"".join(parts), np.uint8), (np.cumsum(length) - length).astype(np.int32), length


def ranges(blob: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the parts ``ids``, one after the other, and where each ends."""
    data, offset, length = blob
    n = length[ids]
    ends = np.cumsum(n, dtype=np.int64)
    at = np.repeat((offset[ids] - (ends - n)).astype(np.int64), n)
    at += np.arange(len(at))
    return data[at], ends


@dataclass
class PieceCodec:
    """Tables of one vocabulary, and the encoder and decoder over them."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    suffix: str
    pattern: str
    special: dict[str, int]
    pieces: Cache = field(default_factory=lambda: Cache(PIECE_BYTES))
    parts: Cache = field(default_factory=lambda: Cache(WORD_BYTES))

    @classmethod
    def from_json(cls, data: bytes) -> PieceCodec:
        spec = json.loads(data)
        model = spec["model"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, model["end_of_word_suffix"], pattern, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def __post_init__(self) -> None:
        strip = len(self.suffix)
        inner = lambda s: s[:-strip] + END if s.endswith(self.suffix) and len(s) > strip else s
        self.ids = {inner(s): i for s, i in self.vocab.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(self.merges):
            a, b = inner(a), inner(b)
            pair = (self.ids[a], self.ids[b])
            self.rank[pair] = r
            self.split[self.ids[a + b]] = pair
        self.born = {whole: self.rank[pair] for whole, pair in self.split.items()}
        self.left, self.right = {}, {}
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        # a token whose own text BPE would merge otherwise never comes out of a longest match
        self.ids = {s: i for s, i in self.ids.items() if i not in self.split or self._no_merge_across(*self.split[i], self.born[i])}
        self.text = {i: s for s, i in self.ids.items()}
        self.auto = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.auto.add_word(s, i)
        self.auto.make_automaton()
        self.size = np.array([len(self.text.get(i, "")) for i in range(max(self.text) + 1)], np.int64)
        #: the longest token that is a proper prefix of each; -1: none
        self.shorter = np.full(len(self.size), -1, np.int64)
        for s, i in self.ids.items():
            self.shorter[i] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), -1)
        self.alphabet = str.maketrans({b: c for b, c in enumerate(byte_alphabet())})
        self.late = str.maketrans({chr(c): chr(to + c - a) for a, b, to in LATE_LOWER for c in range(a, b + 1)})
        self.has_late = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in LATE_LOWER) + "]").search
        letter = r"[\p{L}--[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE_LETTERS) + "]]"
        self.words = regex.compile(self.pattern)
        self.late_words = regex.compile(self.pattern.replace(r"\p{L}", letter), regex.V1)
        self.has_late_letter = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE_LETTERS) + "]").search
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        # decoding, and the list of ids in decimals: all texts in one blob, each with the space that stands between tokens
        names = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        n = max(names) + 1
        self.shown = blob_of([names.get(i, "").encode() + b" " for i in range(n)])
        self.decimal = blob_of([b"%d " % i for i in range(n)])

    def _edge(self, token: int, side: int, memo: dict[int, list[tuple[int, float]]]) -> list[tuple[int, float]]:
        """Tokens at one edge of ``token`` as its merges are undone, each with the rank of the merge that ends it."""
        if token not in memo:
            chain, until = [(token, float("inf"))], token
            while until in self.split:
                part = self.split[until][side]
                chain.append((part, self.born[until]))
                until = part
            memo[token] = chain
        return memo[token]

    def _no_merge_across(self, a: int, b: int, before: float) -> bool:
        """No merge over the border of ``a`` and ``b`` comes before the merges beside it, or before rank ``before``.

        Of merges of one rank the leftmost comes first: one over the border loses to one in ``a`` and beats one in ``b``.
        """
        rank = self.rank
        for x, ends_x in self._edge(a, 1, self.right):
            for y, ends_y in self._edge(b, 0, self.left):
                r = rank.get((x, y))
                if r is not None and r < ends_x and r <= ends_y and r < before:
                    return False
        return True

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is compatible: looked up in a table of fixed size, or worked out and put there."""
        code = a << 20 | b
        slot = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        held = self.pairs[slot]
        unknown = np.flatnonzero(held >> 1 != code)
        if len(unknown):
            new, place = np.unique(code[unknown], return_inverse=True)
            fits = np.fromiter((self._no_merge_across(c >> 20, c & 0xFFFFF, float("inf")) for c in new.tolist()), np.int64, len(new))
            held[unknown] = (new * 2 + fits)[place]
            self.pairs[slot[unknown]] = held[unknown]
        return (held & 1).astype(bool)

    def longest(self, line: str) -> np.ndarray:
        """The longest token that starts at each place of a line of words that END ends; -1: none."""
        out = np.full(len(line), -1, np.int64)
        found = np.fromiter(chain.from_iterable(self.auto.iter(line)), np.int64)
        out[found[::2] - self.size[found[1::2]] + 1] = found[1::2]  # a later end is a longer token
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of words in the byte alphabet. All words take their next step together: on to the longest
        compatible token, to a shorter one, or back."""
        if not words:
            return []
        line = END.join(words) + END
        longest = self.longest(line)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(length)
        start = end - length
        out = np.full(len(line) + len(words), -1, np.int64)  # the tokens of each word behind a mark
        depth = start + np.arange(len(words)) + 1
        first = depth.copy()
        dead = np.zeros(len(line) + 1, bool)
        at, token = start.copy(), longest[start]
        go = np.arange(len(words))
        while len(go):
            t, last, here = token[go], out[depth[go] - 1], at[go]
            some = t >= 0
            to = np.where(some, here + self.size[t], here)
            good = some & ~dead[to]
            check = np.flatnonzero(good & (last >= 0))
            good[check] = self.compatible(last[check], t[check])
            # on
            k = go[good]
            out[depth[k]] = t[good]
            depth[k] += 1
            at[k] = to[good]
            inside = at[k] < end[k]
            token[k[inside]] = longest[at[k[inside]]]
            # shorter
            k = some & ~good
            token[go[k]] = self.shorter[t[k]]
            # back
            k = go[~some]
            if len(k):
                dead[at[k]] = True
                depth[k] -= 1
                if (depth[k] < first[k]).any():
                    raise ValueError("the vocabulary lacks a byte")
                gone = out[depth[k]]
                at[k] -= self.size[gone]
                token[k] = self.shorter[gone]
            go = go[at[go] < end[go]]
        raw = out.astype(np.int32).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), depth.tolist(), strict=True)]

    def _words(self, piece: str) -> list[str]:
        if piece.isascii():
            return [piece] if piece.isalpha() else self.words.findall(piece)
        return (self.late_words if self.has_late_letter(piece) else self.words).findall(piece)

    def _pieces(self, wanted: list[str]) -> dict[str, bytes]:
        """Ids of each of the distinct runs without white space."""
        found, other = self.pieces.find(wanted)
        split = [self._words(p) for p in other]
        ids, new = self.parts.find(chain.from_iterable(split))
        as_bytes = [w.encode().decode("latin-1").translate(self.alphabet) for w in new]
        small = [k for k, w in enumerate(as_bytes) if len(w) <= TOGETHER]
        large = [k for k, w in enumerate(as_bytes) if len(w) > TOGETHER]
        made = [*zip(small, self.encode_words([as_bytes[k] for k in small]), strict=True), *((k, self.encode_words([as_bytes[k]])[0]) for k in large)]
        for k, raw in made:
            ids[new[k]] = raw
            if len(new[k]) <= TOGETHER:
                self.parts.put(new[k], raw)
        for p, own in zip(other, split, strict=True):
            found[p] = raw = ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own])
            if len(p) <= TOGETHER:
                self.pieces.put(p, raw)
        return found

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.translate(self.late) if self.has_late(text) else text
        text = text.lower()
        # str.split() also splits at the four separators below the space, which are no white space to the vocabulary
        return regex.findall(r"\S+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _parted(self, text: str | None) -> list[str | int]:
        """Pieces of a text, and ids where it holds special tokens. Null: none."""
        if not text or not self.specials or "<|" not in text:
            return self._split(text) if text else []
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self._split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._split(text[at:])

    def encode_all(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and where each text's ids end."""
        parted = [self._parted(t) for t in batch]
        known = self._pieces([p for own in parted for p in own if isinstance(p, str)])
        for i in self.special.values():
            known[i] = np.int32(i).tobytes()
        raw = [b"".join([known[p] for p in own]) for own in parted]
        return np.frombuffer(b"".join(raw), np.int32), np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def lines(self, blob: tuple, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """Of each text the parts of its ids, joined by spaces."""
        data, upto = ranges(blob, ids)
        upto = np.concatenate([[0], upto])[np.concatenate([[0], ends])].tolist()
        view = memoryview(data)
        return [view[a : max(a, b - 1)] for a, b in zip(upto, upto[1:], strict=False)]


_codecs: dict[bytes, PieceCodec] = {}


def codec(data: bytes) -> PieceCodec:
    """The codec of a vocabulary file's bytes, built once a worker."""
    key = hashlib.sha256(data).digest()
    if key not in _codecs:
        _codecs[key] = PieceCodec.from_json(data)
    return _codecs[key]


def slices(batch: list[str | None]) -> Iterable[list[str | None]]:
    """``batch`` in parts of about SLICE_CHARS characters at most; a longer text is a part of its own."""
    part, chars = [], 0
    for t in batch:
        n = len(t or "")
        if part and chars + n > SLICE_CHARS:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += n
    if part:
        yield part


def bpe_codes(docs: DataFrame, vocab_path: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Appends ``n_tokens`` long, ``ids_sha256`` (decimal ids joined by a space), ``decoded_sha256`` (decoded text) and,
    with ``with_ids``, ``ids`` array<int> and ``decoded`` string. Null and empty texts have no token and the digest of
    the empty string. Strings of special tokens in a text are those tokens. Rows, also repeated ones, stay as they are;
    an input column with the name of a new one gives way. The driver reads the vocabulary file (a few MB) once and
    broadcasts its bytes. Work, memory and output are per row, so no key or size of text needs other handling.
    """
    with open(vocab_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def kernel(batch: pa.RecordBatch) -> list:
        own = codec(data.value)
        n, a, b, ids, decoded = [], [], [], [], []
        for part in slices(texts(batch, text)):
            got, ends = own.encode_all(part)
            shown = own.lines(own.shown, got, ends)
            n += np.diff(ends, prepend=0).tolist()
            a += [hashlib.sha256(x).hexdigest() for x in own.lines(own.decimal, got, ends)]
            b += [hashlib.sha256(x).hexdigest() for x in shown]
            if with_ids:
                ids += np.split(got, ends[:-1])
                decoded += [bytes(x).decode() for x in shown]
        return [n, a, b, *([ids, decoded] if with_ids else [])]

    return append_arrow(docs, kernel, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids, keep)
