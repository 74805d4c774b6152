"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of about 60 words. The vector of a window is the mean of the embeddings of the hashed
character n-grams of its distinct words, rarer n-grams weighing more, at unit scale; a linear softmax reads it. The text
is as toxic as its most toxic window. Misspelt and inflected words share n-grams, and so vectors, with known ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_arrow, emit_arrow, letter_table, texts

#: Hash buckets (a power of two) of character n-grams, their lengths, and the embedding width.
BUCKET_BITS, GRAMS, WIDTH = 16, (3, 4, 5), 8
BUCKETS = 1 << BUCKET_BITS
#: Words of a window.
WINDOW = 60
#: Training reads at most so many labelled texts of class 1, of class 0, and evenly spaced windows of each.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_WINDOWS = 800, 1600, 48
SEED = 11
_M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def place_keys() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Grams:
    """Hashed n-grams of the distinct words of all windows of a batch of texts."""

    bucket: np.ndarray
    window: np.ndarray  # of each n-gram
    share: np.ndarray  # 1 / n-grams of its word
    text: np.ndarray  # of each window


def grams(batch: list) -> Grams:
    """Words are runs of letters of the lowered text, with a border mark at both ends; null and empty texts have none."""
    joined = "\n" + "\n\n".join((t or "").lower().replace("\n", " ") for t in batch) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[c]
    text_at = np.cumsum(c == 10) >> 1  # two line breaks part texts, and no other is left
    c = np.where(letter, c, 1).astype(np.uint64)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Grams(none, none, none.astype(float), none)
    word_at = np.cumsum(first) - 1
    text = text_at[starts]
    n_words = np.bincount(text, minlength=len(batch))
    n_windows = np.maximum(1, (n_words + WINDOW // 2) // WINDOW) * (n_words > 0)
    base = np.cumsum(n_windows) - n_windows
    order = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[text]
    window = base[text] + order * n_windows[text] // n_words[text]
    # of equal words in a window the first counts
    place = np.arange(len(c)) - starts[np.maximum(word_at, 0)]
    key = np.add.reduceat(np.where(letter, c * place_keys()[place & 255], 0), starts)
    key = (key ^ (key >> np.uint64(31))) * _M + window.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    kept = np.zeros(len(starts), bool)
    kept[np.unique(key, return_index=True)[1]] = True
    usable = letter & kept[np.maximum(word_at, 0)]
    buckets, words = [], []
    h, inner = c, np.ones(len(c), bool)
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _M + c[n - 1 :]
        h ^= h >> np.uint64(29)
        inner = inner[:-1] & usable[n - 2 : len(c) - 1] if n > 2 else inner[:-1]
        if n in GRAMS:
            at = np.flatnonzero(inner)
            buckets.append(((h[at] * _M) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            words.append(word_at[at + 1])
    word = np.concatenate(words)
    per_word = np.bincount(word, minlength=len(starts))
    return Grams(np.concatenate(buckets), window[word], 1.0 / per_word[word], np.repeat(np.arange(len(batch)), n_windows))


def window_bags(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and summed shares of (evenly spaced) windows of one text, for training."""
    g = grams([text])
    n = len(g.text)
    pick = np.unique(np.linspace(0, n - 1, min(n, TRAIN_WINDOWS)).astype(int)) if n else []
    key, at = np.unique(g.window * BUCKETS + g.bucket, return_inverse=True)
    total = np.bincount(at, g.share, len(key))
    ends = np.searchsorted(key >> BUCKET_BITS, np.arange(n + 1))
    return [((key[ends[k] : ends[k + 1]] & (BUCKETS - 1)).astype(np.int32), total[ends[k] : ends[k + 1]].astype(np.float32)) for k in pick]


@dataclass
class SubwordModel:
    """``embedding`` (BUCKETS, WIDTH), ``weights`` (WIDTH, 2), ``bias`` (2) and the weight ``rarity`` of each bucket."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    rarity: np.ndarray

    def margin(self) -> np.ndarray:
        """What a bucket adds to the log-odds of class 1."""
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    def _epochs(self, rows: list, y: np.ndarray, epochs: int, rate: float) -> None:
        rng = np.random.default_rng(SEED)
        e, w, b = self.embedding, self.weights, self.bias
        scale = 0.5 * len(y) / np.maximum(np.bincount(y, minlength=2), 1)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                idx, x = rows[k]
                mean = x @ e[idx]
                z = mean @ w + b
                p = np.exp(z - z.max())
                d = p / p.sum()
                d[y[k]] -= 1
                d *= rate * scale[y[k]]
                e[idx] -= np.outer(x, w @ d)
                w -= 0.001 * np.outer(mean, d)
                b -= 0.02 * d

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], owner: np.ndarray, labels: list[int]) -> SubwordModel:
        """``rows``: buckets and shares of windows, which are overwritten; ``owner``: the text of each, ascending; ``labels``
        of the texts. First every window has its text's class; then only the quarter of the windows of a toxic text that
        looks most toxic, against the three of a clean one that do."""
        rng = np.random.default_rng(SEED)
        e = np.zeros((BUCKETS, WIDTH), np.float32)
        w = rng.normal(0, 0.25, (WIDTH, 2)).astype(np.float32)
        df = np.zeros(BUCKETS)
        for idx, _ in rows:
            df[idx] += 1
        model = cls(e, w, np.zeros(2, np.float32), np.log((len(rows) + 1) / (df + 1)))
        y = np.array(labels, np.int64)
        if not len(rows) or len(set(labels)) < 2:  # one class, or none: its share alone
            share = (np.sum(y) + 0.5) / (len(y) + 1) if len(y) else 0.0
            model.bias[:] = (0, np.log(max(share, 1e-6) / (1 - min(share, 1 - 1e-6))))
            return model
        for idx, x in rows:
            x *= model.rarity[idx]
            x /= max(np.linalg.norm(x), 1e-9)
        model._epochs(rows, y[owner], 2, 1.0)
        count = np.bincount(owner, minlength=len(y))
        for _ in range(2):
            m, b = model.margin(), model.bias[1] - model.bias[0]
            z = np.array([x @ m[idx] + b for idx, x in rows])
            order = np.lexsort((-z, owner))
            rank = np.empty(len(z), np.int64)
            rank[order] = np.arange(len(z)) - (np.cumsum(count) - count)[owner[order]]
            pick = np.flatnonzero(np.where(y[owner] == 1, rank < np.maximum(1, count[owner] * 0.25), rank < 3))
            model._epochs([rows[k] for k in pick], y[owner[pick]], 6, 2.0)
        return model


def score(batch: list, margin: np.ndarray, rarity: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 of each text: of its most toxic window, or of the bias alone if it has no word."""
    g = grams(batch)
    z = np.full(len(batch), -np.inf)
    if len(g.text):
        x = g.share * rarity[g.bucket]
        norm = np.sqrt(np.bincount(g.window, x * x, len(g.text)))
        np.maximum.at(z, g.text, np.bincount(g.window, x * margin[g.bucket], len(g.text)) / np.maximum(norm, 1e-9))
    z = np.where(np.isinf(z), 0, z) + bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fold: DataFrame | None = None) -> DataFrame:
    """A bounded sample (text, y) of labelled rows outside the held-out fold, by the hash order of the id.

    A document labelled twice has the larger label, and of texts with one id the least is read; null labels and ids don't
    count.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0).groupBy("id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    order = [F.xxhash64("id"), "id"]
    some = known.where("y = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(known.where("y = 0").orderBy(*order).limit(TRAIN_CLEAN))
    return own.join(F.broadcast(some), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # some: at most TRAIN_TOXIC + TRAIN_CLEAN rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> SubwordModel:
    """Trains on at most TRAIN_TOXIC + TRAIN_CLEAN labelled rows whose crc32(id) mod 5 is not 0.

    Executors hash the texts; the driver gets the buckets of at most TRAIN_WINDOWS evenly spaced windows of each, so of
    texts above about 2,900 words it learns from a part. Scores are of all windows.
    """

    def kernel(batch: pa.RecordBatch) -> list:
        bags = [window_bags(t) for t in texts(batch, "text")]
        ids, y = texts(batch, "id"), texts(batch, "y")
        flat = [(i, c, b) for i, c, own in zip(ids, y, bags, strict=True) for b in own or [(np.zeros(0, np.int32), np.zeros(0, np.float32))]]
        return [[i for i, *_ in flat], [c for _, c, _ in flat], [b[0].astype(np.uint16).view(np.int16) for *_, b in flat], [b[1] for *_, b in flat]]

    made = emit_arrow(training_rows(docs, labels, doc_id, text, label), kernel, "id long, y int, bucket array<short>, share array<float>").toArrow()
    ids, y = made["id"].to_numpy(), made["y"].to_numpy()
    # the only copy that stays: all windows one after the other
    bucket, ends = joined(made["bucket"], np.int16)
    bucket = bucket.view(np.uint16)  # BUCKET_BITS are 16
    share, _ = joined(made["share"], np.float32)
    del made
    pa.default_memory_pool().release_unused()
    starts = np.concatenate([[0], ends])[:-1]
    known, owner = np.unique(ids, return_inverse=True)
    label_of = np.zeros(len(known), np.int64)
    label_of[owner] = y
    # rows come in any order
    order = sorted(np.flatnonzero(ends > starts).tolist(), key=lambda k: (owner[k], xxhash.xxh64_intdigest(bucket[starts[k] : ends[k]].tobytes() + share[starts[k] : ends[k]].tobytes())))
    rows = [(bucket[starts[k] : ends[k]], share[starts[k] : ends[k]]) for k in order]
    return SubwordModel.fit(rows, owner[order], label_of.tolist())


def joined(lists: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists in one array of their own, and where each list ends."""
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]
    sizes = [pa.compute.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists.chunks]
    return np.concatenate([np.zeros(0, dtype), *values]).astype(dtype, copy=False), np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]), dtype=np.int64)


def toxicity_scores(docs: DataFrame, model: SubwordModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends ``score`` double (0 to 1) and ``predicted`` int to every row; null and empty texts get the bias's score.

    An input column with the name of a new one gives way. Work is per row; the model is a broadcast of fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.margin(), model.rarity, float(model.bias[1] - model.bias[0])))

    def kernel(batch: pa.RecordBatch) -> list:
        s = score(texts(batch, text), *sent.value)
        return [s, (s >= 0.5).astype(np.int32)]

    return append_arrow(docs, kernel, "score double, predicted int", keep)
