"""Language ID: language family first, then one-versus-one linear support vector machines within the family."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_arrow, emit_arrow, letter_table, texts

#: Families of language codes. A code in none of them is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
#: Hash buckets (a power of two) of character n-grams, and the lengths.
BUCKET_BITS, GRAMS = 13, (1, 2, 3)
BUCKETS = 1 << BUCKET_BITS
#: Training reads at most so many documents of each language, and so many in all (but one of each language).
TRAIN_PER_LANGUAGE, TRAIN_DOCUMENTS = 600, 9600
STEPS, RIDGE = 150, 1e-3
_M = np.uint64(0x9E3779B97F4A7C15)


def profile(text: str | None) -> np.ndarray | None:
    """Relative frequencies of the hashed n-grams of the lowered text; runs of non-letters are one border. No letter: None."""
    if not text:
        return None
    c = np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[c]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    c, letter = np.where(letter, c, 1)[keep].astype(np.uint64), letter[keep]
    if not len(c):
        return None
    counts = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(c) - n + 1] if n > 1 else h) * _M + c[n - 1 :]
        h ^= h >> np.uint64(31)
        good = letter if n == 1 else letter[:-1] | letter[1:] if n == 2 else letter[1 : 1 + len(h)]
        if n in GRAMS:
            counts += np.bincount(((h[good[: len(h)]] * _M + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
    return counts / max(1, counts.sum())


def linear_svm(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Weights of a squared-hinge, ridge-regularised linear SVM by accelerated gradient steps."""
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    step = 1.0 / (2 * float((share * np.einsum("ij,ij->i", x, x)).sum()) + RIDGE)
    for k in range(STEPS):
        slack = np.maximum(0, 1 - sign * (x @ look))
        new = look - step * (RIDGE * look - 2 * (x.T @ (share * sign * slack)))
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """``weights`` (BUCKETS + 1, machines), the last row biases; the first machines tell families apart, the others pairs within a family."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        """``x`` (texts, BUCKETS + 1), of which the last column is 1; it is scaled in place, as the one large matrix."""
        of = {code: name for name, codes in FAMILIES.items() for code in codes}
        groups: dict[str, list[str]] = {}
        for code in sorted(set(langs)):
            groups.setdefault(of.get(code, code), []).append(code)
        families = [groups[k] for k in sorted(groups)]
        y = np.array(langs)
        scale = np.ones(BUCKETS + 1)
        if len(x):
            mean, square = x[:, :-1].mean(axis=0, dtype=np.float64), np.einsum("ij,ij->j", x, x, dtype=np.float64)[:-1] / len(x)
            scale[:-1] = 1.0 / (np.sqrt(np.maximum(square - mean * mean, 0)) * np.sqrt(BUCKETS) + 1e-6)
            x *= scale.astype(np.float32)
        own = [np.isin(y, f) for f in families]
        pairs = [p for f in families for p in combinations(f, 2)]
        machines = [linear_svm(x, np.where(m, 1, -1).astype(np.float32)) for m in own] if len(families) > 1 else [np.zeros(BUCKETS + 1, np.float32)] * len(families)
        for a, b in pairs:
            at = (y == a) | (y == b)
            machines.append(linear_svm(x[at], np.where(y[at] == a, 1, -1).astype(np.float32)))
        w = np.stack(machines, axis=1) if machines else np.zeros((BUCKETS + 1, 0), np.float32)
        return cls(families, pairs, w * scale[:, None])

    def predict(self, p: np.ndarray | None) -> tuple[str, float]:
        if p is None or not self.families:
            return "und", 0.0
        m = p @ self.weights[:-1] + self.weights[-1]
        n = len(self.families)
        k = int(np.argmax(m[:n]))
        codes = self.families[k]
        sure = 1 / (1 + np.exp(-4 * float(m[k]))) if n > 1 else 1.0
        if len(codes) == 1:
            return codes[0], float(sure)
        votes = dict.fromkeys(codes, 0.0)
        edge = {pair: float(v) for pair, v in zip(self.pairs, m[n:], strict=True) if pair[0] in votes}
        for (a, b), v in edge.items():
            votes[a if v >= 0 else b] += 1 + 1e-6 * min(abs(v), 1000.0)
        best = max(codes, key=lambda c: votes[c])
        least = min(v if a == best else -v for (a, b), v in edge.items() if best in (a, b))
        return best, float(sure / (1 + np.exp(-4 * least)))


def fit_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2) -> LanguageModel:
    """Learns from non-null texts and languages of rows whose crc32(id) mod ``folds`` is not ``held_out``.

    Every language is learned, from at most TRAIN_PER_LANGUAGE documents by the hash order of the id; where that is above
    TRAIN_DOCUMENTS in all, each language gives its equal share of these, one document at least. An id with several texts of a language
    counts once, with the least of them, so reruns agree. Executors turn the texts into n-gram frequencies, of which the
    driver gets the non-zero ones.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null and lang is not null")
    own = own.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) != held_out)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # one row a language, as the model that is broadcast has
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()
    each = max(1, min(TRAIN_PER_LANGUAGE, TRAIN_DOCUMENTS // max(1, len(sizes))))
    # a hash threshold keeps a few times the sample, so what meets in one task to be ranked does not grow with the input
    ends = [(r.lang, int(min(1.0, (4 * each + 40) / max(1, r.n)) * (1 << 30))) for r in sizes]
    ends = docs.sparkSession.createDataFrame(ends, "lang string, below long")
    some = own.select("id", "lang").join(F.broadcast(ends), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("below")).select("id", "lang").distinct()
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("id", "lang")

    def kernel(batch: pa.RecordBatch) -> list:
        made = [(c, p) for c, t in zip(texts(batch, "lang"), texts(batch, "text"), strict=True) if (p := profile(t)) is not None]
        at = [np.flatnonzero(p) for _, p in made]
        return [[c for c, _ in made], at, [p[i] for i, (_, p) in zip(at, made, strict=True)]]

    sample = own.join(F.broadcast(some), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # some: TRAIN_DOCUMENTS rows, or one of each language
    got = emit_arrow(sample, kernel, "lang string, bucket array<int>, freq array<float>").toArrow()
    rows = sorted(zip(got["lang"].to_pylist(), [b.values.to_numpy() for b in got["bucket"]], [f.values.to_numpy() for f in got["freq"]], strict=True), key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    x = np.zeros((len(rows), BUCKETS + 1), np.float32)
    x[:, -1] = 1
    for k, (_, at, freq) in enumerate(rows):
        x[k, at] = freq
    return LanguageModel.fit(x, [r[0] for r in rows])


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends ``lang_pred`` and ``score`` (0 to 1) to every row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as all are if nothing was learned. An input column
    with the name of a new one gives way. The broadcast model has a fixed number of buckets and machines.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> list:
        made = [sent.value.predict(profile(t)) for t in texts(batch, text)]
        return [[m[0] for m in made], [m[1] for m in made]]

    return append_arrow(docs, kernel, "lang_pred string, score double", keep)
