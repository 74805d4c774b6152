"""Substring dedup by seeds that are extended: repeated passages of at least ``WINDOW`` words across and within texts.

Seeds are winnowed anchors: of the word ``SEED``-grams in each window of WINDOW words the one with the least hash. Equal
windows choose equal anchors at equal offsets. Neighbouring windows with one anchor form a run, the anchor extended to
both sides as far as a window with it reaches. Occurrences of a repeated anchor are joined: runs with equal words are
repeated as a whole, at the cost of one row each however many copies there are; where occurrences of an anchor extend
differently, their windows are compared one by one. Overlapping repeated windows make up the maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_arrow, cut_table, emit_arrow, heavy_keys, join_dealt, texts

WINDOW, SEED = 35, 10
_Q = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than bytes 9-13 and 32, unchanged."""
    return text.encode().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


class RangeHash:
    """Hashes of word ranges of one text, from prefix sums of word hashes times powers of an odd number, mod 2**64."""

    def __init__(self, hashes: np.ndarray, q: int):
        n = len(hashes)
        power = np.full(n, q, np.uint64)
        power[:1] = 1
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power), dtype=np.uint64)])
        back = np.full(n, pow(q, -1, 1 << 64), np.uint64)
        back[:1] = 1
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, RangeHash]:
    """Runs of windows with one anchor: anchor hash, first window and number of windows of each."""
    first = RangeHash(hashes, _Q[0])
    n = len(hashes)
    at = np.arange(n - seed + 1)
    grams = first.of(at, at + seed)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1)
    place = np.arange(len(views)) + views.argmin(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[starts]], starts, np.diff(np.append(starts, len(place))), first


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _seeds(window: int, seed: int):
    def kernel(batch: pa.RecordBatch) -> list:
        out = [anchors(word_hashes(w), window, seed)[0] for t in texts(batch, "text") if len(w := words_of(t)) >= window]
        return [_signed(np.concatenate(out)) if out else []]

    return kernel


def _runs(window: int, seed: int):
    """h, r: anchor and hash of the run's words; k1, k2: the text; at: first window * 64 + windows."""

    def kernel(batch: pa.RecordBatch) -> list:
        cols: list[list] = [[], [], [], [], []]
        for t, k1, k2 in zip(texts(batch, "text"), texts(batch, "k1"), texts(batch, "k2"), strict=True):
            w = words_of(t)
            if len(w) < window:
                continue
            h, start, n, first = anchors(word_hashes(w), window, seed)
            run = _signed(first.of(start, start + n + window - 1))
            for col, x in zip(cols, (_signed(h), run, np.full(len(h), k1), np.full(len(h), k2, np.int32), start * 64 + n), strict=True):
                col.append(x)
        return [np.concatenate(c) if c else [] for c in cols]

    return kernel


def _windows(window: int):
    """Two hashes of each window of the runs asked for, with the text, its place (as a run of one) and the weight."""

    def kernel(batch: pa.RecordBatch) -> list:
        cols: list[list] = [[], [], [], [], [], []]
        for t, k1, k2, need in zip(texts(batch, "text"), texts(batch, "k1"), texts(batch, "k2"), texts(batch, "need"), strict=True):
            hashes = word_hashes(words_of(t))
            code = np.array(need, np.int64)  # (first window * 64 + windows) * 4 + weight
            at, weight = code >> 2, code & 3
            n = at & 63
            start = np.repeat((at >> 6) - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for col, q in zip(cols, _Q, strict=False):
                col.append(_signed(RangeHash(hashes, q).of(start, start + window)))
            for col, x in zip(cols[2:], (np.full(len(start), k1), np.full(len(start), k2, np.int32), start * 64 + 1, np.repeat(weight, n)), strict=True):
                col.append(x)
        return [np.concatenate(c) if c else [] for c in cols]

    return kernel


def _kept(window: int, with_text: bool):
    def kernel(batch: pa.RecordBatch) -> list:
        n, gone, digest, kept = [], [], [], []
        for t, covers in zip(texts(batch, "text"), texts(batch, "covers"), strict=True):
            w = words_of(t)
            out = w
            if covers:
                at = np.array(covers, np.int64)
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, at >> 6, 1)
                np.add.at(edge, (at >> 6) + (at & 63) + window - 1, -1)
                stay = np.cumsum(edge[:-1]) == 0
                out = [w[i] for i in np.flatnonzero(stay)]
            line = b" ".join(out)
            n.append(len(w))
            gone.append(len(w) - len(out))
            digest.append(hashlib.sha256(line).hexdigest())
            kept.append(line.decode())
        return [n, gone, digest, *([kept] if with_text else [])]

    return kernel


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): one row per input row.

    A word goes if a window of ``window`` consecutive words covers it whose words also start anywhere else, in the same
    text or another row, all judged on the input; so all copies of a passage go. Null texts have no words; texts
    shorter than a window keep all. Windows are equal by two 64-bit hashes, runs by one of their words and one of
    their anchor. Other columns are not read, equal rows are copies of each other. Texts are known by 96 bits of hash, so equal texts share their rows in every join; counts per
    anchor, run and window are aggregated before they are shuffled, and the rows of heavy keys are dealt to many tasks.
    """
    if not seed <= window - 1 <= 62:
        raise ValueError("window must exceed seed and be at most 63")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))
    seeds = emit_arrow(own.select("text"), _seeds(window, seed), "h long")
    many = cut_table(seeds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    runs = emit_arrow(own.select("text", "k1", "k2"), _runs(window, seed), "h long, r long, k1 long, k2 int, at long")
    runs = cut_table(join_dealt(runs, many, ["h"], heavy_keys(many, ["h"]), "left_semi"))
    place = F.xxhash64("k1", "k2", "at")
    classes = cut_table(runs.groupBy("h", "r").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    kinds = cut_table(classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    repeated = join_dealt(classes, kinds, ["h"], heavy_keys(kinds, ["h"], "kinds"), "left").where("n > 1 or kinds > 1")
    met = join_dealt(runs, repeated, ["h", "r"], heavy_keys(classes, ["h", "r"]))
    # where an anchor extends differently, one occurrence of each run shows its windows, for at most two occurrences
    shows = F.col("kinds").isNotNull() & (F.col("one") == place)
    met = cut_table(met.select("k1", "k2", "at", F.least("n", F.lit(2)).alias("n"), shows.alias("shows")).where("n > 1 or shows"))
    need = met.where("shows").select("k1", "k2", (F.col("at") * 4 + F.col("n")).alias("code"))
    need = need.groupBy("k1", "k2").agg(F.collect_set("code").alias("need"))
    copies = cut_table(own.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"))
    common = heavy_keys(copies, ["k1", "k2"])
    shown = join_dealt(own, need, ["k1", "k2"], common).dropDuplicates(["k1", "k2"])
    windows = cut_table(emit_arrow(shown, _windows(window), "w1 long, w2 long, k1 long, k2 int, at long, n long"))
    again = cut_table(windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1"))
    single = join_dealt(windows.where("n = 1"), again, ["w1", "w2"], heavy_keys(again, ["w1", "w2"]), "left_semi").select("k1", "k2", "at")
    covers = met.where("n > 1").select("k1", "k2", "at").unionByName(single)
    covers = covers.groupBy("k1", "k2").agg(F.collect_set("at").alias("covers"))
    whole = join_dealt(own, covers, ["k1", "k2"], common, "left")
    return append_arrow(whole, _kept(window, with_text), "n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text, keep=["doc_id"])


REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, unnest(range(1, len(w) - 33)) AS s,
         unnest(list_transform(range(1, len(w) - 33), lambda s: md5(array_to_string(w[s:s + 34], ' ')))) AS h
  FROM d WHERE len(w) >= 35),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, s + k AS i FROM win JOIN twice USING (h), range(0, 35) AS t(k)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS line
  FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""
