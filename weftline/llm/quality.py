"""Quality rules with risk-controlled thresholds.

Every rule is a figure of a text. Labelled rows give counts of good and bad texts per stratum, rule and
bin of the figure; a cutoff may only be used if the exact (Clopper-Pearson) upper bound of the rate at which
it rejects good texts is at most alpha. The bound's level is delta over the number of cutoffs tried
(strata x rules x bins, Bonferroni), so that with probability 1 - delta no chosen cutoff exceeds its limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_splits, need, prepare, stored

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BINS = 64
RULES = ("symbols_per_word", "dup_line_share", "repeat_share", "long_words", "short_words")
STRATA = 4
#: A good text that a cutoff rejects weighs as much as so many bad ones that it lets pass.
GOOD_COST = 10
_DROP = bytes(set(range(256)) - set(SYMBOLS))
_odd = [np.uint64(x | 1) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
    0xE7037ED1A0B428DB
)]


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of UTF-8 bytes; null: none."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = sum(map(len, words))
    if not text.isascii():
        chars = len(b"".join(words).decode("utf-8"))
    return len(words), chars, len(text.translate(None, _DROP)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of width words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.uint64, len(words))
    if len(ids) > len(words) - 1:
        return 0
    seq = (seq + np.uint64(1)) * _odd[0]
    seq ^= seq >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += seq[k : k + n] * _odd[k]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(hit).tolist():  # equal hashes are confirmed on the words
        groups.setdefault(tuple(words[i : i + width]), []).append(i)
    cover = np.zeros(len(words) + 1, np.int64)
    for at in groups.values():
        if len(at) > 1:
            for i in at:
                cover[i] += 1
                cover[i + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def stats(docs: DataFrame) -> DataFrame:
    """text_stats of each whole text, by doc_id; null doc_ids stay, repeated rows stay."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(text_stats, batch.column(1).to_pylist()), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols]],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
            )

    return need(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.col("text").cast("binary")).mapInArrow(count, STATS)


def figures() -> dict[str, Column]:
    """Each rule's figure, scaled to 0..1; greater is worse."""
    w = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / w
    return {
        "symbols_per_word": F.least(F.col("n_symbols") / w, F.lit(1.0)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / w,
        "long_words": F.least(mean / 32, F.lit(1.0)),
        "short_words": F.greatest(F.lit(0.0), 1 - mean / 8),
    }


def stratum() -> Column:
    """Length classes: fixed in number, known for every text."""
    return F.when(F.col("n_words") < 64, 0).when(F.col("n_words") < 256, 1).when(F.col("n_words") < 1024, 2).otherwise(3)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a binomial rate: the p with P(X <= k) = delta; 1 without trials."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if _cdf(k, n, p) > delta:
            lo = p
        else:
            hi = p
    return hi


def _cdf(k: int, n: int, p: float) -> float:
    if p >= 1:
        return 0.0
    if p <= 0:
        return 1.0
    i = np.arange(k + 1)
    lg = np.concatenate(([0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[1:])))) if k else np.zeros(1)
    logs = lg + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def select_cutoffs(counts: dict[tuple[int, str], np.ndarray], alpha: float, delta: float) -> dict[tuple[int, str], int]:
    """From good and bad counts per bin (2 x BINS), per (stratum, rule) the lowest bin from which texts are rejected.

    The rule's share of the allowed false rejection is alpha over the number of rules. Without a safe and useful cutoff: BINS (reject none).
    Of several safe cutoffs that is taken which rejects most bad texts less GOOD_COST times the good ones; then the highest.
    """
    level, limit = delta / (STRATA * len(RULES) * BINS), alpha / len(RULES)
    out = {}
    for key, (good, bad) in counts.items():
        n, best, cut = int(good.sum()), 0, BINS
        g, b = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
        for c in range(BINS - 1, 0, -1):
            if (gain := int(b[c] - GOOD_COST * g[c])) > best and upper_bound(int(g[c]), n, level) <= limit:
                best, cut = gain, c
        out[key] = cut
    return out


def filter_quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Statistics, the base rules and the verdict of the fitted thresholds, one row per row of docs.

    Null text: no words, base_failed; very long texts are read whole; an empty table gives no rows; null doc_ids stay and other columns are left out. labels: doc_id,
    quality (1 good, 0 bad); nulls and ids without text don't count, an id labelled twice counts as good if any label says so, a repeated id counts
    once (the text with the least figures). No labels: nothing but the base rules rejects.
    What reaches the driver is strata x rules x bins x 2 counts.
    """
    s = stored(in_splits(stats(docs), docs), "stats")
    marks = need(labels, {"doc_id": "long", "quality": "int"}).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # An id counts once, however often it is repeated: trials must be independent.
    figures_of = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    once = s.where(~base_failed()).dropna(subset=["doc_id"]).join(marks, "doc_id").groupBy("doc_id", "quality").agg(F.min(figures_of).alias("x"))
    held = once.select("quality", "x.*").withColumn("stratum", stratum())
    long = held.select(
        "stratum", "quality",
        F.explode(F.array(*[F.struct(
            F.lit(r).alias("rule"), F.least(F.floor(x * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
        ) for r, x in figures().items()])).alias("x")
    )
    counts = {(k, r): np.zeros((2, BINS), np.int64) for k in range(STRATA) for r in RULES}
    for row in long.groupBy("stratum", "x.rule", "x.bin", (F.col("quality") > 0).alias("good")).count().collect():
        counts[row["stratum"], row["rule"]][0 if row["good"] else 1, row["bin"]] += row["count"]
    cuts = select_cutoffs(counts, alpha, delta)
    rejected = F.lit(False)
    for (k, r), c in cuts.items():
        if c < BINS:
            rejected = rejected | ((stratum() == k) & (figures()[r] * BINS >= c))
    return s.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
