"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (1 to 4) present in both, over the root of the
product of how many each has. Landmark texts give Nystroem features; kernel ridge regression, one
language against the rest, is solved on a sample of labelled texts; texts are scored by matrix products in batches.

All languages that documents are labelled with are learned. Bounds: LANDMARKS landmark texts and SAMPLE training texts a language, but no more than
ALL_LANDMARKS (one a language at least) and ALL_SAMPLES in all. Landmarks are texts of any length, of which only the sets of n-grams travel; those of
a usual length are taken first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, prepare

GRAMS, BITS = 4, 19
LANDMARKS, ALL_LANDMARKS, SAMPLE, ALL_SAMPLES = 24, 1024, 1000, 32_000
#: Characters of texts that make the best landmarks: enough n-grams, and quickly compared.
USUAL = (200, 3000)
RIDGE, BATCH = 1.0, 128
#: Values of the presence matrix that are held as floats at once.
DENSE = 1 << 24
UNKNOWN = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_buckets(text: str) -> np.ndarray:
    """Buckets (BITS bits) of all n-grams of the text in lower case, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for k in range(min(GRAMS, len(c))):
        h = (h[: len(c) - k] * _MUL + c[k:] + np.uint64(k + 1)) * _MIX
        h ^= h >> np.uint64(29)
        out.append((h * _MUL) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Kernel:
    """Presence of the landmarks' n-grams, and their counts. Of many landmarks the presence is held as bits and unpacked a stretch of n-grams at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.buckets = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        self.scale = 1 / np.sqrt(np.maximum(1, [len(s) for s in sets])).astype(np.float32)
        bits = np.zeros((len(self.buckets), -(-len(sets) // 8)), np.uint8)
        for k, s in enumerate(sets):
            bits[np.searchsorted(self.buckets, s), k >> 3] |= np.uint8(128 >> (k & 7))
        self.bits, self.dense = bits, None
        self.stretch = max(1, DENSE // max(1, len(sets)))

    def presence(self, at: int) -> np.ndarray:
        """The stretch of n-grams that begins at this place, by landmarks."""
        if self.dense is not None:
            return self.dense
        out = np.unpackbits(self.bits[at : at + self.stretch], axis=1, count=len(self.scale)).astype(np.float32)
        if len(self.buckets) <= self.stretch:
            self.dense = out
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None}

    def rows(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts with all landmarks: matrix products of batches."""
        out = np.zeros((len(texts), len(self.scale)), np.float32)
        flags = np.zeros(1 << BITS, np.bool_)
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            x = np.zeros((len(part), len(self.buckets)), np.bool_)
            size = np.ones(len(part), np.float32)
            for k, t in enumerate(part):
                g = gram_buckets(t)
                flags[g] = True
                x[k] = flags[self.buckets]
                size[k] = max(1, np.count_nonzero(flags))
                flags[g] = False
            for k in range(0, len(self.buckets), self.stretch):
                out[at : at + BATCH] += x[:, k : k + self.stretch].astype(np.float32) @ self.presence(k)
            out[at : at + BATCH] *= self.scale / np.sqrt(size)[:, None]
        return out

    def among(self) -> np.ndarray:
        """Kernel values of the landmarks with each other."""
        out = np.zeros((len(self.scale), len(self.scale)))
        for k in range(0, len(self.buckets), self.stretch):
            p = self.presence(k)
            out += p.T @ p
        return out * self.scale * self.scale[:, None]


def nystroem(kernel: np.ndarray) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix, without its null space."""
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def _share(names: list[str], shares: list[float]):
    """By row, the share of its language; 0 for none."""
    if not names:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in zip(names, shares, strict=True) for x in pair])[F.col("lang")], F.lit(0.0))


def _drawn(*columns: str):
    return F.pmod(F.xxhash64(*columns, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)


def landmark_sets(known: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """The languages of known (lang, text), and their landmarks' sets of n-grams: distinct texts, drawn by their hashes, of a usual length first, then longer and shorter ones."""
    n_chars = F.length("text")
    kind = F.when(n_chars.between(*USUAL), 0).when(n_chars > USUAL[1], 1).otherwise(2)
    texts = known.select("lang", kind.alias("kind"), F.xxhash64("text").alias("h"))
    counts = {(r["lang"], r["kind"]): r["n"] for r in texts.groupBy("lang", "kind").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()}
    names = sorted({lang for lang, _ in counts})
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // max(1, len(names))))
    chosen: dict[str, list[int]] = {name: [] for name in names}
    for k in range(3):
        short = [name for name in names if len(chosen[name]) < each and counts.get((name, k))]
        if short:
            # Three times as many as are wanted and some more: too few are drawn in one case of many millions.
            share = _share(short, [min(1.0, (3 * each + 40) / counts[name, k]) for name in short])
            for r in texts.where((F.col("kind") == k) & (_drawn("h") < share)).distinct().orderBy("lang", "h").collect():
                if r["h"] not in chosen[r["lang"]] and len(chosen[r["lang"]]) < each:
                    chosen[r["lang"]].append(r["h"])
    wanted = sorted({h for v in chosen.values() for h in v})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(gram_buckets(t)).astype("<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["h", "grams"])

    some = known.select(F.xxhash64("text").alias("h"), "text").where(F.col("h").isin(wanted)).dropDuplicates(["h"]) if wanted else known.select(
        F.lit(0).cast("long").alias("h"), "text"
    ).limit(0)
    return names, [np.frombuffer(r["grams"], "<i4").astype(np.int64) for r in some.mapInArrow(sets, "h long, grams binary").orderBy("h").collect()]


def fit(known: DataFrame) -> tuple[list[str], Kernel, tuple[np.ndarray, np.ndarray] | None]:
    """Languages, kernel and weights (by landmark and language; the constant) from known (doc_id, lang, text); no weights if nothing is known."""
    names, sets = landmark_sets(known)
    kernel = Kernel(sets)
    if not sets:
        return names, kernel, None
    shared = known.sparkSession.sparkContext.broadcast(kernel)
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    each = min(SAMPLE, max(1, ALL_SAMPLES // len(names)))
    sample = known.where(_drawn("doc_id", "text") < _share(names, [min(1.0, each / n[name]) for name in names])).select("lang", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = shared.value.rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(k.ravel()), k.shape[1]).cast(pa.list_(pa.float32()))], ["lang", "k"]
            )

    got = sample.mapInArrow(rows, "lang string, k array<float>").toArrow()
    x = got["k"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, len(sets)), np.float32)
    place = {name: k for k, name in enumerate(names)}
    lang = np.array([place[v] for v in got["lang"].to_pylist()], np.int64)
    root = nystroem(kernel.among())
    y = np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = (1 / np.maximum(1, np.bincount(lang, minlength=len(names))))[lang] * len(lang) / len(names)  # languages weigh alike
    f = np.hstack([x @ root, np.ones((len(x), 1))])
    beta = np.linalg.solve((f * w[:, None]).T @ f + RIDGE * np.eye(f.shape[1]), (f * w[:, None]).T @ y)
    shared.destroy()
    return names, kernel, ((root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32))


def identify(docs: DataFrame, learn=None, fit_on: DataFrame | None = None) -> DataFrame:
    """doc_id, lang_pred, score, one row per row of docs. learn: condition on doc_id for rows to learn from; fit_on: documents to learn from (docs).

    Null texts and texts without a letter are `und` with score 0, as all are if nothing can be learned. Null doc_ids stay; repeated rows get equal results;
    very long texts are read whole; of languages with equal scores the first by name is taken; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = need(fit_on if fit_on is not None else docs, {"doc_id": "long", "text": "string", "lang": "string"})
    known = base.where(
        F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}")
    ).where(learn if learn is not None else F.lit(True))
    names, kernel, weights = fit(known)
    shared = spark.sparkContext.broadcast(kernel)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            at = [k for k, t in enumerate(texts) if weights is not None and has_letter(t)]
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if at:
                z = shared.value.rows([texts[k] for k in at]) @ weights[0] + weights[1]
                p = np.exp(4 * (z - z.max(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                for k, best, row in zip(at, z.argmax(1).tolist(), p, strict=True):
                    pred[k], score[k] = names[best], float(row[best])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return need(docs, {"doc_id": "long", "text": "string"}).mapInArrow(predict, "doc_id long, lang_pred string, score double")
