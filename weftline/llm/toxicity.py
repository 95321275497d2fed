"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, back off to each class's continuation counts (in how many contexts a word
occurs), from there to the class's prefixes (how many of its words begin so), and last to counts that both share: in how many documents of the whole
corpus each word, and so each prefix, occurs. A text's log-likelihoods are normalised by its length; a logistic curve, fitted on labelled texts that the
models haven't seen, turns them into a score.

Bounds: the models take at most MAX_ROWS labelled rows of either class, and all words and bigrams of these. The shared counts cover every word of every
document, as a written table; of a word that no labelled text has, both classes take the same share of it, so their ratio doesn't need its count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_splits, lean, need, prepare, stored, trim

MAX_ROWS = 30_000
PREFIX, DISCOUNT = 4, 0.75
#: Words whose evidence counts as a text's strongest; words of a segment.
TOP, SEGMENT = 3, 64
#: Bigrams that the driver handles at once; parts, by their first words, in which it counts them.
STRETCH, PARTS = 1_000_000, 1024
THRESHOLD = 0.3
_START = np.uint64(0x9E3779B97F4A7C15)
FEATURES = 6



def _hash(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words and of their prefixes."""
    h = xxhash.xxh64_intdigest
    n = len(words)
    return np.fromiter(map(h, words), np.uint64, n), np.fromiter((h(w[:PREFIX], 7) for w in words), np.uint64, n)


class Tokens:
    """Words of a batch of texts: ids by place into its distinct words (hashes words, prefix hashes prefixes), begin by text."""

    def __init__(self, texts: pa.Array):
        texts = pc.utf8_lower(pc.fill_null(texts, ""))
        split = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(texts, r"[^\pL\pN]+", " "), " "), " ")
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        numbered = split.flatten().dictionary_encode()
        names = numbered.dictionary.to_pylist()
        ids = numbered.indices.to_numpy()
        begin = split.offsets.to_numpy() - split.offsets[0].as_py()
        if "" in names:  # a text without words
            keep = ids != names.index("")
            begin = np.append(0, np.cumsum(keep))[begin]
            ids = ids[keep]
        self.words, self.prefixes = _hash(names)
        self.ids, self.begin = ids, begin

    def starts(self) -> np.ndarray:
        """Places of first words."""
        return self.begin[:-1][np.diff(self.begin) > 0]

    def before(self, values: np.ndarray, none) -> np.ndarray:
        """Values by place, shifted to the next word; none for first words."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts()] = none
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))


def _find(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 where absent."""
    if not len(sorted_):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return np.where(sorted_[at] == keys, at, -1)


@dataclass
class Model:
    """Sorted keys and, by class (ordinary, toxic), their probabilities' parts."""

    words: np.ndarray  # with _START
    p_word: np.ndarray  # 2 x words: smoothed continuation probability
    seen: np.ndarray  # 2 x words: occurrences before another word
    back: np.ndarray  # 2 x words: weight of the backoff after this word (1: never seen before another)
    first: np.ndarray  # by word, where its bigrams begin; and where the last one's end
    second: np.ndarray  # by bigram, the second word's place; ascending for each first word
    kinds: np.ndarray  # by bigram, place of its counts
    counts: np.ndarray  # 2 x kinds: the different counts of bigrams, discounted
    prefixes: np.ndarray
    p_prefix: np.ndarray  # 2 x prefixes: of a word without labelled texts, but for the word's share in its prefix
    p_none: np.ndarray  # 2: the same without a known prefix, but for the word's share in the corpus

    def __getstate__(self) -> dict:
        """The bigrams, most of what is broadcast, compressed by byte, a stretch at a time: each executor holds several copies on disk."""
        packed = []
        for k in range(0, len(self.second), STRETCH):
            steps = np.diff(self.second[k : k + STRETCH], prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T
            packed.append((zlib.compress(np.ascontiguousarray(steps), 1), zlib.compress(self.kinds[k : k + STRETCH], 1)))
        return self.__dict__ | {"second": packed, "kinds": (len(self.second), self.kinds.dtype.str)}

    def __setstate__(self, state: dict) -> None:
        n, kind = state["kinds"]
        second, kinds = np.empty(n, np.int32), np.empty(n, kind)
        for k, (steps, of) in zip(range(0, n, STRETCH), state["second"], strict=True):
            steps = np.ascontiguousarray(np.frombuffer(zlib.decompress(steps), np.uint8).reshape(4, -1).T)
            np.cumsum(steps.view(np.int32).ravel(), out=second[k : k + STRETCH])
            kinds[k : k + STRETCH] = np.frombuffer(zlib.decompress(of), kind)
        self.__dict__ |= state | {"second": second, "kinds": kinds}

    def places(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of bigrams of two words' places, -1 where absent: a search among the first word's."""
        lo, hi = self.first[before], self.first[before + 1]
        end = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.second[np.minimum(mid, len(self.second) - 1)] < at
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        found = (lo < end) & (self.second[np.minimum(lo, len(self.second) - 1)] == at)
        return np.where(found, lo, -1)

    def evidence(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Per word, log of its toxic over its ordinary probability: after the word before it, and by its continuation counts alone."""
        of = _find(self.words, t.words)
        p = np.zeros((2, len(of)))
        rare = of < 0
        p[:, ~rare] = self.p_word[:, of[~rare]]
        q = _find(self.prefixes, t.prefixes[rare])
        p[:, rare] = np.where(q < 0, self.p_none[:, None], self.p_prefix[:, np.maximum(q, 0)] if len(self.prefixes) else 0.0)
        alone = (np.log(p[1] + 1e-300) - np.log(p[0] + 1e-300))[t.ids]
        p, at = p[:, t.ids], of[t.ids]
        before = t.before(at, _find(self.words, np.array([_START]))[0])
        if len(self.words):
            p *= np.where(before < 0, 1.0, self.back[:, np.maximum(before, 0)])
        if len(self.second):
            both = np.flatnonzero((at >= 0) & (before >= 0))
            keys, where = np.unique((before[both] << 32) | at[both], return_inverse=True)
            k = self.places(keys >> 32, keys & 0xFFFFFFFF)[where]
            both, k = both[k >= 0], k[k >= 0]
            p[:, both] += self.counts[:, self.kinds[k]] / np.maximum(self.seen[:, before[both]], 1)
        return np.log(p[1] + 1e-300) - np.log(p[0] + 1e-300), alone

    def features(self, t: Tokens) -> np.ndarray:
        """Per text: mean evidence (length-normalised), that of the strongest segment, the strongest words and the strongest one, the logarithm of its length, and one.

        Parts of a text go by continuation counts: of a few words, a bigram that one class has by chance would outweigh all else.
        """
        (e, alone), n = self.evidence(t), np.diff(t.begin)
        out = np.zeros((len(n), FEATURES))
        total, of_parts = (np.append(0.0, np.cumsum(x)) for x in (e, alone))
        out[:, 0] = (total[t.begin[1:]] - total[t.begin[:-1]]) / np.maximum(n, 1)
        for k in np.flatnonzero(n).tolist():
            a, b = t.begin[k], t.begin[k + 1]
            edge = np.append(np.arange(a, b, SEGMENT), b)
            if len(edge) > 2 and edge[-1] - edge[-2] < SEGMENT // 2:
                edge = np.delete(edge, -2)
            out[k, 1] = ((of_parts[edge[1:]] - of_parts[edge[:-1]]) / np.diff(edge)).max()
            own = alone[a:b]
            out[k, 2] = (own if len(own) <= TOP else np.partition(own, len(own) - TOP)[-TOP:]).sum() / TOP
            out[k, 3] = own.max()
        out[:, 4] = np.log1p(n) / 5
        out[:, 5] = 1.0
        return out


def sampled_labels(labels: DataFrame, learn, most: int = MAX_ROWS) -> DataFrame:
    """doc_id, toxic, part (0..4; 4 is for calibration), weight: labelled rows where learn holds, at most about `most` of either class, by a hash of the id."""
    rows = need(labels, {"doc_id": "long", "toxic": "int"}).dropna().groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(learn)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = {k: min(1.0, most / max(1, n.get(k, 0))) for k in (0, 1)}
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    kept = rows.where(h < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    return kept.select(
        "doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int").alias("part"),
        F.when(F.col("toxic") == 1, 1 / share[1]).otherwise(1 / share[0]).alias("weight")
    )


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return need(docs, {"doc_id": "long", "text": "string"})


def _grouped(batches: Iterator[pa.RecordBatch], size: int = 1_250_000) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sample_words(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The labelled texts' words, sorted, and their prefixes."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            x = Tokens(_column(t, "text"))
            k = np.unique(x.ids)
            yield pa.RecordBatch.from_arrays([_signed(x.words[k]), _signed(x.prefixes[k])], ["w", "q"])

    x = _by(train.select("text").mapInArrow(lean(distinct), "w long, q long").groupBy("w").agg(F.first("q").alias("q")), ["w", "q"])
    order = np.argsort(x["w"])
    return x["w"][order], x["q"][order]


def bigrams(train: DataFrame, words: np.ndarray) -> DataFrame:
    """pair, n: bigrams of the labelled texts as places in words (the first word's in the high half), and how often ordinary (low half) and toxic texts have them. A written table."""
    shared = train.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _find(shared.value, np.array([_START]))[0]
        for t in _grouped(batches):
            toxic, tokens = t["toxic"].to_numpy(), Tokens(_column(t, "text"))
            at = _find(shared.value, tokens.words)[tokens.ids]
            pair, where = np.unique((tokens.before(at, start) << 32) | at, return_inverse=True)
            is_toxic = toxic[tokens.owner()] > 0
            n = np.bincount(where[~is_toxic], minlength=len(pair)) + (np.bincount(where[is_toxic], minlength=len(pair)) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    out = stored(
        train.select("toxic", "text").mapInArrow(lean(count, shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "bigrams",
        few=2
    )
    shared.destroy()
    return out


def _sorted_bigrams(table: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From bigrams, first, second and kinds as a Model has them, and the different counts (low half, high half). The driver fetches about STRETCH bigrams at a time."""
    both = np.sort(_by(table.select("n").distinct(), ["n"])["n"])
    part = F.floor(F.shiftright("pair", 32) * PARTS / max(1, n_words)).cast("int").alias("part")
    sizes = np.zeros(PARTS, np.int64)
    for r in table.groupBy(part).count().collect():
        sizes[r["part"]] = r["count"]
    n, begin, at = int(sizes.sum()), 0, 0
    of_first = np.zeros(n_words + 1, np.int64)
    second, kinds = np.empty(n, np.int32), np.empty(n, np.uint16 if len(both) <= 1 << 16 else np.uint32)
    while begin < PARTS:
        end = begin + 1
        while end < PARTS and sizes[begin : end + 1].sum() <= STRETCH:
            end += 1
        if sizes[begin:end].any():
            x = _by(table.where((part >= begin) & (part < end)), ["pair", "n"])
            order = np.argsort(x["pair"])
            stop = at + len(order)
            second[at:stop], kinds[at:stop] = x["pair"][order] & 0xFFFFFFFF, np.searchsorted(both, x["n"][order])
            of_first[1:] += np.bincount(x["pair"] >> 32, minlength=n_words)
            at = stop
        begin = end
    return np.cumsum(of_first), second, kinds, both


def document_counts(docs: DataFrame) -> DataFrame:
    """w, q, n: every word of the corpus, its prefix, and in how many documents it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            x = Tokens(_column(t, "text"))
            size = max(1, len(x.words))
            df = np.bincount(np.unique(x.owner() * size + x.ids) % size, minlength=len(x.words))
            k = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([_signed(x.words[k]), _signed(x.prefixes[k]), pa.array(df[k])], ["w", "q", "n"])

    return _texts(docs).select("text").mapInArrow(lean(count), "w long, q long, n long").groupBy("w").agg(F.first("q").alias("q"), F.sum("n").alias("n"))


def _counts_of(types: DataFrame, words: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """From document_counts: those of words; the sums of counts, one added to each word's, by prefix and of all words."""
    shared = types.sparkSession.sparkContext.broadcast((words, prefixes))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, prefixes = shared.value
        by_prefix = np.zeros(len(prefixes) + 1, np.int64)
        for t in _grouped(batches):
            w, q, n = (t[c].to_numpy() for c in ("w", "q", "n"))
            at = _find(words, w.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at[at >= 0]), pa.array(n[at >= 0])], ["k", "n"])
            np.add.at(by_prefix, _find(prefixes, q.view(np.uint64)), n + 1)  # -1: the last
        k = np.flatnonzero(by_prefix)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - k), pa.array(by_prefix[k])], ["k", "n"])

    x = _by(types.mapInArrow(lean(look_up, shared), "k long, n long"), ["k", "n"])
    shared.destroy()
    of_word, of_prefix = np.zeros(len(words), np.int64), np.zeros(len(prefixes) + 1, np.int64)
    word = x["k"] >= 0
    of_word[x["k"][word]] = x["n"][word]
    np.add.at(of_prefix, -1 - x["k"][~word], x["n"][~word])
    return of_word, of_prefix[:-1], float(max(1, of_prefix.sum()))


def _by(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    t = df.toArrow()
    return {c: (t[c].to_numpy().view(np.uint64) if c in ("w", "q") else t[c].to_numpy()) for c in columns}


def discounts(n: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """By class, what is taken off each of the counts n (2 x keys): the three discounts, for counts of one, two and more, that counts of counts estimate
    (of modified Kneser-Ney). weight: how many keys have these counts."""
    out = np.zeros_like(n)
    for c in (0, 1):
        of = [float((n[c] == k).sum() if weight is None else weight[n[c] == k].sum()) for k in range(5)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
        d = [min(float(k), max(DISCOUNT, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] else DISCOUNT for k in (1, 2, 3)]
        out[c] = np.where(n[c] >= 3, d[2], np.where(n[c] == 2, d[1], np.where(n[c] == 1, d[0], 0.0)))
    return out


def _discounted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By class: discounted shares of the counts n (2 x keys), and what that leaves for the backoff (all, for a class without counts)."""
    total = n.sum(1)
    kept = n - discounts(n)
    return kept / np.maximum(total, 1)[:, None], np.where(total > 0, 1 - kept.sum(1) / np.maximum(total, 1), 1.0)


def fit_model(docs: DataFrame, train: DataFrame) -> Model:
    """The class models from train (toxic, text), shared counts from docs."""
    found, of = sample_words(train)
    words = np.union1d(found, np.array([_START] if len(found) else [], np.uint64))
    place, prefixes = _find(words, found), np.unique(of)
    q = _find(prefixes, of)
    of_word, of_prefix, every = _counts_of(stored(document_counts(docs), "types", few=2), found, prefixes)
    first, second, kinds, both = _sorted_bigrams(bigrams(train, words), len(words))
    by_kind = np.array([both & 0xFFFFFFFF, both >> 32], float).reshape(2, -1)
    off = discounts(by_kind, np.bincount(kinds, minlength=len(both)).astype(float))
    contexts, seen, left = (np.zeros((2, len(words))) for _ in range(3))
    for k in range(0, len(second), STRETCH):
        of_kind = by_kind[:, kinds[k : k + STRETCH]]
        before = np.searchsorted(first, np.arange(k, k + of_kind.shape[1]), "right") - 1
        for c in (0, 1):
            has = of_kind[c] > 0
            history = before[has]
            contexts[c] += np.bincount(second[k : k + STRETCH][has], minlength=len(words))
            seen[c] += np.bincount(history, weights=of_kind[c][has], minlength=len(words))
            left[c] += np.bincount(history, weights=off[c, kinds[k : k + STRETCH]][has], minlength=len(words))
    # What a history's bigrams leave is for the backoff.
    back = np.where(seen > 0, left / np.maximum(seen, 1), 1.0).astype(np.float32)
    seen = seen.astype(np.float32)
    counts = by_kind - off
    contexts = contexts[:, place]
    # Prefixes: in how many words of either class, discounted into how often the corpus has them.
    kept, spare = _discounted(np.array([np.bincount(q[x > 0], minlength=len(prefixes)) for x in contexts], float))
    p_prefix = kept + spare[:, None] * of_prefix / every
    # Words: in how many contexts of either class, discounted into their prefixes' and their share of these.
    kept, spread = _discounted(contexts)
    p_word = np.zeros((2, len(words)), np.float32)
    p_word[:, place] = kept + spread[:, None] * p_prefix[:, q] * ((of_word + 1) / of_prefix[q])
    return Model(words, p_word, seen, back, first, second, kinds, counts, prefixes, spread[:, None] * p_prefix, spread * spare)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton's method; without both classes a rule on the mean evidence."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([4.0, 0, 0, 0, 0, -1.0])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, learn=None) -> tuple[Broadcast, np.ndarray]:
    """The models, broadcast, and the logistic curve's coefficients. learn: condition on doc_id for rows whose label may be used."""
    spark = docs.sparkSession
    base = _texts(docs)
    chosen = stored(sampled_labels(labels, learn if learn is not None else F.lit(True)), "labels", few=32)
    train = base.join(F.broadcast(chosen), "doc_id")
    model = spark.sparkContext.broadcast(fit_model(base, train.where("part < 4")))
    trim()  # the driver's arrays are as long as the model's

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            x = model.value.features(Tokens(_column(t, "text")))
            yield pa.RecordBatch.from_arrays(
                [_column(t, "toxic"), _column(t, "weight"), *[pa.array(c) for c in x.T]], ["toxic", "weight", *[f"x{k}" for k in range(FEATURES)]]
            )

    got = train.where("part = 4").select("toxic", "weight", "text").mapInArrow(
        lean(features, model), "toxic int, weight double, " + ", ".join(f"x{k} double" for k in range(FEATURES))
    ).toArrow()
    x = np.stack([got[f"x{k}"].to_numpy() for k in range(FEATURES)], 1) if got.num_rows else np.zeros((0, FEATURES))
    return model, fit_logistic(x, got["toxic"].to_numpy().astype(float), got["weight"].to_numpy())


def _scorer(docs: DataFrame, labels: DataFrame, learn):
    """The function that rates texts, and the broadcast that it reads."""
    shared, beta = fit(docs, labels, learn)

    def rate(texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shared.value.features(Tokens(texts)) @ beta, -30, 30)))

    return rate, shared


def score(docs: DataFrame, labels: DataFrame, learn=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0..1), predicted, one row per row of docs. learn: condition on doc_id for rows whose label may be used.

    Null and empty texts have no evidence but the base rate and length; very long texts are read whole. An empty table gives no rows. Null doc_ids stay; repeated rows get equal scores; ids labelled twice are
    toxic if any label says so; without labels of both classes the models fall back to what they share.
    """
    rate, shared = _scorer(docs, labels, learn)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            p = rate(_column(t, "text"))
            yield pa.RecordBatch.from_arrays([_column(t, "doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _texts(docs).mapInArrow(lean(scores, shared), "doc_id long, score double, predicted int")


def reject_toxic(docs: DataFrame, labels: DataFrame, learn=None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, that score below the threshold. Cases as in score."""
    rate, shared = _scorer(docs, labels, learn)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            yield from t.filter(pa.array(rate(_column(t, "text")) < threshold)).to_batches()

    return in_splits(docs.mapInArrow(lean(keep, shared), docs.schema), docs)


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t[name]
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
