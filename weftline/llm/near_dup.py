"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed; the hash's leading bits choose one of K buckets, and of each
bucket's smallest hash a register keeps the number of leading zeros and the next mantissa bits. Empty buckets
borrow from others in a fixed order. Bands of registers are the candidate keys. Candidates are estimated
from their registers (corrected for chance collisions) and then confirmed on the full sets.

Equal sets are one class from the start, so a group of copies costs one member. In a band's bucket every member is
compared with one centre first; only buckets that still hold more than one component have their
members compared with each other, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_files, in_splits, lean, need, prepare, stored

SHINGLE, PERCENT = 5, 75
#: Registers, rows of a band: two sets of similarity 0.75 share none of the 32 bands with a chance of 5e-6.
K, ROWS = 128, 4
MANTISSA, BUCKET_BITS = 10, 7
#: Standard errors below the wanted similarity at which an estimate still goes to the exact check.
SLACK = 5.0
#: Compared at once: so many unlinked members of a bucket with so many of its members.
MINOR_BLOCK, MEMBER_BLOCK = 512, 2048
#: Members per copy of a centre's text.
CENTRE_MEMBERS = 256
#: Hashes of a set by which the members of unresolved buckets are compared.
SAMPLE = 512
_MOST = np.uint32(0xFFFFFFFF)
CACHE_WORDS = 250_000

_rest = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
_bounds = np.arange(K, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_probes = np.array([np.random.default_rng(7919 + j).permutation(K) for j in range(K)])
_mult = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
    0x589965CC75374CC3
)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of width-word shingles of UTF-8 text, A-Z lower-cased; fewer words: the sequence as one; none: empty."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ w[k : k + n]) * _mult[k % 8]
        h ^= h >> np.uint64(32)
    h *= _mult[1]
    h ^= h >> np.uint64(29)
    h *= _mult[2]
    return np.unique(h ^ (h >> np.uint64(32)))


def registers(h: np.ndarray) -> np.ndarray:
    """K registers (16 bits: leading zeros, mantissa; never 0) of a non-empty sorted array of hashes."""
    at = np.searchsorted(h, _bounds)
    full = at < np.append(at[1:], len(h))
    v = h[np.minimum(at, len(h) - 1)] & _rest
    bits = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (v >> shift) & np.uint64((1 << MANTISSA) - 1)
    reg = (((64 - BUCKET_BITS + 1 - bits).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa) + np.uint64(1)
    reg = reg.astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        reg[empty] = reg[_probes[empty, full[_probes[empty]].argmax(1)]]
    return reg


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from shares of equal registers, less what two unrelated sets of n and m shingles have in common by chance."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.1699 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def may_link(equal: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether a pair goes to the exact check: sizes allow it and the estimate is not SLACK standard errors below."""
    least, most = np.minimum(n, m), np.maximum(n, m)
    used = K * (1 - np.exp(-least / K))
    p = percent / 100
    return (100 * least >= percent * most) & (estimate(equal, n, m) >= p - SLACK * np.sqrt(p * (1 - p) / np.maximum(used, 1)))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact condition on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _texts(docs: DataFrame) -> DataFrame:
    return need(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set_id (128-bit hash of the set), bands (registers, ROWS to a long; null for empty sets)."""
    prepare(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, bands = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text)
                sizes.append(len(h))
                ids.append(xxhash.xxh3_128_digest(h.tobytes()))
                bands.append(registers(h).view("<i8").tolist() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "set_id", "bands"]
            )

    return _texts(docs).mapInArrow(lean(sketch, _words), "doc_id long, n long, set_id binary, bands array<long>")


def _registers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u2").reshape(-1, K)


def _estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b that may_link."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bands_a", "bands_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                equal = (_registers(t.column(4)) == _registers(t.column(5))).mean(1)
                yield t.select(["a", "b"]).filter(pa.array(may_link(equal, t.column(2).to_numpy(), t.column(3).to_numpy())))

    return both.mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs a, b whose full sets are similar. Texts go to their pair's b; a hot b is copied, so that no task gets all of its partners."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / CENTRE_MEMBERS).alias("salts"))
    dealt = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    wanted = dealt.select(
        F.col("a").alias("doc_id"), "b", "salt", F.lit(1).alias("side")
    ).unionByName(dealt.select(F.col("b").alias("doc_id"), "b", "salt", F.lit(0).alias("side")).distinct())
    rows = texts.join(wanted, "doc_id").select("doc_id", "b", "salt", "side", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", "side")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sets = None, []
        for t in batches:
            found: list[tuple[int, int]] = []
            for doc_id, b, salt, side, text in zip(*(c.to_pylist() for c in t.columns), strict=True):
                if (b, salt) != centre:
                    centre, sets = (b, salt), []
                h = shingles(text)
                if side == 0:
                    sets.append(h)
                elif any(similar(h, s) for s in sets):
                    found.append((doc_id, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(lean(check, _words), "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link a, b and is not its component's smallest itself. Large-star and small-star steps until nothing changes; each round is written out."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", few=32)
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = stored(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "links", few=32
        )
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
    else:
        raise RuntimeError(f"components: not done after {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _samples(texts: DataFrame) -> DataFrame:
    """node, size, codes (the SAMPLE smallest hashes' leading 32 bits, ascending: the whole set if it is that small)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [shingles(x) for x in batch.column(1).to_pylist()]
            codes = [np.unique((x[:SAMPLE] >> np.uint64(32)).astype("<u4")).tobytes() for x in h]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in h], pa.int64()), pa.array(codes, pa.binary())], ["node", "size", "codes"]
            )

    return texts.mapInArrow(lean(sample, _words), "node long, size long, codes binary")


def _unresolved(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of members of one bucket that are in different components and similar by their samples.

    In a bucket the members outside its largest component meet all members, in blocks. A sample tells small sets'
    similarity as good as exactly, so that what leaves a block is links, not pairs.
    """
    own = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = own.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    open_ = per.groupBy("band", "key").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("parts")
    ).where("parts > 1")
    open_ = open_.select(
        "band", "key", F.col("top.component").alias("major"), F.ceil((F.col("total") - F.col("top.n")) / MINOR_BLOCK).cast("int").alias("nj"),
        F.ceil(F.col("total") / MEMBER_BLOCK).cast("int").alias("ni")
    )
    there = stored(own.join(open_, ["band", "key"]), "open-members", few=32)
    samples = stored(_samples(texts.join(there.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")), "samples", few=32)
    j, i = F.pmod(F.xxhash64("node"), F.col("nj")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("ni")).cast("int")
    placed = there.withColumn("home", i).withColumn("own_j", F.when(F.col("component") != F.col("major"), j))
    resident = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("i", F.col("home")).withColumn(
        "minor", F.coalesce(F.col("j") == F.col("own_j"), F.lit(False))
    ).withColumn("resident", F.lit(True))
    visitor = placed.where("own_j is not null and ni > 1").withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))
    ).where("i <> home").withColumn("j", F.col("own_j")).withColumn("minor", F.lit(True)).withColumn("resident", F.lit(False))
    cols = ["band", "key", "j", "i", "minor", "resident", "node", "component"]
    dealt = resident.select(*cols).unionByName(visitor.select(*cols)).join(samples, "node")
    return dealt.groupBy("band", "key", "j", "i").applyInArrow(_compare, "a long, b long").distinct()


def _compare(t: pa.Table) -> pa.Table:
    minor, resident = (t[c].to_numpy() for c in ("minor", "resident"))
    node, comp, size = (t[c].to_numpy() for c in ("node", "component", "size"))
    codes = [np.frombuffer(x, "<u4") for x in t["codes"].to_pylist()]
    begin = np.cumsum([0, *map(len, codes)])
    of = np.repeat(np.arange(len(codes)), np.diff(begin))
    ids = np.unique(np.concatenate(codes), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    holders, first = of[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))
    a, b = [], []
    met: set[tuple[int, int]] = set()  # pairs of components with a link beyond doubt: one such link joins them
    for x in np.flatnonzero(minor).tolist():
        mine = ids[begin[x] : begin[x + 1]]
        common = np.bincount(np.concatenate([holders[first[k] : first[k + 1]] for k in mine.tolist()]), minlength=len(codes))
        # Of samples, at least this share is common to sets that may be similar.
        some = np.flatnonzero(
            resident & (comp != comp[x]) & (
                100 * np.minimum(size, size[x]) >= PERCENT * np.maximum(size, size[x])
            ) & (100 * common >= 50 * np.minimum(len(mine), np.diff(begin)))
        )
        for y in some[np.argsort(-common[some], kind="stable")].tolist():
            both = (min(comp[x], comp[y]), max(comp[x], comp[y]))
            if both in met or not _sampled(codes[x], codes[y], int(size[x]), int(size[y]), int(common[y])):
                continue
            if max(size[x], size[y]) <= SAMPLE and 100 * (common[y] - 1) >= PERCENT * (size[x] + size[y] - common[y] + 1):
                met.add(both)  # even if two of the codes are equal by chance
            a.append(max(node[x], node[y]))
            b.append(min(node[x], node[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sampled(x: np.ndarray, y: np.ndarray, n: int, m: int, common: int) -> bool:
    """Whether sets of n and m shingles may be similar, given how many codes their samples share: exact up to equal codes for whole sets, else SLACK standard errors."""
    if n <= SAMPLE and m <= SAMPLE:
        return 100 * common >= PERCENT * (n + m - common)
    top = min(x[-1] if n > SAMPLE else _MOST, y[-1] if m > SAMPLE else _MOST)
    k = int(np.searchsorted(x, top, "right") + np.searchsorted(y, top, "right")) - common
    p = PERCENT / 100
    return common / k >= p - SLACK * (p * (1 - p) / k) ** 0.5


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id), one row per row of docs.

    Null or blank texts have no shingles and no links. A null doc_id has no links, a null component_id, and is kept.
    Rows that share a doc_id are one document: any of their texts' links hold, and all are kept or none. Very long texts are read whole; an empty table
    gives no rows; other columns are left out.
    """
    all_ = stored(in_splits(sketches(docs), docs), "sketches")
    some = all_.where("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("set_id").agg(F.min("doc_id").alias("node")), "classes", few=32)
    sets = stored(
        some.join(
            classes.withColumnRenamed("node", "doc_id"), ["set_id", "doc_id"], "left_semi"
        ).select(F.col("doc_id").alias("node"), "set_id", "n", "bands").dropDuplicates(["node", "set_id"]),
        "sets", few=8
    )
    keys = sets.select("node", F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("tinyint"))
    shared = keys.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1").drop("members")
    members = stored(keys.join(shared, ["band", "key"]), "members", few=4)
    # A doc_id with several sets is a node with several members of a bucket.
    starred = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    first = _estimated(starred, sets).groupBy("a").agg(F.min("b").alias("b"))
    nodes = members.select(F.col("node").alias("doc_id")).distinct()
    texts = stored(_texts(docs).join(nodes.hint("shuffle_hash"), "doc_id", "left_semi"), "texts", few=2)
    links = stored(_confirmed(first, texts), "first-links", few=32)
    more = stored(_unresolved(members.drop("centre"), components(links), texts), "open", few=32)
    if more.limit(1).count():
        links = stored(links.unionByName(_confirmed(more, texts)), "all-links", few=32)
    # Sets of one doc_id, if it has several, and members of a class are linked through their class.
    same = some.join(classes, "set_id").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = same.join(classes.select(F.col("node").alias("a")), "a", "left_semi")
    found = components(links.unionByName(repeated))
    label = classes.join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    out = all_.withColumn("set_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_id"))).join(label, "set_id", "left")
    return in_files(out, 4).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
