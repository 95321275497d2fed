"""Packing as an exact round trip; quality figures by brute force; binomial bounds."""

import random
import zlib

import numpy as np
import pytest

from weftline.llm import packing, quality
from weftline.llm.queries import tokenizer_path

TEXTS = ["", "It's a Ça va?! don't we'LL «naïve» x.y,z 12,345.67 ΟΔΟΣ ΟΔΟΣ. é́a", " \t a b\x0bc\x1cd.", "İstanbul, ﬁn. ǅ,", "a., b x_, ...", "word " * 3000, "日本語 and more"]


def test_round_trip(spark, docs_of):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(7, None), (None, "no id"), (8, "twice"), (8, "twice")] + [(100 + k, " ".join(rng.choice(["alpha", "Beta,", "gamma."]) for _ in range(rng.randint(0, 400)))) for k in range(80)]
    got = packing.pack(docs_of(rows), tokenizer_path(), 256).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            want.setdefault((i, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())), []).append(1)
    found = {}
    for r in got:
        found.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
    assert found == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 256


def test_empty_table(spark, docs_of):
    assert packing.pack(docs_of([]), tokenizer_path()).count() == 0


def test_groups(spark, docs_of):
    got = packing.pack(docs_of([(k, "a b c d e f g") for k in range(300)]), tokenizer_path(), 64, group_pieces=100).collect()
    seen = {}
    for r in got:
        seen.setdefault(r["sequence_id"], []).append(r["length"])
    assert len(got) == 300
    assert all(sum(v) <= 64 for v in seen.values())


def test_sum_of_squares_is_the_least_change():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 17, 200)
    seq, off = packing.sum_of_squares(sizes, 16)
    gaps, n = {}, np.zeros(17, int)
    for s, q, o in zip(sizes.tolist(), seq.tolist(), off.tolist(), strict=True):
        def after(gap, s=s):
            m = n.copy()
            if gap:
                m[gap] -= 1
            m[(gap or 16) - s] += 1
            m[0] = 0
            return int((m[1:16] ** 2).sum())

        best = min([after(g) for g in range(s, 16) if n[g]] + [after(0)])
        gap = gaps.get(q, 0)
        assert o == (16 - gap if gap else 0)
        assert after(gap) == best
        if gap:
            n[gap] -= 1
        gaps[q] = (gap or 16) - s
        if gaps[q]:
            n[gaps[q]] += 1
    for size in (64, 2048):
        x = np.minimum(rng.lognormal(4, 1, 3000).astype(int) + 1, size)
        s, _ = packing.pack_lengths(x, size)
        assert s.max() + 1 <= -(-x.sum() // size) * 1.05 + 3


def brute(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines, dup, seen = t.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_statistics(spark, docs_of):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "é \x0b x\x0cy\rz\n#*$%&|<>", "l\nl\nl \n\nl", "a b c d e f g h " * 3, "\x1c\x85  x"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) + "\n" * rng.randint(0, 2) + "x" for _ in range(60)]
    rows = list(enumerate(texts))
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 60, 3)] + [(None, 1), (3, None), (0, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.filter_quality(docs_of(rows), labels).collect()}
    for k, t in rows:
        r, want = got[k], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.filter_quality(docs_of([]), labels).count() == 0


@pytest.mark.parametrize(("k", "n", "delta"), [(0, 10, 0.05), (3, 40, 0.01), (39, 40, 0.05), (5, 5, 0.1), (0, 0, 0.1)])
def test_upper_bound_is_exact(k, n, delta):
    from math import comb

    p = quality.upper_bound(k, n, delta)
    if k >= n:
        assert p == 1
    else:
        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(delta, rel=1e-6)


def test_cutoffs_are_safe():
    good, bad = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    good[:10], bad[40:] = 500, 20
    key = (1, quality.RULES[0])
    assert 10 <= quality.select_cutoffs({key: np.array([good, bad])}, 0.05, 0.05)[key] <= 40
    good[:] = 1
    assert quality.select_cutoffs({key: np.array([good, bad])}, 0.05, 0.05)[key] == quality.BINS
