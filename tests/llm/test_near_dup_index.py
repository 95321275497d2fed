"""Near duplicates and phrase matches against brute force; HyperMinHash estimates; planted cases."""

import collections
import hashlib
import random
import re

import numpy as np

from weftline.llm import near_dup, phrase_index


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}, {i: len(s) for i, s in sets}


def near_copies(rng):
    vocab = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 60, 700]))]
        for _ in range(rng.randint(1, 7)):
            words = [w if rng.random() > 0.03 else rng.choice(vocab) for w in base]
            rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
            k += 1
    return rows


def test_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "MINOR_BLOCK", 2)
    monkeypatch.setattr(near_dup, "MEMBER_BLOCK", 3)
    rng = random.Random(5)
    rows = near_copies(rng)
    n = len(rows)
    rows += [(n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "oNE  two"), (n + 5, "É a b c d"), (n + 6, "é a b c d")]
    want, sizes = brute_components(rows)
    got = near_dup.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_hot_chain_of_edits(spark, docs_of):
    """Each document differs a little from the one before it: one component, though ends have nothing in common."""
    words = [f"a{k}" for k in range(80)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[k % 80] = f"b{k}"
    want, _ = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == want
    assert set(got.values()) == {0}


def test_empty_null_ids_repeated_rows(spark, docs_of):
    assert near_dup.near_duplicates(docs_of([])).count() == 0
    got = near_dup.near_duplicates(docs_of([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (6, "")])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("3", 3, True), ("3", 3, True), ("5", 3, False), ("6", 6, True), ("None", None, True)]


def test_texts_of_one_id(spark, docs_of):
    """Different texts with equally many shingles under one id: what is near any of them is linked with it."""
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(3, " ".join(a)), (3, " ".join(b)), (5, " ".join([*a[:-1], "x"])), (6, " ".join([*b[:-1], "y"])), (7, "other words of another text")]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == {3: 3, 5: 3, 6: 3, 7: 7}


def test_estimates():
    rng = np.random.default_rng(6)
    errors = []
    for j in (0.2, 0.5, 0.75, 0.9):
        for _ in range(20):
            n = 2000
            both = int(2 * n * j / (1 + j))
            h = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            a, b = np.unique(h[:n]), np.unique(np.concatenate((h[:both], h[n : 2 * n - both])))
            eq = (near_dup.registers(a) == near_dup.registers(b)).mean()
            errors.append(near_dup.estimate(np.array([eq]), np.array([n]), np.array([n]))[0] - j)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.06


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 6: 5} | {101 + k: 100 for k in range(40)}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(doc, items, counts, width=13):
    d, hit, found, near = words(doc), set(), set(), set()
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            win = w[i : i + width]
            for at in range(len(d) - len(win) + 1):
                if d[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(item_id)
            rare = min(win, key=lambda x: counts.get(x, 0))
            if any(x == rare and set(win) <= set(d[max(0, at - phrase_index.NEAR) : at + phrase_index.NEAR + 1]) for at, x in enumerate(d)):
                near.add(item_id)
    return len(d), len(hit), sorted(found), sorted(near)


def planted(rng):
    vocab = ["the", "of", "and", *[f"t{k}" for k in range(60)]]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 5, 13, 20, 40])))) for k in range(12)] + [(50, ""), (51, None), (52, "!!!"), (53, "Üñ-İ x")]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split(" ")
            cut = rng.randint(0, 4)
            parts.append(rng.choice([" ", "\n", ", "]).join(w[cut:]).upper())
            parts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 10))))
        docs.append((k, rng.choice([" ", ".", "\n"]).join(parts)))
    return docs + [(90, None), (91, ""), (92, "..."), (None, items[0][1])], items


def check_decontamination(spark, docs_of, docs, items):
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = phrase_index.decontaminate(docs_of(docs), b).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    counts = collections.Counter(w for _, t in docs for w in words(t))
    for k, t in docs:
        n, hit, found, near = brute_hits(t, items, counts)
        r = by[k]
        assert (r["n_words"], r["n_hit"], list(r["items"])) == (n, hit, sorted(map(str, found))), t
        # A block counts its windows' terms over all documents, as the brute force does.
        assert list(r["near_items"]) == sorted(map(str, near)), t
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = {r["doc_id"] for r in phrase_index.reject_contaminated(docs_of(docs), b).collect()}
    assert kept == {r["doc_id"] for r in got if not r["contaminated"]}


def test_decontamination(spark, docs_of):
    check_decontamination(spark, docs_of, *planted(random.Random(7)))


def test_decontamination_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", 30)
    monkeypatch.setattr(phrase_index, "STRETCH", 5)
    check_decontamination(spark, docs_of, *planted(random.Random(8)))


def test_empty_sides(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    got = phrase_index.decontaminate(docs_of([(1, "a b")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]
    assert phrase_index.decontaminate(docs_of([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_stored_index_and_proximity(spark, docs_of):
    d = docs_of([(1, "red green blue red"), (2, "blue x x x x red"), (3, None), (4, "red " + "x " * 30 + "blue")])
    index = phrase_index.build_index(d)
    assert {(r["term"], r["doc_id"]): list(r["positions"]) for r in phrase_index.postings(index, ["Red", "blue"]).collect()} == {("red", 1): [0, 3], ("blue", 1): [2], ("blue", 2): [0], ("red", 2): [5], ("red", 4): [0], ("blue", 4): [31]}
    assert {(r["doc_id"], r["position"]) for r in phrase_index.proximity(index, ["red", "blue"], 3).collect()} == {(1, 0)}
    assert {(r["doc_id"], r["position"]) for r in phrase_index.proximity(index, ["red", "blue"], 6).collect()} == {(1, 0), (2, 0)}
    assert phrase_index.proximity(index, ["red", "missing"], 6).count() == 0


def test_segments(monkeypatch):
    rng = random.Random(9)
    texts = [[b"w%d" % rng.randrange(30) for _ in range(rng.randint(0, 40))] for _ in range(20)]
    s = phrase_index.Segment.of(texts)
    t = phrase_index.Segment.unpacked(s.n_words, s.terms, s.begins, s.packed())
    assert t.positions.tolist() == s.positions.tolist()
    at = {int(h): (t.positions[a:b]).tolist() for h, a, b in zip(t.terms, t.begins[:-1], t.begins[1:])}
    want = {}
    for begin, x in zip(t.begin.tolist(), texts):
        for k, w in enumerate(x):
            want.setdefault(phrase_index.term_hash(w), []).append(begin + k)
    assert at == want


def test_digest_of_items(spark):
    from weftline.llm.queries import op10_decontamination

    got = op10_decontamination(spark, "/root/testdata/sf0.001").where("n_hit = 0").first()
    assert got["items_sha256"] == hashlib.sha256(b"").hexdigest()
