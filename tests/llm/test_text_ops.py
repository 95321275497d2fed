"""PII, line templates, language, toxicity, HTML, WARC: brute force, round trips, edge cases."""

import collections
import hashlib
import io
import math
import pickle
import random
import re
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import html_text, language, line_templates, pii, toxicity, warc_zip


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_identifiers(spark, docs_of):
    rng = random.Random(9)
    parts = ["a@b.c_d@e.f", "x.y+z%@host-1.example.org.", "@", "a@b", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "007.08.9.255", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111111222", "5500005555555559", "+49 (0)30 1234567", "++1 212.555.0199 4", "+1-", "é😀", "12 34", "9" * 25, " ", "\n", "-", ".", "word", "4012888888881881"]
    texts = [None, "", "a" * 5000 + "@", "1" * 5000, "a@" + "b." * 3000 + "c", "+" + "1 " * 3000, *parts] + [rng.choice(["", " ", "x"]).join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "a@b.cd"), (3000, "q@w.er"), (3000, "q@w.er")]
    got = pii.digest_columns(pii.find_private(docs_of(rows)))
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert len(found[3000]) == 2
    for k, t in rows[:-2]:
        r, want = found[k][0], base_spans(t or "")
        text = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t, r["spans"], text)
        assert r["spans"].startswith(text)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[0] == kind for x in want) for kind in ("email", "ip", "card", "phone")]
    assert pii.find_private(docs_of([])).count() == 0


def test_disclosing_words(spark, docs_of):
    """A word of documents that share an address discloses it, wherever it stands; common words don't, nor does a word of one document."""
    far = "the rest of the day and the night was long " * 5
    rows = [(k, f"the project Zanzibarque of {far} ann@corp.example and the Zanzibarque rest") for k in range(4)] + [(10 + k, far) for k in range(20)] + [(50, "the single Qwertzuiop bob@corp.example of the")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest_columns(pii.find_private(docs_of(rows))).collect()}
    t = rows[0][1]
    at, again = t.index("Zanzibarque"), t.rindex("Zanzibarque")
    assert f"term:{at}:{at + 11}" in got[0] and f"term:{again}:{again + 11}" in got[0]
    assert "the" not in [t[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[0].split(",")) if _ == "term"]
    assert got[10] == ""
    assert "term" not in got[50]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_of(rows)).collect()}
    assert "[EMAIL]" in clean[0]
    assert "Zanzibarque" not in clean[0]
    assert clean[10] == rows[4][1]


def brute_disclosing(rows, disclosure=pii.DISCLOSURE):
    """(row, start, end, general) of disclosing words, from sets of documents."""
    has, where, places = {}, {}, []
    for k, (_, t) in enumerate(rows):
        t = t or ""
        taken = [(a, b) for _, a, b in base_spans(t)]
        for kind, a, b in base_spans(t):
            has.setdefault((kind, re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower()), set()).add(k)
        for m in re.finditer(r"[^\W\d_]{3,}", t):
            where.setdefault(m[0].lower(), set()).add(k)
            if taken and not any(a < m.end() and m.start() < b for a, b in taken):
                places.append((k, m.start(), m.end(), m[0].lower()))
    n, out = len(rows), set()
    top = {}
    for w, d in where.items():
        top[w[:3]] = max(top.get(w[:3], 0), len(d))
    for k, a, b, w in places:
        by = []
        for held in has.values():
            if k in held and len(held) > 1 and len(held & where[w]) > 1 and len(held) < n:
                p = (len(held) - 1) / (n - 1)
                if 1 - math.log((len(held & where[w]) - 1) / (len(where[w]) - 1 + pii.PRIOR)) / math.log(p) >= disclosure:
                    by.append(1 - pii.PRIOR + (len(held) - 1) * p ** (disclosure - 1))
        if by:
            out.add((k, a, b, w[:3] + "*" if top[w[:3]] > max(by) else None))
    return out


def test_disclosure_against_brute_force(spark, docs_of):
    rng = random.Random(33)
    vocab = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 5))) for _ in range(300)]
    known = ["ann@corp.example", "Bob@corp.example", "10.1.2.3", "+49 30 1234567", "4111 1111 1111 1111", "cy@corp.example"]
    secret = {x: [pre + "".join(rng.choice("vwxyz") for _ in range(6)) for pre in ("", "", "com")] for x in known}
    rows = []
    for k in range(160):
        words = ["common", *[rng.choice(vocab) for _ in range(rng.randint(0, 60))]]
        for x in rng.sample(known, rng.choice([0, 0, 0, 1, 1, 2])):
            words += [x, *rng.sample(secret[x], rng.randint(0, 3)), x.upper() if k % 5 == 0 and "@" in x else x]
        rng.shuffle(words)
        rows.append((k, rng.choice([" ", ", ", " é "]).join(words)))
    rows += [(200 + k, "a group of copies writes to dan@corp.example on grounds of quuxery") for k in range(90)] + [(500, None), (501, "")]
    want = brute_disclosing(rows)
    assert any(g for *_, g in want) and any(g is None for *_, g in want)
    got = {(r["doc_id"], x["start"], x["end"], x["general"]) for r in pii.find_private(docs_of(rows)).collect() for x in r["terms"]}
    assert got == {(rows[k][0], a, b, g) for k, a, b, g in want}


def test_many_mentions_in_one_text(spark, docs_of):
    text = " ".join(f"user{k}@host{k % 7}.example wrote lines" for k in range(30000))
    began = time.monotonic()
    got = {r["doc_id"]: r for r in pii.digest_columns(pii.find_private(docs_of([(1, text), (2, text), (3, "plain")]))).collect()}
    assert time.monotonic() - began < 90
    assert (got[1]["n_email"], got[2]["n_email"], got[3]["n_email"]) == (30000, 30000, 0)
    want = ",".join(f"{a}:{b}:{c}" for a, b, c in base_spans(text))
    assert got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def brute_lines(rows):
    """What recurs, by the contract: lines, less numbers and case, of three different texts (of eight, for lines of less than four words); all but the first document lose them."""
    held = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            masked = re.sub(r"\s+", " ", re.sub(r"[0-9][^\s]*", "<*>", line.lower())).strip(" ")
            if masked:
                held.setdefault(masked, []).append((d, t, k))
    drops = {}
    for line, xs in held.items():
        if len({t for _, t, _ in xs}) >= (3 if line.count(" ") >= 3 else 8):
            first = min(d for d, _, _ in xs)
            for d, t, k in xs:
                if d != first:
                    drops.setdefault((d, t), set()).add(k)
    return drops


def test_exact_lines_against_brute_force(spark, docs_of):
    rng = random.Random(10)
    vocab = [f"v{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    common = [line(5), line(6), "All rights reserved 2021", "x y", ""]
    rows = []
    for k in range(60):
        own = [line(rng.choice([2, 5, 6])) for _ in range(rng.randint(1, 5))] + rng.sample(common, rng.randint(0, 3))
        rng.shuffle(own)
        rows.append((k, "\n".join(own)))
    rows += [(100 + k, rows[0][1]) for k in range(5)] + [(200, None), (201, ""), (202, "\n\n"), (7, rows[7][1])]
    got = line_templates.drop_recurring_lines(docs_of(rows)).collect()
    drops = brute_lines(rows)
    assert drops
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r["doc_id"]]
        if t is None:
            assert r["text"] is None
            continue
        gone = drops.get((r["doc_id"], t), set())
        assert r["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), (r["doc_id"], gone)
        assert (r["n_lines"], r["n_dropped"], r["value"]) == (t.count("\n") + 1, len(gone), "x")


def test_variable_fields_and_long_passages(spark, docs_of):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    varied = lambda: f"this page was last edited by {word()} on the server of ours"
    rows = [(k, "\n".join([" ".join(word() for _ in range(12)), passage, varied(), " ".join(word() for _ in range(12))])) for k in range(12)]
    rows += [(50 + k, "\n".join(" ".join(word() for _ in range(10)) for _ in range(4))) for k in range(10)]
    whole = "\n".join(" ".join(word() for _ in range(10)) for _ in range(4))
    rows += [(80 + k, whole) for k in range(20)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs_of(rows)).collect()}
    assert got[0]["n_dropped"] == 0
    for k in range(1, 12):
        assert got[k]["n_dropped"] == 2
        assert passage not in got[k]["text"]
    for k in [*range(50, 60), *range(80, 100)]:
        assert got[k]["n_dropped"] == 0
    assert line_templates.drop_recurring_lines(docs_of([])).count() == 0


def test_passages_of_unrelated_documents(spark, docs_of):
    rng = random.Random(21)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    one, several, vetoed = [line(60)], [line(10) for _ in range(6)], [line(9)]
    rows = [(k, "\n\n".join([line(30) for _ in range(k % 3 + 1)] + (one if k < 300 else several))) for k in range(600)]
    rows += [(1000 + k, "\n".join([line(20), *vetoed])) for k in range(5)]
    whole = [line(10) for _ in range(20)]
    edited = lambda at: [line(10) if k == at else x for k, x in enumerate(whole)]
    rows += [(2000 + k, "\n".join([*edited(k % 20), *vetoed])) for k in range(200)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs_of(rows)).collect()}
    assert [got[k]["n_dropped"] for k in (0, 300, 1000)] == [0, 0, 0]
    assert all(got[k]["n_dropped"] == 1 for k in [*range(1, 300), *range(1001, 1005), *range(2000, 2200)])
    assert all(got[k]["n_dropped"] == 6 for k in range(301, 600))


def test_planted_boilerplate_and_copies(spark, docs_of):
    """By seed, 200 documents with four own lines and ten that all share, and a group of copies: all shared lines go but for the first document's, own ones and copies' stay."""
    rows, seeds = [], range(20)
    for seed in seeds:
        rng = random.Random(1000 + seed)
        line = lambda n, rng=rng, seed=seed: " ".join(f"s{chr(97 + seed)}" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
        shared = [line(9) for _ in range(10 if seed % 4 else 2)]
        for k in range(200):
            lines = [(True, x) for x in shared] + [(False, line(9)) for _ in range(4)]
            rng.shuffle(lines)
            rows.append((seed * 1000 + k, ("\n" if k % 2 else "\n\n").join(x for _, x in lines)))
        whole = "\n".join(line(9) for _ in range(12))
        rows += [(seed * 1000 + 500 + k, whole) for k in range(60)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring_lines(docs_of(rows)).collect()}
    for seed in seeds:
        n = 10 if seed % 4 else 2
        assert [got[seed * 1000 + k] for k in range(200)] == [0] + [n] * 199, seed
        assert {got[seed * 1000 + 500 + k] for k in range(60)} == {0}


def syllables(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(12)
    kinds = {"aa": ["th", "er", "ing"], "bb": ["eau", "que", "é"], "cc": ["schw", "ung", "ß"]}
    rows = [(k, syllables(rng, kinds[lang], rng.randint(30, 120)), lang) for k, lang in enumerate(list(kinds) * 60)]
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None), (None, syllables(rng, kinds["bb"], 50), None), (903, syllables(rng, kinds["cc"], 9000).upper(), None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in language.identify(docs, F.pmod(F.col("doc_id"), F.lit(3)) != 5).collect()}
    assert len(got) == len(rows)
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows[:180]) >= 178
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    assert (got[None]["lang_pred"], got[903]["lang_pred"]) == ("bb", "cc")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    alone = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in alone} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_kernel_values(monkeypatch):
    texts = ["abcd", "abce", "zz"]
    grams = lambda t: {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}
    for stretch in (language.DENSE, 6):
        monkeypatch.setattr(language, "DENSE", stretch)
        kernel = language.Kernel([np.unique(language.gram_buckets(t)) for t in texts])
        k, among = kernel.rows(texts), kernel.among()
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                want = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
                assert (k[i, j], among[i, j]) == pytest.approx((want, want), abs=1e-5)


def test_ridge_regression_on_all_landmarks():
    """With every training text a landmark, the Nystroem form is the kernel's own ridge regression."""
    rng = random.Random(30)
    texts = [syllables(rng, parts, 12) for parts in (["th", "er", "ing"], ["eau", "que", "lle"]) for _ in range(10)]
    kernel = language.Kernel([np.unique(language.gram_buckets(t)) for t in texts])
    k = kernel.rows(texts).astype(float)
    y = np.repeat([1.0, -1.0], 10)
    f = k @ language.nystroem(kernel.among())
    primal = f @ np.linalg.solve(f.T @ f + np.eye(f.shape[1]), f.T @ y)
    assert primal == pytest.approx(k @ np.linalg.solve(k + np.eye(20), y), abs=1e-3)


@pytest.mark.parametrize(("n_langs", "words"), [(2, 1200), (70, 30)])
def test_languages_of_long_texts_and_many_languages(spark, n_langs, words):
    rng = random.Random(32)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {f"l{k:02d}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(6)] for k in range(n_langs)}
    rows = [(k, syllables(rng, kinds[lang], words), lang) for k, lang in enumerate(list(kinds) * (30 if n_langs == 2 else 8))]
    rows += [(5000 + k, rows[0][1], "l00") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert n_langs == 70 or min(len(t) for _, t, _ in rows) > language.USUAL[1]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert sum(got[k] == lang for k, _, lang in rows) >= 0.98 * len(rows)


def toxic_rows(rng, n=400):
    parts = ["ka", "lo", "mi", "ru", "te", "so"]
    rows, marks = [], []
    for k in range(n):
        words = syllables(rng, parts, rng.randint(20, 80)).split(" ")
        bad = k % 4 == 0
        for _ in range(4 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilebad", "uglyword", "nasty"]) if k % 8 else "vileb" + rng.choice(parts)
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    return rows, marks


def test_toxicity(spark, docs_of):
    rows, marks = toxic_rows(random.Random(13))
    extra = [(900, None), (901, ""), (902, "..."), (None, "uglyword " * 3), (903, "ka lo mi " * 8000)]
    labels = spark.createDataFrame([(*m, 0) for m in marks] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, score int")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    docs = docs_of(rows + extra)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, learn).collect()}
    assert len(got) == len(rows) + len(extra)
    wrong = [k for k, y in marks if got[k]["predicted"] != y]
    assert len(wrong) <= 8, wrong
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[903]["predicted"] == 0
    kept = toxicity.reject_toxic(docs, labels, learn)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["predicted"]}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs_of(rows[:5]), none).count() == 5
    assert toxicity.score(docs_of([]), none).count() == 0


def test_toxicity_counts_every_word(spark, docs_of):
    rows, marks = toxic_rows(random.Random(14), 60)
    rows = [(k, f"{t} once{k}") for k, t in rows] + [(500, "other words"), (501, "other other"), (502, None)]
    docs = docs_of(rows)
    h = lambda w: xxhash.xxh64_intdigest(w)
    counts = {r["w"] % (1 << 64): r["n"] for r in toxicity.document_counts(docs).collect()}
    texts = [set((t or "").split()) for _, t in rows]
    assert counts == {h(w): sum(w in t for t in texts) for w in set().union(*texts)}
    label = dict(marks)
    train = spark.createDataFrame([(label[k], t) for k, t in rows if k in label], "toxic int, text string")
    model = toxicity.fit_model(docs, train)
    known = [t.split() for k, t in rows if k in label]
    assert set(model.words.tolist()) == {h(w) for t in known for w in t} | {int(toxicity._START)}
    assert len(model.second) == model.first[-1] == len({p for t in known for p in zip([None, *t], t)})
    p = dict(zip(model.words.tolist(), model.p_word.T))
    assert p[h("once0")][1] > p[h("once0")][0] and p[h("once1")][0] > p[h("once1")][1]
    # The model's words and the rest of the corpus share all of each class's probability.
    shared = sum(n + 1 for n in counts.values())
    rest = sum((counts[h(w)] + 1) / shared * model.p_none for w in ("other", "words"))
    assert (model.p_word.sum(1) + rest).tolist() == pytest.approx([1, 1], abs=1e-4)


def brute_evidence(train, corpus):
    """The Kneser-Ney models with dictionaries: a function that gives a text's evidence by word."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    d, cut = toxicity.DISCOUNT, toxicity.PREFIX
    docs = collections.Counter(w for t in corpus for w in set(split(t)))
    of_prefix = collections.Counter()
    for w, n in docs.items():
        of_prefix[w[:cut]] += n + 1
    every = sum(of_prefix.values())
    def off(counts):
        """The three discounts of modified Kneser-Ney, as a function of a count."""
        of = collections.Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        by = [min(k, max(d, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] else d for k in (1, 2)]
        more = sum(n for k, n in of.items() if k == 3)
        by.append(min(3, max(d, 3 - 4 * y * of[4] / more)) if more else d)
        return lambda n: 0 if n == 0 else by[min(n, 3) - 1]

    models = []
    for c in (0, 1):
        pairs = collections.Counter(p for y, t in train if y == c for p in zip([None, *split(t)], split(t)))
        contexts, seen, left = (collections.Counter() for _ in range(3))
        cut_off = off(pairs)
        for (h, w), n in pairs.items():
            contexts[w] += 1
            seen[h] += n
            left[h] += cut_off(n)
        by_prefix = collections.Counter(w[:cut] for w in contexts)
        models.append((pairs, contexts, seen, left, by_prefix, cut_off, off(contexts), off(by_prefix)))
    known = {w for m in models for w in m[1]}

    def lowest(w, m):
        _, contexts, _, _, by_prefix, _, off_word, off_prefix = m
        n, words = sum(contexts.values()), sum(by_prefix.values())
        spread = sum(off_word(x) for x in contexts.values()) / n if n else 1
        spare = sum(off_prefix(x) for x in by_prefix.values()) / words if words else 1
        q = w[:cut]
        if not any(x[:cut] == q for x in known):
            return spread * spare
        p_prefix = ((by_prefix[q] - off_prefix(by_prefix[q])) / words if words else 0) + spare * of_prefix[q] / every
        if w not in known:
            return spread * p_prefix
        return ((contexts[w] - off_word(contexts[w])) / n if n else 0) + spread * p_prefix * (docs[w] + 1) / of_prefix[q]

    def evidence(text):
        out, alone, before = [], [], None
        for w in split(text):
            p = []
            for m in models:
                pairs, _, seen, left, _, cut_off, _, _ = m
                low = lowest(w, m)
                n = pairs[before, w]
                p += [low, (n - cut_off(n)) / seen[before] + left[before] / seen[before] * low if seen[before] else low]
            alone.append(math.log(p[2]) - math.log(p[0]))
            out.append(math.log(p[3]) - math.log(p[1]))
            before = w
        return out, alone

    return evidence


def test_toxicity_against_brute_force(spark, docs_of, monkeypatch):
    """Evidence word by word, with the driver's stretches at one pair in ten; broadcast and back."""
    monkeypatch.setattr(toxicity, "STRETCH", 40)
    rng = random.Random(34)
    rows, marks = toxic_rows(rng, 40)
    rows += [(500, "vilebadder other words mimikaka"), (501, "zzz zzzz kalo"), (502, None)]
    label = dict(marks)
    train = [(label[k], t) for k, t in rows if k in label]
    model = toxicity.fit_model(docs_of(rows), spark.createDataFrame(train, "toxic int, text string"))
    model = pickle.loads(pickle.dumps(model))
    evidence = brute_evidence(train, [t for _, t in rows])
    texts = [rows[0][1], rows[1][1], "vilebadder zzz nowhere uglyword ka", "", None, rows[0][1].upper() + "!!"]
    tokens = toxicity.Tokens(pa.array(texts, pa.string()))
    for k, got in enumerate(model.evidence(tokens)):
        assert got.tolist() == pytest.approx([x for t in texts for x in evidence(t)[k]], abs=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Big &amp; small</h1></header><p>One<br>two&nbsp;&#233; <b>three</p><p>Four  \n five<p>Six <script>x</script>seven<ul><li>a<li>b</ul><aside>Side</aside><form><input value=1>Send</form>
<table><tr><td>c</td><td>d</td></tr></table><div class="comments"><p>Nice!</p></div></article><footer>&copy; me</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "Big & small\nOne two é three\nFour five\nSix seven\na\nb\nc d"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<p>a<p>b < c</p></i>d") == "a\nb < c\nd"
    assert html_text.main_text("<div><p>unclosed <a href='x") == "unclosed <a href='x"
    assert html_text.main_text("<div>" * 30000 + "deep" + "</div>" * 30000) == "deep"
    assert html_text.main_text("<b>" * 30000 + "deep" + "</i><p>" * 3000 + "x") == "deep\nx"
    assert html_text.main_text("<p>" + "long " * 100000) == ("long " * 100000).strip()
    assert html_text.main_text("<script>never closed <p>x") == ""
    assert html_text.main_text('<body><div id="sidebar">s</div><main><p>m</p></main></body>') == "m"


def test_names_of_article_parts_are_not_noise():
    """Names are whole: a part of one that is a noise word says nothing; headings, inline text, labels and buttons in prose stay."""
    html = """<article><h2 id="related-work">Related work</h2><section id="search-results"><p>Found it.</p></section><p class="skip-indent">Indented.</p>
<p>A <span class="hidden-markov">hidden Markov</span> model, <label>label</label> and <button>button</button>.</p><p hidden>unseen</p><div class="left-sidebar ads">no</div><p class="ad">no</p><button>no</button></article>"""
    assert html_text.main_text(html) == "Related work\nFound it.\nIndented.\nA hidden Markov model, label and button."
    assert html_text.main_text("<article><p>part one, the long one</p></article><p>x</p><article><p>part two</p></article>") == "part one, the long one\npart two"
    assert html_text.main_text('<article><p>all of it</p></article><article><a href="/1">A teaser of another page</a></article>') == "all of it"
    assert html_text.main_text('<header class="site-header">s</header><div class="site-header">t</div><div id="main-content"><p>m</p></div><p>n</p>') == "m"


def test_subtree_counts_against_brute_force(spark):
    rng = random.Random(31)
    boxes = [f'<div class="b{k}"><p>box number {k}</p></div>' for k in range(12)] + [f"<p>one of the lines on many pages {k}</p>" for k in range(6)]
    rows = []
    for k in range(150):
        parts = rng.sample(boxes, rng.randint(0, 6)) + [f"<p>the own text of page {k % 140} is this</p>"]
        rows.append((k, f"http://h{k % 4 if k % 3 else 0}.example/{k}", "<body>" + "".join(parts) + "</body>"))
    rows += [(200 + k, *rows[k][1:]) for k in range(20)] + [rows[3], (300, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = {}
    for _, url, html in rows:
        for m in html_text.subtree_hashes(html):
            on.setdefault((url and url.split("/")[2], m), set()).add(html)
    want = {(url, html): {m for m in html_text.subtree_hashes(html) if len(on[url and url.split("/")[2], m]) >= 5} for _, url, html in rows}
    keyed = html_text._source(pages).join(html_text.recurring_subtrees(pages), "page_key", "left").collect()
    assert len(keyed) == len(rows)
    assert any(want.values())
    for r in keyed:
        assert set(r["marks"] or ()) == want[r["url"], r["html"]]


def test_site_templates(spark):
    """A box on five pages of a host goes, however many pages there are; on few pages of another host it stays; articles' paragraphs and copies of pages stay."""
    box, line = '<div class="box"><p>Join our club today</p></div>', "<p>This line stands on every page of ours.</p>"
    rows = [(k, f"http://a.example/p{k}", f"<body>{box if k < 6 else ''}{line}<p>Story {k}</p><p>Same line.</p></body>", 1) for k in range(60)]
    rows += [(100 + k, "https://u@B.example:80/x", f"<body>{box if k < 2 else ''}<p>Other {k}</p></body>", 1) for k in range(12)]
    rows += [(200 + k, "http://c.example/", f"<body>{box}<p>copy</p></body>", 1) for k in range(9)] + [(300, None, None, 1), (None, "", "<p>x</p>", 1), (0, rows[0][1], rows[0][2], 1)]
    rows += [(400 + k, "http://d.example/", f"<nav>{k}</nav><article><p>An article that many pages have, in full.</p></article>", 1) for k in range(9)]
    rows += [(500 + k, "http://e.example/", f"<nav>{k}</nav><div><p>Text that many pages have, in full.</p></div>", 1) for k in range(9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[3] == "Story 3\nSame line."
    assert by[100] == "Join our club today\nOther 0"
    assert by[200] == "Join our club today\ncopy"
    assert (by[300], by[None]) == ("", "x")
    assert by[400] == "An article that many pages have, in full."
    assert by[500] == "Text that many pages have, in full."
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_members(zip64):
    body = warc_zip.zip_stored([("a", b"hello"), ("dir/é", b""), ("b", b"PK\x05\x06" * 9)], zip64)
    z = zipfile.ZipFile(io.BytesIO(body))
    assert z.testzip() is None
    found = warc_zip.zip_members(io.BytesIO(body), len(body))
    assert {k: body[a : a + n] for k, (a, n, _) in found.items()} == {n: z.read(n) for n in z.namelist()}
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as w:
        w.comment = b"note PK\x05\x06 end"
        with w.open("big", "w", force_zip64=True) as f:
            f.write(b"x" * 10)
    raw = other.getvalue()
    at, n, _ = warc_zip.zip_members(io.BytesIO(raw), len(raw))["big"]
    assert raw[at : at + n] == b"x" * 10
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.zip_members(io.BytesIO(b"nothing"), 7)


def test_archive_round_trip(spark):
    long = "é" * 80
    rows = [(5, "http://x/1", long), (3, "http://x/2 3\n", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "n", long), (3, "again", long), (7, "u", "z" * 50000 + "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, path int")
    archives = warc_zip.write_archives(pages, archive_bytes=300)
    assert archives.count() > 1
    got = warc_zip.read_records(archives).collect()
    assert len(got) == len(rows)
    for i, u, t in rows:
        raw = (t or "").encode()
        mine = [r for r in got if r["page_id"] == i]
        for r in mine:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
            revisit = t == long and i != 3
            assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
            assert revisit or bytes(r["payload"]) == raw
        assert len(mine) == (2 if i == 3 else 1), u
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.read_records(warc_zip.write_archives(none)).count() == 0
