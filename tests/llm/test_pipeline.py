"""The pipeline on the smallest tables, stage by stage against the operators and brute force."""

import corpus_pipeline
import pytest
from test_near_dup_index import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_columns(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    want, _ = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in want.items() if i == c}


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        n, hit, *_ = brute_hits(r["text"], items, {})
        assert (r["doc_id"] in kept) == (not (hit and 20 * hit >= n))


def test_lines_and_lengths(stages):
    before, after = stages["line_dedup"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert set(r["text"].split("\n")) <= set(old[r["doc_id"]].split("\n"))
        assert r["n_chars"] == len(r["text"])


def test_packing(stages):
    before, after = stages["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    fill = after.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 2048


CLASH = "doc_id long, text string, n_lines long, n_dropped string, drop int, d int, k int, row_key long, text_key string, items string, contaminated int, set_id int, component_id int, kept int, score double, toxic int, part int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_nulls_clashing_names_and_empty_tables(spark, name):
    """Rows with nulls, empty and very long texts, repeated rows; columns named like the operators' own, and none of n_chars; no rows at all."""
    rest = (7, "seven", 1, 2, 3, 4, "t", "i", 5, 6, 8, 9, 0.5, 1, 2)
    texts = [None, "", " \n", "word " * 40_000, "twice the same text of some words", "twice the same text of some words"]
    rows = [(k, t, *rest) for k, t in enumerate(texts)] + [(None, "an id of null with some words", *rest), (9, None, *[None] * 15), (3, texts[3], *rest)]
    docs = spark.createDataFrame(rows, CLASH)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    want = {tuple(map(str, r)) for r in docs.collect()}
    found = [tuple(map(str, r)) for r in got.collect()]
    assert set(found) <= want
    if name != "near_duplicates":
        assert len(found) == len(rows)
    else:
        assert sorted(x[0] for x in found) == sorted(str(r[0]) for r in rows if r[0] != 5)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 6), (1, None, 5)], "doc_id long, text string, piece int")
    assert corpus_pipeline.pack(spark, docs, SF).count() == 3
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
