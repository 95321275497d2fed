"""Line dedup by a log-template tree of fixed depth.

A line's path is its number of tokens and its leading tokens; numbers are masked as variable fields. At a
leaf a line stands for itself and for the templates that arise if one stretch of it (a quarter of its
tokens, not the leading ones) is variable. A template recurs if enough families of documents hold it. Lines are counted first. A
document's family with respect to a line is the smallest hash among its other lines that don't recur themselves, so documents that share
nothing but boilerplate, of one line or several, are different families. If nearly all of the rest recurs the document is a copy, and its family is the
smallest hash among the recurring ones: copies of one document are one family, and the few more that edits make of them don't count.

DataFrame functions only. Hashes of lines are counted; texts travel once, to meet the numbers of dropped lines.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_files, in_splits, need, stored

#: Leading tokens of a path; stretches that may be variable; tokens from which lines are generalised.
LEADING, STRETCHES, GENERAL_TOKENS = 3, 3, 8
#: Families from which a template recurs, for lines of SHORT tokens or more and for shorter ones.
FAMILIES, SHORT, SHORT_FAMILIES = 3, 4, 8
#: A document is a copy if less than one in so many tokens beside the line are of lines that don't recur.
COPY = 4
#: Bits of a line's key that hold its number of tokens.
TOKEN_BITS = (1 << 20) - 1


def _parsed(text: Column) -> Column:
    """Per line: n (tokens; 0 for a blank line), leaf, hash, general (templates with one variable stretch)."""
    masked = F.regexp_replace(F.lower(text), r"[0-9][^\s]*+", "<*>")
    tokens = F.transform(F.split(masked, "\n", -1), lambda x: F.split(F.trim(F.regexp_replace(x, r"\s++", " ")), " ", -1))

    def line(t: Column) -> Column:
        n = F.size(t)
        without = [F.xxhash64(
            F.lit(k), n, F.slice(t, 1, (n * k / 4).cast("int")), F.slice(t, (n * (k + 1) / 4).cast("int") + 1, n)
        ) for k in range(1, STRETCHES + 1)]
        return F.struct(
            F.when(F.element_at(t, 1) == "", 0).otherwise(n).alias("n"),
            F.xxhash64(n, F.slice(t, 1, LEADING)).alias("leaf"),
            F.xxhash64(t).alias("hash"),
            F.when(n >= GENERAL_TOKENS, F.array(*without)).alias("general"),
        )

    return F.transform(tokens, line)


def _key(hash_: Column, n: Column) -> Column:
    """A line's identity within its text: hash, and number of tokens in the low bits."""
    return hash_.bitwiseAND(F.lit(~TOKEN_BITS)).bitwiseOR(F.least(n, F.lit(TOKEN_BITS)).cast("long"))


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, p (array of n, leaf, hash, general by line)."""
    return need(docs, {"doc_id": "long", "text": "string"}).dropna(subset=["text"]).select(
        "doc_id", F.xxhash64("text").alias("text_key"), _parsed(F.col("text")).alias("p")
    )


def _lines(rows: DataFrame, *others: str) -> DataFrame:
    """doc_id, text_key, others, line (from 0), n, leaf, hash, general of every line that isn't blank."""
    return rows.select("doc_id", "text_key", *others, F.posexplode("p").alias("line", "x")).select("doc_id", "text_key", *others, "line", "x.*").where("n > 0")


def shared_lines(rows: DataFrame) -> DataFrame:
    """text_key, shared (array of hash, n): by text, its lines that FAMILIES texts or more hold."""
    once = _lines(rows).groupBy("hash", "text_key").agg(F.max("n").alias("n"))
    common = once.groupBy("hash").agg(F.count("*").alias("texts")).where(F.col("texts") >= FAMILIES).select("hash")
    return once.join(common, "hash", "left_semi").groupBy("text_key").agg(F.collect_list(F.struct("hash", "n")).alias("shared"))


def _kept(rows: DataFrame) -> DataFrame:
    """rows (parsed, shared) and rest: what a text's families need. keys of shared lines, smallest keys and tokens of own lines and of all."""
    tokens = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(TOKEN_BITS)))
    every = F.array_distinct(F.transform(F.filter("p", lambda x: x["n"] > 0), lambda x: _key(x["hash"], x["n"])))
    rows = rows.withColumn(
        "keys", F.coalesce(F.transform("shared", lambda x: _key(x["hash"], x["n"])), F.array().cast("array<long>"))
    ).withColumn("every", every)
    rows = rows.withColumn("own", F.array_except("every", "keys"))
    least = lambda c: F.slice(F.array_sort(c), 1, 2).alias(f"{c}_least")
    return rows.withColumn(
        "rest", F.struct("keys", least("own"), least("keys"), tokens(F.col("own")).alias("own_n"), tokens(F.col("every")).alias("n"))
    ).drop("keys", "every", "own")


def _family(held: DataFrame) -> DataFrame:
    """held (hash, n, rest) with copied and family instead of rest."""
    key, rest = _key(F.col("hash"), F.col("n")), F.col("rest")
    own_n = rest["own_n"] - F.when(F.array_contains(rest["keys"], key), 0).otherwise(key.bitwiseAND(F.lit(TOKEN_BITS)))
    other = lambda c: F.try_element_at(F.array_remove(rest[c], key), F.lit(1))
    held = held.withColumn("copied", own_n * COPY < rest["n"] - key.bitwiseAND(F.lit(TOKEN_BITS)))
    return held.withColumn("family", F.coalesce(F.when(F.col("copied"), other("keys_least")), other("own_least"), key)).drop("rest")


def _recurring(held: DataFrame, template: list[str]) -> DataFrame:
    """template columns, first (smallest doc_id that has it) of those held by enough families. held: template, n, family, copied, text_key, doc_id."""
    once = held.groupBy(*template, "family", "copied", "text_key").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    family = once.groupBy(*template, "family", "copied").agg(F.min("first").alias("first"), F.max("n").alias("n"), F.count("*").alias("texts"))
    side = lambda copied, c: F.sum(F.when(F.col("copied") == copied, F.col(c) if c else 1).otherwise(0))
    found = family.groupBy(*template).agg(
        F.min("first").alias("first"), F.max("n").alias("n"), side(False, None).alias("own"), side(True, None).alias("copies"),
        side(True, "texts").alias("texts")
    )
    # The smallest of a copy's lines is another one for one in COPY edited copies at most, the next for one in COPY of those, and so on.
    copies = F.when(F.col("texts") > 0, F.greatest(F.lit(1), F.col("copies") - F.floor(F.log(F.col("texts")) / F.log(F.lit(float(COPY)))))).otherwise(0)
    least = F.when(F.col("n") >= SHORT, FAMILIES).otherwise(SHORT_FAMILIES)
    return found.where(F.col("own") + copies >= least).select(*template, "first")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, drop (line numbers): lines of recurring templates, but for those in the template's first document."""
    rows = stored(in_splits(parsed(docs), docs), "lines")
    shared = stored(shared_lines(rows), "shared", few=2)
    # Only lines that enough texts hold can recur exactly.
    exact = _family(
        _kept(rows.join(shared, "text_key")).select("doc_id", "text_key", "rest", F.explode("shared").alias("x")).select("doc_id", "text_key", "rest", "x.*")
    )
    exact = stored(_recurring(exact, ["hash"]), "exact", few=32)
    flagged = _lines(rows).select("doc_id", "text_key", "line", "hash").join(exact, "hash").select("doc_id", "text_key", "line", "first")
    long = _lines(rows).where(F.col("general").isNotNull())
    # Leaves that can hold a generalised template: several lines and texts.
    leaf = long.groupBy("leaf").agg(
        F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.min("text_key").alias("tlo"), F.max("text_key").alias("thi")
    ).where("lo <> hi and tlo <> thi").select("leaf")
    leaf = stored(leaf, "leaves", few=32)
    # An inner join, before which families are computed: what they need is as long as the text and mustn't be shuffled by line.
    held = _family(_lines(_kept(rows.join(shared, "text_key", "left")), "rest").where(F.col("general").isNotNull())).join(leaf, "leaf")
    held = stored(held.select("doc_id", "text_key", "line", "n", "leaf", "family", "copied", F.explode("general").alias("template")), "general", few=2)
    wide = _recurring(held, ["leaf", "template"])
    flagged = reduce(DataFrame.unionByName, [flagged, held.join(wide, ["leaf", "template"]).select("doc_id", "text_key", "line", "first")])
    again = flagged.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("drop"))


def drop_recurring_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with text less its recurring lines, and columns n_lines and n_dropped (which replace any so named); one row per row, other columns as they are.

    A template's first document (smallest doc_id; null ids never come first while others hold it) keeps its lines. Null text stays null with no lines;
    a text without lines left is empty; blank lines stay; equal rows get equal results; very long texts and lines are read whole; an empty table gives no rows.
    """
    own = uuid.uuid4().hex
    d, k, drop = (f"{c}-{own}" for c in ("d", "k", "drop"))
    drops = recurring_lines(docs).select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("drop").alias(drop))
    key = F.col(f"`{k}`") == F.xxhash64("text")
    joined = docs.join(drops.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(f"`{d}`")) & key, "left")
    parts, gone = F.split("text", "\n", -1), F.col(f"`{drop}`")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    counts = {n_lines: F.coalesce(F.size(parts), F.lit(0)), n_dropped: F.coalesce(F.size(gone), F.lit(0))}
    text = F.when(gone.isNotNull(), left).otherwise(F.col("text"))
    return in_files(joined, 4).withColumns(counts | {"text": text}).drop(d, k, drop)
