"""Personal data: patterns for identifiers, and information-theoretic sanitisation of the words of their documents.

An identifier's value is a protected entity c. A word t discloses the share  PMI(t; c) / IC(c)  of c's information, with probabilities from counts of
documents over the whole corpus: n_t that have the word, n_c that have the entity, n_tc that have both. What a document's words tell of its entities is
judged by the other documents: P(c|t) is (n_tc - 1) / (n_t - 1 + PRIOR), P(c) is (n_c - 1) / (N - 1), so that a pair seen in one document tells nothing.
Words above the threshold are marked wherever they stand in documents with the entity; they are generalised to their prefix if that is too
common to disclose the entity, else removed.

DataFrame functions only. A word can disclose an entity only if it isn't much commoner (at_most); all others leave before pairs are made. Entities of the
same documents are one class, as are words, so that copies and long lists don't multiply. Texts are not shuffled: what travel are identifiers, words of
documents with identifiers, and counts. Positions come from splitting a text by the pattern: the pieces' and matches' lengths add up (code points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_splits, join_counted, need, stored

#: kind -> (pattern, a character without which no match exists). The look-around and possessive forms match exactly what the plain
#: patterns do, leftmost and without overlap, but in linear time and without recursion.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "."),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERM = r"[\p{L}\p{M}]{3,}+"
#: Share of an entity's information that a word may disclose; documents without the entity that every word is taken to have besides its own.
DISCLOSURE, PRIOR = 0.9, 0.5
PREFIX = 3
#: Matches whose places are summed up at once.
BLOCK = 256


def _located(found: str, pieces: str, kind: str) -> Column:
    """Matches with their places. Lengths are summed up in blocks, so that the time is in proportion to the matches of one text."""
    item = f"named_struct('kind', '{kind}', 'start', s.at + length(b.p[i]), 'end', s.at + b.n[i], 'value', b.f[i])"
    steps = f"transform(sequence(0, size({found}) - 1), i -> length({pieces}[i]) + length({found}[i]))"
    sums = f"transform(sequence(0, (size(a.n) - 1) div {BLOCK}), k -> aggregate(slice(a.n, k * {BLOCK} + 1, {BLOCK}), 0, (s, x) -> s + x))"
    begins = f"aggregate({sums}, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))), s -> s.out)"
    block = f"aggregate(sequence(k * {BLOCK}, least(size(b.f), (k + 1) * {BLOCK}) - 1), named_struct('at', b.at[k], 'out', cast(array() as {SPAN})), (s, i) -> named_struct('at', s.at + b.n[i], 'out', concat(s.out, array({item}))), s -> s.out)"
    # Arrays of one element name what is computed once.
    one = f"transform(array(named_struct('f', {found}, 'p', {pieces}, 'n', {steps})), a -> named_struct('f', a.f, 'p', a.p, 'n', a.n, 'at', {begins}))"
    every = f"transform({one}, b -> flatten(transform(sequence(0, (size(b.f) - 1) div {BLOCK}), k -> {block})))[0]"
    return F.when(F.size(found) > 0, F.expr(every)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        back = F.reverse(digits)
        doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: back.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
        return total % 10 == 0
    return F.lit(True)


def _matches(df: DataFrame, text: str, pattern: str, guard: Column | None, name: str) -> DataFrame:
    have = F.lit(True) if guard is None else guard
    return df.withColumns({
        f"{name}_found": F.when(have, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
        f"{name}_pieces": F.when(have, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")),
    })


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text, spans: valid identifiers by kind as listed, then by start."""
    rows = need(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.xxhash64("text"))
    for kind, (pattern, guard) in PATTERNS.items():
        rows = _matches(rows, "text", pattern, F.col("text").contains(guard) if guard else None, kind)
    rows = rows.withColumns({k: _located(f"{k}_found", f"{k}_pieces", k) for k in PATTERNS})
    valid = [F.filter(k, (lambda kind: lambda x: _valid(kind, x["value"]))(k)) for k in PATTERNS]
    return rows.select("doc_id", "text_key", "text", F.concat(*valid).alias("spans"))


def entity(kind: Column, value: Column) -> Column:
    """An identity of the protected value, alike for different spellings."""
    return F.xxhash64(kind, F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def mentions(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, spans (kind, start, end, entity), words (w: the word's hash, q: its prefix, start, end; outside of identifiers, only for texts with any)."""
    found = base_spans(docs)
    rows = _matches(
        found, "text", f"{PATTERNS['email'][0]}|{TERM}", F.size("spans") > 0, "term"
    ).withColumn("term", _located("term_found", "term_pieces", "term"))
    word = lambda x: F.struct(F.xxhash64(F.lower(x["value"])).alias("w"), F.substring(F.lower(x["value"]), 1, PREFIX).alias("q"), x["start"], x["end"])
    words = F.transform(F.filter("term", lambda x: ~x["value"].contains("@")), word)
    spans = F.transform("spans", lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), entity(x["kind"], x["value"]).alias("entity")
    ))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", spans.alias("spans"), words.alias("words"))


def term_counts(docs: DataFrame) -> DataFrame:
    """w, q, n: every word's hash and prefix, and in how many documents it occurs."""
    distinct = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    words = need(docs, {"text": "string"}).select(F.explode(distinct).alias("term")).select(
        F.xxhash64("term").alias("w"), F.substring("term", 1, PREFIX).alias("q")
    )
    return words.groupBy("w", "q").agg(F.count("*").alias("n"))


def at_most(n_entity: Column, total: int, disclosure: float = DISCLOSURE) -> Column:
    """Documents up to which a word can disclose an entity of n_entity of all documents, even if all these have it."""
    others = n_entity - 1
    return 1 - PRIOR + others * F.pow(others / max(1, total - 1), F.lit(disclosure - 1))


def share(n_joint: Column, n_term: Column, n_entity: Column, total: int) -> Column:
    """PMI over IC, from document counts."""
    p = (n_entity - 1) / max(1, total - 1)
    return F.when((n_entity > 1) & (n_joint > 1) & (p < 1), 1 - F.log((n_joint - 1) / (n_term - 1 + PRIOR)) / F.log(p)).otherwise(0.0)


def disclosing_words(found: DataFrame, counts: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """row, w, general (the word's prefix and *, where that is too common to disclose, else null): the words to mark. found: mentions, stored; counts: term_counts, stored."""
    total = found.count()
    private = found.where(F.size("spans") > 0)
    has = private.select("row", F.explode(F.array_distinct(F.transform("spans", lambda x: x["entity"]))).alias("entity"))
    same = F.bit_xor(F.xxhash64("row"))
    entities = has.groupBy("entity").agg(F.count("*").alias("n_entity"), same.alias("same")).where("n_entity > 1")
    entities = stored(entities.select("entity", "n_entity", F.xxhash64("same", "n_entity").alias("ec")), "entities", few=8)
    held = stored(join_counted(has, entities, "entity", n="n_entity").select("row", "ec", "n_entity").distinct(), "held", few=8)
    widest = held.groupBy("row").agg(at_most(F.max("n_entity"), total, disclosure).alias("most"))
    words = private.select(
        "row", F.array_distinct(F.transform("words", lambda x: x["w"])).alias("words")
    ).join(widest, "row").select("row", "most", F.explode("words").alias("w"))
    # Words of one document don't tell, nor do words that are too common for all of a document's entities.
    near = stored(join_counted(words, counts.where("n > 1"), "w").where("n <= most").select("row", "w", "q", "n"), "near", few=8)
    classes = near.groupBy("w", "q", "n").agg(F.count("*").alias("m"), same.alias("same")).where("m > 1")
    prefixes = stored(counts.groupBy("q").agg(F.max("n").alias("top"), F.count("*").alias("of")), "prefixes", few=8)
    classes = join_counted(classes.select("w", "q", "n", "m", F.xxhash64("same", "m", "n").alias("tc")), prefixes, "q", n="of")
    classes = stored(classes.select("w", "q", "m", "tc", "top"), "classes", few=8)
    near = stored(join_counted(near.select("row", "w", "n"), classes, "w", n="m").select("row", "w", "q", "n", "tc", "top"), "near-classes", few=8)
    pairs = held.join(
        near.select("row", "tc", "n").distinct(), "row"
    ).where(F.col("n") <= at_most(F.col("n_entity"), total, disclosure)).select("row", "ec", "tc", "n_entity", "n")
    over = pairs.groupBy("ec", "tc", "n_entity", "n").agg(F.count("*").alias("n_joint"))
    over = stored(over.where(share(F.col("n_joint"), F.col("n"), F.col("n_entity"), total) >= disclosure).select("ec", "tc", "n_joint"), "over", few=8)
    marked = join_counted(
        pairs.select("row", "ec", "tc", "n_entity"), over, "ec", "tc", n="n_joint"
    ).groupBy("row", "tc").agg(F.max("n_entity").alias("n_entity"))
    general = F.when(F.col("top") > at_most(F.col("n_entity"), total, disclosure), F.concat("q", F.lit("*")))
    return near.join(marked, ["row", "tc"]).select("row", "w", general.alias("general"))


def find_private(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text_key, spans (kind, start, end by kind as listed), terms (start, end, general; by start), one row per row of docs.

    Null texts count as empty; null doc_ids stay; equal rows get equal results, and count as documents of their own; very long texts are read whole, in
    time that is in proportion to their length; an empty table gives no rows; other columns are ignored.
    """
    found = stored(in_splits(mentions(docs), docs), "mentions")
    flagged = stored(disclosing_words(found, stored(term_counts(docs), "counts", few=2), disclosure), "flagged", few=8)
    # Only rows with such words open their words again.
    rows = found.select("row", "words").join(flagged.select("row").distinct(), "row", "left_semi").select("row", F.explode("words").alias("x"))
    placed = rows.select("row", F.col("x.w").alias("w"), F.col("x.start").alias("start"), F.col("x.end").alias("end")).join(flagged, ["row", "w"])
    terms = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "general"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,general:string>>")
    spans = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("row", "doc_id", "text_key", spans.alias("spans")).join(terms, "row", "left").select(
        "doc_id", "text_key", "spans", F.coalesce("terms", none).alias("terms")
    )


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text with identifiers replaced by [KIND] and disclosing words by their prefix or nothing; null texts are empty."""
    private = find_private(docs, disclosure).dropDuplicates(["doc_id", "text_key"]).withColumnRenamed("doc_id", "d")
    rows = need(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.xxhash64("text"))
    both = rows.join(private, F.col("doc_id").eqNullSafe(F.col("d")) & (rows["text_key"] == private["text_key"]), "left")
    marks = F.array_sort(F.concat(
        F.transform("spans", lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("by")
        )),
        F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.coalesce(x["general"], F.lit("")).alias("by"))),
    ))
    both = both.select("doc_id", "text", marks.alias("marks"))
    fold = "aggregate(marks, named_struct('at', 0, 'out', ''), (s, m) -> if(m.start < s.at, named_struct('at', greatest(s.at, m.end), 'out', s.out), named_struct('at', m.end, 'out', concat(s.out, substring(text, s.at + 1, m.start - s.at), m.by))), s -> concat(s.out, substring(text, s.at + 1)))"
    return both.select("doc_id", F.expr(fold).alias("text"))


def digest_columns(private: DataFrame) -> DataFrame:
    """Counts by kind, base_sha256 and spans as text."""
    n = {f"n_{k}": F.size(F.filter("spans", (lambda kind: lambda x: x["kind"] == kind)(k))).cast("long") for k in PATTERNS}
    text = lambda x, kind: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.transform("spans", lambda x: text(x, x["kind"]))
    term = F.transform("terms", lambda x: text(x, F.lit("term")))
    return private.select(
        "doc_id", *[c.alias(k) for k, c in n.items()], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, term), ",").alias("spans")
    )
