"""Feeds: JSON lines, periodic full crawls, paged feeds as a Python data source."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.codec import postgres_rows
from ..functions.names import category
from ..operators.spans import numbered
from ..streaming.run import CheckpointTable, scratch


def local_copy(spark: SparkSession, path: str) -> str:
    """The path, or, of an http(s) URL, that of a copy in the shared folder, so that executors needn't reach the server. The driver passes it on in pieces."""
    if not path.startswith(("http://", "https://")):
        return path
    at = f"{scratch(spark, 'download')}/{os.path.basename(urllib.parse.urlparse(path).path) or 'feed'}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        with urllib.request.urlopen(path) as response:  # noqa: S310 - the scheme is checked above
            while piece := response.read(1 << 20):
                out.write(bytearray(piece))
    finally:
        out.close()
    return at


def read_json_lines(spark: SparkSession, path: str, schema: str, skip: int = 0, truncate: int | None = None) -> DataFrame:
    """file, line (from 1; the checkpoint behind the item), item of the JSON lines of files, each numbered by itself. A URL is downloaded first.

    skip drops exactly so many lines of each file; truncate keeps so many behind them; comment lines (#) are left out but counted. A line's number is its place within
    its block of the file and the lines of the blocks before it: blocks are counted first, a row each.
    """
    raw = spark.read.text(local_copy(spark, path))
    lines = raw.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__k")
    )
    blocks = lines.groupBy("file", "__at").agg(F.count("*").alias("n"), F.min("__k").alias("__first"))
    earlier = F.sum("n").over(Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "__at", "__first", F.coalesce(earlier, F.lit(0)).alias("__before"))
    numbered = lines.join(blocks, ["file", "__at"]).withColumn("line", F.col("__before") + F.col("__k") - F.col("__first") + 1)
    kept = numbered.where(F.col("line") > skip)
    if truncate is not None:
        kept = kept.where(F.col("line") <= skip + truncate)
    return kept.where(~F.col("value").rlike(r"^\s*#")).select("file", "line", F.from_json("value", schema).alias("item"))


def crawl_indices(items: DataFrame, order: str, began_s: int, parts: int = 64) -> DataFrame:
    """index = seconds * 1e9 + ordinal, so that indices grow from crawl to crawl; held_back marks the last item, whose batch carries the new checkpoint.

    order: a numeric column, cut at quantiles into parts that are numbered apart.
    """
    cuts = sorted(set(items.approxQuantile(order, [k / parts for k in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x < F.col(order))) if cuts else F.lit(0)
    last = items.agg(F.max(order).alias("__last"))
    given = numbered(items, part, order).withColumn("index", F.lit(began_s).cast("long") * 1_000_000_000 + F.col("number")).drop("number")
    return given.join(F.broadcast(last)).withColumn("held_back", F.col(order) == F.col("__last")).drop("__last")


def recrawl(
    crawl: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], order: str, refresh_s: float, checkpoint: Callable[[int], None],
    times: int | None = None
) -> int:
    """A full crawl every refresh_s seconds; times: how often, else until an error. The position behind the last item.

    handle gets all items but the last, with the old checkpoint standing, then the last one; only then the new checkpoint, the index behind it, is written.
    """
    done, position = 0, 0
    while times is None or done < times:
        began = time.time()
        items = crawl_indices(crawl(), order, int(began))
        for batch, rows in enumerate((items.where("not held_back"), items.where("held_back"))):
            handle(rows.drop("held_back"), 2 * done + batch)
        if (last := items.agg(F.max("index")).first()[0]) is not None:
            position = last + 1
            checkpoint(position)
        done += 1
        if times is None or done < times:
            time.sleep(max(0.0, began + refresh_s - time.time()))
    return position


class Tranche(InputPartition):
    def __init__(self, name: str, begin: int, end: int):
        self.name, self.begin, self.end = name, begin, end


class PagedFeed(DataSource):
    """A feed with independently checkpointed tranches, read in pages.

    Subclasses give tranches() -> names, tail(tranche) -> position behind the last item, page(tranche, position, limit) -> items of (stream, index, event_type, data)
    and the next position. Batch reads go from the option `from` (JSON of tranche to position) to the tails; streams keep the same JSON as offset.
    Options: page_size; stripe, positions that one task reads (a tranche is cut into chunks that are read at once); least_page, to which a page's size is halved when
    reading fails, before the error counts; from_tail, to begin at the tails; data=false leaves bodies out.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "tranche string, stream string, index long, event_type string, data string, position long"

    def tranches(self) -> list[str]:
        raise NotImplementedError

    def tail(self, tranche: str) -> int:
        raise NotImplementedError

    def page(self, tranche: str, position: int, limit: int) -> tuple[list[tuple], int]:
        raise NotImplementedError

    def begin(self) -> dict[str, int]:
        given = json.loads(self.options.get("from", "{}"))
        from_tail = self.options.get("from_tail", "false").lower() == "true"
        return {t: given[t] if t in given else self.tail(t) if from_tail else 0 for t in self.tranches()}

    def stripes(self, tranche: str, begin: int, end: int) -> list[Tranche]:
        """The range in chunks that end at multiples of the stripe; one, without stripes."""
        width = int(self.options.get("stripe", "0"))
        if width <= 0 or end <= begin:
            return [Tranche(tranche, begin, end)]
        edges = [begin, *range(begin - begin % width + width, end, width), end]
        return [Tranche(tranche, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return _PagedStream(self)


def _read(feed: PagedFeed, part: Tranche) -> Iterator[tuple]:
    limit = int(feed.options.get("page_size", "500"))
    least = int(feed.options.get("least_page", str(limit)))
    body = feed.options.get("data", "true").lower() == "true"
    at = part.begin
    while at < part.end:
        try:
            items, after = feed.page(part.name, at, min(limit, part.end - at))
        except Exception:
            if limit <= least:
                raise
            limit = max(least, limit // 2)
            continue
        for k, (stream, index, event_type, data) in enumerate(items):
            yield part.name, stream, index, event_type, data if body else None, at + k + 1
        if after <= at:
            return
        at = after


class _PagedReader(DataSourceReader):
    def __init__(self, feed: PagedFeed):
        self.feed = feed

    def partitions(self):
        begin = self.feed.begin()
        return [x for t in self.feed.tranches() for x in self.feed.stripes(t, begin[t], self.feed.tail(t))]

    def read(self, partition: Tranche):
        return _read(self.feed, partition)


class _PagedStream(DataSourceStreamReader):
    def __init__(self, feed: PagedFeed):
        self.feed = feed

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return self.feed.begin()

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {t: self.feed.tail(t) for t in self.feed.tranches()}

    def partitions(self, start: dict, end: dict):
        return [x for t in sorted(end) for x in self.feed.stripes(t, start.get(t, 0), end[t])]

    def read(self, partition: Tranche):
        return _read(self.feed, partition)

    def commit(self, end: dict):
        pass


def paged(
    name: str, tranches: Callable[[], list[str]], tail: Callable[[str], int], page: Callable[[str, int, int], tuple[list[tuple], int]]
) -> type[PagedFeed]:
    """A data source class from three functions."""

    def named(cls) -> str:
        return name

    return type(
        name, (PagedFeed,),
        {"name": classmethod(named), "tranches": lambda self: tranches(), "tail": lambda self, t: tail(t), "page": lambda self, t, at, n: page(t, at, n)}
    )


def all_feed(name: str, tail: Callable[[], int], page: Callable[[int, int], tuple[list[tuple], int]]) -> type[PagedFeed]:
    """A store's feed of everything, which has one tranche, "0". Streams are filtered on what is read, by functions.filters."""
    return paged(name, lambda: ["0"], lambda _: tail(), lambda _, at, n: page(at, n))


def poll_categories(
    read: Callable[[str, int, int], DataFrame], categories: list[str], handle: Callable[[DataFrame, str], None], checkpoints: CheckpointTable,
    source: str = "categories", group: str = "default", page_size: int = 500, pages: int | None = None,
) -> dict[str, int]:
    """Read each category, a tranche each, page by page from its checkpoint until a page is empty; the positions. Checkpoint: last global position + 1.

    read gives a page: at most page_size rows of a category with position (global) at or behind the given one, in order. handle is called before the checkpoint is written,
    so that a page may be handled twice, but is never lost. pages: most pages of a category in this call.
    """
    at = {c: checkpoints.start(source, c, group) for c in categories}
    for c in categories:
        k = 0
        while pages is None or k < pages:
            page = read(c, at[c], page_size)
            last = page.agg(F.max("position")).first()[0]
            if last is None:
                break
            handle(page, c)
            at[c], k = last + 1, k + 1
            row = page.sparkSession.createDataFrame([(source, c, group, at[c])], "source string, tranche string, consumer_group string, position long")
            checkpoints.commit(row, at[c], "poll")
    return at


def jdbc_category(spark: SparkSession, options: dict[str, str], messages: str) -> Callable[[str, int, int], DataFrame]:
    """read for poll_categories from a database. messages: a query with {category}, {position} and {limit}, such as one that selects from a function of the database.

    Categories are names (letters, digits, _, :, +), so that they can't change the query. Rows as codec.postgres_rows wants them.
    """

    def read(category: str, position: int, limit: int) -> DataFrame:
        if not re.fullmatch(r"[\w:+]+", category):
            raise ValueError(f"not a category: {category!r}")
        query = messages.format(category=category, position=int(position), limit=int(limit))
        return postgres_rows(spark.read.format("jdbc").options(**options).option("query", query).load())

    return read


class MemoryStore:
    """A store for tests: what is committed to it is a feed, a batch per commit, numbered by epoch.

    Commits are small files in a folder, so that executors see them; source() is a stream that takes one at a time.
    """

    EVENT = "epoch long, stream string, index long, event_type string, data string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.epoch = spark, path, 0
        self.next: dict[str, int] = {}
        spark.createDataFrame([], self.EVENT).write.mode("append").parquet(path)

    def commit(self, stream: str, events: list[tuple[str, str | None]]) -> int:
        """Append (event_type, data) to a stream; the commit's epoch."""
        begin = self.next.get(stream, 0)
        rows = [(self.epoch, stream, begin + k, t, d) for k, (t, d) in enumerate(events)]
        self.spark.createDataFrame(rows, self.EVENT).coalesce(1).write.mode("append").parquet(self.path)
        self.next[stream] = begin + len(events)
        self.epoch += 1
        return self.epoch - 1

    def source(self, categories: list[str] | None = None) -> DataFrame:
        stream = self.spark.readStream.schema(self.EVENT).option("maxFilesPerTrigger", "1").parquet(self.path)
        return stream if categories is None else stream.where(category(F.col("stream")).isin(categories))
