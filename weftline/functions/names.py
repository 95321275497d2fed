"""Stream names: categories, coercion, composed keys, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_name(name: Column, default: str) -> Column:
    """A name without a dash gets the default category."""
    return F.when(F.instr(name, "-") == 0, F.concat(F.lit(f"{default}-"), name)).otherwise(name)


def category(name: Column) -> Column:
    """Text before the first dash; of a name that begins with one, the name without it."""
    return F.when(name.startswith("-"), name.substr(F.lit(2), F.length(name))).otherwise(F.split_part(name, F.lit("-"), F.lit(1)))


def legacy_category(name: Column) -> Column:
    """The first non-empty token between dashes."""
    return F.regexp_extract(name, "^-*([^-]*)", 1)


def message_stream(key: Column, default: str) -> Column:
    """A message's key as a stream name; without key the default category with an empty id."""
    return F.coalesce(stream_name(key, default), F.lit(f"{default}-"))


def composed_id(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def id_parts(name: Column) -> Column:
    """The parts of a composed stream id: what is behind the first dash, cut at _."""
    return F.split(F.regexp_extract(name, "^[^-]*-(.*)$", 1), "_")


def series_key(source: Column, tranche: Column) -> Column:
    """Checkpoint series: the source, or source_tranche where there is one."""
    return F.concat_ws("_", source, F.nullif(tranche, F.lit("")))


def span_label(event_type: Column, n: Column) -> Column:
    """:type, or :type+n for more than one event."""
    return F.concat(F.lit(":"), event_type, F.when(n > 1, F.concat(F.lit("+"), (n - 1).cast("string"))).otherwise(F.lit("")))
