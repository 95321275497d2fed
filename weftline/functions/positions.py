"""Positions, checkpoints, sizes and times as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions of other readers depend on them.
EPOCH_SLOTS, CHUNK_BITS, TIME_SLOTS = 1_000_000, 28, 1_000_000_000
EVENT_OVERHEAD, MESSAGE_OVERHEAD = 80, 16


def epoch_position(epoch: Column, offset: Column, closed: Column | None = None) -> Column:
    """Index position of an epoch's offset; a closed epoch's end is the next epoch's begin."""
    here = epoch.cast("long") * EPOCH_SLOTS + offset
    return here if closed is None else F.when(closed, (epoch.cast("long") + 1) * EPOCH_SLOTS).otherwise(here)


def position_epoch(position: Column) -> tuple[Column, Column]:
    return F.floor(position / EPOCH_SLOTS).cast("long"), position % EPOCH_SLOTS


def time_position(ts: Column, ordinal: Column) -> Column:
    """Position of the ordinal-th item of a crawl that began at ts."""
    return F.unix_seconds(ts) * TIME_SLOTS + ordinal


def position_time(position: Column) -> tuple[Column, Column]:
    """(seconds, ordinal); null for 0, the initial position."""
    some = F.when(position != 0, position)
    return F.floor(some / TIME_SLOTS).cast("long"), some % TIME_SLOTS


def chunk(position: Column) -> Column:
    return F.shiftrightunsigned(position, CHUNK_BITS)


def chunk_base(number: Column) -> Column:
    return F.shiftleft(number, CHUNK_BITS)


def next_chunk(position: Column) -> Column:
    return chunk_base(chunk(position) + 1)


def percent_position(most: Column, percent: Column) -> Column:
    """Begin of the chunk at so many percent of the greatest position."""
    return chunk_base(chunk(F.floor(most * percent / 100).cast("long")))


def message_bytes(key: Column, value: Column) -> Column:
    return (MESSAGE_OVERHEAD + 2 * F.length(F.coalesce(key, F.lit(""))) + 2 * F.length(F.coalesce(value, F.lit("")))).cast("long")


def stored_size(data: Column, meta: Column) -> Column:
    return (F.octet_length(F.coalesce(data, F.lit(""))) + F.octet_length(F.coalesce(meta, F.lit("")))).cast("long")


def rendered_size(data: Column, meta: Column) -> Column:
    return stored_size(data, meta) + EVENT_OVERHEAD


def kib(size: Column) -> Column:
    return F.floor((size + 512) / 1024).cast("long")


def humanized(seconds: Column) -> Column:
    """d/h/m/s rendering: the two greatest units."""
    s = F.floor(seconds).cast("long")
    d, h, m = F.floor(s / 86400).cast("long"), F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), F.lpad(b.cast("string"), 2, "0"), F.lit(y))
    return F.when(s >= 86400, two(d, "d", h, "h")).when(s >= 3600, two(h, "h", m, "m")).when(s >= 60, two(m, "m", s % 60, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


def next_due(at: Column, freq_s: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(at) + freq_s)


def degraded(size: Column, least: int) -> Column:
    return F.greatest(F.lit(least), size - 128)
