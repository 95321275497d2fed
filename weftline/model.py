"""The event-stream data model: schemas of rows, spans, checkpoints and index spans."""

from __future__ import annotations

from pyspark.sql import types as T

STREAM_EVENT = "stream string, category string, index long, is_unfold boolean, event_type string, data string, meta string, event_id string, correlation_id string, causation_id string, ts timestamp, size int, source string, tranche string, position long, arrival long"
CHECKPOINT = "source string, tranche string, consumer_group string, position long, at timestamp, next_due timestamp, freq_s int"
INDEX_SPAN = "partition_id int, epoch_id int, seq int, kind string, p string, i long, c array<string>"

#: JSON of a span on the wire: s stream, i first index, e events of type c, time t, data d, metadata m.
RENDERED_SPAN = "s string, i long, e array<struct<c:string, t:string, d:string, m:string>>"
#: A change-feed document: p stream, i first and n next index, e events, u unfolds, _ts seconds.
DOCUMENT = "p string, i long, n long, e array<struct<c:string, t:string, d:string, m:string, correlationId:string, causationId:string>>, u array<struct<c:string, t:string, d:string, m:string>>, _ts double"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
