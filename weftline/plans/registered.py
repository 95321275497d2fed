"""Imports every module that registers queries."""

from . import q_feeds, q_index, q_spans, q_state, q_stream  # noqa: F401
