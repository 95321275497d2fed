"""Stream and event filters: allow and deny lists of exact names and patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import category


def any_of(name: Column, tokens: Iterable[str]) -> Column:
    """Tokens of letters, digits and _ (or nothing) match exactly, all others as unanchored patterns."""
    plain = [t for t in tokens if re.fullmatch(r"\w*", t)]
    tests = ([name.isin(plain)] if plain else []) + [name.rlike(t) for t in tokens if t not in plain]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def allowed(name: Column, allow: Iterable[str] = (), deny: Iterable[str] = ()) -> Column:
    """Deny wins; an empty allow list allows all."""
    allow, deny = list(allow), list(deny)
    passes = any_of(name, allow) if allow else F.lit(True)
    return passes & ~any_of(name, deny) if deny else passes


def stream_filter(name: Column, allow_categories=(), deny_categories=(), allow_streams=(), deny_streams=(), include_system: bool = False) -> Column:
    out = allowed(category(name), allow_categories, deny_categories) & allowed(name, allow_streams, deny_streams)
    return out if include_system else out & ~name.startswith("$")


def event_filter(event_type: Column, allow=(), deny=()) -> Column:
    return allowed(event_type, allow, deny)


def category_prefix(name: Column, categories: Iterable[str] | None, predicate: Column | None = None) -> Column:
    """Names that start with any of the texts (all, without any), and the predicate."""
    tests = [name.startswith(c) for c in categories or ()]
    out = reduce(Column.__or__, tests) if tests else F.lit(True)
    return out if predicate is None else out & predicate
