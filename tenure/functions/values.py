"""Scalar clean-up rules: missing text, spelled booleans, numbers, logs, hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def true(condition: Column) -> Column:
    """Three-valued condition as a plain boolean: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parsed(document: Column) -> Column:
    """JSON text as a VARIANT, read once for all of its fields; text that is not JSON is NULL."""
    return F.try_parse_json(document)


def variant_text(document: Column, key: str) -> Column:
    """Text under ``key`` of a parsed document; a missing key or document, or a value that is no text or number, gives ''."""
    return F.coalesce(F.try_variant_get(document, f"$.{key}", "string"), F.lit(""))


def spelled_flag(text: Column, yes: str, no: str) -> Column:
    return F.when(text == yes, F.lit(True)).when(text == no, F.lit(False))


def grouped_number(text: Column) -> Column:
    """Number written with thousands separators; unreadable text becomes NULL."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def log_or_zero(x: Column) -> Column:
    return F.coalesce(F.ln(x), F.lit(0.0))


def digest(text: Column) -> Column:
    return F.sha1(text)


def _concat(parts: list[Column]) -> Column:
    return F.concat(*[p.cast("string") for p in parts])


def joined_text(*parts: Column) -> Column:
    """Concatenation that is NULL as soon as one part is NULL."""
    return _concat(list(parts))


# Stand for a missing key and for the border of two keys.
_MISSING, _BETWEEN = "\u0001", "\u001f"


def key_hash(*keys: Column, seed: int) -> Column:
    """MD5 (as hex) of a row key and a seed. A missing key is a value of its own."""
    parts = [F.coalesce(k.cast("string"), F.lit(_MISSING)) for k in keys]
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(_BETWEEN, *parts)))


def hash_of_text(text: str) -> str:
    """The hash of ``key_hash`` for a text that already holds seed and key."""
    return hashlib.md5(text.encode()).hexdigest()


def hash_uniform(*keys: Column, seed: int) -> Column:
    """Repeatable uniform number in [0, 1) for a row key; never NULL.

    Depends only on the key and the seed: the same row always lands on the same
    side of a split, whatever the partitioning, retries or file layout.
    """
    prefix = F.substring(key_hash(*keys, seed=seed), 1, 8)
    return F.conv(prefix, 16, 10).cast("double") / F.lit(4294967296.0)


def right_closed_bin(x: Column, cuts: Sequence[float]) -> Column:
    """Number of the interval (cuts[i], cuts[i+1]] holding ``x``; NULL outside.

    ``cuts`` is ascending. Plain comparisons, so the expression stays in generated code.
    """
    below = reduce(lambda a, b: a + b, [(x > c).cast("int") for c in cuts])
    return F.when((x > cuts[0]) & (x <= cuts[-1]), below)


def right_closed_bin_of(x: Column, cuts: Column) -> Column:
    """The same with the cut points in an array column, where they differ by row."""
    below = F.size(F.filter(cuts, lambda c: c < x))
    inside = (x > F.element_at(cuts, 1)) & (x <= F.element_at(cuts, -1))
    return F.when(inside, below)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, for comparing results across engines."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)
