"""Small helpers for composing Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable


def quote(value) -> str:
    """A Spark SQL literal for a Python str, bool, number or None."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return "'" + text.replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0") + "'"


def string_array(values: Iterable[str]) -> str:
    values = list(values)
    if not values:
        return "cast(array() AS array<string>)"
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def wide_class(chars: str) -> str:
    """The inside of a regex class of many wide characters.

    Java asks such a class one character after the other.  Behind nested
    ranges a character that is not in it is refused after a few comparisons.
    """
    found = sorted(set(chars))
    if len(found) <= 3:
        return "".join(found)
    half = len(found) // 2
    return f"[{found[0]}-{found[-1]}&&[{wide_class(found[:half])}][{wide_class(found[half:])}]]"


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` once and use it as ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def any_contains(text: str, terms: Iterable[str]) -> str:
    """True when ``text`` contains at least one of the (few, fixed) terms."""
    terms = list(terms)
    if not terms:
        return "false"
    return let("_any", text, f"exists({string_array(terms)}, _t -> contains(_any, _t))")


def which_contain(text: str, terms: Iterable[str]) -> str:
    """The terms found in ``text``, in list order."""
    return let("_which", text, f"filter({string_array(terms)}, _t -> contains(_which, _t))")


def prefix_sums(lengths: str) -> str:
    """Exclusive prefix sums of an int array, in two levels of 64.

    A plain fold that appends to an array copies it at every step; summing
    whole blocks first keeps long documents near linear.
    """
    block = 64
    inner = (
        f"element_at(_blk, cast(_i DIV {block} AS int) + 1)"
        f" + aggregate(slice(_len, cast(_i DIV {block} AS int) * {block} + 1, _i % {block}), 0, (_a, _x) -> _a + _x)"
    )
    blocks = (
        f"transform(sequence(0, cast((size(_len)) DIV {block} AS int)),"
        f" _b -> aggregate(slice(_len, 1, _b * {block}), 0, (_a, _x) -> _a + _x))"
    )
    body = let("_blk", blocks, f"transform(sequence(0, size(_len)), _i -> {inner})")
    return let("_len", lengths, body)


def prefix_max(values: str) -> str:
    """For each element of an int array the largest one before it (-1 for the first), in two levels of 64 like ``prefix_sums``."""
    block = 64
    inner = (
        f"aggregate(slice(_val, cast(_i DIV {block} AS int) * {block} + 1, _i % {block}),"
        f" element_at(_top, cast(_i DIV {block} AS int) + 1), (_a, _x) -> greatest(_a, _x))"
    )
    own = f"transform(sequence(0, cast((size(_val) - 1) DIV {block} AS int)), _b -> array_max(slice(_val, _b * {block} + 1, {block})))"
    tops = "transform(_own, (_x, _b) -> coalesce(array_max(slice(_own, 1, _b)), -1))"
    body = let("_own", own, let("_top", tops, f"transform(_val, (_v, _i) -> {inner})"))
    return let("_val", values, f"CASE WHEN size(_val) = 0 THEN cast(array() AS array<int>) ELSE {body} END")
