"""Column helpers for text: trimming, alias lookup, templates."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# all characters that count as white space at the ends of a line
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode classes and '\\n' as the only line end."""
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_key(m: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that the map has."""
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])


def first_filled_key(m: Column, keys: Sequence[str]) -> Column:
    """Value of the first key whose value is not empty."""
    return F.coalesce(*[blank_to_null(F.try_element_at(m, F.lit(k))) for k in keys])


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True where the text holds one of the words, by one pass of an
    alternation of quoted literals."""
    return c.rlike("|".join(re.escape(w) for w in words))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once per row, however often and wherever
    later steps mention it: a generator of one row keeps the optimiser from
    copying the expression into filters."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def last_wins_map(entries: Column) -> Column:
    """Map from an array column of (key, value) structs in which a later entry
    replaces an earlier one with the same key.  Give it a computed column."""
    keys = entries["key"]
    last = F.filter(
        entries,
        lambda e, i: ~F.array_contains(
            F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"]
        ),
    )
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.map_from_entries(F.when(repeated, last).otherwise(entries))


def fill(template: str, **columns: Column) -> Column:
    """Text template with named places -> string column."""
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(columns[name].cast("string"))
    return F.concat(*parts)


def listing(names: Column, total: Column, shown: int, sep: str = ", ") -> Column:
    """The first names of an array, then '(+n more)' for the rest."""
    head = F.array_join(F.slice(names, 1, shown), sep)
    rest = F.concat(F.lit(" (+"), (total - F.lit(shown)).cast("string"), F.lit(" more)"))
    return F.when(total > shown, F.concat(head, rest)).otherwise(head)


def is_filled(c: Column) -> Column:
    """Neither null nor empty; both tests can be pushed to a scan."""
    return c.isNotNull() & (c != "")
