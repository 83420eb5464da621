"""Rule tables as column expressions, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def first_match(text: Column, rules: list[tuple], otherwise) -> Column:
    """The value of the first (pattern, value) whose pattern is found."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def first_match_sql(text: str, rules: list[tuple], otherwise: str) -> str:
    value = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {value(v)}" for p, v in rules) + f" ELSE {otherwise} END"


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | text.contains(x)
    return out


def contains_any_sql(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(x)})" for x in parts) + ")" if parts else "FALSE"


def within(host: Column, names: list[str]) -> Column:
    """The host is one of the names or a subdomain of one."""
    return F.arrays_overlap(urls.suffixes(host), F.array(*[F.lit(x) for x in names]))


def within_sql(host: str, names: list[str]) -> str:
    return f"list_has_any(list_transform(range(1, len(string_split({host}, '.')) + 1), lambda i: array_to_string(string_split({host}, '.')[i:], '.')), {array_sql(names)})"


def array_sql(values: list[str]) -> str:
    return "[" + ", ".join(quoted(x) for x in values) + "]"


def words_of(text: str) -> list[str]:
    return text.split()
