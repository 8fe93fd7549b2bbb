"""Registration of queries and composition of their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .frames import clean
from .views import VIEWS

QUERIES: dict[str, Callable] = {}
#: The same without the rounding that comparison needs.
PLAIN: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, columns: str | None = None, source: str | None = None) -> Callable:
    """Register a query; with ``columns`` and ``source`` also the SQL it must agree with.

    ``columns`` lists typed outputs: ``d:`` double, ``i:`` whole number, ``t:`` timestamp,
    anything else as is; ``name=expr`` renames. ``source`` is a FROM clause over the views.
    """
    def wrap(fn: Callable[..., DataFrame]) -> Callable:
        PLAIN[name] = fn
        QUERIES[name] = lambda spark, sf: clean(fn(spark, sf))
        if source is not None:
            SQL[name] = compose(select_list(columns) + " " + source)
        return fn

    return wrap


def select_list(columns: str) -> str:
    out = []
    for item in _split(columns):
        kind, _, rest = item.partition(":") if re.match(r"^[dibts]:", item) else ("", "", item)
        name, _, expr = rest.partition("=")
        name, expr = name.strip(), (expr or name).strip()
        if kind == "d":
            expr = f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0.0"
        elif kind == "i":
            expr = f"CAST({expr} AS BIGINT)"
        elif kind == "t":
            expr = f"CAST({expr} AS TIMESTAMP)"
        elif kind == "s":
            expr = f"CAST({expr} AS VARCHAR)"
        out.append(f'{expr} AS "{name}"')
    return "SELECT " + ", ".join(out)


def _split(columns: str) -> list[str]:
    """Comma-separated items, ignoring commas inside brackets."""
    items, depth, cur = [], 0, ""
    for ch in columns:
        depth += ch in "([{"
        depth -= ch in ")]}"
        if ch == "," and depth == 0:
            items.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [i for i in [*items, cur.strip()] if i]


def compose(body: str) -> str:
    """Prefix the views a statement uses, directly or through other views, in definition order."""
    needed: set[str] = set()
    frontier = {v for v in VIEWS if re.search(rf"\b{v}\b", body)}
    while frontier:
        v = frontier.pop()
        needed.add(v)
        frontier |= {w for w in VIEWS if w not in needed and re.search(rf"\b{w}\b", VIEWS[v])}
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in VIEWS if v in needed)
    return f"WITH {ctes}\n{body}" if ctes else body
