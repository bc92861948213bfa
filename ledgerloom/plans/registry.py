"""How plans register a query and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import SQL as TABLES
from .fixtures import Ledger


#: The tables of fixtures.SQL by name, in order: each is defined by those before it.
_PARTS = {part.split(" AS ", 1)[0]: part.rstrip().rstrip(",") for part in re.split(r"(?m)^(?=\w+ AS \()", TABLES.removeprefix("WITH RECURSIVE ")) if part}


def with_tables(sql: str) -> str:
    """A statement with the definitions of just the tables that it names, directly or through others."""
    statement = sql.strip()
    inner = statement[5:] if statement[:5].upper() == "WITH " else None
    needed, text = set(), statement
    for name in reversed(_PARTS):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += "\n" + _PARTS[name]
    tables = [_PARTS[name] for name in _PARTS if name in needed]
    if not tables:
        return f"WITH RECURSIVE {inner}" if inner else statement
    return "WITH RECURSIVE " + ",\n".join(tables) + (",\n" + inner if inner else "\n" + statement)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Registers a function of a Ledger as query `name`; sql may use the tables of fixtures.SQL."""

        def add(f: Callable[[Ledger], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
            if sql:
                self.sql[name] = with_tables(sql)
            return f

        return add
