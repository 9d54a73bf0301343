"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS

BASE = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()


class Tables:
    """The driver tables and the views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose FROM and JOIN names are driver tables or views."""
        names: dict[str, DataFrame] = {}

        def mark(match: re.Match) -> str:
            name = match.group(2)
            if name not in BASE and name not in VIEWS:
                return match.group(0)
            names.setdefault(name, self(name))
            return f"{match.group(1)} {{{name}}}"

        text = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)", mark, text), **names)


class StreamTables(Tables):
    """The same tables as streams. Views that join tables are not meant for it."""

    def __call__(self, name: str) -> DataFrame:
        if name not in BASE:
            return super().__call__(name)
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        # A table is one file or a folder of files. As a stream, a single file is only read through a pattern.
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ops: str, sql: str | None = None):
    """Register a query under its function name; ``ops`` are the inventory ids it covers."""

    def add(run: Callable[[Tables], DataFrame]):
        assert run.__name__ not in QUERIES, run.__name__
        QUERIES[run.__name__] = Query(run.__name__, ops, run, sql)
        return run

    return add


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bfx_\w+", text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def full_sql(text: str) -> str:
    """The SQL with the views it uses in front."""
    views = [f"{name} AS ({VIEWS[name]})" for name in _needed(text, [])]
    own = re.match(r"\s*WITH\s+", text)
    if own and views:
        return f"WITH {', '.join(views)}, {text[own.end():]}"
    return f"WITH {', '.join(views)} {text}" if views else text
