"""The table of runnable queries: a Spark plan and, where SQL can state it, an independent query."""

from __future__ import annotations

import textwrap
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    def add(build):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(build, textwrap.dedent(oracle).strip() if oracle else None)
        return build

    return add
