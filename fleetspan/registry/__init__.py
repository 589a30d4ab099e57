"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from fleetspan.session import configure
from fleetspan.sources.views import VIEWS, Telemetry

_VIEW_NAME = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")
MODULES = ["sources", "rows", "joins", "aggregates", "rankings", "streams", "composites"]
_INPUT = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Entry:
    build: Callable[[Telemetry], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Telemetry(configure(spark), sf_dir))


def with_views(body: str) -> str:
    """Put the view texts a query names in front of it as common table expressions."""
    names = list(dict.fromkeys(_VIEW_NAME.findall(body)))
    ctes = [f"{n} AS ({_INPUT.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in names]
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join([*ctes, body[len(head) :]])
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def all_entries() -> dict[str, Entry]:
    merged: dict[str, Entry] = {}
    for name in MODULES:
        module = import_module(f"fleetspan.registry.{name}")
        overlap = merged.keys() & module.ENTRIES.keys()
        if overlap:
            raise ValueError(f"query names used twice: {sorted(overlap)}")
        merged.update(module.ENTRIES)
    return merged
