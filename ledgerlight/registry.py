"""Registry of driver queries: name -> (Spark builder, DuckDB oracle text).

Spark builders take ``(spark, sf_dir)`` and return a lazy DataFrame.  Oracle
texts are written independently in DuckDB SQL over the same adapter views
(prefixed as CTEs), so a match is evidence, not a tautology.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.sources.adapters import Sources, oracle_ctes


@dataclass
class Entry:
    name: str
    build: Callable[[Sources], DataFrame]
    oracle_body: str | None
    adapters: tuple[str, ...]
    ids: str
    oracle_fn: Callable[[], str] | None = None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Sources(spark, sf_dir))

    def oracle(self, region_key: int | None = None) -> str | None:
        """DuckDB text; with ``region_key`` the adapters read that region's
        slice of the fixture (see ``adapters.RegionalSources``)."""
        body = self.oracle_fn() if self.oracle_fn else self.oracle_body
        if body is None:
            return None
        body = body.strip()
        if not self.adapters:
            return body
        ctes = oracle_ctes(self.adapters, region_key)
        # The body may start with its own CTEs: merge them into one WITH list.
        if body[:4].upper() == "WITH":
            return ctes.rstrip() + ",\n" + body[4:].lstrip()
        return ctes + body


REGISTRY: dict[str, Entry] = {}


def register(name: str, adapters: tuple[str, ...] = (), oracle: str | None = None, ids: str = "",
             oracle_fn: Callable[[], str] | None = None):
    def deco(fn: Callable[[Sources], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, tuple(adapters), ids, oracle_fn)
        return fn
    return deco
