"""Registry of the queries the repository answers over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import Domain, domain_ctes


class Catalog:
    """Named queries, each with the SQL that checks it where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None, needs: tuple[str, ...] = (), ctes: str = ""):
        """Register ``fn(domain)``; ``needs`` are the domain tables the SQL reads."""

        def register(fn: Callable[[Domain], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: fn(Domain.shared(spark, sf_dir))
            if oracle is not None:
                parts = [p for p in (domain_ctes(*needs)[5:] if needs else "", ctes) if p]
                head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
                self.oracles[name] = head + oracle
            return fn

        return register

    def merge(self, *others: "Catalog") -> "Catalog":
        for other in others:
            self.queries.update(other.queries)
            self.oracles.update(other.oracles)
        return self
