"""Catalog of message types and components: search, statistics, checks, lookup."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.schema import PAYLOADS, valid_type_name


def messages(spark: SparkSession) -> DataFrame:
    """(name, domain, fields) of the registered message types."""
    rows = spark.createDataFrame(list(PAYLOADS.items()), "name string, fields string")
    return rows.withColumn("domain", F.substring_index("name", "/", 1))


def search(catalog: DataFrame, pattern: str, *, name: str = "name", ignore_case: bool = True, limit: int | None = None) -> DataFrame:
    """Rows whose name has the pattern; names that contain it literally first, then short ones, then by name."""
    found = catalog.where(F.col(name).rlike(f"(?i){pattern}" if ignore_case else pattern))
    literal = F.lower(F.col(name)).contains(pattern.lower())
    out = found.orderBy((~literal).cast("int"), F.length(name), name)
    return out if limit is None else out.limit(limit)


def type_stats(catalog: DataFrame, by: str, kind: str, most: int = 5) -> DataFrame:
    """The ``most`` most frequent groups with counts per kind and the share of all rows."""
    from pyspark.sql import Window

    found = catalog.groupBy(by).pivot(kind).count().na.fill(0)
    kinds = [c for c in found.columns if c != by]
    found = found.withColumn("total", sum((F.col(c) for c in kinds), F.lit(0)))
    return found.withColumn("percent", 100.0 * F.col("total") / F.sum("total").over(Window.partitionBy())).orderBy(F.desc("total"), by).limit(most)


def classify(catalog: DataFrame) -> DataFrame:
    """``catalog`` (name, fields, declared) with status: Valid, Partial, Warning or Invalid."""
    status = (
        F.when(~valid_type_name(F.col("name")), "Invalid")
        .when(F.col("declared").isNotNull() & (F.col("declared") != F.col("name")), "Warning")
        .when(F.coalesce(F.col("fields"), F.lit("")) == "", "Partial")
        .otherwise("Valid")
    )
    return catalog.withColumn("status", status)


_NAME = re.compile(r"^[a-z][a-z0-9_]*$")


@dataclass
class Registry:
    """Components by namespace/name, imported when first used."""

    paths: dict[str, str] = field(default_factory=dict)
    _found: dict[str, Callable] = field(default_factory=dict)

    def register(self, namespace: str, name: str, path: str) -> None:
        if not _NAME.match(namespace) or not re.match(r"^[A-Za-z_][\w.]*$", name):
            raise ValueError(f"not a component name: {namespace}/{name}")
        self.paths[f"{namespace}/{name}"] = path

    def register_all(self, plugins: dict[str, dict[str, str]]) -> dict[str, str]:
        """Register plugins (namespace -> name -> path); one that fails does not stop the others. Returns the failures."""
        failed = {}
        for namespace, components in plugins.items():
            try:
                for name, where in components.items():
                    self.register(namespace, name, where)
            except ValueError as e:
                failed[namespace] = str(e)
        return failed

    def get(self, key: str) -> Callable:
        if key not in self._found:
            if key not in self.paths:
                raise KeyError(key)
            module, _, attribute = self.paths[key].partition(":")
            self._found[key] = getattr(importlib.import_module(module), attribute)
        return self._found[key]

    def listing(self, spark: SparkSession, namespace: str | None = None) -> DataFrame:
        rows = [(k.split("/")[0], k.split("/", 1)[1], p, k in self._found) for k, p in sorted(self.paths.items()) if namespace is None or k.startswith(f"{namespace}/")]
        return spark.createDataFrame(rows, "namespace string, name string, path string, loaded boolean")
