"""Published versions of a table: rows are written and checked first, and a manifest file, written last, names them.

Layout below a root: ``data/v00000003`` holds the rows of a version, each with its schema version; ``history/run=<run>`` the events
of a run; ``manifests/v00000003.<run>.json`` names version and run. Readers see only what a manifest names, so a run that fails
or is refused at any point leaves everything as it was, and a run that is repeated replaces its own rows and events.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docketlens.sources.snapshots import SCHEMA_VERSION, existing_paths, read_snapshot, version_path, write_snapshot, write_text

_MANIFEST = re.compile(r"/v(\d+)\.([A-Za-z0-9_-]+)\.json$")
#: What a check of a written table says about its metrics: a name and the condition they must meet.
Rules = dict[str, Callable[[dict], bool]]


class Refused(ValueError):
    """A table that was written but does not keep its rules; nothing names it."""

    def __init__(self, broken: list[str], metrics: dict):
        super().__init__(f"not published: {', '.join(broken)} ({metrics})")
        self.broken, self.metrics = broken, metrics


def audited_write(rows: DataFrame, write: Callable[[DataFrame], None], metrics: dict[str, Column], rules: Rules) -> dict:
    """``write`` the rows with ``metrics`` observed on that same write; ``Refused`` if they break a rule."""
    observation = Observation()
    write(rows.observe(observation, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in metrics.items()]))
    # Aggregates of an empty table are told as well, so sums may be null.
    found = {name: value if value is not None else 0 for name, value in observation.get.items()}
    broken = [name for name, holds in rules.items() if not holds(found)]
    if broken:
        raise Refused(broken, found)
    return found


@dataclass(frozen=True)
class Publication:
    root: str
    schema: str
    history_schema: str | None = None
    schema_version: int = SCHEMA_VERSION

    def named(self, spark: SparkSession) -> dict[int, str]:
        """The run of each published version."""
        found = (_MANIFEST.search(p) for p in existing_paths(spark, f"{self.root}/manifests/v*.json"))
        return dict(sorted((int(m[1]), m[2]) for m in found if m))

    def latest(self, spark: SparkSession, before: int | None = None) -> int | None:
        return max((v for v in self.named(spark) if before is None or v < before), default=None)

    def stage(self, rows: DataFrame, version: int, metrics: dict[str, Column] | None = None, rules: Rules | None = None) -> tuple[DataFrame, dict]:
        """Write the rows of a version without naming it; returns them as written, and their metrics."""
        path = version_path(f"{self.root}/data", version)
        found = audited_write(rows, lambda df: write_snapshot(df, path, self.schema_version), metrics or {}, rules or {})
        return read_snapshot(rows.sparkSession, path, self.schema, self.schema_version), found

    def append_history(self, events: DataFrame, run: str) -> None:
        """The events of a run; a repeated run replaces them."""
        events.write.mode("overwrite").parquet(f"{self.root}/history/run={run}")

    def name(self, spark: SparkSession, version: int, run: str, details: dict) -> None:
        """Make a staged version, and the events of its run, the published ones."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
            raise ValueError(f"a run id is of letters, digits, _ and -: {run}")
        other = self.named(spark).get(version)
        if other == run:
            return
        if other is not None:
            raise ValueError(f"version {version} is published by run {other}")
        told = {"version": version, "run": run, "schema_version": self.schema_version, **details}
        write_text(spark, f"{self.root}/manifests/v{version:08d}.{run}.json", json.dumps(told, sort_keys=True, default=str))

    def publish(
        self, rows: DataFrame, run: str, events: DataFrame | None = None, metrics: dict[str, Column] | None = None, rules: Rules | None = None
    ) -> int:
        """Write, check and name the next version, or again the version of this run; returns its number."""
        spark, named = rows.sparkSession, self.named(rows.sparkSession)
        again = [v for v, r in named.items() if r == run]
        if again:
            return again[-1]
        version = max(named, default=0) + 1
        _, found = self.stage(rows, version, metrics, rules)
        if events is not None:
            self.append_history(events, run)
        self.name(spark, version, run, found)
        return version

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """A published version, by default the latest; empty if nothing is published yet."""
        named = self.named(spark)
        if version is not None and version not in named:
            raise ValueError(f"version {version} is not published")
        if not named:
            return spark.createDataFrame([], self.schema)
        return read_snapshot(spark, version_path(f"{self.root}/data", max(named) if version is None else version), self.schema, self.schema_version)

    def history(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Events of the runs up to a version, with their ``run``."""
        runs = dict.fromkeys(r for v, r in self.named(spark).items() if version is None or v <= version)
        paths = [p for r in runs for p in existing_paths(spark, f"{self.root}/history/run={r}")]
        schema = f"{self.history_schema}, run string"
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.root}/history").parquet(*paths)
