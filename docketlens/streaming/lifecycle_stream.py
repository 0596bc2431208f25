"""Listing lifecycle as a stream of checks: absence in a complete snapshot of a source deactivates a record.

A check writes its observed rows first and then one manifest file that names them and tells how each source went. The stream is over the
manifests, one for each micro-batch, so a batch always sees a whole check and never a part of a source. Each batch publishes a version of the
records and the events of its run under its own number: a retried batch reads the version before its own and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlens.operators import lifecycle as L
from docketlens.operators.keyed import computed_once
from docketlens.operators.run_state import with_last_complete
from docketlens.session import literal_rows, no_rows
from docketlens.sources.publication import Publication
from docketlens.sources.schemas import CHANGES
from docketlens.streaming.state import DeltaState, run_available

SOURCE = "source_id string, required boolean, minimum_records bigint, raw_rows bigint, parsed_rows bigint"
CHECK = f"checked_at string, path string, sources array<struct<{SOURCE}>>"
HISTORY = f"event_id string, record_id string, source_id string, type string, occurred_at string, changes {CHANGES}, snapshot string"
COVERAGE = (
    f"{SOURCE}, error string, status string, stale_retention_count bigint, record_count bigint, active_record_count bigint, last_success_at string, "
    "required_source_count bigint, required_success_count bigint, all_required_sources_succeeded boolean, overall_status string, last_complete_at string"
)


class LifecycleStream:
    """Records below ``root`` whose content is the string columns ``content``.

    A version holds every record ever listed, with the snapshot of its last event, which is what a record that comes back is compared
    with. So a check reads the version before it, and never the growing history.
    """

    def __init__(self, root: str, content: list[str], minimum_share: float = 0.8, report_recovery: bool = True):
        self.root, self.content = root, content
        self.minimum_share, self.report_recovery = minimum_share, report_recovery
        text = ", ".join(f"{c} string" for c in content)
        self.state = f"{text}, active boolean, inactive_reason string, stale_reason string, " + ", ".join(f"{c} string" for c in L.STAMPS)
        schema = f"source_id string, record_id string, transition string, {self.state}, changes {CHANGES}, listed boolean, event string"
        self.catalog = Publication(f"{root}/catalog", schema, HISTORY)
        self.coverage = DeltaState(f"{root}/coverage", COVERAGE, ["source_id"])

    def check(self, spark: SparkSession, check: dict, version: int) -> None:
        """Apply one check (``CHECK``) as a version."""
        now = check["checked_at"]
        before = self.catalog.latest(spark, version)
        known = self.catalog.read(spark, before) if before is not None else no_rows(spark, self.catalog.schema)
        checked = L.check_sources(literal_rows(spark, check["sources"], SOURCE), self.minimum_share)
        status = checked.select("source_id", "status")
        observed = spark.read.schema("source_id string, record_id string, " + ", ".join(f"{c} string" for c in self.content)).parquet(check["path"])
        seen = observed.join(status.filter("status = 'ok'"), "source_id", "left_semi").select(*L.KEY, F.struct(*self.content).alias("n"))
        old = known.select(*L.KEY, F.struct(*[c for c in known.columns if c not in L.KEY]).alias("k"))
        # Every known record meets what is observed of it once; what its id was last told as, whatever the source, is looked for in the same rows.
        met = seen.join(old, L.KEY, "full_outer").join(status, "source_id", "left")
        told_at = F.when(F.col("k.event").isNotNull(), F.col("k.last_changed_at"))
        held = F.when(F.col("k.listed") & F.col("status").isNotNull(), F.struct(*[F.col(f"k.{c}") for c in [*self.content, *L.STATE, *L.STAMPS]]))
        met = met.withColumns({"p": held, "_told": F.max_by("k.event", told_at).over(Window.partitionBy("record_id"))})
        # Only a record that comes is compared with its event: no other event is parsed.
        comes = F.col("n").isNotNull() & F.col("p").isNull()
        met = computed_once(met, h=F.from_json(F.when(comes, F.col("_told")), self.state))
        # What this check does not touch: records no longer listed, and those of a source it does not name, which leave the list.
        met = met.withColumn("_absent", F.col("n").isNull() & F.col("p").isNull())
        labelled = L.label(met, self.content, now, self.report_recovery, ("k", "_absent"))
        kept = {c: F.when(F.col("_absent"), F.col(f"k.{c}")).otherwise(F.col(c)) for c in [*self.content, *L.STATE, *L.STAMPS, "changes"]}
        transition = F.when(F.col("_absent"), "absent").otherwise(F.col("transition"))
        labelled = labelled.withColumns({**kept, "transition": transition}).withColumns({
            "event": F.when(L.is_event(F.col("transition")), L.event_snapshot(self.content)).otherwise(F.col("k.event")),
            "listed": ~F.col("transition").isin("absent", "deactivated"),
        })
        columns = ["source_id", "record_id", "transition", *self.content, *L.STATE, *L.STAMPS, "changes", "listed", "event"]
        kinds = ["discovered", "changed", "reactivated", "deactivated", "retained", "unchanged"]
        counts = {kind: F.count_if(F.col("transition") == kind) for kind in kinds}
        staged, found = self.catalog.stage(labelled.select(*columns), version, counts)
        self.catalog.append_history(L.lifecycle_events(staged, self.content, now, F.col("event")), f"check-{version}")
        last = self.coverage.deltas(spark, version).filter(F.col("batch") == (-1 if before is None else before))
        covered = L.coverage(checked, staged.filter("transition <> 'absent'"), last, now)
        self.coverage.write(with_last_complete(covered, last, now).select(*[c.split()[0] for c in COVERAGE.split(", ")]), version)
        self.catalog.name(spark, version, f"check-{version}", {"checked_at": now, **found})

    def _batch(self, manifests: DataFrame, batch_id: int) -> None:
        # One manifest for each micro-batch; its sources are a row each.
        for row in manifests.collect():
            self.check(manifests.sparkSession, row.asDict(recursive=True), batch_id)

    def run(self, spark: SparkSession, checks_path: str) -> None:
        """Apply all checks not yet applied, in the order their manifests were written."""
        checks = spark.readStream.schema(CHECK).option("maxFilesPerTrigger", 1).json(checks_path)
        run_available(checks, self._batch, f"{self.root}/checkpoint")

    def records(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Records listed now, or as of a version."""
        return self.catalog.read(spark, version).filter("listed").drop("changes", "listed", "event")

    def history(self, spark: SparkSession) -> DataFrame:
        """Events of all checks."""
        return self.catalog.history(spark).drop("run")
