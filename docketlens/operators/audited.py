"""Docket lifecycles published only if their rows reconcile: the counts are observed on the writes themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.operators import survival as S
from docketlens.sources.publication import Publication, audited_write

#: Rules of a run, by the names that a refusal tells.
RECONCILES, PENDING_KEPT, ENDED = "rows_reconcile", "pending_rows_are_censored", "dockets_end"


def stage_rows(classified: DataFrame, catalog: Publication, run: str) -> tuple[DataFrame, dict]:
    """The class rows written once and read back, and their counts observed on that write, so that both are of the same rows."""
    path, status = f"{catalog.root}/rows/run={run}", F.col("row_status")
    counts = {"pending_rows": F.count_if("pending"), "valid_rows": F.count_if(status == "valid"), "skipped_rows": F.count_if(status.isin(S.SKIP_STATUSES))}
    rows = classified.filter("is_class")
    seen = audited_write(rows, lambda df: df.write.mode("overwrite").parquet(path), counts, {})
    return classified.sparkSession.read.schema(rows.schema).parquet(path), seen


def publish_lifecycles(
    classified: DataFrame, catalog: Publication, run: str, order: list[str], snapshot: str,
    collapse: Callable[[DataFrame, list[str], str], DataFrame] = S.collapse_dockets,
) -> int:
    """Publish the lifecycles of ``classified`` rows as the next version of ``catalog``, or raise ``Refused`` and publish nothing."""
    return publish_staged(stage_rows(classified, catalog, run), catalog, run, order, snapshot, collapse)


def publish_staged(
    staged: tuple[DataFrame, dict], catalog: Publication, run: str, order: list[str], snapshot: str,
    collapse: Callable[[DataFrame, list[str], str], DataFrame] = S.collapse_dockets,
) -> int:
    """The same of rows that ``stage_rows`` has written, which several runs may share.

    Every class row must be skipped for a reason, collapsed into a docket or the first of one; pending rows must leave a censored docket;
    a docket that is not pending must have an end.
    """
    rows, seen = staged
    lives = collapse(rows, order, snapshot)
    metrics = {
        "collapsed_rows": F.sum(F.col("n_rows") - 1), "pending_dockets": F.count_if("pending"),
        "endless_dockets": F.count_if(~F.col("pending") & F.col("final_terminated_at").isNull()),
    }
    rules = {
        RECONCILES: lambda m: seen["rows"] == seen["skipped_rows"] + m["collapsed_rows"] + m["rows"],
        PENDING_KEPT: lambda m: seen["pending_rows"] == 0 or m["pending_dockets"] > 0,
        ENDED: lambda m: m["endless_dockets"] == 0,
    }
    names = [c.split()[0] for c in catalog.schema.split(", ")]
    return catalog.publish(lives.select(*names), run, metrics=metrics, rules=rules)
