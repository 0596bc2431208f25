"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern; each candidate value is hashed, and for each hash the distinct repositories and owners
that hold it are counted over the whole corpus. A value that several owners hold is a widely copied example (a sample
key out of a manual, a licence checksum); a value that stays with few owners looks like a live credential.
Opaque strings without any keyword beside them are too weak to be reported by pattern alone: they are added only where
the corpus shows them to be owner-specific.

Everything here is DataFrame expressions. Offsets are code points, ends exclusive. Defined results: a null text is
empty; documents without candidates keep a row with empty lists; a null owner or repository counts as one more name;
repeated rows are separate rows with equal spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm.common import document_key
from docketlens.session import written_once

# The patterns and least lengths of the base kinds.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ("assign", "access", "hex")
#: The added kind, listed after the base ones.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
#: A value held by at least this many owners is an example.
EXAMPLE_OWNERS = 3


def _patterns() -> list[tuple[str, str, Column]]:
    """(kind, pattern, condition on the matched text ``m``)."""
    m = F.col("m")
    return [
        ("assign", ASSIGN, F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        ("access", ACCESS, F.length(m) >= 20),
        # A run of fewer letters can hold no longer run: the least length may stand in the pattern.
        ("hex", HEX.replace("+", "{24,}"), F.lit(True)),
        ("opaque", OPAQUE, m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
    ]


def candidates(docs: DataFrame, id_column: str, text_column: str, repo: Column, owner: Column) -> DataFrame:
    """(row, id, key, kind, kind_no, start, end, value_hash, owner, repo): located candidates.

    A document without candidates has one row of null kind. Positions come from the lengths of the pieces between the
    matches, summed in a window over the matches of one document and kind.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), document_key(id_column, text_column).alias("key"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    found = []
    for number, (kind, pattern, _) in enumerate(_patterns()):
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        pairs = F.arrays_zip(F.sequence(F.lit(1), F.size(gaps)).alias("i"), gaps.alias("gap"), matches.alias("m"))
        listed = F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("kind_no"), pairs.alias("found"))
        found.append(F.when(F.col("text").rlike(pattern), listed))
    rows = rows.withColumn("kinds", F.filter(F.array(*found), lambda x: x.isNotNull())).drop("text")
    rows = rows.select("*", F.explode_outer("kinds").alias("k")).drop("kinds")
    rows = rows.select("*", F.explode_outer("k.found").alias("f")).select(
        "row", "id", "key", "repo", "owner", "k.kind", "k.kind_no", "f.i", "f.gap", "f.m"
    )
    so_far = Window.partitionBy("row", "kind_no").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(so_far)
    keep = F.lit(False)
    for kind, _, condition in _patterns():
        keep = F.when(F.col("kind") == kind, condition).otherwise(keep)
    # The piece after the last match has no match beside it.
    placed = rows.select("*", end.alias("end"), (F.col("m").isNotNull() & keep).alias("keep"))
    here = F.col("keep")
    # A document whose matches all fail keeps its rows, emptied; they add nothing below.
    return placed.select(
        "row", "id", "key", "repo", "owner", F.when(here, F.col("kind")).alias("kind"), F.when(here, F.col("kind_no")).alias("kind_no"),
        F.when(here, F.col("end") - F.length("m")).alias("start"), F.when(here, F.col("end")).alias("end"),
        F.when(here, F.sha2("m", 256)).alias("value_hash"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_repos, n_owners, n_seen) over the whole corpus; pairs are made distinct before they are counted."""
    seen = found.where(F.col("value_hash").isNotNull()).groupBy("value_hash", "repo", "owner").agg(F.count("*").alias("n"))
    owners = seen.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    # One repository belongs to one owner, so its (repository, owner) pairs are its repositories.
    return owners.groupBy("value_hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_seen"))


def classified(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """The located candidates of ``found`` with ``live``: true where fewer than ``example_owners`` owners hold the value.

    Base candidates all stay; opaque ones stay only where they are live and touch no base span of their document.
    Rows without a candidate take no part, so that documents without any meet in no join.
    """
    located = found.where(F.col("value_hash").isNotNull())
    spans = located.join(ownership(located), "value_hash").withColumn("live", F.col("n_owners") < example_owners)
    # Spans of one document by start: an opaque span touches a base span that starts before its end and ends after its start.
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_base = F.col("kind_no") < len(BASE)
    spans = spans.withColumn("base_end", F.max(F.when(is_base, F.col("end"))).over(before))
    spans = spans.withColumn("base_start", F.min(F.when(is_base, F.col("start"))).over(after))
    touches = (F.coalesce(F.col("base_end"), F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("base_start"), F.lit(2**62)) < F.col("end"))
    return spans.withColumn("stays", F.coalesce(is_base | (F.col("live") & ~touches), F.lit(False))).drop("base_end", "base_start")


def scan(docs: DataFrame, id_column: str, text_column: str, repo: Column, owner: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each document: (id, key, found), ``found`` being its spans by start and kind with their verdicts.

    The located candidates are written once, as counting and reporting both read them.
    """
    found = written_once(candidates(docs, id_column, text_column, repo, owner), "secret-candidates")
    spans = classified(found, example_owners).where("stays")
    told = spans.select("row", "id", "key", F.struct("start", "kind_no", "kind", "end", "live", "n_repos", "n_owners").alias("span"))
    # Every document keeps a row, whether or not a span of it stays.
    every = found.select("row", "id", "key", F.lit(None).cast(told.schema["span"].dataType).alias("span"))
    return told.unionByName(every).groupBy("row").agg(
        F.first("id").alias("id"), F.first("key").alias("key"), F.array_sort(F.collect_list("span")).alias("found")
    ).drop("row")


def written_spans(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(
    docs: DataFrame, id_column: str, text_column: str, repo: Column, owner: Column,
    live_mark: str = "[SECRET]", example_mark: str = "[EXAMPLE KEY]", example_owners: int = EXAMPLE_OWNERS,
    length_column: str | None = None,
) -> DataFrame:
    """``docs`` with every span replaced: a run of touching spans by ``live_mark`` if any of them is live, else ``example_mark``.

    Columns and all text outside spans are as before, but for ``length_column``, which gets the new length of a changed
    text; a null text stays null.
    """
    found = written_once(candidates(docs, id_column, text_column, repo, owner), "secret-candidates")
    spans = classified(found, example_owners).where("stays")
    spans = spans.select("key", "start", "end", "live").distinct()
    by_start = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1))
    spans = spans.withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = spans.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("live").alias("live"))
    lists = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "live"))).alias("runs"))
    kept = docs.select(F.struct("*").alias("doc"), document_key(id_column, text_column).alias("key"))
    joined = kept.join(lists, "key", "left").select("doc", "runs", F.col(f"doc.`{text_column}`").alias("text"))
    previous = lambda i: F.when(i > 0, F.get("runs", i - 1)["end"]).otherwise(F.lit(0))
    parts = F.transform(
        "runs",
        lambda r, i: F.concat(
            F.substring("text", (previous(i) + 1).cast("int"), (r["start"] - previous(i)).cast("int")),
            F.when(r["live"], F.lit(live_mark)).otherwise(F.lit(example_mark)),
        ),
    )
    last = F.substring("text", (F.element_at("runs", -1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), last))
    changed = joined.select("doc", "runs", text.alias("text"))
    value = {text_column: F.col("text")}
    if length_column:
        old = F.col(f"doc.`{length_column}`")
        value[length_column] = F.when(F.col("runs").isNull(), old).otherwise(F.length("text").cast(docs.schema[length_column].dataType))
    return changed.select(*[value.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
