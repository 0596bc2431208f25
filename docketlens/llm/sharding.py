"""Shards of equal row counts that keep linked documents together: balanced label propagation, columns only.

Documents of one link key (such as equal text) are neighbours. Documents of one key move alike, so the state of the propagation is
one row for each key, with its neighbours' votes, and never a row for each pair. Labels start evenly spread over the shards. In
each round the documents of a key that have no settled place apply together to the shard that holds most of their neighbours; a
shard takes applicants by the pull of their key, its number of documents, until its quota is full, and puts out what a stronger key
displaces. What cannot fit is refused for good and applies elsewhere in the next round. A key larger than a quota applies in parts of a
quota. It ends when every key is settled or refused by all. Documents without neighbours, and those of the keys left, then fill
the rest of the quotas in the order of their keys, so that row counts differ by one at most and few of the keys left are cut.

Admission reads one row for each (shard, pull, bucket of keys): keys above a 1024th of a quota, 8192 of 8 shards at most, are told
apart, smaller ones share 1024 buckets for each power of two of their pull. Documents meet their key's shard in one join; only
places within a key larger than a quota, and those that fill up, are counted.

Defined results: a null link key links to nothing; rows that repeat each other are separate documents; equal pulls go by the key's
bucket, equal votes by a hash of key and shard; a table of fewer rows than shards has one row in each of the first; an empty table
has no rows. Keys are told apart by 64 bits: a collision puts two keys together and changes nothing else. Texts, however long, are read
once, for their key. Only the columns named are read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm.positions import positions
from docketlens.session import written_once

SHARDS = 8
#: Parts of a quota above which a key is admitted on its own, and buckets of the smaller ones of one pull.
FINE = 1024
#: A round settles or refuses something for good, so rounds end by themselves; what a last one leaves would fill up with the rest.
MOST_ROUNDS = 64


def _groups(rows: DataFrame, part: int, shards: int) -> DataFrame:
    """(key, part, size, votes, refused, shard) of every key of two or more documents, in parts of ``part`` at most."""
    label = F.pmod(F.xxhash64("no"), F.lit(shards))
    votes = F.array(*[F.count_if(label == s) for s in range(shards)])
    keys = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("all"), votes.alias("votes")).where("`all` > 1")
    parts = keys.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / part))))
    size = F.least(F.lit(part).cast("long"), F.col("all") - F.col("part") * part)
    return parts.select("key", "part", size.alias("size"), "votes", F.lit(None).cast("array<int>").alias("refused"), F.lit(None).cast("int").alias("shard"))


def _quota(shard: Column, total: int, shards: int) -> Column:
    return F.lit(total // shards).cast("long") + (shard < total % shards).cast("long")


def _round(groups: DataFrame, total: int, shards: int) -> DataFrame:
    """Applications, admissions and refusals of one round."""
    refused = F.coalesce("refused", F.array().cast("array<int>"))
    choices = F.array(*[F.struct(F.element_at("votes", s + 1).alias("votes"), F.xxhash64("key", "part", F.lit(s)).alias("tie"), F.lit(s).alias("shard")) for s in range(shards)])
    best = F.array_max(F.filter(choices, lambda c: ~F.array_contains(refused, c["shard"])))
    heavy = F.col("size") > total // shards // FINE
    asked = groups.withColumns({
        "at": F.coalesce(F.col("shard"), best["shard"]), "heavy": heavy,
        "pull": F.when(heavy, F.col("size")).otherwise(F.pow(2.0, F.floor(F.log2("size"))).cast("long")),
        "bucket": F.when(heavy, F.xxhash64("key", "part")).otherwise(F.pmod("key", F.lit(FINE))),
    })
    by = ["at", "heavy", "pull", "bucket"]
    buckets = asked.where("at is not null").groupBy(*by).agg(F.sum("size").alias("asking"))
    strongest = Window.partitionBy("at").orderBy(F.desc("heavy"), F.desc("pull"), "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumns({"up_to": F.sum("asking").over(strongest), "quota": _quota(F.col("at"), total, shards)})
    buckets = buckets.withColumn("taken", F.col("up_to") <= F.col("quota"))
    full = F.coalesce(F.max(F.when(F.col("taken"), F.col("up_to"))).over(Window.partitionBy("at")), F.lit(0))
    buckets = buckets.withColumn("out", ~F.col("taken") & (full + F.col("asking") > F.col("quota"))).select(*by, "taken", "out")
    told = asked.join(buckets, by, "left")
    now = F.when(F.col("out"), F.array_union(refused, F.array("at"))).otherwise(refused)
    return told.select("key", "part", "size", "votes", now.alias("refused"), F.when(F.col("taken"), F.col("at")).alias("shard"))


def propagate(groups: DataFrame, total: int, shards: int) -> DataFrame:
    """``groups`` with the shard where each settles, null where none takes it."""
    groups = written_once(groups, "sharding-groups")
    for _ in range(MOST_ROUNDS):
        groups = written_once(_round(groups, total, shards), "sharding-groups")
        if groups.where(F.col("shard").isNull() & (F.size("refused") < shards)).isEmpty():
            break
    return groups


def assign(docs: DataFrame, link: Column, carry: list[Column], shards: int = SHARDS) -> DataFrame:
    """(doc, shard, slot): every row of ``docs`` in a shard, with its place there from 0. ``doc`` holds the columns ``carry``."""
    key = F.when(link.isNotNull(), F.xxhash64(link))
    rows = docs.select(F.struct(*carry).alias("doc"), key.alias("key"), F.monotonically_increasing_id().alias("no"))
    rows = written_once(rows, "sharding-rows")
    total = rows.count()
    part = max(total // shards, 1)
    groups = propagate(_groups(rows, part, shards), total, shards)
    settled = groups.where("shard is not null")
    # Keys larger than a quota, fewer than twice the shards.
    large = [r["key"] for r in groups.where("part = 1").select("key").collect()]
    loads = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    homes = settled.where(~F.col("key").isin(large)).select("key", "shard")
    placed = written_once(rows.join(homes, "key", "left"), "sharding-placed")
    whole = placed.where("shard is not null").select("doc", "shard")
    rest = placed.where("shard is null").select("doc", "key", "no")
    if large:
        among = positions(rest.where(F.col("key").isin(large)), "key", [], "sharding-large").withColumn("part", F.floor(F.col("pos") / part))
        among = written_once(among.join(settled.select("key", "part", "shard"), ["key", "part"], "left").select("doc", "key", "no", "shard"), "sharding-parts")
        whole = whole.unionByName(among.where("shard is not null").select("doc", "shard"))
        rest = rest.where(F.coalesce(~F.col("key").isin(large), F.lit(True))).unionByName(among.where("shard is null").drop("shard"))
    # The rest fills the quotas: the shard of a place follows from the room of the shards before.
    ends = list(accumulate(total // shards + (s < total % shards) - loads.get(s, 0) for s in range(shards)))
    filled = positions(rest.withColumn("all", F.lit(0)), "all", ["key"], "sharding-rest")
    shard = F.coalesce(*[F.when(F.col("pos") < end, F.lit(s)) for s, end in enumerate(ends)])
    every = whole.unionByName(filled.select("doc", shard.alias("shard")))
    return positions(every, "shard", [], "sharding-slots").select("doc", "shard", F.col("pos").alias("slot"))
