"""Manifest, sharding and turn repair against plain versions, on odd rows and with small blocks."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlens.llm import merkle, sharding, turn_repair
from docketlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, [siblings of each leaf, level by level]) with digests as hex."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 8 * 8 : place // 8 * 8 + 8]
            proofs[i].append((place % 8, run[: place % 8] + run[place % 8 + 1 :]))
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [place // 8 for place in at]
    return level[0], proofs


def test_addresses_fill_the_layout():
    for rows in range(1, 6):
        at = np.concatenate([merkle.address(rows, depth, np.arange(8**depth)) for depth in range(rows)])
        assert sorted(at.tolist()) == list(range(merkle.nodes_of(rows)))
    # Halves: the first two of four levels come first, then each subtree of the lower two by itself.
    assert merkle.address(4, 1, np.arange(8)).tolist() == list(range(1, 9))
    assert merkle.address(4, 2, np.arange(3)).tolist() == [9, 18, 27] and merkle.address(4, 3, np.array([0, 7, 8])).tolist() == [10, 17, 19]


def test_blocks_hold_the_plain_tree():
    for n in (1, 2, 8, 9, 64, 65, 700):
        leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        root, proofs = plain_tree([d.hex() for d in leaves])
        levels = merkle.height(n)
        stored = merkle.build_block(leaves, levels)
        assert stored[:32].hex() == root
        for i in (0, n // 2, n - 1):
            steps = merkle.siblings(stored, levels, n, i)
            assert [(at, [o.hex() for o in others]) for at, others in steps] == proofs[i] and merkle.fold(leaves[i], steps).hex() == root
            assert merkle.read_path(merkle.write_path(steps)) == steps


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_plain(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 8**levels)
    r = random.Random(levels)
    rows = [(i, r.choice(["en"] * 30 + ["de", "", "ü", None]), r.choice(["A b", "", None, "x" * 5000])) for i in range(150)]
    rows += [(None, "en", "A"), (5, "en", "same"), (5, "en", "same"), (5, None, None), (200, "only", "ONE")]
    df = spark.createDataFrame([(*x, "t", "n") for x in rows], "id long, lang string, text string, tree string, pos string").repartition(3)
    fields = [F.col("id"), F.col("lang"), F.col("text")]
    got = merkle.manifest(df, F.col("lang"), fields, [*fields[:2], F.lower("text")], "id").collect()

    told = lambda *v: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v)
    trees = defaultdict(list)
    for i, lang, text in rows:
        now = told(i, lang, None if text is None else text.lower())
        trees[lang].append(((i is not None, i or 0), H(told(i, lang, text)), i, H(now)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: (sorted(trees[lang]), plain_tree([x[1] for x in sorted(trees[lang])])) for lang in langs}
    root, above = plain_tree([built[lang][1][0] for lang in langs])
    want = []
    for lang, up in zip(langs, above):
        leaves, (subroot, proofs) = built[lang]
        for (_, leaf, i, folded), proof in zip(leaves, proofs):
            for at, others in proof + up:
                folded = H(*others[:at], folded, *others[at:])
            want.append((i, leaf, subroot, root, H(*(o for _, others in proof + up for o in others)), folded))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "id long, lang string")
    assert merkle.manifest(df, F.col("lang"), [F.col("id")], [F.col("id")], "id").collect() == []


@pytest.mark.parametrize("sizes", [[60] * 9 + [30] * 3 + [2] * 100 + [1] * 50, [400, 1, 1, 2, 3], [3] * 200, [55] * 10, [1] * 5, [2], [], [7, 7, 7, 300, 300], [5] * 3 + [900] + [40] * 30])
def test_shards_are_even_and_keep_groups(spark, sizes):
    rows = [(i, k, "s") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k long, shard string").repartition(3)
    got = sharding.assign(df, F.when(F.col("k") != 1, F.col("k")), [F.col("k"), F.col("id")]).collect()
    assert Counter((x["doc"]["k"], x["doc"]["id"]) for x in got) == Counter((k, i) for i, k, _ in rows)
    counts = Counter(x["shard"] for x in got)
    assert all(len(rows) // 8 <= counts[s] <= -(-len(rows) // 8) for s in range(8))
    assert all(sorted(x["slot"] for x in got if x["shard"] == s) == list(range(counts[s])) for s in counts)
    held = defaultdict(Counter)
    for x in got:
        held[x["doc"]["k"]][x["shard"]] += 1
    quota = max(len(rows) // 8, 1)
    cut = [k for k, v in held.items() if len(v) > 1 and k != 1]
    # Keys larger than a quota must be cut, and where quotas fill up, one key for each pair of shards may be.
    assert len([k for k in cut if sizes[k] <= quota]) <= 7
    assert all(max(held[k].values()) == quota for k in cut if sizes[k] > 2 * quota)
    # 75 rows hold 25 threes; 264 rows hold six forties, and three beside the last 108 of the largest key.
    least = {200: 0, 34: 3}
    if len(sizes) in least:
        assert len([k for k in cut if sizes[k] <= quota]) == least[len(sizes)]


def test_op12_laws(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op12_sharding"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["law"] == "rows" for r in rows)
    groups = defaultdict(set)
    for r in rows:
        groups[docs[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in groups.values()) and set(Counter(r["shard"] for r in rows).values()) == {25}


def judged(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_repair(rows):
    """The cheapest edits by trying every edit at every place: (cost, audit, repaired lines)."""
    rows, after = judged(rows), {"": "us", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            said = after[state][0]
            c, a, lines = best(i, said, inserts + 1)
            found.append((c + 2, "I" + a, (names[said] + ":", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, lines = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, lines))
            if fault in (None, "truncated"):
                more = fault == "truncated"
                said = after[state][0]
                c, a, lines = best(i + 1, said, 0)
                found.append((c + 2 + more, "R" + a, (f"{names[said]}:{text}", *lines)))
                if role[:1] and role[:1] in after[state]:
                    c, a, lines = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 0)


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_repair_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    r = random.Random(block)
    convs = {c: [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "una"]), r.choice(["", " \n", "a.", "b", "c! ", "d?", f"{c}.", f"{t}."])) for t in range(r.randint(0, 9))] for c in range(60)}
    convs[None] = [("system", "x."), ("user", "y.")]
    convs[77] = [("user", "z" * 30_000 + ".")] * 3
    rows = [(c, t, *x, "p") for c, said in convs.items() for t, x in enumerate(said)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, pos string").repartition(3)
    every = spark.createDataFrame([(c,) for c in convs], "conv long")
    got = {x["conv"]: x for x in turn_repair.repair_all(df, every).collect()}
    assert set(got) == set(convs)
    for c, said in convs.items():
        x, (cost, audit, lines) = got[c], plain_repair(said)
        faults = Counter(f for _, _, f in judged(said))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        assert (x["cost"], x["audit"], x["repaired_sha256"]) == (cost, audit, H("\n".join(lines))), c
        assert [x[f] for f in ("blank", "duplicate", "truncated")] == [faults[f] for f in ("blank", "duplicate", "truncated")]
        assert x["gaps"] == 0 and x["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_repair_of_odd_rows(spark):
    rows = [(1, None, "user", "a."), (1, None, "user", "b."), (2, 3, None, None), (2, 9, "user", "q?"), (3, 4, "user", "same."), (3, 4, "user", "same."), (4, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = {x["conv"]: x for x in turn_repair.repair(df).collect()}
    assert (got[1]["gaps"], got[1]["illegal"], got[1]["audit"], got[1]["cost"]) == (0, 1, "KR", 2)
    assert (got[2]["gaps"], got[2]["blank"], got[2]["audit"]) == (5, 1, "DKI") and (got[3]["duplicate"], got[3]["audit"]) == (1, "KDI")
    assert (got[4]["cost"], got[4]["audit"], got[4]["repaired_sha256"]) == (3, "D", H(""))
    assert turn_repair.repair(df.limit(0)).collect() == []
