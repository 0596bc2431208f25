"""Registered queries against their SQL on the smallest tables; those without SQL against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketlens.llm import dart_minhash, suffix_dedup
from docketlens.llm.queries import ORACLES, QUERIES
from oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == []


def repeats(texts, length):
    """Plain version of the substring removal."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_op3_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op3_language_id"](spark, FOLDER).collect()
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op4_equals_plain(spark, texts):
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op4_suffix_dedup"](spark, FOLDER).collect()}
    assert rows == dict(zip(texts, repeats([t.encode() for t in texts.values()], suffix_dedup.LENGTH)))


def test_op5_learns(spark):
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_op6_base_and_model(spark, texts):
    rows = QUERIES["op6_interpolated_lm"](spark, FOLDER).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), "\n"] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(w for k, v in tokens.items() if not held[k] for w in v)
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        words = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(words), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), rel=1e-9)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_op9_round_trip(spark, texts):
    rows = QUERIES["op9_packing"](spark, FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        by_document[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces, total in [(v, len(ids[k])) for k, v in by_document.items()] + [(v, sum(n for _, n in v)) for v in by_sequence.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    assert set(by_document) == set(ids)
    # No padding at all: sequences are full or a power of two.
    assert all(n <= 4096 and n & (n - 1) == 0 for n in (sum(x for _, x in v) for v in by_sequence.values()))


def test_op10_equals_plain(spark, texts):
    shingler = dart_minhash.Shingler()
    sets = {k: frozenset(shingler.shingles(t.encode()).tolist()) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if a < b and (texts[a] == texts[b] or common and 5 * common >= 4 * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    rows = QUERIES["op10_dart_minhash"](spark, FOLDER).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {k: root(k) for k in texts}
    assert Counter(r["class_id"] for r in rows if r["kept"]) == Counter({root(k) for k in texts})


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packed":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.select(F.countDistinct("doc_id")).first()[0])
    assert counts[0] > counts[2] > counts[3] == counts[4] == counts[5] > 0.8 * counts[0]
