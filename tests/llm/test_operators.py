"""Each operator on nulls, empty and repeated rows, empty tables and columns of clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlens.llm import (
    chat_format, dart_minhash, decontaminate, interpolated_lm, language_id, packing, secret_scan, suffix_dedup, toxicity, voronoi_knn,
)
from docketlens.llm.components import connected_components

ODD = "doc_id long, text string, lang string, source string, doc string, key string, spans string, id string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "d", "k", "x", "y") for i, t in rows], ODD)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    said = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))
    long = said(30_000)
    return [(1, None), (2, ""), (3, " \n"), (4, "%%%"), (5, "one"), (6, said(80)), (6, None), (None, said(60)), (7, long), (8, long), (9, "a" * 700), (10, "x y " * 200)] + [(11, "same text here")] * 3


def test_chat_layouts(spark):
    records = [
        ("m", '{"messages": [{"content": "hi", "role": "user"}, {"role": "assistant", "content": "<s>[\\\\INST] yes"}]}'),
        ("s", '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": null}]}'),
        ("i", '{"output": "b", "instruction": "a"}'), ("p", '{"prompt": "a", "completion": 5}'), ("bad", "{"), ("none", None), ("other", '{"x": 1}'),
    ]
    df = spark.createDataFrame(records, "k string, rec string")
    turns = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat_format.canonical_turns(df, "k", "rec").collect()}
    assert turns["m"] == ("messages", [("user", "hi"), ("assistant", "<s>[\\INST] yes")])
    assert turns["s"] == ("sharegpt", [("user", "hi"), ("assistant", "")])
    assert turns["i"] == ("instruction", [("user", "a"), ("assistant", "b")]) and turns["p"] == ("prompt", [("user", "a"), ("assistant", "5")])
    assert turns["bad"] == turns["none"] == turns["other"] == (None, None)
    read = chat_format.read_back(chat_format.render(chat_format.canonical_turns(df, "k", "rec"))).where("id = 'm'").first()
    assert [tuple(t) for t in read["turns"]] == turns["m"][1] and "".join(read["loss_texts"]) == "<s>[\\INST] yes"
    assert "<s>" not in read["formatted"] and chat_format.canonical_turns(df.limit(0), "k", "rec").count() == 0


def test_chat_large_records(spark):
    x = lambda n: F.repeat(F.lit("x"), F.lit(n))
    long = 20_000_100
    turns = lambda n, size, more="": F.concat(F.lit('{"messages": [null, {"role": "user"}, '), F.array_join(F.array_repeat(F.concat(F.lit('{"content": "'), x(size), F.lit('", "role": "assistant"}')), n), ","), F.lit(f"{more}]}}"))
    fixed = lambda more="": F.concat(F.lit('{"output": "'), x(long), F.lit(f'", "instruction": 1.50{more}}}'))
    records = {
        "many": turns(1400, 100_000), "long": turns(1, long), "fixed": fixed(), "nested": turns(1, long, ', {"content": {"a": 1}}'), "other": fixed(', "x": 1'),
        "text": F.concat(F.lit('{"messages": "'), x(long), F.lit('"}')), "bad": F.concat(F.lit('{"prompt": "'), x(long)),
    }
    for k, record in records.items():
        got = chat_format.canonical_turns(spark.range(1).select(F.lit(k).alias("k"), record.alias("rec")), "k", "rec")
        sizes = F.transform("turns", lambda t: F.concat_ws(":", t["role"], F.length(t["text"])))
        found = got.select("layout", sizes.alias("sizes")).first()
        said = {"many": [":0", "user:0"] + ["assistant:100000"] * 1400, "long": [":0", "user:0", f"assistant:{long}"], "fixed": ["user:3", f"assistant:{long}"]}.get(k)
        assert (k, found["layout"]) == (k, {"many": "messages", "long": "messages", "fixed": "instruction"}.get(k)) and found["sizes"] == said
    with pytest.raises(Exception, match="(?i)malformed"):
        chat_format.canonical_turns(spark.range(1).select("id", turns(1, 140_000_000).alias("rec")), "id", "rec").select(F.size("turns")).collect()


def test_escape_is_reversible(spark):
    r = random.Random(2)
    parts = [*chat_format.CONTROLS, "\\", "<", "|", ">", "[", "]", "/", "s", "<<SYS\\>>", "[/INST\\\\]"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert row["u"] == row["t"] and not any(c in row["e"] for c in chat_format.CONTROLS)


def test_decontaminate_odd_rows(spark, rows):
    bench = spark.createDataFrame([(1, "one"), (2, None), (None, "same text"), (3, "x y x y x y x y x y x y x"), (3, "")], "item_id long, text string")
    docs = odd(spark, rows)
    for block_chars in (10**6, 8):  # one block, and many
        found = decontaminate.find_contamination(docs, "text", bench, block_chars=block_chars)
        got = [(r["doc"]["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in found.collect()]
        assert len(got) == len(rows)
        assert (5, 1, [(0, 1)], ["1"]) in got and (1, 0, [], []) in got and got.count((11, 3, [(0, 2)], [""])) == 3
        assert (10, 400, [(0, 399)], ["3"]) in got
    assert decontaminate.find_contamination(docs.limit(0), "text", bench).count() == 0
    clean = decontaminate.find_contamination(docs, "text", bench.limit(0))
    assert clean.where(F.size("spans") > 0).count() == 0


def test_fm_index_finds_all():
    r = np.random.default_rng(3)
    sequence = r.integers(1, 4, 600)
    sequence[r.integers(0, 600, 20)] = 0
    sequence[-1] = 0
    index = decontaminate.FMIndex(sequence, 4)
    for length in (1, 2, 5):
        phrases = r.integers(1, 4, (30, length))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            expected = [i for i in range(600 - length + 1) if (sequence[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_language_odd_rows(spark, rows):
    docs = odd(spark, rows)
    labelled = spark.createDataFrame([("a", "alpha beta gamma delta " * 40), ("b", "uno dos tres cuatro " * 40), (None, "zzz"), ("c", None)], "lang string, text string")
    dictionaries = language_id.learn(labelled, "lang", "text")
    assert [n for n, _ in dictionaries] == ["a", "b"]
    found = language_id.identify(docs, "text", dictionaries)
    got = [(r["doc"]["doc_id"], r["lang_pred"], r["rejected"]) for r in found.collect()]
    assert len(got) == len(rows) and (1, "und", True) in got and (4, "und", True) in got
    detector = language_id.Detector(dictionaries)
    assert detector.detect("gamma delta alpha")[0] == "a" and detector.detect("tres cuatro uno dos")[0] == "b"
    assert language_id.learn(labelled.limit(0), "lang", "text") == []
    assert {r["lang_pred"] for r in language_id.identify(docs, "text", []).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), "text", dictionaries).count() == 0


def test_language_of_few_long_texts_or_many_copies(spark):
    long = [("few", f"wenige lange texte {i} " * 2000) for i in range(3)]
    copied = [("copied", "immer gleich " * 200)] * 400 + [("copied", f"ein anderer satz {i}") for i in range(100)]
    rows = [*long, *copied, ("tiny", "oui"), ("marks", "a!?" + "?" * 300), *[("marks", "!" * i + "bc") for i in range(50, 90)]]
    dictionaries = dict(language_id.learn(spark.createDataFrame(rows, "lang string, text string"), "lang", "text", dictionary_bytes=1500))
    # Every language has text: as much as fits, or all there is of it.
    assert {k: len(v) for k, v in dictionaries.items()} == {"few": 1500, "copied": 1500, "tiny": 3, "marks": 1 + 40 * 3}
    assert language_id.Detector([(k, v) for k, v in dictionaries.items()]).names == list(dictionaries)
    whole = dict(language_id.learn(spark.createDataFrame(rows, "lang string, text string"), "lang", "text"))
    assert len(whole["copied"]) == sum(len(t.strip()) + 1 for t in {t for k, t in copied}) - 1


def test_suffix_dedup_odd_rows(spark, rows):
    from test_llm_queries import repeats

    docs = odd(spark, rows)
    for length, most in ((200, 4096), (64, 4096), (64, 2)):
        got = sorted((r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"])) for r in suffix_dedup.remove_repeats(docs, "text", ["doc_id"], length, most).collect())
        assert got == sorted(x[:3] for x in repeats([(t or "").encode() for _, t in rows if t is None or len(t) < 10**5] + [t.encode() for _, t in rows if t and len(t) >= 10**5], length))
    assert suffix_dedup.remove_repeats(docs.limit(0), "text", ["doc_id"]).count() == 0


def test_suffix_sorter_settles_collisions(monkeypatch):
    data = b"abcdabceabcdabcf" * 4
    sorter = suffix_dedup.SuffixSorter(data, 4)
    suffixes = np.arange(len(data) - 3)
    assert [data[i : i + 4] for i in sorter.sort(suffixes)] == sorted(data[i : i + 4] for i in suffixes)
    # Hashes that say all strings are equal: the bytes must tell them apart.
    monkeypatch.setattr(sorter, "extension", lambda a, b: np.full(len(a), 4))
    count = {}
    for i in suffixes:
        count[data[i : i + 4]] = count.get(data[i : i + 4], 0) + 1
    assert sorter.repeated(suffixes).tolist() == [i for i in suffixes if count[data[i : i + 4]] > 1]


def test_toxicity_odd_rows(spark, rows):
    r = random.Random(1)
    words = ["w%d" % i for i in range(200)]
    texts = [(" ".join(r.choice(words) for _ in range(30)) + (" vileword%d" % (i % 7) if i % 3 == 0 else "")).encode() for i in range(300)]
    net = toxicity.train(texts, [int(i % 3 == 0) for i in range(300)], ["en"] * 300, 1 / 3)
    scorer = toxicity.Scorer(net)
    assert scorer.score(b"w1 w2 vileword3 w5") >= 0.5 > scorer.score(b"w1 w2 w5 w9")
    docs = odd(spark, rows)
    got = toxicity.score(docs, "text", net).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity.score(docs.limit(0), "text", net).count() == 0
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.draw_training(docs, labels, "doc_id", "text", "lang", "toxic")[1] == [1]
    assert 0 <= toxicity.Scorer(toxicity.train([], [], [], 0.0)).score(None) <= 1


def test_toxicity_learns_every_language():
    r = random.Random(4)
    words = {k: [f"{chr(97 + k)}{r.randint(100, 999)}w" for _ in range(30)] for k in range(13)}
    rows = [(k, n % 2, " ".join(r.choices(words[k], k=8)) + (" vile" if n % 2 else " calm")) for k in range(12) for n in range(200 - k)] + [(12, 0, " ".join(words[12]))] * 3
    net = toxicity.train([t.encode() for _, _, t in rows], [y for _, y, _ in rows], [f"l{k}" for k, _, _ in rows], 0.5, epochs=1)
    assert set(net.languages) == {f"l{k}" for k in range(12)} | {toxicity.OTHERS} and "l11" in net.cuts and toxicity.OTHERS not in net.cuts
    guess = toxicity.Scorer(net).logit_and_language
    assert [guess(" ".join(words[k][:6]).encode())[1] for k in (0, 11, 12)] == ["l0", "l11", toxicity.OTHERS]
    assert guess(b"zzz unseen qqq")[1] is None


def test_lm_odd_rows(spark, rows):
    docs = odd(spark, rows)
    small = interpolated_lm.score(docs, "text", F.col("doc_id") > 5, ["doc_id"], min_count=2, block_tokens=500)
    whole = interpolated_lm.score(docs, "text", F.col("doc_id") > 5, ["doc_id"], min_count=2)
    key = lambda r: (r["doc"]["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4))
    got = sorted(map(key, small.collect()))
    assert got == sorted(map(key, whole.collect())) and len(got) == len(rows)  # blocks do not matter
    assert all(np.isfinite(x[4]) and x[4] <= 0 for x in got)
    assert interpolated_lm.score(docs, "text", F.lit(False)).where("n_known > 0 or base_score <> 0").count() == 0
    assert interpolated_lm.score(docs.limit(0), "text", F.lit(True)).count() == 0


def test_lm_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, "a b a c" if i % 2 else "b b d") for i in range(40)] + [(100 + i, w) for i, w in enumerate(["a", "b", "c", "d", "zz", ""])], "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r["score"] for r in interpolated_lm.score(docs, "text", F.col("doc_id") < 100, ["doc_id"], min_count=1).collect()}
    assert all(-20 < v < 0 for v in got.values()) and got[100] > got[104]


def test_lm_counts_bigrams_of_rare_words(spark):
    rows = [(i, "new york" if i < 5 else f"some words {i % 7}", "t") for i in range(40)] + [(50, "new york", "h"), (51, "york new", "h")]
    docs = spark.createDataFrame(rows, "id long, text string, part string")
    found = {r["doc"]["id"]: r["score"] for r in interpolated_lm.score(docs, "text", F.col("part") == "t").collect()}
    assert found[50] > found[51] + 0.5


def test_em_prefers_the_better_estimate():
    weights = interpolated_lm.learn_weights([(3, 40, 4, 90.0), (3, -999, 4, 10.0), (0, -999, 8, 5.0)])
    assert weights[3][0] > 0.7 and weights[0][0] < 1e-6 and sum(weights[3]) == pytest.approx(1)


def brute_knn(rows, k):
    clean = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: min(x for j, x in clean if j == i) for i, _ in clean if i % 10 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "group_queries": 2, "block_rows": 7}, {"pivots": 40, "group_queries": 1}])
def test_knn_equals_plain(spark, options):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=6).round(3).tolist()) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(300, None), (310, [1.0, None]), (320, [float("nan")] * 6), (330, [float("inf")] * 6), (None, [1.0] * 6), (340, []), (350, [2.0]), (350, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, rank array<double>").withColumnRenamed("id", "vec_id")
    got = voronoi_knn.top_k(df, "vec_id", "rank", F.col("id") % 10 == 0, k=4, **options)
    assert {tuple(x) for x in got.collect()} == brute_knn(rows, 4)
    assert voronoi_knn.top_k(df.limit(0), "vec_id", "rank", F.col("id") % 10 == 0).count() == 0


def test_secrets_odd_rows(spark, rows):
    own, common = "deadbeef" * 4, "0123456789abcdef" * 2
    texts = [*rows, (20, f"é password = '{own}' AKIA{'Q' * 16}!"), (21, f"key {common}"), (22, f"é {common}"), (23, f"{common}"), (24, "token: abc token=abcdef")]
    docs = odd(spark, texts).withColumn("source", F.concat(F.lit("s"), F.coalesce("doc_id", F.lit(0)).cast("string")))
    found = secret_scan.scan(docs, "doc_id", "text", F.col("source"), F.col("source")).collect()
    assert len(found) == len(texts)
    by = {r["id"]: [(s["kind"], s["start"], s["end"], s["live"]) for s in r["found"]] for r in found}
    assert by[20] == [("assign", 2, 46, True), ("hex", 14, 46, True), ("access", 48, 68, True)]
    assert by[21] == [("hex", 4, 36, False)] and by[24] == [("assign", 11, 23, True)] and by[1] == []
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, "doc_id", "text", F.col("source"), F.col("source")).collect()}
    assert red[20] == "é [SECRET]' [SECRET]!" and red[22] == "é [EXAMPLE KEY]" and red[1] is None and red[5] == "one"
    assert secret_scan.scan(docs.limit(0), "doc_id", "text", F.col("source"), F.col("source")).count() == 0


def test_packing_odd_rows(spark, rows):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(odd(spark, rows), "text", ["doc_id"], path, window=64, open_windows=3).collect()
    sizes = {}
    for p in pieces:
        sizes[p["sequence_id"]] = sizes.get(p["sequence_id"], 0) + p["length"]
        assert len(p["ids"]) == 4 * p["length"]
    assert set(sizes.values()) <= {1, 2, 4, 8, 16, 32, 64}
    assert sum(p["doc_tokens"] for p in pieces if p["start"] == 0) == sum(sizes.values()) and sum(p["start"] == 0 for p in pieces) == len(rows)
    assert packing.pack(odd(spark, rows).limit(0), "text", ["doc_id"], path).count() == 0


def test_cached_tokenizer_equals_plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Don't  STOP now\x1c!", "á é\n<|endoftext|>x 12a3", "ΣΑΣ ΟΔΟΣ\tİ", "", "日本 語 テスト"]
    plain = Tokenizer.from_file(path)
    for t, ids in zip(texts, packing.CachedTokenizer(path).encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]


def test_plain_words_are_cut_once_for_all_their_signs(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["thatndor", "\u00c9nvile", "ci\u00f3n", "don'till", "o'S", "x</w>", "12a3"]
    texts = [f"{sign}{w}{sign} {w.upper()}{sign}" for w in words for sign in ("", ",", ".", "$$$", ".***", "'", "<|")]
    plain, tokenizer, parts = Tokenizer.from_file(path), packing.CachedTokenizer(path), []
    assert tokenizer.parts is not None
    encode = tokenizer._parts
    monkeypatch.setattr(tokenizer, "_parts", lambda these: parts.extend(these) or encode(these))
    for whole in ("_alone", "_together"):
        monkeypatch.setattr(tokenizer, whole, lambda these: pytest.fail(f"{these} went through the whole tokenizer"))
    for t, ids in zip(texts, tokenizer.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2], t
    assert {b"thatndor", "\u00e9nvile".encode(), b"ill", b".***"} <= set(parts) and parts.count(b"thatndor") <= 2


def test_added_tokens_are_found_before_folding():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["A <|ENDOFTEXT|> b", "x<|EndOfText|>'S <|endoftext|>", None, "Plain <|", "\u00d7\u00c9\u00f7 e\u0301 <|startoftext|>A"]
    plain = Tokenizer.from_file(path)
    for most in (packing.KNOWN_WORDS, 4):
        tokenizer = packing.CachedTokenizer(path, most)
        for some in (texts, texts[::-1], []):
            got = [np.frombuffer(ids, "<u4").tolist() for ids in tokenizer.encode([t and t.encode() for t in some])]
            assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in some]


def test_near_duplicates_odd_rows(spark, rows):
    docs = odd(spark, rows)
    got = dart_minhash.near_duplicates(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    classes = sorted((r["id"] or -1, r["class_id"] or -1, r["class_size"]) for r in got)
    assert (8, 7, 2) in classes and classes.count((11, 11, 3)) == 3 and (1, 1, 3) in classes
    kept = dart_minhash.keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns and kept.count() == len({c for _, c, _ in classes}) == sum(r["keeps"] for r in got)
    assert dart_minhash.near_duplicates(docs.limit(0), "doc_id", "text").count() == 0


def test_signature_agrees_as_weighted_jaccard():
    r = np.random.default_rng(1)
    agree, true = [], []
    for _ in range(60):
        e = r.integers(0, 2**63, 120, dtype=np.uint64)
        one, other = r.integers(1, 9, 120).astype(float), r.integers(1, 9, 120).astype(float)
        a, b = dart_minhash.signatures(np.concatenate([e, e]), np.concatenate([one, other]), np.array([120, 120]), 64)
        agree.append((a == b).mean())
        true.append(np.minimum(one, other).sum() / np.maximum(one, other).sum())
    assert np.mean(agree) == pytest.approx(np.mean(true), abs=0.03)


def test_bucket_blocks_lose_no_link():
    r = np.random.default_rng(2)
    base = np.sort(r.choice(2**31, 60, replace=False)).astype(np.uint32)
    sets = [np.unique(np.concatenate([base[r.random(60) > 0.08], r.integers(2**31, 2**32, 3).astype(np.uint32)])) for _ in range(40)]
    links = dart_minhash.joining_links(sets, list(range(40)), None)
    name = list(range(40))
    for a, b in links:
        assert dart_minhash.similar(sets[a], sets[b])
        name = [name[a] if x == name[b] else x for x in name]
    for a in range(40):
        for b in range(a):
            assert not dart_minhash.similar(sets[a], sets[b]) or name[a] == name[b]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in (200, 201, 202)}}


def test_texts_of_marks_are_not_drawn(spark):
    marks = [("en", "!?; " * (i % 7 + 1) + "-" * i) for i in range(300)] + [("en", "some words"), ("de", "ein paar"), ("zz", "..."), ("é", "é")]
    found = language_id.learn(spark.createDataFrame(marks, "lang string, text string"), "lang", "text")
    assert dict(found) == {"en": b"some words", "de": b"ein paar", "é": "é".encode()}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """No sample is drawn, every row that is not judged by is counted, and neither files nor tasks change the network."""
    monkeypatch.setattr(toxicity, "draw_training", None)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 100)
    docs = spark.range(400).selectExpr("id doc_id", "concat('word', id % 7, IF(id % 4 = 0, ' rude', ' kind'), ' only', id) text", "'en' lang")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) toxic")
    net = toxicity.fit(docs, labels, "doc_id", "text", "lang", "toxic")
    again = toxicity.fit(docs.repartition(7, "text"), labels.repartition(3), "doc_id", "text", "lang", "toxic")
    assert np.array_equal(net.table, again.table) and net.cuts == again.cuts and net.bias == again.bias
    scorer = toxicity.Scorer(net)
    assert scorer.score(b"word1 rude only9") > 0.5 > scorer.score(b"word1 kind only9")
    seen = [net.known_words[toxicity.units(f"only{i}".encode())[0]] for i in range(400)]
    assert 280 < sum(seen) < 320
