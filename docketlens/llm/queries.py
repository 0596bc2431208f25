"""The registered queries of this folder: thin, each gets its rows through its operator. SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.llm import (
    chat_format, dart_minhash, decontaminate, interpolated_lm, language_id, merkle, packing, secret_scan, sharding, suffix_dedup,
    toxicity, turn_repair, voronoi_knn,
)
from docketlens.llm.common import UPPER, crc_class, table


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    records = chat_format.records_of_rows(turns.unionByName(added), "conv_id", "turn", "role", "text")
    read = chat_format.read_back(chat_format.render(chat_format.canonical_turns(records, "id", "record")))
    return chat_format.digests(read).withColumnRenamed("id", "conv_id")


_CONTROL_SQL = r"(<\|(im_start|im_sep|im_end|endoftext)\|\\*>|</?s\\*>|\[/?INST\\*\]|<</?SYS>\\*>)"
OP1_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), marked AS (
  SELECT *, len(regexp_extract_all(role, '{_CONTROL_SQL}')) + len(regexp_extract_all(text, '{_CONTROL_SQL}')) AS escapes FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + escapes + {len(chat_format.START + chat_format.SEP + chat_format.END)})::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), "text", table(spark, folder, "benchmark"), carry=["doc_id"])
    n_hit, contaminated = decontaminate.hits(found)
    return found.select(
        "doc.doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"),
    )


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS_SQL} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, w[i : i + least({decontaminate.WINDOW}, len(w)) - 1] AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {decontaminate.WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(g) AS n FROM phrases))
), found AS (SELECT doc_id, i, n, item_id FROM places JOIN phrases USING (g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (crc_class("doc_id", 5) == 0).alias("held_out"))
    dictionaries = language_id.learn(docs.where("not held_out"), "lang", "text")
    found = language_id.identify(docs, "text", dictionaries, carry=["doc_id", "held_out"])
    return found.select("doc.doc_id", "doc.held_out", "lang_pred", "score", "rejected")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"), "text", ["doc_id"])
    return cut.select(
        "doc.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (crc_class("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, folder, "labels").where(crc_class("doc_id", 5) != 0)
    network = toxicity.fit(docs.where("not held_out"), labels, "doc_id", "text", "lang", "toxic")
    found = toxicity.score(docs, "text", network, carry=["doc_id", "held_out"])
    return found.select("doc.doc_id", "doc.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (crc_class("doc_id", 7) == 2).alias("held_out"))
    found = interpolated_lm.score(docs, "text", ~F.col("held_out"), carry=["doc_id", "held_out"])
    return found.select("doc.doc_id", "doc.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_voronoi_knn(spark: SparkSession, folder: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


OP7_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM valid q JOIN valid d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secret_scan.scan(docs, "doc_id", "text", repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind_no"] < len(secret_scan.BASE))
    return found.select(
        F.col("id").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secret_scan.written_spans(base), 256).alias("base_sha256"), secret_scan.written_spans(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def _kind_sql(number: int, kind: str, pattern: str, condition: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS kind_no, '{kind}' AS kind, m, e - length(m) AS s, e FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1),
        lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))) AS e
      FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms, string_split_regex(text, '{quoted}') AS gaps FROM docs WHERE regexp_matches(text, '{quoted}'))
    ) WHERE {condition}"""


OP8_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (
  {_kind_sql(0, "assign", secret_scan.ASSIGN, "length(regexp_extract(m, '" + secret_scan.ASSIGN.replace("'", "''") + "', 2)) >= 6")}
  UNION ALL {_kind_sql(1, "access", secret_scan.ACCESS, "length(m) >= 20")}
  UNION ALL {_kind_sql(2, "hex", secret_scan.HEX.replace("+", "{24,}"), "true")}
  UNION ALL {_kind_sql(3, "opaque", secret_scan.OPAQUE, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')")}
), owned AS (
  SELECT s.m, count(DISTINCT coalesce(d.source, '')) AS owners FROM spans s JOIN documents d USING (doc_id) GROUP BY s.m
), judged AS (
  SELECT s.*, o.owners < {secret_scan.EXAMPLE_OWNERS} AS live,
    kind_no < 3 OR (o.owners < {secret_scan.EXAMPLE_OWNERS} AND NOT EXISTS (
      SELECT 1 FROM spans b WHERE b.doc_id = s.doc_id AND b.kind_no < 3 AND b.s < s.e AND s.s < b.e)) AS stays
  FROM spans s JOIN owned o ON o.m = s.m
), told AS (
  SELECT doc_id,
    count(*) FILTER (kind_no = 0) AS a, count(*) FILTER (kind_no = 1) AS k, count(*) FILTER (kind_no = 2) AS h,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind_no) FILTER (kind_no < 3) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind_no) AS every,
    count(*) FILTER (live) AS n_live
  FROM judged WHERE stays GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN told USING (doc_id)
"""

def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, folder, "documents"), "text", ["doc_id"], path, with_ids=False).select(
        "doc.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = dart_minhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.col("keeps").alias("kept"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(crc_class("doc_id", 3) == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    found = merkle.manifest(docs, F.col("lang"), fields, [*fields[:-1], tampered], "doc_id")
    return found.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc_step(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ 0xEDB88320 * (value & 1)
    return value


_CRC_TABLE = [_crc_step(i) for i in range(256)]


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text."""
    codes = f"list_transform(regexp_extract_all({text}, '.'), lambda c: ascii(c)::UBIGINT)"
    step = f"xor(c >> 8, ({_CRC_TABLE}::UBIGINT[])[(xor(c, b) & 255)::INT + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {step}), 4294967295::UBIGINT)"


#: Levels of a tree that the SQL below climbs at most; enough for 8^9 leaves.
_SQL_LEVELS = 9


def _climb_sql(start: str) -> str:
    """CTEs up0..: (tree, pos, h) of the nodes at each level, s0..: the siblings of a node and its run. A tree's root stays as it is."""
    parts = [f"{start}up0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {start}leaves)"]
    for k in range(_SQL_LEVELS):
        parts.append(f"""{start}up{k + 1} AS (
          SELECT tree, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, pos // 8 AS pos,
            (any_value(n) + 7) // 8 AS n FROM {start}up{k} GROUP BY tree, pos // 8)""")
    return ", ".join(parts)


def _proof_sql(start: str, leaf: str) -> str:
    """CTEs walk0..: for each leaf the proof text so far and the folded digest so far, one level after the other."""
    parts = [f"{start}walk0 AS (SELECT *, pos AS here FROM {leaf})"]
    for k in range(_SQL_LEVELS):
        parts.append(f"""{start}runs{k} AS (
          SELECT tree, pos, n, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS left_side,
            coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS right_side
          FROM {start}up{k} WINDOW r AS (PARTITION BY tree, pos // 8 ORDER BY pos)),
        {start}walk{k + 1} AS (
          SELECT w.* EXCLUDE (proof, folded, here), proof || left_side || right_side AS proof, here // 8 AS here,
            CASE WHEN r.n = 1 THEN folded ELSE sha256(left_side || folded || right_side) END AS folded
          FROM {start}walk{k} w JOIN {start}runs{k} r ON w.tree = r.tree AND w.here = r.pos)""")
    return ", ".join(parts)


_FIELD_SQL = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF_SQL = lambda text: f"sha256({' || '.join(map(_FIELD_SQL, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF_SQL("text")} AS h,
    CASE WHEN {_crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {_LEAF_SQL(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}
      ELSE {_LEAF_SQL("text")} END AS now
  FROM documents
), d_leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM docs),
{_climb_sql("d_")},
t_leaves AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM d_up{_SQL_LEVELS}),
{_climb_sql("t_")},
first AS (SELECT tree, doc_id, h AS leaf, pos, '' AS proof, now AS folded FROM d_leaves),
{_proof_sql("d_", "first")},
second AS (
  SELECT doc_id, leaf, t.h AS subroot, proof, folded, '' AS tree, t.pos FROM d_walk{_SQL_LEVELS} w JOIN t_leaves t ON w.tree = t.name
), {_proof_sql("t_", "second")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM t_walk{_SQL_LEVELS}, (SELECT h FROM t_up{_SQL_LEVELS}) r
"""


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    carry = [F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    found = sharding.assign(table(spark, folder, "documents"), text, carry)
    return found.select("doc.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    damaged = turn_repair.damage(rows, "conv_id", "turn", "role", "text")
    return turn_repair.repair_all(damaged, rows.select(F.col("conv_id").alias("conv"))).withColumnRenamed("conv", "conv_id")


# Plain form of the repair: the least (cost, letters) to each state, row by row, with the repaired lines beside it.
OP13_SQL = rf"""
WITH RECURSIVE cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    ({_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20)::INT AS c
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role,
    CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS again
  FROM cases WHERE c <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged
), judged AS (
  SELECT *, substr(role, 1, 1) AS ini, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS then_ini,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (then_ini IS NOT NULL AND ini || then_ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), steps(st, mid, pre, lines) AS (
  VALUES ('0', '0', '', []::VARCHAR[]), ('0', 'u', 'I', ['user:']), ('0', 'a', 'II', ['user:', 'assistant:']), ('s', 's', '', []), ('s', 'u', 'I', ['user:']),
    ('s', 'a', 'II', ['user:', 'assistant:']), ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']), ('u', 'u', 'II', ['assistant:', 'user:']),
    ('a', 'a', '', []), ('a', 'u', 'I', ['user:']), ('a', 'a', 'II', ['user:', 'assistant:'])
), moves(mid, op, ini, aft, said, price) AS (
  VALUES ('0', 'K', 's', 's', NULL, 0), ('0', 'K', 'u', 'u', NULL, 0), ('s', 'K', 'u', 'u', NULL, 0), ('u', 'K', 'a', 'a', NULL, 0), ('a', 'K', 'u', 'u', NULL, 0),
    ('0', 'R', NULL, 'u', 'user', 2), ('s', 'R', NULL, 'u', 'user', 2), ('u', 'R', NULL, 'a', 'assistant', 2), ('a', 'R', NULL, 'u', 'user', 2),
    ('0', 'D', NULL, '0', NULL, 3), ('s', 'D', NULL, 's', NULL, 3), ('u', 'D', NULL, 'u', NULL, 3), ('a', 'D', NULL, 'a', NULL, 3)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '0' AS st, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM judged
  UNION ALL
  SELECT conv_id, i, st, best.cost, best.audit, best.lines FROM (
    SELECT w.conv_id, r.i, m.aft AS st, min({{
      'cost': w.cost + 2 * length(s.pre)::INT + m.price + (m.op <> 'D' AND r.fault = 'truncated')::INT, 'audit': w.audit || s.pre || m.op,
      'lines': CASE m.op WHEN 'D' THEN w.lines || s.lines ELSE list_append(w.lines || s.lines, coalesce(m.said, r.role) || ':' || r.text) END}}) AS best
    FROM walk w JOIN judged r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1 JOIN steps s ON s.st = w.st
      JOIN moves m ON m.mid = s.mid AND (m.ini IS NULL OR m.ini = r.ini) AND (m.op = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    GROUP BY w.conv_id, r.i, m.aft)
), ended AS (
  SELECT w.conv_id, min({{'cost': w.cost + 2 * length(t.pre)::INT, 'audit': w.audit || t.pre, 'lines': w.lines || t.lines}}) AS best
  FROM walk w JOIN (SELECT DISTINCT conv_id, n FROM judged) c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
    JOIN (VALUES ('0', '', []::VARCHAR[]), ('s', 'II', ['user:', 'assistant:']), ('u', 'I', ['assistant:']), ('a', '', [])) t(st, pre, lines) ON t.st = w.st
  GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_interpolated_lm": op6_interpolated_lm,
    "op7_voronoi_knn": op7_voronoi_knn,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sharding": op12_sharding,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES = {"op1_chat_format": OP1_SQL, "op2_decontaminate": OP2_SQL, "op7_voronoi_knn": OP7_SQL, "op8_secret_scan": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_turn_repair": OP13_SQL}
