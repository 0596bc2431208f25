"""Chat formatting by schema fingerprint.

Prompt, instruction and message records reach a corpus in many JSON layouts. The nested field paths of a record,
whatever the order of its keys and the types of its values, are hashed to a fingerprint; the fingerprint selects a
declarative mapping, and the mapping alone says where turns, roles and texts are. Canonical turns are rendered by a
template whose control strings are escaped inside roles and texts, so that the formatted text can be split again.

Everything here is a column expression. Defined results: a null or missing text is an empty text, a null role an empty
role; a record that is null, no JSON or of no known fingerprint gets a null ``layout`` and null turns and stays in the
output; a record has no limit of size below a row's two gigabytes, but a single turn above 128 MiB is an error; a record with an empty list of turns is formatted as an empty text; repeated records stay repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this and of other common chat templates. No text may contain them unescaped.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_OPEN = r"(<\|(?:im_start|im_sep|im_end|endoftext)\||</?s|\[/?INST|<</?SYS>)"
_CLOSE = r"(\\*)([>\]])"
TURNS = "array<struct<role:string,text:string>>"
#: Bytes from which on a record may exceed what one variant holds (128 MiB, strings of 20,000,000 characters).
LARGE_BYTES = 20_000_000
_NO_LIMIT = {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)}
_SCALAR = r"(?:STRING|VOID|VARIANT|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\s*\d+\))"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``paths``: the nested field paths of the layout, ``[]`` for the elements of a list. Either ``turns`` is the path of a
    list whose elements hold ``role`` and ``text``, or ``fixed`` lists (role, path) in the order of the turns.
    ``aliases`` renames roles to canonical ones.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()


_HUMAN = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", aliases=_HUMAN),
    Mapping("instruction", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("system_instruction", ("system", "instruction", "output"), fixed=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
)


def shape_of_paths(paths: tuple[str, ...]) -> str:
    """The nested form of field paths, keys in binary order, as ``shape_of_record`` states it."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})

    def nested(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{nested(node['[]'])}>" if node["[]"] else "ARRAY"
        if not node:
            return ""
        return "OBJECT<" + ", ".join(k + (f": {nested(v)}" if v else "") for k, v in sorted(node.items())) + ">"

    return nested(tree)


def shape_of_record(record: Column) -> Column:
    """The nested field paths of a JSON text, without value types; null for what is no JSON."""
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), rf": {_SCALAR}(?=[,>])", "")
    return F.regexp_replace(shape, f"ARRAY<{_SCALAR}>", "ARRAY")


def fingerprint(shape: Column) -> Column:
    return F.xxhash64(shape)


def _string(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _mapped(value: Column, m: Mapping) -> Column:
    if m.fixed:
        return F.array(*[F.struct(F.lit(role).alias("role"), _string(value, f"$.{path}").alias("text")) for role, path in m.fixed])
    return _turns_of(F.try_variant_get(value, f"$.{m.turns}", "array<variant>"), m)


def _turns_of(items: Column, m: Mapping) -> Column:
    def turn(item: Column) -> Column:
        role = _string(item, f"$.{m.role}")
        for old, new in m.aliases:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), _string(item, f"$.{m.text}").alias("text"))

    return F.transform(items, turn)


def _is_scalar(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(f"^{_SCALAR}$"), F.lit(True))


def _large(record: Column, m: Mapping) -> tuple[Column, Column]:
    """(whether a large record has the layout's paths, its turns), by a variant for each turn instead of one for the record.

    A turn that no variant can hold is an error, not a null.
    """
    keys = sorted({path.split(".")[0].removesuffix("[]") for path in m.paths})
    fits = F.array_sort(F.json_object_keys(record)) == F.array(*map(F.lit, keys))
    if m.fixed:
        if any("." in path or "[]" in path for path in m.paths):
            return fits, F.raise_error(F.lit(f"a record of more than {LARGE_BYTES} bytes in the nested layout {m.name}")).cast(TURNS)
        read = F.from_json(record, "struct<" + ",".join(f"`{k}`:variant" for k in keys) + ">", _NO_LIMIT)
        for k in keys:
            fits = F.when(fits, _is_scalar(read[k]))
        return fits, F.array(*[F.struct(F.lit(role).alias("role"), _string(read[path], "$").alias("text")) for role, path in m.fixed])
    inner = sorted(path.removeprefix(f"{m.turns}[].") for path in m.paths)
    if keys != [m.turns] or any("." in path or "[]" in path for path in inner):
        return fits, F.raise_error(F.lit(f"a record of more than {LARGE_BYTES} bytes in the nested layout {m.name}")).cast(TURNS)
    listed = F.json_array_length(F.from_json(record, f"struct<`{m.turns}`:string>", _NO_LIMIT)[m.turns]).isNotNull()
    items = F.from_json(record, f"struct<`{m.turns}`:array<variant>>", _NO_LIMIT)[m.turns]
    # A null among the turns says nothing about their paths; turns may lack a path that others have.
    told = F.filter(items, lambda v: ~F.coalesce(F.is_variant_null(v), F.lit(True)))
    fields = F.transform(told, lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
    plain = F.forall(fields, lambda f: f.isNotNull() & F.forall(F.map_values(f), _is_scalar))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(fields, F.map_keys))))
    fits = F.when(F.when(fits, listed), plain & (found == F.array(*map(F.lit, inner))))
    return fits, _turns_of(items, m)


def canonical_turns(records: DataFrame, id_column: str, record_column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, fingerprint, layout, turns) for records of JSON text; ``layout`` is null where no mapping has the fingerprint.

    Records of LARGE_BYTES and more are compared with the mappings path by path; of no known layout, their fingerprint is null.
    """
    rows = records.select(F.col(id_column).alias("id"), F.col(record_column).alias("record"))
    large = F.octet_length("record") >= LARGE_BYTES
    known, none = F.lit(None).cast("long"), F.lit(None).cast("string")
    for m in mappings:
        known = F.when(F.coalesce(_large(F.col("record"), m)[0], F.lit(False)), fingerprint(F.lit(shape_of_paths(m.paths)))).otherwise(known)
    marked = F.when(large, known).otherwise(fingerprint(shape_of_record(F.when(~large, F.col("record")))))
    rows = rows.select("id", F.when(large, F.col("record")).alias("large"), F.try_parse_json(F.when(~large, F.col("record"))).alias("value"), marked.alias("fingerprint"))
    layout, turns = none, F.lit(None).cast(TURNS)
    for m in mappings:
        chosen = F.col("fingerprint") == fingerprint(F.lit(shape_of_paths(m.paths)))
        layout = F.when(chosen, F.lit(m.name)).otherwise(layout)
        turns = F.when(chosen & F.col("large").isNotNull(), _large(F.col("large"), m)[1]).when(chosen, _mapped(F.col("value"), m)).otherwise(turns)
    return rows.select("id", "fingerprint", layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """Add one backslash before the last character of each control string, however many stand there already."""
    return F.regexp_replace(text, _OPEN + _CLOSE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\" + _CLOSE, "$1$2$3")


def render(canonical: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, layout, formatted, loss_runs): the formatted text and its loss mask in code points.

    ``loss_runs`` has one (skip, keep) for each turn: that many code points of the turn, end marker not counted,
    stand outside and then under the mask.
    """
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("head"), escape(t["text"]).alias("body")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["head"], F.lit(SEP), t["body"], F.lit(END))), "")

    def run(t: Column) -> Column:
        head = F.length(t["head"]) + len(START) + len(SEP)
        under = t["role"].isin(*loss_roles)
        body = F.length(t["body"])
        return F.struct(F.when(under, head).otherwise(head + body).alias("skip"), F.when(under, body).otherwise(0).alias("keep"))

    shown = canonical.select("id", "layout", turns.alias("turns"))
    return shown.select("id", "layout", text.alias("formatted"), F.transform("turns", run).alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to ``render``'s rows the turns and the unescaped texts under the mask, both read from the formatted text."""
    pieces = F.split("formatted", r"<\|im_end\|>", -1)
    rows = formatted.withColumn("piece", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(piece: Column) -> Column:
        at = F.locate(SEP, piece)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(START) + 1), at - 1 - len(START))).alias("role"),
            unescape(F.substring(piece, at + len(SEP), F.length(piece))).alias("text"),
        )

    def masked(piece: Column, run: Column) -> Column:
        return unescape(F.substring(piece, run["skip"] + 1, run["keep"]))

    return rows.select(
        "id", "layout", "formatted", "loss_runs",
        F.transform("piece", turn).alias("turns"), F.zip_with("piece", "loss_runs", masked).alias("loss_texts"),
    )


def records_of_rows(rows: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """Turn rows as (id, record): one JSON record for each conversation, in the layout that its turns suggest.

    Two turns user and assistant are an instruction record, three with a system turn first a system instruction; longer
    ones are a list of messages, or under the other usual names where the id's hash is odd. Turns follow their number,
    equal numbers role and text; rows with null ids are one conversation with a null id.
    """
    rows = rows.select(
        F.col(id_column).alias("id"),
        F.struct(
            F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        ).alias("t"),
    )
    told = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles, text = F.col("t.role"), lambda i: F.get("t", F.lit(i))["text"]
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    renamed = F.transform(
        "t",
        lambda t: F.struct(
            F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")
        ),
    )
    usual = F.forall("t", lambda t: t["role"].isin("user", "assistant", "system"))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(
            roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
            F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))),
        )
        .when(usual & (F.pmod(F.xxhash64("id"), F.lit(2)) == 1), F.to_json(F.struct(renamed.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return told.select("id", record.alias("record"))


def digests(read: DataFrame) -> DataFrame:
    """One row of digests for each record read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
