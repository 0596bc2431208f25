"""Repair of conversation structure by the cheapest edits, ties by the letters of the edits.

Edits keep (K, 0), rerole (R, 2) or delete (D, 3) each row and insert empty rows (I, 2) so that role initials read ``(s?(ua)+)?``. Blank
and repeated rows must go; a truncated row that stays costs 1 more. Every path through a conversation has one integer weight: its high
digits are the cost, and below them each row has a field of three digits for the letters of the inserts before it and of its own edit, left to
right, with zeros behind (D < I < K < R as 1 to 4); the last field is for inserts at the end. An edge adds to the cost and to its own field,
so weights are sums and the least integer of an ordinary shortest-path step is the cheapest repair with the ASCII-least letters.
Letters tell the repaired roles: after them each next role is determined.

Rows get places within their conversation and conversations are cut into blocks of ``BLOCK`` rows, so one of any length is many tasks. A block of
a longer conversation is solved from each state to each state; what a block adds (cost, and the order of its letters among the ends from one
start) is a few numbers, and one step over the blocks of a conversation picks its path. Two different letter strings of a block differ before
either ends, since both end with the edit of its last row, so their order does not depend on what follows.

Defined results: rows of a conversation ascend by turn (nulls first), then role, then the text's first 64 characters and hash; equal rows are
rows, all but the first of them duplicates. A null conversation id is a conversation, a null role or text is one space. The initial of a role is
its first character; a role that is empty has none and cannot be kept. A conversation without rows has no edits. Long texts are only
compared by a 128-bit hash and hashed as they stream by. The audit of a conversation is one string, so conversations are bounded by
what a string holds, 2^31 characters. An empty table has no conversations. Only the columns named are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlens.llm.positions import positions
from docketlens.session import written_once

BLOCK = 1024
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
LETTERS = "DIKR"
FIELD = 9  # bits: three digits of three bits
#: States by what was said last: nothing, system, user, assistant. Ends: nothing or assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Legal steps: the initial that may follow, and the state it leads to. The first of a state is what an insert or rerole says.
NEXT = {START: [("u", USER), ("s", SYSTEM)], SYSTEM: [("u", USER)], USER: [("a", ASSISTANT)], ASSISTANT: [("u", USER)]}
SPOKEN = {"u": "user", "a": "assistant"}


def field(letters: str) -> int:
    """Up to three letters as digits, left to right, with zeros behind."""
    return int("".join(str(LETTERS.index(c) + 1) for c in letters).ljust(FIELD // 3, "0"), 8)


def letters_of(number: int, fields: int) -> str:
    """The letters in the low ``fields`` fields of a weight."""
    digits = f"{number & ((1 << FIELD * fields) - 1):0{FIELD // 3 * fields}o}"
    return "".join(LETTERS[int(d) - 1] for d in digits if d != "0")


@functools.cache
def edges(code: str) -> list[list[tuple[int, int, int]]]:
    """For each state before a row: (state behind it, cost, field). ``code`` is the row's initial, in capitals if truncated, or ``-`` if it must go."""
    out = []
    more = TRUNCATED if code.isupper() else 0
    for state in NEXT:
        best: dict[int, tuple[int, int]] = {state: (DELETE, field("D"))}
        before = state
        for inserts in range(FIELD // 3):
            if code != "-":
                for k, (initial, after) in enumerate(NEXT[before]):
                    found = [(INSERT * inserts + REROLE + more, field("I" * inserts + "R"))] if k == 0 else []
                    if initial == code.lower():
                        found.append((INSERT * inserts + KEEP + more, field("I" * inserts + "K")))
                    best.update({after: min([*found, *([best[after]] if after in best else [])])} if found else {})
            before = NEXT[before][0][1]
        out.append([(after, cost, digits) for after, (cost, digits) in best.items()])
    return out


def _tail(state: int) -> tuple[int, int]:
    """(cost, field) of the inserts that end a conversation after its last row."""
    inserts = 0
    while state not in ENDS:
        state, inserts = NEXT[state][0][1], inserts + 1
    return INSERT * inserts, field("I" * inserts)


def paths(codes: str, start: int) -> list[int | None]:
    """The least weight of a path over rows ``codes`` from ``start`` to each state; the field of inserts at the end is left at zero."""
    top = FIELD * (len(codes) + 1)
    best: list[int | None] = [0 if s == start else None for s in NEXT]
    for i, code in enumerate(codes):
        shift, after = FIELD * (len(codes) - i), [None] * len(NEXT)
        for state, weight in enumerate(best):
            if weight is not None:
                for to, cost, digits in edges(code)[state]:
                    now = weight + (cost << top) + (digits << shift)
                    if after[to] is None or now < after[to]:
                        after[to] = now
        best = after
    return best


def solve(codes: str) -> tuple[int, str]:
    """(cost, letters) of the cheapest repair of a whole conversation."""
    top = FIELD * (len(codes) + 1)
    ended = [w + (_tail(s)[0] << top) + _tail(s)[1] for s, w in enumerate(paths(codes, START)) if w is not None]
    weight = min(ended)
    return weight >> top, letters_of(weight, len(codes) + 1)


def choose(blocks: list[dict[tuple[int, int], tuple[int, int]]]) -> list[tuple[int, int]]:
    """The (state before, state behind) of each block on the least path; blocks tell (cost, rank of letters) of their ways."""
    rest = {s: _tail(s)[0] for s in NEXT}  # the least cost from each state on
    best: list[dict[int, int]] = []
    for ways in reversed(blocks):
        options: dict[int, tuple] = {}
        for (start, end), (cost, rank) in ways.items():
            options[start] = min(options.get(start, (float("inf"),)), (cost + rest[end], rank, end))
        rest, taken = {s: o[0] for s, o in options.items()}, {s: o[2] for s, o in options.items()}
        best.append(taken)
    state, out = START, []
    for taken in reversed(best):
        out.append((state, taken[state]))
        state = taken[state]
    return out


def damage(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text): rows dropped, emptied, stripped of end marks, repeated or given to the user, by the CRC-32 of ``conv:turn``."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")), F.lit(20))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), told(role).alias("role"), told(text).alias("text"), case.alias("case")).where("case <> 0")
    now = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")
    return rows.select("conv", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), now.alias("text"), times).drop("time")


def _text_key() -> list[Column]:
    return [F.xxhash64(F.lit(1), "role", "text").alias("ha"), F.xxhash64(F.lit(2), "text", "role").alias("hb")]


def _codes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault`` (blank, duplicate, truncated or null) and ``code``."""
    seen = rows.groupBy("conv", "ha", "hb").agg(F.min("pos").alias("first_pos")).withColumnsRenamed({"conv": "c", "ha": "a", "hb": "b"})
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("ha") == F.col("a")) & (F.col("hb") == F.col("b")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("pos") > F.col("first_pos"), "duplicate").when(~ended, "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.withColumn("fault", fault).withColumn("code", code).drop("c", "a", "b", "first_pos")


_WAY = "conv {0}, block long, blocks long, start int, end int, cost long, rank int, letters string"


def _ways(blocks: DataFrame, conv_type: str) -> DataFrame:
    """Each block's least way from each state to each state; a conversation of one block has only its solution."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for r in batch.select(["block", "blocks", "codes"]).to_pylist():
                codes, found = r["codes"], []
                if r["blocks"] == 1:
                    cost, letters = solve(codes)
                    found.append((START, None, cost, 0, letters))
                else:
                    top = FIELD * (len(codes) + 1)
                    for start in NEXT:
                        ways = sorted((w & ((1 << top) - 1), end, w >> top) for end, w in enumerate(paths(codes, start)) if w is not None)
                        found += [(start, end, cost, rank, letters_of(low, len(codes) + 1)) for rank, (low, end, cost) in enumerate(ways)]
                rows.append(found)
            index = pa.array([i for i, found in enumerate(rows) for _ in found], pa.int64())
            columns = list(zip(*(way for found in rows for way in found))) or [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
            arrays = [batch.column(c).take(index) for c in ("conv", "block", "blocks")] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "block", "blocks", "start", "end", "cost", "rank", "letters"])

    return blocks.mapInArrow(run, _WAY.format(conv_type))


def _picked(ways: DataFrame, conv_type: str) -> DataFrame:
    """(conv, block, start, end) on the least path, for conversations of several blocks."""

    def pick(key, rows):
        blocks: list[dict] = []
        for r in rows.sort_by("block").select(["block", "start", "end", "cost", "rank"]).to_pylist():
            while len(blocks) <= r["block"]:
                blocks.append({})
            blocks[r["block"]][r["start"], r["end"]] = (r["cost"], r["rank"])
        chosen = choose(blocks)
        columns = [pa.array([key[0].as_py()] * len(chosen), rows.schema.field("conv").type), pa.array(range(len(chosen)), pa.int64())]
        return pa.table([*columns, *(pa.array(c, pa.int32()) for c in zip(*chosen))], names=["conv", "block", "start", "end"])

    several = ways.where("blocks > 1").select("conv", "block", "start", "end", "cost", "rank")
    return several.groupBy("conv").applyInArrow(pick, f"conv {conv_type}, block long, start int, end int")


_SUMMARY = "conv {0}, gaps long, blank long, duplicate long, truncated long, illegal long, repaired_sha256 string"
_LEGAL = ("su", "ua", "au")


class _Summary:
    """What a conversation's rows, met in order, come to."""

    def __init__(self):
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.initial = 0, None
        self.hash, self.lines, self.state = hashlib.sha256(), 0, START

    def say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def insert(self, times: int) -> None:
        for _ in range(times):
            initial, self.state = NEXT[self.state][0]
            self.say(SPOKEN[initial], "")

    def add(self, turn, role: str, text: str, fault: str | None, edit: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns, self.first_turn, self.last_turn = self.turns + 1, turn if self.first_turn is None else self.first_turn, turn
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in _LEGAL
        self.initial = initial
        own = edit.strip("I")
        self.insert(edit.index(own))
        if own == "R":
            initial, self.state = NEXT[self.state][0]
            self.say(SPOKEN[initial], text)
        elif own == "K":
            self.state = dict(NEXT[self.state])[initial]
            self.say(role, text)
        self.insert(len(edit) - edit.index(own) - 1)

    def row(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, self.hash.hexdigest()


def _summaries(rows: DataFrame, conv_type: str) -> DataFrame:
    """One row for each conversation of ``rows`` (conv, turn, role, text, fault, edit, pos), which stream by in order."""
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "pos")

    def run(batches: Iterator[pa.RecordBatch]):
        held, conv, conv_arrow = None, None, None
        done, convs = [], []

        def sent():
            arrays = [pa.array(c, t) for c, t in zip(zip(*done), [*[pa.int64()] * 5, pa.string()])]
            return pa.RecordBatch.from_arrays([pa.array(convs, conv_arrow), *arrays], names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "repaired_sha256"])

        for batch in batches:
            conv_arrow = batch.schema.field("conv").type
            values = [batch.column(c).to_pylist() for c in ("conv", "pos", "turn", "role", "text", "fault", "edit")]
            for now, pos, *rest in zip(*values, strict=True):
                if held is None or pos == 0:
                    if held is not None:
                        done.append(held.row())
                        convs.append(conv)
                    held, conv = _Summary(), now
                held.add(*rest)
            if len(done) >= 1000:
                yield sent()
                done.clear(), convs.clear()
        if held is not None:
            done.append(held.row())
            convs.append(conv)
        if done:
            yield sent()

    return dealt.select("conv", "pos", "turn", "role", "text", "fault", "edit").mapInArrow(run, _SUMMARY.format(conv_type))


def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``rows`` (conv, turn, role, text)."""
    said = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    said = said.select("*", F.substring("text", 1, 64).alias("head"), *_text_key())
    placed = written_once(_codes(positions(said, "conv", ["turn", "role", "head", "ha", "hb"], "repair").drop("head")), "repair-coded")
    conv_type = placed.schema["conv"].dataType.simpleString()
    block = F.floor(F.col("pos") / BLOCK)
    coded = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"]), "")
    blocks = placed.groupBy("conv", block.alias("block")).agg(F.ceil(F.first("of_key") / BLOCK).alias("blocks"), coded.alias("codes"))
    ways = written_once(_ways(blocks, conv_type), "repair-ways")
    picked = _picked(ways, conv_type).withColumnsRenamed({"conv": "c", "block": "b", "start": "s", "end": "e"})
    several = ways.where("blocks > 1").join(
        picked, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e"))
    )
    last = F.when(F.col("block") == F.col("blocks") - 1, F.col("end")).otherwise(-1)
    tails = F.coalesce(*[F.when(last == s, F.struct(F.lit(_tail(s)[0]).alias("cost"), F.lit(letters_of(_tail(s)[1], 1)).alias("letters"))) for s in NEXT],
                       F.struct(F.lit(0).alias("cost"), F.lit("").alias("letters")))
    several = several.select("conv", "block", (F.col("cost") + tails["cost"]).alias("cost"), F.concat("letters", tails["letters"]).alias("letters"))
    solved = written_once(ways.where("blocks = 1").select("conv", "block", "cost", "letters").unionByName(several), "repair-solved")
    # The letters of each row: the inserts before it and its own; those at the end go with the last row.
    each = F.regexp_extract_all("letters", F.lit(r"(I*[DKR](?:I+$)?)"), F.lit(1))
    edits = solved.select(F.col("conv").alias("c"), "block", F.posexplode(each).alias("i", "edit"))
    edits = edits.select("c", (F.col("block") * BLOCK + F.col("i")).alias("p"), "edit")
    edited = placed.join(edits, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")))
    summaries = _summaries(edited, conv_type).withColumnRenamed("conv", "c")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda s: s["letters"]), "")
    audits = solved.groupBy("conv").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    return audits.join(summaries, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def repair_all(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``repair`` with a row for every distinct ``conv`` of ``convs``, those without rows too."""
    found = repair(rows).withColumnRenamed("conv", "c")
    every = convs.select("conv").distinct().join(found, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = F.lit(hashlib.sha256().hexdigest())
    return every.select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
