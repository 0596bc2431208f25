"""Packing of tokenized documents into training sequences: bounded-space online best-fit.

Each task keeps a fixed number of open windows. A document takes whole windows while it is longer than one; what is left
goes into the open window where it leaves the least room. Where it fits into none, the fullest window is topped up with
the document's next tokens and emitted. The windows that are open at the end of a task are merged over groups of tasks, and
what remains of a group is cut at powers of two, which need no padding.

Defined results: a null or empty text is the end token alone; each token of a document is in exactly one piece; repeated
rows are packed each; no rows give no sequences. Sequences are as long as their tokens: full, or a power of two.
"""

from __future__ import annotations

import codecs
import functools
import json
import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlens.session import written_once

WINDOW = 4096
OPEN_WINDOWS = 16
END_ID = 2
#: Tasks whose open windows are merged together; bounds the rows of a merge.
MERGE_TASKS = 8
#: Entries of a worker's table of known words. It outlives a task; of a full table the words not met for longest go.
KNOWN_WORDS = 1_000_000
#: Stands between words that are encoded together. Its id cuts the result; words that hold it are encoded alone.
SEPARATOR = "\x1f"
#: Words of one such text, and of one call; long texts are slower for each word, and so are single words.
_TOGETHER, _CALL = 512, 20_480
#: Bytes of texts that are looked up together, if they are more than one.
_TEXT_BYTES = 4 << 20
_MERGED = 1 << 62

_CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Settings of a tokenizer whose plain words (printable ASCII and the letters U+00C0 to U+00FF) are cut here, by ``PLAIN_PART``,
#: which is much faster; of any other tokenizer, and for other words, normalizing and cutting are left to the tokenizer.
PLAIN_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _CLASSES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
    "model": {
        "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
    },
}
#: ``_CLASSES`` over the UTF-8 bytes of plain words, where each byte from 0x80 is half a letter; a space stands between words.
PLAIN_PART = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^ a-z0-9\x80-\xff]+| ")
_NOT_PLAIN = rb"[^!-~\x80-\xbf\xc3]|\xc3[\x97\xb7]"
#: Byte table: lower case of the bytes of plain words; U+00C0 to U+00DE end in 0x80 to 0x9E.
_PLAIN_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
#: The character that a byte-level vocabulary has for each byte.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_CHARS = "".join(chr(256 + _HIDDEN.index(b)) if b in _HIDDEN else chr(b) for b in range(256))
#: The same for parts with spaces between them, which stay spaces.
_SPACED_CHARS = BYTE_CHARS[:32] + " " + BYTE_CHARS[33:]
#: Ends a word where the parts of words are laid end to end; no id.
_MARK = b"\xff" * 4


def _cut(ids: np.ndarray, ends: np.ndarray, skip: int) -> list[bytes]:
    """Bytes of the ids up to each place of ``ends``, each run but the first without the ``skip`` ids before it."""
    raw, ends = ids.tobytes(), (4 * ends).tolist()
    return [raw[a:b] for a, b in zip([0, *(e + 4 * skip for e in ends[:-1])], ends, strict=True)]


def _rules(tokenizer) -> dict:
    """The settings that ``PLAIN_RULES`` names; its model's are of byte-pair encoding."""
    steps = {n: getattr(tokenizer, n) for n in ("normalizer", "pre_tokenizer")}
    return {
        **{n: step and json.loads(step.__getstate__()) for n, step in steps.items()},
        **{n: getattr(tokenizer, n) for n in ("post_processor", "truncation", "padding")},
        "model": {n: getattr(tokenizer.model, n, "") for n in PLAIN_RULES["model"]},
    }


class CachedTokenizer:
    """Ids of whole texts. No token of the tokenizer spans ASCII white space, so texts are encoded by the strings
    between it, and strings that were met before are looked up.

    Words met lately are in ``known``, those before them in ``older``: when ``known`` holds half of what the table may, it becomes
    ``older``, and what is met again moves back. New plain words are cut into parts (``PLAIN_RULES``), which the tokenizer's
    model encodes as words of their own; other new words go to the tokenizer many at a time, as one text with separators.
    """

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        cut = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.cut = cut[0] if len(cut) == 1 else None
        # A tokenizer that folds A-Z knows a word in any case.
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.folds = all(ids(word) == ids(word.lower()) for word in (*string.ascii_uppercase, string.ascii_uppercase, "aBc"))
        # Added tokens are found in a text as it is, before it is folded.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.not_plain = re.compile(b"|".join([_NOT_PLAIN, *map(re.escape, self.added)]))
        self.parts = None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if _rules(self.tokenizer) == PLAIN_RULES and all(c in vocabulary and c + "</w>" in vocabulary for c in BYTE_CHARS):
            self.parts = Tokenizer(self.tokenizer.model)
            self.parts.pre_tokenizer = CharDelimiterSplit(" ")
            self.is_end = np.zeros(1 + max(vocabulary.values()), bool)
            self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _alone(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _together(self, words: list[bytes]) -> list[bytes]:
        glue = f" {SEPARATOR} ".encode()
        texts = [glue.join(words[at : at + _TOGETHER]).decode() for at in range(0, len(words), _TOGETHER)]
        out = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            out += _cut(ids, np.append(np.flatnonzero(ids == self.cut), len(ids)), 1)
        return out

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        texts = [b" ".join(parts[at : at + _TOGETHER]) for at in range(0, len(parts), _TOGETHER)]
        texts = [codecs.charmap_decode(t, "strict", _SPACED_CHARS)[0] for t in texts]
        out = []
        for e in self.parts.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            out += _cut(ids, np.flatnonzero(self.is_end[ids]) + 1, 0)
        return out

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words, by those of their parts. A part alone is cut as in its word, so a known word may serve."""
        parts = PLAIN_PART.findall(b" ".join(words).translate(_PLAIN_LOWER))
        table = {w: self.known.get(w) or self.older.get(w) for w in set(parts).difference((b" ",))}
        new = [w for w, ids in table.items() if ids is None]
        table.update(zip(new, self._parts(new), strict=True))
        table[b" "] = _MARK
        ids = np.frombuffer(b"".join([*map(table.__getitem__, parts), _MARK]), "<u4")
        return _cut(ids, np.flatnonzero(ids == 0xFFFFFFFF), 1)

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each in the way that it needs."""
        mark, ways = SEPARATOR.encode(), {self._parts: [], self._plain: [], self._together: [], self._alone: []}
        one_part, plain, together, alone = ways.values()
        for w in words:
            if self.parts and not self.not_plain.search(w):
                (one_part if w.isalpha() and w.islower() else plain).append(w)
            else:
                (alone if self.cut is None or mark in w else together).append(w)
        out: dict[bytes, bytes] = {}
        for encode, these in ways.items():
            if these:
                out.update(zip(these, encode(these), strict=True))
        return [out[w] for w in words]

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, which ``known`` holds from then on."""
        if self.older:
            self.known.update([(w, self.older[w]) for w in words if w not in self.known and w in self.older])
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), _CALL):
            part = new[at : at + _CALL]
            self.known.update(zip(part, self._learn(part), strict=True))
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: pa.Array | list[bytes | None], end_id: int = END_ID) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (UTF-8), with the end id."""
        end = np.array([end_id], dtype="<u4").tobytes()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).view(pa.string())
        if self.folds:
            lower = pc.ascii_lower(texts)
            for added in self.added:
                found = pc.match_substring(lower, added)
                lower = pc.if_else(found, texts, lower) if pc.any(found).as_py() else lower
            texts = lower
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        different = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if 2 * len(self.known) > self.most:
            self.known, self.older = {}, self.known
        self.known[b""] = b""
        ids = self._look_up(different)
        at, counts = words.indices.to_numpy(), pc.fill_null(pc.list_value_length(split), 0).to_numpy()
        cuts = np.append(0, np.cumsum(counts)).tolist()
        return [b"".join(map(ids.__getitem__, at[a:b].tolist())) + end for a, b in zip(cuts, cuts[1:])]


@functools.cache
def worker_tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of this worker process, with its known words."""
    return CachedTokenizer(path)


class Packer:
    """Open windows as lists of (document, start, ids); emitted ones go to ``closed``."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.most = window, open_windows
        self.open: list[tuple[int, list]] = []
        self.closed: list[list] = []

    def add(self, document, ids: bytes) -> None:
        start, total = 0, len(ids) // 4
        while total - start >= self.window:
            self.closed.append([(document, start, ids[4 * start : 4 * (start + self.window)])])
            start += self.window
        while start < total:
            rest = total - start
            fits = [(self.window - fill, k) for k, (fill, _) in enumerate(self.open) if self.window - fill >= rest]
            if fits:
                k, take = min(fits)[1], rest
            elif len(self.open) < self.most:
                self.open.append((0, []))
                k, take = len(self.open) - 1, rest
            else:
                k = max(range(len(self.open)), key=lambda i: self.open[i][0])
                take = self.window - self.open[k][0]
            fill, pieces = self.open[k]
            pieces.append((document, start, ids[4 * start : 4 * (start + take)]))
            start += take
            if fill + take == self.window:
                self.closed.append(pieces)
                del self.open[k]
            else:
                self.open[k] = (fill + take, pieces)


PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])
_ARROW_PIECE = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def _columns(windows: list[tuple[int, list]], with_ids: bool) -> tuple[list, list[list]]:
    """(documents, columns of PIECE) of numbered windows; a piece's document is (values, total tokens)."""
    documents, columns = [], [[] for _ in _ARROW_PIECE]
    for number, pieces in windows:
        offset = 0
        for (values, total), start, ids in pieces:
            length = len(ids) // 4
            documents.append(values)
            row = (start, length, zlib.crc32(ids), total, number, offset, ids if with_ids else None)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += length
    return documents, columns


def _batch(windows: list[tuple[int, list]], with_ids: bool, doc_type: pa.DataType, more: dict) -> pa.RecordBatch:
    documents, columns = _columns(windows, with_ids)
    arrays = [pa.array(documents, doc_type), *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW_PIECE, strict=True))]
    names = ["doc", *(n for n, _ in _ARROW_PIECE)]
    for name, (value, kind) in more.items():
        names.append(name)
        arrays.append(pa.array([value] * len(documents), kind))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _powers(pieces: list, length: int) -> list[list]:
    """Cuts pieces of together ``length`` tokens into lists of a power of two tokens each, longest first."""
    out, pieces = [], list(pieces)
    for bit in reversed(range(length.bit_length())):
        room = length & (1 << bit)
        taken = []
        while room:
            document, start, ids = pieces.pop(0)
            if len(ids) > 4 * room:
                pieces.insert(0, (document, start + room, ids[4 * room :]))
                ids = ids[: 4 * room]
            taken.append((document, start, ids))
            room -= len(ids) // 4
        if taken:
            out.append(taken)
    return out


def merge_windows(windows: list[list], window: int = WINDOW) -> list[list]:
    """Fills windows from the fullest on; the last, not full one is cut at powers of two."""
    size = lambda pieces: sum(len(p[2]) for p in pieces) // 4
    packer = Packer(window, 1)
    for pieces in sorted(windows, key=size, reverse=True):
        for document, start, ids in pieces:
            at = 0
            while at < len(ids):
                fill = packer.open[0][0] if packer.open else 0
                part = ids[at : at + 4 * (window - fill)]
                held = packer.open.pop()[1] if packer.open else []
                held.append((document, start + at // 4, part))
                if fill + len(part) // 4 == window:
                    packer.closed.append(held)
                else:
                    packer.open.append((fill + len(part) // 4, held))
                at += len(part)
    return packer.closed + [p for fill, pieces in packer.open for p in _powers(pieces, fill)]


def pack(
    docs: DataFrame, text_column: str, carry: list[str], tokenizer_path: str, window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row for each piece of a document.

    ``doc`` holds the columns ``carry``. ``ids`` are little-endian unsigned 32-bit ids, null if ``with_ids`` is false.
    The tokenizer's file must be at ``tokenizer_path`` on every machine. The first pass is written once: its closed
    windows are results, its open ones go on to the merge.
    """
    rows = docs.select(F.struct(*carry).alias("doc"), F.col(text_column).alias("text"))
    doc_field = rows.schema["doc"]
    first = T.StructType([doc_field, *PIECE, T.StructField("task", T.LongType()), T.StructField("closed", T.BooleanType())])

    def run(batches):
        task = TaskContext.get().partitionId()
        tokenizer, packer, number, doc_type = worker_tokenizer(tokenizer_path), Packer(window, open_windows), 0, None
        for batch in batches:
            doc_type = batch.column("doc").type
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64), 0
            while at < batch.num_rows:
                most = _TEXT_BYTES + (ends[at - 1] if at else 0)
                part = batch.slice(at, max(1, int(np.searchsorted(ends, most, "right")) - at))
                at += part.num_rows
                values = part.column("doc").to_pylist()
                for value, ids in zip(values, tokenizer.encode(part.column("text"), end_id), strict=True):
                    packer.add((value, len(ids) // 4), ids)
                done = [((task << 32) + number + i, w) for i, w in enumerate(packer.closed)]
                number += len(done)
                packer.closed = []
                if done:
                    yield _batch(done, with_ids, doc_type, {"task": (task, pa.int64()), "closed": (True, pa.bool_())})
        # The worker lives on, beside those of other operators.
        pa.default_memory_pool().release_unused()
        if packer.open:
            left = [((task << 32) + number + i, pieces) for i, (_, pieces) in enumerate(packer.open)]
            yield _batch(left, True, doc_type, {"task": (task, pa.int64()), "closed": (False, pa.bool_())})

    pieces = written_once(rows.mapInArrow(run, first), "packed-pieces")
    last = T.StructType([doc_field, *PIECE])

    def merge(key, part):
        held: dict[int, list] = {}
        for r in sorted(part.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"])):
            held.setdefault(r["sequence_id"], []).append(((r["doc"], r["doc_tokens"]), r["start"], r["ids"]))
        base = _MERGED + (key[0].as_py() << 24)
        merged = [(base + i, w) for i, w in enumerate(merge_windows(list(held.values()), window))]
        return pa.Table.from_batches([_batch(merged, with_ids, part.schema.field("doc").type, {})])

    names = ["doc", *(f.name for f in PIECE)]
    left = pieces.where("not closed").withColumn("merge_group", F.floor(F.col("task") / MERGE_TASKS))
    merged = left.groupBy("merge_group").applyInArrow(merge, last)
    return pieces.where("closed").select(*names).unionByName(merged)
