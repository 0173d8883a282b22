"""Byte-level BPE encoding and decoding with forced boundaries.

A merge can only join two bytes that stand side by side inside some vocabulary
token. A byte pair that no token contains is therefore a certain cut: what lies
left and right of it can be encoded independently and concatenated. The table of
such pairs is built from the vocabulary and used twice:

* between words: if no token holds a visible character's last byte before a space,
  text is cut before each single space that stands between two of them. The
  pre-tokenizer also never looks across such a place, so fragments repeat like
  words do and are memoised in a bounded table. ``encode_all`` encodes the short
  ones that are new to it together, in one call, and takes them apart at these cuts;
* inside the pre-tokens of a fragment encoded alone: at every pair the table rules out.

Results equal those of the ``tokenizers`` library for the same file with
``add_special_tokens=False``; added tokens that occur literally in a text become
their ids, as there.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache
from itertools import filterfalse, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import arrow_schema, rowwise
from .vocab import BYTE_BPE

#: Fixed value: the pre-tokenizer pattern that byte-level vocabularies are built with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fragments that are remembered, and the longest one that is.
MEMO_ENTRIES = 400_000
MEMO_CHARS = 48
#: Characters of texts whose new fragments are encoded together; a longer text stands alone.
GROUP_CHARS = 1 << 20


def printable_bytes() -> dict[str, int]:
    """The characters that byte-level vocabulary files write bytes with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _visible_before_space(token: bytes) -> bool:
    """Whether a token holds a visible character, or part of one, before a space."""
    spaces = [i for i in range(1, len(token)) if token[i] == 0x20]
    return any(not token[:i].decode("utf-8", "replace")[-1].isspace() for i in spaces)


class _Split(Exception):
    """A part whose edges are white space: the places around it are no certain cuts."""


class _Memo(dict):
    def __init__(self, coder: "ForcedBoundaryBPE", lead: str):
        super().__init__()
        self.coder, self.lead = coder, lead

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Split
        ids = self.coder.fragment(self.lead + part)
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[part] = ids
        return ids


class ForcedBoundaryBPE:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str = BYTE_BPE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        as_byte = printable_bytes()
        raw = {bytes(as_byte[c] for c in t): i for t, i in model["vocab"].items()}
        self.ids: dict[bytes, int] = raw
        made = [raw[bytes(as_byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("merge order and ids differ; this vocabulary can't be ranked by id")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.core = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=raw, special_tokens={})._core_bpe
        self.size = 1 + max([*raw.values(), *self.added.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for b, i in raw.items():
            self.bytes_of[i] = b
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        #: inside[x, y]: some token holds byte x directly before byte y.
        self.inside = np.zeros((256, 256), dtype=bool)
        for b in raw:
            if len(b) > 1:
                v = np.frombuffer(b, np.uint8)
                self.inside[v[:-1], v[1:]] = True
        self.word_cuts = not any(_visible_before_space(b) for b in raw)
        self.absent = {(x, y) for x, y in np.argwhere(~self.inside).tolist()}
        self.pattern = regex.compile(PATTERN)
        self.first, self.inner = _Memo(self, ""), _Memo(self, " ")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _pieces(self, token: bytes) -> list[bytes]:
        """A pre-token's bytes, cut at every pair that no vocabulary token holds."""
        absent, at, out = self.absent, 0, []
        for i, pair in enumerate(zip(token, token[1:], strict=False), 1):
            if pair in absent:
                out.append(token[at:i])
                at = i
        out.append(token[at:])
        return out

    def fragment(self, text: str) -> bytes:
        """Ids of one fragment, as little-endian unsigned 32-bit integers."""
        ids, known, encode = [], self.ids, self.core.encode_single_piece
        for token in self.pattern.findall(text):
            b = token.encode()
            if (i := known.get(b)) is not None:
                ids.append(i)
                continue
            for piece in self._pieces(b):
                if (i := known.get(piece)) is not None:
                    ids.append(i)
                else:
                    ids.extend(encode(piece))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, rows: list[list[str]]) -> None:
        """Memoise the fragments of split texts that are new, from one call: between certain cuts each has the ids it has alone."""
        inner = self.inner

        def new() -> list[str]:
            parts = set()
            for row in rows:
                parts.update(filterfalse(inner.__contains__, islice(row, 1, None)))
            return [w for w in parts if w and len(w) <= MEMO_CHARS and not w[0].isspace() and not w[-1].isspace()]

        words = new()
        if len(inner) + len(words) > MEMO_ENTRIES:
            inner.clear()
            words = new()[:MEMO_ENTRIES]  # what is left is encoded one by one, as it is met
        if not words:
            return
        ids = np.frombuffer(self.core.encode_to_tiktoken_buffer(" " + " ".join(words), set()), np.uint32)
        stops = np.cumsum(np.fromiter((1 + len(w.encode()) for w in words), np.int64, len(words)))
        ends = np.cumsum(self.lengths[ids])
        at = np.searchsorted(ends, stops)
        if not np.array_equal(ends[at], stops):
            raise AssertionError("a token lies across a certain cut")
        packed = ids.astype("<u4").tobytes()
        inner.update(zip(words, (packed[a:b] for a, b in pairwise([0, *(4 * at + 4).tolist()])), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """What ``encode`` gives for each of the texts."""
        if not self.word_cuts:
            return list(map(self.encode, texts))
        out, at = [], 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= GROUP_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            rows = [t.split(" ") if t and not self._marked(t) else [] for t in texts[at:stop]]
            self._learn(rows)
            out += [self._plain(t, row) if row else self.encode(t) for t, row in zip(texts[at:stop], rows, strict=True)]
            at = stop
        return out

    def _marked(self, text: str) -> bool:
        return self.marks is not None and any(m in text for m in self.added)

    def _plain(self, text: str, parts: list[str] | None = None) -> bytes:
        if not self.word_cuts:
            return self.fragment(text)
        head, *rest = parts or text.split(" ")
        try:
            if not rest:
                return self.fragment(text)
            return self.first[head] + b"".join(map(self.inner.__getitem__, rest))
        except _Split:
            pass
        out, held = [], head
        for part in rest:
            if held and part and not held[-1].isspace() and not part[0].isspace():
                out.append(self.fragment(held))
                held = " " + part
            else:
                held += " " + part
        out.append(self.fragment(held))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: empty), as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self._marked(text):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ForcedBoundaryBPE:
    """One coder per worker process and file, with its memo."""
    return ForcedBoundaryBPE(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """Encode every text. Returns (``id_col``, ids binary), one row per input row.

    ``ids`` packs the token ids as little-endian unsigned 32-bit integers. A null
    or empty text gives an empty ``ids``; repeated rows and null ids are kept as
    they are; other columns are left out, so their names can't clash; an empty
    table gives an empty table. One narrow pass: no shuffle, and a worker holds
    one small slice of rows and a memo of bounded size.
    """
    kind = df.schema[id_col].dataType
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        c = coder(vocabulary)
        body = lambda part: {"k": part.column(0), "ids": [c.encode(t) for t in part.column(1).to_pylist()]}
        for batch in batches:
            yield from rowwise(body, arrow_schema([("k", batch.schema.field(0).type), ("ids", pa.binary())]))(iter([batch]))

    return src.mapInArrow(run, f"k {kind.simpleString()}, ids binary").select(F.col("k").alias(id_col), "ids")


def decode_ids(df: DataFrame, ids_col: str = "ids", vocabulary: str = BYTE_BPE, text_col: str = "decoded") -> DataFrame:
    """Append ``text_col``, the text of packed ids, to ``df`` (null ids: empty text).

    A column of ``df`` that already has the new name is replaced.
    """
    src = df.drop(text_col) if text_col != ids_col else df
    at = src.columns.index(ids_col)

    def run(batches):
        c = coder(vocabulary)
        for batch in batches:
            for part in _small(batch):
                text = pa.array([c.decode(x or b"") for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, text_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(text_col, T.StringType())]))


def _small(batch: pa.RecordBatch):
    from .arrow import slices

    return slices(iter([batch]))
