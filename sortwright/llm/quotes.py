"""Quotation linking: conversations in reply order, without the quotes.

A message's lines are parsed into own text and quotes with their level (the number
of leading ``>``). Passages are hashed, normalised: each quoted line, and each sentence
of a run of quoted lines whatever its line breaks, so that a quote which was wrapped
anew, or one sentence of a long line, is still found. Hashes are joined, within their
conversation, to the latest earlier message that has the passage as its own text. The
message from which most words are quoted at level one is the parent.

Replies are ordered by an Euler tour of the trees of parents: each message is entered
and left, every such step knows the one before it, and pointer jumping along them gives
its thread, depth and place. A step is the predecessor of one other, so no key of these
joins is hot. Prefix counts over a range-partitioned sort then give positions, so a
conversation that holds a third of all rows is spread over many tasks throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import discard, stage
from .arrow import arrow_schema, slices

#: Turns that are searched at once for a line's latest earlier occurrence.
SPAN = 1024

_QUOTE = regex.compile(r"^[ \t]*+((?:>[ \t]?+)+)")
#: Lines that introduce a quote in mail and forum software.
_INTRO = regex.compile(r"^[ \t]*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)[ \t]?:[ \t]*$", regex.I)
_SENTENCE = regex.compile(r"(?<=[.!?…。！？])[ ]+")


def normalised(line: str) -> str:
    """A line as it is compared: case folded, white space runs as one space."""
    return " ".join(line.casefold().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text of a message, and its quoted lines with their levels; a blank line, or own text, is (0, "") between them."""
    own: list[str] = []
    quoted: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        if not m:
            own.append(line)
            quoted.append((0, ""))
            continue
        while own and not own[-1].strip():
            own.pop()
        if own and _INTRO.match(own[-1]):
            own.pop()
        rest = line[m.end() :]
        quoted.append((m[1].count(">"), rest) if rest.strip() else (0, ""))
    return "\n".join(own).strip(), quoted


def sentences(lines: list[str]) -> list[tuple[str, int, int]]:
    """Sentences of adjoining lines, normalised, each with the first and last line it lies in."""
    words = [normalised(x) for x in lines]
    ends = np.cumsum([len(w) + 1 for w in words])
    out, at = [], 0
    for s in _SENTENCE.split(" ".join(words)):
        if s:
            first, last = np.searchsorted(ends, [at, at + len(s) - 1], side="right")
            out.append((s, int(first), int(last)))
        at += len(s) + 1
    return out


def _runs(lines: list[tuple[int, str]]):
    """Adjoining lines of equal level above 0 as (level, index of the first, lines)."""
    start = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or lines[i][0] != lines[start][0]:
            if lines[start][0] > 0:
                yield lines[start][0], start, [x for _, x in lines[start:i]]
            start = i


def own_passages(body: str) -> set[str]:
    """Lines and sentences of a message's own text, normalised."""
    found = {normalised(x) for x in body.split("\n") if x.strip()}
    for _, _, lines in _runs([(1 if x.strip() else 0, x) for x in body.split("\n")]):
        found.update(s for s, _, _ in sentences(lines))
    return found


def quoted_passages(quoted: list[tuple[int, str]]) -> list[tuple[int, int, int, str]]:
    """(level, line, its words, passage) of quoted lines: the line itself, and the sentences it has a part of."""
    out = []
    for level, start, lines in _runs(quoted):
        words = [len(x.split()) for x in lines]
        found = {(i, normalised(x)) for i, x in enumerate(lines)}
        found |= {(i, s) for s, first, last in sentences(lines) for i in range(first, last + 1)}
        out += [(level, start + i, words[i], p) for i, p in sorted(found)]
    return out


def _hash(passage: str) -> int:
    return xxhash.xxh3_64_intdigest(passage) - (1 << 63)


def _passages(messages: DataFrame) -> DataFrame:
    """One row a passage: (conv, turn, level, line, words, h); level 0 is own text."""
    schema = arrow_schema([("conv", pa.int64()), ("turn", pa.int64()), ("level", pa.int32()), ("line", pa.int32()), ("words", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for rows in slices(batches):
            out = []
            for conv, turn, text in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                own, quoted = parse(text)
                out += [(conv, turn, 0, None, None, h) for h in {_hash(x) for x in own_passages(own)}]
                out += [(conv, turn, level, line, words, _hash(x)) for level, line, words, x in quoted_passages(quoted)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return messages.select("conv", "turn", "text").mapInArrow(run, "conv long, turn long, level int, line int, words int, h long")


def _earlier(rows: DataFrame, keys: list[str], own: DataFrame) -> DataFrame:
    """Rows (keys, turn, ...) with ``before``: the latest turn of ``own`` (keys, turn) below theirs, or null.

    Turns are looked at by spans: a window holds the turns of one span, and another one
    row a span, so no group of one key is sorted whole.
    """
    span = F.floor(F.col("turn") / SPAN).cast("long")
    marks = own.select(*keys, "turn").distinct().withColumn("span", span)
    asked = rows.withColumn("span", span)
    both = asked.withColumn("own", F.lit(0)).unionByName(marks.withColumn("own", F.lit(1)), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys, "span").orderBy("turn", "own").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("own") == 1, F.col("turn"))).over(earlier)).where("own = 0").drop("own")
    spans = marks.groupBy(*keys, "span").agg(F.max("turn").alias("last"))
    steps = asked.select(*keys, "span").distinct().join(spans, [*keys, "span"], "full_outer")
    far = steps.withColumn("far", F.max("last").over(Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "span", "far")
    found = near.join(far, [*keys, "span"], "left")
    return found.withColumn("before", F.coalesce("near", "far")).drop("near", "far", "span")


def _origins(passages: DataFrame) -> DataFrame:
    """(conv, turn, level, line, words, origin): for each quoted line the latest earlier turn that has one of its passages."""
    quoted = passages.where("level > 0")
    own = passages.where("level = 0").join(quoted.select("conv", "h").distinct(), ["conv", "h"], "left_semi").select("conv", "h", "turn")
    found = _earlier(quoted, ["conv", "h"], own)
    return found.groupBy("conv", "turn", "level", "line", "words").agg(F.max("before").alias("origin"))


def _tours(parents: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth, place) of all messages in trees of (conv, turn, parent); place is the order of entering."""
    nodes = parents.unionByName(parents.select("conv", F.col("parent").alias("turn")).distinct().join(parents.select("conv", "turn"), ["conv", "turn"], "left_anti").withColumn("parent", F.lit(None).cast("long")))
    nodes = stage(nodes, "nodes")
    # A child is entered after its parent is, or after the child before it is left; left after its last child is, or after it is entered.
    children = nodes.where("parent is not null")
    after = _earlier(children, ["conv", "parent"], children).withColumnRenamed("before", "sibling")
    last = children.groupBy("conv", F.col("parent").alias("turn")).agg(F.max("turn").alias("child"))
    enter = after.select("conv", "turn", F.lit(True).alias("enter"), F.coalesce("sibling", "parent").alias("up"), F.col("sibling").isNull().alias("up_enter"))
    roots = nodes.where("parent is null").select("conv", "turn", F.lit(True).alias("enter"), F.lit(None).cast("long").alias("up"), F.lit(None).cast("boolean").alias("up_enter"))
    leave = nodes.join(last, ["conv", "turn"], "left").select("conv", "turn", F.lit(False).alias("enter"), F.coalesce("child", "turn").alias("up"), F.col("child").isNull().alias("up_enter"))
    steps = enter.unionByName(roots).unionByName(leave)
    # Up to a step: steps that enter, and how far down; head is the turn of the tour's first step, once reached.
    one = F.when(F.col("enter"), 1)
    now = stage(steps.select("conv", "turn", "enter", "up", "up_enter", one.otherwise(0).cast("long").alias("place"), one.otherwise(-1).cast("long").alias("depth"), F.when(F.col("up").isNull(), F.col("turn")).alias("head")), "steps")
    while not now.where("up is not null").isEmpty():
        far = now.select("conv", F.col("turn").alias("up"), F.col("enter").alias("up_enter"), F.col("up").alias("up2"), F.col("up_enter").alias("enter2"), F.col("place").alias("place2"), F.col("depth").alias("depth2"), F.col("head").alias("head2"))
        moved = now.where("up is not null").join(far, ["conv", "up", "up_enter"])
        moved = moved.select("conv", "turn", "enter", F.col("up2").alias("up"), F.col("enter2").alias("up_enter"), (F.col("place") + F.col("place2")).alias("place"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("head2").alias("head"))
        before, now = now, stage(now.where("up is null").unionByName(moved), "steps")
        discard(before)
    return now.where("enter").select("conv", "turn", F.col("head").alias("thread"), (F.col("depth") - 1).cast("int").alias("depth"), "place")


def _positions(rows: DataFrame) -> DataFrame:
    """Add position, counted from 0 in each conversation in order (thread, place, body)."""
    schema_text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index("conv")
    dealt = rows.repartitionByRange("conv", "thread", "place", "body").sortWithinPartitions("conv", "thread", "place", "body")

    def count(batches):
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in slices(batches):
            local = []
            for conv in batch.column(at).to_pylist():
                n = n + 1 if conv == last else 0
                last = conv
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(local), part, np.int32)), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"])

    counted = stage(dealt.mapInArrow(count, f"{schema_text}, part int, local long"), "ordered")
    sizes = counted.groupBy("conv", "part").agg((F.max("local") + 1).alias("size"))
    # A conversation has a row for each range it reaches into; most have one.
    base = F.coalesce(F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.withColumn("base", base).where("base > 0").select(F.col("conv").alias("c"), F.col("part").alias("p"), "base")
    joined = counted.join(bases, counted["conv"].eqNullSafe(bases["c"]) & (counted["part"] == bases["p"]), "left")
    return joined.withColumn("position", F.col("local") + F.coalesce("base", F.lit(0))).drop("part", "local", "c", "p", "base")


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Link quotes to their messages and put conversations in reply order.

    Returns conv_id, turn, role, body (the text without quotes), quoted (number of
    quoted lines), linked (those of which a passage is found in an earlier message of the
    conversation), parent (turn of the message most words are quoted from at level one;
    ties: the latest), thread (first turn of its chain of parents), depth (links to it),
    position (place in the conversation, from 0: threads by their first turn, in each a
    message, then its replies by turn, each followed by its own) and formatted (role
    line, body, end line: concatenated by position they are the conversation). One row
    per input row.

    A null text is empty; a null role is written as an empty one. Rows whose
    conversation or turn is null link with nothing; null turns come first. Rows that
    repeat a turn are kept, in order of their text, and count as one message for links.
    Texts of any length are read whole. Other columns are left out; an empty table gives
    an empty table.
    """
    src = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    found = stage(_origins(_passages(src.where("conv is not null and turn is not null"))), "origins")
    votes = found.where("level = 1 and origin is not null").groupBy("conv", "turn", "origin").agg(F.sum("words").alias("n"))
    parents = stage(votes.groupBy("conv", "turn").agg(F.max(F.struct("n", "origin"))["origin"].alias("parent")), "parents")
    counts = found.groupBy("conv", "turn").agg(F.count("origin").alias("linked"))
    facts = counts.join(_tours(parents), ["conv", "turn"], "full_outer").join(parents, ["conv", "turn"], "left")

    def bodies(batches):
        schema = arrow_schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("quoted", pa.int64())])
        for rows in slices(batches):
            parsed = [parse(t) for t in rows.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(i).cast(schema.field(i).type) for i in range(3)), pa.array([b for b, _ in parsed], pa.string()), pa.array([sum(level > 0 for level, _ in q) for _, q in parsed], pa.int64())], schema=schema)

    own = src.mapInArrow(bodies, "conv long, turn long, role string, body string, quoted long")
    full = own.join(facts.select("conv", "turn", "linked", "parent", "thread", "depth", "place"), ["conv", "turn"], "left")
    full = full.select("conv", "turn", "role", "body", "quoted", F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("place", F.lit(1)).alias("place"))
    text = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    return _positions(full).withColumn("formatted", text).withColumnRenamed("conv", conv_col).select(conv_col, "turn", "role", "body", "quoted", "linked", "parent", "thread", "depth", "position", "formatted")
