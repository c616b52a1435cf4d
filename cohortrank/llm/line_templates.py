"""Line dedup by a tree of line templates of fixed depth.

A line goes down the tree by its number of tokens; a token with a digit is a variable field and counts as '<*>'.
At the leaf the line stands for its exact template and, if it has at least WILD_TOKENS tokens, for wider ones that
each leave some of its eight blocks of tokens open, the leading tokens being part of the first: any one block, from
LONG_TOKENS tokens on any two. Lines of one template so agree in number of tokens and, but for the leading ones, in
at least three quarters of their places.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.llm.common import filtered, free_name, materialise, slices, small_batches

#: Lines of fewer tokens count only where short lines are asked for; leading tokens beside the eighths; tokens from
#: which one block opens, and two.
MIN_TOKENS, DEPTH, WILD_TOKENS, LONG_TOKENS = 5, 2, 6, 12
BLOCKS = 8
#: How many blocks may open, and the hashes of the blocks.
PACKED = struct.Struct("<b8q")
#: The blocks that are left open, and three groups of blocks of which any such choice leaves one untouched.
OPEN = {n: list(itertools.combinations(range(BLOCKS), n)) for n in (1, 2)}
GROUPS = [(0, 1, 2), (3, 4, 5), (6, 7)]
VARIABLE = re.compile(rb"\S*[0-9]\S*")


def number(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)


def parse(line: bytes, short: bool = False) -> tuple[int, bytes | None] | None:
    """The code of a line's exact template, and its PACKED blocks if these may vary; None for a blank line and, unless
    short, for one of under MIN_TOKENS tokens."""
    if any(d in line for d in b"0123456789"):
        line = VARIABLE.sub(b"<*>", line)
    tokens = line.split()
    n = len(tokens)
    if n < (1 if short else MIN_TOKENS):
        return None
    head = b"%d\0" % n
    exact = number(head + b" ".join(tokens))
    if n < WILD_TOKENS:
        return exact, None
    cut = [0, *(DEPTH + (n - DEPTH) * k // BLOCKS for k in range(1, BLOCKS + 1))]
    blocks = [number(b"%d\0%s%s" % (k, head, b" ".join(tokens[a:b]))) for k, (a, b) in enumerate(itertools.pairwise(cut))]
    return exact, PACKED.pack(2 if n >= LONG_TOKENS else 1, *blocks)


def wide(packed: bytes) -> list[int]:
    """Codes of the templates that leave blocks open."""
    n, *blocks = PACKED.unpack(packed)
    return [number(struct.pack("<8q", *(0 if k in some else x for k, x in enumerate(blocks)))) for some in OPEN[n]]


def templates(line: bytes, short: bool = False) -> list[int]:
    """Signed 64-bit codes of the templates that a line stands for, the exact one first; none where parse() has none."""
    found = parse(line, short)
    return [] if found is None else [found[0], *(wide(found[1]) if found[1] else [])]


def line_table(docs: DataFrame, id_col: str, text_col: str, short: bool = False) -> DataFrame:
    """One row for each line that has templates: _id, number of the line, code of its exact template, its blocks."""
    small_batches(docs)
    own = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, numbers, codes, blocks = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for i, x in enumerate((text or "").encode().split(b"\n")):
                    if (found := parse(x, short)) is not None:
                        rows.append(row)
                        numbers.append(i)
                        codes.append(found[0])
                        blocks.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(codes, pa.int64()), pa.array(blocks, pa.binary())],
                ["_id", "number", "code", "blocks"],
            )

    schema = T.StructType([T.StructField("_id", own), T.StructField("number", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("blocks", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def wide_codes(lines: DataFrame) -> DataFrame:
    """For each row of code, first, blocks: one row per wide template, with its code as wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(map(wide, batch.column(2).to_pylist()))
            at = pa.array(np.repeat(np.arange(batch.num_rows, dtype=np.int32), [len(own) for own in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x for own in found for x in own], pa.int64())], ["code", "first", "wide"])

    return lines.select("code", "first", "blocks").mapInArrow(run, T.StructType([lines.schema["code"], lines.schema["first"], T.StructField("wide", T.LongType())]))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """Lines to drop: _id and dropped (line numbers), for the documents that have any.

    A template recurs if lines of at least two documents stand for it. Its lines stay in the document of
    smallest id and are dropped from the others. Rows of one id are one document.
    """
    held = materialise(line_table(docs, id_col, text_col, short).where(F.col("_id").isNotNull()), "lines")
    # each distinct line once, in its document of smallest id: the others go by their exact template
    distinct = materialise(held.groupBy("code").agg(F.min("_id").alias("first"), F.max("_id").alias("_last"), F.first("blocks").alias("blocks")), "templates")
    # two lines of one wide template share a group of blocks, so only lines that share one need wide codes
    group = F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("blocks", 8 * g[0] + 2, 8 * len(g))) for k, g in enumerate(GROUPS)))).alias("group")
    grouped = distinct.where("blocks IS NOT NULL").select("code", "first", "blocks", group)
    met = grouped.groupBy("group").agg(F.min("code").alias("_a"), F.max("code").alias("_b")).where("_a < _b").select("group")
    near = grouped.join(met, "group", "left_semi").dropDuplicates(["code"])
    wider = materialise(wide_codes(near), "wide")
    earliest = wider.groupBy("wide").agg(F.min("first").alias("first"), F.max("first").alias("_last")).where("first < _last").select("wide", F.col("first").alias("_first"))
    limits = wider.join(earliest, "wide").where("_first < first").groupBy("code").agg(F.min("_first").alias("_first"))
    going = distinct.join(limits, "code", "left").select("code", "_last", F.coalesce("_first", "first").alias("_first")).where("_last > _first").select("code", "_first")
    lines = held.select("_id", "number", "code").join(going, "code").where(F.col("_id") > F.col("_first"))
    return lines.groupBy("_id").agg(F.collect_set("number").alias("dropped"), F.collect_set("code").alias("dropped_codes"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, report: bool = False, short: bool = False, emptied: bool = True) -> DataFrame:
    """Drop lines of recurring templates; one row per input row, all columns stay.

    length_col, if given, becomes the length of the new text where lines were dropped. With report, _lines and
    _dropped (numbers of lines before, and of those dropped) are added; docs must have no such columns then, other
    columns may have any name. With short, lines of fewer than MIN_TOKENS tokens recur by their exact template, else
    they stay. Blank lines and repeats within one document stay. Without emptied, rows that had words and have none left go:
    what they said stands in the documents that kept their lines. Null texts stay null, and rows with a null id are left
    as they are. Texts of any length are taken whole. Of documents only those that lose a line cross the shuffle. An
    empty table gives no rows.
    """
    small_batches(docs)
    gone = materialise(recurring_lines(docs, id_col, text_col, short), "gone")
    names, own_name = docs.columns, free_name(docs, "_gone")
    keys, report_as = gone.select(F.col("_id").alias(id_col)), ["_lines", "_dropped"]
    # rows that repeat an id with other texts share line numbers, not codes
    found = gone.select(F.col("_id"), F.struct("dropped", "dropped_codes").alias("_gone")).alias("g")
    rows = filtered(docs, keys, id_col).alias("d").join(found, F.col(f"d.`{id_col}`") == F.col("g._id"), "left")
    rows = rows.select(*(F.col(f"d.`{c}`") for c in names), F.col("g._gone").alias(own_name))
    others = filtered(docs, keys, id_col, rest=True).select(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.IntegerType()) for c in report_as)] if report else docs.schema.fields)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, before, count = batch.column(text_col).to_pylist(), [], []
            changed = [False] * len(texts)
            for i, own in enumerate(batch.column(own_name).to_pylist()):
                parts = [] if texts[i] is None else texts[i].split("\n")
                before.append(len(parts))
                kept = parts
                if own and parts:
                    numbers, codes = set(own["dropped"]), set(own["dropped_codes"])
                    kept = [x for k, x in enumerate(parts) if k not in numbers or codes.isdisjoint(templates(x.encode(), short))]
                    if len(kept) < len(parts):
                        texts[i], changed[i] = "\n".join(kept), True
                count.append(len(parts) - len(kept))
            columns = {c: batch.column(c) for c in names} | {text_col: pa.array(texts, pa.string())}
            if length_col:
                old = columns[length_col].to_pylist()
                columns[length_col] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, old, strict=True)], columns[length_col].type)
            out = pa.RecordBatch.from_arrays([*columns.values(), *([pa.array(before, pa.int32()), pa.array(count, pa.int32())] if report else [])], schema.names)
            yield out if emptied else out.filter(pa.array([not c or bool(t.strip(" \t\n\v\f\r")) for t, c in zip(texts, changed, strict=True)], pa.bool_()))

    out = rows.mapInArrow(strip, schema)
    if not report:
        return out.unionByName(others)
    whole = F.coalesce(F.size(F.split(F.col(f"`{text_col}`"), "\n")), F.lit(0))
    return out.unionByName(others.withColumns({"_lines": F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(whole).cast("int"), "_dropped": F.lit(0).cast("int")}))
