"""Quality rules: base counts of a text, and lines that too many documents of one host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.llm.common import filtered, free_name, materialise, slices, small_batches

SYMBOLS = "#*$%&|<>"
#: A line is removed where more distinct documents of its host hold it than MIN_DOCS, or than SHARE of them all and FLOOR.
MIN_DOCS, SHARE, FLOOR = 100, 0.01, 10
#: A document is depleted if, after removal, fewer words are left than MIN_WORDS or than KEEP_PERCENT of all.
MIN_WORDS, KEEP_PERCENT, REPEAT_PERCENT = 10, 20, 20
MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(5)]


def windows(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run of five word codes."""
    n = len(codes) - 4
    return sum((codes[k : k + n] * MIX[k] for k in range(5)), np.zeros(n, np.uint64))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which the text holds twice or more."""
    if len(words) < 6:
        return 0
    own = windows(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts[inverse] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, often, 1)
    np.add.at(step, often + 5, -1)
    return int((np.cumsum(step) > 0).sum())


def line_code(words: list[bytes]) -> int:
    """Signed 64-bit hash of a line: A-Z lower-cased, digits alike, white space squeezed."""
    return int.from_bytes(xxhash.xxh3_64_digest(re.sub(rb"[0-9]", b"0", b" ".join(words).lower())), "big", signed=True)


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: the base counts, a 128-bit code of the text, and the codes and word counts of its lines."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {x: [] for x in NAMES}
            for text in batch.column(1).to_pylist():
                text = text or ""
                data = text.encode()
                words = data.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
                lines = [(x, w) for x in data.split(b"\n") if (w := x.split())]
                code = xxhash.xxh3_128_digest(data)
                held: dict[int, int] = {}
                for _, w in lines:
                    c = line_code(w)
                    held[c] = held.get(c, 0) + len(w)
                for name, x in zip(NAMES, (
                    len(words), len(b"".join(words).decode()), sum(map(text.count, SYMBOLS)), len(lines) - len({x for x, _ in lines}), repeated_words(words),
                    int.from_bytes(code[:8], "big", signed=True), int.from_bytes(code[8:], "big", signed=True), list(held), list(held.values()),
                ), strict=True):
                    out[name].append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(v, pa.list_(pa.int64()) if k in ("lines", "line_words") else pa.int64()) for k, v in out.items())],
                [id_col, "host", *NAMES],
            )

    fields = [T.StructField(x, T.ArrayType(T.LongType()) if x in ("lines", "line_words") else T.LongType()) for x in NAMES]
    schema = T.StructType([docs.schema[id_col], T.StructField("host", T.StringType()), *fields])
    return docs.select(id_col, text_col, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")).mapInArrow(run, schema)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "code_a", "code_b", "lines", "line_words"]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, *, floor: int = FLOOR, copies: str = "once") -> DataFrame:
    """Base rules, then the verdict by cross-document line frequency. One row per input row, repeats included.

    Lines are counted per host by their code: by documents (an id and its text; repeats of both are one document, null
    ids of one text too) with copies="each", by texts with copies="once", so that copies alone never make a line
    frequent. Lines above either limit are removed and a document that they deplete is rejected. A null text has no words, a null host is the host ''. An empty table gives no rows.

    Returns id_col, host, the counts, code_a and code_b (of the text), removed (codes of removed lines),
    removed_words, base_failed and kept. Other columns do not come along. Shuffles hold codes, never texts.
    """
    held = materialise(measure(docs, id_col, text_col, host_col), "measured")
    text = ["host", "code_a", "code_b"]
    if copies not in ("each", "once"):
        raise ValueError(f"copies is each or once, not {copies}")
    # a struct counts null ids too; copies of one text are first counted apart by id, so a hot text lies in many tasks
    documents = F.count_distinct(F.struct(id_col)) if copies == "each" else F.max(F.lit(1).cast("long"))
    distinct = held.groupBy(*text).agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"), documents.alias("documents"))
    distinct = materialise(distinct, "texts")  # equal texts have equal lines
    sizes = distinct.groupBy("host").agg(F.sum("documents").alias("n_documents"))
    frequent = (
        distinct.select("host", "documents", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.sum("documents").alias("n"))
        .where(F.col("n") > min(min_docs, floor)).join(sizes, "host")
        .where((F.col("n") > min_docs) | ((F.col("n") > floor) & (F.col("n") > share * F.col("n_documents")))).select("host", "line")
    )
    line = F.explode(F.arrays_zip("lines", "line_words")).alias("x")
    removed = (
        distinct.select(*text, line).select(*text, F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
        .join(frequent, ["host", "line"]).groupBy(*text).agg(F.collect_list("line").alias("removed"), F.sum("words").alias("removed_words"))
    )
    out = held.drop("lines", "line_words").join(removed, text, "left")
    out = out.withColumns({"removed": F.coalesce("removed", F.array().cast("array<bigint>")), "removed_words": F.coalesce("removed_words", F.lit(0).cast("long"))})
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (left * 100 < F.col("n_words") * KEEP_PERCENT))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str | None = None) -> DataFrame:
    """The documents that judge() keeps, without their removed lines. All columns stay, whatever their names;
    length_col, if given, follows the new text. Rows go by id, host and text, so repeated rows all return. Only the
    texts that are rejected or lose a line are shuffled. Copies of a text count once here: a group of copies would else
    lose all its lines and with them the copy that is to stay. A null text is rejected, as it has no words; a text of any
    length is taken whole; an empty table gives no rows."""
    small_batches(docs)
    verdicts = judge(docs, id_col, text_col, host_col)
    touched = verdicts.where(~F.col("kept") | (F.size("removed") > 0)).select(
        F.col(id_col).alias("_id"), F.col("host").alias("_host"), F.col("code_a").alias("_a"), F.col("code_b").alias("_b"), F.struct("kept", "removed").alias("_verdict")
    )
    touched = materialise(touched.dropDuplicates(["_id", "_host", "_a", "_b"]), "touched")
    host, a, b, verdict = (free_name(docs, x) for x in ("_host", "_a", "_b", "_verdict"))
    schema = T.StructType([*docs.schema.fields, T.StructField(host, T.StringType()), T.StructField(a, T.LongType()), T.StructField(b, T.LongType())])
    keys = touched.select(F.col("_id").alias(id_col))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = [xxhash.xxh3_128_digest((t or "").encode()) for t in batch.column(text_col).to_pylist()]
            own = [[int.from_bytes(c[s], "big", signed=True) for c in codes] for s in (slice(0, 8), slice(8, 16))]
            hosts = pa.array([x or "" for x in batch.column(host_col).cast(pa.string()).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts, *(pa.array(x, pa.int64()) for x in own)], schema.names)

    rows = filtered(docs, keys, id_col).select(*docs.columns).mapInArrow(coded, schema).alias("d")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("t._id")) & (F.col(f"d.`{a}`") == F.col("t._a")) & (F.col(f"d.`{b}`") == F.col("t._b")) & (F.col(f"d.`{host}`") == F.col("t._host"))
    names = docs.columns
    found = rows.join(touched.alias("t"), same, "left").select(*(F.col(f"d.`{c}`") for c in names), F.col("t._verdict").alias(verdict))
    found = found.where(F.col(verdict).isNull() | F.col(f"`{verdict}`.kept")).withColumn(verdict, F.col(f"`{verdict}`.removed"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text_col).to_pylist()
            changed = np.zeros(len(texts), bool)
            for i, codes in enumerate(batch.column(verdict).to_pylist()):
                if codes:
                    gone = set(codes)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if not (w := x.encode().split()) or line_code(w) not in gone)
                    changed[i] = True
            columns = {c: batch.column(c) for c in names} | {text_col: pa.array(texts, pa.string())}
            if length_col:
                old = batch.column(length_col).to_pylist()
                columns[length_col] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, old, strict=True)], batch.column(length_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return found.mapInArrow(strip, docs.schema).unionByName(filtered(docs, keys, id_col, rest=True).select(*names))
