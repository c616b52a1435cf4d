"""Token counts of sections: whole documents are encoded once, and token spans are joined to section spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortrank.llm.bpe import encoder
from cohortrank.llm.common import slices, small_batches


def section_starts(data: bytes, separator: bytes) -> np.ndarray:
    """Byte offsets at which sections start; a separator ends the section before it, and none is empty."""
    starts, at = [0], data.find(separator)
    while at >= 0:
        starts.append(at + len(separator))
        at = data.find(separator, starts[-1])
    if len(starts) > 1 and starts[-1] == len(data):
        starts.pop()
    return np.array(starts, np.int64)


def count_tokens(docs: DataFrame, path: str, pattern: str, separator: str = "\n", rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of each section of each document, as the encoding of the whole document has them.

    Sections are the stretches that end with separator, so together they cover the text. A token that crosses a
    boundary goes to the section of its first byte (rule 'first'), or to the one that holds most of its bytes,
    the earlier at a tie ('most'). So every token counts once: sections sum to the document.

    Returns id_col, section (from 0), start and length (bytes of the UTF-8 text), n_tokens, n_crossing (of
    these, tokens that cross the section's end). A null or empty text has one section without bytes or tokens.
    Repeated rows are counted each, texts of any length whole. Other columns do not come along. No shuffle: a document's spans are sorted,
    so the interval join is a merge within its row.
    """
    small_batches(docs)
    if rule not in ("first", "most"):
        raise ValueError("rule is 'first' or 'most'")
    mark = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        widths = np.array([len(x) for x in own.tokens], np.int64)
        for batch in slices(batches):
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            texts = batch.column(1).to_pylist()
            for row, (text, packed) in enumerate(zip(texts, own.encode_all(texts), strict=True)):
                data = (text or "").encode()
                starts = section_starts(data, mark)
                bounds = np.append(starts[1:], len(data))
                ends = np.cumsum(widths[np.frombuffer(packed, "<u4")])
                begins = np.append(0, ends[:-1]) if len(ends) else ends
                at = np.searchsorted(starts, begins, "right") - 1
                crossing = ends > bounds[at] if len(ends) else np.zeros(0, bool)
                if rule == "most" and crossing.any():
                    best, most = at.copy(), np.minimum(ends, bounds[at]) - begins
                    last = np.searchsorted(starts, ends, "left") - 1
                    for i in np.flatnonzero(crossing):
                        for s in range(at[i] + 1, last[i] + 1):
                            held = min(ends[i], bounds[s]) - starts[s]
                            if held > most[i]:
                                best[i], most[i] = s, held
                    at = best
                n = len(starts)
                for part, x in zip(parts, (np.full(n, row), np.arange(n), starts, bounds - starts, np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n)), strict=True):
                    part.append(x)
            rows, *columns = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in columns)],
                [id_col, "section", "start", "length", "n_tokens", "n_crossing"],
            )

    names = ["section", "start", "length", "n_tokens", "n_crossing"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(x, T.LongType()) for x in names)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
