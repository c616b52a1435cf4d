"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Which bins there are depends only on how many pieces of each length there are, so the plan is made on at most
`capacity` counts, however many documents there are. It is a list of runs: so many pieces of one length go to
so many bins at one offset. Pieces then find their place by their rank in the order of lengths.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.llm.bpe import SPACE, UnitEncoder
from cohortrank.llm.common import SLICE_BYTES, materialise, release, slices, small_batches, with_global_order

#: Byte-level tokenizers write bytes that don't print as the characters from 256 on, in order.
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
WORD = re.compile(f"[^{SPACE}]+")
#: What str.split() and Arrow part at and is no white space; letters whose lower case is no single letter, or that
#: normalization might change. Words with these go to the library itself.
UNEVEN = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]")


def uneven(word: str) -> bool:
    return not word.isascii() and UNEVEN.search(word) is not None


#: A mark that ends a word of letters is a piece of its own.
MARKED = r"(\pL)([.,;:!?])( |\n|$)"
#: Pieces of at most MERGE_BYTES bytes are merged together, MERGE_ROWS at a time.
MERGE_BYTES, MERGE_ROWS = 32, 4096
NONE = np.int32(2**31 - 1)


class PairMerges:
    """Merges many short pieces at once, a row of a matrix each: every step merges the first pair of lowest rank of
    each row that has one left. Pairs are looked up in an open hash table."""

    BITS = 18

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], ending: str):
        of = [chr(BYTE_CHARS.get(b, b)) for b in range(256)]
        self.inner = np.array([vocabulary[c] for c in of], np.int32)
        self.last = np.array([vocabulary[c + ending] for c in of], np.int32)
        self.results = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in merges], np.int64)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, NONE, np.int32)
        slots, left = self.slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes the first that asks for it, the others go on to the next slot
            at, first = np.unique(slots[left], return_index=True)
            won = left[first[self.keys[at] < 0]]
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], won
            left = np.setdiff1d(left, won)
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
        pairs = np.repeat(self.inner, 256), np.tile(self.inner, 256), np.tile(self.last, 256)
        self.inner_pairs, self.last_pairs = (self.rank(pairs[0], x).reshape(256, 256) for x in pairs[1:])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where there is no merge."""
        wanted = left.astype(np.int64) << 20 | right
        at = self.slot(wanted)
        held, out = self.keys[at], self.ranks[at]
        out[held != wanted] = NONE
        open_ = np.flatnonzero((held != wanted) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = held == wanted[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of one byte or more each."""
        m, lengths = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = int(lengths.max())
        inside = np.arange(size) < lengths[:, None]
        data = np.zeros((m, size), np.uint8)
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        row, end = np.arange(m), lengths - 1
        ids = np.full((m, size + 1), -1, np.int32)  # the last column stays empty
        ids[:, :-1] = np.where(inside, self.inner[data], -1)
        ids[row, end] = self.last[data[row, end]]
        ranks = np.full((m, size + 1), NONE)
        ranks[:, : size - 1] = np.where(inside[:, 1:], self.inner_pairs[data[:, :-1], data[:, 1:]], NONE)
        two = row[end > 0]
        ranks[two, end[two] - 1] = self.last_pairs[data[two, end[two] - 1], data[two, end[two]]]
        out, places = np.full((m, size), -1, np.int32), np.arange(size)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            live = best < NONE
            if not live.all():
                out[row[~live]] = ids[~live, :-1]
                row, ids, ranks, at, best = row[live], ids[live], ranks[live], at[live], best[live]
            if not len(row):
                break
            k = np.arange(len(row))
            moved = places > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            new = self.results[best]
            ids[k, at] = new
            after = ids[k, at + 1]
            ranks[k, at] = np.where(after >= 0, self.rank(new, np.maximum(after, 0)), NONE)
            back = np.flatnonzero(at)
            ranks[back, at[back] - 1] = self.rank(ids[back, at[back] - 1], new[back])
        counts = (out >= 0).sum(1)
        packed = out[out >= 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class WordEncoder(UnitEncoder):
    """Ids by the tokenizer, which drops white space and merges within the matches of its own pattern only.

    Texts are normalized and split at white space as the tokenizer's file says, and words into its pattern's matches.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.model = self.own.model
        rules = json.loads(self.own.to_str())
        steps = [x["type"] for x in rules["normalizer"]["normalizers"]], [x["type"] for x in rules["pre_tokenizer"]["pretokenizers"]]
        model = rules["model"]
        plain = (model["type"], model["dropout"], model["unk_token"], model["continuing_subword_prefix"], model["byte_fallback"], model["ignore_merges"])
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or plain != ("BPE", None, None, None, False, False):
            raise ValueError(f"{path} holds a tokenizer of another kind: {steps} {plain}")
        self.pieces = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.merges = PairMerges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")

    def units(self, text: str) -> Iterator[str]:
        return (m[0] if uneven(m[0]) else m[0].lower() for m in WORD.finditer(text))

    def regular(self, text: str) -> bool:
        return not UNEVEN.search(text)

    def columns(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, bool]:
        # white space at either end of a text gives an empty word there, which has no ids
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), MARKED, r"\1 \2\3"))
        return lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), False

    def learn(self, units: list[str]) -> list[bytes]:
        odd = {k for k, u in enumerate(units) if uneven(u)}
        if odd:  # the library's Unicode tables decide
            even = iter(self.learn([u for k, u in enumerate(units) if k not in odd]))
            return [array("I", self.own.encode(u, add_special_tokens=False).ids).tobytes() if k in odd else next(even) for k, u in enumerate(units)]
        whole = [u.isalpha() for u in units]
        split = {k: self.pieces(units[k]) for k, one in enumerate(whole) if not one}
        parts = list({p for own in split.values() for p in own})
        names = [u.encode() for u, one in zip(units, whole, strict=True) if one]
        ids = self.merged(names + [p.encode() for p in parts])
        known = dict(zip(parts, ids[len(names) :], strict=True))
        single = iter(ids)
        return [next(single) if one else b"".join([known[p] for p in split[k]]) for k, one in enumerate(whole)]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces, those of about the same length together."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        short = int((lengths <= MERGE_BYTES).sum())
        out = [b""] * len(pieces)
        for k in range(0, short, MERGE_ROWS):
            some = order[k : min(short, k + MERGE_ROWS)].tolist()
            for i, x in zip(some, self.merges.ids([pieces[i] for i in some]), strict=True):
                out[i] = x
        for i in order[short:].tolist():
            out[i] = array("I", [t.id for t in self.model.tokenize(pieces[i].decode("latin-1").translate(BYTE_CHARS))]).tobytes()
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", checksums: bool = False) -> DataFrame:
    """Tokenize whole texts, end each with end_id and cut those longer than capacity.

    Returns per piece: id_col, piece (from 0), start, length, ids binary (little-endian unsigned 32-bit), or with
    checksums ids_crc32 in place of ids.
    A null or empty text is end_id alone.
    """
    small_batches(docs)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path)
        for batch in slices(batches, size=SLICE_BYTES // 4):  # words take several times their text
            row, piece, start, ids = [], [], [], []
            for i, packed in enumerate(own.encode_all(batch.column(1).to_pylist())):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    ids.append(packed[at : at + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()) if checksums else pa.array(ids, pa.binary())],
                [id_col, *names],
            )
        # a worker outlives its task: what it has learned would weigh on the stages that follow
        del own
        word_encoder.cache_clear()
        gc.collect()  # an encoder and its memories name each other
        release()

    names = ["piece", "start", "length", "ids_crc32" if checksums else "ids"]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType() if checksums else T.BinaryType()]
    schema = T.StructType([docs.schema[id_col], *map(T.StructField, names, kinds)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (first rank, bin, pieces a bin, offset, length); ranks count the pieces from the longest down.

    Pieces above a third of the capacity fit at most two to a bin: from the longest down, each takes the
    longest partner that fits. The others go, from the longest down, to the fullest bin with room for them.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    left = {n: counts[n] for n in lengths}
    rank, at = {}, 0
    for n in lengths:
        rank[n] = at
        at += counts[n]
    steps: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = {}  # gap -> runs [first bin, bins]
    gaps: list[int] = []
    bins = 0

    def put(n: int, first: int, pieces: int, each: int, offset: int) -> None:
        steps.append((rank[n], first, each, offset, n))
        rank[n] += pieces
        left[n] -= pieces

    def free(gap: int, first: int, count: int) -> None:
        if gap > 0 and count:
            if gap not in room:
                room[gap] = []
                insort(gaps, gap)
            room[gap].append([first, count])

    large = [n for n in lengths if 3 * n > capacity]
    rising = large[::-1]
    for n in large:
        while left[n]:
            k = bisect_left(rising, capacity - n + 1) - 1  # the longest that fits beside n
            while k >= 0 and not (left[rising[k]] - (rising[k] == n)) > 0:
                k -= 1
            if k < 0:
                count = left[n]
                put(n, bins, count, 1, 0)
                free(capacity - n, bins, count)
            elif (m := rising[k]) == n:
                count = left[n] // 2
                put(n, bins, 2 * count, 2, 0)
                free(capacity - 2 * n, bins, count)
            else:
                count = min(left[n], left[m])
                put(n, bins, count, 1, 0)
                put(m, bins, count, 1, n)
                free(capacity - n - m, bins, count)
            bins += count
        rising.remove(n)
    for n in lengths[len(large) :]:
        while left[n]:
            k = bisect_left(gaps, n)
            if k < len(gaps):
                gap = gaps[k]
                run = room[gap][-1]
            else:
                gap, run = capacity, [bins, -(-left[n] // (capacity // n))]
                bins += run[1]
                free(gap, *run)
                run = room[gap][-1]
            each = gap // n
            used = min(run[1], left[n] // each)
            if not used:
                each, used = left[n], 1
            put(n, run[0], used * each, each, capacity - gap)
            free(gap - each * n, run[0], used)
            run[0] += used
            run[1] -= used
            if not run[1]:
                room[gap].remove(run)
            if not room[gap]:
                del room[gap]
                gaps.remove(gap)
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Give each piece (id_col, piece, start, length, more columns) its sequence_id and offset.

    Ties in length go by id, piece and start; which of two equal rows comes first is open. An empty table gives
    no rows. The driver sees one count per length and one total per partition.
    """
    held = materialise(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan(counts, capacity)
    ordered, _, _ = with_global_order(held, [F.col("length").desc(), id_col, "piece", "start"], "length")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index = pdf["_index"].to_numpy(np.int64)
            step = steps[np.searchsorted(steps[:, 0], index, "right") - 1]
            nth = index - step[:, 0]
            yield pdf.drop(columns=["_index", "_before"]).assign(
                sequence_id=step[:, 1] + nth // step[:, 2], offset=step[:, 3] + nth % step[:, 2] * step[:, 4]
            )

    schema = T.StructType([*held.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ordered.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most capacity tokens; the pieces carry a checksum, not ids.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset. A null, empty or blank text is end_id alone;
    repeated rows and null ids are packed each; texts of any length are cut into pieces; other columns, whatever their
    names, do not come along; an empty table gives no rows.
    """
    return pack(token_pieces(docs, path, capacity, end_id, id_col, text_col, checksums=True), capacity, id_col)
