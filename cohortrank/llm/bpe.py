"""Byte-level BPE encoding and decoding.

A piece's merges run on a segment tree over its byte positions. The leaf of a live position holds the rank of
the pair that starts there, the root the leftmost minimum; a merge changes three leaves, so a piece of n bytes
takes O(n log n) however long it is. Short pieces are merged many at a time, each in a tree of its own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortrank.llm.common import slices, small_batches

#: Unicode White_Space, as the tokenizer's own \s has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the tokenizer's pattern runs from a non-space into a space, so a text can be encoded unit by unit.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Without this, splitting at each space gives units.
SPACED = re.compile(f"[{SPACE}] | $")
#: Units, and as many pieces, that a Python worker remembers at most; the longest unit that it remembers.
CACHE_UNITS, CACHE_CHARS = 160_000, 40
#: Units encoded together at most, and the length from which a text is split into units piecemeal.
GROUP_UNITS, LONG_TEXT = 100_000, 1_000_000
#: Pieces of up to 2**TREE_BITS bytes are merged TREE_ROWS at a time.
TREE_BITS, TREE_ROWS = 6, 16_384


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of one piece: always merge the leftmost pair of lowest rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)  # a node holds rank * size + position, so that min() is the leftmost lowest
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # of the token that starts at a live position
    left = list(range(-1, n - 1))  # start of the token before it
    while (top := tree[1]) != none:
        at = top % size
        gone = end[at]
        end[at] = stop = end[gone]
        if stop < n:
            left[stop] = at
        changed = [(gone, none)]
        for p, q in ((at, stop), (left[at], at)):
            if p >= 0:
                e = end[q] if q < n else -1
                r = rank(piece[p:e]) if 0 <= e and e - p <= longest else None
                changed.append((p, none if r is None else r * size + p))
        for p, value in changed:
            k = size + p
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if a > b:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
    out, p = [], 0
    while p < n:
        out.append(ranks[piece[p : end[p]]])
        p = end[p]
    return out


class MergeTrees:
    """merge() for many pieces at once: a row of a matrix is the segment tree of one piece, and every step merges
    the root's pair in all rows that have one left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], table[order, 2].astype(np.int32)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of merged pairs, -1 where there is none; an id of -1 has none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (right >= 0), self.values[at], -1)

    def ids(self, pieces: list[bytes], bits: int) -> list[bytes]:
        """Packed ids of pieces of at most 2**bits bytes each."""
        size, m, none = 1 << bits, len(pieces), np.int64(1 << 62)
        lengths = np.fromiter(map(len, pieces), np.int64, m)
        data = np.zeros((m, size + 1), np.uint8)
        inside = np.arange(size + 1) < lengths[:, None]
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(inside, self.byte_ids[data], -1)
        tree = np.full((m, 2 * size), none)
        pair = self.byte_pairs[data[:, :-1], data[:, 1:]].astype(np.int64)
        tree[:, size:] = np.where(inside[:, 1:] & (pair >= 0), pair << bits | np.arange(size), none)
        level = size
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.tile(np.arange(1, size + 2), (m, 1))
        before = np.tile(np.arange(-1, size), (m, 1))
        live = inside.copy()
        rows = np.flatnonzero(tree[:, 1] != none)
        while len(rows):
            top = tree[rows, 1]
            at = top & (size - 1)
            gone = after[rows, at]
            stop = after[rows, gone]
            ids[rows, at] = top >> bits
            after[rows, at] = stop
            before[rows, stop] = at
            live[rows, gone] = False
            first = before[rows, at]
            ahead = self.rank(ids[rows, at], ids[rows, stop]).astype(np.int64)
            behind = self.rank(np.where(first >= 0, ids[rows, first], 0), np.where(first >= 0, ids[rows, at], -1)).astype(np.int64)
            tree[rows, size + np.minimum(gone, size - 1)] = none
            tree[rows, size + at] = np.where(ahead >= 0, ahead << bits | at, none)
            has = first >= 0
            tree[rows[has], size + first[has]] = np.where(behind >= 0, behind << bits | first, none)[has]
            nodes = size + np.stack([gone, at, np.where(has, first, at)])
            for _ in range(bits):
                nodes >>= 1
                for k in nodes:
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            rows = rows[tree[rows, 1] != none]
        packed = ids[live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live.sum(1))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Memory(dict):
    """A dict of bounded size: when it is full its entries grow old, and of the old ones those asked for come back."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def recall(self, keys: Iterable) -> list:
        """Brings back old entries of keys; returns the keys that are not known at all."""
        old, unknown = self.old, []
        for k in keys:
            if (x := old.get(k)) is None:
                unknown.append(k)
            else:
                self[k] = x
        return unknown

    def settle(self) -> None:
        if len(self) > CACHE_UNITS // 2:
            self.old = dict(self)
            self.clear()


class Units(Memory):
    """The packed ids of units; before is what stands before each key in the text."""

    def __init__(self, before: str, learn: Callable[[list[str]], list[bytes]]):
        super().__init__()
        self.before, self.learn = before, learn

    def take(self, units: list[str]) -> list[bytes]:
        """The ids of each of some distinct units, new ones learned together."""
        found, old, new = list(map(self.get, units)), self.old.get, []
        for k, x in enumerate(found):
            if x is None:
                u = units[k]
                if (x := old(u)) is None:
                    new.append(k)
                else:
                    found[k] = self[u] = x
        ids = self.learn([self.before + units[k] for k in new]) if new else []
        for k, x in zip(new, ids, strict=True):
            found[k] = x
            if len(u := units[k]) <= CACHE_CHARS:
                self[u] = x
        self.settle()
        return found


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def gather(found: list[bytes], places: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The entries of found at places, joined up to each of ends."""
    flat = np.frombuffer(b"".join(found), "<u4")
    lengths = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    starts = np.cumsum(lengths) - lengths
    own = lengths[places]
    upto = np.append(0, np.cumsum(own))
    packed = memoryview(flat[np.repeat(starts[places] - upto[:-1], own) + np.arange(upto[-1])].tobytes())
    cuts = (4 * upto[ends]).tolist()
    return [bytes(packed[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class UnitEncoder:
    """Encodes texts unit by unit, each distinct unit of some texts once; learn() gives the packed ids of new units."""

    def __init__(self):
        self.bare, self.spaced = Units("", self.learn), Units(" ", self.learn)

    def learn(self, units: list[str]) -> list[bytes]:
        raise NotImplementedError

    def found(self, units: list[str], spaced: bool) -> list[bytes]:
        """The ids of some distinct units, after a space each if so."""
        return (self.spaced if spaced else self.bare).take(units)

    def units(self, text: str) -> Iterator[str]:
        """The units of one text."""
        return (m[0] for m in UNIT.finditer(text))

    def regular(self, text: str) -> bool:
        """Whether columns() can split the text."""
        return not SPACED.search(text)

    def columns(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, bool]:
        """The units of regular texts in one array, the end of each text in it, and whether a space stands before
        each unit but the first of a text."""
        lists = pc.split_pattern(texts, " ")
        return lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), True

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """encode() of each text; null texts have no ids. A long text is taken in groups of GROUP_UNITS units."""
        texts = list(texts)
        out, even = [b""] * len(texts), []
        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) <= LONG_TEXT and self.regular(text):
                even.append(k)
                continue
            units, parts = self.units(text), []
            while group := list(islice(units, GROUP_UNITS)):
                parts += self.join(pa.array(group, pa.large_string()), np.array([len(group)]), False)
            out[k] = b"".join(parts)
        if even:
            for k, ids in zip(even, self.join(*self.columns(pa.array([texts[k] for k in even], pa.large_string()))), strict=True):
                out[k] = ids
        return out

    def join(self, values: pa.Array, ends: np.ndarray, spaced: bool) -> list[bytes]:
        """The ids of the texts whose units stand in values, each up to its end."""
        coded = values.dictionary_encode()
        found = self.found(strings(coded.dictionary), spaced)
        places = coded.indices.to_numpy().astype(np.int64)
        if spaced:  # no space stands before a text's first unit
            at = np.append(0, ends[:-1])
            first = values.take(pa.array(at)).dictionary_encode()
            places[at] = len(found) + first.indices.to_numpy()
            found = found + self.found(strings(first.dictionary), False)
        return gather(found, places, ends)


class Encoder(UnitEncoder):
    """Byte-level BPE by the ranks in the file at path, each match of pattern on its own."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = load_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.tokens = token_list(self.ranks)
        self.whole = {token: np.array([r], "<u4").tobytes() for token, r in self.ranks.items()}
        self.merged = Memory()
        self.trees = MergeTrees(self.ranks)
        self.pieces = regex.compile(pattern).findall
        # letters with or without a space before them are one match, as what might match earlier starts with a quote
        earlier, found, _ = pattern.partition(r"| ?\p{L}+|")
        self.letters = bool(found) and all(x.startswith("'") for x in earlier.split("|"))

    def one_piece(self, unit: str) -> bool:
        word = unit[1:] if unit[:1] == " " else unit
        return self.letters and word.isalpha() and (word.isascii() or max(word) < "\u0250")

    def learn(self, units: list[str]) -> list[bytes]:
        split = [(u.encode(),) if self.one_piece(u) else [p.encode() for p in self.pieces(u)] for u in units]
        whole = self.whole
        self.merged.settle()
        new = self.merged.recall({p for own in split for p in own if p not in whole and p not in self.merged})
        classes: dict[int, list[bytes]] = {}
        for p in new:
            classes.setdefault((len(p) - 1).bit_length(), []).append(p)
        for bits, pieces in classes.items():
            if bits > TREE_BITS:
                self.merged.update((p, np.array(merge(p, self.ranks, self.longest), "<u4").tobytes()) for p in pieces)
                continue
            for k in range(0, len(pieces), TREE_ROWS):
                part = pieces[k : k + TREE_ROWS]
                self.merged.update(zip(part, self.trees.ids(part, bits), strict=True))
        merged = self.merged
        return [b"".join([whole[p] if p in whole else merged[p] for p in own]) for own in split]

    def decode(self, packed: bytes) -> bytes:
        return decode(packed, self.tokens)


def decode(packed: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def token_list(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        tokens[r] = token
    return tokens


@lru_cache(maxsize=2)
def decoder(path: str) -> list[bytes]:
    return token_list(load_ranks(path))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts by the ranks in the file at path, each match of pattern on its own.

    Returns id_col, n_tokens long and ids binary (little-endian unsigned 32-bit). A null text counts as empty:
    no tokens, empty ids. Texts of any length are encoded whole. One row per input row, repeated rows and null ids included; other columns, whatever
    their names, do not come along. No shuffle.
    """
    small_batches(docs)
    id_type = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches):
            ids = own.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                [id_col, "n_tokens", "ids"],
            )

    schema = T.StructType([id_type, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Add decoded binary, the bytes that ids stand for. Null ids decode to no bytes. All columns stay."""
    schema = T.StructType([f for f in encoded.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())])
    kept = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder(path)
        for batch in slices(batches):
            decoded = [decode(x, tokens) if x else b"" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(decoded, pa.binary())], schema.names)

    return encoded.mapInArrow(run, schema)
