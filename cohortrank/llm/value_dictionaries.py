"""Product codes of integer vectors by dictionaries of values.

Components become integers, and a block of vectors keeps for each dimension the distinct integers that occur and, of each
vector, a place in that dictionary. Against a codebook every distinct integer meets every entry once: the squared
differences are a table, and the distance of a part is a gather and an add for each of its dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortrank.llm.common import materialise

#: Vectors of a block, which a task holds at once.
BLOCK = 4096
#: Integers beyond this would overflow sums of squares.
LARGEST = 1 << 24


def blocks(rows: DataFrame, dim: int, scale: float) -> DataFrame:
    """ids, labels, values (the distinct integers of each dimension) and codes (places in them, 16 bits each, dimension by
    dimension) of up to BLOCK rows (vec_id, label, v)."""
    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("vals", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("codes", T.BinaryType())])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        flat = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ints = np.floor(flat * scale)
        if np.abs(ints).max(initial=0) > LARGEST:
            raise ValueError(f"components times {scale} must lie within {LARGEST}")
        vals, codes = [], []
        for column in ints.astype(np.int64).T:
            distinct, places = np.unique(column, return_inverse=True)
            vals.append(distinct.tolist())
            codes.append(places.astype(np.uint16))
        whole = pa.array([0, part.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, part.column(i)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([vals], pa.list_(pa.list_(pa.int64()))), pa.array([np.concatenate(codes).tobytes()], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield one(batch.slice(at, BLOCK))

    to_arrow_type(label)  # labels of a kind that Arrow lacks fail here, not in a task
    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def nearest(vals: list, codes: bytes, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Parts x rows: the codebook's nearest entry (ties to the lower index) and its distance; also the codes by
    dimension. book: parts x entries x width."""
    parts, entries, width = book.shape
    place = np.frombuffer(codes, np.uint16).reshape(parts * width, -1)
    n = place.shape[1]
    entry, distance = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for p in range(parts):
        total = np.zeros((n, entries), np.int64)
        for w in range(width):
            d = p * width + w
            table = (np.asarray(vals[d], np.int64)[:, None] - book[p, :, w]) ** 2
            total += table[place[d]]
        entry[p] = total.argmin(1)
        distance[p] = total[np.arange(n), entry[p]]
    return entry, distance, place


def refined(held: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after one round: each entry is the floored mean of the parts assigned to it; unused entries stay. Tasks
    add up before the shuffle, and the driver gets one row an entry."""
    parts, entries, width = book.shape
    names = [f"c{w}" for w in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for vals, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entry, _, place = nearest(vals, codes, book)
                for p in range(parts):
                    count[p] += np.bincount(entry[p], minlength=entries)
                    for w in range(width):
                        own = np.asarray(vals[p * width + w], np.int64)[place[p * width + w]]
                        total[p, :, w] += np.bincount(entry[p], weights=own, minlength=entries).astype(np.int64)  # exact below 2 ** 53
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": count[p, e], **{c: total[p, e, w] for w, c in enumerate(names)}})

    sums = held.select("vals", "codes").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    out = book.copy()
    for r in sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect():
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    return out


def encoded(held: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row."""
    label = held.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entry, distance, _ = nearest(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), book)
                code = [x.tobytes().hex() for x in np.ascontiguousarray(entry.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code), pa.array(distance.sum(0))], names=schema.names)

    return held.select("ids", "labels", "vals", "codes").mapInArrow(run, schema)


def with_group_sum(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """rows plus the sum of value over their group, nulls being one. Groups of over a thousandth of all rows, of which there
    are under a thousand, are broadcast; rows of the others meet their sums by a join, so no task gets a hot group."""
    sums = materialise(rows.groupBy(group).agg(F.sum(value).alias(out), F.count("*").alias("_n")), "sums")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") * 1000 > total
    same = lambda b: F.col(group).eqNullSafe(F.col(b))
    many, few = (sums.where(c).select(F.col(group).alias("_g"), out) for c in (hot, ~hot))
    return rows.join(F.broadcast(many), same("_g")).drop("_g").unionByName(
        rows.join(F.broadcast(many.select("_g")), same("_g"), "left_anti").join(few, same("_g")).drop("_g")
    )


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Product codes of all vectors and what they lose.

    Components x become floor(scale * x), vectors are cut into `parts` equal parts, and each part position has a codebook
    that starts with the `entries` smallest ids and is refined `rounds` times. Returns vec_id, code (two hex digits a
    part), error (squared distances to the final entries), label_error (summed over equal labels, nulls together) and
    codebooks_sha256. Rows whose vector is null, empty or holds null or non-finite components are dropped, as are those of
    another length than most (ties to the shorter); that length must be a multiple of `parts`. Repeated rows and ids each
    keep a row (rows of one id start the codebook in the order of their vectors), null ids come last in it. With fewer
    vectors than `entries` the codebook has as many; an empty table gives no rows. Integers beyond 2 ** 24 are an error.
    Other columns do not come along.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    dim = dims[0]["dim"]
    if dim % parts or entries > 256:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} parts, or {entries} entries need more than two digits")
    rows = rows.where(F.size("v") == dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` rows
    start = np.floor(np.array([r["v"] for r in first]).reshape(len(first), dim) * scale).astype(np.int64)
    book = np.ascontiguousarray(start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    held = materialise(blocks(rows, dim, scale), "blocks")
    for _ in range(rounds):
        book = refined(held, book)
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    out = with_group_sum(materialise(encoded(held, book), "codes"), "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
