"""Importance resampling towards a target corpus, drawn by a parallel sort with regular sampling.

Words and runs of words are hashed into buckets. Two counts of buckets, over the source and over the target, give an
array of gains; a document's weight is the mean gain of its features, read from that array, and its score the weight
plus noise that depends on its id alone, so that the highest scores are a weighted sample without replacement. Ranks come
from a sort in runs: every partition sorts its own rows and names keys at regular places, the gathered keys give
splitters, each run's segments go to the part between two splitters and are merged there, and the counts of earlier parts
give exact ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrank.llm.common import materialise, shuffle_partitions, slices, small_batches

BUCKETS = 10_000
#: Parts of the sort at most; the driver gathers about the square of their number of keys.
PARTS = 512
#: Features longer than this are hashed one by one, all others a byte of each at a time.
SHORT = 48

#: Bytes of words: digits, letters and all of what is not ASCII; capital letters count as small ones.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def crc_table() -> np.ndarray:
    """CRC-32 of single bytes, by the rule of its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def crc32_spans(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of spans of bytes."""
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    long = int(np.searchsorted(-size, -SHORT))  # spans of more than SHORT bytes come first
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # spans of more than j bytes
        own = crc[long:n]
        crc[long:n] = CRC[(own ^ text[at[long:n] + j]) & 0xFF] ^ (own >> 8)
    crc[long:] ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(text[at[i] : at[i] + size[i]].tobytes())
    out = np.empty(len(at), np.uint32)
    out[order] = crc
    return out


def feature_buckets(texts: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of words; of each feature its text and bucket. Features are all runs of 1 to `most` words of
    a text, joined by one space; null texts have none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    text = LOWER[raw]
    held = np.append(WORD[text], False)
    first = np.zeros(len(text) + 1, bool)
    first[offsets - offsets[0]] = True  # a text's first byte continues no word
    start = np.flatnonzero(held[:-1] & (np.append(True, ~held[:-2]) | first[:-1])) if len(text) else np.zeros(0, np.int64)
    stop = np.flatnonzero(held[:-1] & (~held[1:] | first[1:])) + 1 if len(text) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets - offsets[0], start, side="right") - 1
    words = np.bincount(doc, minlength=len(texts))
    if most > 1:  # words with one space after each, so that a run is a span
        length = stop - start
        where = np.cumsum(length + 1) - length - 1
        joined = np.full(int((length + 1).sum()), 32, np.uint8)
        joined[np.repeat(where - np.cumsum(length) + length, length) + np.arange(length.sum())] = text[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]
        text, start, stop = joined, where, where + length
    docs, found = [], []
    for n in range(1, most + 1):
        whole = doc[n - 1 :] == doc[: len(doc) - n + 1] if n > 1 else np.ones(len(doc), bool)
        a, b = start[: len(whole)][whole], stop[n - 1 :][whole]
        docs.append(doc[: len(whole)][whole])
        found.append(crc32_spans(text, a, b - a) % np.uint32(buckets))
    return words, np.concatenate(docs), np.concatenate(found).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket. A task hands on one row a bucket at most, and the driver gets one a bucket."""
    small_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(feature_buckets(batch.column(0), most, buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target), with one more feature in each bucket."""
    buckets, every, wanted = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (every + buckets) / ((s + 1.0) * (wanted + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(seed: str, doc_id: int) -> int:
    """floor(1000 times a Gumbel variate) that the id decides."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, most: int, seed: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row; a null id has no noise and so no score."""
    small_batches(docs)
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "weight": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, doc, bucket = feature_buckets(batch.column(1), most, len(gain))
            n = np.bincount(doc, minlength=len(words))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, doc, gain[bucket])
            weight = total // np.maximum(n, 1)
            ids = batch.column(0).to_pylist()
            score = [None if i is None else w + noise(seed, i) for i, w in zip(ids, weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, words, n, weight, score), kinds.values(), strict=True)], names=list(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in kinds))


def draw(rows: DataFrame, eligible, share: tuple[int, int]) -> DataFrame:
    """rows (doc_id, n_features, weight, score) with rank: of the N eligible the floor(N * share) highest scores, ties to
    smaller ids, get 1, 2, 3...; null for all others."""
    spark, names = rows.sparkSession, rows.columns
    held = rows.withColumn("_in", F.coalesce(eligible, F.lit(False)))
    total = held.where("_in").count()
    wanted, parts = total * share[0] // share[1], min(shuffle_partitions(spark), PARTS)
    stride = max(1, total // parts**2)
    order = [F.desc("score"), *(c for c in names if c != "score")]
    key = ["score", "doc_id"]

    def regular(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for pdf in batches:
            places = np.arange((stride - 1 - at) % stride, len(pdf), stride)
            at += len(pdf)
            yield pdf.iloc[places]

    runs = held.where("_in").select(*names).sortWithinPartitions(*order)
    sample = sorted((-r["score"], r["doc_id"]) for r in runs.select(*key).mapInPandas(regular, "score long, doc_id long").collect())
    cuts = sorted({sample[len(sample) * j // parts] for j in range(1, parts)}) if sample else []
    pair = np.dtype([("s", np.int64), ("d", np.int64)])
    splitters = np.array(cuts, pair)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = np.empty(len(pdf), pair)
            own["s"], own["d"] = -pdf["score"].to_numpy(np.int64), pdf["doc_id"].to_numpy(np.int64)
            low = np.searchsorted(splitters["s"], own["s"], side="left")
            high = np.searchsorted(splitters["s"], own["s"], side="right")
            tied = np.flatnonzero(low < high)  # a splitter has this score, so the ids decide
            for i in tied.tolist():
                low[i] += np.searchsorted(splitters["d"][low[i] : high[i]], own["d"][i], side="right")
            yield pdf.assign(_part=low.astype(np.int32))

    longs = ", ".join(f"{c} long" for c in names)
    parted = materialise(runs.mapInPandas(place, f"{longs}, _part int"), "parts")
    base, before = {}, 0
    for r in sorted(parted.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        base[r["_part"]], before = before, before + r["count"]
    last = max((p for p, b in base.items() if b < wanted), default=-1)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[int, int] = {}
        for pdf in batches:
            own = pdf["_part"].to_numpy()
            places = np.empty(len(pdf), np.int64)
            for p in np.unique(own).tolist():
                here = np.flatnonzero(own == p)
                places[here] = base[p] + at.get(p, 0) + np.arange(1, len(here) + 1)
                at[p] = at.get(p, 0) + len(here)
            yield pdf.drop(columns="_part").assign(rank=places)

    exchanged = parted.where(F.col("_part") <= last).repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", *order)
    ranked = exchanged.mapInPandas(rank, f"{longs}, rank long")
    none = F.lit(None).cast("long").alias("rank")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(parted.where(F.col("_part") > last).select(*names, none)).unionByName(held.where("NOT _in").select(*names, none))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least: int = 20, most: int = 1, buckets: int = BUCKETS, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Draw a share of docs whose features are distributed more like those of target.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case; features are all runs of 1 to `most`
    words, repeats counted. Returns doc_id, n_features, weight, score and rank for every row. Of the rows with at least
    `least` words and an id the floor(N * share) highest scores are drawn. Null and empty texts have no features and
    weight 0; rows with a null id count in the statistics but have neither score nor rank; repeated rows each take a rank
    of their own, ties to the smaller id; an empty target gives every bucket its smoothed gain, an empty source no rows.
    Texts of any length count whole, and other columns do not come along.
    """
    gain = gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_col, most, buckets))
    rows = materialise(scored(docs, gain, most, seed, id_col, text_col), "scored")
    return draw(rows, (F.col("n_words") >= least) & F.col("doc_id").isNotNull(), share).select("doc_id", "n_features", "weight", "score", "rank")
