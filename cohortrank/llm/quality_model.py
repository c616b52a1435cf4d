"""A quality score learned from preferences: Bradley-Terry over pairs of labelled documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.llm.common import slices, small_batches

#: At most so many labelled rows are learned from (those of smallest hash), and so many preference pairs drawn.
MAX_ROWS, MAX_PAIRS = 20_000, 200_000
SYMBOLS = "#*$%&|<>"
MARKS = re.compile(r"[!?]{2,}|\.{3,}")


@lru_cache(maxsize=1)
def char_kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 an upper-case letter, 3 a digit, else 0."""
    return np.array([2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 0 for c in map(chr, range(0x110000))], np.uint8)


def features(text: str | None) -> list[float]:
    """Numbers that describe how a text is written; they use no word list and no language."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    sizes = np.fromiter(map(len, words), np.int64, n)
    chars = int(sizes.sum())
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = np.bincount(char_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=4)
    letters, upper, digits = int(kinds[1] + kinds[2]), int(kinds[2]), int(kinds[3])
    symbols = sum(map(text.count, SYMBOLS))
    marks = len(MARKS.findall(text))
    pairs = len({*zip(words, words[1:], words[2:])})
    short = int((sizes < 4).sum())
    long_ = int((sizes > 9).sum())
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    ended = sum(w[-1] in ",.;:!?" for w in words)
    capital = sum(w[0].isupper() for w in words)
    mean = chars / n
    spread = float(sizes.std())
    return [
        np.log(n), min(n, 50) / 50, mean, spread, letters / chars, upper / chars, (upper / chars) ** 0.5, symbols / n, (symbols / n) ** 0.5,
        marks / n, digits / chars, text.count("|") / n, text.count("!") / n, text.count("http") / n, text.count("@") / n,
        len(counts) / n, np.log(len(counts)) / np.log(n + 1), top / n, (top / n) ** 0.5, 1 - pairs / max(n - 2, 1), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines),
        np.log(n / len(lines)), short / n, long_ / n, (long_ / n) ** 0.5, stops / n, ended / n, capital / n, int(sizes.max()) / 20, sum(c > 1 for c in counts.values()) / len(counts),
        float(n < 10), float(n < 5), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
    ]


N_FEATURES = 34


def with_features(rows: DataFrame, text_col: str) -> DataFrame:
    small_batches(rows)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != text_col), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([list(map(float, features(t))) for t in batch.column(text_col).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), x], schema.names)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.strength(x) - self.threshold).clip(-30, 30)))


def fit_pairs(x: np.ndarray, good: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Weights that make preferred documents win: logistic loss on feature differences, by Newton's method.

    Each pair prefers a row of label 1 to one of label 0. The threshold is the quantile of the learned strengths
    at the share of label 0, so as many learned rows fall below it as have that label. Without rows of both
    labels every score is 0.5.
    """
    width = x.shape[1] if x.ndim == 2 else N_FEATURES
    if not len(x) or good.all() or not good.any():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, 20 * len(x))
    d = z[rng.choice(np.flatnonzero(good), n)] - z[rng.choice(np.flatnonzero(~good), n)]
    w = np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp((d @ w).clip(-30, 30)))  # that the other one wins
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(width), d.T @ p / n - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, float(np.quantile(z @ w, 1 - good.mean())))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most max_rows labelled rows, those of the smallest hash of their id, ids divided as held_out()
    has it. Rows whose id or label is null are left out; an id with both labels counts for both, and of the texts of
    a repeated id the one of smallest features is taken. Without rows of both labels every score is 0.5."""
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_good")).distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_good").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = with_features(texts.join(F.broadcast(sample), "_id").select("_id", "_good", "_text"), "_text").toPandas()  # max_rows bounds both
    rows = rows.assign(features=rows["features"].map(tuple)).sort_values(["_id", "_good", "features"]).drop_duplicates(["_id", "_good"])
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), N_FEATURES)
    return fit_pairs(x, rows["_good"].to_numpy(bool))


def held_out(ids):
    """True for the third of ids that nothing is learned from."""
    return F.coalesce(F.crc32(ids.cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row: id_col, held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    A null or empty text is scored as a text without words. Repeated rows get equal scores; other columns do
    not come along. No shuffle.
    """
    small_batches(docs)
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column(2).to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x), pa.float64())], schema.names)

    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col)).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The documents that score at least cut, with all their columns, whatever their names. A null or empty text is
    scored as a text without words; repeated rows stay or go together; an empty table gives no rows. No shuffle."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column(text_col).to_pylist()], float).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) >= cut))

    return docs.mapInArrow(run, docs.schema)
