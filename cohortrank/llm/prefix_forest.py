"""Approximate nearest neighbours by inner product with a forest of hash prefixes.

Each tree gives every vector a string of bits, the signs of its products with random directions. In a sorted
array of such strings the vectors that share a prefix are neighbours. A query descends each tree to its longest
matching prefixes and ascends in all trees by the same number of bits until enough candidates share a prefix
with it; the candidates are then scored exactly. Points are kept in bands of norms that differ by at most the
root of two, each with its own forest, however few they are; a query that finds too few in a band's buckets is held
against the whole band.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortrank.llm.common import materialise

TREES, BITS = 24, 30
#: Candidates at which the ascent stops, counted once a tree: a share of a band's vectors, and at least LEAST for each
#: neighbour asked for. The share is the smallest of SHARES with which SAMPLE queries, searched exactly, find TARGET of
#: their neighbours.
SHARES, LEAST = [0.001 * 2 ** (j / 2) for j in range(28)], 2 * TREES
SAMPLE, TARGET = 64, 0.965
#: Vectors in a block of a bucket; levels below the bucket's at which the ascent can stop.
BLOCK, LEVELS = 4096, 12


def directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(TREES, BITS, dim + 1))


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Rows x trees strings of BITS bits, as integers: sorting these sorts the strings."""
    bits = np.einsum("nd,tbd->ntb", x, planes) > 0
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def point_strings(x: np.ndarray, band: np.ndarray, tops: dict[int, float], planes: np.ndarray) -> np.ndarray:
    """Strings of points: one more coordinate makes all points of a band equally long, so the nearest in angle has the
    largest product."""
    top = np.array([tops[b] for b in band.tolist()])
    return hash_strings(np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]), planes)


def calibrated(points: DataFrame, queries: DataFrame, planes: np.ndarray, tops: dict, sizes: dict, shares: list[float], least: int, k: int) -> tuple[float, dict[int, int]]:
    """The smallest of shares with which the sample finds TARGET of its neighbours, and each band's bucket depth: a bit
    less than any query of the sample then needs. The sample is of SAMPLE queries of smallest hash, held against all
    points, so the cost is SAMPLE products a point."""
    sample = queries.orderBy(F.xxhash64("first_id"), "q").limit(SAMPLE).select("q", "v").toPandas()  # SAMPLE bounds it
    if not len(sample):
        return shares[-1], dict.fromkeys(sizes, 0)
    dim, asked = planes.shape[2] - 1, sample["q"].to_numpy(np.int64)
    own = np.array(sample["v"].tolist(), np.float64).reshape(-1, dim)
    strings = hash_strings(np.column_stack([own, np.zeros(len(own))]), planes)
    rows = np.arange(len(own))[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                x, band = np.array(part["v"].tolist(), np.float64).reshape(-1, dim), part["band"].to_numpy(np.int32)
                code, best = point_strings(x, band, tops, planes), np.zeros((len(own), len(x)), np.int64)
                for tree in range(TREES):
                    shared = BITS - np.frexp((strings[:, tree, None] ^ code[None, :, tree]).astype(np.float64))[1]
                    best = np.maximum(best, shared)
                    for b in np.unique(band).tolist():
                        places = (rows * (BITS + 1) + shared[:, band == b]).ravel()
                        seen[b] = seen.get(b, 0) + np.bincount(places, minlength=len(own) * (BITS + 1))
                products = own @ x.T
                near = np.argpartition(-products, min(k, len(x) - 1), axis=1)[:, : k + 1]
                yield pd.DataFrame({
                    "q": np.repeat(np.arange(len(own)), near.shape[1]), "band": band[near].ravel(), "level": best[rows, near].ravel(), "n": 0, "id": part["p"].to_numpy(np.int64)[near].ravel(), "score": products[rows, near].ravel(),
                })
        for b, n in seen.items():
            yield pd.DataFrame({"q": np.repeat(np.arange(len(own)), BITS + 1), "band": b, "level": np.tile(np.arange(BITS + 1), len(own)), "n": n, "id": -1, "score": 0.0})

    held = materialise(points.select("p", "band", "v").mapInPandas(run, "q int, band int, level int, n long, id long, score double"), "sample")
    counts = {b: np.zeros((len(own), BITS + 1), np.int64) for b in sizes}
    for r in held.where("n > 0").groupBy("band", "q", "level").agg(F.sum("n").alias("n")).collect():  # SAMPLE * (BITS + 1) a band at most
        counts[r["band"]][r["q"], r["level"]] = r["n"]
    counts = {b: c[:, ::-1].cumsum(1)[:, ::-1] for b, c in counts.items()}  # of points that share so many bits or more
    ids = F.element_at(F.array(*map(F.lit, asked.tolist())), F.col("q") + 1)
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    near = held.where("n = 0").where(F.col("id") != ids).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("q", "band", "level").collect()
    for share in shares:
        # the deepest level at which enough points share a prefix, -1 where there are too few in all
        levels = {b: (c >= max(least, share * sizes[b])).sum(1) - 1 for b, c in counts.items()}
        if sum(r["level"] >= levels[r["band"]][r["q"]] for r in near) >= TARGET * len(near):
            break
    return share, {b: max(0, min(int(x.min()) - 1, math.ceil(math.log2(sizes[b] / BLOCK)))) for b, x in levels.items()}


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None, least: int | None = None, seed: int = 11
) -> DataFrame:
    """For each row whose id is divisible by every: its k nearest found among all other rows.

    Returns query_id, rank (from 1), vec_id, score (inner product in double precision); ties go to the smaller
    id. Rows whose vector is null, zero, of another length than most or holds nulls or non-finite numbers take
    no part, nor do null ids. Rows that repeat an id are rows like others: each is a candidate of the rest, and each that
    asks gets an answer of its own. Fewer candidates than k are all returned, and an empty table gives no rows. Other
    columns, whatever their names, do not come along.

    Without a share the forest takes the one that calibrated() fits, and at least `least` candidates, LEAST * k if that
    is not given. Equal vectors are one point and searched once: of any vector only the k + 1 smallest ids can appear in
    a result. Buckets larger than BLOCK are split into blocks, and so are their queries, so a task holds about BLOCK of
    either however common a prefix is.
    """
    least = least or LEAST * k
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    sound = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    )
    sound = materialise(sound, "vectors")
    dims = sound.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return sound.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dim = dims[0]["dim"]
    sound = sound.where(F.size("v") == dim)
    order = W.partitionBy("v").orderBy("vec_id")
    members = materialise(sound.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1), "members")
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    points = members.where("_n = 1").select(
        F.monotonically_increasing_id().alias("p"), F.col("vec_id").alias("first_id"), "v", F.least(F.greatest(square, F.lit(1e-300)), F.lit(1e300)).alias("_s")
    )
    points = materialise(points, "points")  # from here on p names a vector
    longest = points.agg(F.max("_s")).first()[0]
    points = points.withColumn("band", F.floor(F.log2(F.lit(longest)) - F.log2("_s")).cast("int"))
    asks = sound.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("v", F.col("vec_id").alias("query_id")).agg(F.count("*").cast("int").alias("copies"))
    asks = materialise(asks.join(points.select("p", "v"), "v").select(F.col("p").alias("q"), "query_id", "copies"), "asks")
    queries = materialise(asks.select("q").distinct().join(points.select(F.col("p").alias("q"), "first_id", "v"), "q"), "queries")

    tops, sizes = {}, {}
    for r in points.groupBy("band").agg(F.count("*").alias("n"), F.max("_s").alias("top")).collect():  # a row for each halving of norms
        tops[r["band"]], sizes[r["band"]] = r["top"], r["n"]
    points = points.drop("_s")
    planes = directions(dim, seed)
    share, depths = calibrated(points, queries, planes, tops, sizes, [share] if share else SHARES, least, k)
    spark = vectors.sparkSession
    bands = F.broadcast(spark.createDataFrame(
        [(b, -(-m // BLOCK), float(max(least, share * m)), depths[b]) for b, m in sizes.items()], "band int, _scan_blocks int, _goal double, _depth int"
    ))
    where = ["band", "tree", "prefix", "block", "part"]
    ids = queries.select(F.col("q").alias("id"))

    def rows(band, code: np.ndarray, depth: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        m = len(own)
        return pd.DataFrame({
            "band": np.repeat(np.broadcast_to(np.asarray(band, np.int32), m), TREES), "tree": np.tile(np.arange(TREES, dtype=np.int32), m),
            "prefix": (code >> (BITS - depth)).ravel(), "code": code.ravel(), "id": np.repeat(own, TREES),
        })

    def explode(is_query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 1024):
                    part = pdf.iloc[at : at + 1024]
                    x = np.array(part["v"].tolist(), np.float64).reshape(len(part), dim)
                    own = part["id"].to_numpy(np.int64)
                    if is_query:
                        code = hash_strings(np.column_stack([x, np.zeros(len(x))]), planes)
                        for band, depth in depths.items():
                            yield rows(band, code, np.int64(depth), own)
                        continue
                    band = part["band"].to_numpy(np.int32)
                    code = point_strings(x, band, tops, planes)
                    yield rows(band, code, np.array([depths[b] for b in band.tolist()], np.int64)[:, None], own)
        return run

    def count(key, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        strings = np.sort(have["code"].to_numpy(np.int64))
        code = ask["code"].to_numpy(np.int64)
        out = {"id": ask["id"].to_numpy(np.int64), "band": np.full(len(ask), key[0], np.int32)}
        for j in range(LEVELS + 1):
            level = min(depths[key[0]] + j, BITS)
            low = code >> (BITS - level) << (BITS - level)
            out[f"c{j}"] = np.searchsorted(strings, low + (1 << (BITS - level))) - np.searchsorted(strings, low)
        return pd.DataFrame(out)

    schema = "band int, tree int, prefix long, code long, id long"
    coded = materialise(points.select(F.col("p").alias("id"), "band", "v").mapInPandas(explode(False), schema), "codes")
    asking = materialise(queries.select(F.col("q").alias("id"), "v").mapInPandas(explode(True), schema), "asking")
    # a bucket's points lie in blocks and its queries in parts, so that a task holds one of each
    cut = lambda c: F.ceil(F.count("*") / BLOCK).cast("int").alias(c)
    every_one = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    buckets = coded.groupBy(*where[:3]).agg(cut("_blocks")).join(asking.groupBy(*where[:3]).agg(cut("_parts")), where[:3])
    coded = coded.join(buckets, where[:3]).select(*where[:3], one_of("id", "_blocks").alias("block"), every_one("_parts").alias("part"), "code", "id")
    asking = asking.join(buckets, where[:3]).select(*where[:3], every_one("_blocks").alias("block"), one_of("id", "_parts").alias("part"), "code", "id")
    names = [f"c{j}" for j in range(LEVELS + 1)]
    counts = asking.groupBy(*where).cogroup(coded.groupBy(*where)).applyInPandas(count, "id long, band int, " + ", ".join(f"{c} long" for c in names))
    total = counts.groupBy("id", "band").agg(*(F.sum(c).alias(c) for c in names))
    # level -1: all trees' buckets together hold too few, so the query goes on up to the empty prefix
    level = F.lit(-1)
    for j, x in enumerate(names):
        level = F.when(F.coalesce(F.col(x), F.lit(0)) >= F.col("_goal"), F.least(F.col("_depth") + j, F.lit(BITS))).otherwise(level)
    every_band = ids.crossJoin(bands)
    at = materialise(every_band.join(total, ["id", "band"], "left").select("id", "band", level.alias("level")), "levels")
    rest = at.where("level < 0").select("id", "band")
    scanned = [r["band"] for r in rest.select("band").distinct().collect()]
    sides = [asking.join(at.where("level >= 0"), ["id", "band"]).select(*where, "code", "id", "level")]
    stores = [coded.select(*where, "code", "id")]
    if scanned:
        whole = [F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("prefix")]
        sizes = rest.groupBy("band").agg(cut("_parts")).join(bands.select("band", "_scan_blocks"), "band")
        code = F.lit(0).cast("long").alias("code")
        sides.append(rest.join(sizes, "band").select("band", *whole, every_one("_scan_blocks").alias("block"), one_of("id", "_parts").alias("part"), code, "id", F.lit(0).alias("level")))
        stores.append(points.join(sizes, "band").select("band", *whole, one_of("p", "_scan_blocks").alias("block"), every_one("_parts").alias("part"), code, F.col("p").alias("id")))
    asking, coded = functools.reduce(DataFrame.unionByName, sides), functools.reduce(DataFrame.unionByName, stores)
    asking = asking.join(queries.select(F.col("q").alias("id"), "v"), "id").select(*where, "code", "id", "level", "v")
    coded = coded.join(points.select(F.col("p").alias("id"), "v"), "id").select(*where, "code", "id", "v")

    none = pd.DataFrame({"q": np.zeros(0, np.int64), "p": np.zeros(0, np.int64), "low": np.zeros(0), "high": np.zeros(0)})

    def score(key, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        """Of a query's candidates in a block those that may be among its k + 1 best, with bounds of their products: the
        library that multiplies matrices adds in an order of its own, so its products are off by a little."""
        if not len(ask) or not len(have):
            return none
        have = have.sort_values(["code", "id"])
        strings, ids = have["code"].to_numpy(np.int64), have["id"].to_numpy(np.int64)
        x = np.array(have["v"].tolist(), float).reshape(-1, dim)
        lengths = np.linalg.norm(x, axis=1)
        out = [none]
        shift = BITS - ask["level"].to_numpy(np.int64)
        low = ask["code"].to_numpy(np.int64) >> shift << shift
        begin, end = np.searchsorted(strings, low), np.searchsorted(strings, low + (np.int64(1) << shift))
        for (a, b), own in ask.assign(begin=begin, end=end).groupby(["begin", "end"]):
            if a == b:
                continue
            for i in range(0, len(own), 1024):
                some = own.iloc[i : i + 1024]
                y = np.array(some["v"].tolist(), float).reshape(-1, dim)
                products = y @ x[a:b].T
                slack = 2 * dim * np.finfo(float).eps * np.linalg.norm(y, axis=1)[:, None] * lengths[None, a:b] + np.finfo(float).tiny
                slack[~np.isfinite(products)] = 0
                lows, m = products - slack, min(k + 1, b - a)
                cut = -np.partition(-lows, m - 1, axis=1)[:, m - 1]
                r, c = np.nonzero(products + slack >= cut[:, None])
                out.append(pd.DataFrame({"q": some["id"].to_numpy(np.int64)[r], "p": ids[a + c], "low": lows[r, c], "high": (products + slack)[r, c]}))
        return pd.concat(out)

    near = asking.groupBy(*where).cogroup(coded.groupBy(*where)).applyInPandas(score, "q long, p long, low double, high double")
    near = near.groupBy("q", "p").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    own = W.partitionBy("q")
    near = near.withColumn("_n", F.row_number().over(own.orderBy(F.desc("low"))))
    near = near.withColumn("_cut", F.min(F.when(F.col("_n") <= k + 1, F.col("low"))).over(own)).where(F.col("high") >= F.col("_cut"))
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    # k + 1 vectors, and of their rows k + 1: one of them may be the query's own
    best = near.join(queries.select("q", F.col("v").alias("qv")), "q").join(points.select("p", "first_id", "v"), "p").select("q", "p", "first_id", exact.alias("score"))
    best = best.withColumn("_n", F.row_number().over(own.orderBy(F.desc("score"), "first_id", "p"))).where(F.col("_n") <= k + 1)
    members = members.join(points.select("p", "v"), "v").select(
        "p", "vec_id", (F.row_number().over(W.partitionBy("p", "vec_id").orderBy("_n")) == 1).alias("first")
    )
    best = best.select("q", "p", "score").join(members, "p")
    best = best.withColumn("_n", F.row_number().over(own.orderBy(F.desc("score"), "vec_id", "p", F.desc("first")))).where(F.col("_n") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_n", "p", "vec_id", "first", "score"))).alias("found"))  # k + 1 at most
    others = F.filter("found", lambda x: ~((x["p"] == F.col("q")) & (x["vec_id"] == F.col("query_id")) & x["first"]))
    answers = asks.join(lists, "q").withColumn("found", F.slice(others, 1, k))
    answers = answers.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return answers.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
