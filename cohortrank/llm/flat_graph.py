"""Near duplicates among vectors by range search on a robust-pruned flat graph.

Vectors of one label that lie closely together are first gathered into beads: all of a bead's members are linked with each
other by the triangle inequality, so a group of n copies costs one node and not n * n comparisons. Beads are dealt to
overlapping clusters, each a shard in which a graph is built: a node keeps near neighbours that no kept one makes
superfluous, and a few far ones. A node's lists from all shards are united. Every bead then searches its shards from their
medoids, first greedily, then over all neighbours of what lies in range; neighbours in other shards are followed by joins,
round by round. Pairs of beads are decided by their distance and radii, and what these leave open by exact comparison of
members. A sample of vectors is held against all others to audit the recall.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrank.llm.common import materialise
from cohortrank.llm.components import components

#: Nodes of a shard at most; rows that are dealt to clusters at once; clusters that a large one is cut into at most.
SHARD, DEALT, FAN = 512, 8192, 64
#: Near candidates of a node, neighbours that it keeps of them, far neighbours, and how much nearer a kept one must be.
NEAR, DEGREE, FAR, ALPHA = 48, 20, 4, 1.2
#: Nodes beyond the range that a search expands at most; queries searched at once.
LIST, QUERIES = 24, 512
#: Vectors of the audit, the recall it asks for, and clusterings made before and until it is reached.
SAMPLE, TARGET, FIRST, LAST = 256, 0.99, 2, 5
#: Rounding of angles.
EPS = 1e-6


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def cells(items: DataFrame, seed: int, nearest: int) -> DataFrame:
    """items (label, node, v and others) with a cell of at most SHARD rows of one label, each row in the cells of its nearest
    pivots.

    A cell that is too large is cut by pivots drawn from it by hash, rows being dealt in parts of about DEALT whatever
    the cell's size; what many cuts leave too large is divided by hash.
    """
    state = items.withColumn("cell", F.lit(0).cast("long"))
    whole: list[DataFrame] = []
    for turn in range(12):
        sizes = state.groupBy("label", "cell").agg(F.count("*").alias("_n"))
        big = materialise(sizes.where(F.col("_n") > SHARD), "big")
        if big.isEmpty():
            break
        held = materialise(state, "dealing")
        whole.append(held.join(big.select("label", "cell"), ["label", "cell"], "left_anti"))
        own = held.join(big, ["label", "cell"]).withColumn("_hash", F.xxhash64(F.lit(seed), F.lit(turn), "node"))
        fan = F.least(F.lit(FAN), F.greatest(F.lit(4), F.ceil(2 * F.col("_n") / SHARD)))
        salts = F.ceil(F.col("_n") / DEALT)
        drawn = F.pmod("_hash", F.lit(1 << 40)) < fan * float(1 << 40) / F.col("_n")
        pivots = own.where(drawn).select("label", "cell", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("_salt"), F.col("_hash").alias("pivot"), F.col("v").alias("p"))
        dealt = own.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit(turn)), salts).cast("int")).drop("_n", "_hash")
        pivots, dealt = (x.toDF(*x.columns) for x in (pivots, dealt))  # columns of their own

        def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            if not len(near) or not len(rows):
                return rows.drop(columns="_salt")
            near = near.sort_values("pivot")
            product = matrix(rows["v"]) @ matrix(near["p"]).T
            k = min(nearest, len(near))
            best = np.argsort(-product, axis=1, kind="stable")[:, :k]
            out = rows.iloc[np.repeat(np.arange(len(rows)), k)].drop(columns="_salt")
            named = near["pivot"].to_numpy(np.int64)[best.ravel()]
            return out.assign(cell=np.bitwise_xor(named, out["cell"].to_numpy(np.int64) * 31))

        on = ["label", "cell", "_salt"]
        state = materialise(dealt.groupBy(*on).cogroup(pivots.groupBy(*on)).applyInPandas(assign, held.schema), "dealt")
    else:
        parts = F.ceil(F.count("*") / SHARD).cast("int").alias("_n")
        last = state.join(state.groupBy("label", "cell").agg(parts), ["label", "cell"])
        whole.append(last.withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("node"), "_n"))).drop("_n"))
        return functools.reduce(DataFrame.unionByName, whole)
    return functools.reduce(DataFrame.unionByName, [*whole, state])


def gathered(items: DataFrame, theta: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Beads of items (label, node, v, radius, weight, least): the bead of each node, and the beads in the form of items.

    A leader takes what lies, radius included, within half the range of it, so all members of a bead are in range of each
    other; a bead's place is its members' mean, its radius reaches all of them.
    """
    half = theta / 2 - EPS

    def lead(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node").reset_index(drop=True)
        x, r = matrix(own["v"]), own["radius"].to_numpy(np.float64)
        reach = angle(x @ x.T) + r
        reach[np.arange(len(x)), np.arange(len(x))] = r
        leader, node = np.full(len(x), -1), own["node"].to_numpy(np.int64)
        centre: list = [None] * len(x)
        radius = np.zeros(len(x))
        for i in range(len(x)):
            if leader[i] >= 0:
                continue
            mine = (leader < 0) & (reach[i] <= half) if r[i] <= half else np.zeros(len(x), bool)
            mine[i] = True
            leader[mine] = i
            if mine.sum() == 1:
                centre[i], radius[i] = x[i].tolist(), r[i]
                continue
            mean = (x[mine] * own["weight"].to_numpy(np.float64)[mine, None]).sum(0)
            mean /= np.linalg.norm(mean)
            centre[i], radius[i] = mean.tolist(), float((angle(x[mine] @ mean) + r[mine]).max()) + EPS
        return pd.DataFrame({"label": own["label"], "node": node, "bead": node[leader], "v": centre, "radius": radius, "weight": own["weight"], "least": own["least"]})

    dealt = cells(items, seed, 1)
    fields = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    led = materialise(dealt.groupBy("label", "cell").applyInPandas(lead, f"label {fields['label']}, node long, bead long, v array<double>, radius double, weight long, least long"), "beads")
    sums = led.groupBy("bead").agg(F.sum("weight").alias("weight"), F.min("least").alias("least"))
    beads = led.where("node = bead").select("label", "node", "v", "radius").join(sums.withColumnRenamed("bead", "node"), "node")
    return led.select("node", "bead"), materialise(beads.select(*items.columns), "bead_items")


def pruned(x: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Of each node's candidates (nearest first, -1: none) those that robust pruning keeps, -1 for the others: a candidate
    goes if a kept one is ALPHA times nearer to it than the node is."""
    n, m = near.shape
    far = lambda a, b: np.sqrt(np.maximum(0, 2 - 2 * np.einsum("...d,...d->...", a, b)))
    valid = near >= 0
    own = far(x[:, None, :], x[near])
    alive, count = valid.copy(), np.zeros(n, int)
    for j in range(m):
        take = alive[:, j] & (count < keep)
        alive[:, j] = take
        count += take
        rows = np.flatnonzero(take)
        if j + 1 < m and len(rows):
            between = far(x[near[rows, j]][:, None, :], x[near[rows, j + 1 :]])
            alive[rows, j + 1 :] &= ALPHA * between > own[rows, j + 1 :]
    return np.where(alive, near, -1)


def shard_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of each node: pruned near ones, links back, and far ones that keep the graph connected."""
    n = len(x)
    x32 = x.astype(np.float32)
    product = x32 @ x32.T
    np.fill_diagonal(product, -2)
    m = min(NEAR, n - 1)
    if m < 1:
        return [np.zeros(0, np.int64)] * n
    near = np.argpartition(-product, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(product, near, 1), axis=1, kind="stable"), 1)
    out = pruned(x32, near, DEGREE)
    a, b = np.repeat(np.arange(n), m), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    both = np.unique(np.concatenate([a * n + b, b * n + a]))  # links back
    a, b = both // n, both % n
    order = np.lexsort((-product[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    lists = np.full((n, 2 * NEAR), -1)
    few = place < 2 * NEAR
    lists[a[few], place[few]] = b[few]
    lists = pruned(x32, lists, DEGREE + DEGREE // 2)
    distant = np.random.default_rng(seed).integers(0, n, (n, FAR))
    return [np.unique(np.concatenate([own[own >= 0], some[some != i]])) for i, (own, some) in enumerate(zip(lists, distant, strict=True))]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.sum(0)).argmax())


def search_shard(x: np.ndarray, radius: np.ndarray, adjacency: np.ndarray, theta: float, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within theta and both radii that all nodes find as queries, from the medoid.

    The nearest unexpanded node is expanded until LIST nodes beyond the range were; what is in range is always expanded.
    A query that has not met its own node by then goes on from there.
    """
    x32 = x.astype(np.float32)
    asks, finds = [], []
    for low in range(0, len(x), QUERIES):
        q = np.arange(low, min(low + QUERIES, len(x)))
        at = np.arange(len(q))
        reach = np.cos(np.minimum(math.pi, theta + radius[q, None] + radius[None, :] + 1e-3)).astype(np.float32)
        near = np.full((len(q), len(x)), -3, np.float32)  # products with the nodes met
        open_ = near.copy()  # of those not expanded
        first = x32[q] @ x32[begin]
        near[:, begin] = open_[:, begin] = first
        spent = np.zeros(len(q), int)
        restarted = False
        active = np.ones(len(q), bool)
        while True:
            rows = at[active]
            best = open_[rows].argmax(1)
            value = open_[rows, best]
            inside = value >= reach[rows, best]
            going = (value > -3) & (inside | (spent[rows] < LIST))
            active[rows[~going]] = False
            rows, best, inside = rows[going], best[going], inside[going]
            if not len(rows):
                if restarted:
                    break
                restarted = True
                lost = at[near[at, q] == -3]
                near[lost, q[lost]] = open_[lost, q[lost]] = 1.0
                active[lost] = True
                if not len(lost):
                    break
                continue
            spent[rows] += ~inside
            open_[rows, best] = -3
            links = adjacency[best]
            i, j = np.nonzero(links >= 0)
            i, j = rows[i], links[i, j]
            fresh = near[i, j] == -3
            i, j = i[fresh], j[fresh]
            near[i, j] = open_[i, j] = np.einsum("nd,nd->n", x32[q[i]], x32[j])
        i, j = np.nonzero((near >= reach) & (near > -3))
        other = q[i] != j
        asks.append(q[i][other])
        finds.append(j[other])
    return np.concatenate(asks), np.concatenate(finds)


def built(shards: DataFrame, seed: int) -> DataFrame:
    """node and its neighbours in each of its shards."""

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        node = own["node"].to_numpy(np.int64)
        return pd.DataFrame({"node": node, "links": [node[i].tolist() for i in shard_graph(matrix(own["v"]), seed)]})

    return shards.groupBy("label", "cell").applyInPandas(build, "node long, links array<long>")


def searched(shards: DataFrame, theta: float) -> DataFrame:
    """From shards whose rows hold the united links: pairs (a, b) in range, and with inside false those that a link from a
    pair in range leads to outside the shard."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        node, x = own["node"].to_numpy(np.int64), matrix(own["v"])
        size = own["links"].map(len).to_numpy()
        flat = np.concatenate([np.asarray(i, np.int64) for i in own["links"]]) if size.sum() else np.zeros(0, np.int64)
        home = np.searchsorted(node, flat).clip(max=len(node) - 1)
        home = np.where(node[home] == flat, home, -1) if len(flat) else home
        row, place = np.repeat(np.arange(len(node)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        adjacency = np.full((len(node), max(1, size.max(initial=1))), -1)
        adjacency[row, place] = home
        a, b = search_shard(x, own["radius"].to_numpy(np.float64), adjacency, theta, medoid(x))
        outer = pd.DataFrame({"b": row[home < 0], "z": flat[home < 0]})
        leads = pd.DataFrame({"a": a, "b": b}).merge(outer, on="b")[["a", "z"]].drop_duplicates()
        return pd.concat([pd.DataFrame({"a": node[a], "b": node[b], "inside": True}), pd.DataFrame({"a": node[leads["a"].to_numpy(int)], "b": leads["z"].to_numpy(np.int64), "inside": False})])

    return shards.groupBy("label", "cell").applyInPandas(run, "a long, b long, inside boolean")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bead_pairs(beads: DataFrame, theta: float, seeds: list[int]) -> DataFrame:
    """Pairs (a, b, apart), a < b, of beads that the search finds within theta and both radii."""
    clusterings = [materialise(cells(beads.select("label", "node", "v", "radius"), seed, 2).withColumn("cell", F.xxhash64("cell", F.lit(seed))), "shards") for seed in seeds]
    shards = functools.reduce(DataFrame.unionByName, clusterings)
    lists = functools.reduce(DataFrame.unionByName, [built(c, s) for c, s in zip(clusterings, seeds, strict=True)])
    # a node lies in two clusters of each cut at most, so its lists are few
    graph = materialise(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "graph")
    met = materialise(searched(shards.join(graph, "node"), theta), "met")
    point = lambda side: beads.select(F.col("node").alias(side), F.col("v").alias(f"v{side}"), F.col("radius").alias(f"r{side}"))

    def kept(pairs: DataFrame) -> DataFrame:
        apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("va", "vb"))))
        near = pairs.join(point("a"), "a").join(point("b"), "b").withColumn("apart", apart)
        return materialise(near.where(F.col("apart") <= theta + F.col("ra") + F.col("rb") + EPS).select("a", "b", "apart"), "pairs")

    pair = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    found = [kept(pair(met.where("inside"), "a", "b"))]
    tried = pair(met, "a", "b")
    new = kept(pair(met.where("NOT inside"), "a", "b").join(found[0], ["a", "b"], "left_anti"))
    for _ in range(50):  # each round goes one link further; most find nothing at once
        if new.isEmpty():
            break
        found.append(new)
        ends = new.select("a", "b").unionAll(new.select(F.col("b").alias("a"), F.col("a").alias("b")))
        further = materialise(pair(ends.join(graph.withColumnRenamed("node", "b"), "b").select("a", F.explode("links").alias("c")), "a", "c").join(tried, ["a", "b"], "left_anti"), "further")
        tried = tried.unionAll(further)
        new = kept(further)
    return functools.reduce(DataFrame.unionByName, found)


def counted(pairs: DataFrame, beads: DataFrame, members: DataFrame, least: float, theta: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of all members of a bead (bead, n), links of single members (node, n), and linked beads (a, b).

    Beads whose farthest members are in range are linked as a whole; pairs whose nearest members may or may not be are
    compared member by member, in blocks of at most SHARD by SHARD.
    """
    info = lambda side: beads.select(F.col("node").alias(side), F.col("radius").alias(f"r{side}"), F.col("weight").alias(f"w{side}"))
    known = materialise(pairs.join(info("a"), "a").join(info("b"), "b"), "known")
    sure = F.col("apart") + F.col("ra") + F.col("rb") <= theta - EPS
    whole = known.where(sure)
    by_bead = whole.select(F.col("a").alias("bead"), F.col("wb").alias("n")).unionAll(whole.select(F.col("b").alias("bead"), F.col("wa").alias("n"))).groupBy("bead").agg(F.sum("n").alias("n"))
    open_pairs = known.where(~sure).select("a", "b")
    sized = members.groupBy("bead").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("_parts"))
    parts = lambda side: sized.select(F.col("bead").alias(side), F.col("_parts").alias(f"_p{side}"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    planned = materialise(open_pairs.join(parts("a"), "a").join(parts("b"), "b"), "open")
    side = lambda own: members.select(F.col("bead").alias(own), "node", "v", "weight").join(planned, own)
    on = ["a", "b", "i", "j"]
    names = [*on, "node", "v", "weight"]
    left = side("a").select("a", "b", part("_pa").alias("i"), spread("_pb").alias("j"), *names[4:]).toDF(*names)
    right = side("b").select("a", "b", spread("_pa").alias("i"), part("_pb").alias("j"), *names[4:]).toDF(*names)

    def compare(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "node": [], "n": []}).astype(np.int64)
        hit = matrix(one["v"]) @ matrix(two["v"]).T >= least
        out = [(own["node"].to_numpy(np.int64), count.astype(np.int64)) for own, count in ((one, hit @ two["weight"].to_numpy(np.int64)), (two, hit.T @ one["weight"].to_numpy(np.int64)))]
        node, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"a": key[0], "b": key[1], "node": node[n > 0], "n": n[n > 0]})

    close = materialise(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(compare, "a long, b long, node long, n long"), "compared")
    links = whole.select("a", "b").unionAll(close.select("a", "b").distinct())
    return by_bead, close.groupBy("node").agg(F.sum("n").alias("n")), links


def audited(points: DataFrame, result: DataFrame, least: float) -> float | None:
    """Share of all links of the sample that result (node, n_links) holds; None where the sample has none. The sample is of
    the SAMPLE vectors of smallest hash and as many of those that are linked; all others are held against it."""
    by_hash = lambda df: df.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(SAMPLE).select("node")
    chosen = by_hash(points).unionAll(by_hash(result.where("n_links > 0"))).distinct()
    sample = points.join(chosen, "node").select("node", "label", "v", "weight").toPandas().sort_values("node")  # 2 * SAMPLE rows
    if not len(sample):
        return None
    places = sample.reset_index(drop=True).groupby("label").indices
    asked = {label: matrix(sample["v"].iloc[at]) for label, at in places.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(sample), np.int64)
        for pdf in batches:
            for label, some in pdf[pdf["label"].isin(list(asked))].groupby("label"):
                for at in range(0, len(some), 4096):
                    part = some.iloc[at : at + 4096]
                    total[places[label]] += (asked[label] @ matrix(part["v"]).T >= least) @ part["weight"].to_numpy(np.int64)
        yield pd.DataFrame({"node": sample["node"].to_numpy(np.int64), "n": total})

    true = points.select("label", "v", "weight").mapInPandas(run, "node long, n long").groupBy("node").agg((F.sum("n") - 1).alias("n"))
    r = true.join(result, "node").agg(F.sum("n").alias("n"), F.sum("n_links").alias("got")).first()
    return r["got"] / r["n"] if r["n"] else None


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal labels with a cosine of `least` or more, and the components they form.

    Returns for every row vec_id, n_links (other rows linked directly), component_id (the smallest id reachable, the row's
    own included), kept (vec_id = component_id) and audit_recall (share of the links of a sample, searched exactly, that
    were found; null where it has none). Vectors that are null, empty, zero or hold null or non-finite components and rows
    with a null label or id link with nothing. Rows that repeat an id are vectors of their own. Vectors of different
    lengths never link. An empty table gives no rows. Other columns do not come along. `least` must be above 0, so that
    half its angle is below a quarter turn.

    The search is approximate: while the audit finds less than TARGET of the links, another clustering is added to the
    graph, up to LAST. A link that is found is always exact.
    """
    theta = math.acos(least)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = rows.withColumn("_sound", sound).withColumn("v", F.when(F.col("_sound"), F.transform("v", lambda x: x / top)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = scaled.withColumn("v", F.transform("v", lambda x: x / norm))
    # vectors of other lengths get a label of their own
    unit = unit.withColumn("label", F.struct(F.col("label"), F.size("v").alias("dim")).cast("struct<label:string,dim:int>")).withColumn("label", F.to_json("label"))
    unit = unit.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.hash("v", "label")})
    held = materialise(unit, "vectors")
    classes = held.where("_sound").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    items = points.select("label", "node", "v", F.lit(0.0).alias("radius"), "weight", "least")

    member, beads = gathered(items, theta, 1)
    before, now = items.count(), beads.count()
    turn = 2
    while now < 0.9 * before and turn <= 6:  # a large group fills many cells, so their beads are gathered again
        above, beads = gathered(beads, theta, turn)
        member = materialise(member.join(above.select(F.col("node").alias("bead"), F.col("bead").alias("_up")), "bead").select("node", F.col("_up").alias("bead")), "members")
        before, now, turn = now, beads.count(), turn + 1
    members = materialise(points.select("node", "v", "weight").join(member, "node"), "members")

    for n in range(FIRST, LAST + 1):
        pairs = bead_pairs(beads, theta, [100 + i for i in range(n)])
        by_bead, by_node, links = counted(pairs, beads, members, least, theta)
        whole = beads.select(F.col("node").alias("bead"), F.col("weight").alias("_own")).join(by_bead.withColumnRenamed("n", "_all"), "bead", "left")
        result = members.select("node", "bead").join(whole, "bead").join(by_node.withColumnRenamed("n", "_some"), "node", "left")
        n_links = F.col("_own") - 1 + F.coalesce("_all", F.lit(0)) + F.coalesce("_some", F.lit(0))
        result = materialise(result.select("node", "bead", n_links.alias("n_links")), "links")
        recall = audited(points, result.select("node", "n_links"), least)
        if recall is None or recall >= TARGET:
            break

    root = components(links).withColumnsRenamed({"node": "bead", "component": "root"})
    placed = beads.select(F.col("node").alias("bead"), "least").join(root, "bead", "left").withColumn("root", F.coalesce("root", "bead"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_bead = placed.join(smallest, "root").select("bead", "component_id")
    of_class = points.select("node", "k1", "k2").join(result.join(of_bead, "bead"), "node").select("k1", "k2", "n_links", "component_id")
    linked = held.where("_sound").select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = held.where("NOT _sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumns({"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)), "audit_recall": F.lit(recall).cast("double")})
