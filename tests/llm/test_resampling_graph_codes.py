"""Importance resampling, range search on the flat graph and value dictionaries, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortrank.llm import flat_graph, resampling, value_dictionaries
from cohortrank.llm.queries import oracle_sql, queries
from tests.llm.conftest import ROWS

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, most):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, share=(10, 100), least=20, most=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, most)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        n, found = features(x, most)
        w = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), w, None if i is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(able[: len(able) * share[0] // share[1]], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resample_equals_the_plain_version(spark, most):
    rng = random.Random(most)
    word = lambda: rng.choice(["Ab", "x1", "é", "日本語", "zz" * 40, "the", "it's", "A", "b" * rng.randint(1, 9)])
    docs = [(i, " \n,"[rng.randint(0, 2)].join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(r[0], r[1]) for r in ROWS] + [docs[3], docs[3], (None, docs[4][1])]
    target = [" ".join(word() for _ in range(30)) for _ in range(5)] + [None, ""]
    given = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, bucket int").repartition(5)
    out = resampling.resample(given, spark.createDataFrame([(t,) for t in target], "text string"), (40, 100), 12, most)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_resample(docs, target, (40, 100), 12, most)


def test_resample_of_little(spark, no_docs):
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(no_docs, one).collect() == []
    got = resampling.resample(one, no_docs.select("text")).collect()
    assert [(r.n_features, r["rank"]) for r in got] == [(3, None)]
    long = spark.createDataFrame([(1, "word " * 700_000), (2, "x" * 3_000_000)], "doc_id long, text string")  # above 3 MB
    assert sorted(r.n_features for r in resampling.resample(long, one, least=1, share=(1, 1)).collect()) == [1, 700_000]


def test_crc_of_spans():
    text = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    start = np.arange(0, 4000, 7)
    length = (start * 31 % 97).astype(np.int64)
    assert resampling.crc32_spans(text, start, length).tolist() == [zlib.crc32(text[a : a + n].tobytes()) for a, n in zip(start, length, strict=True)]


def test_ranks_over_many_tied_keys(spark):
    """Two scores only, so that splitters are decided by ids."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 2).alias("score")).repartition(7)
    got = {r.doc_id: r["rank"] for r in resampling.draw(rows, F.lit(True), (70, 100)).collect()}
    want = {i: k for k, i in enumerate(sorted(range(3000), key=lambda i: (-(i % 2), i))[:2100], 1)}
    assert got == {i: want.get(i) for i in range(3000)}


def plain_links(rows, least=0.93):
    """n_links and component of each row, in order."""
    x = []
    for i, label, v in rows:
        sound = i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x.append(np.array(v, float) / np.linalg.norm(v) if sound else None)
    link = [[j for j in range(len(rows)) if j != i and x[i] is not None and x[j] is not None and rows[i][1] == rows[j][1] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least] for i in range(len(rows))]
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(link):
            low = min([comp[i], *(comp[j] for j in near)]) if near else comp[i]
            changed |= low != comp[i]
            comp[i] = low
    return sorted(((rows[i][0], len(link[i]), comp[i], rows[i][0] is None or comp[i] == rows[i][0]) for i in range(len(rows))), key=str)


def clustered(rng, n, groups, dim, noise):
    """n vectors, a third of them around one centre, the rest around others or alone."""
    centres = rng.normal(size=(groups, dim))
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))
    return np.where((rng.random(n) < 0.8)[:, None], centres[which] + noise * rng.normal(size=(n, dim)), rng.normal(size=(n, dim)))


@pytest.mark.parametrize("noise", [0.05, 0.26])  # tight groups, and groups whose links lie on both sides of the limit
def test_links_equal_all_pairs(spark, noise):
    rng = np.random.default_rng(3)
    x = clustered(rng, 1500, 12, 16, noise)
    rows = [(int(i), int(i % 2), [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]
    out = flat_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.select("vec_id", "n_links", "component_id", "kept", "audit_recall").collect()), key=str)
    want = plain_links(rows)
    if noise < 0.1:
        assert got == want
    else:  # the search is approximate
        assert sum(n for _, n, *_ in got) >= 0.97 * sum(n for _, n, *_ in want) and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_links_of_odd_rows(spark, tmp_path):
    a = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (5, 1, a), (3, 1, a), (3, 1, a), (3, 2, a), (9, 2, [2.0, 4.0, 6.0, 8.0]), (11, 1, [-x for x in a]), (12, None, a), (13, 1, None), (14, 1, [0.0] * 4), (15, 1, [1.0, None, 1.0, 1.0]),
        (16, 1, [1.0, float("nan"), 1.0, 1.0]), (17, 1, [float("inf"), 1.0, 1.0, 1.0]), (None, 1, a), (18, 1, [1.0, 2.0]), (19, 1, []), (20, 1, [1e300, 2e300, 3e300, 4e300]),
    ]
    given = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, label int, embedding array<double>, node int, cell int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in flat_graph.near_duplicates(given).collect()]
    scaled = [(i, y, [c / 1e300 for c in v] if i == 20 else v) for i, y, v in rows]
    assert sorted(got, key=str) == plain_links(scaled)
    assert flat_graph.near_duplicates(given.limit(0)).collect() == []


def test_robust_pruning_and_search_reach_everything():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = flat_graph.shard_graph(x, 1)
    assert max(map(len, lists)) <= flat_graph.DEGREE + flat_graph.DEGREE // 2 + flat_graph.FAR
    adjacency = np.full((400, max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        adjacency[i, : len(own)] = own
    a, b = flat_graph.search_shard(x, np.zeros(400), adjacency, 0.4, flat_graph.medoid(x))
    near = np.arccos(np.clip(x @ x.T, -1, 1)) <= 0.4
    np.fill_diagonal(near, False)
    assert len(a) >= 0.98 * near.sum() and (np.arccos(np.clip((x[a] * x[b]).sum(1), -1, 1)) <= 0.402).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, y, [math.floor(256 * c) for c in v]) for i, y, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    book = [[cut(v, p) for *_, v in kept[:entries]] for p in range(parts)]
    find = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for *_, v in kept:
                own.setdefault(find(v, p)[1], []).append(cut(v, p))
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(book[p])])
        book = new
    digest = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    coded = [(i, y, [find(v, p) for p in range(parts)]) for i, y, v in kept]
    sums = Counter()
    for _, y, f in coded:
        sums[y] += sum(d for d, _ in f)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), sums[y], digest) for i, y, f in coded), key=str)


@pytest.mark.parametrize("n", [5, 300])
def test_codes_equal_the_plain_version(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([1, 1, 2, None]), [rng.gauss(0, 0.3) for _ in range(32)]) for i in range(n)]
    rows += [(n, 1, None), (n + 1, 2, [float("nan")] * 32), (n + 2, 2, [None] * 32), (n + 3, 9, [1.0]), (None, 7, rows[0][2]), rows[1], (3, 5, rows[2][2])]
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, code int, error int").repartition(4)
    got = sorted((tuple(r) for r in value_dictionaries.compress(given).collect()), key=str)
    assert got == plain_codes([r for r in rows if not r[2] or len(r[2]) == 32])
    assert value_dictionaries.compress(given.limit(0)).collect() == []


def test_codes_refuse_what_would_overflow(spark):
    given = spark.createDataFrame([(1, 1, [1e30] * 16)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="must lie within"):
        value_dictionaries.compress(given).collect()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_registered_query_agrees_with_its_sql(spark, name):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in queries()[name](spark, path).select(*cols).collect())
