import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cohortrank.llm import prefix_forest, warc


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, p in data:
        if i is not None and len(p) >= 1000:
            last[p] = max(last.get(p, i), i)
    out = Counter()
    for i, p in data:
        again = i is not None and p in last and i < last[p]
        out[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again else None)] += 1
    return out


def test_pages_come_back_as_written(spark, tmp_path):
    rng = random.Random(9)
    page = lambda n: "".join(rng.choices("abc <>\r\n", k=n))
    big, tricky = page(30_000), ("WARC/1.1\r\n" * 900) + "x" * 8100 + "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "u", tricky), (6, "u", tricky), (7, "é", "é" * 5000), (8, "s", "short"), (9, "s", "short"), (None, "n", big), (10, "d", page(2000)), (10, "d", page(9000))]
    rows += [(20 + i, f"http://{i}", page(rng.randint(0, 20_000))) for i in range(40)]
    path = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({}).repartition(3), path)
    out = warc.read_warc(spark, path).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == expected(rows)
    assert all(r.intact for r in out)
    bodies = Counter(r.page_id for r in out if r.record_type == "response" and bytes(r.payload) == next(((h or "").encode() for i, _, h in rows if i == r.page_id and len((h or "").encode()) == r.payload_bytes), None))
    assert sum(bodies.values()) == sum(r.record_type == "response" for r in out)


def test_damage_is_reported(spark, tmp_path):
    own = list(warc.page_records(1, "u", b"x" * 40_000, hashlib.sha1(b"x" * 40_000).hexdigest(), None, "<urn:a>"))
    assert len(own) > 2
    (tmp_path / "cut.warc").write_bytes(b"".join(own[:1] + own[2:]))  # a segment is missing
    assert [r.intact for r in warc.read_warc(spark, str(tmp_path / "cut.warc")).collect()] == [False]
    (tmp_path / "whole.warc").write_bytes(b"".join(own[::-1]))  # segments in any order
    assert [r.intact for r in warc.read_warc(spark, str(tmp_path / "whole.warc")).collect()] == [True]


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 4096, b"x" * 4097, b"WARC/1.1\r\n" * 3, b"y" * 4090 + b"WARC/1.1\r\n"])
def test_chunks(payload):
    framed = warc.chunked(payload)
    assert warc.dechunked(framed) == payload and warc.VERSION not in framed
    if payload:
        with pytest.raises(ValueError):
            warc.dechunked(framed[: len(framed) // 2])


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def brute(rows, k, every):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted(((sum(a * b for a, b in zip(ok[q].tolist(), v.tolist(), strict=True)), i) for i, v in ok.items() if i != q), key=lambda x: (-x[0], x[1]))[:k]
            out[q] = [(i, x) for x, i in s]
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(50)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = brute(rows, 20, 20), {}
    for r in prefix_forest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = prefix_forest.search(df, least=1000).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 300 and hit >= 0.9 * 20 * 300


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert prefix_forest.search(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (20, [3.0, 1.0]), (5, [1.0, 1.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in prefix_forest.search(two).orderBy("query_id", "rank").collect()] == [(0, 1, 20, 5.0), (0, 2, 5, 3.0), (20, 1, 0, 5.0), (20, 2, 5, 4.0)]


@pytest.mark.parametrize("kind", ["lognormal norms", "one long vector"])
def test_recall_with_unequal_norms_at_production_parameters(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one long vector":
        x[7] *= 100
    else:
        x *= rng.lognormal(sigma=1, size=len(x))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in prefix_forest.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 450 and all(len(f) == 20 for f in got.values())
    assert hit >= 0.95 * 20 * 450, hit / 9000


def test_queries_without_a_bucket_are_held_against_the_whole_band(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "BLOCK", 500)  # buckets of three bits
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(6000, 8))) + 40  # all on one side
    x[::1000] *= -1  # the queries on the other
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, got = brute(list(enumerate(x.tolist())), 20, 1000), {}
    for r in prefix_forest.search(df, every=1000, least=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: [i for i, _ in v] for q, v in want.items()} == got


def test_rows_that_repeat_an_id_are_candidates_and_ask_for_themselves(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 40)]
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0, 0.0]), (20, rows[19][1]), (20, rows[19][1]), (7, [9.0, 0.0, 0.0, 0.0]), (7, [9.0, 0.0, 0.0, 0.0])]
    out = {}
    for r in prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=60).collect():
        out.setdefault((r.query_id, r["rank"]), []).append((r.vec_id, round(r.score, 9)))
    asking = [at for at, (i, _) in enumerate(rows) if i % 20 == 0]
    want = {}
    for at in asking:
        near = sorted(((-sum(a * b for a, b in zip(rows[at][1], v, strict=True)), i) for n, (i, v) in enumerate(rows) if n != at))
        for rank, (s, i) in enumerate(near, 1):
            want.setdefault((rows[at][0], rank), []).append((i, round(-s, 9)))
    assert len(asking) == 5 and {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in out.items()}


def test_ties_of_many_different_vectors_go_to_the_smaller_ids(spark):
    scale = 1e9  # products near 1e18 that differ by rounding alone in another order of adding
    rows = [(20, [scale, scale, 0.0, 0.0])] + [(i, [scale, 0.0, scale * i, -scale * i]) for i in range(1, 200) if i != 20]
    out = prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in out] == [i for i in range(1, 22) if i != 20][:20] and {r.score for r in out} == {scale * scale}
