"""Each registered query on a small directory, held to its contract."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cohortrank.llm.bpe import load_ranks
from cohortrank.llm.queries import queries
from tests.llm.test_lines_quality import words
from tests.llm.test_near_duplicates import brute


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng, path = random.Random(31), str(tmp_path_factory.mktemp("given"))
    texts = ["\n".join(words(rng, rng.randint(2, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " more", None, "", " \n ", "word " * 9000, "é日本 🙂\tx", "too few"]
    docs = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(rng.random() < 0.7), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, [(i, t) for i, t, *_ in docs], vectors


def rows(spark, given, name):
    return queries()[name](spark, given[0]).collect()


def test_op1(spark, given):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in given[1]:
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, given, "op1_byte_bpe")} == want


def test_op2(spark, given):
    out = rows(spark, given, "op2_line_templates")
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in given[1])
    assert {r.doc_id: r.n_lines for r in out} == {i: 0 if t is None else t.count("\n") + 1 for i, t in given[1]}
    assert all(r.n_dropped == r.n_lines for r in out if r.doc_id in (60, 61))


def test_op3(spark, given):
    out = rows(spark, given, "op3_byte_shards")
    assert {(r.doc_id, r["size"], r.text_crc32) for r in out} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in given[1]}
    slots = defaultdict(list)
    for r in out:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op4(spark, given):
    out, bins, pieces = rows(spark, given, "op4_best_fit_packing"), defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert set(pieces) == {i for i, _ in given[1]} and all([s for _, s, _ in sorted(x)] == [4096 * k for k in range(len(x))] for x in pieces.values())


def test_op6(spark, given):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sums = Counter()
    for r in rows(spark, given, "op6_token_counts"):
        sums[r.doc_id] += r.n_tokens
    assert sums == Counter({i: len(own.encode_ordinary(t or "")) for i, t in given[1]}) + Counter()


def test_op7(spark, given):
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows(spark, given, "op7_jaccard_join")), key=str) == brute(given[1])


def test_op8(spark, given):
    out = rows(spark, given, "op8_bradley_terry")
    assert {(r.doc_id, r.held_out) for r in out} == {(i, zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in given[1]}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_op10(spark, given):
    got = defaultdict(list)
    for r in sorted(rows(spark, given, "op10_prefix_forest"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    x = {i: np.array(v, np.float32).astype(float) for i, v in given[2]}
    assert got == {q: sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20] for q in x if q % 20 == 0}
