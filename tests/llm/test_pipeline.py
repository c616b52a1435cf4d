import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cohortrank.llm import quality_model
from cohortrank.llm.queries import oracle_sql, queries
from tests.llm.test_lines_quality import brute_base, brute_lines, words
from tests.llm.test_near_duplicates import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, junk, exact and near copies, and a line that several documents share."""
    rng, rows = random.Random(12), []
    for _ in range(70):
        rows.append("\n".join(f"{words(rng, rng.randint(8, 30)).capitalize()}." for _ in range(rng.randint(1, 5))))
    rows += [" ".join(f"{w.upper()}!!" for w in words(rng, 40).split()) for _ in range(25)]
    rows += ["too short", None, "", "again and again and again " * 20]
    rows += [rows[3], rows[3], rows[5].replace(rows[5].split()[2], "changed", 1)]
    rows += [f"{words(rng, 25).capitalize()}.\nThis one line stands in several documents of the corpus." for _ in range(4)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(not 70 <= i < 95), 0) for i in range(95)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, [(i, t) for i, t, *_ in docs]


def test_run_equals_the_plain_version(spark, corpus):
    path, rows = corpus
    kept = []
    for i, t in rows:
        b = brute_base(t)
        if b[0] >= 10 and 100 * b[4] <= 20 * b[0]:
            kept.append((i, t))
    model = quality_model.learn(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    kept = [(i, t) for i, t in kept if model.score(np.array([quality_model.features(t)]))[0] >= 0.5]
    assert {i for i, _ in kept} >= set(range(60)) - {i for i in range(60) if brute_base(rows[i][1])[0] < 10} and not any(70 <= i < 95 for i, _ in kept)
    kept = [(i, t) for i, t in brute_lines(kept) if t.strip(" \t\n\v\f\r")]
    groups = brute(kept)
    kept = [(i, t) for i, t in kept if any(g == (i, g[1], i) for g in groups)]
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own.encode_special_tokens = True
    want = Counter((i, len(own.encode(t, add_special_tokens=False).ids) + 1) for i, t in kept)
    out = corpus_pipeline.run(spark, path).collect()
    assert not {r.doc_id for r in out} & {99, 100}  # exact copies of document 3
    assert Counter((r.doc_id, r.length) for r in out) == want
    assert len({r.sequence_id for r in out}) == -(-sum(n for _, n in want) // 4096)


def test_stages_keep_the_columns_of_documents(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "near_duplicates", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema.simpleString() == docs.schema.simpleString()


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())
