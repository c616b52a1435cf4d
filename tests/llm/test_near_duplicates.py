import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortrank.llm import common, components, jaccard_join
from cohortrank.llm.common import filtered
from cohortrank.llm.jaccard_join import keep_one, near_duplicates


def sets_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=80):
    group = {i: i for i, _ in rows if i is not None}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    s = [(i, sets_of(t)) for i, t in rows if i is not None]
    for (a, x), (b, y) in combinations(s, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
    return sorted(((i, len(sets_of(t)), find(i) if i is not None else None) for i, t in rows), key=str)


def corpus(seed, n=160):
    """Originals, near copies in chains, documents around a shared passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 or not texts:
            texts.append([word() for _ in range(rng.randint(1, 120))])
        elif kind < 0.75:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            texts.append(t if rng.random() < 0.7 else [*t, word()])
        else:
            texts.append([word() for _ in range(rng.randint(1, 25))] + passage + [word() for _ in range(rng.randint(1, 25))])
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # small blocks send clumps through several tiles
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(near_duplicates(df)) == brute(rows)


def test_odd_rows(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs)) == brute(rows)
    assert near_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = corpus(5, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == sorted({c for _, _, c in brute(rows)})


def test_a_tile_links_each_group_once_and_bounds_never_lose_a_link():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.03], rng.integers(0, 2**63, 4).astype(np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, 190).astype(np.uint64)) for _ in range(10)]
    links = jaccard_join.tile_links(sets, np.arange(50), np.ones(50, bool), 80)
    want = defaultdict(set)
    for i, j in combinations(range(50), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            want[i].add(j)
    assert len(links) == 39 and all(j in want[i] or i in want[j] for i, j in links)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (5, 4)]
    out = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.component) for r in out} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)}


def test_odd_rows_of_a_group_stay_or_go_as_stated(spark):
    text = "one text of several words that two rows of the same id have"
    rows = [(None, text), (None, text), (5, text), (5, text), (5, "another text of that id, quite unlike the first one"), (6, text), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(*r, 1, {"k": "v"}) for r in rows], "doc_id long, text string, _bucket int, _bits map<string,string>")
    out = keep_one(df)
    assert out.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, text), (None, text), (5, text), rows[4], (7, None), (8, "")], key=str)


def test_linked_sets_share_a_cell_and_as_many_as_needed():
    rng = np.random.default_rng(8)
    for _ in range(400):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        lost = int(rng.integers(0, len(a) // 5 + 1))
        b = np.union1d(rng.choice(a, len(a) - lost, replace=False), rng.integers(0, 2**63, int(rng.integers(0, len(a) // 5 + 1))).astype(np.uint64) * np.uint64(2))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (x, needs), (y, other) = (jaccard_join.cell_signatures(s, 80) for s in (a, b))
        shared = np.intersect1d(x, y)
        counts = [int((shared % np.uint64(2) == p).sum()) for p in (0, 1)]
        assert any(n and c >= n for c, n in zip(counts, needs, strict=True)) and any(n and c >= n for c, n in zip(counts, other, strict=True))


def test_names_of_cells_and_owners_leave_two_bytes_of_zeros(spark):
    rng = random.Random(12)
    for n in (1, 3, 40, 700):
        cells, _ = jaccard_join.cell_signatures(np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)), 80)
        assert cells.max() < 1 << 48 and (np.diff(cells.view(np.int64)) >= 0).all()
    codes = spark.createDataFrame([(bytes([k]) * 16,) for k in range(256)], "code binary")
    owners = [r.o for r in codes.select(jaccard_join.owner_of("code").alias("o")).collect()]
    assert len(set(owners)) == 256 and all(o % 65536 == 0 for o in owners)


@pytest.mark.parametrize("rest", [False, True])
def test_the_filter_makes_no_row_but_those_that_stay(spark, rest):
    rows = spark.range(1000).select("id", F.lit("x").alias("_bucket"))
    out = filtered(rows, spark.createDataFrame([(3,), (500,), (None,)], "id long"), "id", rest)
    assert {r.id for r in out.collect()} == ({*range(1000)} - {3, 500} if rest else {3, 500}) and out.columns == rows.columns
    assert "LeftOuter" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("heavy", [0, 65_536])
def test_the_second_pass_takes_counts_under_hubs_and_no_cells(spark, monkeypatch, heavy):
    tables = {}
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name, *options: tables.setdefault(name, []).append(common.materialise(df, name, *options)) or tables[name][-1])
    rows = corpus(11)
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)
    assert tables["visits"][0].count() and "cell" not in {c for name, made in tables.items() if name not in ("digests", "heavy", "shared", "tops") for df in made for c in df.columns}


def test_owners_in_different_parts_of_a_heavy_cell_stand_under_one_hub(spark):
    shared = spark.createDataFrame([(2, 10, 10, 0), (2, 11, 11, 1), (2, 12, 11, 1), (4, 11, 11, None), (7, 11, 11, None), (4, 12, 11, None)], "cell long, owner long, hub long, part int")
    assert {tuple(r) for r in jaccard_join.hub_counts(shared).collect()} == {(10, 10, 1, 0), (11, 10, 1, 0), (12, 10, 1, 0), (11, 11, 1, 1), (12, 11, 1, 0)}


def test_a_set_visits_blocks_with_which_it_shares_what_a_link_needs(spark):
    near = [(1, 1, 5, 0, 4, 0), (2, 1, 5, 0, 4, 0), (3, 1, 3, 0, 4, 0), (4, 1, 5, 0, 4, 0), (5, 9, 8, 8, 4, 4)]
    labels = [(1, 1, 0, 0, False), (2, 2, 1, 1, True), (3, 3, 0, 2, True), (4, 4, 5, 3, True), (5, 5, 0, 4, True)]
    near = spark.createDataFrame(near, "owner long, hub long, c0 long, c1 long, need0 int, need1 int")
    left = jaccard_join.unsettled(near, spark.createDataFrame(labels, "owner long, label long, band int, block int, minor boolean"))
    assert {r.owner for r in left.collect()} == {1, 2, 4}  # 3 shares too few cells, 5 none with another label
    assert {tuple(r) for r in jaccard_join.block_visits(left).collect()} == {(2, 0, 0)}  # 4 is too far in size
