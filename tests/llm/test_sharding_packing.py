import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cohortrank.llm import packing, sharding

PATH = P.path("word_bpe_49k.json")


def test_shards_are_contiguous_and_near_equal(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(3000 + i, "the same text") for i in range(1500)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) <= 2 * 408
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert order == sorted(out, key=lambda r: (r.text_crc32, r["size"], r.doc_id))
    copies = {r.shard for r in out if r.doc_id >= 3000}
    assert max(copies) - min(copies) + 1 == len(copies)


def test_shards_of_odd_rows(docs, no_docs):
    out = sharding.shard_by_bytes(docs, 4)
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in out.collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sharding.shard_by_bytes(no_docs, 4).count() == 0


def placed(counts, capacity):
    """Each bin's pieces (offset, length) by the plan."""
    steps = packing.plan(counts, capacity)
    lengths = [n for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    bins = defaultdict(list)
    for rank, n in enumerate(lengths):
        first, start, each, offset, length = steps[np.searchsorted(steps[:, 0], rank, "right") - 1]
        assert length == n
        k = rank - first
        bins[start + k // each].append((offset + k % each * n, n))
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plans_fill_bins_without_gaps_or_overlaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 300])
    counts = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 4))]) for _ in range(500))
    bins = placed(counts, capacity)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in pieces) <= 2
    assert sum(len(x) for x in bins.values()) == sum(counts.values())


def test_large_pieces_pair_as_often_as_possible():
    assert len(placed(Counter({60: 2, 40: 2, 55: 1, 45: 1, 35: 2}), 100)) == 4
    assert len(placed(Counter({50: 7}), 100)) == 4
    assert packing.plan({}, 100).shape == (0, 5)


def test_small_pieces_take_the_fullest_bin_with_room():
    bins = placed(Counter({90: 1, 80: 1, 20: 1, 10: 1}), 100)
    assert sorted(sorted(n for _, n in x) for x in bins.values()) == [[10, 90], [20, 80]]


def test_documents(docs, no_docs):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    out = packing.pack_documents(docs, PATH, 4096, 1).collect()
    got, bins = Counter(), defaultdict(list)
    for r in out:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for r in docs.collect():
        x = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(x), 4096)):
            part = x[a : a + 4096]
            want[(r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert got == want
    for pieces in bins.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) == -(-sum(x[3] * n for x, n in want.items()) // 4096)
    assert packing.pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("text", ["Hello,  World's 42nd <|endoftext|> test!", "ΑΣ Σίσυφος İstanbul", "a\x1c!\x1f!b", "é café", "日本語テキスト", "x" * 500, "''s !'s"])
def test_words_encode_as_the_tokenizer_does(text):
    own = packing.word_encoder(PATH)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.own.encode(text, add_special_tokens=False).ids


def test_shards_equal_the_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abé", k=rng.randint(0, 300)))) for i in range(400)] + [(400 + i, "copy") for i in range(200)] + [(700, None), (701, "")]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24).collect()
    sized = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, i) for i, t in rows)
    total, before, want, slots = sum(n for _, n, _ in sized), 0, set(), Counter()
    for code, n, i in sized:
        shard = before * 24 // total
        want.add((i, n, code, shard, slots[shard]))
        slots[shard] += 1
        before += n
    assert {(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out} == want


def test_words_of_any_kind_encode_as_the_tokenizer_does():
    rng = random.Random(4)
    own = packing.word_encoder(PATH)
    pools = ["abcdeXYZ éÈßÄñ.,!?;:'\"-0123456789\n\t  \x1c\x85\xa0İΣσς日本語ﬁẞ🙂́<|>_ŉǅª²½ĸʼn", [chr(c) for c in range(0x20, 0x250)], [chr(c) for c in range(0x3000)]]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 50))) for pool in pools for _ in range(400)] + ["q" * 5000, "abc," * 9]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [own.own.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_worker_keeps_an_encoder_after_its_task(spark):
    rows = spark.createDataFrame([(i, f"some words {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    assert packing.token_pieces(rows, PATH, 64, 1).count() == 400

    def kept(batches):
        for b in batches:
            yield b.assign(n=packing.word_encoder.cache_info().currsize)[["n"]]

    assert {r.n for r in rows.mapInPandas(kept, "n long").collect()} == {0}
