import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortrank.llm import line_templates, quality_model, quality_rules


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), dup, len(covered)


def test_base_counts(docs, no_docs):
    out = quality_rules.judge(docs)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter()
    for r in docs.collect():
        b = brute_base(r.text)
        want[(r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want
    assert quality_rules.judge(no_docs).count() == 0


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(4)
    banner = "This Banner line 12 stands on very many pages of the host here"
    rows = [(i, f"{banner}\n{words(rng, 40)}", "hot") for i in range(30)] + [(100 + i, f"{banner}\n{words(rng, 2)}", "hot") for i in range(5)]
    rows += [(200 + i, f"{banner}\n{words(rng, 40)}", "cold") for i in range(3)] + [(300 + i, "one text that is copied very often in this corpus by its host", "hot") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules.judge(df, min_docs=10, share=0.1).collect()}
    assert all(out[i].removed_words == 13 and out[i].kept for i in range(30))
    assert not any(out[100 + i].kept for i in range(5))
    assert all(out[200 + i].removed_words == 0 and out[200 + i].kept for i in range(3))
    assert all(out[300 + i].kept for i in range(50))  # copies count once


def test_rules_keep_columns_and_strip_lines(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_rules.judge, "__defaults__", ("doc_id", "text", "source", 2, 0.0))
    rows = [(i, f"shared line of the whole host right here now\nown words {i} " + words(random.Random(i), 30), "h", 5) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = quality_rules.apply_rules(df, length_col="n_chars").collect()
    assert len(out) == 5 and all("shared line" not in r.text and r.n_chars == len(r.text) for r in out)
    kept = quality_rules.apply_rules(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {1, 2, 6, None, 9}  # 8 repeats a line


def brute_lines(rows):
    """Plain version of the template tree: first document of each template, then the lines that go."""
    first, recurs = {}, defaultdict(set)
    for i, text in rows:
        for line in (text or "").encode().split(b"\n"):
            for c in line_templates.templates(line):
                recurs[c].add(i)
                first[c] = min(first.get(c, i), i)
    gone = lambda i, x: any(len(recurs[c]) > 1 and first[c] < i for c in line_templates.templates(x.encode()))
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if i is None or not gone(i, x))) for i, t in rows)


def test_line_dedup_equals_the_plain_version(spark, docs, no_docs):
    rng = random.Random(6)
    shared = [words(rng, rng.randint(3, 20)) for _ in range(8)]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.4 else words(rng, rng.randint(1, 15)) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(70, "User 17 logged in from 10.0.0.1 at noon"), (71, "User 99 logged in from 10.9.9.9 at noon"), (72, None), (73, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_templates.drop_recurring_lines(df)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_lines(rows)
    odd = line_templates.drop_recurring_lines(docs)
    assert odd.schema == docs.schema and odd.count() == docs.count()
    by_id = defaultdict(list)
    for r in odd.collect():
        by_id[r.doc_id].append(r.text)
    assert by_id[9] == ["Another line that only this document has"] and by_id[2] == [""] and by_id[1] != [""] and by_id[3] == [None]
    assert line_templates.drop_recurring_lines(no_docs).count() == 0


def test_templates_open_variable_fields():
    t = line_templates.templates
    assert t(b"Item 12 of 40 was sold") == t(b"Item 99 of 7 was sold")
    a, b = b"a b c d e f g h i j k l m n", b"a b c d e f g h i j k l x y"
    assert a != b and set(t(a)) & set(t(b))  # one quarter differs
    assert not set(t(a)) & set(t(b"a b c x e f g h i j y l m n z"))
    assert t(b"only four words here") == []


def labelled(n, rng):
    good = [(i, words(rng, rng.randint(20, 80)).capitalize() + ".") for i in range(n)]
    bad = [(n + i, " ".join(f"{w.upper()}!!" for w in words(rng, rng.randint(20, 60)).split())) for i in range(n // 3)]
    return good, bad


def test_the_classifier_tells_held_out_rows_apart(spark, docs):
    good, bad = labelled(300, random.Random(8))
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality_model.learn(df, labels)
    out = quality_model.score_documents(df, model).where("held_out").collect()
    assert len(out) > 80 and np.mean([(r.predicted == 1) == (r.doc_id < 300) for r in out]) > 0.97
    assert np.allclose(model.weights, quality_model.learn(df.repartition(5), labels).weights)
    odd = quality_model.score_documents(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    kept = quality_model.keep_good(docs, model)
    assert kept.schema == docs.schema


def test_without_both_labels_every_score_is_a_half(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    model = quality_model.learn(docs, labels)
    assert {r.score for r in quality_model.score_documents(docs, model).collect()} == {0.5}
    assert quality_model.score_documents(no_docs, quality_model.learn(no_docs, labels)).count() == 0


@pytest.mark.parametrize("text", [None, "", " ", "\n", "a", "日本", "!" * 500, "퟿"])
def test_features_of_odd_texts(text):
    x = quality_model.features(text)
    assert len(x) == quality_model.N_FEATURES and np.isfinite(x).all()


def test_lines_with_two_small_edits_recur(spark):
    line = [f"{a}{b}" for a in "abcdefg" for b in "hijklmn"]
    edit = lambda *at: " ".join("edited" if i in at else w for i, w in enumerate(line))
    rows = [(1, edit()), (2, edit(5, 40)), (3, edit(0)), (4, edit(1, 25)), (5, edit(5, 20, 40)), (6, edit() + " more")]
    out = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, t in sorted(out.items()) if t] == [1, 6]  # 5 is near 2, which went; 6 has another number of tokens
    assert Counter(out.items()) == brute_lines(rows)


def test_short_lines_recur_in_the_query_and_the_pipeline(spark, tmp_path):
    from cohortrank.llm.queries import queries
    from corpus_pipeline import line_stage

    rows = [(1, "All rights reserved.\n\nNo 7", 0), (2, "All rights reserved.\n\nNo 9\nown line", 0), (3, "rights All reserved.\nAll rights", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_lines, r.n_dropped) for r in queries()["op2_line_templates"](spark, str(tmp_path)).collect()}
    assert out == {1: (3, 0), 2: (4, 2), 3: (2, 0)}
    left = line_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text for r in left.collect()}[2] == "\nown line"


def test_either_limit_alone_removes_a_line(spark):
    rng = random.Random(5)
    rows = [(i, f"a line that a small host has on every page\n{words(rng, 30)}", "small") for i in range(12)]
    rows += [(100 + i, (f"a line of one page in ten here\n{words(rng, 30)}" if i < 101 else words(rng, 30)), "large") for i in range(1010)]
    rows += [(2000 + i, f"a line on every page of a tiny host\n{words(rng, 30)}", "tiny") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.removed_words for r in quality_rules.judge(df, share=1.0).collect()}
    assert {i for i, n in out.items() if n} == {i for i in range(100, 201)}  # above the count, below the share
    out = {r.doc_id: r.removed_words for r in quality_rules.judge(df, min_docs=1000).collect()}
    assert {i for i, n in out.items() if n} == {*range(12), *range(100, 201)}  # the other way round


def brute_verdicts(rows, copies):
    """removed_words and kept by the rules' words alone: frequent lines of a host go, depleted documents are rejected. Lines
    count by distinct (id, text) or, with copies once, by distinct text."""
    norm = lambda w: re.sub("[0-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(w)))
    split = lambda t: [w for line in (t or "").split("\n") if (w := re.findall(r"[^\x20\x09-\x0D]+", line))]
    texts = defaultdict(set)
    for i, t, h in rows:
        texts[h or ""].add((i if copies == "each" else 0, t or ""))
    frequent = defaultdict(set)
    for h, own in texts.items():
        n = Counter(x for _, t in own for x in set(map(norm, split(t))))
        frequent[h] = {x for x, c in n.items() if c > 100 or (c > 10 and c > 0.01 * len(own))}
    out = Counter()
    for i, t, h in rows:
        b = brute_base(t)
        gone = sum(len(w) for w in split(t) if norm(w) in frequent[h or ""])
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        depleted = gone > 0 and (b[0] - gone < 10 or 100 * (b[0] - gone) < 20 * b[0])
        out[(i, gone, failed, not failed and not depleted)] += 1
    return out


def test_verdicts_equal_the_plain_version_at_the_querys_limits(spark, tmp_path):
    from cohortrank.llm.queries import queries

    rng = random.Random(14)
    common = [f"{words(rng, rng.randint(3, 9))} {k}" for k in range(6)]
    rows = []
    for i in range(600):
        lines = [words(rng, rng.randint(4, 30)) for _ in range(rng.randint(0, 3))] + [x for x in common if rng.random() < 0.05] + ([words(rng, 2)] if rng.random() < 0.1 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["hot", "hot", "b", None])))
    rows += [(600 + i, rows[i][1], rows[i][2]) for i in range(40)] + [(700, None, "b"), (None, common[0], "hot"), (701, "", None)]
    copied = words(rng, 30)
    rows += [(1000 + i, copied, "b") for i in range(30)] + [(1000, copied, "b")] * 3 + [(None, words(rng, 12), "b")] * 15
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {x: brute_verdicts(rows, x) for x in ("each", "once")}
    for x, out in (("each", queries()["op5_line_frequency"](spark, str(tmp_path))), ("once", quality_rules.judge(df))):
        got = Counter((r.doc_id, r.removed_words, r.base_failed, r.kept) for r in out.collect())
        assert got == want[x] and sum(n for (_, gone, *_), n in got.items() if gone) > 20 and any(gone and not failed and not kept for _, gone, failed, kept in got)
    assert {x: sum(n for (i, _, _, kept), n in want[x].items() if (i or 0) >= 1000 and kept) for x in want} == {"each": 0, "once": 33}  # 30 copies go, repeats of one row count once
    with pytest.raises(ValueError):
        quality_rules.judge(df, copies="twice")


def test_preferences_fit_as_plain_gradient_descent_does():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    good = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=300) > -1
    model = quality_model.fit_pairs(x, good)
    z = (x - x.mean(0)) / x.std(0)
    pick = np.random.default_rng(7)
    d = z[pick.choice(np.flatnonzero(good), 6000)] - z[pick.choice(np.flatnonzero(~good), 6000)]
    w = np.zeros(4)
    for _ in range(20_000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w)
    assert np.allclose(model.weights, w, atol=1e-4)
    assert np.isclose(model.threshold, np.quantile(z @ w, 1 - good.mean()), atol=1e-3)


def test_clashing_columns_come_through(spark):
    rng = random.Random(3)
    names = ["_gone", "_lines", "_dropped", "_host", "_a", "_b", "_removed", "_verdict", "_bucket", "_bits", "_key", "_id"]
    rows = [(i, f"a line that they all have in common here\n{words(rng, 20)}", "s", *range(len(names))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for out in (line_templates.drop_recurring_lines(df), quality_rules.apply_rules(df)):
        assert out.schema == df.schema
        assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}


def lines_match(a, b):
    """Whether two lines share a template, by the rule's words: equally many tokens, those with digits alike, and at most
    one of eight stretches (two from twelve tokens on) that differs, the first two tokens belonging to the first."""
    a, b = (["#" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", x)] for x in (a, b))
    if len(a) != len(b) or not a:
        return False
    n = len(a)
    stretch = [0 if k < 2 else next(s for s in range(8) if k < 2 + (n - 2) * (s + 1) // 8) for k in range(n)]
    return len({s for s, x, y in zip(stretch, a, b, strict=True) if x != y}) <= (0 if n < 6 else 1 if n < 12 else 2)


def test_line_dedup_equals_pairwise_comparison(spark):
    rng = random.Random(21)
    pool = [words(rng, n).split() for n in (1, 2, 4, 5, 6, 7, 9, 11, 12, 13, 20, 40) for _ in range(2)]

    def line():
        own = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(["x1", "y22", "other", "word"])
        return " ".join(own)

    rows = [(i, "\n".join(line() if rng.random() < 0.7 else words(rng, rng.randint(1, 14)) for _ in range(rng.randint(1, 5)))) for i in range(50)] + [(60, None), (61, "\n \n")]
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), short=True)
    earlier, want = [], {}
    for i, t in rows:
        want[i] = None if t is None else "\n".join(x for x in t.split("\n") if not any(lines_match(x, y) for y in earlier))
        earlier += (t or "").split("\n")
    assert {r.doc_id: r.text for r in out.collect()} == want
    a, b = b"User alice logged in from home", b"User bob logged in from home"
    assert set(line_templates.templates(a)) & set(line_templates.templates(b)) and lines_match(a.decode(), b.decode())
