import random

import pytest

from tallyspark.llm import jaccard
from tallyspark.llm.jaccard import jaccard_classes


def brute(rows, n, num, den):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = (t or "").translate(table).encode().split()
        sets.append((i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((find(i), find(j)))
                top[q] = p
    return {(i, len(a), find(i)) for i, a in sets}


def corpus(seed, docs=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(docs):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randrange(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 4, 8, 9, 10, 20, 40, 90, 300]))]
            if r.random() < 0.3:
                w += passage
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,n,num,small,part,wide", [(1, 4, 85, 16, 4096, 8), (2, 5, 80, 2, 8, 8), (3, 2, 60, 1, 2, 0), (4, 3, 70, 3, 4096, 1), (5, 2, 75, 2, 4096, 22)])
def test_equals_brute_force(spark, monkeypatch, seed, n, num, small, part, wide):
    """Small bounds send pairs through the rounds of larger keys and through keys dealt in parts."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    rows = corpus(seed)
    got = {tuple(r) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)


def test_odd_rows(spark):
    rows = [(5, None, 1), (6, "", 1), (7, "A b\x1fc D", 2), (9, "a B\x1fc d", 2), (None, "a b\x1fc d", 3), (7, "A b\x1fc D", 2), (11, "x " * 30000, 4)]
    got = sorted(jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string, component_id int"), 4, 85, 100).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(5, 0, 5), (6, 0, 6), (7, 1, 7), (7, 1, 7), (9, 1, 7), (None, 1, None), (11, 1, 11)], key=str)
    assert jaccard_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("cluster,few", [(2048, 6), (5, 0), (3, 100)])
def test_near_copies_below_the_threshold_make_no_pairs(spark, monkeypatch, cluster, few):
    """Copies of one text with changes of their own: most pairs are within the bound of the sketches and don't qualify. What is
    sent grows with the copies, not with their pairs."""
    monkeypatch.setattr(jaccard, "CLUSTER", cluster, raising=False)
    monkeypatch.setattr(jaccard, "FEW", few, raising=False)
    sent = []

    def materialize(df, name, real=jaccard.materialize):
        made = real(df, name)
        sent.append((name, made.rows["n"]))
        return made

    def kinds(df, name, n, real=jaccard.materialize_kinds):
        made = real(df, name, n)
        sent.extend((name, t.count()) for t, _ in made if name == "jaccard-met")
        return made

    monkeypatch.setattr(jaccard, "materialize", materialize)
    monkeypatch.setattr(jaccard, "materialize_kinds", kinds)
    r = random.Random(7)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(120), r.choice([0, 1, 3, 4])):
            w[k] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = {tuple(x) for x in jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)
    assert all(n <= len(rows) * (1 if name != "jaccard-met" else 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) for name, n in sent if name in ("jaccard-met", "jaccard-pairs", "jaccard-clusters"))
    assert cluster < 2048 or all(n < len(rows) for name, n in sent if name == "jaccard-links")


def test_long_texts_keep_no_row_for_each_key(spark, monkeypatch):
    """More copies of a long text, with changes of their own, than a small key has sets: what is sent grows with the copies,
    not with their keys."""
    sent = []

    def kinds(df, name, n, real=jaccard.materialize_kinds):
        made = real(df, name, n)
        sent.extend(t.count() for t, _ in made if name == "jaccard-met")
        return made

    monkeypatch.setattr(jaccard, "materialize_kinds", kinds)
    r = random.Random(3)
    rows = []
    for base in ([f"w{r.randrange(4000)}" for _ in range(size)] for size in (1800, 4000)):
        for _ in range(20):
            w = list(base)
            for k in r.sample(range(len(w)), r.choice([0, 10, len(w) // 45, len(w) // 30])):
                w[k] = f"x{r.randrange(10_000)}"
            rows.append((len(rows), " ".join(w)))
    got = {tuple(x) for x in jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 5, 80, 100).collect()}
    assert got == brute(rows, 5, 80, 100)
    assert sum(sent) <= len(rows) * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
