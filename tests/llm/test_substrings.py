import random

import pytest

from tallyspark.llm.substrings import remove_repeats


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen:
                gone |= set(range(s, s + length))
            seen.add(key)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["x y", "é"]
    passages = [[r.choice(vocab) for _ in range(k)] for k in (19, 20, 21, 60)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(passages) if r.random() < 0.4 else [r.choice(vocab) for _ in range(r.randrange(60))]
        if r.random() < 0.1:
            w += ["a"] * 45
        rows.append((i * 7 % 1009, r.choice([" ", "\n", " \t"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = remove_repeats(df, 20, joined=True).collect()
    assert {r.doc_id: (r.n_words, sum(s.stop - s.start for s in r.spans), r.kept) for r in got} == brute(rows, 20)


def test_odd_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, None, "x"), (2, "", "x"), (3, a, "x"), (3, a, "x"), (4, f"{b}\n{a} end", "x"), (4, b, "y"), (None, a, "x"), (9, "z " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r.kept[-5:] if r.kept else r.kept) for r in remove_repeats(df, 20).collect()), key=str)
    # The two texts of 4 share b: the one with the larger hash gives it up.
    assert [x for x in got if x[0] != 4] == sorted([(1, 0, 0, None), (2, 0, 0, ""), (3, 30, 0, a[-5:]), (3, 30, 0, a[-5:]), (None, 30, 0, a[-5:]), (9, 50000, 49999, "z ")], key=str)
    four = sorted(x[2] for x in got if x[0] == 4)
    assert four in ([0, 60], [30, 30])
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"), 20).count() == 0


def test_text_keeps_its_white_space(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a\n\n{p}\nb"), (2, f"c\n\n{p}\n d\te")]
    got = {r.doc_id: r.kept for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 20).collect()}
    assert got == {1: rows[0][1], 2: "c\n\nd\te"}


def test_places_are_sent_in_rows_that_dont_grow_with_the_square_of_the_partitions(spark):
    """A bin's places go to buckets by the bytes of the text and the cores, whatever the number of shuffle partitions."""
    from tallyspark.llm.substrings import later_places

    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = corpus(3)
    rows += [(2000 + i, rows[i][1]) for i in range(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        sent = later_places(docs, 20, False).count()
        got = remove_repeats(docs, 20, joined=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: (r.n_words, sum(s.stop - s.start for s in r.spans), r.kept) for r in got} == brute(rows, 20)
    assert 0 < sent <= 4 * 60 * 2 * spark.sparkContext.defaultParallelism  # with a bucket for each bin: several times as many
