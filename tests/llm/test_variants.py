import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from tallyspark.llm import variants
from tallyspark.llm.queries import op11_spelling_variants
from tallyspark.llm.variants import near_pairs, spelling_variants, word_counts


def counted(rows, least=7, every=31, often=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=10):
    of = {w: set() for w in words}
    for a, b in combinations(sorted(words), 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            of[a].add(b)
            of[b].add(a)
    form = {w: min(of[w], key=lambda x: (-words[x], x.encode())) if of[w] else None for w in words}
    form = {w: f if f and words[f] >= times * words[w] else None for w, f in form.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(of[w]), words.get(form[w])))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(counted(rows))
    got = rows_of(op11_spelling_variants(spark, d))
    assert got == want
    assert any(r[4] for r in want) and any(r[1] for r in want)


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefgh×"])
def test_no_pair_is_lost(spark, letters):
    """Few letters: many anagrams, hot signatures and near words; chains of forms of several steps."""
    import random

    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.choice([7, 8, 9]))): 2 * 10 ** r.randrange(5) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)
    assert rows_of(spelling_variants(df)) == brute(words)
    assert near_pairs(df).count() == sum(x[4] for x in brute(words)) // 2


def test_roots_follow_forms_to_the_last(spark):
    words = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20_000, "aaabbbbb": 200_000, "zzzzzzzz": 2_000_000}
    got = {r[0]: r[2] for r in rows_of(spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint")))}
    assert set(got.values()) == {"aaabbbbb", "zzzzzzzz"} and got["aaaaaaaa"] == "aaabbbbb"


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    texts = [None, "", " ", "short Words only", "Variant VARIANT variantE Éclairé éclairé ÷×÷×÷×÷ ÷×÷×÷×÷", "variant" * 30_000, "letters1letters_letters", "the variant of the variants"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "nothing variant letters", 2), (4, texts[4], 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word int").repartition(4)
    got = {(r.word, r.n) for r in word_counts(df).collect()}
    assert got == set(counted([(i, t) for i, t, _ in rows]).items())
    assert any(h for h in (zlib.crc32(f"{i}:variant".encode()) % 31 for i in range(8)))
    for empty in (spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, None)], "doc_id bigint, text string")):
        assert spelling_variants(word_counts(empty)).count() == 0


def test_a_null_word_is_left_out(spark):
    df = spark.createDataFrame([(None, 5), ("letters", 3), ("lettess", 40)], "word string, n bigint")
    assert rows_of(spelling_variants(df)) == {("letters", "lettess", "lettess", 3, 1, 40), ("lettess", None, "lettess", 40, 1, None)}
