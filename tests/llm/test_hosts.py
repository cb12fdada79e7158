import re

from pyspark.sql import functions as F

from tallyspark.llm.hosts import host_rates, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_measures_and_odd_rows(spark):
    texts = [None, "", "a", "é \x1c ü\x85x # <b> $\n\n#\n#", "a b c d e a b c d e f", "x " * 40, " ".join(f"w{i}" for i in range(30)), "one\none\n one\none", "y " * 60000]
    rows = [(i, t, "h", 1) for i, t in enumerate(texts)] + [(None, "a b", None, 2), (3, texts[3], "h", 2)]
    got = judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string, failed int"), F.col("source")).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(i, *(brute(t) if i != 8 else (60000, 60000, 0, 0, 60000))) for i, t, _, _ in rows]
    assert sorted(((r.doc_id, *(r[c] for c in cols)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.base_failed == (r.n_words < 10 or 5 * r.n_repeat_words > r.n_words) for r in got)
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert judge(empty, F.col("source")).count() == 0


def test_a_bad_host_goes_and_a_small_one_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(k * 1000 + i, "no" if i < (38 if k == 0 else 2) else good, f"h{k}") for k in range(12) for i in range(40)] + [(99001, "no", "small"), (99002, good, "small"), (99003, good, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in judge(df, F.col("source")).where("kept").collect()}
    assert kept == {i for i, t, h in rows if t == good and h != "h0"}
    rates = {r.host: r.rate for r in host_rates(df.select(F.col("source").alias("host"), (F.col("text") == "no").alias("failed"))).collect()}
    assert 0.05 < rates["h1"] < 0.12 < rates["small"] < 0.5 < rates["h0"] < 0.95
