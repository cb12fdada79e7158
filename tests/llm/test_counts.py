import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import counts
from tallyspark.llm.counts import check_cuts, parts_of, token_counts
from tallyspark.llm.queries import op13_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_query_is_what_the_library_gives(spark, whole):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_token_counts(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        n = whole(r.text)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 1024)


ODD = [
    None, "", " ", "  \n\n a", "it's we'll DON'T 12345 ½ <|endoftext|>x<|endoftext|>", "a <|endoftext|>" * 700, "<|endoftext|>" * 300, "žluťoučký 🙂🙂 　x y z",
    "\x1c\x1d a\x85b", "ab" * 4000, "漢字，かな。カナ！한글? " * 300, "x  \n\n  y\t\t z" * 300, "1. 2, 3; 4: 5! 6? 'll 's" * 200, "'s't " * 500, "\n" * 3000, " " * 3000, "…… ——" * 400, "𝔸𝔹 𝟙𝟚" * 300, "᠎ a᠎ b" * 200,
]


@pytest.mark.parametrize("long", [100, 1500, 1 << 20])
def test_odd_and_long_texts(spark, monkeypatch, whole, long):
    monkeypatch.setattr(counts, "BATCH_BYTES", 500)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, ODD[5], "y"), (5, ODD[5], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(df, PATH, long=long, chars=40).collect())
    assert got == sorted((str(i), len((t or "").encode()), whole(t)) for i, t, _ in rows)


def test_parts_are_the_text_and_their_tokens_its_tokens(whole):
    r = Tokenizer.from_file(PATH)
    for text in filter(None, ODD):
        for chars in (1, 7, 50):
            parts = parts_of(text, chars)
            assert "".join(parts) == text
            assert [i for p in parts for i in r.encode(p, add_special_tokens=False).ids] == r.encode(text, add_special_tokens=False).ids
    assert len(parts_of("word " * 1000, 50)) > 80


def test_no_rows_and_other_tokenizers(spark):
    assert token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
    with pytest.raises(ValueError, match="safe boundaries"):
        token_counts(spark.createDataFrame([], "doc_id bigint, text string"), public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["added_tokens"].append(spec["added_tokens"][0] | {"content": "<a b>"})
    with pytest.raises(ValueError, match="<a b>"):
        check_cuts(json.dumps(spec))
