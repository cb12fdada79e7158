import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyspark.llm.bpe import bpe_decode, bpe_encode, load_ranks
from tallyspark.llm.queries import op5_byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_odd_texts(spark, whole):
    texts = [None, "", " ", "   a  b\n\n c \t", "it's we'll DON'T 12345 ½ <|endoftext|>", "žluťoučký 🙂🙂 　x y z", "\x1c\x1d a\x85b", "ab" * 40000, "the the the"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "y"), (3, texts[3], "x")]
    enc = bpe_encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3), RANKS, public_tokenizers.PATTERN)
    enc = enc.withColumn("decoded", enc["n_tokens"])
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded), r.n_tokens) for r in bpe_decode(enc, RANKS).collect())
    want = sorted((str(i), ids := whole.encode_ordinary(t or ""), (t or "").encode(), len(ids)) for i, t, _ in rows)
    assert got == want
    assert bpe_encode(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_is_what_the_library_gives(spark, whole):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op5_byte_bpe(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = whole.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
