import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import packing
from tallyspark.llm.packing import best_fit_decreasing, best_fit_pack, lower_bound, token_pieces
from tallyspark.llm.queries import op1_best_fit_packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """Bins by exhaustive search."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_holds(lengths):
    lengths = sorted(lengths, reverse=True)
    bound, used = lower_bound(np.bincount(lengths, minlength=21), 20), len(best_fit_decreasing(lengths, 20)[2])
    assert bound <= fewest(lengths, 20) <= used


def check(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for x in at.values():
        end = 0
        for offset, n in sorted(x):
            assert offset == end
            end += n
        assert end <= capacity
    return len(at)


@pytest.mark.parametrize("kind", ["small", "large"])
def test_packs_as_few_as_the_bound_or_nearly(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "ROWS_A_PARTITION", 300)
    r = random.Random(3)
    lengths = [min(100, 1 + int(r.expovariate(1 / 20))) if kind == "small" else r.choice([26, 35, 51, 52, 70, 100]) for _ in range(3000)]
    rows = best_fit_pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id int, length int"), 100).collect()
    assert len(rows) == 3000
    used, bound = check(rows, 100), lower_bound(np.bincount(lengths, minlength=101), 100)
    assert bound <= used <= bound * 1.01 + 1


def test_query_keeps_every_id(spark):
    d = "/root/testdata/sf0.001"
    rows = op1_best_fit_packing(spark, d).collect()
    t = Tokenizer.from_file(WORDS)
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bound = lower_bound(np.bincount([r.length for r in rows], minlength=2049), 2048)
    assert bound <= check(rows, 2048) <= bound + 1


def test_odd_rows(spark):
    texts = [None, "", " \n", "<|endoftext|> It's É é x　y İstanbul ΣΑΣ 123", "word " * 5000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 2), (3, texts[3], 1)]
    got = token_pieces(spark.createDataFrame(rows, "doc_id bigint, text string, row int"), WORDS)
    t = Tokenizer.from_file(WORDS)
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(str(i), k, ids[k : k + 2048]) for k in range(0, len(ids), 2048)]
    out = got.collect()
    assert sorted((str(r.doc_id), r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in out) == sorted(want)
    assert best_fit_pack(spark.createDataFrame([], "id int, length int")).count() == 0


def test_columns_of_made_names(spark):
    df = spark.createDataFrame([(1, 60, "a", 5, 6, True, 9), (2, 50, "b", 5, 6, False, 9), (2, 50, "b", 5, 6, False, 9)], "id int, length int, row string, part int, offset int, open boolean, piece int")
    rows = best_fit_pack(df, 100).collect()
    assert sorted((r.id, r.length, r.row, r.part, r.open, r.piece) for r in rows) == [(1, 60, "a", 5, True, 9), (2, 50, "b", 5, False, 9), (2, 50, "b", 5, False, 9)]
    assert check(rows, 100) == 2


def test_only_tokenizers_of_words(spark):
    import json

    import public_tokenizers

    from tallyspark.llm.packing import check_words, token_pieces

    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="word by word"):
        token_pieces(df, public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    check_words(json.dumps(spec))
    cased = spec | {"normalizer": {"type": "NFC"}}
    with pytest.raises(ValueError, match="word by word"):
        check_words(json.dumps(cased))
    spec["added_tokens"].append(spec["added_tokens"][0] | {"content": "STOP"})
    with pytest.raises(ValueError, match="STOP"):
        check_words(json.dumps(spec))


def test_exchanges_end_at_the_last_turn(spark, monkeypatch):
    from tallyspark.llm import packing

    monkeypatch.setattr(packing, "ROWS_A_PARTITION", 40)
    monkeypatch.setattr(packing, "TRIES", 0)
    df = spark.range(900).selectExpr("id AS doc_id", "600 + id * 37 % 400 AS length")
    found = {}
    for turns in (1, 2, 32):
        monkeypatch.setattr(packing, "TURNS", turns)
        rows = packing.best_fit_pack(df).collect()
        assert len(rows) == 900
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(sum(n for _, n in b) <= 2048 and sorted(o for o, _ in b)[0] == 0 for b in bins.values())
        found[turns] = len(bins)
    assert found[1] >= found[2] >= found[32]


def test_a_turn_that_needs_more_sequences_is_not_taken(spark, monkeypatch):
    """In one partition the second turn packs these pieces into one sequence more than the first."""
    from tallyspark.llm import packing

    monkeypatch.setattr(packing, "ROWS_A_PARTITION", 40)
    monkeypatch.setattr(packing, "TRIES", 0)
    df = spark.range(0, 900, 1, 1).selectExpr("id AS doc_id", "600 + id * 37 % 400 AS length")
    found = []
    for turns in (1, 2):
        monkeypatch.setattr(packing, "TURNS", turns)
        rows = packing.best_fit_pack(df).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(rows) == 900
        assert all(sum(n for n in (x[1] for x in sorted(b))) <= 2048 and all(o == sum(x[1] for x in sorted(b)[:k]) for k, (o, _) in enumerate(sorted(b))) for b in bins.values())
        found.append(len(bins))
    assert found[0] >= found[1]
