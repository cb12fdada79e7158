import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import test_hosts
import test_jaccard
import test_lines
import test_packing

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_repeats(rows, length):
    """Texts without the intervals of repeated windows and the white space after each."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        m = list(WORD.finditer(t))
        gone = set()
        for s in range(len(m) - length + 1):
            key = tuple(x[0] for x in m[s : s + length])
            if key in seen:
                gone |= set(range(s, s + length))
            seen.add(key)
        spaces = t[: m[0].start()] if m and 0 not in gone else t[: m[0].start()] if m else t
        out[i] = spaces + "".join(t[x.start() : m[k + 1].start() if k + 1 < len(m) else len(t)] for k, x in enumerate(m) if k not in gone)
    return out


def brute(rows):
    texts = {}
    for i, t in rows.items():
        n, _, _, _, repeats = test_hosts.brute(t)
        if n >= 10 and 5 * repeats <= n:
            texts[i] = t
    texts = {i: x[0] for i, x in test_lines.brute(sorted(texts.items())).items() if WORD.search(x[0])}
    near = test_jaccard.brute(sorted(texts.items()), 5, 80, 100)
    texts = {i: texts[i] for i, _, c in near if i == c}
    texts = {i: t for i, t in cut_repeats(texts, 50).items() if WORD.search(t)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = set()
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        out |= {(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    return out


def test_equals_brute_force(spark, tmp_path):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    rows = {}
    for i in range(0, 240, 2):
        lines = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 9))]
        if rows and r.random() < 0.3:
            lines = r.choice(list(rows.values())).split("\n")
            k = r.randrange(len(lines))
            lines[k] += " changed"
        if r.random() < 0.2:
            lines.insert(r.randrange(len(lines) + 1), f"{r.choice(vocab)} {passage} {r.choice(vocab)}")
        if r.random() < 0.05:
            lines = ["again and again and over"] * 9
        rows[i] = "\n".join(lines)
    rows[900], rows[901] = "", "two words"
    df = spark.createDataFrame([(i, t, "en", f"s{i % 7}", len(t)) for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == brute(rows)
    test_packing.check(got, 2048)


def test_odd_rows_pass_every_stage(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, None, None, None, "x"), (1, text, None, None, None, "x"), (None, text + " and more", "en", "s", 1, "y"), (None, None, None, None, None, None), (5, "", "en", "s", 0, "z"), (6, " ".join(f"v{i}" for i in range(50000)), "en", "s", 0, "z")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, ""), "test")
            assert docs.columns == corpus_pipeline.COLUMNS
            if data:
                assert sorted((r.doc_id for r in docs.collect()), key=str) == {"quality_rules": [1, 1, 6, None], "line_dedup": [1, 1, 6, None]}.get(name, [1, 6, None])
        assert corpus_pipeline.packing(spark, docs, "").count() == (0 if not data else corpus_pipeline.packing(spark, docs, "").select("doc_id", "piece").distinct().count())
