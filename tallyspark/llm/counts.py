"""Operator 13: token counts by batch encoding in Arrow functions that return lengths only.

A task joins and cuts its Arrow batches to blocks of bounded bytes and encodes them in batches of about the same number of
bytes; only counts leave Python. A long text is cut at safe boundaries, where the tokens of the whole are those of the
parts: before white space or a sentence mark after a letter or digit. Texts over LONG bytes leave the task that read them as
rows of such parts, are dealt anew and summed again, so one of them is counted by many tasks; short ones are never shuffled.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import blocks, bounded_batches, materialize_kinds, task

#: Bytes that are encoded in one call, and of a text from which it is counted by more than one task.
BATCH_BYTES, LONG = 256 << 10, 4 << 20
#: A part ends at a place of SAFE behind so many characters.
PART_CHARS = 32 << 10
#: Between a letter or digit and white space, or a mark that neither belongs to a contraction nor to a special token. Letters are
#: of blocks that are the same in every version of Unicode.
SAFE = re.compile(r"(?<=[0-9A-Za-zぁ-ゖァ-ヺ一-龥가-힣])(?=[ \t\n\r.,;:!?、。，！？])|(?<=[!-~])(?=[ \t\n\r])")
COUNTED = "kind int, doc_id bigint, n_bytes bigint, n_tokens bigint, key string, part int, text string"
COUNTED_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("key", pa.string()), ("part", pa.int32()), ("text", pa.string())])

_tokenizers: dict[str, object] = {}


def check_cuts(source: str) -> None:
    """Raise unless a tokenizer's file (JSON) is of the kind whose texts may be cut at SAFE: byte-level pre-tokens by the usual
    pattern, nothing normalised or added, and no added token that a cut could lie in."""
    import json

    spec = json.loads(source)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    cut = [t["content"] for t in spec.get("added_tokens", []) if SAFE.search(t["content"]) or re.match(r"[ \t\n\r.,;:!?]", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if not plain or cut:
        raise ValueError(f"texts for this tokenizer can't be cut at safe boundaries: {cut or pre}")


def tokenizer(source: str, name: str):
    """The tokenizer of a file's JSON; a process keeps one for each name."""
    if name not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(source)
        made.no_truncation()
        made.no_padding()
        _tokenizers[name] = made
    return _tokenizers[name]


def parts_of(text: str, chars: int) -> list[str]:
    """The text in parts of about `chars` characters, cut at safe boundaries only; a stretch without one stays whole."""
    out, start = [], 0
    while len(text) - start > chars:
        found = SAFE.search(text, start + chars)
        if not found or found.start() == len(text):
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def _counts(encoder, texts: list[str], chars: int) -> np.ndarray:
    """Tokens of each text; the encoder is called for batches of about BATCH_BYTES."""
    owner, parts = [], []
    for k, text in enumerate(texts):
        own = parts_of(text, chars) if len(text) > chars else [text]
        owner += [k] * len(own)
        parts += own
    ends = np.cumsum([len(p) for p in parts])
    n, at = np.zeros(len(parts), np.int64), 0
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        n[at:stop] = [len(e) for e in encoder.encode_batch_fast(parts[at:stop], add_special_tokens=False)]
        at = stop
    return np.bincount(np.array(owner, np.int64), weights=n, minlength=len(texts)).astype(np.int64)


def _decoded(column) -> list[str]:
    return [(x or b"").decode(errors="replace") for x in column.cast(pa.binary()).to_pylist()]


@task
def _count_short(batches: Iterator[pa.RecordBatch], source, name: str, long: int, chars: int) -> Iterator[pa.RecordBatch]:
    """A row with the count of each text of at most `long` bytes (kind 0), the parts of each longer one (kind 1)."""
    encoder = tokenizer(source.value, name)
    for t in blocks(batches):
        sizes = np.array([len(x or b"") for x in t.column("text").cast(pa.binary()).to_pylist()], np.int64)
        short = pa.array(sizes <= long)
        own = t.filter(short)
        n = _counts(encoder, _decoded(own.column("text")), chars)
        rows = {"kind": pa.array(np.zeros(len(n)), pa.int32()), "doc_id": own.column("doc_id").combine_chunks(), "n_bytes": pa.array(sizes[sizes <= long]), "n_tokens": pa.array(n)}
        yield pa.RecordBatch.from_arrays([rows[f.name] if f.name in rows else pa.nulls(len(n), f.type) for f in COUNTED_ARROW], schema=COUNTED_ARROW)
        for k in np.flatnonzero(sizes > long).tolist():
            key = uuid.uuid4().hex
            parts = parts_of(_decoded(t.column("text").slice(k, 1))[0], 8 * chars)
            for p, part in enumerate(parts):
                row = {"kind": 1, "doc_id": t.column("doc_id")[k].as_py(), "n_bytes": 0 if p else int(sizes[k]), "key": key, "part": p, "text": part}
                yield pa.RecordBatch.from_pylist([row], COUNTED_ARROW)


@task
def _count_parts(batches: Iterator[pa.RecordBatch], source, name: str, chars: int) -> Iterator[pa.RecordBatch]:
    encoder = tokenizer(source.value, name)
    for t in blocks(batches):
        n = _counts(encoder, _decoded(t.column("text")), chars)
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("key", "doc_id", "n_bytes")), pa.array(n)], names=["key", "doc_id", "n_bytes", "n_tokens"])


def token_counts(documents: DataFrame, source_path: str, long: int = LONG, chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of documents (doc_id, text): its UTF-8 bytes, and the tokens that the tokenizer
    of a JSON file gives, without added special tokens; strings of special tokens inside a text are such tokens.

    A null or empty text has 0 of both. A null doc_id stays null; repeated rows give repeated results; an empty table gives no
    rows; other columns of the input are ignored. Texts of any length are counted whole: those of over `long` bytes by several
    tasks. A pre-token of any length (a text without a safe boundary) is encoded by itself. The file is read by the
    driver and sent to the executors; one whose texts can't be cut so raises an error.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    with open(source_path, encoding="utf-8") as f:
        text = f.read()
    check_cuts(text)
    source = spark.sparkContext.broadcast(text)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = docs.mapInArrow(partial(_count_short, source=source, name=source_path, long=long, chars=chars), COUNTED)
    (short, _), (parts, _) = materialize_kinds(made, "token-counts", 2)
    dealt = parts.select("key", "part", "doc_id", "n_bytes", "text").repartition(F.col("key"), F.col("part"))
    counted = dealt.mapInArrow(partial(_count_parts, source=source, name=source_path, chars=chars), "key string, doc_id bigint, n_bytes bigint, n_tokens bigint")
    whole = counted.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("key")
    return short.select("doc_id", "n_bytes", "n_tokens").unionByName(whole)
