"""Operator 6: removal of repeated passages, by Rabin-Karp hashes of every window of L words.

A window's two rolling hashes are differences of prefix sums of word hashes (polynomials modulo 2^64 with odd
bases). Each block of documents keeps the first occurrence of each of its windows (so a passage that a third
of all rows share is sent once per block, not once per row) and sends it to one of many hash bins, packed:
8 bytes of the first hash and 1 of the second, by which the bin is chosen too, with document and start as
small differences. A bin finds the first start of every window over all blocks and sends the other starts,
packed again, to buckets of documents, where overlapping windows merge into maximal intervals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import WordHashes, bins_for, blocks, bounded_batches, bytes_of, from_planes, list_array, materialize, mix, planes, task, text_bytes

#: Bytes of text in a block; its windows take many times as much.
BLOCK = 1 << 20
#: Bytes of text in a bucket of documents; the places of its windows take 16 times as much at most.
BUCKET_BYTES = 16 << 20
#: Bits of a window's start; above them, where rows share a doc_id, stands a 32-bit hash of the text.
START_BITS = 31
#: Intervals of so many bytes at most are broadcast to the documents; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PACKED = "bin int, h binary, tag binary, doc binary, n binary, start binary, dup_doc binary, dup_n binary, dup_start binary"


class Rolling:
    """Hashes of all windows of a sequence of 64-bit values; powers of the base are kept."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        if self.size < len(values) + 1:
            self.size = 2 * len(values) + 1
            for name, b in (("powers", self.base), ("back", self.inverse)):
                x = np.full(self.size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=sums[1:])
        count = len(values) - length + 1
        return (sums[length:] - sums[:count]) * self.back[:count]


def _packed_places(doc: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places sorted by document and start, as documents, places in each, and differences of starts."""
    first = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)) if len(doc) else np.zeros(0, np.int64)
    delta = np.diff(start, prepend=start[:1] * 0)
    delta[first] = start[first]
    return planes(np.diff(doc[first], prepend=doc[:1] * 0)), planes(np.diff(first, append=len(doc)).astype(np.int32)), planes(delta)


def _places(doc: bytes, n: bytes, start: bytes) -> tuple[np.ndarray, np.ndarray]:
    docs, counts, delta = np.cumsum(from_planes(doc, np.int64)), from_planes(n, np.int32), from_planes(start, np.int64)
    total = np.cumsum(delta)
    first = np.cumsum(counts) - counts
    before = total[first] - delta[first]
    return np.repeat(docs, counts), total - np.repeat(before, counts)


@task
def _pack(batches: Iterator[pa.RecordBatch], length: int, bins: int, apart: bool) -> Iterator[pa.RecordBatch]:
    hashes, one, two = WordHashes(), Rolling(BASES[0]), Rolling(BASES[1])
    for t in blocks(batches, limit=BLOCK):
        t = t.sort_by("doc_id")
        texts, ids = text_bytes(t.column("text")), np.asarray(t.column("doc_id"), dtype=np.int64)
        words = [x.split() for x in texts]
        counts = np.array([len(w) for w in words], np.int64)
        values = np.concatenate([hashes.of(w) for w in words])
        del words
        if len(values) < length:
            continue
        offset = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(ids)), counts)
        shift = np.array([xxhash.xxh32_intdigest(x) for x in texts], np.int64) << START_BITS if apart else np.zeros(len(ids), np.int64)
        inside = np.flatnonzero(row[: len(values) - length + 1] == row[length - 1 :])
        if not len(inside):
            continue
        h1 = one.windows(values, length)[inside]
        h2 = mix(two.windows(mix(values ^ np.uint64(0xA5A5A5A5DEADBEEF)), length)[inside])
        row = row[inside]
        doc, start = ids[row], inside - offset[row] + shift[row]
        if apart:  # rows of one doc_id go by their texts' hashes
            o = np.lexsort((start, doc))
            h1, h2, doc, start, row = h1[o], h2[o], doc[o], start[o], row[o]
        o = np.argsort(h1, kind="stable")
        same = (h1[o][1:] == h1[o][:-1]) & (h2[o][1:] == h2[o][:-1])
        same = np.concatenate([[False], same])
        first = o[np.maximum.accumulate(np.where(same, 0, np.arange(len(o))))]
        repeated_row = same & (doc[o] == doc[first]) & (start[o] == start[first])
        again = np.zeros(len(o), bool)
        again[o[same & ~repeated_row]] = True
        where = np.where(again, mix((doc ^ 0x5BD1E995).astype(np.uint64)), h2 >> np.uint64(8)) % np.uint64(bins)
        order = np.argsort(where.astype(np.uint32), kind="stable")
        if repeated_row.any():
            order = order[~np.isin(order, o[repeated_row])]
        edges = np.searchsorted(where[order], np.arange(bins + 1, dtype=np.uint64))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            at = order[edges[b] : edges[b + 1]]
            new, old = at[~again[at]], at[again[at]]
            rows.append((int(b), h1[new].tobytes(), h2[new].astype(np.uint8).tobytes(), *_packed_places(doc[new], start[new]), *_packed_places(doc[old], start[old])))
            if len(rows) == 256:
                yield _as_batch(rows)
                rows = []
        if rows:
            yield _as_batch(rows)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["bin", "h", "tag", "doc", "n", "start", "dup_doc", "dup_n", "dup_start"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if not k else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=names)


@task
def _later(t: pa.Table, buckets: int) -> pa.Table:
    """The places in one bin that aren't the first of their window, packed by bucket of documents."""
    col = lambda c: t.column(c).to_pylist()
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in col("h")])
    tag = np.concatenate([np.frombuffer(x, np.uint8) for x in col("tag")])
    places = [_places(*x) for x in zip(col("doc"), col("n"), col("start"), strict=True) if len(x[0])]
    doc, start = (np.concatenate([p[k] for p in places]) if places else np.zeros(0, np.int64) for k in (0, 1))
    o = np.argsort(h, kind="stable")
    run = h[o]
    twice = np.zeros(len(o), bool)
    twice[1:] |= run[1:] == run[:-1]
    twice[:-1] |= run[1:] == run[:-1]
    o = o[twice]
    o = o[np.lexsort((start[o], doc[o], tag[o], h[o]))]
    later = np.zeros(len(o), bool)
    if len(o):
        new = np.ones(len(o), bool)
        new[1:] = (h[o][1:] != h[o][:-1]) | (tag[o][1:] != tag[o][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        later = (doc[o] != doc[o][first]) | (start[o] != start[o][first])
    dups = [_places(*x) for x in zip(col("dup_doc"), col("dup_n"), col("dup_start"), strict=True) if len(x[0])]
    doc = np.concatenate([doc[o][later], *(p[0] for p in dups)])
    start = np.concatenate([start[o][later], *(p[1] for p in dups)])
    bucket = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    o = np.lexsort((start, doc, bucket))
    which, first = np.unique(bucket[o], return_index=True)
    rows = [_packed_places(doc[k], start[k]) for k in np.split(o, first[1:])] if len(o) else []
    return pa.table({"bucket": pa.array(which, pa.int32()), **{c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate(("doc", "n", "start"))}})


@task
def _spans(t: pa.Table, length: int) -> pa.Table:
    """Maximal intervals of the windows' words, for each document of a bucket."""
    places = [_places(*x) for x in zip(*(t.column(c).to_pylist() for c in ("doc", "n", "start")), strict=True)]
    doc, start = (np.concatenate([p[k] for p in places]) for k in (0, 1))
    o = np.lexsort((start, doc))
    doc, start = doc[o], start[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    stop = start[np.append(first[1:], len(doc)) - 1] + length
    ids, n = np.unique(doc[first], return_counts=True)
    return pa.table({"doc_of_spans": pa.array(ids, pa.int64()), "starts": list_array(start[first], n, pa.int64()), "stops": list_array(stop, n, pa.int64())})


def buckets_for(size: int, cores: int) -> int:
    """Buckets of documents for `size` bytes of text. Every bin writes a row for each bucket, so buckets don't follow the shuffle
    partitions, which the bins follow, but the text, and the cores where it is small."""
    return max(2 * cores, -(-size // BUCKET_BYTES))


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@task
def _cut(batches: Iterator[pa.RecordBatch], apart: bool, joined: bool) -> Iterator[pa.RecordBatch]:
    for t in blocks(batches):
        n_words, spans, n_spans, kept = [], [], [], []
        starts, stops = t.column("starts").to_pylist(), t.column("stops").to_pylist()
        for text, null, at, to in zip(text_bytes(t.column("text")), t.column("text").is_null().to_pylist(), starts, stops, strict=True):
            words = text.split()
            n_words.append(len(words))
            a, b = np.array(at or [], np.int64), np.array(to or [], np.int64)
            if apart and len(a):
                own = a >> START_BITS == xxhash.xxh32_intdigest(text)
                a, b = (x[own] & ((1 << START_BITS) - 1) for x in (a, b))
            spans += list(zip(a.tolist(), b.tolist(), strict=True))
            n_spans.append(len(a))
            if joined:
                left = [w for i, j in zip([0, *b.tolist()], [*a.tolist(), len(words)], strict=True) for w in words[i:j]]
                kept.append(b" ".join(left))
            elif not len(a):
                kept.append(None if null else text)
            else:
                ends = [m.span() for m in WORD.finditer(text)]
                parts, done = [], 0
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    parts.append(text[done : ends[i][0]])
                    done = ends[j][0] if j < len(ends) else len(text)
                kept.append(b"".join([*parts, text[done:]]))
        offsets = np.zeros(len(n_spans) + 1, np.int32)
        np.cumsum(n_spans, out=offsets[1:])
        inner = pa.StructArray.from_arrays([pa.array([x[k] for x in spans], pa.int64()) for k in (0, 1)], names=["start", "stop"])
        t = t.drop_columns(["text", "starts", "stops"])
        out = [*(c.combine_chunks() for c in t.columns), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), inner), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=[*t.column_names, "n_words", "spans", "kept"])


def later_places(docs: DataFrame, length: int, apart: bool) -> DataFrame:
    """Windows that start earlier too, packed by buckets of documents: a row for each bin and bucket at most."""
    size = bytes_of(docs)
    bins, buckets = bins_for(docs, size=size), buckets_for(size, docs.sparkSession.sparkContext.defaultParallelism)
    packed = docs.where("doc_id is not null").mapInArrow(partial(_pack, length=length, bins=2 * bins, apart=apart), PACKED)
    return packed.groupBy("bin").applyInArrow(lambda t: _later(t, buckets), "bucket int, doc binary, n binary, start binary")


def remove_repeats(documents: DataFrame, length: int = 50, joined: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with n_words, spans (array of removed word intervals start, stop) and kept, the text left.

    Words are runs of characters other than \\x20 and \\x09-\\x0D. A word goes if it lies in a window of
    `length` words whose word sequence also starts earlier: in a smaller doc_id, or earlier in the same
    document. Windows are judged on the input. kept is the text without the removed intervals and the white
    space after each, or with `joined` the kept words with one space between them. A null text has no words
    and stays null (empty with `joined`). A null doc_id takes no part: nothing is removed and it removes
    nothing. Repeated rows are the same document; rows that share a doc_id but not the text go in the order
    of a 32-bit hash of the text (a text has fewer than 2 ** 31 words). An empty table gives no rows. Windows count as the same by 72 bits of two rolling
    hashes and the choice of one bin.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select("doc_id", "text")
    apart = not documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    later = later_places(docs, length, apart)
    spans = later.groupBy("bucket").applyInArrow(lambda t: _spans(t, length), "doc_of_spans bigint, starts array<bigint>, stops array<bigint>")
    spans = materialize(spans, "repeat-spans")
    size = spans.agg(F.coalesce(F.sum(24 + 16 * F.size("starts")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    clash = {"n_words", "spans", "kept", "text", "starts", "stops"} & set(keep)
    if clash:
        raise ValueError(f"keep names columns that are made here: {sorted(clash)}")
    rows = documents.select(*keep, "text", F.col("doc_id").alias("own_doc_id")).join(spans, F.col("own_doc_id") == F.col("doc_of_spans"), "left").select(*keep, "text", "starts", "stops")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return rows.mapInArrow(partial(_cut, apart=apart, joined=joined), f"{schema}, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, kept string")
