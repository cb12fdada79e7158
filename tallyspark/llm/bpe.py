"""Operator 5: byte-level BPE encoding and decoding by a shuffle of distinct words.

Documents are cut into pre-tokens in blocks of a bounded size. A block is written as one row that holds its
positions, as numbers of its distinct pre-tokens (the most frequent number is the smallest, so the bytes
compress well), with the bin of each, and as one row of packed distinct pre-tokens for each hash bin, in the order of
their numbers, so that ids that come back need no numbers. A bin meets every occurrence of
its words over all blocks, encodes each distinct word once and joins the ids back to the blocks that have it; a
block is then reassembled by position. A frequent word is shuffled once for each block, not for each
occurrence. Decoding joins the ids with the table of token bytes, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bins_for, blocks, bounded_batches, from_planes, materialize, materialize_kinds, pack, planes, remove, stretches, task, unpack

#: Bytes of text in a block.
BLOCK = 8 << 20
OUT_BYTES = 4 << 20
BIN_BYTES = 16 << 20
SPLIT = "kind int, block string, doc_ids array<bigint>, lengths array<int>, sequence binary, bins binary, bin int, words binary"
#: Stands between packed words; no UTF-8 text has this byte.
END = b"\xff"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file; a vocabulary has a fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Numbers(dict):
    """Numbers words from 0 in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack_ids(n: np.ndarray, ids: np.ndarray) -> bytes:
    """Counts of ids and the ids, in two bytes each where all are small."""
    short = not len(ids) or int(ids.max()) < 1 << 16
    return pack(planes(n.astype(np.int32)), ids.astype("<u2").tobytes() if short else b"", b"" if short else planes(ids), level=12)


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, short, long = unpack(data, 3)
    return from_planes(n, np.int32), np.frombuffer(short, "<u2").astype(np.uint32) if not long else from_planes(long, np.uint32)


def _pack_sequence(x: np.ndarray) -> bytes:
    """Numbers as their high bytes, the low bytes of those under 256 and the low bytes of the others."""
    low, high = x.astype(np.uint8), x >> 8
    return pack(planes(high), low[high == 0].tobytes(), low[high > 0].tobytes(), level=9)


def _unpack_sequence(data: bytes) -> np.ndarray:
    high, small, large = unpack(data, 3)
    x = from_planes(high, np.uint32) << np.uint32(8)
    under = x == 0
    x[under] = np.frombuffer(small, np.uint8)
    x[~under] |= np.frombuffer(large, np.uint8)
    return x


def cut_by(pattern: str) -> Callable[[], Callable[[bytes], list]]:
    """Makes, on an executor, the function that finds the pattern's matches."""

    def make() -> Callable[[bytes], list]:
        import regex

        find = regex.compile(pattern).findall
        return lambda text: find(text.decode())

    return make


@task
def _split(batches: Iterator[pa.RecordBatch], cutter: Callable[[], Callable[[bytes], list]], bins: int, core: Callable[[bytes], bytes] | None) -> Iterator[pa.RecordBatch]:
    cut = cutter()
    kinds = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(SPLIT.split(", "), kinds, strict=True)])
    for t in blocks(batches, limit=BLOCK):
        numbers, parts = Numbers(), []
        for text in t.column("text").cast(pa.binary()):
            words = cut(text.as_py() or b"")
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        sequence = np.concatenate(parts)
        order = np.argsort(-np.bincount(sequence, minlength=len(numbers)), kind="stable").astype(np.int32)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = [w if isinstance(w, bytes) else w.encode() for w in numbers]
        where = np.fromiter((xxhash.xxh32_intdigest(core(w) if core else w) for w in words), np.uint32, len(words))[order] % np.uint32(bins)
        block = uuid.uuid4().hex
        packed = {"sequence": _pack_sequence(rank[sequence]), "bins": pack(planes(where))}
        yield pa.RecordBatch.from_pylist([{"kind": 0, "block": block, "doc_ids": t.column("doc_id").to_pylist(), "lengths": [len(p) for p in parts], **packed}], schema)
        del sequence, parts, numbers, packed
        by_bin = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[by_bin], np.arange(bins + 1))
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            own = [words[k] for k in order[by_bin[edges[b] : edges[b + 1]]]]  # the most frequent first
            rows.append({"kind": 1, "block": block, "bin": int(b), "words": pack(END.join(own), level=12)})
        yield pa.RecordBatch.from_pylist(rows, schema)


_coders: dict[str, object] = {}


def _rank_encoder(ranks, name: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Encodes words by the broadcast ranks of a file; a process keeps one encoder for each."""
    import tiktoken

    if name not in _coders:
        _coders[name] = tiktoken.Encoding("ranks", pat_str=".+", mergeable_ranks=ranks.value, special_tokens={})
    piece = _coders[name]._core_bpe.encode_single_piece

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [piece(w) for w in words]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    return encode


@task
def _encode(t: pa.Table, encoder: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]]) -> pa.Table:
    """The ids of the words of one bin, packed for each block; a distinct word is encoded once."""
    numbers = Numbers()
    own = []
    for packed in t.column("words").to_pylist():
        words = unpack(packed, 1)[0].split(END)
        own.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    flat, n = encoder()(list(numbers))
    start, out = np.cumsum(n) - n, []
    for x in own:
        out.append(_pack_ids(n[x], flat[stretches(start[x], n[x])]))
    return pa.table({"block": t.column("block"), "bin": t.column("bin"), "ids": pa.array(out, pa.binary())})


@task
def _reassemble(batches: Iterator[pa.RecordBatch], then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> Iterator[pa.RecordBatch]:
    yield from then(_blocks_of_ids(batches)) if then else _blocks_of_ids(batches)


def _blocks_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            doc_ids, lengths = b.column("doc_ids")[r].values, np.asarray(b.column("lengths")[r].values, dtype=np.int64)
            back = b.column("back")[r].as_py() or []
            sequence = _unpack_sequence(b.column("sequence")[r].as_py())
            place = np.argsort(from_planes(*unpack(b.column("bins")[r].as_py(), 1), np.uint32), kind="stable")
            parts = [_unpack_ids(x["ids"]) for x in sorted(back, key=lambda x: x["bin"])]
            n = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
            flat = np.concatenate([np.zeros(0, np.uint32), *(p[1] for p in parts)])
            del back, parts
            if len(place) != len(n):
                raise ValueError("a block has not got the ids of all its words")
            start, count = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            start[place], count[place] = np.cumsum(n) - n, n
            done = doc = 0
            so_far = np.cumsum(lengths)
            while doc < len(lengths):  # a few MB of ids at a time
                stop = max(doc + 1, int(np.searchsorted(so_far, done + OUT_BYTES // 16)))
                part = sequence[done : int(so_far[stop - 1])]
                each = count[part]
                ends = np.cumsum(each)
                ids = flat[stretches(start[part], each)]
                bounds = np.concatenate([[0], ends])[np.concatenate([[0], so_far[doc:stop] - done])]
                data = ids.astype("<u4").tobytes()
                out = [data[4 * i : 4 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(doc, stop - doc), pa.array(np.diff(bounds), pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])
                done, doc = int(so_far[stop - 1]), stop


def encode_words(documents: DataFrame, cutter: Callable[[], Callable[[bytes], list]], encoder: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]], core: Callable[[bytes], bytes] | None = None, then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of documents (doc_id, text): the ids of the parts into which the cutter's function
    cuts a text (UTF-8), one after the other; the encoder's function gives all ids of a list of distinct parts, and how
    many each has. Both are made on the executors. Words with the same core meet in one call of the encoder. then: what
    is made of the rows' batches in the same task, with its schema."""
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bins = bins_for(docs, bin_bytes=BIN_BYTES)
    (rows, _), (words, words_path) = materialize_kinds(docs.mapInArrow(partial(_split, cutter=cutter, bins=bins, core=core), SPLIT), "word-blocks", 2)
    ids = materialize(words.select("bin", "block", "words").groupBy("bin").applyInArrow(lambda t: _encode(t, encoder), "block string, bin int, ids binary"), "word-ids")
    remove(spark, words_path)
    back = ids.groupBy("block").agg(F.collect_list(F.struct("bin", "ids")).alias("back"))
    joined = rows.select("block", "doc_ids", "lengths", "sequence", "bins").join(back, "block", "left").drop("block")
    return joined.mapInArrow(partial(_reassemble, then=then[0] if then else None), then[1] if then else "doc_id bigint, n_tokens bigint, ids binary")


def bpe_encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of documents (doc_id, text); ids are little-endian unsigned 32-bit.

    Each match of the pattern is encoded by itself with the ranks, without special tokens. A null or empty
    text has no tokens and empty ids. A null doc_id stays null; repeated rows give repeated results; an empty
    table gives no rows; other columns of the input are ignored. Texts of any length are encoded whole.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    return encode_words(documents, cut_by(pattern), lambda: _rank_encoder(ranks, ranks_path))


@task
def _decode(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    starts, data = table.value
    data = np.frombuffer(data, np.uint8)
    for b in batches:
        ids = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in b.column("ids").to_pylist()]
        out = []
        for x in ids:
            out.append(data[stretches(starts[x], starts[x + 1] - starts[x])].tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The columns of encoded with decoded (in place of a column of that name), the bytes of its ids; null or empty ids
    decode to no bytes.

    The token-byte table (one row a token, a vocabulary's size) is sent to every executor and joined there.
    """
    spark = encoded.sparkSession
    bounded_batches(spark)
    encoded = encoded.drop("decoded")
    by_id = {i: t for t, i in load_ranks(ranks_path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    table = spark.sparkContext.broadcast((starts, b"".join(tokens)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(partial(_decode, table=table), f"{schema}, decoded binary")
