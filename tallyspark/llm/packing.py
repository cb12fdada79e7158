"""Operator 1: best-fit packing of token sequences with certified bin counts.

Texts become pieces of at most `capacity` token ids. Pieces are dealt evenly over partitions of a bounded
number of rows, each packed by best-fit decreasing. Dual-feasible functions give a lower bound for each
partition: where it equals the number of bins the partition is certified and gives back only its emptiest bin;
a partition with a gap gives back every bin that isn't full. What is given back is exchanged: dealt anew over
fewer partitions and packed again, until one partition is left, an exchange saves no bin, TURNS are over, or the bins are as few as the
bound of the whole, which follows from a histogram of the lengths (`capacity` rows at most).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import encode_words
from tallyspark.llm.common import bounded_batches, materialize, stretches

ROWS_A_PARTITION = 20_000
#: Further runs of best fit, on slightly changed orders, in a partition with a gap.
TRIES = 16
#: Exchanges at most. Each deals what the one before gave back over fewer partitions, so that later ones save ever less; the numbers
#: of sequences have room for 63.
TURNS = 32


_tokenizers: dict[str, object] = {}
#: Punctuation that ends words; after a letter or a digit it is a token part of its own, as the word before it is.
TAIL = b".,;:!?\"')]}"
QUOTED = b"<|"


def _core(word: bytes) -> bytes:
    """An ASCII word in lower case without the punctuation at its end; other words, and those that may hold a
    special token, as they are."""
    if QUOTED in word or not word.isascii():
        return word
    core = word.rstrip(TAIL)
    return core.lower() if core[-1:].isalnum() else word.lower()


def check_words(source: str) -> None:
    """Raise unless a tokenizer's file (JSON) is of the kind whose texts fall into words that are encoded once each: lower-cased, cut
    at white space, which is dropped, letters apart from punctuation, and no added token that could stand in a word without QUOTED."""
    import json

    spec = json.loads(source)
    kinds = lambda x: {x.get("type"), *(n.get("type") for n in x.get("normalizers", []) + x.get("pretokenizers", []))} if x else set()
    split = [n for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if n.get("type") == "Split" and n.get("invert") and n.get("behavior") == "Removed"]
    pattern = split[0]["pattern"].get("Regex", "") if split else ""
    words = "Lowercase" in kinds(spec.get("normalizer")) and "[\\p{L}]+" in pattern and "[^\\s\\p{L}\\p{N}]+" in pattern
    odd = [t["content"] for t in spec.get("added_tokens", []) if QUOTED.decode() not in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if not words or odd or spec.get("truncation") or spec.get("padding"):
        raise ValueError(f"texts for this tokenizer can't be encoded word by word: {odd or spec.get('pre_tokenizer')}")


def _word_encoder(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Encodes words with a tokenizer file, each core and each tail once; a process keeps one tokenizer."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    tokenizer = _tokenizers[path]

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cores = [_core(w) for w in words]
        tails = [w[len(c) :] for w, c in zip(words, cores, strict=True)]
        numbers = {x: k for k, x in enumerate(dict.fromkeys([b"", *cores, *tails]))}
        parts = [x.decode() for x in numbers]
        lists = [e.ids for k in range(0, len(parts), 10_000) for e in tokenizer.encode_batch_fast(parts[k : k + 10_000], add_special_tokens=False)]
        flat, n = np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        start = np.cumsum(n) - n
        both = np.empty(2 * len(words), np.int64)
        both[::2] = np.fromiter(map(numbers.__getitem__, cores), np.int64, len(words))
        both[1::2] = np.fromiter(map(numbers.__getitem__, tails), np.int64, len(words))
        return flat[stretches(start[both], n[both])], n[both].reshape(-1, 2).sum(axis=1)

    return encode


def _white_space() -> Callable[[bytes], list]:
    return bytes.split


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    tail = np.array([end], "<u4").tobytes()
    for b in batches:
        rows = []
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
            data = (ids or b"") + tail
            rows += [(doc_id, k // (4 * capacity), k // 4, min(4 * capacity, len(data) - k) // 4, data[k : k + 4 * capacity]) for k in range(0, len(data), 4 * capacity)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids"])


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids) of documents (doc_id, text): the ids of the whole text without special
    tokens, then `end`, cut into pieces of `capacity` ids. The tokenizer must be one that drops white space and
    takes words by themselves, as the word-level BPE files do, ASCII ones without regard to case and apart from
    punctuation after their last letter or digit: each distinct word is encoded once in the corpus. Special tokens that a text
    quotes are found as the file has it. A null or empty text is the one id `end`; a null doc_id and repeated rows are kept as they are; other
    columns are ignored. ids: little-endian, 32 bits. A tokenizer of another kind is an error."""
    with open(tokenizer_path, encoding="utf-8") as f:
        check_words(f.read())
    cut = (partial(_pieces, capacity=capacity, end=end), "doc_id bigint, piece int, start bigint, length bigint, ids binary")
    return encode_words(documents, _white_space, lambda: _word_encoder(tokenizer_path), _core, cut)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; counts[x] items have length x. The largest bound of the dual-feasible
    functions: the identity, the thresholds (lengths under e vanish, those over capacity - e fill a bin),
    and the rounding functions u_k with k from 1 to 20, alone and after each threshold."""
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((x * counts).sum()) // capacity)
    below, volume = np.cumsum(counts), np.cumsum(x * counts)
    for e in range(1, capacity // 2 + 1):  # U_e: lengths under e vanish, those over capacity - e fill a bin
        high = int(below[capacity] - below[capacity - e])
        mid = int(volume[capacity - e] - volume[e - 1])
        best = max(best, high + -(-mid // capacity))
    for k in range(1, 21):
        u = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((u * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given in falling order, or nearly), and the room left in each bin. Bins are kept by
    their room; a number with one bit for each room that occurs finds the tightest fit."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, left, bins, offsets = 0, [], [], []
    for n in lengths:
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - room)
        left[b] = room = room - n
        rooms[room].append(b)
        mask |= 1 << room
    return bins, offsets, left


def _pack_part(t: pa.Table, capacity: int, turn: int, last: bool) -> pa.Table:
    t = t.sort_by([("length", "descending"), ("row", "ascending")])
    lengths = t.column("length").to_pylist()
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    bins, offsets, left = best_fit_decreasing(lengths, capacity)
    certified = len(left) == bound
    for attempt in range(0 if certified else TRIES):  # the same with nearly falling orders
        r = np.random.default_rng([turn, attempt])
        order = np.argsort(-np.array(lengths) * (1 + (attempt + 1) / TRIES * 0.2 * r.random(len(lengths))), kind="stable")
        other = best_fit_decreasing([lengths[k] for k in order.tolist()], capacity)
        if len(other[2]) < len(left):
            left, back = other[2], np.argsort(order)
            bins, offsets = np.array(other[0])[back].tolist(), np.array(other[1])[back].tolist()
            certified = len(left) == bound
            if certified:
                break
    left = np.array(left)
    if last:
        opened = np.zeros(len(left), bool)
    elif certified:
        opened = np.arange(len(left)) == int(np.argmax(left))
        opened &= left > 0
    else:
        opened = left > 0
    bins = np.array(bins, np.int64)
    ids = (np.int64(turn) << 57) | (np.int64(t.column("part")[0].as_py()) << 25) | bins
    return pa.table({"row": t.column("row"), "length": t.column("length"), "sequence_id": ids, "offset": np.array(offsets, np.int64), "open": opened[bins]})


def _packer(capacity: int, turn: int, last: bool):
    return lambda t: _pack_part(t, capacity, turn, last)


def best_fit_pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (any columns, with length from 1 to capacity) plus sequence_id and offset.

    The pieces of a sequence_id fill it from offset 0 without gaps and never exceed the capacity. Lengths that
    equal the capacity are sequences of their own. Ties go in the order of the written rows, repeated rows are pieces
    each; an empty table gives no rows; a length that is null or out of range is an error. Columns of pieces that are
    called sequence_id or offset are replaced."""
    spark = pieces.sparkSession
    bounded_batches(spark)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    length = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit("a length out of range"))).cast("bigint")
    held = pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("piece"), length.alias("length"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(held, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    bound, done = lower_bound(counts, capacity), int(counts[capacity])
    whole = rows.where(F.col("length") == capacity).select("row", (F.lit(-1).cast("bigint") - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    todo, placed = rows.where(F.col("length") < capacity).select("row", "length"), [whole]
    n, turn, fewest = int(counts[:capacity].sum()), 0, None
    while n:  # until a turn saves no bin; one partition or turn TURNS is the last
        parts = -(-n // ROWS_A_PARTITION)
        last = parts == 1 or turn + 1 == TURNS
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        packed = dealt.groupBy("part").applyInArrow(_packer(capacity, turn, last), "row bigint, length bigint, sequence_id bigint, offset bigint, open boolean")
        packed = materialize(packed, "packed")
        bins, opened, n = packed.agg(F.count_distinct("sequence_id"), F.count_distinct(F.expr("if(open, sequence_id, null)")), F.count_if("open")).first()
        if done + bins == bound or fewest is not None and done + bins >= fewest:  # as few as can be, or nothing saved
            best = before.where("open") if fewest is not None and done + bins > fewest else packed  # a turn can need more than the one before
            placed.append(best.select("row", "sequence_id", "offset"))
            break
        placed.append(packed.where("not open").select("row", "sequence_id", "offset"))
        fewest, before = done + bins, packed
        done += bins - opened
        todo = packed.where("open").select("row", "length")
        turn += 1
    return rows.join(reduce(DataFrame.unionByName, placed), "row").select("piece.*", "sequence_id", "offset")
