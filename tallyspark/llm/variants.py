"""Operator 11: groups of spelling variants by PartEnum signatures.

A word's multiset of letters is a binary vector with a dimension for each (letter, occurrence). One inserted or deleted letter
changes one dimension, a replaced one two, so near words lie within a Hamming distance of two. The dimensions are dealt into
partitions; of vectors within distance d at most d partitions differ, so they agree on all of some (partitions - d). A signature is
such a choice of partitions with the vector's part in them and the length: words of one length (distance two) and words
whose lengths differ by one (distance one) have signatures of their own, and only words whose signatures agree meet, in an
equi-join. Pairs are then verified by their edit distance. Words are counted in each block of documents before they are shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import blocks, bounded_batches, discard, materialize, mix, task, text_bytes

#: Partitions of the dimensions for words of one length and for lengths that differ by one; signatures leave out two of the former
#: and one of the latter.
SAME, NEXT = 6, 3
#: Distinct words that a task holds before it gives out their counts.
HELD = 400_000
#: Words for which signatures are made at once.
WORDS = 20_000
#: Letters by how often European languages use them: partitions take them in turn, so that they get like shares.
LETTERS = "eainrtosldcumpgvbhfzqyjxkw"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
EQUAL, SHORTER, LONGER = 0, 1, 2


@task
def _word_counts(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of the runs of at least `least` letters, some with a letter deleted; a word comes once for many documents."""
    find = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return made

    for t in blocks(batches):
        for doc_id, text in zip(t.column("doc_id").to_pylist(), text_bytes(t.column("text")), strict=True):
            prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for word, n in Counter(find(text.translate(LOWER).decode(errors="replace"))).items():
                h = zlib.crc32(word.encode(), prefix)
                if h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                counts[word] += n
        if len(counts) > HELD:
            yield out()
    if counts:
        yield out()


def _parts(words: list[str], partitions: int) -> np.ndarray:
    """A hash of each word's vector in each partition, as (words, partitions)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, owner))
    letters, owner = letters[order], owner[order]
    new = np.concatenate([[True], (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    occurrence = np.arange(len(letters)) - np.repeat(first, np.diff(np.append(first, len(letters))))
    turn = np.arange(max(int(letters.max()) + 1, 128))
    turn[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    dimension = mix((letters + (occurrence << 32)).astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(words) * partitions, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, owner * partitions + (turn[letters] + occurrence) % partitions, dimension)
    return out.reshape(-1, partitions)


def signatures(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, signature of each word) for every choice of partitions: words of one length share one of kind EQUAL if their
    vectors differ in at most two dimensions; a word and one with a letter more share one of SHORTER and LONGER if in at most one."""
    lengths = np.fromiter(map(len, words), np.uint64, len(words))
    for partitions, out, kinds in ((SAME, 2, ((EQUAL, 0),)), (NEXT, 1, ((SHORTER, 0), (LONGER, 1)))):
        parts = _parts(words, partitions)
        for no, chosen in enumerate(combinations(range(partitions), partitions - out)):
            with np.errstate(over="ignore"):
                joined = np.zeros(len(words), np.uint64)
                for p in chosen:
                    joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + parts[:, p] + np.uint64(1))
                for kind, less in kinds:
                    yield kind, mix(joined + mix((lengths - np.uint64(less)) * np.uint64(1000) + np.uint64(100 * out + no)))


@task
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, WORDS):
            b = whole.slice(at, WORDS)
            for kind, signature in signatures(b.column("word").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(np.full(b.num_rows, kind), pa.int32()), b.column("word"), b.column("n")], names=["signature", "kind", "word", "n"])


def word_counts(documents: DataFrame, least: int = 7, every: int = 31, often: int = 2) -> DataFrame:
    """(word, n) of documents (doc_id, text): maximal runs of [A-Za-z\\u00C0-\\u00FF] with A-Z in lower case. Where `every` divides
    the unsigned crc32 h of "<doc_id>:<run>", the run's code point h % length is deleted. Words have at least `least` code
    points and n >= often.

    A null or empty text has no words; a null doc_id is written as nothing; repeated rows count again; an empty table gives no rows."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = docs.mapInArrow(partial(_word_counts, least=least, every=every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb) of words (word, n; each word once): all pairs at an edit distance of one, each once."""
    signed = words.select("word", "n").mapInArrow(_signed, "signature bigint, kind int, word string, n bigint")
    a = signed.select("signature", F.col("kind").alias("kind_a"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = signed.select("signature", F.col("kind").alias("kind_b"), F.col("word").alias("b"), F.col("n").alias("nb"))
    same = (F.col("kind_a") == EQUAL) & (F.col("kind_b") == EQUAL) & (F.col("a") < F.col("b"))
    more = (F.col("kind_a") == SHORTER) & (F.col("kind_b") == LONGER)
    met = a.join(b, "signature").where((same | more) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n; each word once).

    Near words differ by one inserted, deleted or replaced code point; n_near counts them. A word's form is its near word
    of largest n (ties: the smallest in code-point order) if that n is at least `times` the word's, else null; form_n is the form's n. root
    follows the forms to the last word, and is the word itself where there is none. An empty table gives no rows; a null
    word is near nothing. Forms grow by `times` at every step, so as many joins as log2 of the longest possible chain resolve
    all roots.
    """
    known = materialize(words.where("word is not null"), "variant-words")
    pairs = near_pairs(known)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n"))))
    both = pairs.select(sides.alias("s")).select("s.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * times
    stats = best.select(F.col("word").alias("of"), "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    stats = materialize(stats, "variant-forms")
    jump = materialize(stats.where("form is not null").select(F.col("of").alias("start"), F.col("form").alias("root")), "variant-roots")
    largest = known.agg(F.max("n")).first()[0] or 1
    longest = math.floor(math.log(largest, times)) + 1 if times > 1 else largest
    for _ in range(math.ceil(math.log2(max(longest, 1)))):
        onward = jump.select(F.col("start").alias("root"), F.col("root").alias("next"))
        last, jump = jump, materialize(jump.join(onward, "root", "left").select("start", F.coalesce("next", "root").alias("root")), "variant-roots")
        discard(last)
    out = known.join(stats, known["word"] == stats["of"], "left").join(jump, known["word"] == jump["start"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
