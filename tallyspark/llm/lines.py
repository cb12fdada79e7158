"""Operator 9: line dedup by pairwise alignment.

Every line of at least `min_chars` characters is hashed; a minimum per hash (combined before the shuffle) gives
the earliest document that has it, and each later document is paired with the earliest holders of its lines:
a star for each line, never all pairs of those who share it, whatever the number of its holders. A pair is
formed once, however many lines it shares. Patience diff aligns each pair and the aligned common blocks go from
the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import blocks, bounded_batches, materialize, task


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that occur once in each range, in the longest run of rising positions."""
    once = {x for x, n in Counter(a[a0:a1]).items() if n == 1} & {x for x, n in Counter(b[b0:b1]).items() if n == 1}
    place = {x: k for k, x in enumerate(b[b0:b1], b0) if x in once and x}
    pairs = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place]
    tails, ends, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, rising in both; 0 stands for a line without words."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        i0, j0 = a0, b0
        found = _anchors(a, b, a0, a1, b0, b1)
        for i, j in found:
            out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        if found:
            todo.append((i0, a1, j0, b1))
    return sorted(out)


def common_lines(a: list[int], b: list[int], rare: set[int] | None) -> list[int]:
    """Positions in b of the aligned blocks that hold a rare line or two long lines; long lines have odd hashes.
    Without a set every long line counts as a rare one."""
    gone, block = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            long = [b[y] for _, y in block if b[y] & 1]
            if len(long) > 1 or any(rare is None or x in rare for x in long):
                gone += [y for _, y in block]
            block = []
        block.append((i, j))
    return gone


@task
def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [common_lines(a, b, None if r is None else set(r)) for a, b, r in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "rare")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("later"), pa.array(gone, pa.list_(pa.int32()))], names=["later", "gone"])


@task
def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in blocks(batches):
        texts, n, dropped = [], [], []
        for text, gone in zip(t.column("text").to_pylist(), t.column("gone").to_pylist(), strict=True):
            lines = text.split("\n") if text is not None else []
            out = set(gone or ())
            n.append(len(lines))
            dropped.append(len(out))
            texts.append("\n".join(x for k, x in enumerate(lines) if k not in out) if out else text)
        t = t.drop_columns(["text", "gone"])
        cols = [pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), *cols], names=[*t.column_names, "text", "n_lines", "n_dropped"])


def drop_aligned_lines(documents: DataFrame, min_chars: int = 20, rare: int | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with text (what is left), n_lines and n_dropped, one row for each input row.

    Lines are cut at \\n and compared without white space at their ends. A document is aligned with each
    earlier document (smaller doc_id) that is the first to hold one of its lines of min_chars characters.
    Aligned runs of lines that hold such a line are deleted from the later document; the first document keeps
    everything. With `rare`, a pair needs a first-held line in at most so many documents or two first-held
    lines, and a run needs such a rare line or two lines. A null text stays
    null with no lines; a null doc_id takes no part; equal rows are the same document and both are kept;
    rows that share a doc_id but not the text go in the order of a text hash. An empty table gives no rows.
    """
    clash = {"text", "n_lines", "n_dropped", "gone"} & set(keep)
    if clash:
        raise ValueError(f"keep names columns that are made here: {sorted(clash)}")
    bounded_batches(documents.sparkSession)
    me = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("me")
    line = lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))
    code = lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.shiftleft(F.shiftright(F.xxhash64(x, F.length(x)), 1), 1) + (F.length(x) >= min_chars).cast("bigint"))
    hashed = F.transform(F.split("text", "\n"), lambda x: code(line(x)))
    table = materialize(documents.where("doc_id is not null and text is not null").select(me, hashed.alias("lines")).dropDuplicates(["me"]), "line-hashes")
    long = table.select("me", F.explode(F.array_distinct(F.filter("lines", lambda x: x.bitwiseAND(F.lit(1)) == 1))).alias("line"))
    held = long.groupBy("line").agg(F.min("me").alias("first"), F.count("*").alias("df")).where("df > 1")
    shared = long.join(held, "line").where("me > first")
    pairs = shared.groupBy(F.col("me").alias("later"), F.col("first").alias("earlier"))
    if rare is None:
        pairs = pairs.agg(F.lit(None).cast("array<bigint>").alias("rare"))
    else:
        pairs = pairs.agg(F.count("*").alias("n"), F.collect_list(F.expr(f"if(df <= {rare}, line, null)")).alias("rare")).where("n > 1 or size(rare) > 0")
    one, two = table.select(F.col("me").alias("earlier"), F.col("lines").alias("a")), table.select(F.col("me").alias("later"), F.col("lines").alias("b"))
    aligned = pairs.join(two, "later").join(one, "earlier").select("later", "a", "b", "rare")
    gone = aligned.mapInArrow(_align, "later struct<doc_id:bigint,h:bigint>, gone array<int>").groupBy("later").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    mine = documents.select(*[F.col(c) for c in keep], "text", me)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return mine.join(gone, mine["me"] == gone["later"], "left").select(*keep, "text", "gone").mapInArrow(_drop, f"{schema}, text string, n_lines bigint, n_dropped bigint")
