"""Operator 4: quality rules of documents and verdicts on their hosts.

Each text is measured whole. Rule failures are summed per host (combined before the shuffle); a beta prior is
fitted to all hosts by moments of the beta-binomial, each host's failure rate is shrunk towards it, and hosts
whose shrunk rate is over the limit are rejected with all their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import WordHashes, blocks, bounded_batches, materialize, mix, task, text_bytes
from tallyspark.llm.substrings import BASES, Rolling

WINDOW = 5
#: Bytes of text that are measured at once: sums over bytes take many times as much.
BLOCK = 1 << 20
#: So many rejected hosts at most are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
SPACE = b" \t\n\x0b\x0c\r"
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_byte = np.arange(256)
#: Bytes that begin a code point outside white space, and the symbols.
IN_WORD = ((_byte & 0xC0) != 0x80) & ~np.isin(_byte, list(SPACE))
IS_SYMBOL = np.isin(_byte, list(b"#*$%&|<>"))


def repeated_words(values: np.ndarray, row: np.ndarray, rows: int, one: Rolling, two: Rolling) -> np.ndarray:
    """Words of each row that lie in a window of WINDOW words found twice or more in the row."""
    if len(values) < WINDOW:
        return np.zeros(rows, np.int64)
    inside = np.flatnonzero(row[: len(values) - WINDOW + 1] == row[WINDOW - 1 :])
    own = mix(row[inside].astype(np.uint64) + np.uint64(1))
    a, b = one.windows(values, WINDOW)[inside] ^ own, two.windows(values, WINDOW)[inside] ^ own
    o = np.argsort(a, kind="stable")
    same = (a[o][1:] == a[o][:-1]) & (b[o][1:] == b[o][:-1])
    twice = np.zeros(len(o), bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(len(values) + 1, np.int64)
    at = inside[o[twice]]
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW, -1)
    return np.bincount(row[np.cumsum(steps[:-1]) > 0], minlength=rows)


@task
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, one, two = WordHashes(), Rolling(BASES[0]), Rolling(BASES[1])
    for t in blocks(batches, limit=BLOCK):
        texts = text_bytes(t.column("text"))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        total = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[np.concatenate([[0], ends])])
        parts = [hashes.of(x.split()) for x in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        lines = [[y for y in x.split(b"\n") if y.strip(SPACE)] for x in texts]
        again = [len(x) - len(set(x)) for x in lines]
        repeats = repeated_words(np.concatenate(parts), np.repeat(np.arange(len(texts)), counts), len(texts), one, two)
        t = t.drop_columns(["text"])
        cols = [pa.array(np.asarray(x, dtype=np.int64)) for x in (counts, total(IN_WORD), total(IS_SYMBOL), again, repeats)]
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), *cols], names=[*t.column_names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measures(documents: DataFrame) -> DataFrame:
    """The columns of documents without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Words are runs of characters other than \\x20 and \\x09-\\x0D; a null or empty text has none and zeros. Null ids
    and repeated rows stay as they are; columns of the made names are replaced; an empty table gives no rows."""
    documents = documents.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    bounded_batches(documents.sparkSession)
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.drop("text").schema)
    return documents.mapInArrow(_measure, f"{rest}, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n, f, rate) of failures (host, failed): the host's failure rate shrunk by the empirical beta prior.

    With m the rate of all rows, the variance between hosts is estimated by moments from the spread of the
    host rates less what chance gives; the prior counts as m (1 - m) / variance - 1 rows (without a variance,
    or with one host, every rate is m). Rows without a host are left out."""
    hosts = failures.where("host is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("failed").cast("int")).cast("double").alias("f"))
    whole = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("sn"), F.sum("f").alias("sf"), F.sum(F.expr("n * n")).alias("snn"), F.sum(F.expr("f * f / n")).alias("sff"))
    m = whole.withColumn("m", F.expr("sf / sn")).withColumn("v", F.expr("if(sn - snn / sn > 0, (sff - sf * sf / sn - m * (1 - m) * (h - 1)) / (sn - snn / sn), 0)"))
    prior = m.select("m", F.expr("if(v > 0, greatest(m * (1 - m) / v - 1, 0), null)").alias("rows"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "f", F.expr("coalesce((f + m * rows) / (n + rows), m)").alias("rate"))


def judge(documents: DataFrame, host: Column, max_rate: float = 0.5) -> DataFrame:
    """The columns of documents without text, with the measures, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of them in a 5-word window that comes twice. kept: not
    base_failed, and the host's shrunk failure rate is at most max_rate. A null host gets no verdict; a null
    text fails; repeated rows count each; an empty table gives no rows. Columns of the input with the names made here
    are replaced."""
    own = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in ("text", "base_failed", "kept", *[m.split()[0] for m in MEASURES.split(", ")])]).alias("row"), "text", host.alias("host_of_document"))
    made = measures(own).withColumn("base_failed", base_failed())
    made = materialize(made, "measures")
    bad = materialize(host_rates(made.select(F.col("host_of_document").alias("host"), F.col("base_failed").alias("failed"))).where(F.col("rate") > max_rate).select(F.col("host").alias("bad_host")), "bad-hosts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    out = made.join(bad, F.col("host_of_document") == F.col("bad_host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).select("row.*", *[m.split()[0] for m in MEASURES.split(", ")], "base_failed", "kept")
