"""Shared helpers: tables in the checkpoint folder, blocks of documents, word hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Text of at most so many bytes is held by a Python worker at once (one longer document alone).
BLOCK_BYTES = 4 << 20
ARROW_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches sent to Python hold at most ARROW_BYTES, whatever the length of a row's text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a local one only where none is named and Spark is local: the
    executors of a cluster would each write to a folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    base = f"file://{tempfile.mkdtemp(prefix='tallyspark-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _written(df: DataFrame, name: str, by: str | None = None) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and lost
    executors cost nothing that was finished before. Its shuffle files go once it is written. `rows` of
    what is returned has the number of rows as n and, if there is a column `own`, in how many that holds."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n"), *([F.count_if("own").alias("own")] if "own" in df.columns else [])]
    path = _written(df.observe(seen, *counts), name)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to, made.rows = path, seen.get
    return made


def materialize_kinds(df: DataFrame, name: str, kinds: int) -> list[tuple[DataFrame, str]]:
    """The rows of each value from 0 of the column `kind`, as tables of their own, with their folders."""
    spark, path = df.sparkSession, _written(df, name, "kind")
    schema = df.drop("kind").schema
    made = {r["kind"] for r in spark.read.schema(df.schema).parquet(path).select("kind").distinct().collect()} if kinds else set()
    return [(spark.read.schema(schema).parquet(f"{path}/kind={k}") if k in made else spark.createDataFrame([], schema), f"{path}/kind={k}") for k in range(kinds)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of materialize that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def discard(made: DataFrame) -> None:
    """Delete the table of a DataFrame that materialize gave, once nothing reads it any more."""
    remove(made.sparkSession, made.written_to)


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers stay for later tasks beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def task(f: Callable) -> Callable:
    """Marks a function or generator that Spark runs on executors: its memory is given back when it ends."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(*args, **kwargs):
            try:
                yield from f(*args, **kwargs)
            finally:
                give_back()
    else:

        @functools.wraps(f)
        def run(*args, **kwargs):
            try:
                return f(*args, **kwargs)
            finally:
                give_back()

    return run


def planes(x: np.ndarray) -> bytes:
    """Byte planes of integers: those of small numbers are nearly all zero and vanish when compressed."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(*parts: bytes, level: int = 3) -> bytes:
    """Parts of bytes, compressed one by one: each has its own distribution."""
    out = [zstandard.ZstdCompressor(level=level).compress(p) for p in parts]
    return struct.pack(f"<{len(out)}I", *map(len, out)) + b"".join(out)


def unpack(data: bytes, n: int) -> list[bytes]:
    ends = np.cumsum([4 * n, *struct.unpack_from(f"<{n}I", data)]).tolist()
    return [zstandard.ZstdDecompressor().decompress(data[i:j]) for i, j in zip(ends, ends[1:])]


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after the other: lengths[i] of them from starts[i]."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def bytes_of(documents: DataFrame, column: str = "text") -> int:
    return documents.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def bins_for(documents: DataFrame, column: str = "text", bin_bytes: int = 32 << 20, size: int | None = None) -> int:
    """Hash bins for what is made of a column: each takes the share of bin_bytes of text, two or more for a shuffle partition.
    `size` is the column's bytes, where they are known."""
    size = bytes_of(documents, column) if size is None else size
    return max(2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bin_bytes))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Tables of documents whose texts have about `limit` bytes: small batches are joined and large ones split."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class WordHashes(dict):
    """64-bit hash of each word (bytes), kept so that a word is hashed once; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which every bit of the result hangs on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def list_array(values: np.ndarray, lengths: list[int] | np.ndarray, type_: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=type_))


#: Labels of so many nodes at most (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 2_000_000


def _near_sides(edges: DataFrame, name: str) -> DataFrame:
    """Of edges (u > v), with m the least v of a u: (u, m) with `own` true, once, and (v, m) for every other v."""
    w = Window.partitionBy("u")
    least = edges.select("u", "v", F.min("v").over(w).alias("m"), F.row_number().over(w.orderBy("v")).alias("row"))
    sides = least.where("row = 1 or v > m").select(F.when(F.col("row") == 1, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("row") == 1).alias("own"))
    return materialize(sides, name)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a hint to broadcast it, if it has at most so many rows."""
    return F.broadcast(df) if rows <= most else df


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of undirected edges (u, v), as (node, component: the smallest node), once for each node.

    In each round the smaller neighbours of a node are linked to the least of them, and every link to a node that has a
    smaller neighbour itself goes on to that one's least: one shuffle, by the larger node, and a join of the links with the
    nodes' least neighbours. A node of which many are linked is on the smaller side and isn't gathered anywhere. Rounds end when
    every node has one link and nothing is left to follow. Nodes are longs; loops and repeated edges are
    harmless; no edges give no rows. The table is written in the shared folder.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = _near_sides(e, "edges")
    for _ in range(max_rounds):
        own = e.where("own").select(F.col("u").alias("at"), F.col("v").alias("to"))
        own = small(own, e.rows["own"], BROADCAST_NODES)
        if e.rows["own"] == e.rows["n"] and e.join(own, e["v"] == own["at"], "left_semi").isEmpty():
            break
        last = e
        e = _near_sides(e.join(own, e["v"] == own["at"], "left").select("u", F.coalesce("to", "v").alias("v")), "edges")
        discard(last)
    else:
        raise RuntimeError("components: edges still change after the last round")
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    labels = materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops), "labels")
    discard(e)
    return labels


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) of what `labels` joins and the links (u, v) together; `labels` is deleted."""
    if labels is None:
        return components(links)
    near = small(labels, labels.rows["n"], BROADCAST_NODES)
    u, v = (near.select(F.col("node").alias(f"node_{c}"), F.col("component").alias(f"top_{c}")) for c in "uv")
    tops = links.join(u, F.col("u") == F.col("node_u"), "left").join(v, F.col("v") == F.col("node_v"), "left")
    tops = tops.select(F.coalesce("top_u", "u").alias("u"), F.coalesce("top_v", "v").alias("v"))
    more = components(tops)
    if not more.rows["n"]:
        discard(more)
        return labels
    onward = small(more, more.rows["n"], BROADCAST_NODES).select(F.col("node").alias("old"), F.col("component").alias("new"))
    known = labels.join(onward, labels["component"] == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = more.join(small(labels, labels.rows["n"], BROADCAST_NODES).select(F.col("node").alias("old")), more["node"] == F.col("old"), "left_anti")
    both = materialize(known.unionByName(fresh), "labels")
    discard(labels)
    discard(more)
    return both
