"""Keyed upserts, guarded snapshots and growing memory, for batches and for streams by foreachBatch.

Keyed state lies in hash buckets of its keys; a batch writes new files for the buckets it touches and then a small list
that says which files hold each bucket now. A batch that is replayed starts from the list before it and writes the same again,
and readers never see a half-written one. Snapshots are only ever added: each batch writes its own folder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.operators.order import keep_last
from tallyspark.sources.sinks import merged_memory


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], value: str, at: str, order: list[str], known: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """The table after a batch: a value updates or inserts, a null deletes or does nothing. Of a key that comes
    more than once in a batch the last counts; keys that `known` lacks are ignored. `seen` gets the counts saved and removed when the
    table is written."""
    last = keep_last(batch, keys, order)
    if known is not None:
        last = last.join(known, known.columns, "left_semi")
    new = last.select(*keys, F.col(value).alias("_v"), F.col(at).alias("_at"), F.lit(True).alias("_new"))
    both = current.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    hit = F.coalesce("_new", F.lit(False))
    if seen is not None:
        both = both.observe(seen, F.count_if(hit & F.col("_v").isNotNull()).alias("saved"), F.count_if(hit & F.col("_v").isNull() & F.col("_old").isNotNull()).alias("removed"))
    out = both.where(~(hit & F.col("_v").isNull()))
    return out.select(*[F.when(hit, F.col("_v")).otherwise(F.col(c)).alias(c) if c == value else F.when(hit, F.col("_at")).otherwise(F.col(c)).alias(c) if c == at else F.col(c) for c in current.columns])


def upsert_counts(current: DataFrame, batch: DataFrame, keys: list[str], value: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """saved and removed rows of a batch; keys that `known` lacks count for nothing, as in upsert."""
    last = keep_last(batch, keys, order)
    if known is not None:
        last = last.join(known, known.columns, "left_semi")
    old = current.select(*keys, F.lit(True).alias("_old"))
    j = last.join(old, keys, "left")
    return j.agg(F.count_if(F.col(value).isNotNull()).alias("saved"), F.count_if(F.col(value).isNull() & F.col("_old").isNotNull()).alias("removed"))


#: Lists of files that stay behind the newest one, with the files they name.
KEPT_VERSIONS = 2


class _Folder:
    """A folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._hadoop = spark, path, spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        at = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        at, fs = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def has(self, name: str) -> bool:
        at, fs = self._at(name)
        return fs.exists(at)

    def delete(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)

    def put(self, name: str, text: str) -> None:
        """Writes a small file beside its place and moves it there."""
        at, fs = self._at(name)
        new, _ = self._at(f"{name}.new")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(new, at)

    def get(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())


class Buckets:
    """A keyed table in hash buckets. A batch reads and rewrites the buckets its keys fall into, and no other."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.folder = _Folder(spark, path)

    def _bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _lists(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.folder.names("lists") if n.startswith("v=") and not n.endswith(".new"))

    def held(self, before: int | None = None) -> dict[int, int]:
        """Which version holds each bucket that isn't empty, as of the newest batch (or of the last one before a number)."""
        done = [n for n in self._lists() if before is None or n < before]
        return {int(b): v for b, v in json.loads(self.folder.get(f"lists/v={done[-1]}")).items()} if done else {}

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/v={v}/_bucket={b}" for b, v in sorted(self.held(before).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, step: Callable[[DataFrame, DataFrame], DataFrame], batch: DataFrame, number: int) -> None:
        """Replaces the touched buckets by step(their rows, batch). The driver holds one number for each bucket."""
        batch = batch.persist()
        touched = {r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()}
        made = step(self.read(number, touched), batch).withColumn("_bucket", self._bucket())
        made.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v={number}")
        batch.unpersist()
        written = {int(n.split("=")[1]) for n in self.folder.names(f"data/v={number}") if n.startswith("_bucket=")}
        held = {b: v for b, v in self.held(number).items() if b not in touched} | dict.fromkeys(written, number)
        self.folder.put(f"lists/v={number}", json.dumps(held))
        self._clean(number)

    def _clean(self, number: int) -> None:
        """Deletes lists and buckets that neither a reader nor a replay of this batch can need any more."""
        lists = [n for n in self._lists() if n <= number]
        needed = set()
        for n in lists[-KEPT_VERSIONS - 1 :]:
            needed |= {(v, b) for b, v in json.loads(self.folder.get(f"lists/v={n}")).items()}
        for n in lists[: -KEPT_VERSIONS - 1]:
            self.folder.delete(f"lists/v={n}")
        for v in (int(n[2:]) for n in self.folder.names("data") if n.startswith("v=")):
            if v <= number:
                for b in (n.split("=")[1] for n in self.folder.names(f"data/v={v}") if n.startswith("_bucket=")):
                    if (v, b) not in needed:
                        self.folder.delete(f"data/v={v}/_bucket={b}")


class Snapshots:
    """Rows of dated snapshots, added once. A date belongs to the feed that brought it first, over as many batches as its files
    come in; rows of the date from another feed, such as a second reading of the same files, add nothing, and a batch that is replayed
    replaces what it wrote before. Each batch writes a folder of its rows and then one of its dates, which are the ledger."""

    def __init__(self, spark: SparkSession, path: str, schema: str, feed: str, date: str = "snapshot_date"):
        self.spark, self.path, self.schema, self.date = spark, path, schema, date
        self.feed = hashlib.md5(feed.encode()).hexdigest()[:12]
        self.folder = _Folder(spark, path)

    def _done(self) -> list[str]:
        return [f"{f}/{b}" for f in self.folder.names("dates") for b in self.folder.names(f"dates/{f}") if self.folder.has(f"dates/{f}/{b}/_SUCCESS")]

    def dates(self, others: bool = False) -> DataFrame:
        """The ledger: (date, feed, batch), a row for each batch in which a date came; with `others` without this feed's own."""
        done = [f"{self.path}/dates/{d}" for d in self._done() if not (others and d.startswith(f"feed={self.feed}/"))]
        schema = f"{self.date} string, feed string, batch bigint"
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        done = [f"{self.path}/rows/{d}" for d in self._done()]
        return self.spark.read.schema(self.schema).parquet(*done) if done else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        at = f"feed={self.feed}/batch={number}"
        others = self.dates(others=True).select(self.date).distinct()
        own = batch.join(others, self.date, "left_anti").select(batch.columns)
        self.folder.delete(f"dates/{at}")
        own.write.mode("overwrite").parquet(f"{self.path}/rows/{at}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{at}")
        ledger = written.select(F.col(self.date).cast("string").alias(self.date)).distinct().select(self.date, F.lit(self.feed).alias("feed"), F.lit(number).cast("bigint").alias("batch"))
        ledger.write.mode("overwrite").parquet(f"{self.path}/dates/{at}")


def stream_into(stream: DataFrame, state: Buckets, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    """A stream writer that applies step(rows of the state, batch) for every batch, once for each."""
    return stream.writeStream.foreachBatch(lambda batch, number: state.apply(step, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_snapshots(stream: DataFrame, state: Snapshots, checkpoint: str) -> DataStreamWriter:
    """A stream writer that adds the snapshots of every batch; a file source reads its files in the order of their times."""
    return stream.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def memory_step(keys: list[str], order: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda current, batch: merged_memory(current, batch.where(F.col("source").isin("claude", "preparer")), keys, order)
