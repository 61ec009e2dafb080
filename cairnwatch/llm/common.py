"""Helpers the corpus operators share: shared-storage cuts, Arrow batch slicing, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, so that memory follows
#: this bound (or the longest single text), not the Arrow batch.
SLICE_BYTES = 2_000_000


_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit words over all their bits (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of any spans of a sequence of numbers, by polynomial prefix sums modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(Spans.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            Spans.up, Spans.down = (np.r_[np.uint64(1), np.cumprod(np.full(n - 1, b, np.uint64))] for b in (_BASE, inverse))
        self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Spans.up[: len(data)])]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Spans.down[starts])


#: The folder of each application that names none, in local mode.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir; a fresh one where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext.applicationId
        path = _OWN[own] = _OWN.get(own) or "file://" + tempfile.mkdtemp(prefix="cairnwatch-")
    return path.rstrip("/")


#: Rows of an Arrow batch: texts are long, and a batch stands in the JVM and in Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS rows in this session, unless it has a lower bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Folders written by cut() in each call of a tidy operator that is still running, outermost first.
_WRITTEN: list[set[str]] = []


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Cuts lineage with a written table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _plain(path: str) -> str:
    """A path without the slashes that file systems write differently after the scheme."""
    return path.replace("file:///", "/").replace("file:/", "/")


def _roots(df: DataFrame) -> set[str]:
    """The folders that a DataFrame reads, from its plan: no file is listed."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves().iterator(), set()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths().iterator()
            while paths.hasNext():
                found.add(_plain(paths.next().toString()))
    return found


def discard(df: DataFrame) -> None:
    """Deletes a table that cut() wrote and nothing reads any more."""
    spark = df.sparkSession
    root = _plain(shared_dir(spark))
    for folder in _roots(df):
        if folder.startswith(root):
            _delete(spark, folder)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that leaves behind only those of its written tables that its result still reads."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _WRITTEN.append(set())
        first = args[0] if args else next(iter(kwargs.values()))
        small_batches(first if isinstance(first, SparkSession) else first.sparkSession)
        try:
            result = operator(*args, **kwargs)
        except BaseException:
            _WRITTEN.pop()
            raise
        written = _WRITTEN.pop()
        read = _roots(result)
        kept = {path for path in written if _plain(path) in read}
        for path in written - kept:
            _delete(result.sparkSession, path)
        if _WRITTEN:
            _WRITTEN[-1].update(kept)
        return result

    return run


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no further column of the input can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id and text, never null; rows that repeat both share it."""
    parts = (F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.unhex(F.md5(F.concat(*parts)))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, row) of each row of docs: its row_key, and all its columns in one, so that no name can clash."""
    return docs.select(row_key(docs[id_col].cast("long"), docs[text_col]).alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def _give_back() -> None:
    """Hands memory that Python no longer uses back to the system; a worker waits for its next task without it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of at most `most` bytes of `column`, one row at least."""
    for batch in batches:
        start = size = 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
    _give_back()


def running_total(df: DataFrame, group: str, order: list[Column], tag: str, out: str, value: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` (1) over the rows before this one in its `group`.

    No group comes into one task: rows are dealt into hashed buckets, each bucket is summed
    on its own and the buckets' totals give the offsets. The order is by bucket, then `order`;
    with value 1 it numbers the rows of a group from 0 without gaps.
    """
    from pyspark.sql import Window as W

    buckets = 4 * shuffle_width(df.sparkSession)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn("_value", F.lit(1) if value is None else value)
    sums = dealt.groupBy(group, "_bucket").agg(F.sum("_value").alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut(sums.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), tag)
    within = W.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.withColumn("_before", F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .join(offsets, [group, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_before")).cast("long"))
        .drop("_bucket", "_value", "_before", "_offset")
    )


@tidy
def connected_components(edges: DataFrame, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `edges` (a, b long): label is the smallest node reachable.

    Alternates large-star and small-star passes (Kiveris et al. 2014) until only stars are
    left: nodes below their component's smallest. Minima are pre-aggregated by Spark's
    partial aggregation; the joins back read written tables, so that AQE can split the
    partition of a hub. Fails rather than returning unfinished labels.
    """
    current = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    for _ in range(most_rounds):
        ends = current.select(F.col("a").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(current.select(F.col("b").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        unfinished = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where(F.col("below") + F.col("above") > 1)
        if unfinished.isEmpty():
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), tag)
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where(F.col("a") != F.col("b")).distinct(), tag)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), tag)
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = cut(small.where(F.col("a") != F.col("b")).distinct(), tag)
        for old in (current, least, large, low):
            discard(old)
        current = after
    else:
        raise RuntimeError("connected components did not settle")
    top = current.select(F.col("b").alias("node")).distinct()
    return cut(current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(top.select("node", F.col("node").alias("label"))), tag)
