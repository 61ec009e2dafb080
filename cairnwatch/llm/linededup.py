"""Line deduplication by a suffix array over line-ID sequences, in DataFrame operations alone.

The lines of all documents (those with words) form sequences of line IDs. Prefix doubling
ranks suffixes by their first 1, 2, 4, ... lines: the pair of ranks at p and p + h orders
the first 2h lines, and distinct pairs, sorted, give the next ranks. Suffixes of one rank
are an interval of the suffix array whose common prefix is at least that long; those alone
in theirs can repeat nothing and drop out. A run counts as repeated from `min_words` words
on, and since each line has a word, the interval that a suffix shares its first `min_words`
words with is reached after log2(min_words) doublings; deeper ranks couldn't change it.
Any window of such an interval is named by two overlapping ranks, so the shortest windows
from every line forward and backward name all intervals; their union is the maximal runs.
All occurrences but the first of each interval are deleted; the first stays whole, also
where a run overlaps itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.llm.common import cut, shuffle_width, tidy

WORDS = r"[^\x20\x09-\x0D]+"
_LAST = (1 << 63) - 1


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """A document's place: its id (null: after all) and, among equal ids, a hash of its text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)), F.xxhash64(docs["text"].cast("string"))


def sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """(o, x, idx, line, sym, e, s) for each line that has words.

    o, x: the document; idx: number among its lines with words, line: among all; sym: 16
    bytes for the line's text; e (s): the last (first) idx of the shortest window of
    min_words words from (to) this line, null where the document ends first.
    """
    o, x = _identity(docs)
    lines = docs.select(o.alias("o"), x.alias("x"), F.posexplode(F.split(docs["text"].cast("string"), "\n")).alias("line", "_t"))
    lines = lines.select("o", "x", "line", F.unhex(F.md5("_t")).alias("sym"), F.regexp_count("_t", F.lit(WORDS)).alias("w")).where("w > 0")
    # Rows that repeat id and text are one document. The lines of a document meet once, for
    # this and for the windows below.
    lines = lines.repartition("o", "x").dropDuplicates(["o", "x", "line"])
    doc = W.partitionBy("o", "x")
    by_line = doc.orderBy("line")
    lines = lines.withColumn("idx", F.row_number().over(by_line) - 1).withColumn("c", F.sum("w").over(by_line).cast("long"))
    lines = lines.withColumn("a", F.col("c") - F.col("w"))
    ahead, behind = doc.orderBy("a").rangeBetween(0, min_words - 1), doc.orderBy("c").rangeBetween(-(min_words - 1), 0)
    lines = lines.withColumn("e", F.max("idx").over(ahead)).withColumn("ce", F.max("c").over(ahead))
    lines = lines.withColumn("s", F.min("idx").over(behind)).withColumn("as", F.min("a").over(behind))
    return lines.select(
        "o", "x", "idx", "line", "sym",
        F.when(F.col("ce") >= F.col("a") + min_words, F.col("e")).alias("e"),
        F.when(F.col("as") <= F.col("c") - min_words, F.col("s")).alias("s"),
    )


def _ranked(distinct: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """distinct with `rank`, a number that rises with the keys: sorted ranges numbered in turn."""
    n = shuffle_width(distinct.sparkSession)
    ordered = distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut(ordered.withColumn("rank", F.monotonically_increasing_id()), tag)


def ranks(lines: DataFrame, levels: int) -> list[DataFrame]:
    """For each level k the suffixes (o, x, idx, r) that share their first 2**k lines with another, by rank."""
    seen = lines.groupBy("sym").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sym")
    first = _ranked(seen, ["sym"], "lines-symbols")
    active = [cut(lines.select("o", "x", "idx", "sym").join(first, "sym").select("o", "x", "idx", F.col("rank").alias("r")), "lines-rank")]
    for k in range(levels):
        now = active[-1]
        ahead = now.select("o", "x", (F.col("idx") - (1 << k)).alias("idx"), F.col("r").alias("r2"))
        pairs = cut(now.join(ahead, ["o", "x", "idx"]), "lines-pairs")
        again = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "r2")
        ranked = _ranked(again, ["r", "r2"], "lines-ranked")
        active.append(cut(pairs.join(ranked, ["r", "r2"]).select("o", "x", "idx", F.col("rank").alias("r")), "lines-rank"))
    return active


def repeated(lines: DataFrame, min_words: int) -> DataFrame:
    """(o, x, idx) of the lines inside later occurrences of runs of min_words words or more."""
    levels = max(0, min_words.bit_length() - 1)
    stacked = None
    for k, level in enumerate(ranks(lines, levels)):
        level = level.select(F.lit(k).alias("k"), "o", "x", "idx", "r")
        stacked = level if stacked is None else stacked.unionByName(level)
    forward = lines.where("e IS NOT NULL").select("o", "x", F.col("idx").alias("b"), "e")
    backward = lines.where("s IS NOT NULL").select("o", "x", F.col("s").alias("b"), F.col("idx").alias("e"))
    windows = forward.unionByName(backward).withColumn("n", F.col("e") - F.col("b") + 1)
    windows = windows.withColumn("k", F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int"))
    left = stacked.select("k", "o", "x", F.col("idx").alias("b"), F.col("r").alias("r1"))
    right = stacked.select("k", "o", "x", F.col("idx").alias("t"), F.col("r").alias("r2"))
    named = windows.join(left, ["k", "o", "x", "b"]).withColumn("t", F.expr("e + 1 - shiftleft(1, k)"))
    named = cut(named.join(right, ["k", "o", "x", "t"]).select("o", "x", "b", "e", "n", "r1", "r2", "k"), "lines-windows")
    place = F.struct("o", "x", "b")
    firsts = cut(named.groupBy("k", "n", "r1", "r2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("k", "n", "r1", "r2", "first"), "lines-firsts")
    later = named.join(firsts, ["k", "n", "r1", "r2"]).where(place != F.col("first"))
    # A run may overlap itself: the lines of its first occurrence stay.
    own = (F.col("o") == F.col("first.o")) & (F.col("x") == F.col("first.x"))
    later = later.withColumn("b", F.when(own, F.greatest("b", F.col("first.b") + F.col("n"))).otherwise(F.col("b"))).where("b <= e")
    return later.select("o", "x", F.explode(F.sequence("b", "e")).alias("idx")).distinct()


@tidy
def deduplicate(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text) for each row of docs, text without the deleted lines.

    Lines end at \\n. A run of whole lines with min_words words or more that occurs before,
    by ascending doc_id (null last) and line, is deleted, but for lines that a first
    occurrence shares with a later one that overlaps it: that of each run stays whole. Lines
    without words are kept and don't part a run. Rows that repeat id and text are one document and all get its result;
    different texts of one id are ordered by hash. A null text stays null with 0 lines, an
    empty one has 1 line. An empty table gives an empty result; other columns aren't read.
    """
    lines = cut(sequences(docs, min_words), "lines")
    gone = repeated(lines, min_words)
    by_doc = gone.join(lines.select("o", "x", "idx", "line"), ["o", "x", "idx"]).groupBy("o", "x").agg(F.collect_list("line").alias("gone"))
    by_doc = cut(by_doc, "lines-gone")
    o, x = _identity(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), o.alias("o"), x.alias("x"))
    # What is deleted grows with the input: never broadcast it, however small it is here.
    rows = rows.join(by_doc.hint("merge"), ["o", "x"], "left")
    parts = F.split("text", "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    clean = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    return rows.select(
        "doc_id", n.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_deleted"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(clean).alias("text"),
    )
