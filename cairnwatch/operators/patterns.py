"""Graph patterns as joins: labelled nodes, typed relations either way, one to n of them in a row.

A pattern is a start and hops, as in (a:Label)-[:TYPE|OTHER*1..3]->(b:Label). Each hop is a join
on the nodes reached so far; only named nodes are kept and equal rows are merged after each
hop, so that what is carried grows with the answers, not with the paths to them. For a
hop of several relations each task reads what it needs of the graph, and lists no paths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwatch.operators.reach import walk
from cairnwatch.sources.shared import TASK_ROWS, cut, parts_for

#: Ends in a list of steps at most.
PACK = 256
#: Bytes of a row group of a table that tasks read parts of.
GROUP_BYTES = 4 << 20
#: Starts that walk together: as many as this, and fewer, but not below the second, while there are fewer groups than partitions.
WALK_STARTS, LEAST_STARTS = 50_000, 2_000
#: Relations that a task gets in a hop of one relation: few, as each may go on from many rows.
STEP_ROWS = 250_000
#: Starts that are carried as sets of bits at most; more are carried as rows.
SET_STARTS = 4096

OUT, IN, BOTH = "out", "in", "both"


@dataclass(frozen=True)
class Hop:
    """One to `most` relations of the types (all by default) towards `direction`, to a node of the label (any by default).

    name: the column that the node becomes; None for a node that the answer leaves out.
    """

    types: tuple[str, ...] = ()
    direction: str = OUT
    most: int = 1
    label: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Pattern:
    """A start node (its column's name and label) and the hops from it."""

    start: str
    label: str | None = None
    hops: tuple[Hop, ...] = field(default=())


def _steps(edges: DataFrame, hop: Hop) -> DataFrame:
    """(_from, _to) of each relation that a hop may take."""
    rows = edges.where(F.col("type").isin(*hop.types)) if hop.types else edges
    out, back = rows.select(F.col("src").alias("_from"), F.col("dst").alias("_to")), rows.select(F.col("dst").alias("_from"), F.col("src").alias("_to"))
    return {OUT: out, IN: back, BOTH: out.unionByName(back)}[hop.direction]


def _packed(steps: DataFrame, as_bytes: bool = False) -> DataFrame:
    """(_from, _ends): the steps from a node, dealt by it, in lists of at most PACK ends, each end once; a hub has many lists.

    as_bytes: a list is the bytes of its numbers, which are read much faster than a list of them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            both = now if before is None else pa.concat_tables([before, now])
            a, b = (both.column(c).combine_chunks() for c in ("_from", "_to"))
            turn = pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True] if before is None else [], turn | pc.not_equal(b[1:], b[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)
            turn, before, now = np.concatenate([[True] if before is None else [], turn]).astype(bool)[new], now.slice(len(now) - 1), now.filter(pa.array(new))
            if len(now):
                turn[0] = True  # a list ends with its batch
                runs = np.flatnonzero(turn)
                at = np.arange(len(now)) - np.repeat(runs, np.diff(np.append(runs, len(now))))
                begins = np.flatnonzero(at % PACK == 0)
                froms, ends = (now.column(c).combine_chunks() for c in ("_from", "_to"))
                bounds = np.append(begins, len(now)).astype(np.int32)
                if as_bytes:
                    ends = ends.to_numpy()
                    lists = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds * ends.itemsize), pa.py_buffer(np.ascontiguousarray(ends))])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(bounds), ends)
                yield pa.RecordBatch.from_arrays([froms.take(pa.array(begins)), lists], names=["_from", "_ends"])

    return steps.select("_from", "_to").sortWithinPartitions("_from", "_to").mapInArrow(run, f"_from {kinds['_from']}, _ends {'binary' if as_bytes else f'array<{kinds["_to"]}>'}")


def _names(steps: DataFrame) -> tuple[DataFrame, int]:
    """(_number, _name) of all ends of the steps, in their order, so that ends of one kind mostly lie together; written. And how many they are."""
    spark = steps.sparkSession
    names = cut(steps.select(F.col("_from").alias("_name")).unionByName(steps.select(F.col("_to").alias("_name"))).where("_name IS NOT NULL").distinct(), "ids")
    ranges = names.repartitionByRange(math.ceil(max(1, names.count()) / TASK_ROWS), "_name").sortWithinPartitions("_name")
    # The id counts rows from each partition's 2 ** 33 times its number on; what the partitions before it have makes it dense.
    placed = cut(ranges.withColumn("_id", F.monotonically_increasing_id()), "placed")
    counts = {r["_p"]: r["n"] for r in placed.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    number = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), (F.shiftright("_id", 33) + 1).cast("int")) + F.col("_id") % (1 << 33)
    return cut(placed.select(number.cast("int" if total < 1 << 31 else "long").alias("_number"), "_name"), "names", GROUP_BYTES), total


def reached(starts: DataFrame, edges: DataFrame, hop: Hop) -> DataFrame:
    """(_at, _end): nodes within 1 to hop.most relations of each start (_at), the start itself left out if more than one is allowed.

    Nodes come to the frontier when they are first reached and are not gone through again, so
    cycles end and a hub's paths are not listed. With a single relation, loops count. Rows are
    distinct. Several relations are gone through where the starts are: nodes are numbered, the
    relations are written as lists of numbers, and tasks read from these what their starts need
    (reach.walk), so that neither what is found on the way nor the rows themselves are moved or
    written.
    """
    steps = _steps(edges, hop)
    if hop.most == 1:
        return starts.distinct().join(steps.distinct(), F.col("_at") == F.col("_from")).select("_at", F.col("_to").alias("_end")).distinct()
    names, total = _names(steps)
    n = math.ceil(max(1, steps.count()) / TASK_ROWS)
    by = lambda end, number: names.select(F.col("_name").alias(end), F.col("_number").alias(number))
    # Sorted to meet the names of their ends, steps take less room in the next shuffle; to meet those they come from, few a partition, they need not be.
    ends = steps.join(by("_to", "_t"), "_to").select("_from", "_t").repartition(n, "_from")
    numbered = ends.join(by("_from", "_f").repartition(n, "_from").hint("shuffle_hash"), "_from").select(F.col("_f").alias("_from"), F.col("_t").alias("_to"))
    packed = cut(_packed(numbered, True), "packed", GROUP_BYTES)
    starts = cut(starts.distinct(), "starts")
    many = starts.count()
    groups = max(math.ceil(many / WALK_STARTS), min(math.ceil(many / LEAST_STARTS), parts_for(starts.sparkSession, 0)), 1)
    by_group = starts.join(by("_at", "_n"), "_at").groupBy(F.pmod(F.col("_n"), F.lit(groups)).alias("_group")).agg(F.sort_array(F.collect_list(F.struct("_n", "_at"))).alias("_starts"))
    dealt = by_group.repartitionByRange(groups, "_group").select(F.col("_starts._n").alias("_numbers"), F.col("_starts._at").alias("_names"))
    kinds = [f"_at {starts.schema['_at'].dataType.simpleString()}", f"_end {steps.schema['_to'].dataType.simpleString()}"]
    return dealt.mapInArrow(walk(packed.inputFiles(), names.inputFiles(), total, hop.most), ", ".join(kinds))


def _numbered(starts: DataFrame, column: str) -> DataFrame | None:
    """(column, _number) of the starts, written; None where they are more than SET_STARTS."""
    few = cut(starts.select(column).limit(SET_STARTS + 1).withColumn("_number", F.row_number().over(W.orderBy(column)) - 1), "starts")
    return few if few.count() <= SET_STARTS else None


def _sets(numbers: DataFrame, column: str) -> DataFrame:
    """(_now, _word, _bits): each start by itself, as the set of 64 numbers' bits in which it is."""
    return numbers.select(F.col(column).alias("_now"), F.floor(F.col("_number") / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, _number % 64)").alias("_bits"))


def _members(sets: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    """(column, _now): the starts of each node's set."""
    one = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("_bits"), i).bitwiseAND(1) == 1)
    rows = sets.select("_now", "_word", F.explode(one).alias("_bit")).withColumn("_number", F.col("_word") * 64 + F.col("_bit"))
    return rows.join(numbers, "_number").select(column, "_now")


def match(nodes: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """Distinct rows of the pattern's named nodes. nodes: (id, label); edges: (src, type, dst).

    A relation is not used twice by one hop, but two hops may use the same one. Nodes that
    nodes doesn't list have no label. Null ids and ends match nothing.
    """

    def labelled(rows: DataFrame, column: str, label: str | None) -> DataFrame:
        if label is None:
            return rows
        return rows.join(nodes.where(F.col("label") == label).select(F.col("id").alias(column)), column, "left_semi")

    state = labelled(nodes.where("id IS NOT NULL").select(F.col("id").alias(pattern.start)).distinct(), pattern.start, pattern.label)
    state, named, at = state.withColumn("_now", F.col(pattern.start)), [pattern.start], "_now"
    # Until a node is named, few starts are carried as a set at each node reached: a hop makes a row a relation, not one for each start as well.
    numbers = _numbered(state, pattern.start) if pattern.hops and not pattern.hops[0].name else None
    state = state if numbers is None else _sets(numbers, pattern.start)
    single = [h for h in pattern.hops if h.most == 1]
    n = parts_for(edges.sparkSession, edges.count(), STEP_ROWS) if single else 0
    for k, hop in enumerate(pattern.hops):
        first = k == 0 and hop.most > 1 and numbers is None  # its pairs already are the rows: each start by itself
        if hop.most == 1:
            # Steps are dealt once for both: those without repeats, and the join.
            steps = _steps(edges, hop).repartition(n, "_from").distinct().withColumnRenamed("_to", "_end")
            state = state.repartition(n, at).join(labelled(steps, "_end", hop.label), F.col(at) == F.col("_from"))
        else:
            pairs = labelled(reached(state.select(F.col(at).alias("_at")), edges, hop), "_end", hop.label)
            state = pairs.withColumn(pattern.start, F.col("_at")) if first else state.join(pairs, F.col(at) == F.col("_at"))
        state = state.withColumn(at, F.col("_end"))
        if numbers is not None:
            state = state.groupBy(at, "_word").agg(F.bit_or("_bits").alias("_bits"))
            if hop.name or k == len(pattern.hops) - 1:
                state, numbers = _members(state, numbers, pattern.start), None
        elif not first:
            state = state.select(*named, at).distinct()
        if hop.name:
            named.append(hop.name)
            state = state.withColumn(hop.name, F.col(at))
        state = state if numbers is not None else state.select(*named, at)
    # With the last node named, rows are distinct as they are.
    return state.drop("_now") if pattern.hops and pattern.hops[-1].name else state.select(*named).distinct()
