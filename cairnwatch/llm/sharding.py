"""Sharding by balanced label propagation.

Documents that are linked (they share a text) vote through their group for the shard most
of them are in and move there under capacity quotas, whole groups at a time; shards
without room for a group drop out of its next vote. Documents without links cost nothing
wherever they lie, so they fill the shards up to sizes that differ by one row at most.
Groups of over a quarter of a shard, few by their size, are placed first, largest first;
only what fits no shard whole is split, and then fills shards one after another.

Then single rows move: in each round every row that has links in several shards counts its
neighbours by shard and asks to go where most of them are; requests are admitted in pairs
of opposite direction, or against rows without links, so that no count changes, and rounds
go on until the cut stops falling. Any table of links will do: a row may have many hubs.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwatch.llm.common import connected_components, cut, discard, running_total, text_key, tidy


def pieces(sizes: dict[bytes, int], room: list[int]) -> dict[bytes, list[tuple[int, int]]]:
    """(end, shard) of the consecutive pieces of each group; takes their rows from `room`.

    The largest goes first to the fullest shard that holds it whole. What fits none fills
    the emptiest shard, and the rest waits for its turn by size.
    """
    waiting = [(-n, g) for g, n in sizes.items()]
    heapq.heapify(waiting)
    out: dict[bytes, list[tuple[int, int]]] = {g: [] for g in sizes}
    while waiting:
        n, g = heapq.heappop(waiting)
        n = -n
        whole = [s for s, r in enumerate(room) if r >= n]
        to = min(whole, key=lambda s: room[s]) if whole else max(range(len(room)), key=lambda s: room[s])
        part = min(n, room[to])
        room[to] -= part
        out[g].append(((out[g][-1][0] if out[g] else 0) + part, to))
        if n > part:
            heapq.heappush(waiting, (part - n, g))
    return out


def _large(rows: DataFrame, large: dict[bytes, int], room: list[int]) -> DataFrame:
    """(uid, shard) of the rows of large groups; takes them from `room`."""
    placed = pieces(large, room)
    table = [(bytearray(g), [e for e, _ in p], [s for _, s in p]) for g, p in placed.items()]
    table = rows.sparkSession.createDataFrame(table, "grp binary, ends array<long>, shards array<int>")
    numbered = running_total(rows.select("uid", "grp").join(F.broadcast(table), "grp"), "grp", [F.col("uid")], "shard-large", "_at")
    at = F.size(F.filter("ends", lambda e: e <= F.col("_at"))) + 1
    return numbered.select("uid", F.element_at("shards", at).alias("shard"))


def propagate(links: DataFrame, room: list[int]) -> tuple[DataFrame | None, DataFrame]:
    """((uid, shard), the rest) of linked rows (uid, hub, n), n the rows of a hub; at most room[s] of them in shard s.

    Each round, a hub's rows vote with their present shards, hubs propose to go to the
    winner, and proposals are admitted while the shard's quota lasts. Hubs that were not
    admitted vote again among the shards that have room for them, until none is left that
    any shard has room for; those others are the rest.
    """
    waiting = cut(links.select("uid", "hub", "n", F.pmod(F.xxhash64("uid"), F.lit(len(room))).cast("int").alias("shard")), "shard-labels")
    settled, rest, turn = None, None, 0
    while True:
        most = F.lit(max(room)).cast("long")
        out = cut(waiting.where(F.col("n") > most).select("uid", "hub", "n"), "shard-rest")
        rest = out if rest is None else rest.unionByName(out)
        waiting = waiting.where(F.col("n") <= most)
        if waiting.isEmpty():
            return settled, rest
        # A label on a shard without room turns into one of the open ones, in proportion to its hash.
        rooms = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(r).cast("long").alias("r")) for s, r in enumerate(room)])
        opened = F.transform(F.filter(rooms, lambda x: x["r"] >= F.col("n")), lambda x: x["s"])
        other = F.element_at("opened", (F.pmod(F.xxhash64("hub", F.lit(turn)), F.size("opened")) + 1).cast("int"))
        labelled = waiting.withColumn("opened", opened).withColumn("shard", F.when(F.array_contains("opened", F.col("shard")), F.col("shard")).otherwise(other)).drop("opened")
        votes = labelled.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "shard", F.lit(turn)).alias("tie"), "shard")).alias("b"), F.sum("n").alias("weight"))
        proposals = best.select("hub", F.col("b.shard").alias("to"), "weight")
        ordered = running_total(proposals, "to", [F.col("hub")], "shard-quota", "ahead", F.col("weight"))
        room_of = F.element_at(F.array(*map(F.lit, room)), F.col("to") + 1)
        admitted = cut(ordered.where(F.col("ahead") + F.col("weight") <= room_of).select("hub", "to", "weight"), "shard-admitted")
        for r in admitted.groupBy("to").agg(F.sum("weight").alias("w")).collect():  # a row a shard
            room[r["to"]] -= r["w"]
        moved = waiting.join(admitted, "hub").select("uid", F.col("to").alias("shard"))
        settled = cut(moved if settled is None else settled.unionByName(moved), "shard-settled")
        left = cut(labelled.join(admitted, "hub", "left_anti"), "shard-labels")
        discard(waiting)
        waiting, turn = left, turn + 1


def cut_links(state: DataFrame, links: DataFrame) -> float:
    """Pairs of rows that share a hub but not a shard, of (uid, shard) and (uid, hub), counted for each hub."""
    votes = links.join(state, "uid").groupBy("hub", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = votes.groupBy("hub").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return by.agg(F.sum((F.col("t") * F.col("t") - F.col("s")) / 2)).first()[0] or 0.0


def _wishes(state: DataFrame, links: DataFrame, turn: int) -> tuple[float, DataFrame]:
    """The cut, and (uid, shard, to) of half of the rows that have more neighbours elsewhere, another half each turn."""
    here = cut(links.join(state, "uid"), "shard-here")
    votes = here.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    by = votes.groupBy("hub").agg(F.sum(F.col("n").cast("double")).alias("t"), F.sum(F.col("n").cast("double") * F.col("n")).alias("s"), F.collect_list(F.struct("shard", "n")).alias("votes"))
    by = cut(by.where("t * t > s"), "shard-open")  # a hub has a vote a shard at most
    total = by.agg(F.sum((F.col("t") * F.col("t") - F.col("s")) / 2)).first()[0] or 0.0
    if not total:
        return total, state.limit(0).withColumn("to", F.col("shard"))
    # A row's hubs that lie in one shard hold it there; a row without open hubs doesn't ask.
    asking = here.join(by.select("hub"), "hub", "left_semi").select("uid").distinct()
    mine = here.join(asking, "uid", "left_semi").join(by.select("hub", "votes"), "hub", "left")
    whole = votes.groupBy("hub").agg(F.max("n").alias("n"))
    mine = mine.join(whole, "hub").withColumn("votes", F.coalesce("votes", F.array(F.struct("shard", "n"))))
    scores = mine.select("uid", "shard", F.explode("votes").alias("v")).groupBy("uid", "shard", F.col("v.shard").alias("to")).agg(F.sum(F.col("v.n") - (F.col("v.shard") == F.col("shard")).cast("long")).alias("score"))
    best = scores.groupBy("uid", "shard").agg(F.max(F.struct("score", F.xxhash64("to", F.lit(turn)).alias("tie"), "to")).alias("b"), F.max(F.when(F.col("to") == F.col("shard"), F.col("score"))).alias("own"))
    wishes = best.where(F.col("b.score") > F.coalesce("own", F.lit(0))).where(F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(2)) == 0)
    return total, wishes.select("uid", "shard", F.col("b.to").alias("to"))


def admitted(asked: dict[tuple[int, int], int], free: list[int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many requests (from, to) are granted, and how many rows without links go (from, to) in return; changes `free`."""
    granted = {(i, j): min(n, asked.get((j, i), 0)) for (i, j), n in asked.items()}
    returned: dict[tuple[int, int], int] = {}
    for (i, j), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - granted[i, j], free[j])
        if more:
            granted[i, j] += more
            returned[j, i] = returned.get((j, i), 0) + more
            free[j] -= more  # a row moves once a round
    return {k: n for k, n in granted.items() if n}, returned


def _moved(rows: DataFrame, spans: dict[int, list[tuple[int, int]]], tag: str) -> DataFrame:
    """(uid, to): of rows (uid, grp), numbered within grp, those that the (count, to) spans of grp reach."""
    if not spans:
        return rows.select("uid", F.lit(0).alias("to")).limit(0)
    table, at = [], 0
    for g, parts in spans.items():
        ends, at = [], 0
        for n, _ in parts:
            at += n
            ends.append(at)
        table.append((g, ends, [to for _, to in parts]))
    table = F.broadcast(rows.sparkSession.createDataFrame(table, "grp int, ends array<long>, to array<int>"))  # a row a pair of shards at most
    numbered = running_total(rows.join(table, "grp"), "grp", [F.col("uid")], tag, "_at")
    place = F.size(F.filter("ends", lambda e: e <= F.col("_at"))) + 1
    return numbered.where(F.col("_at") < F.element_at("ends", -1)).select("uid", F.element_at("to", place).alias("to"))


def refine(state: DataFrame, links: DataFrame, shards: int, patience: int = 3) -> DataFrame:
    """(uid, shard) with fewer pairs cut than in `state`, or as many; every shard keeps its count of rows.

    links: (uid, hub), any number of hubs a row and rows a hub. Ends when no request can be
    granted, or when the cut hasn't fallen for `patience` rounds; the best state is returned.
    """
    links = cut(links.select("uid", "hub").distinct(), "shard-edges")
    linked = links.select("uid").distinct()
    state = cut(state.select("uid", "shard"), "shard-state")
    best, least, stale, turn = state, None, 0, 0
    while stale < patience:
        total, wishes = _wishes(state, links, turn)
        if least is None or total < least:
            best, least, stale = state, total, 0
        else:
            stale += 1
        if not total:
            break
        turn += 1
        wishes = cut(wishes.withColumn("grp", F.col("shard") * shards + F.col("to")), "shard-wishes")
        asked = {(r["shard"], r["to"]): r["n"] for r in wishes.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pair of shards
        loose = state.join(linked, "uid", "left_anti")
        counts = {r["shard"]: r["n"] for r in loose.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
        granted, returned = admitted(asked, [counts.get(s, 0) for s in range(shards)])
        if not granted:
            stale += 1
            if not asked:
                break
            continue
        moves = _moved(wishes.select("uid", "grp"), {i * shards + j: [(n, j)] for (i, j), n in granted.items()}, "shard-granted")
        back: dict[int, list[tuple[int, int]]] = {}
        for (i, j), n in returned.items():
            back.setdefault(i, []).append((n, j))
        moves = cut(moves.unionByName(_moved(loose.select("uid", F.col("shard").alias("grp")), back, "shard-returned")), "shard-moves")
        state = cut(state.join(moves, "uid", "left").select("uid", F.coalesce("to", "shard").alias("shard")), "shard-state")
    return best


@tidy
def assign_links(docs: DataFrame, links: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, grp) for rows of docs linked by (doc_id, hub).

    As assign(), but rows are linked by any hubs (hosts, topics, citations): what hubs connect
    is placed whole where any shard holds it, and laid out in sequence where none does; rows
    then move by refine(). Rows of a doc_id that no hub names,
    or without one, are free; a hub of one row links nothing; null hubs are left out.
    """
    rows = _rows(docs)
    edges = rows.join(links.select("doc_id", F.xxhash64(F.col("hub").cast("string")).alias("hub")).where(links["hub"].isNotNull()), "doc_id").select("uid", "hub")
    edges = cut(edges.distinct(), "shard-links")
    # Rows have numbers from 0 on, hubs negative ones.
    joined = connected_components(edges.select(F.col("uid").alias("a"), F.col("hub").bitwiseOR(F.lit(-(1 << 63))).alias("b")), "shard-cc")
    whole = rows.select("uid").join(joined.withColumnRenamed("node", "uid"), "uid", "left").select("uid", text_key(F.coalesce("label", "uid").cast("string")).alias("grp"))
    return _slots(rows, refine(_placed(cut(whole, "shard-whole"), shards), edges, shards))


def _rows(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        text_key(text).alias("grp"),
    )
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()), "shard-rows")


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _fill(room: list[int], at: Column) -> Column:
    """The shard of the row numbered `at` if shards are filled one after another."""
    ends, upto = [], 0
    for free in room:
        upto += free
        ends.append(upto)
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= at)).cast("int")


def _slots(rows: DataFrame, state: DataFrame) -> DataFrame:
    numbered = running_total(rows.join(state, "uid"), "shard", [F.col("uid")], "shard-slots", "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "grp")


@tidy
def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, grp) for each row of docs, law `rows`.

    Rows of equal texts form a group and share a shard as far as the capacity allows; the
    shards' counts differ by one at most; slots run from 0 without gaps. A null text is
    empty (size 8) and grouped with the empty ones; null and repeated doc_ids are rows like
    any other. An empty table gives an empty result; columns beyond id and text are not read.
    """
    rows = _rows(docs)
    grouped = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = rows.join(cut(grouped.select("grp"), "shard-groups"), "grp").select("uid", F.xxhash64("grp").alias("hub"))
    return _slots(rows, refine(_placed(rows, shards), links, shards))


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """(uid, shard) of rows (uid, grp): counts one apart, rows of a group together where any shard holds them."""
    total = rows.count()
    quota = _quota(total, shards)
    room = list(quota)
    counts = cut(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-groups")
    bound = total // (4 * shards)
    large = {bytes(r["grp"]): r["n"] for r in counts.where(F.col("n") > bound).collect()}  # fewer than 4 * (shards + 1)
    links = rows.join(counts.where(F.col("n") <= bound), "grp").select("uid", F.xxhash64("grp").alias("hub"), "n")
    placed = rows.select("uid", F.lit(0).alias("shard")).where(F.lit(False))
    if large:
        placed = cut(_large(rows, large, room), "shard-large")
    settled, rest = propagate(links, room)
    if settled is not None:
        placed = placed.unionByName(settled)
    # What fits no shard whole is laid out group after group, so that few parts arise; single rows follow.
    hubs = rest.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    hubs = cut(running_total(hubs, "_all", [F.col("hub")], "shard-rest", "_first", F.col("n")).select("hub", "_first"), "shard-rest")
    inside = running_total(rest.select("uid", "hub"), "hub", [F.col("uid")], "shard-rest", "_in")
    laid = cut(inside.join(hubs, "hub").select("uid", (F.col("_first") + F.col("_in")).alias("_at")), "shard-rest")
    over = laid.count()
    single = rows.join(placed.select("uid").unionByName(laid.select("uid")), "uid", "left_anti").select("uid", F.lit(0).alias("_all"))
    numbered = running_total(single, "_all", [F.col("uid")], "shard-fill", "_at").select("uid", (F.col("_at") + over).alias("_at")).unionByName(laid)
    return placed.select("uid", "shard").unionByName(numbered.select("uid", _fill(room, F.col("_at")).alias("shard")))
