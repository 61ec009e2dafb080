"""Walks over a written graph of numbered nodes: each task reads it by itself, so that nothing it finds is moved.

The graph is a table of lists of ends (_from, _ends: their numbers' bytes) and one of names (_number, _name), both sorted by number within
each file, in small row groups. A task takes a group of starts. For each relation it reads those row groups that may
have a node of its frontier, and keeps their lists only. What lies at the last relation is worked out and handed on
start by start, never held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Ends of lists that a task holds at most; ends beyond come in further passes, dealt by their number.
HELD = 64_000_000
#: Ends that are looked at in one go, and pairs of start and end that are kept between relations.
AT_ONCE, KEPT = 2_000_000, 32_000_000
#: Rows of a batch that is handed on.
OUT_ROWS = 100_000


class Full(Exception):
    """More than a task may hold."""


class _Table:
    """Parquet files sorted by their first column, read by keys."""

    def __init__(self, files: list[str], key: str, value: str):
        import pyarrow.parquet as pq
        from pyarrow import fs as pfs

        self.key, self.value, self.groups = key, value, []
        for uri in files:
            fs, path = pfs.FileSystem.from_uri(uri)
            file = pq.ParquetFile(fs.open_input_file(path))
            meta, at = file.metadata, file.schema_arrow.names.index(key)
            for g in range(meta.num_row_groups):
                known = meta.row_group(g).column(at).statistics
                least, most = (known.min, known.max) if known is not None and known.has_min_max else (None, None)
                self.groups.append((least, most, file, g))

    def rows(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(key of each row, values) of the rows of the sorted keys."""
        for least, most, file, g in self.groups:
            part = keys if least is None else keys[np.searchsorted(keys, least) : np.searchsorted(keys, most, "right")]
            if not len(part):
                continue
            got = file.read_row_group(g, columns=[self.key, self.value], use_threads=False).combine_chunks()
            if not got.num_rows:
                continue
            have = got.column(self.key).chunk(0).to_numpy()
            at = np.searchsorted(part, have)
            hit = np.flatnonzero((at < len(part)) & (part[np.minimum(at, len(part) - 1)] == have))
            if len(hit):
                yield have[hit], got.column(self.value).chunk(0).take(pa.array(hit))


class _Lists:
    """The lists of ends of some nodes, those ends only whose number leaves `rest` when divided by `parts`; Full with more than `most`."""

    def __init__(self, table: _Table, nodes: np.ndarray, most: float, parts: int = 1, rest: int = 0):
        froms, sizes, ends, held = [], [], [], 0
        for have, lists in table.rows(nodes):
            bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            flat = np.frombuffer(lists.buffers()[2], have.dtype, (int(bounds[-1]) - int(bounds[0])) // have.itemsize, int(bounds[0]))
            n = np.diff(bounds) // have.itemsize
            if parts > 1:
                stay = flat % parts == rest
                n = np.add.reduceat(stay, np.cumsum(n) - n, dtype=np.int64)
                flat = flat[stay]
            held += len(flat)
            if held > most:
                raise Full
            froms.append(have), sizes.append(n), ends.append(flat)
        none = np.zeros(0, np.int64)
        self.froms, self.sizes, self.ends = (np.concatenate(x) if x else none for x in (froms, sizes, ends))
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        order = np.argsort(self.froms, kind="stable")
        self.froms, self.sizes, self.begins = self.froms[order], self.sizes[order].astype(np.int64), self.begins[order]
        self.before = np.concatenate([[0], np.cumsum(self.sizes)])

    def counts(self, nodes: np.ndarray) -> np.ndarray:
        return self.before[np.searchsorted(self.froms, nodes, "right")] - self.before[np.searchsorted(self.froms, nodes)]

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, end) of all ends of the nodes."""
        first, last = np.searchsorted(self.froms, nodes), np.searchsorted(self.froms, nodes, "right")
        which, lists = _spread(first, last - first)
        at, ends = _spread(self.begins[lists], self.sizes[lists])
        return which[at], self.ends[ends]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of the numbers from each begin on, so many as its size says."""
    place = np.repeat(np.arange(len(sizes)), sizes)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[place]


def _unique(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _pieces(counts: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans between bounds, each of about AT_ONCE by its counts, more only where two bounds have more between them."""
    total, b = np.concatenate([[0], np.cumsum(counts)])[bounds], 0
    while b < len(bounds) - 1:
        e = max(b + 1, int(np.searchsorted(total, total[b] + AT_ONCE, "right")) - 1)
        yield int(bounds[b]), int(bounds[e])
        b = e


def _onward(lists: _Lists, marks: np.ndarray, nodes: np.ndarray, n_nodes: int) -> Iterator[tuple[int, np.ndarray]]:
    """(mark, keys): mark * n_nodes + end of the ends of all nodes up to that mark (sorted) and after the one before, distinct and sorted."""
    if not len(marks):
        return
    counts = lists.counts(nodes)
    for b, e in _pieces(counts, np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1, [len(marks)]])):
        keys = []
        for i, k in _pieces(counts[b:e], np.arange(e - b + 1)):
            which, ends = lists.of(nodes[b + i : b + k])
            keys.append(_unique(marks[b + i : b + k][which] * n_nodes + ends))
        yield int(marks[e - 1]), keys[0] if len(keys) == 1 else _unique(np.concatenate(keys))


def walk(files: list[str], named: list[str], n_nodes: int, most: int) -> Callable:
    """The mapInArrow function from groups of starts (_numbers, _names) to (_at, _end) of what lies within 1 to `most` relations."""

    def near(lists: _Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start * n_nodes + node) of all within most - 1 relations and of those that are as far as that, both sorted."""
        alone = len(starts) == 1  # can't be split any further, and is held whole
        own = np.arange(len(starts), dtype=np.int64) * n_nodes + starts
        found = frontier = own
        for _ in range(most - 1):
            held = _Lists(lists, _unique(frontier % n_nodes), np.inf if alone else HELD)
            new, size = [], len(found)
            for _, keys in _onward(held, frontier // n_nodes, frontier % n_nodes, n_nodes):
                at = np.searchsorted(found, keys)
                new.append(keys[(at == len(found)) | (found[np.minimum(at, len(found) - 1)] != keys)])
                size += len(new[-1])
                if size > KEPT and not alone:
                    raise Full
            frontier = np.concatenate(new) if new else own[:0]
            found = np.concatenate([found, frontier])
            found.sort()
        return found, frontier

    def pairs(lists: _Table, table: _Table, starts: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        try:
            found, frontier = near(lists, starts)
        except Full:
            half = len(starts) // 2
            yield from pairs(lists, table, starts[:half], names[:half])
            yield from pairs(lists, table, starts[half:], names[half:])
            return
        reached, todo = _unique(frontier % n_nodes), [(1, 0)]
        while todo:
            parts, rest = todo.pop()
            try:
                held = _Lists(lists, reached, HELD if parts < n_nodes else np.inf, parts, rest)
            except Full:
                todo += [(2 * parts, rest + parts), (2 * parts, rest)]
                continue
            yield from last(table, held, found[found % n_nodes % parts == rest], frontier, starts, names)

    def last(table: _Table, held: _Lists, found: np.ndarray, frontier: np.ndarray, starts: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """Pairs of what was found before and of what the frontier's lists have."""
        wanted = _unique(np.concatenate([_unique(held.ends.copy()), _unique(found % n_nodes)]))
        numbers, words, kind = [], [], None
        for have, some in table.rows(wanted):
            kind = some.type
            numbers.append(have), words.append(some.cast(pa.large_string()) if pa.types.is_string(some.type) else some)
        if not words:
            return
        numbers, words = np.concatenate(numbers), pa.concat_arrays(words)
        place = np.argsort(numbers)
        numbers = numbers[place]
        done = 0

        def out(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            who, ends = keys // n_nodes, keys % n_nodes
            other = ends != starts[who]
            who, ends = who[other], place[np.searchsorted(numbers, ends[other])]
            for i in range(0, len(who), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(who[i : i + OUT_ROWS])), words.take(pa.array(ends[i : i + OUT_ROWS])).cast(kind)], names=["_at", "_end"])

        for mark, keys in _onward(held, frontier // n_nodes, frontier % n_nodes, n_nodes):
            # With what the same starts, and those between that go no further, have found before.
            upto = int(np.searchsorted(found, (mark + 1) * n_nodes))
            yield from out(_unique(np.concatenate([keys, found[done:upto]])))
            done = upto
        yield from out(found[done:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = table = None
        for batch in batches:
            for i in range(batch.num_rows):
                if lists is None:
                    lists, table = _Table(files, "_from", "_ends"), _Table(named, "_number", "_name")
                starts = batch.column("_numbers")[i].values.to_numpy().astype(np.int64)
                yield from pairs(lists, table, starts, batch.column("_names")[i].values)

    return run
