"""Token-ID output: documents tokenised and packed into rows of a fixed number of ids.

Texts are tokenised and packed in blocks of a bounded number of tokens, where they are
read: nothing is shuffled and a lost task is simply run again. Within a block, documents
longer than a row are split without loss, and the pieces go, longest first, each into the
fullest row that still has room (best fit decreasing); a segment tree over capacities
finds that row.

Texts are cut at single spaces into chunks that are views of the Arrow buffer, chunks are
dictionary-encoded, and each distinct one is tokenised once, all of a slice in one call;
ids are then gathered with numpy, so that no text is ever laid out as Python words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwatch.llm.common import slices

TOKENIZERS = "/opt/tokenizers"
SEQ_LEN, BLOCK_TOKENS = 2048, 4_000_000
#: Ids of documents end with this one, which the rank file leaves free; it pads rows as well.
END = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk may begin at a space unless one of these bytes follows: white space, or the first byte of some beyond ASCII.
_NO_CUT = np.isin(np.arange(256), [*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3])
#: Bytes of text tokenised at a time: the more, the fewer distinct chunks in all.
_SLICE_BYTES = 6_000_000


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Flags of places where UTF-8 bytes can be cut so that the parts are tokenised alike alone and in place.

    A space before anything but white space begins a token of its own, whatever precedes it.
    """
    flags = np.zeros(len(data), bool)
    np.equal(data[:-1], 32, out=flags[:-1])
    flags[:-1] &= ~_NO_CUT[data[1:]]
    return flags


class Tokenizer:
    """Byte-level BPE from a rank file."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> None:
        import tiktoken

        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("packed ids have 16 bits; this vocabulary has more")
        self.encoding = tiktoken.Encoding("rank-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int32)
        self.bytes_of[list(ranks.values())] = [len(r) for r in ranks]

    def whole(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, where each chunk's ids begin and how many they are).

        Chunks that begin with a space are tokenised in one go, as a cut before them never
        matters; the others, the first of a text, one by one.
        """
        bounds, raw = np.frombuffer(chunks.buffers()[1], np.int32)[: len(chunks) + 1], chunks.buffers()[2].to_pybytes()
        spaced = np.frombuffer(raw, np.uint8)[bounds[:-1]] == 32
        first = pa.array(~spaced)
        together = chunks.filter(pc.invert(first))
        joined = together.buffers()[2].to_pybytes()[: np.frombuffer(together.buffers()[1], np.int32)[len(together)]].decode() if len(together) else ""
        ids = self.encoding.encode_to_numpy(joined).astype(np.uint16)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.diff(bounds)[spaced])) + 1
        alone = [self.encoding.encode_ordinary(c.decode()) for c in chunks.filter(first).to_pylist()]
        many = np.empty(len(chunks), np.int64)
        many[spaced] = np.diff(np.r_[0, ends])
        many[~spaced] = [len(x) for x in alone]
        place = np.empty(len(chunks), np.int64)
        place[spaced] = np.r_[0, ends][:-1]
        place[~spaced] = len(ids) + np.cumsum([0, *map(len, alone)])[:-1]
        return np.concatenate([ids, *(np.array(x, np.uint16) for x in alone)]), np.stack([place, many])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with END last; where each text's ids end).

        Null counts as empty; bytes that are not UTF-8 count as U+FFFD.
        """
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        _, offsets, raw = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        begin, end = int(bounds[0]), int(bounds[-1])
        if begin == end:
            return np.full(len(texts), END, np.uint16), np.arange(1, len(texts) + 1)
        flags = chunk_starts(np.frombuffer(raw, np.uint8)[begin:end])
        flags[bounds[:-1][np.diff(bounds) > 0] - begin] = True
        starts = (np.flatnonzero(flags) + begin).astype(np.int32)
        flat = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, np.int32(end)]), raw]).dictionary_encode()
        try:
            ids, (at, n) = self._ids(flat.dictionary)
        except UnicodeDecodeError:
            return self(pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()]))
        codes = flat.indices.to_numpy(zero_copy_only=False)
        n = n[codes].astype(np.int32)
        upto = np.cumsum(n, dtype=np.int32)
        where = np.repeat(at[codes].astype(np.int32) - (upto - n), n)
        where += np.arange(len(where), dtype=np.int32)
        last = np.r_[0, upto][np.searchsorted(starts, bounds[1:])].astype(np.int64)
        return np.insert(ids[where], last, END), last + np.arange(1, len(texts) + 1)


class Capacities:
    """Open rows by room left: a segment tree over 0..most finds the least room of at least n."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the open row with the least room >= least, taken out."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                if not count[i]:
                    i += 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of pieces for each row; no row exceeds the capacity, each piece is in one row."""
    rooms, rows = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            found = (capacity, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


SCHEMA = "pack_id long, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, resets array<int>, n_tokens int, ids binary"
_ARROW = pa.schema([
    ("pack_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
    ("resets", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("ids", pa.binary()),
])
#: Rows of a batch handed on.
_BATCH_ROWS = 256


def _packed(doc_ids: pa.Array, tokens: np.ndarray, ends: np.ndarray, seq_len: int, first: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block; pack_id counts from `first`."""
    sizes = np.diff(np.r_[0, ends])
    times = -(-sizes // seq_len)
    doc = np.repeat(np.arange(len(sizes)), times)
    offset = (np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)) * seq_len
    length = np.minimum(seq_len, sizes[doc] - offset)
    source = (ends - sizes)[doc] + offset
    packed = best_fit_decreasing(length.tolist(), seq_len)
    for at in range(0, len(packed), _BATCH_ROWS):
        some = packed[at : at + _BATCH_ROWS]
        members = np.array([len(m) for m in some])
        piece = np.concatenate([np.array(m) for m in some])
        n, row = length[piece], np.repeat(np.arange(len(some)), members)
        upto = np.cumsum(n)
        row_ends = upto[np.cumsum(members) - 1]
        inside = (upto - n) - np.r_[0, row_ends[:-1]][row]  # where in its row a piece begins
        steps = np.arange(upto[-1]) - np.repeat(upto - n, n)
        matrix = np.full(len(some) * seq_len, END, "<u2")
        matrix[np.repeat(row * seq_len + inside, n) + steps] = tokens[np.repeat(source[piece], n) + steps]
        by_piece = np.r_[0, np.cumsum(members)].astype(np.int32)
        cu = np.insert(inside + n, by_piece[:-1], 0).astype(np.int32)
        by_cu = (by_piece + np.arange(len(some) + 1)).astype(np.int32)
        spread = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values) if isinstance(values, np.ndarray) else values)
        yield pa.RecordBatch.from_arrays([
            pa.array(first + at + np.arange(len(some))),
            spread(by_piece, doc_ids.take(pa.array(doc[piece]))),
            spread(by_piece, offset[piece]),
            spread(by_cu, cu),
            spread(by_piece, inside.astype(np.int32)),
            pa.array(np.diff(np.r_[0, row_ends]).astype(np.int32)),
            pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * 2 * seq_len).astype(np.int32)), pa.py_buffer(matrix)]),
        ], schema=_ARROW)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken", block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (SCHEMA) for each packed row of seq_len ids, little-endian 16-bit, padded with END.

    cu_seqlens are the ends of the row's pieces, 0 first; positions restart at `resets`
    (see positions()); doc_offsets say where in its document a piece begins, so that every
    document can be put together again. Each document ends with END; a null or empty text is
    that one id. Null and repeated ids are packed like any other; texts of any length are
    split, none is cut off; an empty table gives no rows; other columns aren't read. pack_id
    numbers the rows of a partition of the input, whose number is in its upper 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, first = Tokenizer(folder, name), TaskContext.get().partitionId() << 32
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            starts = np.cumsum([0, *(len(t) for _, t, _ in waiting)])
            ends = np.concatenate([e + s for (_, _, e), s in zip(waiting, starts)])
            yield from _packed(pa.concat_arrays([i for i, _, _ in waiting]), np.concatenate([t for _, t, _ in waiting]), ends, seq_len, first)

        for part in slices(batches, most=_SLICE_BYTES):
            tokens, ends = encode(part.column("text"))
            waiting.append((part.column("doc_id"), tokens, ends))
            held += len(tokens)
            if held >= block_tokens:
                for out in rows():
                    first += out.num_rows
                    yield out
                waiting, held = [], 0
        if waiting:
            yield from rows()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def positions(packed: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Adds position_ids, seq_len of them a row: they count from 0 within each piece and within the padding."""
    ends = F.concat(F.slice("cu_seqlens", 2, F.size("cu_seqlens")), F.array(F.lit(seq_len)))
    lengths = F.zip_with("cu_seqlens", ends, lambda s, e: e - s)
    counted = F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n - 1))
    return packed.withColumn("position_ids", F.flatten(counted))


_FILES = ("ids", "cu", "resets", "index")


def write(packed: DataFrame, path: str) -> DataFrame:
    """Writes rows of pack() as binary files below `path`, a set for each partition; returns (name, rows).

    <name>.ids: the id matrix, row after row; <name>.cu: cumulative lengths and <name>.resets:
    position resets, 32-bit integers, all rows' behind one another; <name>.index: an Arrow
    stream of pack_id, n_tokens and the pieces' doc_ids and doc_offsets, whose number is a
    row's number of resets, and of its cumulative lengths less one. Names are new for each
    attempt, and only those listed count: the list is kept as a table in `path`/_files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as pfs

        fs, root = pfs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name, rows, index = f"part-{uuid.uuid4().hex}", 0, pa.schema([f for f in _ARROW if f.name in ("pack_id", "n_tokens", "doc_ids", "doc_offsets")])
        out = {f: fs.open_output_stream(f"{root}/{name}.{f}") for f in _FILES}
        with out["ids"], out["cu"], out["resets"], out["index"], pa.ipc.new_stream(out["index"], index) as listed:
            for batch in batches:
                ids = batch.column("ids")
                bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
                out["ids"].write(ids.buffers()[2][int(bounds[0]) : int(bounds[-1])])
                out["cu"].write(batch.column("cu_seqlens").flatten().to_numpy().astype("<i4").tobytes())
                out["resets"].write(batch.column("resets").flatten().to_numpy().astype("<i4").tobytes())
                listed.write_batch(pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in index], schema=index))
                rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows]}, schema=pa.schema([("name", pa.string()), ("rows", pa.int64())]))

    packed.select([f.name for f in _ARROW]).mapInArrow(run, "name string, rows long").write.parquet(f"{path}/_files")
    return packed.sparkSession.read.schema("name string, rows long").parquet(f"{path}/_files")


def read(spark: SparkSession, path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """The rows (SCHEMA) that write() has put below `path`, from its files; a few rows at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        fs, root = pfs.FileSystem.from_uri(path)
        for name in (n for batch in batches for n in batch.column("name").to_pylist()):
            files = {f: fs.open_input_stream(f"{root}/{name}.{f}") for f in _FILES}
            with files["ids"], files["cu"], files["resets"], files["index"]:
                for batch in pa.ipc.open_stream(files["index"]):
                    n, spans = batch.num_rows, batch.column("doc_ids")
                    pieces = spans.value_lengths().to_numpy()
                    by_piece = np.r_[0, np.cumsum(pieces)].astype(np.int32)
                    by_cu = (by_piece + np.arange(n + 1)).astype(np.int32)
                    cu = np.frombuffer(files["cu"].read(4 * int(by_cu[-1])), "<i4")
                    resets = np.frombuffer(files["resets"].read(4 * int(by_piece[-1])), "<i4")
                    bounds = (np.arange(n + 1) * 2 * seq_len).astype(np.int32)
                    ids = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(files["ids"].read(2 * seq_len * n))])
                    yield pa.RecordBatch.from_arrays([
                        batch.column("pack_id"), spans, batch.column("doc_offsets"), pa.ListArray.from_arrays(pa.array(by_cu), pa.array(cu)),
                        pa.ListArray.from_arrays(pa.array(by_piece), pa.array(resets)), batch.column("n_tokens"), ids,
                    ], schema=_ARROW)

    names = spark.read.schema("name string, rows long").parquet(f"{path}/_files").select("name")
    return names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, SCHEMA)


def written(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """docs packed, written below `path` and read from there."""
    write(pack(docs, seq_len, folder, name), path)
    return read(docs.sparkSession, path, seq_len)
