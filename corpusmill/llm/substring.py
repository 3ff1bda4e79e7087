"""Repeated-passage removal: count-min prefilter, then exact grouping of the windows that may repeat.

Documents are packed once, without a shuffle, into chunks of bounded text. Each chunk is a
partition of the corpus with its own count-min sketch of its windows: ROWS rows of counters that saturate at two. The
sketch is cut by the leading bits of the hash into blocks of a fixed number of cells, so it grows in blocks, as the corpus does, and
each block is merged by a task of its own; only counters above zero are sent. The sum of the chunks' counters is
never less than the count of any window, so a window with a counter below two occurs once in the corpus. The second pass
sends only the other windows, as 128-bit hashes with the place of the chunk's first occurrence, and groups them
exactly; each chunk gets back one bit for each, whether it starts earlier elsewhere. A window that a third of all documents
share is one entry for each chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import give_back, joined, lean, materialize, pick, slices, span_hash, table, text_buffers, window_hash, window_starts, word_spans

WINDOW = 20
#: Text bytes in a chunk. At many TB take 128 MB and blocks of 2**24 windows, in executors with memory for it, so that a message still holds many windows.
CHUNK_BYTES = 4 << 20
#: Windows of a block of the sketch, at most on average.
BLOCK_WINDOWS = 1 << 20
#: Rows of the sketch, and cells in a row for each window of a full block, as a power of two: at most 1 in 20 single windows passes.
ROWS, SPARE_BITS = 2, 2


def pack_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs to a written table (chunk, words, rows), one row a chunk: rows is an Arrow stream of whole documents with all columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, filled, words = TaskContext.get().partitionId() << 32, 0, 0, 0
        sink = out = None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"chunk": [part | seq], "words": [words], "rows": [sink.getvalue().to_pybytes()]})

        for rows, data, off in slices(batches, limit=1 << 20):
            if filled and filled + len(data) > chunk_bytes:
                yield done()
                seq, filled, words, out = seq + 1, 0, 0, None
            if out is None:
                sink = pa.BufferOutputStream()
                out = pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(rows)
            filled += len(data)
            words += len(word_spans(data, off)[0])
        if out is not None:
            yield done()

    return materialize(docs.mapInArrow(lean(pack), "chunk bigint, words bigint, rows binary"), compression="none")


class Chunk:
    """The windows of a chunk's documents, taken in the order of doc_id."""

    def __init__(self, packed: bytes | pa.Buffer, width: int) -> None:
        rows = pa.ipc.open_stream(packed).read_all()
        ids = np.array(rows.column("doc_id").fill_null(np.iinfo(np.int64).min))
        # rows of one doc_id are ordered by text, so that the result doesn't depend on how they arrived
        self.rows = rows.take(pa.array(np.argsort(ids, kind="stable"))) if len(np.unique(ids)) == len(ids) else rows.append_column("ord__", pa.array(ids)).sort_by([("ord__", "ascending"), ("text", "ascending")]).drop_columns(["ord__"])
        self.ids = np.sort(ids)
        self.width = width
        self.data, self.off = text_buffers(self.rows.column("text"))
        self.s, self.e, self.firsts = word_spans(self.data, self.off)
        starts = window_starts(self.firsts, width).astype(np.int32 if len(self.s) < 1 << 31 else np.int64)
        h1, h2 = (window_hash(span_hash(self.data, self.s, self.e, k), width, k)[starts] for k in (0, 1))
        order = np.argsort(h1, kind="stable")
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        if np.any(~new[1:] & (b[1:] != b[:-1])):
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.starts = starts[order]  # of all windows, by hash and then by place
        self.new = new  # the first occurrence of each different window
        self.h1, self.h2 = a[new], b[new]
        self.first = self.starts[new]
        self.times = np.diff(np.append(np.flatnonzero(new), len(new)))  # of each different window in this chunk

    def blocks(self, bits: int, which: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(block, from, to) of the different windows, or of those that which indexes."""
        blocks = block_of(self.h1 if which is None else self.h1[which], bits)
        if len(blocks):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield int(blocks[lo]), lo, hi

    def cells(self, lo: int, hi: int, row: int, bits: int, cell_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """In one row of a block: the cells of some different windows, sorted, and which of them each window has."""
        h = self.h1[lo:hi] << np.uint64(bits) if row == 0 and bits else self.h1[lo:hi] if row == 0 else self.h2[lo:hi]
        cells, which = np.unique(h >> np.uint64(64 - cell_bits), return_inverse=True)
        return cells, which.reshape(-1)

    def sketch(self, lo: int, hi: int, row: int, bits: int, cell_bits: int) -> np.ndarray:
        """The counters above zero in one row of a block: twice the cell, and one more if the counter is two."""
        cells, which = self.cells(lo, hi, row, bits, cell_bits)
        counters = 2 * cells + (np.bincount(which, self.times[lo:hi]) > 1).astype(np.uint64)
        return np.concatenate([np.zeros(1, np.uint64), counters])  # differences start from 0

    def candidates(self, bits: int, cell_bits: int, replies: dict[int, np.ndarray]) -> np.ndarray:
        """Indexes of the different windows that the merged sketch counts more than once."""
        repeated = np.zeros(len(self.h1), bool)
        for k, lo, hi in self.blocks(bits):
            ok, at = np.ones(hi - lo, bool), 0
            for row in range(ROWS):
                cells, which = self.cells(lo, hi, row, bits, cell_bits)
                size = (len(cells) + 7) // 8
                ok &= np.unpackbits(replies[k][at : at + size], count=len(cells)).astype(bool)[which]
                at += size
            repeated[lo:hi] = ok
        return np.flatnonzero(repeated)


def block_of(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - bits) if bits else np.zeros(len(h1), np.uint64)).astype(np.int64)


def delta_encode(sorted_values: np.ndarray, dtype: str) -> bytes:
    """Differences in dtype; its largest value means: add it and go on."""
    most = np.uint64(np.iinfo(dtype).max)
    d = np.diff(sorted_values, prepend=sorted_values[:1])
    more = (d // most).astype(np.int64)
    out = np.full(int(more.sum()) + len(d), most, dtype)
    out[np.cumsum(more + 1) - 1] = d % most
    return out.tobytes()


def delta_decode(raw, base: int, dtype: str) -> np.ndarray:
    x = np.frombuffer(raw, dtype)
    return (np.cumsum(x, dtype=np.uint64) + np.uint64(base))[x != np.iinfo(dtype).max]


def planes(values: np.ndarray) -> bytes:
    """Byte by byte, so that constant bytes lie together and compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(raw, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def merge_sketches(group: pa.Table, dtype: str, cell_bits: int) -> pa.Table:
    """One block's sketches, added up, to a bit for each counter that a chunk sent: the sum is two or more."""
    bits = [b""] * group.num_rows
    for row in range(ROWS):
        total = np.zeros(1 << cell_bits, np.uint8)
        for raw in group.column(f"row{row}"):
            counters = delta_decode(raw.as_buffer(), 0, dtype)[1:]
            cells = counters >> np.uint64(1)
            total[cells] = np.minimum(total[cells] + 1 + (counters & np.uint64(1)).astype(np.uint8), 2)
        for i, raw in enumerate(group.column(f"row{row}")):
            bits[i] += np.packbits(total[delta_decode(raw.as_buffer(), 0, dtype)[1:] >> np.uint64(1)] > 1).tobytes()
    return pa.table({"chunk": group.column("chunk"), "kind": pa.array(np.ones(len(bits), np.int32)), "block": group.column("block"), "bits": pa.array(bits, pa.binary())})


def first_places(group: pa.Table) -> pa.Table:
    """One block's windows to a bit for each window of each chunk: it starts earlier in another chunk."""
    columns = {k: [unplanes(x.as_buffer(), t) for x in group.column(k)] for k, t in (("h1", "u8"), ("h2", "u8"), ("ids", "i8"), ("pos", "u4"))}
    sizes = [len(x) for x in columns["h1"]]
    h1, h2, ids, pos = (np.concatenate(columns[k]) for k in ("h1", "h2", "ids", "pos"))
    chunk = np.repeat(np.array(group.column("chunk")), sizes)
    order = np.lexsort((chunk, pos, ids, h2, h1))
    later = np.zeros(len(order), bool)
    a, b = h1[order], h2[order]
    later[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    at, bits = 0, []
    for n in sizes:
        bits.append(np.packbits(later[at : at + n]).tobytes())
        at += n
    return pa.table({"chunk": group.column("chunk"), "kind": pa.array(np.full(len(bits), 2, np.int32)), "block": group.column("block"), "bits": pa.array(bits, pa.binary())})


def _replies(messages: pa.Table, kind: int) -> dict[int, np.ndarray]:
    return {b.as_py(): np.frombuffer(x.as_buffer(), np.uint8) for k, b, x in zip(messages.column("kind"), messages.column("block"), messages.column("bits")) if k.as_py() == kind}


def _finish(chunk: Chunk, removed: np.ndarray, digest: bool, schema: pa.Schema) -> pa.Table:
    """removed: starts of the windows to remove."""
    cover = np.bincount(removed, minlength=len(chunk.s) + 1) - np.bincount(removed + chunk.width, minlength=len(chunk.s) + 1)[: len(chunk.s) + 1]
    keep = np.cumsum(cover)[: len(chunk.s)] == 0
    n_words = np.diff(chunk.firsts)
    kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[chunk.firsts])
    text, off, _, _ = joined(chunk.data, chunk.off, chunk.s, chunk.e, chunk.firsts, keep)
    raw, edges = memoryview(text.tobytes()), off.tolist()
    n_removed = n_words - kept
    if digest:
        sums = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table([chunk.rows.column("doc_id"), pa.array(n_words), pa.array(n_removed), pa.array(sums)], schema=schema)
    old = chunk.rows.column("text").to_pylist()
    new = [old[i] if not n_removed[i] else str(raw[edges[i] : edges[i + 1]], "utf-8") for i in range(len(old))]
    columns = [pa.array(new, pa.string()) if f == "text" else pa.array(n_words) if f == "n_words" else pa.array(n_removed) if f == "n_removed" else chunk.rows.column(f) for f in schema.names]
    return pa.table(columns, schema=schema)


def remove_repeated(docs: DataFrame, width: int = WINDOW, digest: bool = False, chunk_bytes: int = CHUNK_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Remove each word that a window covers which starts earlier elsewhere.

    Earlier means in a document of smaller doc_id or before in the same one. Windows are judged
    on the input. docs has doc_id and text; its other columns are kept, but n_words and
    n_removed are replaced. Texts without removals stay as they are; of the others the kept words
    are joined by one space. digest: return (doc_id, n_words, n_removed, kept_sha256) only.

    A null text stays null and has no words; a null doc_id comes before all others; rows that
    share a doc_id are ordered by text and then by chunk, and each gets a row. No rows give no rows.
    A document is in one chunk however long it is; a task needs some 20 bytes for each byte of a chunk's text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if digest:
        source = pick(docs, "doc_id", "text")
        out_type = T.StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    else:
        names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed") and (c in ("doc_id", "text") or c.lower() not in ("doc_id", "text"))]
        source = pick(docs, *names)
        out_type = T.StructType([*source.schema.fields, *T.StructType.fromDDL("n_words bigint, n_removed bigint").fields])
    arrow_type = to_arrow_schema(out_type)
    chunks = pack_chunks(source, chunk_bytes)
    stats = chunks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("chunks")).first()
    bits = max(0, math.ceil(math.log2(max(1, stats["words"]) / block_windows)))
    cell_bits = max(6, math.ceil(math.log2(block_windows)) + SPARE_BITS)
    gap = 2 ** (bits + cell_bits + 1) * max(1, stats["chunks"]) / max(1, stats["words"])
    dtype = "u2" if gap < 2**14 else "u4"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk = Chunk(packed.as_buffer(), width)
                found = [(key, k, *(delta_encode(chunk.sketch(lo, hi, r, bits, cell_bits), dtype) for r in range(ROWS))) for k, lo, hi in chunk.blocks(bits)]
                del chunk
                columns = list(zip(*found)) or [()] * (2 + ROWS)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["chunk", "block", *(f"row{r}" for r in range(ROWS))])

    def candidates(key: tuple[pa.Scalar, ...], group: pa.Table, messages: pa.Table) -> pa.Table:
        chunk = Chunk(group.column("rows")[0].as_buffer(), width)
        mine = chunk.candidates(bits, cell_bits, _replies(messages, 1))
        h1, h2, first = chunk.h1[mine], chunk.h2[mine], chunk.first[mine]
        doc = np.searchsorted(chunk.firsts, first, "right") - 1
        ids, pos = chunk.ids[doc], (first - chunk.firsts[doc]).astype("u4")
        found = list(chunk.blocks(bits, mine))
        give_back()
        columns = [pa.array([planes(x[lo:hi]) for _, lo, hi in found], pa.binary()) for x in (h1, h2, ids, pos)]
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), *columns], names=["chunk", "block", "h1", "h2", "ids", "pos"])

    def finish(key: tuple[pa.Scalar, ...], group: pa.Table, messages: pa.Table) -> pa.Table:
        chunk = Chunk(group.column("rows")[0].as_buffer(), width)
        mine = chunk.candidates(bits, cell_bits, _replies(messages, 1))
        replies, earlier = _replies(messages, 2), np.zeros(len(mine), bool)
        for k, lo, hi in chunk.blocks(bits, mine):
            earlier[lo:hi] = np.unpackbits(replies[k], count=hi - lo)
        removed = np.concatenate([chunk.starts[~chunk.new], chunk.first[mine[earlier]]])
        out = _finish(chunk, removed, digest, arrow_type)
        give_back()
        return out

    by_chunk = lambda df: df.groupBy("chunk")
    payload = chunks.select("chunk", "rows")
    reply = "chunk bigint, kind int, block bigint, bits binary"
    sketches = payload.mapInArrow(lean(sketch), "chunk bigint, block bigint, " + ", ".join(f"row{r} binary" for r in range(ROWS)))
    shared = materialize(sketches.groupBy("block").applyInArrow(lambda g: merge_sketches(g, dtype, cell_bits), reply))
    windows = by_chunk(payload).cogroup(by_chunk(shared)).applyInArrow(candidates, "chunk bigint, block bigint, h1 binary, h2 binary, ids binary, pos binary")
    places = materialize(windows.groupBy("block").applyInArrow(first_places, reply))
    return by_chunk(payload).cogroup(by_chunk(shared.unionByName(places))).applyInArrow(finish, out_type)


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words or more that occur earlier."""
    return remove_repeated(table(spark, sf_dir, "documents"), digest=True)
