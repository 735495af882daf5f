"""Best-fit-decreasing packing of token ids into rows of fixed length.

Documents are encoded, closed with an end id, and cut into segments of at most
one row; a cut loses nothing, as segments carry their document and place.  The
segments of a group (about ``group_tokens`` ids, so memory is bounded whatever
the partition holds) are sorted by falling length, and each goes to the row
with the least room that is enough.  That room is found in a segment tree over
capacities, whose nodes tell whether any open row has such room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corvex.llm.wordhash import lean

from corvex.llm import pieces

ROW_TOKENS = 2048
#: Ids packed together at a time.
GROUP_TOKENS = 4 << 20
END_ID, PAD_ID = 2, 0


class Rooms:
    """Open rows by the room left in them; the least room of at least n in O(log row length)."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest open row; the row is taken out."""
        at, count = need + self.leaves, self.count
        if not count[at]:
            # Up to the first ancestor with rows on its right, then down to their leftmost.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit(lengths: np.ndarray, row_tokens: int) -> tuple[np.ndarray, int]:
    """(row of each segment, rows) by best fit of falling lengths; equal lengths keep their order."""
    rooms, out, rows = Rooms(row_tokens), np.zeros(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = rooms.take(need)
        room, row = found or (row_tokens, rows)
        rows += found is None
        out[i] = row
        if room > need:
            rooms.put(room - need, row)
    return out, rows


def segments(sizes: np.ndarray, row_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first id in the document, length) of each segment."""
    parts = -(-sizes // row_tokens)
    doc = np.repeat(np.arange(len(sizes)), parts)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc, place * row_tokens, np.minimum(row_tokens, sizes[doc] - place * row_tokens)


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID, pad_id: int = PAD_ID, model: str = pieces.DEFAULT_MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Packed rows.

    pack_id (partition, then row in it), n_tokens, input_ids (row_tokens
    little-endian int32, padded with pad_id), cu_seqlens (cumulative segment
    lengths from 0), position_ids (little-endian int32; 0 at each segment's
    start), and for each segment doc_ids and doc_offsets (its first id's place
    in the document).

    A null or empty text gives one segment of the end id alone, so that every
    row of docs is in the result; rows that repeat are packed one by one; an
    empty table gives no rows; other columns are dropped first.  Which segments
    share a row depends on how the input is partitioned.
    """
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    key_type = rows.schema["_key"].dataType.simpleString()
    if row_tokens < 1:
        raise ValueError("row_tokens must be positive")

    def flush(keys: list, ids: list[np.ndarray], first: int) -> tuple[list[pa.RecordBatch], int]:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids)
        begin = np.cumsum(sizes) - sizes
        doc, offset, length = segments(sizes, row_tokens)
        where, n = best_fit(length, row_tokens)
        order = np.lexsort((np.arange(len(where)), -length, where))
        where, doc, offset, length = where[order], doc[order], offset[order], length[order]
        before = np.cumsum(length) - length
        bound = np.searchsorted(where, np.arange(n + 1))
        base = before[bound[:-1]]
        place = before - base[where]
        # Where each id comes from and where it goes, for all segments at once.
        step = np.arange(length.sum()) - np.repeat(before, length)
        to = np.repeat(where * row_tokens + place, length) + step
        matrix, position = np.full(n * row_tokens, pad_id, dtype="<i4"), np.zeros(n * row_tokens, dtype="<i4")
        matrix[to] = flat[np.repeat(begin[doc] + offset, length) + step]
        position[to] = step
        fill = np.bincount(where, length, n).astype(np.int64)
        counts = np.diff(bound)
        cu_at = np.concatenate([[0], np.cumsum(counts + 1)])
        cu = np.zeros(cu_at[-1], dtype=np.int32)
        cu[np.arange(len(where)) + where + 1] = place + length
        keys = pa.array(keys).take(pa.array(doc)) if key_type != "bigint" else pa.array(keys, pa.int64()).take(pa.array(doc))
        out, wide = [], 4 * row_tokens
        offsets = lambda low, high: pa.array((np.arange(high - low + 1) * wide).astype(np.int32))
        matrix, position = matrix.tobytes(), position.tobytes()
        step = max(1, (8 << 20) // wide)
        for low in range(0, n, step):
            high = min(n, low + step)
            binary = lambda raw, low=low, high=high: pa.Array.from_buffers(pa.binary(), high - low, [None, offsets(low, high).buffers()[1], pa.py_buffer(raw[low * wide : high * wide])])
            listed = lambda values, at, low=low, high=high: pa.ListArray.from_arrays(pa.array((at[low : high + 1] - at[low]).astype(np.int32)), values[int(at[low]) : int(at[high])])
            columns = [pa.array(first + np.arange(low, high)), pa.array(fill[low:high]), binary(matrix), listed(pa.array(cu), cu_at), binary(position), listed(keys, bound), listed(pa.array(offset), bound)]
            out.append(pa.RecordBatch.from_arrays(columns, ["pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "doc_offsets"]))
        return out, first + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = pieces.coder(model), TaskContext.get().partitionId() << 33
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in pieces.slices(texts):
                flat, at = code.encode(texts[low:high])
                keys += own[low:high]
                ids += [np.append(flat[a:b], end_id).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
                held += len(flat) + high - low
                if held >= group_tokens:
                    out, first = flush(keys, ids, first)
                    yield from out
                    keys, ids, held = [], [], 0
        if keys:
            yield from flush(keys, ids, first)[0]

    schema = f"pack_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{key_type}>, doc_offsets array<long>"
    return rows.mapInArrow(lean(run, keeps=True), schema)


def write(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet files; input_ids and position_ids are raw matrix rows."""
    packed.write.mode("overwrite").parquet(path)
