"""Filling fixed-capacity containers: bounded-space best-fit packing inside each partition, then one merge of what stayed open."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .bpe import count_column, default_vocabulary

CAPACITY, OPEN_WINDOWS = 2_048, 128

#: Leftover items merged by one task. A leftover is an item of a window that was open when its partition ended.
LEFTOVERS_PER_TASK = 200_000


class OpenWindows:
    """At most `most` open containers. An item goes where it leaves the least space; if it fits nowhere, the fullest is closed."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.next = capacity, most, 0
        self.free: list[tuple[int, int]] = []  # (free space, window), ascending

    def place(self, size: int) -> tuple[int, int | None]:
        """The item's window, and the window closed for it or by it."""
        k = bisect_left(self.free, (size, -1))
        closed = None
        if k < len(self.free):
            space, window = self.free.pop(k)
        else:
            if len(self.free) >= self.most:
                closed = self.free.pop(0)[1]
            space, window = self.capacity, self.next
            self.next += 1
        if space > size:
            insort(self.free, (space - size, window))
        else:
            closed = window if closed is None else closed
        return window, closed


_SCHEMA = "part_no int, token_start bigint, token_end bigint, container_id bigint, leftover boolean"


def _parts(size: int, capacity: int) -> list[tuple[int, int, int]]:
    """(part_no, start, end): one part, or for an item above the capacity full ones and the rest."""
    return [(i, at, min(size, at + capacity)) for i, at in enumerate(range(0, size, capacity))]


def pack(sized: DataFrame, *, id_col: str, size_col: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """id_col, part_no, token_start, token_end, container_id: every item in one container, none over the capacity.

    Only an item larger than `capacity` is split, into full containers and one rest. Null and zero sizes take no space and get the
    container NULL; negative sizes raise. Repeated ids are items of their own. Each partition is packed as it streams by, with
    `open_windows` windows; those still open at its end are taken apart and packed again, largest items first, in bounded tasks.
    """
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be positive")
    ship(sized.sparkSession)
    kind = sized.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {_SCHEMA}"
    items = sized.select(F.col(id_col), F.col(size_col).cast("long").alias("_size"))
    first = cut(items.mapInArrow(_streamed(id_col, capacity, open_windows), schema))
    return _merge(first, id_col, kind, capacity)


def _streamed(id_col: str, capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        windows, held = OpenWindows(capacity, most), {}
        out: list[tuple] = []
        schema = None
        for batch in batches:
            schema = schema or _arrow(batch.schema, id_col)
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not size:
                    out.append((key, 0, 0, 0, None, False))
                    continue
                if size < 0:
                    raise ValueError(f"negative size {size}")
                for part in _parts(size, capacity):
                    window, closed = windows.place(part[2] - part[1])
                    held.setdefault(window, []).append((key, *part, base + window))
                    if closed is not None:
                        out += [(*x, False) for x in held.pop(closed)]
            if out:
                yield _batch(out, schema)
                out = []
        out += [(*x, True) for xs in held.values() for x in xs]
        if out:
            yield _batch(out, schema)

    return run


def _merge(first: DataFrame, id_col: str, kind: str, capacity: int) -> DataFrame:
    """Packs the leftovers again; everything else is final."""
    columns = [id_col, "part_no", "token_start", "token_end", "container_id"]
    left = first.where("leftover")
    n = left.count()
    parts = -(-n // LEFTOVERS_PER_TASK)
    done = first.where("not leftover").select(columns)
    if not n:
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62) + (TaskContext.get().partitionId() << 36)
        windows = OpenWindows(capacity, 1 << 62)
        out, schema = [], None
        for batch in batches:
            schema = schema or _arrow(batch.schema, id_col)
            out += [(k, p, s, e, base + windows.place(e - s)[0], True) for k, p, s, e in zip(*(batch.column(i).to_pylist() for i in range(4)))]
        if out:
            yield _batch(out, schema)

    spread = left.repartition(parts, F.xxhash64("container_id")).sortWithinPartitions(F.desc(F.col("token_end") - F.col("token_start")), "container_id", id_col, "part_no")
    return done.unionByName(spread.mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}").select(columns))


def _arrow(schema: pa.Schema, id_col: str) -> pa.Schema:
    return pa.schema([(id_col, schema.field(0).type), ("part_no", pa.int32()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("container_id", pa.int64()), ("leftover", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def token_sizes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rows_at_once: int = 500) -> DataFrame:
    """(id_col, n_tokens) by a public tokenizer, counted where the rows are read; null and empty texts have 0."""
    ship(documents.sparkSession)
    where = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(i, rows_at_once)
                yield pa.RecordBatch.from_arrays([part.column(0), count_column(part.column(1), where)], [id_col, "n_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def pack_documents(documents: DataFrame, *, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, path: str | None = None) -> DataFrame:
    """Documents by doc_id in containers of `capacity` tokens of byte_bpe_50k; see `pack`."""
    return pack(token_sizes(documents, path=path), id_col="doc_id", size_col="n_tokens", capacity=capacity, open_windows=open_windows)
