"""Documents as chunks of numbers into a chunk's own dictionary.

A corpus has far fewer different words per some million tokens than tokens.
So jobs that look something up for every token send each chunk's dictionary
through the shuffle, not the tokens, and send the answers back per chunk.

A chunk is numbered by its partition and its place in it. Several jobs make
the same chunks again from the same input, which must therefore be a table
that is read the same way each time (a scan), not one with random order.
"""

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

TOKENS = 2_000_000  # a chunk ends with the document that reaches this


@dataclass
class Chunk:
    number: int
    rows: pa.Table  # the columns besides the text
    lengths: np.ndarray  # tokens of each document
    ids: np.ndarray  # all tokens, as places in ``words``
    words: list  # the dictionary, in order of first occurrence


def chunks(batches: Iterator[pa.RecordBatch], tokens: Callable, limit: int = TOKENS) -> Iterator[Chunk]:
    """Group rows whose last column is a text. ``tokens`` gives the list of tokens of a text."""
    first = TaskContext.get().partitionId() << 32
    made = 0
    words: defaultdict = defaultdict()
    words.default_factory = words.__len__
    rows, lengths, ids, total = [], [], [], 0

    def finish() -> Chunk:
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return Chunk(first + made, pa.Table.from_batches(rows), np.array(lengths, np.int64), flat, list(words))

    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        others = batch.drop_columns([batch.schema.names[-1]])
        start = 0
        for i in range(batch.num_rows):
            own = [words[t] for t in tokens(texts[i].as_py())]
            ids.append(np.array(own, np.int32))
            lengths.append(len(own))
            total += len(own)
            if total >= limit:
                rows.append(others.slice(start, i + 1 - start))
                yield finish()
                made, start, total = made + 1, i + 1, 0
                words.clear()
                rows, lengths, ids = [], [], []
        if start < batch.num_rows:
            rows.append(others.slice(start))
    if lengths:
        yield finish()


def pack(values: np.ndarray) -> bytes:
    """Compressed little-endian numbers, byte planes apart, with their width in front."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return bytes([values.itemsize]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_by_chunk(
    answers: DataFrame, columns: dict[str, str], sums: tuple[str, ...] = (), rows: int = 1_000_000
) -> DataFrame:
    """Rows of (chunk, place, numbers...) as packed rows per chunk, some for each partition.

    ``columns`` names the number columns and their numpy kinds; the totals of
    the columns in ``sums`` are kept instead of their values.
    """
    names = ["place", *columns]
    kinds = ["<i4", *columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            chunk = table["chunk"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            arrays = [table[c].to_numpy().astype(k)[order] for c, k in zip(names, kinds, strict=True)]
            added = [table[c].to_numpy()[order] for c in sums]
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                packed = [pa.array([pack(x[a:b])], pa.binary()) for x in arrays]
                totals = [pa.array([int(x[a:b].sum())], pa.int64()) for x in added]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk[order[a]]], pa.int64()), *packed, *totals], ["chunk", *names, *sums]
                )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= rows:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    fields = ", ".join(["chunk long", *(f"{c} binary" for c in names), *(f"{c} long" for c in sums)])
    return answers.select("chunk", *names, *sums).mapInArrow(run, fields)


def unpack_places(table: pa.Table, columns: dict[str, str], n: int) -> list[np.ndarray]:
    """The number columns of a chunk's packed rows in order of place; all ``n`` places must be there."""
    places = np.concatenate([unpack(x, "<i4") for x in table["place"].to_pylist()])
    if len(places) != n or len(np.unique(places)) != n:
        raise ValueError("the chunks of two passes differ: the input must be read the same way each time")
    order = np.argsort(places)
    return [
        np.concatenate([unpack(x, kind) for x in table[c].to_pylist()])[order] for c, kind in columns.items()
    ]
