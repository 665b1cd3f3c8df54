"""A shuffle of packed arrays: mappers make (bucket, blob) rows, reducers get all blobs of a bucket.

Blobs cost the JVM a row each instead of a row a hash, and mappers combine before they ship, so that a hash of a third of all
rows is one row a mapper. A bucket holds about BUCKET_BYTES of input text, until there are MOST_BUCKETS of them (1 TiB of text);
beyond that it grows with the input (about 1.5 GB of text at 100 TB, whose hashes its reducer holds packed), since a shuffle of more partitions costs Spark more
than it saves. Results do not depend on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shuffle_partitions
from ._tokens import give_back

BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 16
SHIPPED = "bucket int, blob binary"


def bucket_count(texts: DataFrame, column: str = "text") -> int:
    """Grows with the text; never fewer than the shuffle partitions."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return min(MOST_BUCKETS, max(shuffle_partitions(texts.sparkSession), -(-size // BUCKET_BYTES)))


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def exchange(shipped: DataFrame, buckets: int, reduce: Callable[[int, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """reduce(bucket, blobs) for each bucket, a task each; it holds the bucket's packed blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(bucket, []).append(blob.as_py())
        for bucket in list(held):
            yield from reduce(bucket, held.pop(bucket))
        give_back()

    return shipped.repartitionById(buckets, "bucket").mapInArrow(run, schema)


def by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.Table]]:
    """All rows of each key of a partition that is sorted by an integer key."""
    held, now = [], None
    for b in batches:
        key = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else []
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            if now is not None and key[a] != now:
                yield int(now), pa.Table.from_batches(held)
                held = []
            now = key[a]
            held.append(b.slice(a, e - a))
    if held:
        yield int(now), pa.Table.from_batches(held)
