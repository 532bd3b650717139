"""What the operators share: reading tables, staging in the shared folder, Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaweave.functions.lineage import staged

__all__ = ["fold", "map_arrow", "map_batches", "most_frequent", "read", "staged", "training_fold"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; NULL ids fall into fold 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(4))


def training_fold(held: int, doc_id: str = "doc_id"):
    """Whether a row may be learnt from: its fold is not the held-out one."""
    return fold(doc_id) != held


def map_batches(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, flush: Callable[[], dict[str, list]] | None = None) -> DataFrame:
    """Apply ``rows`` (columns in, columns out, as lists) to every Arrow batch of ``df``.

    ``flush`` adds rows at the end of a partition. Batches hold a bounded number of bytes of text,
    so that very long texts do not meet in one call.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def emit(columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if len(next(iter(made.values()))):
                    yield emit(made)
        if flush is not None:
            made = flush()
            if len(next(iter(made.values()))):
                yield emit(made)

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], list[pa.RecordBatch]], schema: str, flush: Callable[[], Iterable[pa.RecordBatch]] | None = None) -> DataFrame:
    """``map_batches`` for work on whole columns: ``rows`` and ``flush`` give Arrow batches, whose columns are cast to ``schema``."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                for made in rows(part):
                    yield made.cast(out)
        for made in flush() if flush is not None else ():
            yield made.cast(out)
        pa.default_memory_pool().release_unused()  # the process goes on to other partitions

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most_bytes`` bytes (one row at least)."""
    n = batch.num_rows
    each = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, n, each):
        yield batch.slice(at, each)


def most_frequent(counted: DataFrame, word: str, n: str, most: int) -> DataFrame:
    """The ``most`` rows of largest ``n``, ties by ``word``; ``counted`` is a written table.

    The count at the cut comes from a histogram of counts, so that only rows from it upward are
    sorted: partitions do not each send their own candidates.
    """
    left = most
    least = 1
    for r in counted.groupBy(n).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc(n)).limit(most).collect():
        least, left = r[n], left - r["words"]
        if left <= 0:
            break
    return counted.where(F.col(n) >= least).orderBy(F.desc(n), word).limit(most)
