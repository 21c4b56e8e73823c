"""Helpers that the corpus operators share: table access, lineage cuts and code shipping."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words when sizes are counted: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on its way to Python (long texts make batches of few rows), and of row groups of cut() tables.
BATCH_KEY, BATCH_BYTES, ROW_GROUP = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all executors see.

    On a single machine (master local, as in tests) a temporary folder is set once where the session names none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        kept = getattr(spark, "_helixframe_dir", None)
        if kept is None:
            kept = spark._helixframe_dir = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        found = kept
    return f"{found.rstrip('/')}/helixframe"


#: Tables that cut() wrote in each open scratch(), innermost last.
_scratches: list[list[DataFrame]] = []


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs a re-read, not a re-run.

    A surrounding scratch() deletes it at its end, unless it is to be kept: then the next outer one does.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._helixframe_path = path
    for owner in (_scratches[:-1] if keep else _scratches)[-1:]:
        owner.append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() has written, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._helixframe_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """What cut() writes inside is deleted at the end, but for kept tables."""
    own: list[DataFrame] = []
    _scratches.append(own)
    try:
        yield
    finally:
        _scratches.pop()
    release(*own)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, and bounds Arrow batches by bytes.

    Batches stay at Spark's default only where the context's configuration names a size.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if getattr(sc, "_helixframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="helixframe-code-")) / "helixframe_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._helixframe_shipped = True


def crc32_fold(column: str, folds: int) -> Column:
    """crc32 of a column's text modulo folds; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def best_disjoint(best: Callable[[int, int], tuple[float, int] | None], starts: Iterable[int], end: int, taken: Iterable[tuple[int, int]] = ()) -> list[tuple[float, int, int]]:
    """Disjoint windows (value, start, end) outside the taken ones, highest value first.

    best(start, limit) gives the value and end of the best window from start that ends at limit or before, or None.
    Each possible window is given or overlaps one that is taken or has at least its value.
    """
    held: list[tuple[int, int]] = []
    for start, stop in sorted(taken):
        if held and start <= held[-1][1]:
            held[-1] = (held[-1][0], max(stop, held[-1][1]))
        else:
            held.append((start, stop))

    def window(start: int) -> tuple[float, int, int] | None:
        at = bisect_right(held, (start, float("inf")))
        if at and held[at - 1][1] > start:
            return None
        found = best(start, held[at][0] if at < len(held) else end)
        return found and (-found[0], start, found[1])

    heap = [w for s in starts if (w := window(s))]
    heapify(heap)
    out = []
    while heap:
        value, start, stop = heappop(heap)
        at = bisect_right(held, (start, float("inf")))
        if at and held[at - 1][1] > start:
            continue
        if at < len(held) and held[at][0] < stop:
            if shorter := window(start):
                heappush(heap, shorter)
            continue
        insort(held, (start, stop))
        out.append((-value, start, stop))
    return out


def sql_quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
