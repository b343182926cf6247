"""What the operators share: staged tables, Arrow text access and file cleaning."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one only where that is unset and all runs in one process, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="llm-stage-"))
    return _OWN_DIR[0]


class Staged:
    """A table written once to the shared folder, so that what follows reads it instead of computing it again.

    Operators drop what they no longer need. What the DataFrame that they return still reads they put into
    the list that a caller gives as ``left``, who may drop it once that DataFrame has been written.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.name = f"{name}-{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/llm_stage/{self.name}"
        self.schema = df.schema
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing will read the table again."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def roots(df: DataFrame) -> set[str]:
    """The folders and files that a DataFrame's plan names, none of them listed."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        if leaves.apply(i).nodeName() == "LogicalRelation" and leaves.apply(i).relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaves.apply(i).relation().location().rootPaths()
            out |= {paths.apply(k).toString() for k in range(paths.size())}
    return out


#: What clears the tables that an operator keeps in a worker between tasks.
TABLES: list[Callable[[], None]] = []
_LIBC = ctypes.CDLL(None)


def _clear_tables() -> None:
    for clear in TABLES:
        clear()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep_tables: bool = False, each: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which at its end, or behind ``each`` batch, gives memory back: workers serve many stages, and what one leaves the next has not.

    Without ``keep_tables`` the tables that operators keep in a worker go too, before and behind it.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_tables:
            _clear_tables()
        try:
            for batch in run(batches):
                yield batch
                del batch
                if each:
                    _give_back()
        finally:
            if not keep_tables:
                _clear_tables()
            _give_back()

    return wrapped


#: Bytes of rows that Spark hands to Python at once, at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
#: Rows that Spark's reader of Parquet decodes at once, at most; it holds them twice as it grows, in each task.
READ_ROWS = 256
#: Bytes of a row group of the Parquet that is written: a task holds one whole as it writes, and of one what it reads of its columns.
ROW_GROUP = 16 << 20


def small_transfers(spark: SparkSession) -> None:
    """Bound what Spark hands to Python at once by bytes too, and what a task reads and writes at once: rows of documents have any length. Lowers the session's settings, never raises them."""
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    # Spark hands a session's settings to the writer, so this holds for what callers write of a result too
    found = spark.conf.get("parquet.block.size", None) or spark._jsc.hadoopConfiguration().get("parquet.block.size")
    if not found or int(found) > ROW_GROUP:
        spark.conf.set("parquet.block.size", str(ROW_GROUP))


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle: the session's own setting, which follows the input on a cluster."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``most`` bytes of text, or one longer row: (first row, end row, bytes, offsets from 0).

    Working arrays stay proportional to ``most`` or to the longest single text, never to the batch.
    """
    if not len(column):
        return
    raw, offs = utf8(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, side="right")) - 1)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


#: Bytes of text that are worked on at once where a row's work is a dozen arrays as long as its text.
AT_ONCE = 1 << 18


def with_text(docs: DataFrame, own: list[str], text: str) -> tuple[DataFrame, int]:
    """``docs`` with columns ``own`` and the text, which is sent once even if it is one of them; and the text's place."""
    if text in own:
        return docs.select(*own), own.index(text)
    return docs.select(*own, docs[text].alias(private(docs, "text_")[0])), len(own)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """Without columns whose names an operator adds (compared as Spark does, without case): the operator's own win."""
    low = {n.lower() for n in names}
    return df.select(*[c for i, c in enumerate(df.columns) if c.lower() not in low])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``rows`` with what ``groups`` has of each of their groups: ``keys``, ``n`` (how many of the ``count`` rows it has) and more; rows without one go.

    Groups of more than a thousandth of all rows are at most a thousand: they are broadcast, so a hot group's
    rows stay in the tasks where they are. The others are joined by shuffle.
    """
    most = max(1000, count // 1000)
    large = groups.where(F.col("n") > most).drop("n")
    near = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.where(F.col("n") <= most).drop("n"), keys)
    return near.unionByName(rows.join(F.broadcast(large), keys))


def private(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, for an operator's own use."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that come sorted by their first ``keys`` columns of integers: (rows of some groups, their offsets).

    Only a group that goes on past a batch is held until it ends.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for k, c in enumerate(columns):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
        at = np.flatnonzero(new)
        if not len(at):
            held.append(batch)
            continue
        if first := held + ([batch.slice(0, at[0])] if at[0] else []):
            yield pa.concat_batches(first), np.array([0, sum(b.num_rows for b in first)])
        if len(at) > 1:
            yield batch.slice(at[0], at[-1] - at[0]), at - at[0]
        held = [batch.slice(at[-1])]
    if held:
        yield pa.concat_batches(held), np.array([0, sum(b.num_rows for b in held)])
