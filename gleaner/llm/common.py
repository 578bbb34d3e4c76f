"""What the operators of this subpackage share: the shared folder, checkpoints and small Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that hold whole texts; with texts of a few kB a batch stays at some MB.
TEXT_BATCH_ROWS = 2000
#: Bytes of texts that a vectorised step takes at once; what it makes of them is some ten times as large.
TEXT_BLOCK = 4 << 20
#: Rows of a few numbers that make a task and its file worth while, and how many such files may be smaller.
FILE_ROWS, FEW_FILES = 20_000, 12


@lru_cache(maxsize=1)
def _libc():
    """The C library, where it can be told to return free memory."""
    try:
        found = ctypes.CDLL("libc.so.6")
        found.malloc_trim(0)
    except (OSError, AttributeError):
        return None
    return found


def give_back() -> None:
    """Return the memory that a Python process holds but doesn't use: workers outlive their tasks, the driver its steps."""
    pa.default_memory_pool().release_unused()
    if (c := _libc()) is not None:
        c.malloc_trim(0)


def tidy(run):
    """``run``, for mapInArrow, without what its task leaves behind in the worker."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where that is unset on a single
    machine, as in tests, a temporary one, set once per session and deleted at the end.

    A path without a scheme is on the cluster's default file system.  A cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        local = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found.rstrip("/"))
    qualified = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{qualified.removeprefix('file:')}" if re.match("file:/(?!/)", qualified) else qualified


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/gleaner/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder, so that the loss of an executor costs no recomputation.

    The shuffle files behind it go at once: nothing reads them again.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    out = df.checkpoint(eager=True)
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)
    return out


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have at most ``rows`` rows of a few numbers, in no more partitions than these are worth.  Where adaptive
    execution doesn't join small ones, a checkpoint has a file of hardly any rows for each, and an executor forks to make one."""
    return df.coalesce(max(FEW_FILES, -(-rows // FILE_ROWS)))


def release(df: DataFrame) -> None:
    """Delete the files of the checkpoints that ``df`` reads; for those that nothing will read again."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().logical().collectLeaves()
    for leaf in (leaves.apply(k) for k in range(leaves.size())):
        if leaf.nodeName().startswith("LogicalRDD") and (file := leaf.rdd().getCheckpointFile()).isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Between the steps of a long job: the driver gives back what finished ones took, its JVM's heap and what that process
    has allocated beside it as well, where the JVM can be told to."""
    gc.collect()
    give_back()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return  # a JVM that has no such command


def regrouped(df: DataFrame, column: str) -> DataFrame:
    """The same rows, their long or binary ``column`` worked out anew.  A join on the result of an aggregation would use
    its partitions as they are; so it deals both sides out itself, and adaptive execution can split a hot key's rows."""
    c = F.col(column)
    anew = F.substring(c, 1, 1 << 30) if dict(df.dtypes)[column] == "binary" else F.bitwise_not(F.bitwise_not(c))
    return df.withColumn(column, anew)


def whole_text(column: str = "text"):
    """The text column; a null is an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without a detour by str; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_pieces(batches: Iterable[pa.RecordBatch], rows: int = TEXT_BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a step makes of them at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_blocks(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts, in ``column``, have at most ``most`` bytes; a longer text is one by itself."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each text's tokens begin and the last ends, a code for each token, the different tokens): what is done
    for a token has to be done once a block only.  Tokens have white space between them."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = found.flatten().dictionary_encode()
    offsets = found.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], flat.indices.to_numpy(zero_copy_only=False), flat.dictionary


def words_in(texts: pa.Array, pattern: re.Pattern, plain) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(a number for each word of all texts one after another, where each text's begin and the last end, the words by
    number).  Words are what ``pattern`` finds in the lower-cased text; it must take no white space, stop or quotation mark
    and find all of a token of which ``plain``, a function of arrays, is true."""
    offsets, codes, found = tokens(texts)
    bare = pc.utf8_trim(pc.utf8_lower(found), characters=".,;:!?\"'()")
    simple = plain(bare).to_numpy(zero_copy_only=False)
    whole = bare.filter(pa.array(simple)).dictionary_encode()
    words = whole.dictionary.to_pylist()
    number = np.zeros(len(found), np.int32)
    number[simple] = whole.indices.to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~simple)
    if not len(rest):
        return number[codes], offsets, words
    known = {w: k for k, w in enumerate(words)}
    others = [[known.setdefault(w, len(known)) for w in pattern.findall(t.lower())] for t in found.take(pa.array(rest)).to_pylist()]
    sizes, flat = np.ones(len(found), np.int64), np.array([k for o in others for k in o], np.int32)
    sizes[rest] = [len(o) for o in others]
    begins = np.zeros(len(found), np.int64)
    begins[rest] = np.cumsum(sizes[rest]) - sizes[rest]
    n = sizes[codes]
    ends = np.r_[0, np.cumsum(n)]
    out = np.empty(ends[-1], np.int32)
    one = simple[codes]
    out[ends[:-1][one]] = number[codes[one]]
    codes, first, n = codes[~one], ends[:-1][~one], n[~one]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(first, n) + within] = flat[np.repeat(begins[codes], n) + within]
    return out, ends[offsets], list(known)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values in the type that Spark has for them."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
