"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Only used where the session names no shared folder (tests, local mode).
LOCAL_SHARED = "/tmp/checkpoints/clausewright"
#: A mapInArrow function cuts its batches into runs of about this many bytes of text.
RUN_BYTES = 8 << 20
#: Texts that a task's Python gets at once where a table is written: Spark's 10,000 are some 20 MB in the JVM and in Python.
TEXTS = 1024
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What this Python worker keeps from task to task, each with the last task that asked for it.
_KEPT: dict[object, tuple[object, int | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns (new name = exact old name), whatever else df holds.

    Columns are found by position, so an extra column whose name differs from a wanted one only in
    case, or that equals the name of a result column, does no harm.
    """
    rows, at = flat(df)
    return rows.select(*[F.col(at[old]).alias(new) for new, old in wanted.items()])


def flat(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under unique column names, and the new name of each old one (the first, where one repeats)."""
    at: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, f"_in{i}")
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))]), at


def keep_rows(docs: DataFrame, text: str, choose: Callable[[list[str | None]], Iterable[bool]]) -> DataFrame:
    """The rows whose text is chosen, with all their columns, decided where they lie."""
    rows, at = flat(docs)
    column = rows.columns.index(at[text])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, at[text]):
            yield batch.filter(pa.array(list(choose(batch.column(column).to_pylist())), pa.bool_()))

    return rows.mapInArrow(kept, rows.schema).toDF(*docs.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session without one has a folder of
    this machine's in local mode, and is an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    return (found or LOCAL_SHARED).rstrip("/")


def materialize(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends there, and an executor's
    loss costs no more than the tasks it ran. The shuffle files that it took go at once, its own files when the
    driver's JVM ends or at discard(). batch: the most rows that Python functions get at once, where rows are wide."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    wanted, before = {_CLEAN_UP: "true"}, {_CLEAN_UP: spark.conf.get(_CLEAN_UP, "false")}
    if batch:
        wanted[_BATCH], before[_BATCH] = str(batch), spark.conf.get(_BATCH)
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.startswith(("file:", "/")) or "://" in folder:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _task() -> int | None:
    task = TaskContext.get()
    return task.taskAttemptId() if task else None


def kept(key: object, make: Callable[[], object]) -> object:
    """What make() gives, once for all tasks of a Python worker that ask for it one after another; trim() of a task that
    has not asked for it lets it go, so that one stage's tables don't lie in the memory of the next."""
    found = _KEPT[key][0] if key in _KEPT else make()
    _KEPT[key] = found, _task()
    return found


def trim() -> None:
    """Gives back to the system what this Python worker holds of its last tasks: what they kept and this one does not
    use, and what they have freed; allocators would keep it, and workers live on from stage to stage."""
    now = _task()
    for key in [k for k, (_, task) in _KEPT.items() if task != now]:
        del _KEPT[key]
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the text exceeds the limit; a row is never split."""
    trim()
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, worst: Callable, where: Column | None = None) -> list[Row]:
    """About `rows` labelled texts (text, label) for a fit on the driver; empty ones are left out. Of a text of over
    `chars` characters a window of that length is taken, at a place that a hash chooses.

    Rows are chosen by a hash of doc_id, under a threshold that the number of labels sets, so no more than
    about that many reach the driver at any size. Null keys and labels are left out; a key labelled more
    than once counts once, with the label that `worst` picks. where: a condition on doc_id.
    """
    marks = pick(labels, doc_id="doc_id", label=label).where("label is not null and doc_id is not null")
    marks = (marks if where is None else marks.where(where)).groupBy("doc_id").agg(worst("label").alias("label"))
    share = min(1.0, rows / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = pick(docs, doc_id="doc_id", text="text").where(F.length("text") > 0)
    place = F.pmod(F.xxhash64("doc_id"), F.length("text") - chars + 1).cast("int") + 1
    texts = texts.withColumn("text", F.when(F.length("text") > chars, F.substring("text", place, F.lit(chars))).otherwise(F.col("text")))
    found = texts.join(chosen, "doc_id").select("doc_id", "text", "label").collect()
    return sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))


class Words:
    """Numbers for the words of a run of texts: a word keeps its number and its hash within the run."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint32)

    def of(self, text: str) -> np.ndarray:
        return self.numbered(text.encode().split())

    def numbered(self, words: list[bytes]) -> np.ndarray:
        number, known = self.numbers, len(self.numbers)
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        if len(number) > len(self.hashes):
            grown = np.zeros(max(1024, 2 * len(number)), np.uint32)
            grown[:known] = self.hashes[:known]
            self.hashes = grown
        if len(number) > known:
            fresh = np.fromiter(map(zlib.crc32, islice(reversed(number), len(number) - known)), np.uint32, len(number) - known)
            self.hashes[known : len(number)] = fresh[::-1]
        return ids
