"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at a time.
CHUNK_CHARS = 2_000_000
#: Bytes of a batch that goes to a Python worker. A batch is held several times over on its way.
BATCH = "2m"
#: Bits of the bitmaps of wanted rows, fixed sizes.
BITMAP, WIDE_BITMAP = 1 << 20, 1 << 23
#: Spark's setting by which a query's shuffle files go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Distinct words and stems that a worker remembers between chunks.
WORDS_KEPT, STEMS_KEPT = 250_000, 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset and all runs on this machine, as in tests, it is set to a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there, which ends its lineage.

    The table goes when ``free`` is told or the program ends, what was dealt
    out to make it as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarry-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # else shuffle files stay until the driver collects its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` made and nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df._quarry_path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        with contextlib.suppress(Exception):
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def bitmap(slots: DataFrame, size: int = BITMAP) -> Column:
    """An array of ``size`` / 64 longs with the bits of a column ``slot`` set, as a value for each row."""
    words = slots.select(F.expr("shiftright(slot, 6)").cast("long").alias("word"), F.expr("shiftleft(1L, slot & 63)").alias("bits"))
    every = slots.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = words.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return cut(full.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.expr("transform(w, x -> x.bits)").alias("w"))).scalar()


def _marked(df: DataFrame, wanted: DataFrame, by: tuple[str, ...], size: int) -> tuple[DataFrame, str]:
    """``df`` with two columns more, and a condition over these that all rows of ``wanted`` meet."""
    slot = F.pmod(F.xxhash64(*by), F.lit(size)).cast("int")
    marked = df.withColumn("_bits", bitmap(wanted.select(slot.alias("slot")), size)).withColumn("_slot", slot)
    return marked, "shiftright(_bits[shiftright(_slot, 6)], _slot & 63) & 1L = 1L"


def maybe_in(df: DataFrame, wanted: DataFrame, *by: str, size: int = BITMAP) -> DataFrame:
    """Rows of ``df`` whose columns ``by`` may be those of a row of ``wanted``: all that are, and few others as long as these are few for the bitmap.

    A bitmap of fixed size decides in the scan, so that only such rows are dealt.
    """
    marked, maybe = _marked(df, wanted, by, size)
    return marked.filter(maybe).drop("_bits", "_slot")


def without(df: DataFrame, gone: DataFrame, by: str, size: int = WIDE_BITMAP) -> DataFrame:
    """Rows of ``df`` whose ``by`` isn't in ``gone``: exactly; rows that the bitmap can tell aren't dealt. ``by`` isn't null."""
    marked, maybe = _marked(df, gone, (by,), size)
    safe, rest = (marked.filter(x).drop("_bits", "_slot") for x in (f"not ({maybe})", maybe))
    return safe.unionByName(rest.join(gone.select(by), by, "left_anti"))


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of a few MB, so that long texts don't fill a worker's memory.

    Spark has this limit as a setting of the session; it is lowered unless it
    was set to something else.
    """
    conf = df.sparkSession.conf
    if str(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")) in ("67108864b", "67108864", "64m", "64MB"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)

    def task(batches):
        remembered(None, lambda: None)  # forgets what other stages left
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def release() -> None:
    """Give memory that is no longer used back to the machine: the C library keeps much of it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: What a worker process remembers between the tasks of a stage, and that stage.
_REMEMBERED: dict = {}
_STAGE: list = [None]


def remembered(key, make):
    """``make()``, made once for the tasks of a stage that a worker process runs; what other stages left goes."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _STAGE[0]:
        _REMEMBERED.clear()
        _STAGE[0] = stage
    if key is not None and key not in _REMEMBERED:
        _REMEMBERED[key] = make()
    return _REMEMBERED.get(key)


def training_row(id_col: str = "doc_id") -> Column:
    """True for rows whose crc32 of the id's text is not a multiple of 5."""
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0


def bounded_sample(rows: DataFrame, by: str, sizes: dict, bound: int) -> DataFrame:
    """The ``bound`` rows (id, ``by``) with the smallest hash of their id of each value of ``by``; ``sizes`` has their numbers of rows.

    Hashes past what so many rows can be expected to need go in the scan: so
    what meets in a task is about a fifth more than the bound, however many
    rows a value has.
    """
    place = F.shiftrightunsigned(F.xxhash64("id"), 33)
    share = {k: min(1.0, (1.2 * bound + 200) / n) for k, n in sizes.items()}
    most = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 31)))]), F.col(by))
    few = rows.filter(place <= most)
    return few.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(place, "id"))).filter(F.col("_r") <= bound).drop("_r")


def chunks(sizes, limit: int = CHUNK_CHARS):
    """Slices of consecutive items whose sizes add up to about ``limit``; each has one item at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


class Vocabulary:
    """Numbers words in order of appearance; forgets them all when it grows too large."""

    def __init__(self, kept: int = WORDS_KEPT):
        self.kept = kept
        self.clear()

    def clear(self):
        self.index = defaultdict(count().__next__)
        self.known = 0

    def number(self, docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all documents in a row, and the number of words of each document."""
        n, get = np.array([len(x) for x in docs], dtype=np.int64), self.index.__getitem__
        return np.fromiter(map(get, chain.from_iterable(docs)), dtype=np.int64, count=int(n.sum())), n

    def fresh(self) -> list:
        """Words numbered since the last call."""
        n = len(self.index)
        if n == self.known:
            return []
        items = list(islice(self.index, self.known, None))
        self.known = n
        return items


class StemCoder:
    """Ids of words by their stems, each of which is encoded once as long as it is remembered.

    ``encode`` gives all ids of a list of stems in a row and each one's number
    of ids. ``marks`` are characters and their ids: one behind a letter is cut
    off first, which is right for models that never join the two. ``fold``
    lower-cases A-Z, for models that do so themselves.
    """

    def __init__(self, encode, marks: dict[str, int], fold: bool, kept: int = STEMS_KEPT):
        self.encode, self.fold, self.stems = encode, fold, Vocabulary(kept)
        self.marks, self.mark_ids = pa.array(list(marks), type=pa.string()), np.array([*marks.values(), 0], dtype=np.int64)
        self.forget()

    def forget(self):
        self.stems.clear()
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of words in a row, and each word's number of ids."""
        if self.stems.known > self.stems.kept:
            self.forget()
        head = pc.utf8_slice_codeunits(words, 0, -1)
        mark = pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=self.marks)
        cut_off = pc.and_(pc.is_valid(mark), pc.utf8_is_alpha(pc.utf8_slice_codeunits(head, -1)))
        stems = pc.if_else(cut_off, head, words)
        coded = (pc.ascii_lower(stems) if self.fold else stems).dictionary_encode()
        at, _ = self.stems.number([coded.dictionary.to_pylist()])
        if fresh := self.stems.fresh():
            ids, lengths = self.encode(fresh)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        at = at[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else at
        lengths, marked = self.lengths[at], np.flatnonzero(cut_off.to_numpy(zero_copy_only=False))
        which = pc.fill_null(mark, len(self.marks)).to_numpy(zero_copy_only=False)[marked]
        ids = np.insert(self.ids[spread(self.starts[at], lengths)], np.cumsum(lengths)[marked], self.mark_ids[which])
        lengths[marked] += 1
        return ids, lengths


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... for lengths[i] each, all in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; runs may be empty."""
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=np.float64)
    filled = np.flatnonzero(lengths)
    if len(filled):
        starts = (np.cumsum(lengths) - lengths)[filled]
        out[filled] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out
