"""Helpers that the operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts, as a character class of Java and Python.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark.sparkContext, "_leafline_dir", None)
        if folder is None:
            made = tempfile.mkdtemp(prefix="leafline-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            folder = spark.sparkContext._leafline_dir = f"file://{made}"
    return folder.rstrip("/")


#: Paths made within tracked(), by application.
_tracked: dict[str, list[str]] = {}
_tracking: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/leafline/{tag}-{uuid.uuid4().hex}"
    if _tracking:
        _tracked.setdefault(_tracking[-1], []).append(path)
    return path


@contextlib.contextmanager
def tracked(spark: SparkSession) -> Iterator[None]:
    """Remembers the paths that are made within, for sweep()."""
    _tracking.append(spark.sparkContext.applicationId)
    try:
        yield
    finally:
        _tracking.pop()


def sweep(spark: SparkSession) -> None:
    """Deletes what was made within tracked(): for a caller who knows that nothing reads it any more."""
    drop(spark, *_tracked.pop(spark.sparkContext.applicationId, []))


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, and lost executors cost nothing that was written."""
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafline_path = path
    return out


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables of written(), or paths, that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._leafline_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors unless PYTHONPATH has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_leafline_shipped", False):
        return
    made = tempfile.mkdtemp(prefix="leafline-zip-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(path := f"{made}/leafline.zip", "w") as z:
        for folder, _, names in os.walk(f"{root}/leafline"):
            for name in names:
                if name.endswith(".py"):
                    z.write(full := os.path.join(folder, name), os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._leafline_shipped = True


#: Rows and bytes of the batches that a worker takes at a time, so that long texts don't add up in it.
ROWS, BYTES = 4000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """The same bounds for the JVM's side, where the session sets none: they are read when a plan runs, so there is no other place for them."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ROWS rows, and of BYTES bytes unless one row has more."""
    at, n = 0, batch.num_rows
    if n and batch.nbytes <= BYTES and n <= ROWS:
        yield batch
        return
    while at < n:
        size = max(1, min(ROWS, n - at))
        while size > 1 and batch.slice(at, size).nbytes > BYTES:
            size //= 2
        yield batch.slice(at, size)
        at += size


def _outs(out) -> Iterable[dict]:
    return () if out is None else (out,) if isinstance(out, dict) else out


#: What a worker keeps between its tasks.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept by the process under this key."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _release(keeps: object) -> None:
    """Forgets what was kept under other keys."""
    others = [k for k in _kept if k != keeps]
    for k in others:
        del _kept[k]
    if others:
        trim()


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, last: bool = False, keeps: object = None) -> DataFrame:
    """mapInArrow with columns as dicts. make() runs once in each task and gives the function for a batch.

    That function returns a dict, None, or an iterator of dicts, each a batch. With last, it is called once more with None after the
    last batch. Batches that come in have ROWS rows and BYTES bytes at most, whatever the session's settings. keeps: the key of kept() that
    the tasks use; what a worker kept for other operators goes when a task begins, as workers live on from stage to stage.
    """
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release(keeps)
        step = make()
        for batch in batches:
            for part in _parts(batch):
                yield from (_batch(out, arrow) for out in _outs(step(part)))
        if last:
            yield from (_batch(out, arrow) for out in _outs(step(None)))
        del step
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives freed memory back: workers live on between tasks, beside a heap that fills the rest."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of texts; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the filter of rows that may leave, for each of them and at most (8 MB); 2 ** PAGE bits are a row of its table.
SPREAD, MOST, PAGE = 32, 26, 15


def _doubted(keyed: DataFrame, like: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of keyed whose keys are surely not in like, and the rest, without a shuffle.

    A bit set of the hashes of like's keys is broadcast, of bounded size: where like outgrows it, more of the rows are doubted, none is lost.
    """
    at, page, bits = "_leafline_at", "_leafline_page", "_leafline_bits"
    wide = 1 << min(MOST, max(PAGE, (SPREAD * like.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(wide))
    pages = like.select(place.alias(at)).groupBy(F.shiftright(at, PAGE).alias(page)).agg(F.bitmap_construct_agg(F.col(at).bitwiseAND(F.lit((1 << PAGE) - 1))).alias(bits))
    met = keyed.withColumn(at, place).join(F.broadcast(pages), F.shiftright(at, PAGE) == F.col(page), "left")
    byte = F.expr(f"cast(conv(hex(substring({bits}, cast(({at} & {(1 << PAGE) - 1}) div 8 as int) + 1, 1)), 16, 10) as int)")
    doubt = F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1, F.lit(False))
    return met.where(~doubt).select(*keyed.columns), met.where(doubt).select(*keyed.columns)


def staying(docs: DataFrame, columns: list[str], marked: DataFrame) -> DataFrame:
    """The rows of docs that stay, with these columns.

    marked(doc_id, text_sha256 of the raw text, all, one, rows) says of the rows of docs whether all like them stay, or
    one of them; its `rows` add up to the rows of docs. Texts are dealt out only of rows that may leave, by _doubted(), so that what is shuffled grows with
    those; there the keys decide. Only rows that repeat a doc_id with its text are ranked, by their columns.
    """
    spark, id_, text = docs.sparkSession, "_leafline_id", "_leafline_text"
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    like = marked.groupBy(name("doc_id").alias(id_), F.col("text_sha256").alias(text)).agg(F.bool_or("all").alias("all"), F.bool_or("one").alias("one"), F.sum("rows").alias("n"))
    like = written(spark, like.where("not all and (not one or n > 1)").select(id_, text, "one"), "leaving")
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], name("doc_id").alias(id_), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias(text))
    sure, doubted = _doubted(keyed, like, [id_, text])
    out = sure.select(*columns).unionByName(doubted.join(like, [id_, text], "left_anti").select(*columns))
    if like.where("one").isEmpty():
        return out
    order = Window.partitionBy(id_, text).orderBy(*[F.col(f"`{c}`") for c in columns])
    again = doubted.join(like.where("one"), [id_, text], "left_semi").withColumn("_leafline_n", F.row_number().over(order)).where("_leafline_n = 1")
    return out.unionByName(again.select(*columns))


def word_count(column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(column, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")
