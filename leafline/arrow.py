"""mapInArrow with columns as dicts, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors unless PYTHONPATH has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_leafline_sent", False):
        return
    made = tempfile.mkdtemp(prefix="leafline-package-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(path := f"{made}/leafline.zip", "w") as z:
        for folder, _, names in os.walk(f"{root}/leafline"):
            for name in names:
                if name.endswith(".py"):
                    z.write(full := os.path.join(folder, name), os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._leafline_sent = True


#: Bytes up to which an input is dealt over all cores before Python reads it; larger inputs have files enough.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input, which may be one file and so one task, over all cores."""
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def mapped(df: DataFrame, step: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Each Arrow batch of df as lists by column through step, to rows of schema."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = step(batch.slice(at, 1000).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
