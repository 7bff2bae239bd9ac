"""Shared plumbing of the training-data operators: input columns, scratch space, Arrow row mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows handed to Python code at once inside an Arrow batch; bounds the worker's working set.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that text operators read, whatever else the table has; a null text stays null."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors when PYTHONPATH doesn't already say where it is."""
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_strata_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="strata-ship-"), "strata_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(ROOT, "strata")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), ROOT))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._strata_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set (local tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_strata_checkpoints", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = spark.sparkContext._strata_checkpoints = tempfile.mkdtemp(prefix="spark-strata-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Narrow intermediate results: computed once, kept in the shared checkpoint folder, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Wide intermediate results: written as compressed parquet in the shared folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession)}/strata-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema for the few types the operators return, from the same DDL string that Spark gets."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def map_texts(docs: DataFrame, row: Callable[[str], tuple], ddl: str, text_col: str = "text") -> DataFrame:
    """doc_id plus the columns that ``row(text)`` returns for each whole text (null: empty), one slice at a time."""
    ship(docs.sparkSession)
    schema = arrow_schema("doc_id long, " + ddl)

    def run(batches):
        for b in slices(batches):
            out = [row(t or "") for t in b.column(1).to_pylist()]
            cols = [b.column(0), *([r[i] for r in out] for i in range(len(schema) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return id_and_text(docs, text_col=text_col).mapInArrow(run, "doc_id long, " + ddl)


def map_rows(docs: DataFrame, column: str, change: Callable[[str], str]) -> DataFrame:
    """All rows and columns of ``docs``, with the texts of one column changed; nulls stay."""
    ship(docs.sparkSession)
    at = docs.columns.index(column)

    def run(batches):
        for b in slices(batches):
            new = pa.array([None if t is None else change(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)



def count_kind(spans: str, kind: str) -> Column:
    """How many of the spans (kind:start:end) are of a kind."""
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long")
