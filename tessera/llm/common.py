"""What the text operators share: the per-batch runner and input normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "__text"

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return _ARROW[kind.simpleString()]


_PLAIN = {"bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "string": T.StringType, "binary": T.BinaryType}


def _type(name: str) -> T.DataType:
    if name.startswith("array<"):
        return T.ArrayType(_type(name[6:-1]))
    if name.startswith("struct<"):
        return T.StructType([T.StructField(*(f(x) for f, x in zip((str, _type), part.split(":", 1)))) for part in name[7:-1].split(",")])
    return _PLAIN[name]()


def fields(ddl: str) -> list[T.StructField]:
    """Fields of a list "name type, ..."; works without a session, as executors import it too."""
    return [T.StructField(name, _type(kind)) for name, kind in (part.split(" ") for part in ddl.split(", "))]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay near ``most_bytes``; a single row is never cut."""
    n = batch.num_rows
    if batch.column(column).nbytes <= most_bytes:
        yield batch
        return
    step = max(1, n * most_bytes // batch.column(column).nbytes)
    for at in range(0, n, step):
        yield batch.slice(at, step)


def map_documents(
    docs: DataFrame,
    make_kernel: Callable[[], Callable[[pa.Array], dict]],
    out: Sequence[T.StructField],
    *,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Run a kernel over whole texts, one Arrow batch at a time, without a shuffle.

    ``make_kernel`` is called once per task; the kernel gets the text column (nulls included) and
    returns one sequence per output field.  ``keep`` names the input columns that go along; one that
    has the name of an output field gives way to the output.  All other input columns are dropped.
    """
    made = {f.name for f in out}
    keep = [c for c in keep if c not in made]
    columns = [F.col(f"`{c}`") for c in keep]
    if text_col in keep:
        at = keep.index(text_col)
    else:
        at = len(keep)
        columns.append(F.col(f"`{text_col}`").cast("string").alias(TEXT))
    frame = docs.select(*columns)
    schema = T.StructType([*frame.schema.fields[: len(keep)], *out])
    kinds = [(f.name, arrow_type(f.dataType)) for f in out]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for whole in batches:
            for batch in slices(whole, at):
                made = kernel(batch.column(at))
                arrays = [x if isinstance(x := made[name], pa.Array) else pa.array(x, type=kind) for name, kind in kinds]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[*batch.schema.names[:n], *(k for k, _ in kinds)])

    return frame.mapInArrow(run, schema)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives b""."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def as_text(texts: pa.Array) -> list[str]:
    """Each text as str; null gives ""."""
    return [x or "" for x in texts.to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
