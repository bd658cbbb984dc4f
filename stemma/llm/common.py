"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: What separates words in the contracts of the operators.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for a row and hand it to ``body`` (which may use it inside other lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a local folder; on a cluster it is an error. What is
    stored stays until the folder of the setting is cleared: results are read from it lazily.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.gettempdir() + "/stemma-checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_columns(df: DataFrame, column: str, made: Callable[[pa.Array], Iterator[dict[str, pa.Array]]], new: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ``new`` columns that ``made`` yields for stretches of ``column``, in order; they replace columns of the same name.

    The other columns go through as they are, in Arrow: no number or null of theirs changes its type.
    """
    fields = T._parse_datatype_string(new).fields
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in fields} and f.name not in drop]
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in made(batch.column(0)):
                found = {name: x.cast(types[name]) for name, x in found.items()}
                rows = len(next(iter(found.values())))
                part = batch.slice(at, rows)
                at += rows
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(found[f.name] for f in fields)], names=[*(f.name for f in kept), *(f.name for f in fields)])

    return df.select(F.col(column).alias("__made_from"), *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType(kept + fields))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read again: it is computed once, and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
