"""TSV files in and out, and row counts of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.catalog import MANY, ONE, UP, Model
from stemma.errors import QuestionError
from stemma.plans.question import Engine
from stemma.plans.retrieve import Request, Retrieval


def read_tsv(spark: SparkSession, path: str, model: Model, strict: bool = True) -> DataFrame:
    """Rows of a tab-separated file with a header, as revisions of ``model``; empty cells are null.

    A cell that doesn't fit its attribute is an error; without ``strict`` it is null.
    """
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="", quote='"', escape='"')
    kinds = {a.name: "string" if a.type in UP else model.schema()[a.stored].dataType.simpleString() for a in model if a.type not in ONE + MANY}
    simple = {n: k for n, k in kinds.items() if n in raw.columns}
    cells = {n: F.from_json(n, k) if k.startswith(("array", "struct")) else F.col(n).try_cast(k) for n, k in simple.items()}
    if strict and cells:
        bad = F.filter(F.array(*(F.when(F.col(n).isNotNull() & c.isNull(), F.concat(F.lit(f"{n}: "), F.col(n))) for n, c in cells.items())), lambda x: x.isNotNull())
        if found := raw.select(F.explode(bad).alias("cell")).limit(20).collect():
            raise QuestionError("cells don't fit their attributes: " + "; ".join(sorted(r.cell for r in found)))
    return raw.select(*(c.alias(n) for n, c in cells.items()))


def write_tsv(df: DataFrame, path: str) -> None:
    """Text columns to tab-separated files with a header, one for each partition."""
    df.write.csv(path, sep="\t", header=True, emptyValue="", nullValue="")


def unload(engine: Engine, model_name: str, path: str, expand_matrices: bool = False) -> None:
    """All records of a model as text; Spark writes the partitions side by side, so there is nothing to page."""
    write_tsv(Retrieval(engine, Request(model_name, format="tsv", expand_matrices=expand_matrices)).tsv(), path)


def row_counts(engine: Engine) -> DataFrame:
    """model and its number of rows."""
    parts = [df.select(F.lit(name).alias("model")).groupBy("model").agg(F.count("*").alias("n_rows")) for name, df in sorted(engine.tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_rows(engine: Engine) -> DataFrame:
    """The project's template: a row for each attribute."""
    rows = [(m.name, a.name, a.type, a.model if a.type in UP + ONE + MANY else None) for m in engine.catalog.models.values() for a in m]
    return engine.spark.createDataFrame(rows, "model_name string, attribute_name string, attribute_type string, link_model_name string")
