"""Revisions and project templates as JSON."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stemma.catalog import LINKS, Attribute, Catalog, Model
from stemma.errors import QuestionError
from stemma.functions.columns import parse_date
from stemma.operators.upsert import Revisions, given_type


def revision_schema(model: Model) -> T.StructType:
    """Of the attributes, as a JSON revision has them; dates are texts."""
    return T.StructType([T.StructField(a.name, T.StringType() if isinstance(given_type(a), T.TimestampNTZType) else given_type(a)) for a in model])


def _cell(a: Attribute, value: Any) -> Any:
    kind = given_type(a)
    if value is None:
        return None
    if isinstance(kind, T.TimestampNTZType):
        return value if isinstance(value, datetime.datetime) else parse_date(value)
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise QuestionError(f"{value} is not an Array.")
        if a.type == "matrix":
            if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value):
                raise QuestionError("Matrix value is not an array of numbers")
            return [float(v) for v in value]
        return [_cell_of(kind.elementType, v) for v in value]
    if a.type == "match" and not (isinstance(value, dict) and sorted(value) == ["type", "value"]):
        raise QuestionError(f"{json.dumps(value)} is not like {{ type, value }}.")
    return _cell_of(kind, value)


def _cell_of(kind: T.DataType, value: Any) -> Any:
    if isinstance(kind, T.StructType):
        return {f: value.get(f) if isinstance(value.get(f), str) or value.get(f) is None else json.dumps(value[f]) for f in kind.names}
    if value is None:
        return None
    return float(value) if isinstance(kind, T.DoubleType) else str(value) if isinstance(kind, T.StringType) else value


def revisions_of(spark: SparkSession, catalog: Catalog, body: Mapping[str, Mapping[Any, Mapping[str, Any]]]) -> dict[str, Revisions]:
    """A request's revisions, {model: {record: {attribute: value}}}: what one request holds comes from the driver."""
    out = {}
    for name, records in body.items():
        model = catalog.model(name)
        names = tuple(dict.fromkeys(n for r in records.values() for n in r))
        known = [model.get(n) for n in names if model.find(n)]
        schema = T.StructType([T.StructField("__record", T.StringType()), T.StructField("__seq", T.LongType()), T.StructField("__given", T.ArrayType(T.StringType())), *(T.StructField(a.name, given_type(a)) for a in known)])
        rows = [{"__record": str(record), "__seq": i, "__given": [*revision]} | {a.name: _cell(a, revision.get(a.name)) for a in known} for i, (record, revision) in enumerate(records.items())]
        out[name] = Revisions(spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema))), names)
    return out


def read_revisions(spark: SparkSession, catalog: Catalog, path: str, models: list[str]) -> dict[str, Revisions]:
    """Files of lines {"model", "record", "seq", "revision": {attribute: value}}; later ``seq`` win."""
    lines = spark.read.schema("model string, record string, seq long, revision string").json(path)
    out = {}
    for name in models:
        model = catalog.model(name)
        cells = F.from_json("revision", revision_schema(model))
        rows = lines.where(F.col("model") == name).select(F.col("record").alias("__record"), F.coalesce("seq", F.lit(0).cast("long")).alias("__seq"), F.coalesce(F.json_object_keys("revision"), F.array().cast("array<string>")).alias("__given"), cells.alias("r"))
        columns = [F.to_timestamp_ntz(F.regexp_replace(F.col("r")[a.name], r"(Z|\+00:?00)\z", "")).alias(a.name) if isinstance(given_type(a), T.TimestampNTZType) else F.col("r")[a.name].alias(a.name) for a in model]
        out[name] = Revisions(rows.select("__record", "__seq", "__given", *columns), tuple(a.name for a in model))
    return out


def catalog_of(project: str, template: Mapping[str, Any]) -> Catalog:
    """The catalog that a project template, {"models": {name: {"template": {...}}}}, describes."""
    models = {}
    for name, entry in template["models"].items():
        t = entry["template"]
        attributes = []
        for n, a in t["attributes"].items():
            kind = a["attribute_type"]
            validation = a.get("validation")
            if isinstance(validation, Mapping):
                validation = (validation["type"], *([validation.get("begin"), validation.get("end"), bool(validation.get("exclude_end"))] if validation["type"] == "Range" else [validation.get("value")]))
            attributes.append(
                Attribute(
                    a.get("name", n), kind, column=a.get("column_name"), target=a.get("link_model_name") if kind in LINKS else None, via=a.get("link_attribute_name"), options=tuple(a.get("options") or ()),
                    validation=tuple(validation) if validation else None, restricted=bool(a.get("restricted")), hidden=bool(a.get("hidden")), read_only=bool(a.get("read_only")), unique=bool(a.get("unique")),
                    display_name=a.get("display_name"), description=a.get("description"), format_hint=a.get("format_hint"), group=a.get("attribute_group"),
                )
            )
        dictionary = t.get("dictionary")
        if isinstance(dictionary, Mapping):
            dictionary = (dictionary["dictionary_model"], tuple(dictionary["attributes"].items()))
        identity = t.get("identifier")
        known = any(a.name == identity for a in attributes)
        parent = any(a.type == "parent" for a in attributes)
        models[name] = Model(name, tuple(attributes), key="id" if known or not identity else identity, identity=identity if known else None, root=not parent and not t.get("parent"), version=t.get("version", 0), dictionary=dictionary, date_shift_root=bool(t.get("date_shift_root")))
    return Catalog(project, models)


def template_of(catalog: Catalog) -> dict[str, Any]:
    """The project template, as ``catalog_of`` reads it."""
    return {"models": {name: {"template": m.template()} for name, m in catalog.models.items()}}
