"""Documents of a model by name, with a small filter language; every request becomes a question."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.catalog import MANY, ONE, UP, Attribute, Model
from stemma.errors import QuestionError
from stemma.plans.question import Answer, Engine

TERM = re.compile(r"([a-z][a-z0-9_]*)(\^@|\[\]|>=|<=|=|<|>|~)(.*)\Z", re.DOTALL)
SCALAR = ("string", "identifier", "integer", "float", "boolean", "date_time", "shifted_date_time", "file", "image", "match", "matrix")


@dataclass
class Request:
    model_name: str
    record_names: str | Sequence[str] = "all"
    attribute_names: str | Sequence[str] = "all"
    filter: str | Sequence[str] | None = None
    order: str | None = None
    page: int | None = None
    page_size: int | None = None
    show_disconnected: bool = False
    collapse_tables: bool = False
    output_predicate: str | None = None
    hide_templates: bool = False
    expand_matrices: bool = False
    transpose: bool = False
    format: str = "json"

    def check(self) -> None:
        if not self.model_name:
            raise QuestionError("No model name given")
        if self.record_names != "all" and not isinstance(self.record_names, (list, tuple)):
            raise QuestionError("Improperly formed record names")
        if self.attribute_names not in ("all", "identifier") and not isinstance(self.attribute_names, (list, tuple)):
            raise QuestionError("Improperly formed attribute names")
        if self.format not in ("json", "tsv"):
            raise QuestionError(f"{self.format} is not an output format")


def filter_terms(text: str | Sequence[str] | None) -> list[str]:
    """Terms parted by white space, or a list of them (perhaps as JSON)."""
    if not text:
        return []
    if isinstance(text, str):
        return [str(x) for x in json.loads(text)] if text.lstrip().startswith("[\"") else text.split()
    return list(text)


def filter_of(model: Model, term: str, requested: Sequence[str]) -> list:
    """``attribute OP value`` as a filter of a question."""
    m = TERM.match(term)
    if not m:
        raise QuestionError(f"Cannot parse filter {term}")
    name, op, value = m.groups()
    a = model.get(name)
    if name not in requested:
        raise QuestionError(f"{name} is not among the requested attributes")
    if op == "^@":
        return ["::lacks", name]
    if a.type in MANY:
        raise QuestionError(f"Cannot filter on {a.type} {name}")
    path = [name, "::identifier"] if a.type in UP + ONE else [name]
    kind = "string" if a.type in UP + ONE else a.type
    if kind == "matrix":
        return ["::has", name]
    if op == "[]":
        return [*path, "::in", value.split(",")]
    if op == "~":
        return [*path, "::matches", value]
    if kind == "boolean":
        if op != "=" or value not in ("true", "false"):
            raise QuestionError(f"{term} does not ask for true or false")
        return [*path, f"::{value}"]
    if op == "=" and kind in ("string", "identifier", "file", "image"):
        return [*path, "::equals", value]
    if kind in ("file", "image"):
        raise QuestionError(f"{op} does not apply to {kind} {name}")
    return [*path, f"::{op}", value]


@dataclass
class Retrieval:
    engine: Engine
    request: Request
    model: Model = field(init=False)
    attributes: list[Attribute] = field(init=False)

    def __post_init__(self) -> None:
        self.request.check()
        self.model = self.engine.catalog.model(self.request.model_name)
        asked = self.request.attribute_names
        found = [a for a in self.model if not (a.restricted and not self.engine.user.can_see_restricted)]
        if asked == "identifier":
            found = [a for a in found if a.name == self.model.identity]
        elif asked != "all":
            for name in asked:
                self.model.get(name)
            by_name = {a.name: a for a in found}
            found = [by_name[n] for n in dict.fromkeys([*([self.model.identity] if self.model.identity else []), *asked]) if n in by_name]
        self.attributes = [a for a in found if not ((self.request.collapse_tables or self.request.format == "tsv") and a.type == "table")]

    def slices(self) -> dict[str, list[str]]:
        out = {}
        for term in filter_terms(self.request.output_predicate):
            m = TERM.match(term)
            if not m or m[2] != "[]" or self.model.get(m[1]).type != "matrix":
                raise QuestionError(f"Only matrix attributes can be sliced: {term}")
            out[m[1]] = m[3].split(",")
        return out

    def output(self, a: Attribute, slices: dict[str, list[str]]) -> list:
        if a.type in MANY:
            return [a.name, "::all", "::identifier"]
        if a.type in UP + ONE:
            return [a.name, "::identifier"]
        if a.type in ("file", "image", "file_collection"):
            return [a.name, "::all"]
        if a.name in slices:
            return [a.name, "::slice", slices[a.name]]
        return [a.name]

    @property
    def shown(self) -> list[Attribute]:
        """Without tables, which have records of their own."""
        return [a for a in self.attributes if a.type != "table"]

    def filters(self) -> list:
        requested = [a.name for a in self.attributes]
        found = [filter_of(self.model, t, requested) for t in filter_terms(self.request.filter)]
        names = self.request.record_names
        return found + ([] if names == "all" else [["::identifier", "::in", list(names)]])

    def answer(self) -> Answer:
        r, slices = self.request, self.slices()
        columns = [self.output(a, slices) for a in self.shown] or [["::identifier"]]
        return self.engine.ask([self.model.name, *self.filters(), "::all", columns], r.order, r.page, r.page_size, r.show_disconnected)

    def documents(self) -> DataFrame:
        """identifier and a column for each attribute; lists of links are lists of identifiers."""
        df = self.answer().flat([a.name for a in self.shown] or ["__identifier"])
        return df.withColumns({a.name: F.transform(a.name, lambda x: x["v"]) for a in self.shown if a.type in MANY})

    def count(self) -> int:
        """Of all pages; asked for with the first one only."""
        return self.engine.ask([self.model.name, *self.filters(), "::count"], show_disconnected=self.request.show_disconnected).collect()

    def tables(self) -> dict[str, DataFrame]:
        """Of each table attribute, the rows of the records found, with their parent's identifier."""
        out, keys = {}, self.documents().select(F.col("identifier").alias("__parent"))
        for a in self.attributes:
            if a.type == "table":
                other = self.engine.catalog.model(a.model)
                up = self.engine.catalog.back(self.model, a).name
                shown = [b for b in other if b.type in SCALAR and not (b.restricted and not self.engine.user.can_see_restricted)]
                rows = self.engine.ask([other.name, "::all", [*[[b.name] for b in shown], [up, "::identifier"]]]).flat([*(b.name for b in shown), up])
                out[other.name] = rows.join(keys, rows[up] == F.col("__parent"), "left_semi")
        return out

    def payload(self) -> dict:
        """Documents by identifier with the model's template; the one place where rows come to the driver."""
        first = {"count": self.count()} if self.request.page == 1 else {}
        template = lambda m: {} if self.request.hide_templates else {"template": m.template()}
        found = {self.model.name: {"documents": {str(r[0]): r.asDict(True) for r in self.documents().collect()}, **template(self.model), **first}}
        for name, rows in self.tables().items():
            found[name] = {"documents": {str(r[0]): r.asDict(True) for r in rows.collect()}, **template(self.engine.catalog.model(name))}
        return {"models": found}

    def tsv(self) -> DataFrame:
        """Text columns by attribute, without hidden ones; a matrix in one column as JSON, or in a column for each of its own; ``transpose``: rows of attribute and cells."""
        shown = [a for a in self.shown if not a.hidden]
        slices = self.slices()
        matrices = {a.name: slices.get(a.name, list(a.options)) for a in shown if a.type == "matrix"} if self.request.expand_matrices else None
        df = self.documents()
        out = tsv_frame(df.select("identifier", *(a.name for a in shown)), matrices)
        return transposed(out) if self.request.transpose else out.drop("identifier")


def text_cell(df: DataFrame, name: str) -> Column:
    """A value as it stands in a TSV file: lists parted by commas, nothing for null and empty lists."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind.startswith("array<struct<k:"):
        return text_array(F.transform(c, lambda x: x["v"]), kind)
    if kind.startswith("array"):
        return text_array(c, kind)
    if kind.startswith(("struct", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def text_array(c: Column, kind: str) -> Column:
    if kind.count("struct<") > kind.count("struct<k:"):
        return F.coalesce(F.when(F.size(c) > 0, F.to_json(c)), F.lit(""))
    return F.coalesce(F.array_join(F.filter(c.cast("array<string>"), lambda x: x.isNotNull()), ", "), F.lit(""))


def tsv_frame(df: DataFrame, matrices: dict[str, Sequence[str]] | None = None, renames: Sequence[str] | None = None) -> DataFrame:
    """``df`` as text columns; of ``matrices`` a column ``name.column`` for each of their columns; ``renames`` name the columns of ``df``."""
    names = list(renames) if renames else df.columns
    if len(names) != len(df.columns):
        raise QuestionError("user_columns do not match the columns of the answer")
    out = []
    for old, new in zip(df.columns, names, strict=True):
        if matrices and old in matrices:
            out += [F.coalesce(F.get(F.col(old), i).cast("string"), F.lit("")).alias(f"{new}.{n}") for i, n in enumerate(matrices[old])]
        else:
            out.append(text_cell(df, old).alias(new))
    return df.select(*out)


def transposed(df: DataFrame) -> DataFrame:
    """A row for each column of ``df`` but the first: its place, its name, and its cells in the order of the first column.

    As each row holds all records, what is transposed should be a page; nothing goes through the driver.
    """
    first, *names = df.columns
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(f"`{n}`").alias("cell")) for i, n in enumerate(names))))
    rows = df.select(F.col(f"`{first}`").alias("by"), cells.alias("c"))
    return rows.groupBy("c.position", "c.column").agg(F.transform(F.sort_array(F.collect_list(F.struct("by", "c.cell"))), lambda x: x["cell"]).alias("cells"))


def format_leaves(engine: Engine, form: Any) -> list[str]:
    """The headers of an answer's columns: its identifier's, and of each part the last name that its format leads to."""

    def leaf(part: Any) -> str:
        if isinstance(part, str):
            return part
        return part[0] if is_matrix(engine, part[0]) else leaf(part[-1])

    if not (isinstance(form, list) and len(form) == 2 and isinstance(form[0], str)):
        raise QuestionError("only a list has columns")
    label, inner = form
    whole = isinstance(inner, str) or is_matrix(engine, inner[0])
    return [label, *([leaf(inner)] if whole else [leaf(x) for x in inner])]


def is_matrix(engine: Engine, label: Any) -> bool:
    if not isinstance(label, str) or "#" not in label:
        return False
    model, attribute = label.split("::")[-1].split("#")
    found = engine.catalog.model(model).find(attribute)
    return found is not None and found.type == "matrix"


def _leaf_list(c: Column, kind: T.DataType) -> tuple[Column, T.DataType, bool]:
    """(value, its type, whether it is a list): of nested lists all values, flat and without nulls; of nested tables their last column."""
    if isinstance(kind, T.StructType) and kind.names and kind.names[-1].startswith("_"):
        last = kind.names[-1]
        return _leaf_list(c[last], kind[last].dataType)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and kind.elementType.names == ["k", "v"]:
        inner = kind.elementType["v"].dataType
        _, leaf, many = _leaf_list(F.lit(None).cast(inner), inner)
        found = F.transform(c, lambda x: _leaf_list(x["v"], inner)[0])
        return F.filter(F.flatten(F.filter(found, lambda x: x.isNotNull())) if many else found, lambda x: x.isNotNull()), leaf, True
    return c, kind, isinstance(kind, T.ArrayType)


def list_text(c: Column, kind: T.DataType) -> Column:
    """A list as JSON with a blank behind each comma; nothing for an empty one."""
    item = (lambda x: F.when(x.isNull(), F.lit("nil")).otherwise(F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))) if not isinstance(kind, (T.DoubleType, T.LongType, T.IntegerType)) else (lambda x: F.coalesce(number_text(x), F.lit("nil")))
    return F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(F.transform(c, item), ", "), F.lit("]")))


def number_text(c: Column) -> Column:
    """Whole numbers without a fraction."""
    whole = c.cast("decimal(38,0)").cast("string")
    return F.when((F.abs(c) < F.lit(1e15)) & (c.cast("double") == F.floor(c).cast("double")), whole).otherwise(c.cast("string"))


def query_tsv(engine: Engine, question: Sequence, user_columns: Sequence[str] | None = None, expand_matrices: bool = False, transpose: bool = False, **more: Any) -> DataFrame:
    """A question's answer as text columns under the headers of its format or ``user_columns``.

    Headers that repeat get a number behind them, as columns need names of their own; ``user_columns`` must be distinct.
    Nested values are one cell; matrices are one cell, or a column for each of theirs.
    """
    answer = engine.ask(question, **more)
    headers = format_leaves(engine, answer.format)
    names = list(user_columns) if user_columns else [f"{h}~{headers[:i].count(h)}" if h in headers[:i] else h for i, h in enumerate(headers)]
    if len(names) != len(headers):
        raise QuestionError(f"user_columns array must be {len(headers)} elements long")
    form, df = answer.format[1], answer.df
    kind = df.schema["answer"].dataType
    table = not isinstance(form, str) and not is_matrix(engine, form[0]) and isinstance(kind, T.StructType)
    parts = [(F.col("answer")[n], kind[n].dataType, f) for n, f in zip(kind.names, form, strict=True)] if table else [(F.col("answer"), kind, form)]
    if not table and len(headers) != 2:  # a nested list under its record: its label, and what it leads to
        parts = [(F.transform("answer", lambda x: x["k"]), T.ArrayType(kind.elementType["k"].dataType), "k"), (F.col("answer"), kind, form)]
    out = [F.coalesce(F.col("identifier").cast("string"), F.lit("")).alias(names[0])]
    for name, (c, t, f) in zip(names[1:], parts, strict=True):
        value, leaf, many = _leaf_list(c, t)
        if isinstance(f, list) and is_matrix(engine, f[0]) and expand_matrices:
            out += [F.coalesce(number_text(F.get(value, i)), F.lit("")).alias(f"{name}.{n}") for i, n in enumerate(f[1])]
        elif many:
            out.append(F.coalesce(list_text(value, leaf.elementType if isinstance(leaf, T.ArrayType) else leaf), F.lit("")).alias(name))
        elif isinstance(leaf, T.StructType):
            out.append(F.coalesce(value["url"].cast("string") if "url" in leaf.names else F.to_json(value), F.lit("")).alias(name))
        else:
            out.append(F.coalesce(number_text(value) if isinstance(leaf, T.DoubleType) else value.cast("string"), F.lit("")).alias(name))
    rows = df.select(*out)
    return transposed(rows.select(F.col(f"`{names[0]}`").alias("__by"), *(F.col(f"`{n}`") for n in rows.columns))) if transpose else rows
