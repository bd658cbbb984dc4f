"""Questions in the path language, compiled to DataFrames.

A question is a nested list: ``[model, filters..., reduction, output...]``. Filters become conditions
on rows (semi and anti joins at the top, left-joined flags below ``::or``), links to one record become
left joins, and every list below a record is aggregated by its foreign key before it is joined, so
that no branch multiplies another. All of it stays lazy; Catalyst chooses join strategies.
"""

from __future__ import annotations

import itertools
import math
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from stemma.catalog import MANY, ONE, UP, Attribute, Catalog, Model, User
from stemma.errors import Forbidden, QuestionError
from stemma.functions.columns import iso_time, matrix_row, matrix_slice, numeric_text, parse_date, to_integer, to_number

QUANTIFIERS = ("::any", "::every")
COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "::<=": lambda c, v: c <= v,
    "::<": lambda c, v: c < v,
    "::>=": lambda c, v: c >= v,
    "::>": lambda c, v: c > v,
    "::=": lambda c, v: c == v,
    "::!=": lambda c, v: c != v,
}
#: For each kind of value, the verbs and what they give, as ``::predicates`` lists them.
PREDICATES = {
    "model": ["::all", "::first", "::count", "::distinct", *QUANTIFIERS],
    "record": ["::identifier", "::has", "::lacks", "::metrics"],
    "string": ["::equals", "::not", "::in", "::notin", "::matches", "::<=", "::<", "::>=", "::>"],
    "number": [*COMPARE, "::in", "::not", "::notin"],
    "date_time": [*COMPARE],
    "boolean": ["::true", "::false", "::untrue"],
    "file": ["::equals", "::not", "::url", "::path", "::original_filename", "::md5", "::updated_at", "::all"],
    "file_collection": ["::url", "::path", "::original_filename", "::md5", "::updated_at", "::all"],
    "match": ["::type", "::value"],
    "matrix": ["::slice"],
}
#: Rows up to the end of a page that is cut off by a sort with limit and offset.
NEAR = 100_000
_names = itertools.count()


def fresh() -> str:
    return f"__{next(_names)}"


def integer_condition(c: Column, verb: str, value: Any) -> Column:
    """A comparison of whole numbers with a bound of their own type, so that it reaches the scan."""
    v = to_integer(value)
    if isinstance(v, int):
        return COMPARE[verb](c, F.lit(v))
    if abs(v) >= 2**63:
        return COMPARE[verb](c.cast("double"), F.lit(v))
    if verb in ("::=", "::!="):
        return F.when(c.isNotNull(), F.lit(verb == "::!="))
    return COMPARE[verb](c, F.lit(math.floor(v) if verb in ("::>", "::<=") else math.ceil(v)))


def scalar_condition(c: Column, a: Attribute, args: Sequence) -> Column:
    """``verb operand`` on a stored value."""
    if not args:
        raise QuestionError(f"{a.name} is not a Boolean")
    verb, *rest = args
    value = rest[0] if rest else None
    if a.type in ("file", "image") and verb in ("::equals", "::not"):
        return c["filename"] == value if verb == "::equals" else c["filename"] != value
    if a.type == "boolean":
        if verb in ("::true", "::false", "::untrue"):
            found = c.eqNullSafe(F.lit(verb != "::false"))
            return ~found if verb == "::untrue" else found
    elif a.type in ("date_time", "shifted_date_time"):
        if verb in COMPARE:
            return COMPARE[verb](c, F.lit(parse_date(value)).cast("timestamp_ntz"))
    elif a.type in ("integer", "float"):
        if verb in COMPARE:
            return integer_condition(c, verb, value) if a.type == "integer" else COMPARE[verb](c, F.lit(to_number(value)))
        if isinstance(value, list) and verb in ("::in", "::not", "::notin"):
            numbers = [to_integer(v) for v in value] if a.type == "integer" else [to_number(v) for v in value]
            numbers = [v for v in numbers if a.type == "float" or isinstance(v, int)]  # no integer is one of the others
            found = c.isin(numbers) if numbers else F.lit(False)
            return found if verb == "::in" else ~found
    elif a.type in ("string", "identifier"):
        if verb == "::matches":
            return c.rlike(value)
        if verb == "::equals":
            return c == F.lit(value)
        if isinstance(value, list) and verb in ("::in", "::not", "::notin"):
            found = c.isin(value) if value else F.lit(False)
            return found if verb == "::in" else ~found
        if verb == "::not":
            return c != F.lit(value)
        if verb in COMPARE and verb not in ("::=", "::!="):
            return COMPARE[verb](numeric_text(c), F.lit(to_number(value)))
    raise QuestionError(f"{verb} is not a valid argument to {a.type} {a.name}")


def not_before(sort: Sequence[Column], first: Sequence) -> Column:
    """Whether a row is not before ``first``, ascending, nulls last; never null."""
    found = F.lit(True)
    for c, v in reversed([*zip(sort, first, strict=True)]):
        found = c.isNull() & found if v is None else c.isNull() | F.coalesce(c > F.lit(v), F.lit(False)) | (F.coalesce(c == F.lit(v), F.lit(False)) & found)
    return found


def shared_folder(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; where that is unset a local master gets a local folder, and on a cluster it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        top = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not context.master.startswith("local"):
                raise QuestionError("set spark.checkpoint.dir to a folder that driver and executors share")
            top = "file://" + tempfile.gettempdir() + "/stemma-checkpoints"
        context.setCheckpointDir(top)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _list(value) -> list:
    if not isinstance(value, (list, tuple)):
        raise QuestionError(f"{value} is not a list")
    return list(value)


@dataclass
class Answer:
    """``df`` has the columns identifier and answer for lists, answer alone otherwise."""

    df: DataFrame
    format: Any
    single: bool

    def collect(self) -> Any:
        """The nested answer; only here rows come to the driver."""
        rows = self.df.collect()
        if self.single:
            return plain(rows[0]["answer"]) if rows else None
        return [[plain(v) for v in r] for r in rows] if len(self.df.columns) > 1 else [plain(r[0]) for r in rows]

    def flat(self, names: Sequence[str]) -> DataFrame:
        """Of a table projection, a column for each part, by the given names."""
        fields = self.df.schema["answer"].dataType.names
        return self.df.select("identifier", *(F.col("answer")[f].alias(n) for f, n in zip(fields, names, strict=True)))


def plain(value: Any) -> Any:
    """Structs and arrays as lists; files and metrics, whose fields have names, as dicts."""
    if isinstance(value, Row):
        named = [f for f in value.__fields__ if not f.startswith("_")]
        return {f: plain(value[f]) for f in named} if named and named != ["k", "v"] else [plain(v) for v in value]
    return [plain(v) for v in value] if isinstance(value, list) else value


@dataclass
class Engine:
    """Answers questions on ``tables`` (a DataFrame for each model of ``catalog``) for ``user``.

    ``metrics``: for each model, named functions from its DataFrame to a column. ``file_metadata``: a
    DataFrame of filename, file_hash and updated_at. ``file_url``: from a filename column to a URL column.
    """

    spark: SparkSession
    catalog: Catalog
    tables: dict[str, DataFrame]
    user: User = field(default_factory=lambda: User(can_see_restricted=True))
    metrics: dict[str, dict[str, Callable[[DataFrame], Column]]] = field(default_factory=dict)
    file_metadata: DataFrame | None = None
    file_url: Callable[[Column], Column] = lambda name: name

    # rows

    def visible(self, model: Model) -> DataFrame:
        """The rows that the user may see: none that is restricted, or has an ancestor that is."""
        df = self.tables[model.name]
        if self.user.can_see_restricted:
            return df
        hidden = self._restricted(model)
        return df if hidden is None else df.join(hidden, model.key, "left_anti")

    def _restricted(self, model: Model) -> DataFrame | None:
        """The keys of restricted rows."""
        df, found = self.tables[model.name], []
        if own := model.find("restricted"):
            found.append(df.where(F.col(own.stored).eqNullSafe(F.lit(True))).select(model.key))
        if up := model.parent:
            above = self.catalog.model(up.model)
            if (more := self._restricted(above)) is not None:
                found.append(df.join(more.withColumnRenamed(above.key, up.stored), up.stored, "left_semi").select(model.key))
        return reduce(DataFrame.unionByName, found) if found else None

    def _connected(self, df: DataFrame, model: Model, yes: bool = True) -> DataFrame:
        """The rows of ``df`` that have a parent at every level, or those that don't."""
        if not (up := model.parent):
            return df if yes else df.where(F.lit(False))
        above = self.catalog.model(up.model)
        if not above.parent:
            return df.where(F.col(up.stored).isNotNull() if yes else F.col(up.stored).isNull())
        keys = self._connected(self.tables[above.name], above).select(F.col(above.key).alias(up.stored))
        return df.join(keys, up.stored, "left_semi" if yes else "left_anti").select(*df.columns)

    def rows(self, model: Model, filters: Sequence, start: bool = False, show_disconnected: bool = False) -> DataFrame:
        """The rows of a model under a list of filters, all of which must hold."""
        df = self.visible(model)
        if start:
            df = self._connected(df, model, not show_disconnected)
        for f in filters:
            if (keys := self._keys(model, _list(f))) is not None:
                column, found = keys
                df = df.join(found, column, "left_semi").select(*df.columns)
            elif f and f[0] == "::lacks" and len(f) == 2 and model.get(f[1]).type in MANY + ONE:
                column, found = self._keys(model, ["::has", f[1]])
                df = df.join(found, column, "left_anti").select(*df.columns)
            else:
                columns = df.columns
                df, condition = self.condition(df, model, f)
                df = df.where(condition).select(*columns)
        return df

    # filters

    def _keys(self, model: Model, f: list) -> tuple[str, DataFrame] | None:
        """A column of ``model`` and the values of it that a filter leaves, perhaps repeated, for filters that are quantified or ask for a list; others: None."""
        if f and f[0] == "::has" and len(f) == 2 and (a := model.get(f[1])).type in MANY + ONE:
            back = self.catalog.back(model, a)
            child = self.visible(self.catalog.model(a.model))
            return model.key, child.where(F.col(back.stored).isNotNull()).select(F.col(back.stored).alias(model.key))
        if f and f[0] not in ("::and", "::or") and isinstance(f[-1], str) and f[-1] in QUANTIFIERS:
            column, flags = self._quantified(model, f[:-1], f[-1])
            return column, flags.where("flag").select(F.col("k").alias(column))
        return None

    def _held(self, df: DataFrame, keys: tuple[str, DataFrame]) -> tuple[DataFrame, Column]:
        """``df`` with a mark on the rows whose column is among ``keys``."""
        column, found = keys
        name, key = fresh(), fresh()
        marks = found.distinct().select(F.col(column).alias(key), F.lit(True).alias(name))
        return df.join(marks, F.col(column) == F.col(key), "left").drop(key), F.col(name).isNotNull()

    def condition(self, df: DataFrame, model: Model, f: Sequence) -> tuple[DataFrame, Column]:
        """``df``, perhaps with more columns, and whether the filter holds for a row."""
        f = _list(f)
        if not f:
            raise QuestionError("a filter is empty")
        if f[0] in ("::and", "::or"):
            parts = []
            for part in f[1:]:
                df, c = self.condition(df, model, part)
                parts.append(c)
            if not parts:
                raise QuestionError(f"{f[0]} has no filters")
            return df, reduce(lambda x, y: x & y if f[0] == "::and" else x | y, parts)
        if (keys := self._keys(model, f)) is not None:
            return self._held(df, keys)
        if f[0] in ("::has", "::lacks"):
            return self._present(df, model, model.get(f[1]), f[0] == "::has")
        if f[0] == "::identifier":
            a = model.get(model.identity) if model.identity else Attribute(model.key, "integer")
            return df, scalar_condition(F.col(model.identifier), a, f[1:])
        a = self._allowed(model, f[0])
        if a.type in UP + ONE and len(f) > 1:
            other = self.catalog.model(a.model)
            if f[1] in ("::has", "::lacks") or isinstance(f[1], list) or other.find(f[1]) and other.get(f[1]).type in MANY:
                return self._flag(df, model, a, f[1:])
            df, c, last, rest = self._value(df, model, f)
            return df, scalar_condition(c, last, rest)
        if a.type in MANY:
            return self._flag(df, model, a, f[1:])
        return df, scalar_condition(F.col(a.stored), a, f[1:])

    def _allowed(self, model: Model, name: str) -> Attribute:
        a = model.get(name)
        if a.restricted and not self.user.can_see_restricted:
            raise Forbidden(f"Cannot query for restricted attribute {name}")
        return a

    def _value(self, df: DataFrame, model: Model, path: list) -> tuple[DataFrame, Column, Attribute, list]:
        """``df`` with the value at the end of a path of links to one record; its attribute, and what follows."""
        if path[0] == "::identifier":
            a = model.get(model.identity) if model.identity else Attribute(model.key, "integer")
            return df, F.col(model.identifier), a, path[1:]
        a = self._allowed(model, path[0])
        if a.type not in UP + ONE:
            return df, F.col(a.stored), a, path[1:]
        other, name = self.catalog.model(a.model), fresh()
        sub, c, last, rest = self._value(self.visible(other), other, path[1:] or ["::identifier"])
        return self._to_one(df, model, a, sub, {name: c}), F.col(name), last, rest

    def _to_one(self, df: DataFrame, model: Model, a: Attribute, sub: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Left join of columns of the one record that link ``a`` leads to."""
        other, key = self.catalog.model(a.model), fresh()
        by, own = (other.key, a.stored) if a.type in UP else (self.catalog.back(model, a).stored, model.key)
        right = sub.select(F.col(by).alias(key), *(c.alias(n) for n, c in columns.items()))
        if a.type in ONE:
            # of several children the one with the least identifier
            right = sub.select(F.col(by).alias(key), F.col(other.identifier).alias("__by"), *(c.alias(n) for n, c in columns.items())).groupBy(key).agg(*(F.min_by(n, "__by").alias(n) for n in columns))
        return df.join(right, F.col(own) == F.col(key), "left").drop(key)

    def _flag(self, df: DataFrame, model: Model, a: Attribute, f: list) -> tuple[DataFrame, Column]:
        """Whether the filter holds for a record that ``a`` leads to."""
        other, key, name = self.catalog.model(a.model), fresh(), fresh()
        f = f[0] if len(f) == 1 and isinstance(f[0], list) else f
        sub, c = self.condition(self.visible(other), other, f)
        by, own = (other.key, a.stored) if a.type in UP else (self.catalog.back(model, a).stored, model.key)
        right = sub.select(F.col(by).alias(key), c.alias(name)) if a.type in UP else sub.groupBy(F.col(by).alias(key)).agg(F.max(c).alias(name))
        return df.join(right, F.col(own) == F.col(key), "left").drop(key), F.col(name)

    def _present(self, df: DataFrame, model: Model, a: Attribute, has: bool) -> tuple[DataFrame, Column]:
        if a.type in MANY + ONE:
            df, held = self._held(df, self._keys(model, ["::has", a.name]))
            return df, held if has else ~held
        c = F.col(a.stored)
        if has:
            return df, c.isNotNull()
        if a.type in ("file", "image"):
            return df, c.isNull() | c["filename"].isNull() | (c["filename"] == "null")
        return df, c.isNull()

    def _quantified(self, model: Model, args: list, verb: str) -> tuple[str, DataFrame]:
        """A column of ``model`` (its key, or that of a link), and k (a value of it) and flag: whether any, or every, of the last model's rows passes each of the filters.

        No rows: not even ``::every`` holds. A filter that gives null doesn't hold. Models between are
        walked through: one row that leads on is enough.
        """
        names = [x for x in itertools.takewhile(lambda x: isinstance(x, str), args)]
        filters = args[len(names) :]
        if not names:
            raise QuestionError(f"{args} has no model to quantify over")
        a = self._allowed(model, names[0])
        if a.type not in UP + ONE + MANY:
            raise QuestionError(f"{names[0]} does not lead to a model")
        other = self.catalog.model(a.model)
        sub, parts = self.visible(other), []
        if len(names) > 1:
            column, flags = self._quantified(other, [*names[1:], *filters], verb)
            name, key = fresh(), fresh()
            sub = sub.join(flags.select(F.col("k").alias(key), F.col("flag").alias(name)), F.col(column) == F.col(key), "left")
            parts, verb = [F.col(name)], "::any"
        else:
            for f in filters:
                sub, c = self.condition(sub, other, f)
                parts.append(c)
        parts = [F.coalesce(c, F.lit(False)) for c in parts] or [F.lit(True)]
        if a.type in UP:
            return a.stored, sub.select(F.col(other.key).alias("k"), reduce(lambda x, y: x & y, parts).alias("flag"))
        back = self.catalog.back(model, a).stored
        named = {fresh(): c for c in parts}
        fold = F.max if verb == "::any" else F.min  # each filter is quantified for itself
        out = sub.where(F.col(back).isNotNull()).select(F.col(back).alias("k"), *(c.alias(n) for n, c in named.items()))
        out = out.groupBy("k").agg(*(fold(n).alias(n) for n in named))
        return model.key, out.select("k", reduce(lambda x, y: x & y, [F.col(n) for n in named]).alias("flag"))

    # outputs

    def project(self, df: DataFrame, model: Model, args: list, in_table: bool = False) -> tuple[DataFrame, Column, Any]:
        """``df``, the value that ``args`` ask of a record, and its format.

        Filters on a list drop records whose list is empty, but within a table of columns they leave an empty cell.
        """
        label = lambda name: f"{self.catalog.project}::{model.name}#{name}"
        if not args or args == ["::identifier"]:
            return df, F.col(model.identifier), label(model.identity or model.key)
        first, *rest = args
        if isinstance(first, list):
            if not first:
                raise QuestionError("a table needs columns")
            return self._table(df, model, first)
        if first == "::metrics":
            found = [f(df).alias(n) for n, f in self.metrics.get(model.name, {}).items()]
            return df, F.struct(*found) if found else F.lit(None), label("metrics")
        a = self._allowed(model, first)
        if a.type in UP + ONE:
            other, name = self.catalog.model(a.model), fresh()
            sub, c, form = self.project(self.visible(other), other, rest, in_table)
            return self._to_one(df, model, a, sub, {name: c}), F.col(name), form
        if a.type in MANY:
            return self._many(df, model, a, rest, in_table)
        return (*self._scalar(df, a, rest), [label(a.name), self._slice_names(a, rest)] if a.type == "matrix" else label(a.name))

    def _table(self, df: DataFrame, model: Model, columns: list) -> tuple[DataFrame, Column, Any]:
        """Columns that begin with the same link to one record share its join."""
        paths = [[c] if isinstance(c, str) else list(c) for c in columns]
        shared: dict[str, list[int]] = {}
        for i, path in enumerate(paths):
            if path and isinstance(path[0], str) and (a := model.find(path[0])) and a.type in UP + ONE:
                shared.setdefault(path[0], []).append(i)
        cells: dict[int, Column] = {}
        forms: dict[int, Any] = {}
        for i, path in enumerate(paths):
            if i in cells:
                continue
            together = shared.get(path[0], [i]) if path and isinstance(path[0], str) else [i]
            if len(together) == 1:
                df, cells[i], forms[i] = self.project(df, model, path, True)
                continue
            df, c, found = self.project(df, model, [path[0], [paths[j][1:] or ["::identifier"] for j in together]], True)
            for k, j in enumerate(together):
                cells[j], forms[j] = c[f"_{k}"], found[k]
        return df, F.struct(*(cells[i].alias(f"_{i}") for i in range(len(paths)))), [forms[i] for i in range(len(paths))]

    def _slice_names(self, a: Attribute, args: list) -> list[str]:
        return list(args[1]) if args and args[0] == "::slice" else list(a.options)

    def _scalar(self, df: DataFrame, a: Attribute, args: list) -> tuple[DataFrame, Column]:
        c, verb = F.col(a.stored), args[0] if args else None
        if a.type in ("file", "image", "file_collection"):
            return self._files(df, a, verb or "::url")
        if a.type == "matrix" and verb in (None, "::slice"):
            if verb is None:
                return df, matrix_row(c, len(a.options))
            cells = matrix_slice(c, a.options, _list(args[1] if len(args) > 1 else []))
            return df, cells
        if a.type == "match" and verb in (None, "::type", "::value"):
            return df, c[verb[2:]] if verb else c
        if a.type in ("date_time", "shifted_date_time") and verb is None:
            return df, iso_time(c)
        if verb is None:
            return df, c
        # a verb that tells true from false is a value, too
        return df, scalar_condition(c, a, args)

    def _files(self, df: DataFrame, a: Attribute, verb: str) -> tuple[DataFrame, Column]:
        fields = {"::path": lambda f: f["filename"], "::original_filename": lambda f: f["original_filename"], "::url": lambda f: self.file_url(f["filename"])}
        fields["::all"] = lambda f: F.when(f["filename"].isNotNull(), F.struct(fields["::url"](f).alias("url"), f["filename"].alias("path"), f["original_filename"].alias("original_filename")))
        c = F.col(a.stored)
        if verb in fields:
            return df, F.transform(c, fields[verb]) if a.type == "file_collection" else fields[verb](c)
        if verb not in ("::md5", "::updated_at"):
            raise QuestionError(f"{verb} is not a valid argument to {a.type} {a.name}")
        if self.file_metadata is None:
            return df, F.lit(None).cast("string")
        name, value = fresh(), "file_hash" if verb == "::md5" else "updated_at"
        # of several entries of a file the latest
        known = self.file_metadata.groupBy(F.col("filename").alias("__file")).agg(F.max(F.struct("updated_at", "file_hash"))[value].alias(name))
        if a.type != "file_collection":
            return df.join(known, c["filename"] == F.col("__file"), "left").drop("__file"), F.col(name)
        row = fresh()  # lists that are equal have equal answers
        df = df.withColumn(row, F.to_json(c))
        each = df.select(row, c.alias("files")).dropDuplicates([row]).select(row, F.posexplode("files").alias("at", "f"))
        each = each.select(row, "at", F.col("f.filename").alias("__file")).join(known, "__file", "left")
        found = each.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", name))), lambda x: x[name]).alias(name))
        return df.join(found, row, "left"), F.col(name)

    def _split(self, args: list) -> tuple[list, str, list]:
        """(filters, reduction, output) of what follows a model."""
        filters = list(itertools.takewhile(lambda x: isinstance(x, list), args))
        rest = args[len(filters) :]
        if not rest:
            raise QuestionError("a list needs ::all, ::first, ::count, ::distinct, ::any or ::every")
        verb, *output = rest
        if verb not in PREDICATES["model"]:
            raise QuestionError(f"{verb} is not a valid argument to a model")
        if verb in ("::count", *QUANTIFIERS) and output:
            raise QuestionError("Trailing arguments after terminal value!")
        return filters, verb, output

    def _distinct_column(self, model: Model, output: list) -> Column:
        a = self._allowed(model, output[0]) if len(output) == 1 and isinstance(output[0], str) else None
        if a is None or a.type not in ("string", "identifier"):
            raise QuestionError("::distinct needs a string attribute")
        return F.col(a.stored)

    def _many(self, df: DataFrame, model: Model, a: Attribute, args: list, in_table: bool) -> tuple[DataFrame, Column, Any]:
        other, name, key = self.catalog.model(a.model), fresh(), fresh()
        back = self.catalog.back(model, a).stored
        filters, verb, output = self._split(args)
        identity, label = F.col(other.identifier), f"{self.catalog.project}::{other.name}#{other.identity or other.key}"
        count = F.count(F.when(F.col("i").isNotNull(), F.lit(1)))
        if verb == "::every":
            sub, flags = self.visible(other), []
            for f in filters:
                sub, c = self.condition(sub, other, f)
                flags.append(F.coalesce(c, F.lit(False)))
            found = sub.select(F.col(back).alias(key), reduce(lambda x, y: x & y, [identity.isNotNull(), *flags]).alias("ok")).groupBy(key).agg(F.min("ok").alias(name))
            return df.join(found, F.col(model.key) == F.col(key), "left").drop(key), F.coalesce(F.col(name), F.lit(False)), label
        sub, form = self.rows(other, filters), label
        if verb == "::distinct":
            value = self._distinct_column(other, output)
        elif verb in ("::all", "::first"):
            sub, value, inner = self.project(sub, other, output, in_table)
            form = [label, inner] if verb == "::all" else inner
        else:
            value = F.lit(None).cast("int")
        sub = sub.where(F.col(back).isNotNull()).select(F.col(back).alias(key), identity.alias("i"), value.alias("v"))
        folds = {
            "::all": lambda: F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct(F.col("i").alias("k"), F.col("v").alias("v"))))),
            "::first": lambda: F.min_by(F.struct("v"), F.when(F.col("i").isNotNull(), F.col("i")))["v"],
            "::count": lambda: count,
            "::any": lambda: count > 0,
            "::distinct": lambda: F.sort_array(F.collect_set("v")),
        }
        found = sub.groupBy(key).agg(folds[verb]().alias(name))
        drops = filters and not in_table and verb in ("::all", "::first")
        df = df.join(found, F.col(model.key) == F.col(key), "inner" if drops else "left").drop(key)
        empty = {"::all": lambda c: F.coalesce(c, F.array()), "::distinct": lambda c: F.coalesce(c, F.array()), "::count": lambda c: F.coalesce(c, F.lit(0).cast("long")), "::any": lambda c: F.coalesce(c, F.lit(False))}
        return df, empty.get(verb, lambda c: c)(F.col(name)), form

    # questions

    def ask(self, question: Sequence, order: str | None = None, page: int | None = None, page_size: int | None = None, show_disconnected: bool = False, bounds: DataFrame | None = None) -> Answer:
        if not self.user.can_view:
            raise Forbidden("You are not allowed to view this project")
        question = _list(question)
        if question == ["::predicates"]:
            return self._listing([[k, v] for k, v in PREDICATES.items()], "k string, v array<string>")
        if question == ["::model_names"]:
            return self._listing([[n] for n in sorted(self.catalog.models)], "k string")
        model = self.catalog.model(question[0])
        if question[1:] == ["::attribute_names"]:
            return self._listing([[a.name] for a in model], "k string")
        filters, verb, output = self._split(question[1:])
        identity, label = F.col(model.identifier), f"{self.catalog.project}::{model.name}#{model.identity or model.key}"
        if verb == "::every":
            df, flags = self.rows(model, [], True, show_disconnected), []
            for f in filters:
                df, c = self.condition(df, model, f)
                flags.append(F.coalesce(c, F.lit(False)))
            ok = reduce(lambda x, y: x & y, [identity.isNotNull(), *flags])
            return Answer(df.agg(F.coalesce(F.min(ok), F.lit(False)).alias("answer")), label, True)
        df = self.rows(model, filters, True, show_disconnected)
        if verb == "::count":
            return Answer(df.agg(F.count(identity).alias("answer")), label, True)
        if verb == "::any":
            return Answer(df.agg((F.count(identity) > 0).alias("answer")), label, True)
        if verb == "::distinct":
            c = self._distinct_column(model, output)
            return Answer(df.where(c.isNotNull()).select(c.alias("answer")).distinct().orderBy("answer"), label, False)
        sort = self._sort(model, order)
        df = df.where(identity.isNotNull())
        if page_size is not None:
            df = self._page(df, sort, page or 1, page_size, bounds)
        if verb == "::first":
            df = df.orderBy(*(c.asc_nulls_last() for c in sort)).limit(1)
        df, value, form = self.project(df, model, output)
        out = df.select(identity.alias("identifier"), value.alias("answer"), *(c.alias(f"__order{i}") for i, c in enumerate(sort[:-1])))
        if verb == "::first":
            return Answer(out.select("answer"), form, True)
        out = out.orderBy(*(F.col(f"__order{i}").asc_nulls_last() for i in range(len(sort) - 1)), F.col("identifier").asc_nulls_last())
        return Answer(out.select("identifier", "answer"), [label, form], False)

    def _page(self, df: DataFrame, sort: list[Column], page: int, page_size: int, bounds: DataFrame | None = None) -> DataFrame:
        """The rows of a page: those between its first row and the next page's.

        ``bounds`` are sought by one distributed sort of all keys. A page near the beginning, of which no task has
        to hold more than NEAR rows, is simply cut off there.
        """
        if page_size < 2:
            raise QuestionError("Page size must be greater than 1")
        if page < 1:
            raise QuestionError("Page must start at 1")
        if bounds is None and page * page_size <= NEAR:
            firsts = df.select(*(c.alias(f"s{i}") for i, c in enumerate(sort))).orderBy(*(F.col(f"s{i}").asc_nulls_last() for i in range(len(sort)))).limit(page * page_size + 1).offset((page - 1) * page_size).collect()
            # at most two pages; of those only the first rows are needed
            found = {page: firsts[0]} if firsts else {}
            if len(firsts) > page_size:
                found[page + 1] = firsts[page_size]
        else:
            bounds = self._bounds(df, sort, page_size) if bounds is None else bounds
            found = {r["page"]: r[1:] for r in bounds.where(F.col("page").isin(page, page + 1)).collect()}
        if page not in found:
            raise QuestionError(f"Page {page} not found")
        df = df.where(not_before(sort, found[page]))
        return df.where(~not_before(sort, found[page + 1])) if page + 1 in found else df

    def _bounds(self, df: DataFrame, sort: list[Column], page_size: int) -> DataFrame:
        """page and its first row's sort columns, a row for each page; written once, as ranks depend on how ranges were drawn."""
        names = [f"s{i}" for i in range(len(sort))]
        order = [F.col(n).asc_nulls_last() for n in names]
        keys = df.select(*(c.alias(n) for c, n in zip(sort, names, strict=True))).repartitionByRange(*order).sortWithinPartitions(*order)
        placed = checkpointed(keys.withColumn("m", F.monotonically_increasing_id()))
        placed = placed.select(*names, F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("i"))
        sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
        before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        rank = F.col("before") + F.col("i")
        firsts = placed.join(F.broadcast(before), "part").where(rank % page_size == 0)
        return checkpointed(firsts.select((rank / page_size + 1).cast("long").alias("page"), *names))

    def pages(self, question: Sequence, page_size: int, order: str | None = None, show_disconnected: bool = False):
        """The answers of all pages, one after the other; the bounds of all pages are sought once."""
        model = self.catalog.model(question[0])
        filters, *_ = self._split(list(question[1:]))
        df = self.rows(model, filters, True, show_disconnected)
        sort = self._sort(model, order)
        bounds = self._bounds(df.where(F.col(model.identifier).isNotNull()), sort, page_size) if page_size > 1 else None
        for page in itertools.count(1):
            try:
                yield self.ask(question, order, page, page_size, show_disconnected, bounds)
            except QuestionError as e:
                if page > 1 and str(e) == f"Page {page} not found":
                    return
                raise

    def _sort(self, model: Model, order: str | None) -> list[Column]:
        """By attribute ``order``, if it is one with a value, and by identity."""
        by = model.find(order) if order else None
        return [*([F.col(by.stored)] if by and by.type not in MANY + ONE else []), F.col(model.identifier)]

    def _listing(self, rows: list, schema: str) -> Answer:
        return Answer(self.spark.createDataFrame(rows, schema), None, False)
