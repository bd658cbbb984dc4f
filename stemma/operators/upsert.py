"""Revisions of records as one operation: merged, linked, checked and written into new tables.

A model's revisions are rows of ``__record`` (the identifier as text, the key of models without one, or
``::temp...`` for a new row of those), ``__seq``, ``__given`` (the names of the attributes that the row
revises; a null among them is a value) and a column for each attribute. Links are given by identifier,
collections and tables as lists of them, files as (path, original_filename).

Of repeated revisions of a record the last one counts, attribute by attribute. Lists of children
become revisions of the children: those named are linked (and made, where they are new), those that
were linked before and aren't named lose their link, or, in tables, their place. What a child's own
revision says wins over what follows from lists. All complaints are found before anything is written;
the result is a new table for each model, which the caller writes to a new place and swaps.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.catalog import FILE, MANY, ONE, TYPES, UP, Attribute, Model
from stemma.errors import Forbidden, QuestionError
from stemma.functions.columns import shifted
from stemma.plans.question import Engine, checkpointed, fresh

FILES = ("file", "image")
GIVEN_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "original_filename")])
#: Hash buckets in which new records are numbered, each for itself.
KEY_BUCKETS = 4096
BLANK, TEMP = "::blank", "::temp"


def given_type(a: Attribute) -> T.DataType:
    """The type in which revisions give an attribute."""
    if a.type in UP + ONE:
        return T.StringType()
    if a.type in MANY:
        return T.ArrayType(T.StringType())
    if a.type in FILES:
        return GIVEN_FILE
    return T.ArrayType(GIVEN_FILE) if a.type == "file_collection" else TYPES[a.type]


@dataclass(frozen=True)
class Revisions:
    """Rows of a model's revisions, and the attributes that they may revise."""

    rows: DataFrame
    names: tuple[str, ...]


def as_revisions(model: Model, df: DataFrame, order: str | None = None) -> Revisions:
    """A table whose columns are attributes: each row revises all of them. ``order`` is a column by which repeated revisions follow each other; without one the greatest value of each attribute counts.

    Records are known by ``__record`` or else by the column of the identifier.
    """
    who = "__record" if "__record" in df.columns else model.identity or model.key
    names = tuple(c for c in df.columns if c not in (who, order))
    cells = []
    for name in names:
        if a := model.find(name):
            kind = given_type(a)
            have = df.schema[name].dataType
            cells.append((F.col(name) if have == kind or isinstance(kind, (T.StructType, T.ArrayType)) else F.col(name).cast(kind)).alias(name))
    seq = F.col(order).cast("long") if order else F.lit(0).cast("long")
    given = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return Revisions(df.select(F.col(who).cast("string").alias("__record"), seq.alias("__seq"), given.alias("__given"), *cells), names)


def merged(model: Model, revisions: Revisions) -> Revisions:
    """One row for each record: of each attribute the last value that is given, null or not; names that no attribute has in ``__unknown``."""
    known = [n for n in revisions.names if model.find(n)]
    aggregates, flags = [], []
    for i, name in enumerate(known):
        has = F.array_contains("__given", name)
        aggregates.append(F.max(F.when(has, F.struct("__seq", F.col(name).alias("v")))).alias(f"__v{i}"))
        flags.append(F.when(F.col(f"__v{i}").isNotNull(), F.lit(name)))
    unknown = F.collect_set(F.array_except("__given", F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
    out = revisions.rows.groupBy("__record").agg(*aggregates, F.array_distinct(F.flatten(unknown)).alias("__unknown"))
    given = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return Revisions(out.select("__record", given.alias("__given"), "__unknown", *(F.col(f"__v{i}")["v"].alias(n) for i, n in enumerate(known))), tuple(known))


def has(name: str) -> Column:
    return F.array_contains("__given", name)


def violation(a: Attribute, c: Column) -> Column | None:
    """A complaint where a value breaks the attribute's validation, else null.

    Validations: ("Array", values), ("Range", begin, end, exclusive), ("Regexp", pattern) or ("Null",), under which everything passes.
    """
    if a.type == "matrix":
        return F.when(F.exists(c, lambda x: x.isNull()), F.lit("Matrix value is not an array of numbers")).when(F.size(c) != len(a.options), F.lit("Improper matrix row size"))
    if a.type == "match":
        return F.when(c.isNotNull() & (c["type"].isNull() | c["value"].isNull()), F.concat(F.to_json(c), F.lit(" is not like { type, value }.")))
    if not a.validation or a.validation[0] == "Null":
        return None
    kind, *args = a.validation
    text = F.coalesce(c.cast("string"), F.lit(""))
    if kind == "Array":
        bad, say = ~c.cast("string").isin([str(v) for v in args[0]]), F.concat(F.lit("'"), text, F.lit("' should be one of " + ", ".join(map(str, args[0])) + "."))
    elif kind == "Range":
        low, high, open_end = (*args, False)[:3]
        tests = ([c < low] if low is not None else []) + ([c >= high if open_end else c > high] if high is not None else [])
        bad = reduce(lambda x, y: x | y, tests, F.lit(False))
        say = F.concat(text, F.lit(f" should be greater than or equal to {low} and {'less than' if open_end else 'less than or equal to'} {high}."))
    elif kind == "Regexp":
        bad, say = ~c.cast("string").rlike(args[0]), F.concat(F.lit("'"), text, F.lit(f"' should be like '{a.format_hint}'." if a.format_hint else "' is improperly formatted."))
    else:
        raise QuestionError(f"{kind} is not a validation")
    return F.when(c.isNotNull() & bad, F.concat(F.lit(f"On {a.name}, "), say))


def link_violation(engine: Engine, a: Attribute, c: Column) -> Column | None:
    """A complaint where an identifier breaks the validation of the model that it names a record of."""
    other = engine.catalog.model(a.model)
    of = other.find(other.identity) if other.identity else None
    if of is None or not of.validation:
        return None
    wrong = violation(replace(of, name=a.name), c)
    return wrong if wrong is None else F.when(~F.startswith(c, F.lit("::")), wrong)


def extension(path: Column) -> Column:
    """With its full stop; empty if there is none."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def file_entry(model: Model, a: Attribute, record: Column, given: Column, i: Column | None = None) -> Column:
    """What is stored of a file: its place and the name by which it will be known; blank files stay blank, a path without a scheme takes the file away."""
    ext = F.coalesce(*(F.when(extension(given[n]) != "", extension(given[n])) for n in ("path", "original_filename")), F.lit(".dat"))
    name = F.concat(F.lit(f"{model.name}-"), record, F.lit(f"-{a.name}"), *([F.lit("-"), i.cast("string")] if i is not None else []), ext)
    blank, stored = given["path"] == BLANK, given["path"].rlike("^[a-z][a-z0-9+.-]*://")

    def cell(at_blank: Column, at_stored: Column) -> Column:
        return F.when(blank, at_blank).when(stored, at_stored)

    return F.struct(cell(F.lit(BLANK), given["path"]).alias("location"), cell(F.lit(BLANK), name).alias("filename"), cell(F.lit(BLANK), given["original_filename"]).alias("original_filename")).cast(FILE)


def matches(value: Column, rule: Column) -> Column:
    """Whether a text fits a dictionary's rule, a struct of type and value (JSON): String, Number, Array, Range or Regexp."""
    kind, raw = rule["type"], rule["value"]
    plain = F.regexp_replace(raw, r'\A"|"\z', "")
    numbers = F.from_json(raw, "array<double>")
    number = value.try_cast("double")
    return F.coalesce(
        F.when(kind == "String", value == plain)
        .when(kind == "Number", number == raw.try_cast("double"))
        .when(kind == "Array", F.array_contains(F.from_json(raw, "array<string>"), value))
        .when(kind == "Range", (number >= F.get(numbers, 0)) & (number <= F.get(numbers, 1)))
        .when(kind == "Regexp", F.regexp_like(value, plain)),
        F.lit(False),
    )


def unmatched(engine: Engine, model: Model, revisions: DataFrame) -> DataFrame:
    """The revisions that no entry of the model's dictionary allows: all mapped attributes must fit one entry."""
    name, pairs = model.dictionary
    entries, rules = engine.tables[name], engine.catalog.model(name)
    tests = []
    for mine, theirs in pairs:
        rule = F.col(f"d.{rules.get(theirs).stored}")
        c = F.col(f"r.{mine}")
        tests.append(matches(c.cast("string"), rule) if rules.get(theirs).type == "match" else rule == c)
    return revisions.alias("r").join(entries.alias("d"), reduce(lambda x, y: x & y, tests), "left_anti")


def numbered(new: DataFrame, top: DataFrame) -> DataFrame:
    """``new`` (of distinct ``__record``) with ``__key``: numbers above the one in ``top``, the same whatever the partitioning.

    Records are ranked within hash buckets; the buckets' sizes, KEY_BUCKETS rows, give where each begins.
    """
    bucketed = new.withColumn("__bucket", F.pmod(F.xxhash64("__record"), F.lit(KEY_BUCKETS)))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("n"))
    bases = sizes.select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__record"))
    out = bucketed.join(F.broadcast(bases), "__bucket").withColumn("__rank", rank).crossJoin(F.broadcast(top))  # ``top`` is one row
    return out.withColumn("__key", F.col("__top") + F.col("__base") + F.col("__rank")).select("__record", "__key")


def root_of(engine: Engine, model: Model, df: DataFrame) -> DataFrame:
    """``df`` with ``__root``, the identifier of its date shift root record (null if it is disconnected)."""
    path = engine.catalog.shift_path(model)
    if path is None:
        raise QuestionError(f"{model.name} has no date shift root")
    if not path:
        return df.withColumn("__root", F.col(model.identifier))
    out, c, *_ = engine._value(df, model, [*(a.name for a in path), "::identifier"])
    return out.select(*df.columns, c.alias("__root"))


def shift_dates(engine: Engine, model: Model, df: DataFrame, salt: str) -> DataFrame:
    """``df`` with its shifted_date_time attributes moved back by their root record's days."""
    columns = [a.stored for a in model if a.type == "shifted_date_time" and a.stored in df.columns]
    rooted = root_of(engine, model, df)
    return rooted.withColumns({c: shifted(F.col(c), F.col("__root"), salt) for c in columns}).drop("__root")


@dataclass
class Update:
    """Revisions of several models on the tables of ``engine``: merged and resolved on construction, below the checkpoint folder.

    ``salt``: for the models below the date shift root, whose shifted dates are moved before they are stored.
    """

    engine: Engine
    revisions: Mapping[str, Revisions]
    now: Column = field(default_factory=lambda: F.current_timestamp().cast("timestamp_ntz"))
    salt: str | None = None

    def __post_init__(self) -> None:
        if not self.engine.user.can_edit:
            raise Forbidden("You are not allowed to edit this project")
        self.catalog, self.stored = self.engine.catalog, self.engine.tables
        own = {n: merged(self.catalog.model(n), r) for n, r in self.revisions.items()}
        lists = {a.model for n, r in own.items() for a in self.catalog.model(n) if a.type in ONE + MANY and a.name in r.names}
        own = {n: self._given(self.catalog.model(n), r) for n, r in own.items()}
        linked = {n: [replace(r, rows=r.rows.withColumn("__seq", F.lit(0).cast("long")))] for n, r in own.items()}
        self.kept: dict[str, list[tuple[str, DataFrame, DataFrame]]] = {}  # of tables: the stored column of the parent, parents, rows that stay
        for name, r in own.items():
            model = self.catalog.model(name)
            for a in model:
                if a.type in ONE + MANY and a.name in r.names:
                    for child, more in self._links(model, a, r.rows):
                        linked.setdefault(child, []).append(more)
        self.rows: dict[str, Revisions] = {}
        for name, parts in linked.items():
            if name in own and len(parts) == 1:  # merged, and no list adds to it
                self.rows[name] = own[name]
                continue
            names = tuple(dict.fromkeys(n for p in parts for n in p.names))
            union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (p.rows for p in parts))
            again = merged(self.catalog.model(name), Revisions(union.drop("__unknown"), names)).rows.drop("__unknown")
            if "__unknown" in union.columns:
                again = again.join(union.where(F.size("__unknown") > 0).select("__record", "__unknown"), "__record", "left")
            self.rows[name] = Revisions(again, names)
        self.untouched = lists - set(self.rows)  # by lists that no row gives
        self.keyed = {n: self._keyed(self.catalog.model(n), r.rows) for n, r in self.rows.items()}
        # written once: what is checked is what is stored
        self.resolved = {n: checkpointed(self._resolved(self.catalog.model(n), r)) for n, r in self.rows.items()}

    def _given(self, model: Model, r: Revisions) -> Revisions:
        """Merged rows as they are stored, so that the source is read once, and of the names those that a row gives or the dictionary is asked for."""
        rows = checkpointed(r.rows)
        found = {x.name for x in rows.select(F.explode("__given").alias("name")).distinct().collect()}  # names of the model's attributes
        found |= {mine for mine, _ in model.dictionary[1]} if model.dictionary else set()
        names = tuple(n for n in r.names if n in found)
        return Revisions(rows.select("__record", "__given", "__unknown", *names), names)

    def _links(self, model: Model, a: Attribute, rows: DataFrame) -> list[tuple[str, Revisions]]:
        """Revisions of the records below list ``a``: links to those named, and none for those that were linked before."""
        child = self.catalog.model(a.model)
        back = self.catalog.back(model, a)
        listed = rows.where(has(a.name)).select(F.col("__record").alias("__parent"), (F.array(a.name) if a.type in ONE else F.col(a.name)).alias("__children"))
        named = listed.select("__parent", F.explode("__children").alias("__record")).where("__record is not null")
        named = named.groupBy("__record").agg(F.max("__parent").alias(back.name))

        def revised(df: DataFrame, seq: int) -> Revisions:
            return Revisions(df.select("__record", F.lit(seq).cast("long").alias("__seq"), F.array(F.lit(back.name)).alias("__given"), back.name), (back.name,))

        parents = self._identified(model).join(listed.select(F.col("__parent").alias("__record")), "__record", "left_semi").select(F.col("__key").alias("__up"))
        before = self.stored[child.name].join(parents, F.col(back.stored) == F.col("__up"), "left_semi")
        out = [(child.name, revised(named, -1))]
        if a.type == "table":
            stay = named.select("__record")
            self.kept.setdefault(child.name, []).append((back.stored, parents, stay))
        else:
            gone = before.select(F.col(child.identifier).cast("string").alias("__record"), F.lit(None).cast("string").alias(back.name))
            out.append((child.name, revised(gone, -2)))
        return out

    def _identified(self, model: Model) -> DataFrame:
        """__record and __key of the stored records."""
        return self.stored[model.name].select(F.col(model.identifier).cast("string").alias("__record"), F.col(model.key).alias("__key"))

    def _keyed(self, model: Model, rows: DataFrame) -> DataFrame:
        """__record, __key and __new of the revised records; no key for rows of models without identifiers that are neither stored nor temporary."""
        found = rows.select("__record").join(self._identified(model), "__record", "left")
        if model.identity and model.identifier == model.key:
            return found.select("__record", F.coalesce("__key", F.col("__record").try_cast("long")).alias("__key"), F.col("__key").isNull().alias("__new"))
        new = found.where(F.col("__key").isNull())
        if not model.identity:
            new = new.where(F.startswith("__record", F.lit("::")))
        top = self.stored[model.name].agg(F.coalesce(F.max(model.key), F.lit(0)).cast("long").alias("__top"))
        keys = numbered(new.select("__record"), top)
        out = found.withColumnRenamed("__key", "__old").join(keys, "__record", "left")
        return out.select("__record", F.coalesce("__old", "__key").alias("__key"), F.col("__old").isNull().alias("__new"))

    def _resolved(self, model: Model, r: Revisions) -> DataFrame:
        """Merged rows with keys, and for each link the key of the other record (``__fk_...``)."""
        out = r.rows.join(self.keyed[model.name], "__record")
        for a in model:
            if a.type in UP and a.name in r.names:
                other = self.catalog.model(a.model)
                known = self._identified(other)
                if other.name in self.keyed:
                    known = known.unionByName(self.keyed[other.name].where("__new").select("__record", "__key"))
                out = out.join(known.select(F.col("__record").alias(a.name), F.col("__key").alias(f"__fk_{a.name}")), a.name, "left")
        return out

    @property
    def complaints(self) -> DataFrame:
        """model, identifier and complaint; empty if all may be written."""
        found = []
        for name, df in self.resolved.items():
            model, names, user = self.catalog.model(name), self.rows[name].names, self.engine.user
            who = F.col("__record")
            # what a row alone tells is one pass over the rows
            said = [F.when(F.col("__key").isNull(), F.concat(F.lit(f"{name} '"), who, F.lit("' has no backing identifier, could not be loaded.")))]
            lists = []
            if "__unknown" in df.columns:
                lists.append(F.transform("__unknown", lambda u: F.concat(F.lit(f"{name} has no attribute '"), u, F.lit("'"))))  # noqa: B023
            if model.identity and (wrong := violation(model.get(model.identity), who)) is not None:
                said.append(F.when(F.col("__new") & ~has(model.identity), wrong))
            for a in (model.get(n) for n in names):
                c, tests = F.col(a.name), []
                if (a.restricted or a.name == "restricted" or a.type == "shifted_date_time") and not user.can_see_restricted:
                    tests.append(F.concat(F.lit(f"Cannot revise restricted attribute :{a.name} on {name} '"), who, F.lit("'")))
                if a.type in UP:
                    other = self.catalog.model(a.model)
                    tests.append(F.when(c.isNotNull() & F.col(f"__fk_{a.name}").isNull(), F.concat(F.lit(f"{name}.{a.name} '"), c, F.lit("' does not exist."))))
                    if other.single:
                        df, one = self._one(df, other)
                        tests.append(F.when(c != one, F.concat(F.lit(f"{other.name.title()} name must match '"), one, F.lit("'"))))
                if a.type in MANY:
                    if link_violation(self.engine, a, c.cast("string")) is not None:
                        lists.append(F.when(has(a.name), F.transform(c, lambda x: link_violation(self.engine, a, x))))  # noqa: B023
                elif (wrong := link_violation(self.engine, a, c) if a.type in UP + ONE else violation(a, c)) is not None:
                    tests.append(wrong)
                said += [F.when(has(a.name), t) for t in tests]
            if model.single:
                df, one = self._one(df, model)
                said.append(F.when(F.col("__new"), F.concat(F.lit(f"{name.title()} name must match '"), one, F.lit("'"))))
            if not user.can_see_restricted and (hidden := self.engine._restricted(model)) is not None:
                df = df.join(hidden.select(F.col(model.key).alias("__hidden")).distinct(), F.col("__key") == F.col("__hidden"), "left")
                said.append(F.when(F.col("__hidden").isNotNull() & ~F.col("__new"), F.concat(F.lit(f"Cannot revise restricted {name} '"), who, F.lit("'"))))
            every = F.flatten(F.filter(F.array(F.array(*said), *lists), lambda x: x.isNotNull()))
            rows = [df.select("__record", F.explode(every).alias("complaint"))]
            if model.dictionary and all(mine in names for mine, _ in model.dictionary[1]):
                rows.append(unmatched(self.engine, model, df).select("__record", F.lit(f"No matching entries for {model.dictionary[0]}").alias("complaint")))
            if self._shifting(model):
                say = F.concat(F.lit("Cannot execute action on "), who, F.lit(", because it is not connected to the date_shift_root model, but requires date-shifting."))
                rows.append(self._rooted(model).where("__root is null").select("__record", say.alias("complaint")))
            found += [r.where("complaint is not null").select(F.lit(name).alias("model"), F.col("__record").alias("identifier"), "complaint") for r in rows]
        return reduce(DataFrame.unionByName, found).distinct()

    def _one(self, df: DataFrame, model: Model) -> tuple[DataFrame, Column]:
        """``df`` with the identifier of a model's single record, null if there is none yet."""
        name = fresh()
        known = self.stored[model.name].agg(F.min(F.col(model.identifier).cast("string")).alias(name))
        return df.crossJoin(F.broadcast(known)), F.col(name)  # one row

    def _shifting(self, model: Model) -> list[Attribute]:
        return [a for a in model if a.type == "shifted_date_time" and model.name in self.rows and a.name in self.rows[model.name].names and self.salt]

    def _rooted(self, model: Model) -> DataFrame:
        """__record, __key and __root of the records with a new date: the way up goes over the revised tables."""
        later = replace(self.engine, tables=self.stored | {n: self._written(self.catalog.model(n)) for n in self.rows})
        dated = reduce(lambda x, y: x | y, [has(a.name) & F.col(a.name).isNotNull() for a in self._shifting(model)])
        rows = self.resolved[model.name].where(dated).select("__record", "__key")
        return root_of(later, model, later.tables[model.name].join(rows, F.col(model.key) == F.col("__key"))).select("__record", "__key", "__root")

    def _written(self, model: Model) -> DataFrame:
        """The table with its revisions: touched attributes of stored records replaced, new records added; ``created_at`` is never overwritten."""
        old, names = self.stored[model.name], self.rows[model.name].names
        columns = old.columns
        for back, parents, stay in self.kept.get(model.name, []):
            gone = old.join(parents, F.col(back) == F.col("__up"), "left_semi").select(model.key, F.col(model.identifier).cast("string").alias("__record"))
            old = old.join(gone.join(stay, "__record", "left_anti").select(model.key), model.key, "left_anti").select(*columns)
        full = old.join(self.resolved[model.name].select(*(F.col(c).alias(f"__r_{c}") for c in self.resolved[model.name].columns)), F.col(model.key) == F.col("__r___key"), "full_outer")
        hit, given, record = F.col("__r___key").isNotNull(), F.col("__r___given"), F.col("__r___record")
        by_column = {a.stored: a for a in model if a.type not in ONE + MANY}
        out = []
        for c in columns:
            kind, a = old.schema[c].dataType, by_column.get(c)
            value = F.col(c)
            if a and a.name in names:
                new = F.col(f"__r_{'__fk_' if a.type in UP else ''}{a.name}")
                revised = hit & F.array_contains(given, a.name)
                if a.type in FILES:
                    revised = revised & ~F.coalesce(new["path"] == TEMP, F.lit(False))
                    new = file_entry(model, a, record, new)
                elif a.type == "file_collection":
                    new = F.transform(new, lambda f, i: file_entry(model, a, record, f, i))  # noqa: B023
                value = F.when(revised, new.cast(kind)).otherwise(value)
            if c == model.key:
                value = F.coalesce(F.col(c), F.col("__r___key").cast(kind))
            elif c == "updated_at":
                value = F.when(hit, self.now).otherwise(F.col(c))
            elif c == "created_at":
                value = F.coalesce(F.col(c), F.when(hit, self.now))
            elif model.identity and c == model.identifier:
                value = F.coalesce(value, record.cast(kind))
            out.append(value.alias(c))
        return full.select(*out)

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The new tables of the models that are revised."""
        out = {name: self.stored[name] for name in self.untouched}
        for name in self.rows:
            model = self.catalog.model(name)
            df = self._written(model)
            if moved := self._shifting(model):
                roots = self._rooted(model).join(self.resolved[name].select(F.col("__key").alias("__k2"), "__given"), F.col("__key") == F.col("__k2")).select(F.col("__key").alias("__k"), "__root", "__given")
                df = df.join(roots, F.col(model.key) == F.col("__k"), "left").withColumns({a.stored: F.when(F.array_contains("__given", a.name), shifted(F.col(a.stored), F.col("__root"), self.salt)).otherwise(F.col(a.stored)) for a in moved}).select(*df.columns)
            out[name] = df
        return out


def load(engine: Engine, changes: Mapping[str, DataFrame | Revisions], dry_run: bool = False, order: str | None = None, salt: str | None = None, shown: int = 20) -> dict[str, DataFrame]:
    """The new tables after all of ``changes``, or an error with the number of complaints and the first ``shown`` of them; a dry run checks alone."""
    revisions = {n: df if isinstance(df, Revisions) else as_revisions(engine.catalog.model(n), df, order if order in df.columns else None) for n, df in changes.items()}
    update = Update(engine, revisions, salt=salt)
    found = update.complaints.select("complaint").distinct().orderBy("complaint").limit(shown + 1).collect()
    if found:
        more = f"; and more of {update.complaints.count()}" if len(found) > shown else ""
        raise QuestionError("; ".join(r.complaint for r in found[:shown]) + more)
    return {} if dry_run else update.tables
