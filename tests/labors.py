"""A small project for tests: labors, their monsters, victims and prizes."""

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stemma.catalog import Attribute as A
from stemma.catalog import Catalog, Model, User
from stemma.plans.question import Engine

CITIES = ("Athens", "Sparta", "Sidon", "Thebes")
TWELVE = "The Twelve Labors of Hercules"


def catalog():
    return Catalog(
        "labors",
        {
            m.name: m
            for m in (
                Model("project", (A("name", "identifier"), A("labor", "collection"), A("codex", "table")), identity="name", root=True, single=True, date_shift_root=False),
                Model("labor", (A("name", "identifier"), A("project", "parent"), A("number", "integer"), A("monster", "child"), A("prize", "table"), A("contributions", "matrix", options=CITIES)), identity="name", date_shift_root=True),
                Model(
                    "monster",
                    (
                        A("name", "identifier", validation=("Regexp", "^[A-Z][a-z]+ [A-Z][a-z]+$")), A("labor", "parent"), A("species", "string", validation=("Regexp", "^[a-z ]+$")), A("victim", "collection"),
                        A("reference_monster", "link", target="monster"), A("monster_group", "collection", target="monster", via="reference_monster"), A("stats", "file"), A("certificates", "file_collection"),
                    ),
                    identity="name",
                ),
                Model("victim", (A("name", "identifier"), A("monster", "parent"), A("country", "string", restricted=True), A("restricted", "boolean"), A("arrival", "shifted_date_time"), A("wound", "table")), identity="name"),
                Model("wound", (A("victim", "parent"), A("location", "string"), A("severity", "integer"))),
                Model("prize", (A("labor", "parent"), A("name", "string"), A("worth", "integer"))),
                Model("codex", (A("project", "parent"), A("aspect", "string"), A("lore", "match"))),
            )
        },
    )


def plain(kind, value):
    return dict(zip(kind.names, value, strict=True)) if isinstance(kind, T.StructType) and value is not None else value


def local(spark, table):
    """A relation whose size Spark knows."""
    return spark.createDataFrame(table)


def engine(spark, user=None, **rows):
    """``rows``: by model, dicts of stored columns; keys follow their order."""
    cat = catalog()
    tables = {}
    for name, model in cat.models.items():
        schema = model.schema()
        found = [{"id": i + 1} | r for i, r in enumerate(rows.get(name, []))]
        tables[name] = local(spark, pa.Table.from_pylist([{f.name: plain(f.dataType, r.get(f.name)) for f in schema} for r in found], to_arrow_schema(schema)))
    return Engine(spark, cat, tables, user or User(can_edit=True, can_see_restricted=True))
