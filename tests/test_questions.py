"""Questions, retrieval and upserts on small tables with nulls."""

import datetime
import hmac

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stemma.catalog import Attribute as A
from stemma.catalog import Catalog, Model, User
from stemma.errors import Forbidden, QuestionError
from stemma.functions.columns import shift_days, shifted
from stemma.operators import upsert
from stemma.plans.question import Engine
from stemma.plans.retrieve import Request, Retrieval


@pytest.fixture(scope="module")
def labors(spark):
    labor = Model("labor", (A("name", "identifier"), A("project", "parent"), A("number", "integer"), A("completed", "boolean"), A("prize", "table"), A("monster", "child"), A("contributions", "matrix", options=("Athens", "Sparta"))), identity="name")
    prize = Model("prize", (A("name", "string"), A("worth", "integer"), A("labor", "parent")))
    monster = Model("monster", (A("name", "identifier"), A("labor", "parent"), A("species", "string", validation=("Regexp", "^[a-z ]+$")), A("victim", "collection")), identity="name")
    victim = Model("victim", (A("name", "identifier"), A("monster", "parent"), A("restricted", "boolean"), A("country", "string", restricted=True), A("born", "shifted_date_time")), identity="name")
    project = Model("project", (A("name", "identifier"), A("labor", "collection")), identity="name", root=True)
    cat = Catalog("labors", {m.name: m for m in (project, labor, prize, monster, victim)})
    rows = {
        "project": [(1, "Twelve", None, None)],
        "labor": [(1, "Lion", 1, 1, True, [1.0, 2.0], None, None), (2, "Hydra", 1, 2, None, None, None, None), (3, "Stables", 1, 5, False, [3.0, 4.0], None, None), (4, "Lost", None, 9, True, None, None, None), (5, "Hind", 1, 3, True, None, None, None)],
        "prize": [(1, "poison", 5, 2, None, None), (2, "poop", None, 3, None, None), (3, "iou", 2, 3, None, None), (4, "skin", 1, 1, None, None)],
        "monster": [(1, "Lion", 1, "lion", None, None), (2, "Hydra", 2, "hydra", None, None)],
        "victim": [(1, "John", 1, True, "x", datetime.datetime(2020, 1, 1), None, None), (2, "Jane", 1, None, "y", None, None, None), (3, "Sue", 2, False, None, None, None, None)],
    }
    return Engine(spark, cat, {n: spark.createDataFrame(r, cat.model(n).schema()) for n, r in rows.items()}, User(can_edit=True, can_see_restricted=True))


def names(engine, *q, **more):
    return [r[0] for r in engine.ask(list(q), **more).collect()]


def test_quantifiers(labors):
    every, some = ["prize", ["::has", "worth"], "::every"], ["prize", ["worth", "::>", 3], "::any"]
    assert names(labors, "labor", every, "::all", "::identifier") == ["Hydra", "Lion"]  # Hind has no prizes, one of Stables' is null
    assert names(labors, "labor", some, "::all", "::identifier") == ["Hydra"]
    assert names(labors, "labor", ["::or", some, ["name", "::equals", "Hind"]], "::all", "::identifier") == ["Hind", "Hydra"]
    assert names(labors, "labor", ["prize", "::any"], "::all", "::identifier") == ["Hydra", "Lion", "Stables"]
    assert names(labors, "prize", ["labor", ["name", "::matches", "bles"], "::every"], "::all", "name") == [2, 3]
    assert names(labors, "labor", ["monster", "victim", ["name", "::equals", "Sue"], "::any"], "::all", "::identifier") == ["Hydra"]


def test_lists_counts_and_cells(labors):
    assert labors.ask(["labor", "::all", "prize", "::count"]).collect() == [["Hind", 0], ["Hydra", 1], ["Lion", 1], ["Stables", 2]]
    assert labors.ask(["labor", "::all", "prize", ["worth", "::>", 1], "::all", "worth"]).collect() == [["Hydra", [[1, 5]]], ["Stables", [[3, 2]]]]
    cells = labors.ask(["labor", "::all", [["number"], ["prize", ["worth", "::>", 1], "::first", "worth"]]]).collect()
    assert cells == [["Hind", [3, None]], ["Hydra", [2, 5]], ["Lion", [1, None]], ["Stables", [5, 2]]]
    assert labors.ask(["labor", "::first", "number"]).collect() == 3 and labors.ask(["labor", ["name", "::equals", "no"], "::first", "number"]).collect() is None
    assert labors.ask(["labor", "::distinct", "name"]).collect() == ["Hind", "Hydra", "Lion", "Stables"]
    assert labors.ask(["labor", ["completed", "::untrue"], "::count"]).collect() == 2
    assert names(labors, "labor", "::all", "number", show_disconnected=True) == ["Lost"]


def test_pages(labors):
    assert names(labors, "labor", "::all", "number", order="number", page=2, page_size=2) == ["Hind", "Stables"]
    with pytest.raises(QuestionError, match="Page 4 not found"):
        labors.ask(["labor", "::all", "number"], page=4, page_size=2)
    with pytest.raises(QuestionError, match="greater than 1"):
        labors.ask(["labor", "::all", "number"], page=1, page_size=1)
    assert sum(len(a.collect()) for a in labors.pages(["labor", "::all", "number"], 3)) == 4


def test_matrix(labors):
    assert labors.ask(["labor", ["name", "::in", ["Lion", "Hydra"]], "::all", "contributions"]).collect() == [["Hydra", [None, None]], ["Lion", [1.0, 2.0]]]
    with pytest.raises(QuestionError, match="Invalid slice"):
        labors.ask(["labor", "::all", "contributions", "::slice", ["Thebes"]])


def test_matrix_keeps_the_type_of_its_numbers(labors):
    for kind in ("float", "double"):
        labor = labors.tables["labor"].withColumn("contributions", F.col("contributions").cast(f"array<{kind}>"))
        answer = Engine(labors.spark, labors.catalog, labors.tables | {"labor": labor}, labors.user).ask(["labor", ["name", "::in", ["Lion", "Hydra"]], "::all", "contributions"])
        assert answer.df.schema["answer"].dataType.elementType.simpleString() == kind
        assert answer.collect() == [["Hydra", [None, None]], ["Lion", [1.0, 2.0]]]


def test_restriction(labors):
    viewer = Engine(labors.spark, labors.catalog, labors.tables, User())
    assert names(viewer, "victim", "::all", "::identifier") == ["Jane", "Sue"]
    with pytest.raises(Forbidden):
        viewer.ask(["victim", "::all", "country"])
    assert "country" not in Retrieval(viewer, Request("victim")).documents().columns


@pytest.mark.parametrize("q", [["labor"], ["labor", "::count", "name"], ["labor", "::all", "nothing"], ["labor", ["number", "::matches", "x"], "::all"], ["prize", "::distinct", "worth"], ["nothing", "::all"]])
def test_refused(labors, q):
    with pytest.raises(QuestionError):
        labors.ask(q)


def test_retrieve(labors):
    r = Retrieval(labors, Request("labor", attribute_names=["number", "monster"], filter="number>=3", page=1, page_size=5))
    assert sorted(map(tuple, r.documents().collect())) == [("Hind", "Hind", 3, None), ("Stables", "Stables", 5, None)]
    assert r.payload()["models"]["labor"]["count"] == 2
    with pytest.raises(QuestionError):
        Retrieval(labors, Request("labor", attribute_names=["number"], filter="completed=true")).documents()


def test_load(labors, spark):
    rev = spark.createDataFrame([("Lion", "big cat", None), ("Bird", "marsh bird", "Stables")], "name string, species string, labor string")
    new = upsert.load(labors, {"monster": rev})["monster"]
    assert sorted((r.name, r.species, r.labor_id) for r in new.collect()) == [("Bird", "marsh bird", 3), ("Hydra", "hydra", 2), ("Lion", "big cat", None)]
    for bad in [("Lion", "LION", None), ("Lion", "lion", "Nobody")]:
        with pytest.raises(QuestionError):
            upsert.load(labors, {"monster": spark.createDataFrame([bad], rev.schema)}, dry_run=True)
    lists = upsert.as_revisions(labors.catalog.model("monster"), spark.createDataFrame([("Lion", ["Sue"])], "name string, victim array<string>"))
    moved = upsert.load(labors, {"monster": lists})["victim"]
    assert {r.name: r.monster_id for r in moved.collect()} == {"John": None, "Jane": None, "Sue": 1}


def test_date_shift(spark):
    for name in ("root", "The Nemean Lion", "é"):
        want = int(int(hmac.new(b"salt", name.encode(), "sha256").hexdigest(), 16) / 2**256 * 365)
        at = datetime.datetime(2020, 3, 1, 23, 59, 1)
        got = spark.range(1).select(shift_days(F.lit(name), "salt").alias("d"), shifted(F.lit(at).cast("timestamp_ntz"), F.lit(name), "salt").alias("t")).first()
        assert tuple(got) == (want, at - datetime.timedelta(days=want)) and 0 <= want < 365


def test_catalog_changes(labors):
    cat = labors.catalog.rename_attribute("monster", "labor", "deed")
    assert cat.model("monster").get("deed").stored == "labor_id" and cat.back(cat.model("labor"), cat.model("labor").get("monster")).name == "deed"
    with pytest.raises(QuestionError):
        labors.catalog.apply([("add_model", "x", "name", "labor"), ("add_model", "x", "name", "labor")])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())
