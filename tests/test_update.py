"""Updates as one operation."""

import datetime
import hashlib
import hmac
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from labors import TWELVE, engine, local
from stemma.catalog import User
from stemma.errors import Forbidden, QuestionError
from stemma.operators import evolve, upsert
from stemma.sources.json_files import catalog_of, read_revisions, revisions_of, template_of
from stemma.sources.tsv import read_tsv

PROJECT = [{"name": TWELVE}]


def update(e, body, **more):
    """The engine with the tables after the update."""
    new = upsert.load(e, revisions_of(e.spark, e.catalog, body), **more)
    return type(e)(e.spark, e.catalog, e.tables | {n: local(e.spark, df.toArrow()) for n, df in new.items()}, e.user)


def links(e, model, *path):
    """{identifier: value} of a path."""
    return {r[0]: r[1] for r in e.ask([model, "::all", *path], show_disconnected=False).collect()} | {r[0]: r[1] for r in e.ask([model, "::all", *path], show_disconnected=True).collect()}


def refused(e, body, message, **more):
    with pytest.raises(QuestionError) as found:
        upsert.load(e, revisions_of(e.spark, e.catalog, body), **more)
    assert str(found.value) == message


def test_parent_lists_make_and_link_children(spark):
    e = update(engine(spark, project=PROJECT), {"project": {TWELVE: {"labor": ["The Nemean Lion", "The Lernean Hydra"]}}})
    rows = e.tables["labor"].orderBy("name").collect()
    assert [(r.name, r.project_id) for r in rows] == [("The Lernean Hydra", 1), ("The Nemean Lion", 1)]
    assert len({r.id for r in rows}) == 2 and all(r.created_at and r.updated_at for r in rows)
    again = update(e, {"project": {TWELVE: {"labor": ["The Nemean Lion"]}}})
    assert {r.name: r.project_id for r in again.tables["labor"].collect()} == {"The Lernean Hydra": None, "The Nemean Lion": 1}


def test_children_move_and_swap(spark):
    labors = [{"name": "Lion", "project_id": 1}, {"name": "Hydra", "project_id": 1}]
    e = engine(spark, project=PROJECT, labor=labors, monster=[{"name": "Lernean Hydra", "labor_id": 1}, {"name": "Nemean Lion", "labor_id": 2}])
    both = update(e, {"labor": {"Hydra": {"monster": "Lernean Hydra"}, "Lion": {"monster": "Nemean Lion"}}})
    assert links(both, "monster", "labor", "::identifier") == {"Lernean Hydra": "Hydra", "Nemean Lion": "Lion"}
    one = update(e, {"labor": {"Hydra": {"monster": "Lernean Hydra"}}})
    assert links(one, "monster", "labor", "::identifier") == {"Lernean Hydra": "Hydra", "Nemean Lion": None}
    made = update(e, {"labor": {"Hydra": {"monster": "Cretan Bull"}}})
    assert links(made, "monster", "labor", "::identifier")["Cretan Bull"] == "Hydra"


def test_lists_within_a_model_and_explicit_revisions(spark):
    e = engine(spark, project=PROJECT, monster=[{"name": "Lernean Hydra"}, {"name": "Ceryneian Hind", "reference_monster_id": 1}])
    read = lambda x: {r.name: r.reference_monster_id for r in x.tables["monster"].collect()}
    implied = update(e, {"monster": {"Lernean Hydra": {"monster_group": ["Nemean Lion"]}}})
    assert read(implied) == {"Lernean Hydra": None, "Ceryneian Hind": None, "Nemean Lion": 1}
    explicit = update(e, {"monster": {"Lernean Hydra": {"monster_group": ["Nemean Lion"]}, "Ceryneian Hind": {"reference_monster": "Nemean Lion"}}})
    new = {r.name: r.id for r in explicit.tables["monster"].collect()}["Nemean Lion"]
    assert read(explicit) == {"Lernean Hydra": None, "Ceryneian Hind": new, "Nemean Lion": 1}


def test_unknown_parents_are_refused_but_those_of_the_request_are_not(spark):
    e = engine(spark, project=PROJECT, monster=[{"name": "Lernean Hydra"}])
    refused(e, {"monster": {"Lernean Hydra": {"labor": "The Lernean Hydra"}}}, "monster.labor 'The Lernean Hydra' does not exist.")
    new = update(e, {"monster": {"Lernean Hydra": {"labor": "The Lernean Hydra"}}, "labor": {"The Lernean Hydra": {"project": TWELVE, "number": 2}}})
    assert links(new, "monster", "labor", "number") == {"Lernean Hydra": 2}
    assert upsert.load(e, revisions_of(spark, e.catalog, {"monster": {"Lernean Hydra": {"species": "x"}}}), dry_run=True) == {}


def test_table_rows_are_appended_replaced_and_addressed_by_key(spark):
    e = engine(spark, project=PROJECT, labor=[{"name": "Lion", "project_id": 1}, {"name": "Apples", "project_id": 1}], prize=[{"name": "hide", "labor_id": 1}, {"name": "discord", "labor_id": 2, "worth": 1}])
    joy = {"name": "joy", "worth": 9}
    read = lambda x: sorted((r.labor_id, r.name, r.worth) for r in x.tables["prize"].collect())
    more = update(e, {"prize": {"::temp1": joy | {"labor": "Apples"}, "::temp2": joy | {"labor": "Apples"}}})
    assert read(more) == [(1, "hide", None), (2, "discord", 1), (2, "joy", 9), (2, "joy", 9)]
    other = update(e, {"labor": {"Apples": {"prize": ["::temp1", "::temp2"]}}, "prize": {"::temp1": joy, "::temp2": joy}})
    assert read(other) == [(1, "hide", None), (2, "joy", 9), (2, "joy", 9)]
    assert read(update(e, {"prize": {2: {"worth": 5}}})) == [(1, "hide", None), (2, "discord", 5)]
    refused(e, {"prize": {77: {"worth": 5}}}, "prize '77' has no backing identifier, could not be loaded.")
    lore = {"type": "String", "value": "leather"}
    codex = engine(spark, project=PROJECT, codex=[{"aspect": "hide", "lore": ("String", "fur")}])
    assert update(codex, {"codex": {1: {"lore": lore}}}).tables["codex"].first().lore.asDict() == lore


def test_repeated_revisions_are_merged(spark):
    e = engine(spark, project=PROJECT, monster=[{"name": "Nemean Lion", "species": "cat"}])
    rows = [("Nemean Lion", "x", 1), ("Nemean Lion", None, 3), ("Nemean Lion", "y", 2), ("Cretan Bull", "bull", 1), ("Cretan Bull", "ox", 2)]
    df = spark.createDataFrame(rows, "name string, species string, at long").repartition(4)
    assert {(r.name, r.species) for r in upsert.load(e, {"monster": df}, order="at")["monster"].collect()} == {("Nemean Lion", None), ("Cretan Bull", "ox")}
    keys = [{r.name: r.id for r in upsert.load(e, {"monster": df.repartition(n)}, order="at")["monster"].collect()} for n in (1, 7)]
    assert keys[0] == keys[1]


def test_validation_on_create_and_rename(spark):
    e = engine(spark, project=PROJECT, monster=[{"name": "nemean lion"}])
    refused(e, {"monster": {"bad name": {"species": "lion"}}}, "On name, 'bad name' is improperly formatted.")
    refused(e, {"monster": {"nemean lion": {"species": "Lion"}}}, "On species, 'Lion' is improperly formatted.")
    assert update(e, {"monster": {"nemean lion": {"name": "Nemean Lion"}}}).tables["monster"].first().name == "Nemean Lion"
    assert update(e, {"monster": {"nemean lion": {"species": "lion"}}}).tables["monster"].first().species == "lion"
    refused(e, {"labor": {"Lion": {"monster": "nemean lion", "project": TWELVE}}}, "On monster, 'nemean lion' is improperly formatted.")
    refused(e, {"labor": {"Lion": {"contributions": [10, 10]}}}, "Improper matrix row size")
    refused(e, {"labor": {"Lion": {"contributions": [1, 2, "x", 4]}}}, "Matrix value is not an array of numbers")
    refused(e, {"project": {TWELVE: {"labor": "Lion"}}}, "Lion is not an Array.")
    refused(e, {"monster": {"Nemean Lion": {"sepcies": "lion"}}}, "monster has no attribute 'sepcies'")


def test_a_project_has_one_record(spark):
    e = engine(spark, project=PROJECT)
    say = f"Project name must match '{TWELVE}'"
    refused(e, {"project": {"The Ten Labors": {}}}, say)
    with pytest.raises(QuestionError, match=say):
        upsert.load(e, revisions_of(spark, e.catalog, {"labor": {"Lion": {"project": "The Ten Labors"}}}))
    assert update(engine(spark), {"project": {"The Ten Labors": {}}}).tables["project"].count() == 1


def test_files(spark):
    e = engine(spark, project=PROJECT, monster=[{"name": "Nemean Lion", "stats": ("store://b/a.tsv", "monster-Nemean Lion-stats.tsv", "a.tsv")}])
    read = lambda x: x.tables["monster"].first()
    set_to = lambda **f: tuple(read(update(e, {"monster": {"Nemean Lion": {"stats": f}}})).stats)
    assert set_to(path="::blank") == ("::blank", "::blank", "::blank")
    assert set_to(path="::temp") == ("store://b/a.tsv", "monster-Nemean Lion-stats.tsv", "a.tsv")
    assert set_to(path=None) == (None, None, None)
    assert set_to(path="store://b/dir.x/file", original_filename="s.csv") == ("store://b/dir.x/file", "monster-Nemean Lion-stats.csv", "s.csv")
    assert set_to(path="store://b/file")[1] == "monster-Nemean Lion-stats.dat"
    many = read(update(e, {"monster": {"Nemean Lion": {"certificates": [{"path": "store://b/1.txt"}, {"path": "store://b/2"}]}}})).certificates
    assert [f.filename for f in many] == ["monster-Nemean Lion-certificates-0.txt", "monster-Nemean Lion-certificates-1.dat"]


def days(name, salt):
    return int(int(hmac.new(salt.encode(), name.encode(), hashlib.sha256).hexdigest(), 16) / 2**256 * 365)


def test_dates_move_by_whole_days_of_the_root_that_the_request_leads_to(spark):
    e = engine(spark, project=PROJECT, labor=[{"name": "Lion", "project_id": 1}, {"name": "Hydra", "project_id": 1}], monster=[{"name": "Nemean Lion", "labor_id": 1}, {"name": "Lernean Hydra"}], victim=[{"name": "Sue", "monster_id": 1}])
    at = datetime.datetime(2020, 1, 1, 12, 30)
    read = lambda x: {r.name: r.arrival for r in x.tables["victim"].collect()}
    stored = update(e, {"victim": {"Sue": {"arrival": at.isoformat()}}}, salt="s")
    assert read(stored) == {"Sue": at - datetime.timedelta(days=days("Lion", "s"))}
    pending = update(e, {"victim": {"Sue": {"arrival": at.isoformat()}}, "monster": {"Nemean Lion": {"labor": "Hydra"}}}, salt="s")
    assert read(pending) == {"Sue": at - datetime.timedelta(days=days("Hydra", "s"))}
    say = "Cannot execute action on {}, because it is not connected to the date_shift_root model, but requires date-shifting."
    refused(e, {"victim": {"Bob": {"arrival": at.isoformat(), "monster": "Lernean Hydra"}}}, say.format("Bob"), salt="s")
    refused(e, {"victim": {"Sue": {"arrival": at.isoformat()}}, "monster": {"Nemean Lion": {"labor": None}}}, say.format("Sue"), salt="s")


def test_censor(spark):
    rows = {"project": PROJECT, "victim": [{"name": "Sue", "restricted": True}, {"name": "Bob"}]}
    e = engine(spark, User(can_edit=True), **rows)
    refused(e, {"victim": {"Sue": {"monster": None}}}, "Cannot revise restricted victim 'Sue'")
    refused(e, {"victim": {"Bob": {"country": "Italy"}}}, "Cannot revise restricted attribute :country on victim 'Bob'")
    refused(e, {"victim": {"Bob": {"restricted": True}}}, "Cannot revise restricted attribute :restricted on victim 'Bob'")
    with pytest.raises(Forbidden):
        upsert.load(engine(spark, User(), **rows), revisions_of(spark, e.catalog, {"victim": {"Bob": {}}}))


def test_all_complaints_are_counted(spark):
    e = engine(spark, project=PROJECT)
    df = spark.createDataFrame([(f"Bad Name{i}", None) for i in range(30)], "name string, species string")
    with pytest.raises(QuestionError, match="and more of 30"):
        upsert.load(e, {"monster": df})


def test_revisions_from_files_are_read_once(spark, tmp_path):
    e = engine(spark, project=PROJECT, labor=[{"name": "Lion", "project_id": 1, "number": 1}], monster=[{"name": "Nemean Lion", "labor_id": 1}, {"name": "Lernean Hydra"}], prize=[{"name": "hide", "labor_id": 1}])
    lines = [{"model": "labor", "record": "Lion", "seq": i, "revision": {"number": i}} for i in range(9)] + [{"model": "labor", "record": "Hydra", "seq": 9, "revision": {}}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: (read.add(1), x)[1]).asNondeterministic()
    r = read_revisions(spark, e.catalog, f"file://{tmp_path}/r.json", ["labor"])["labor"]
    new = upsert.load(e, {"labor": replace(r, rows=r.rows.withColumn("__record", counted("__record")))})
    assert sorted((x.name, x.number) for x in new["labor"].collect()) == [("Hydra", None), ("Lion", 8)]
    assert read.value == len(lines)
    # lists that no row gives change nothing below them
    assert {n: sorted(df.drop("created_at", "updated_at").collect()) for n, df in new.items() if n != "labor"} == {n: sorted(e.tables[n].drop("created_at", "updated_at").collect()) for n in ("monster", "prize")}
    (tmp_path / "l.json").write_text(json.dumps({"model": "labor", "record": "Lion", "revision": {"monster": "Lernean Hydra"}}))
    moved = upsert.load(e, read_revisions(spark, e.catalog, f"file://{tmp_path}/l.json", ["labor"]))
    assert sorted((x.name, x.labor_id) for x in moved["monster"].collect()) == [("Lernean Hydra", 1), ("Nemean Lion", None)]
    assert [(x.name, x.number) for x in moved["labor"].collect()] == [("Lion", 1)] and moved["prize"].count() == 1


def test_sources(spark, tmp_path):
    e = engine(spark, project=PROJECT)
    lines = [{"model": "monster", "record": "Nemean Lion", "seq": 1, "revision": {"species": "cat"}}, {"model": "monster", "record": "Nemean Lion", "seq": 2, "revision": {"species": None}}, {"model": "victim", "record": "Sue", "revision": {"arrival": "2020-01-02T03:04:05Z", "monster": "Nemean Lion"}}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    new = upsert.load(e, read_revisions(spark, e.catalog, f"file://{tmp_path}/r.json", ["monster", "victim"]))
    assert [(r.name, r.species) for r in new["monster"].collect()] == [("Nemean Lion", None)]
    assert [(r.name, r.arrival, r.monster_id is not None) for r in new["victim"].collect()] == [("Sue", datetime.datetime(2020, 1, 2, 3, 4, 5), True)]
    again = catalog_of("labors", json.loads(json.dumps(template_of(e.catalog))))
    assert {n: m.schema() for n, m in again.models.items()} == {n: m.schema() for n, m in e.catalog.models.items()}
    assert again.model("monster").get("species").validation == ("Regexp", "^[a-z ]+$")
    (tmp_path / "p.tsv").write_text("name\tworth\nhide\t3\nskin\tmuch\n")
    with pytest.raises(QuestionError, match="worth: much"):
        read_tsv(spark, f"file://{tmp_path}/p.tsv", e.catalog.model("prize"))
    assert [tuple(r) for r in read_tsv(spark, f"file://{tmp_path}/p.tsv", e.catalog.model("prize"), strict=False).collect()] == [("hide", 3), ("skin", None)]


def test_evolution(spark):
    e = engine(spark, project=PROJECT)
    from stemma.catalog import Attribute as A

    new = e.catalog.add_attribute("prize", A("owner")).add_model("shield", "name", "labor")
    assert ("add_column", "prize", "owner", "string") in evolve.steps(e.catalog, new) and ("create_table", "shield", None, None) in evolve.steps(e.catalog, new)
    assert evolve.conformed(e.tables["prize"], new.model("prize")).schema == new.model("prize").schema()
