"""Answers as TSV, options of retrieval, and the plans of questions."""

import io
from contextlib import redirect_stdout

import pytest

from labors import TWELVE, engine
from stemma import queries
from stemma.errors import QuestionError
from stemma.plans.retrieve import Request, Retrieval, format_leaves, query_tsv

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labors(spark):
    return engine(
        spark,
        project=[{"name": TWELVE}],
        labor=[{"name": "Belt", "number": 9, "project_id": 1, "contributions": [10.0, 11.0, 12.0, 13.0]}, {"name": "Cattle", "number": 10, "project_id": 1, "contributions": [20.0, 21.0, 22.0, 23.5]}, {"name": "Apples", "number": 11, "project_id": 1}],
        monster=[{"name": "Nemean Lion", "labor_id": 1}, {"name": "Lernean Hydra", "labor_id": 2}],
        victim=[{"name": "Jane", "monster_id": 1}, {"name": "John", "monster_id": 1}, {"name": "Sue", "monster_id": 2}],
        wound=[{"victim_id": 1, "location": "Head", "severity": 4}, {"victim_id": 1, "location": "Arm", "severity": 2}, {"victim_id": 2, "location": "Arm", "severity": 5}],
    )


def tsv(labors, q, **more):
    df = query_tsv(labors, q, **more)
    return [df.columns, *sorted(map(list, df.collect()))]


SLICES = ["labor", "::all", ["number", ["contributions", "::slice", ["Athens", "Sparta"]], ["contributions", "::slice", ["Thebes"]]]]


def test_matrices(labors):
    names = ["labor", "number", "first", "second"]
    assert tsv(labors, SLICES, user_columns=names, expand_matrices=True) == [["labor", "number", "first.Athens", "first.Sparta", "second.Thebes"], ["Apples", "11", "", "", ""], ["Belt", "9", "10", "11", "13"], ["Cattle", "10", "20", "21", "23.5"]]
    assert tsv(labors, SLICES, user_columns=names)[2:] == [["Belt", "9", "[10, 11]", "[13]"], ["Cattle", "10", "[20, 21]", "[23.5]"]]
    head = tsv(labors, ["labor", "::all", ["number", ["contributions", "::slice", ["Athens"]]]], expand_matrices=True)[0]
    assert head == ["labors::labor#name", "labors::labor#number", "labors::labor#contributions.Athens"]
    with pytest.raises(QuestionError, match="must be 4 elements long"):
        query_tsv(labors, SLICES, user_columns=["a"])


def test_nested_values_are_one_cell_and_empty_lists_blank(labors):
    q = ["victim", "::all", [["wound", ["location", "::equals", "Head"], "::all", "severity"], ["wound", ["location", "::equals", "Arm"], "::all", "severity"]]]
    assert tsv(labors, q) == [["labors::victim#name", "labors::wound#severity", "labors::wound#severity~1"], ["Jane", "[4]", "[2]"], ["John", "", "[5]"], ["Sue", "", ""]]
    deep = ["monster", "::all", [["labor", "number"], ["victim", "::all", "wound", "::all", "location"]]]
    assert tsv(labors, deep)[1:] == [["Lernean Hydra", "10", ""], ["Nemean Lion", "9", '["Head", "Arm", "Arm"]']]
    rows = {r.position: (r.column, list(r.cells)) for r in query_tsv(labors, deep, transpose=True).collect()}
    assert rows == {0: ("labors::monster#name", ["Lernean Hydra", "Nemean Lion"]), 1: ("labors::labor#number", ["10", "9"]), 2: ("labors::wound#location", ["", '["Head", "Arm", "Arm"]'])}
    assert tsv(labors, ["labor", "::all", "number"])[1:] == [["Apples", "11"], ["Belt", "9"], ["Cattle", "10"]]


def test_leaves(labors):
    names = "labors::project#name", "labors::labor#name", "labors::victim#name", "labors::wound#id"
    assert format_leaves(labors, [names[0], [[names[1], [names[2], names[2]]], [names[1], [names[2], "labors::victim#country"]]]]) == [names[0], names[2], "labors::victim#country"]
    assert format_leaves(labors, [names[0], ["labors::labor#number", names[2], [names[2], [names[3], "labors::wound#location"]]]])[1:] == ["labors::labor#number", names[2], "labors::wound#location"]
    assert format_leaves(labors, [names[0], [names[1], ["labors::labor#contributions", ["Athens"]]]]) == [names[0], names[1], "labors::labor#contributions"]


def test_retrieval_options(labors):
    r = Retrieval(labors, Request("labor", attribute_names=["number", "prize", "contributions"], output_predicate="contributions[]Sparta", expand_matrices=True, format="tsv"))
    assert r.tsv().columns == ["name", "number", "contributions.Sparta"] and sorted(map(tuple, r.tsv().collect()))[0] == ("Apples", "11", "")
    turned = Retrieval(labors, Request("labor", attribute_names=["number"], transpose=True)).tsv()
    assert {x.column: list(x.cells) for x in turned.collect()} == {"name": ["Apples", "Belt", "Cattle"], "number": ["11", "9", "10"]}
    assert "template" not in Retrieval(labors, Request("labor", hide_templates=True)).payload()["models"]["labor"]
    with pytest.raises(QuestionError):
        Request("labor", format="xml").check()


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    known = queries.queries()
    up = plan(known["up_quantifier"](spark, SF)).split("(1)")[0]
    assert up.count("Scan parquet") - up.count("BroadcastExchange") <= 4 and "LeftSemi" in up
    e = queries.engine(spark, SF)
    scan = plan(e.ask(["documents", ["n_chars", "::>", 5000], "::count"]).df)
    assert "GreaterThan(n_chars,5000)" in scan
    assert "LeftAnti" in plan(known["lacks_list"](spark, SF))
    shared = plan(known["shared_links"](spark, SF))
    assert shared.split("(1) ")[0].count("Scan parquet") <= 6
    deep = known["page_by_bounds"](spark, SF)
    assert "offset" not in plan(deep).lower()


def test_pages_by_bounds_with_nulls(spark):
    e = engine(spark, project=[{"name": TWELVE}], labor=[{"name": f"L{i:02}", "number": i // 3 if i % 4 else None, "project_id": 1} for i in range(23)])
    want = [r[0] for r in e.ask(["labor", "::all", "number"], order="number").collect()]
    got = [[r[0] for r in a.collect()] for a in e.pages(["labor", "::all", "number"], 5, order="number")]
    assert [len(x) for x in got] == [5, 5, 5, 5, 3] and sum(got, []) == want
    assert [r[0] for r in e.ask(["labor", "::all", "number"], order="number", page=4, page_size=5).collect()] == got[3]
