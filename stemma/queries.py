"""Questions on the test tables, and the SQL that they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.catalog import Attribute as A
from stemma.catalog import Catalog, Model, User
from stemma.functions.columns import iso_time
from stemma.operators import evolve, upsert
from stemma.plans.question import Engine, shared_folder
from stemma.plans.retrieve import Request, Retrieval, query_tsv, tsv_frame
from stemma.sources.json_files import read_revisions
from stemma.sources.tsv import read_tsv, row_counts, unload


def catalog() -> Catalog:
    dims = tuple(f"d{i}" for i in range(64))
    text, number, real = (lambda n: A(n, "string")), (lambda n: A(n, "integer")), (lambda n: A(n, "float"))
    models = [
        Model("region", (A("r_name", "identifier"), A("nation", "collection")), "r_regionkey", "r_name", root=True),
        Model("nation", (A("n_name", "identifier"), A("region", "parent", "n_regionkey"), A("customer", "collection"), A("supplier", "collection")), "n_nationkey", "n_name"),
        Model("customer", (A("c_name", "identifier"), A("nation", "parent", "c_nationkey"), A("orders", "collection"), A("events", "table"), real("c_acctbal"), text("c_mktsegment"), A("restricted", "boolean"), A("referrer", "link", target="customer"), A("referred", "collection", target="customer", via="referrer")), "c_custkey", "c_name"),
        Model("supplier", (A("s_name", "identifier"), A("nation", "parent", "s_nationkey"), A("lineitem", "collection"), real("s_acctbal")), "s_suppkey", "s_name"),
        Model("part", (number("p_partkey"), text("p_name"), text("p_brand"), text("p_type"), number("p_size"), real("p_retailprice"), A("p_flag", "boolean"), A("lineitem", "collection")), "p_partkey", root=True),
        Model("orders", (number("o_orderkey"), A("customer", "parent", "o_custkey"), A("lineitem", "table"), text("o_orderstatus"), real("o_totalprice"), A("o_orderdate", "date_time"), text("o_orderpriority")), "o_orderkey", "o_orderkey"),
        Model("lineitem", (A("orders", "parent", "l_orderkey"), A("part", "link", "l_partkey"), A("supplier", "link", "l_suppkey"), number("l_linenumber"), real("l_quantity"), real("l_extendedprice"), real("l_discount"), text("l_returnflag"), A("l_shipdate", "date_time")), "id"),
        Model("events", (number("event_id"), A("customer", "parent", "user_id"), A("ts", "shifted_date_time"), text("event_type"), real("value"), text("k")), "event_id"),
        Model("embeddings", (number("vec_id"), A("embedding", "matrix", options=dims), number("label")), "vec_id", root=True),
        Model("documents", (number("doc_id"), text("lang"), text("source"), number("n_chars"), A("labels", "child")), "doc_id", root=True),
        Model("pages", (number("page_id"), text("url"), A("snapshot", "file"), A("copies", "file_collection"), A("kind", "match")), "page_id", root=True),
        Model("labels", (A("documents", "parent", "doc_id"), number("quality"), number("toxic")), "doc_id"),
    ]
    return Catalog("warehouse", {m.name: m for m in models})


def engine(spark: SparkSession, sf_dir: str, user: User | None = None) -> Engine:
    cat = catalog()
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in cat.models}
    tables["lineitem"] = tables["lineitem"].withColumn("id", F.xxhash64(*tables["lineitem"].columns))
    tables["events"] = tables["events"].withColumn("k", F.get_json_object("props", "$.k"))
    tables["customer"] = tables["customer"].withColumn("restricted", F.when(F.col("c_acctbal") < 0, F.lit(True)).when(F.col("c_acctbal") < 5000, F.lit(False)))
    tables["customer"] = tables["customer"].withColumn("referrer_id", F.when(F.col("c_custkey") >= 7, F.floor(F.col("c_custkey") / 7)))
    tables["part"] = tables["part"].withColumn("p_flag", F.when(F.col("p_size") % 3 == 0, F.lit(True)).when(F.col("p_size") % 3 == 1, F.lit(False)))
    page, last = F.col("page_id").cast("string"), F.element_at(F.split("url", "/"), -1)

    def file(name: Column) -> Column:
        return F.struct(F.concat(F.lit("store://"), F.col("url")).alias("location"), name.alias("filename"), last.alias("original_filename"))

    snapshot = F.when(F.col("page_id") % 5 > 0, file(F.concat(F.lit("pages-"), page, F.lit("-snapshot.html"))))
    copies = F.array(*(file(F.concat(F.lit("pages-"), page, F.lit(f"-copies-{i}.html"))) for i in range(2)))
    tables["pages"] = tables["pages"].select("page_id", "url", snapshot.alias("snapshot"), copies.alias("copies"), F.struct(F.lit("String").alias("type"), last.alias("value")).alias("kind"))
    names = tables["pages"].select(F.explode(F.flatten(F.array(F.array("snapshot"), F.col("copies")))["filename"]).alias("filename")).where("filename is not null")
    stamps = names.select("filename", F.md5("filename").alias("file_hash"), F.concat(F.lit("2024-01-"), F.lpad((F.length("filename") % 28 + 1).cast("string"), 2, "0")).alias("updated_at"))
    # an older entry of each file, which doesn't count
    metadata = stamps.unionByName(stamps.select("filename", F.lit("old").alias("file_hash"), F.lit("2023-01-01").alias("updated_at")))
    metrics = {"orders": {"expensive": lambda df: F.col("o_totalprice") > 300000, "status": lambda df: F.lower("o_orderstatus")}}
    return Engine(spark, cat, tables, user or User(can_edit=True, can_see_restricted=True), metrics, metadata, lambda name: F.concat(F.lit("https://files.example/"), name))


def holey(spark: SparkSession, sf_dir: str) -> Engine:
    """Without some links: orders that have no customer, customers of a nation that has no region."""
    e = engine(spark, sf_dir)
    orders = e.tables["orders"].withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey")))
    nations = e.tables["nation"].withColumn("n_regionkey", F.when(F.col("n_nationkey") != 3, F.col("n_regionkey")))
    return replace(e, tables=e.tables | {"orders": orders, "nation": nations})


#: name: (question, further arguments, SQL). Of lists the columns are identifier and answer, otherwise answer.
QUESTIONS: dict[str, tuple[list, dict, str]] = {}


def question(name: str, q: list, sql: str, **more) -> None:
    QUESTIONS[name] = (q, more, sql)


_LIST = ["::all", "::identifier"]
question("scan_all", ["region", *_LIST], "SELECT r_name AS identifier, r_name AS answer FROM region")
for _name, _verb, _op in (("ge", "::>=", ">="), ("gt", "::>", ">"), ("le", "::<=", "<="), ("lt", "::<", "<"), ("eq", "::=", "="), ("ne", "::!=", "<>")):
    question(f"number_{_name}", ["lineitem", ["l_quantity", _verb, 45], "::count"], f"SELECT count(*) AS answer FROM lineitem WHERE l_quantity {_op} 45")
question("number_in", ["part", ["p_size", "::in", [1, 5, 9]], "::all", "p_size"], "SELECT p_partkey AS identifier, p_size AS answer FROM part WHERE p_size IN (1, 5, 9)")
question("number_notin", ["part", ["p_size", "::notin", [1, 5, 9]], "::count"], "SELECT count(*) AS answer FROM part WHERE p_size NOT IN (1, 5, 9)")
question("string_equals", ["customer", ["c_mktsegment", "::equals", "BUILDING"], "::all", "c_mktsegment"], "SELECT c_name AS identifier, c_mktsegment AS answer FROM customer WHERE c_mktsegment = 'BUILDING'")
question("string_not", ["customer", ["c_mktsegment", "::not", "BUILDING"], "::count"], "SELECT count(*) AS answer FROM customer WHERE c_mktsegment <> 'BUILDING'")
question("string_in", ["orders", ["o_orderstatus", "::in", ["F", "P"]], "::count"], "SELECT count(*) AS answer FROM orders WHERE o_orderstatus IN ('F', 'P')")
question("string_notin", ["orders", ["o_orderstatus", "::notin", ["F", "P"]], "::count"], "SELECT count(*) AS answer FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
question("string_matches", ["part", ["p_type", "::matches", "^[A-M].*S"], "::all", "p_type"], "SELECT p_partkey AS identifier, p_type AS answer FROM part WHERE regexp_matches(p_type, '^[A-M].*S')")
question("string_as_number", ["events", ["k", "::>", "50"], "::all", "k"], "SELECT event_id AS identifier, json_extract_string(props, '$.k') AS answer FROM events WHERE regexp_full_match(json_extract_string(props, '$.k'), '\\d+(\\.\\d+)?') AND try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 50")
question("date_after", ["orders", ["o_orderdate", "::>", "1997-01-01"], "::all", "o_orderdate"], "SELECT o_orderkey AS identifier, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS answer FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'")
question("boolean_untrue", ["customer", ["restricted", "::untrue"], "::count"], "SELECT count(*) AS answer FROM customer WHERE NOT c_acctbal < 0")
question("boolean_false", ["customer", ["restricted", "::false"], "::count"], "SELECT count(*) AS answer FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000")
question("path_up", ["orders", "::all", "customer", "nation", "region", "r_name"], "SELECT o_orderkey AS identifier, r_name AS answer FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
question("path_filter", ["customer", ["nation", "region", "r_name", "::equals", "ASIA"], *_LIST], "SELECT c_name AS identifier, c_name AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
question("and_or", ["orders", ["::or", ["::and", ["o_orderstatus", "::equals", "F"], ["o_totalprice", "::>", 100000]], ["o_orderpriority", "::matches", "^1"]], "::count"], "SELECT count(*) AS answer FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority LIKE '1%'")
question("has_list", ["orders", ["::has", "lineitem"], "::count"], "SELECT count(*) AS answer FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
question("lacks_list", ["orders", ["::lacks", "lineitem"], *_LIST], "SELECT o_orderkey AS identifier, o_orderkey AS answer FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
question("any_child", ["orders", ["lineitem", ["l_discount", "::>", 0.08], "::any"], *_LIST], "SELECT o_orderkey AS identifier, o_orderkey AS answer FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.08)")
question("every_child", ["orders", ["lineitem", ["l_discount", "::>", 0.02], "::every"], "::all", "o_orderstatus"], "SELECT o_orderkey AS identifier, o_orderstatus AS answer FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(coalesce(l_discount > 0.02, false)))")
question("independent_filters", ["orders", ["lineitem", ["l_discount", "::>", 0.08], ["l_quantity", "::<", 5], "::any"], "::count"], "SELECT count(*) AS answer FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.08) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 5)")
question("same_row", ["orders", ["lineitem", ["::and", ["l_discount", "::>", 0.08], ["l_quantity", "::<", 5]], "::any"], "::count"], "SELECT count(*) AS answer FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.08 AND l_quantity < 5)")
question("nested_quantifiers", ["nation", ["customer", ["orders", ["lineitem", ["l_quantity", "::>", 10], "::every"], "::any"], "::every"], *_LIST], """
  WITH o AS (SELECT l_orderkey AS k FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 10)), c AS (SELECT DISTINCT o_custkey AS k FROM orders JOIN o ON k = o_orderkey),
  n AS (SELECT c_nationkey AS k FROM customer LEFT JOIN c ON k = c_custkey GROUP BY 1 HAVING bool_and(k IS NOT NULL)) SELECT n_name AS identifier, n_name AS answer FROM nation JOIN n ON k = n_nationkey""")
question("through_models", ["nation", ["customer", "orders", ["o_totalprice", "::>", 400000], "::any"], *_LIST], "SELECT DISTINCT n_name AS identifier, n_name AS answer FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000")
question("up_quantifier", ["lineitem", ["orders", ["o_orderstatus", "::equals", "F"], "::any"], "::count"], "SELECT count(*) AS answer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
question("quantifiers_in_or", ["customer", ["::or", ["orders", ["o_totalprice", "::>", 400000], "::any"], ["events", ["value", "::>", 90], "::any"]], *_LIST], "SELECT c_name AS identifier, c_name AS answer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 90)")
question("bare_any", ["orders", ["lineitem", "::any"], "::count"], "SELECT count(DISTINCT l_orderkey) AS answer FROM lineitem")
question("nested_count", ["customer", "::all", "orders", "::count"], "SELECT c_name AS identifier, count(o_orderkey) AS answer FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
question("nested_any", ["customer", "::all", "orders", ["o_orderstatus", "::equals", "P"], "::any"], "SELECT c_name AS identifier, count(o_orderkey) > 0 AS answer FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
question("nested_every", ["customer", "::all", "orders", ["o_totalprice", "::>", 10000], "::every"], "SELECT c_name AS identifier, coalesce(bool_and(o_totalprice > 10000), false) AS answer FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
question("nested_first", ["customer", "::all", "orders", "::first", "o_totalprice"], "SELECT c_name AS identifier, arg_min(o_totalprice, o_orderkey) AS answer FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
question("first", ["customer", ["c_acctbal", "::>", 5000], "::first", "c_acctbal"], "SELECT c_acctbal AS answer FROM customer WHERE c_acctbal > 5000 ORDER BY c_name LIMIT 1")
question("distinct", ["part", "::distinct", "p_brand"], "SELECT DISTINCT p_brand AS answer FROM part WHERE p_brand IS NOT NULL")
question("bool_any", ["orders", ["o_totalprice", "::<", 0], "::any"], "SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice < 0")
question("bool_every", ["orders", ["o_totalprice", "::>", 0], "::every"], "SELECT bool_and(o_totalprice > 0) AS answer FROM orders")
question("count_connected", ["lineitem", "::count"], "SELECT count(*) AS answer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IS NOT NULL")
question("count_disconnected", ["orders", "::count"], "SELECT count(*) AS answer FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IS NULL", show_disconnected=True)
question("order_page", ["orders", "::all", "o_orderstatus"], "SELECT o_orderkey AS identifier, o_orderstatus AS answer FROM orders ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT 100 OFFSET 200", order="o_orderdate", page=3, page_size=100)
question("matrix_slice", ["embeddings", "::all", "embedding", "::slice", ["d0", "d5"]], "SELECT vec_id AS identifier, [embedding[1], embedding[6]] AS answer FROM embeddings")
question("where_filter", ["customer", "::all", "orders", ["o_totalprice", "::>", 400000], "::first", "o_totalprice"], "SELECT c_name AS identifier, arg_min(o_totalprice, o_orderkey) AS answer FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY 1")
question("child_path", ["documents", ["labels", "quality", "::=", 1], "::all", "labels", "toxic"], "SELECT documents.doc_id AS identifier, toxic AS answer FROM documents JOIN labels ON labels.doc_id = documents.doc_id WHERE quality = 1")


question("boolean_true", ["part", ["p_flag", "::true"], "::count"], "SELECT count(*) AS answer FROM part WHERE p_size % 3 = 0")
question("number_fraction", ["part", ["p_size", "::>=", "24.5"], "::count"], "SELECT count(*) AS answer FROM part WHERE p_size >= 24.5")
question("string_matches_some", ["part", ["p_type", "::matches", "^[E-M].*O"], "::all", "p_type"], "SELECT p_partkey AS identifier, p_type AS answer FROM part WHERE regexp_matches(p_type, '^[E-M].*O')")
question("bool_any_true", ["orders", ["o_totalprice", "::>", 400000], "::any"], "SELECT count(*) > 0 AS answer FROM orders WHERE o_totalprice > 400000")
question("has_scalar", ["pages", ["::has", "url"], "::count"], "SELECT count(url) AS answer FROM pages")
question("lacks_link", ["customer", ["::lacks", "referrer"], "::all", "c_mktsegment"], "SELECT c_name AS identifier, c_mktsegment AS answer FROM customer WHERE c_custkey < 7")
question("self_link", ["customer", "::all", "referrer", "referrer", "c_name"], "SELECT c.c_name AS identifier, b.c_name AS answer FROM customer c LEFT JOIN customer a ON a.c_custkey = c.c_custkey // 7 AND c.c_custkey >= 7 LEFT JOIN customer b ON b.c_custkey = a.c_custkey // 7 AND a.c_custkey >= 7")
question("self_collection", ["customer", "::all", "referred", "::count"], "SELECT c.c_name AS identifier, count(b.c_custkey) AS answer FROM customer c LEFT JOIN customer b ON b.c_custkey // 7 = c.c_custkey AND b.c_custkey >= 7 GROUP BY 1")
question("self_quantifier", ["customer", ["referred", ["c_acctbal", "::>", 0], "::every"], *_LIST], "SELECT c.c_name AS identifier, c.c_name AS answer FROM customer c JOIN customer b ON b.c_custkey // 7 = c.c_custkey AND b.c_custkey >= 7 GROUP BY 1 HAVING bool_and(b.c_acctbal > 0)")
question("quantifiers_within", ["customer", ["orders", ["::or", ["lineitem", ["l_discount", "::>", 0.07], "::every"], ["::and", ["o_orderstatus", "::equals", "P"], ["lineitem", ["l_quantity", "::<", 3], "::any"]]], "::any"], *_LIST], """
  SELECT c_name AS identifier, c_name AS answer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (
    o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_discount > 0.07)) OR o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 3)))""")
question("lacks_in_or", ["orders", ["::or", ["::lacks", "lineitem"], ["o_orderstatus", "::equals", "P"]], "::count"], "SELECT count(*) AS answer FROM orders WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
question("up_in_or", ["lineitem", ["::or", ["orders", "customer", ["c_mktsegment", "::equals", "BUILDING"], "::any"], ["l_quantity", "::>", 45]], "::count"], "SELECT count(*) AS answer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR l_quantity > 45")
question("unknown_order", ["customer", "::all", "c_acctbal"], "SELECT c_name AS identifier, c_acctbal AS answer FROM customer ORDER BY c_name LIMIT 50 OFFSET 50", order="no_such_attribute", page=2, page_size=50)
question("file_equals", ["pages", ["snapshot", "::equals", "pages-7-snapshot.html"], "::all", "url"], "SELECT page_id AS identifier, url AS answer FROM pages WHERE page_id = 7")
question("file_lacks", ["pages", ["::lacks", "snapshot"], "::count"], "SELECT count(*) AS answer FROM pages WHERE page_id % 5 = 0")
_SNAPSHOT = "CASE WHEN page_id % 5 > 0 THEN 'pages-' || page_id || '-snapshot.html' END"
question("file_path", ["pages", "::all", "snapshot", "::path"], f"SELECT page_id AS identifier, {_SNAPSHOT} AS answer FROM pages")
question("file_url", ["pages", "::all", "snapshot", "::url"], f"SELECT page_id AS identifier, 'https://files.example/' || {_SNAPSHOT} AS answer FROM pages")
question("file_original", ["pages", "::all", "snapshot", "::original_filename"], "SELECT page_id AS identifier, CASE WHEN page_id % 5 > 0 THEN string_split(url, '/')[-1] END AS answer FROM pages")
question("file_md5", ["pages", "::all", "snapshot", "::md5"], f"SELECT page_id AS identifier, md5({_SNAPSHOT}) AS answer FROM pages")
question("file_updated_at", ["pages", "::all", "snapshot", "::updated_at"], f"SELECT page_id AS identifier, '2024-01-' || lpad((length({_SNAPSHOT}) % 28 + 1)::VARCHAR, 2, '0') AS answer FROM pages")
question("file_collection_path", ["pages", "::all", "copies", "::path"], "SELECT page_id AS identifier, ['pages-' || page_id || '-copies-0.html', 'pages-' || page_id || '-copies-1.html'] AS answer FROM pages")
question("file_collection_md5", ["pages", "::all", "copies", "::md5"], "SELECT page_id AS identifier, [md5('pages-' || page_id || '-copies-0.html'), md5('pages-' || page_id || '-copies-1.html')] AS answer FROM pages")
question("match_type", ["pages", "::all", "kind", "::type"], "SELECT page_id AS identifier, 'String' AS answer FROM pages")
question("match_value", ["pages", "::all", "kind", "::value"], "SELECT page_id AS identifier, string_split(url, '/')[-1] AS answer FROM pages")
question("matrix_bare", ["embeddings", ["label", "::=", 1], "::all", "embedding"], "SELECT vec_id AS identifier, embedding AS answer FROM embeddings WHERE label = 1")
question("attribute_names", ["region", "::attribute_names"], "SELECT unnest(['r_name', 'nation']) AS k")
question("model_names", ["::model_names"], "SELECT unnest(['customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS k")


def _asked(q: list, more: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).ask(q, **more).df


def connected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a parent at every level, where some lack one."""
    return holey(spark, sf_dir).ask(["orders", "::all", "o_orderstatus"]).df


def disconnected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holey(spark, sf_dir).ask(["orders", "::all", "customer", "c_name"], show_disconnected=True).df


def quantified_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that gives null doesn't hold: customers all of whose referred customers have a nation in a region."""
    return holey(spark, sf_dir).ask(["customer", ["referred", ["nation", "region", "r_name", "::not", "ASIA"], "::every"], "::all", "::identifier"], show_disconnected=False).df


def page_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that ``order_page`` cuts off, by the bounds of all pages."""
    e = engine(spark, sf_dir)
    orders = e.catalog.model("orders")
    bounds = e._bounds(e.rows(orders, [], True), e._sort(orders, "o_orderdate"), 100)
    return e.ask(["orders", "::all", "o_orderstatus"], "o_orderdate", 3, 100, bounds=bounds).df


def metrics_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).ask(["orders", "::all", "::metrics"]).df.select("identifier", "answer.*")


def shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns by one link: joined once."""
    return engine(spark, sf_dir).ask(["orders", "::all", [["customer", "c_name"], ["customer", "nation", "n_name"], ["customer", "referrer", "c_name"], "o_orderstatus"]]).flat(["c_name", "n_name", "referrer", "o_orderstatus"])


def query_tsv_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of nested lists in one cell, empty lists as blank cells."""
    q = ["region", "::all", [["nation", "::count"], ["nation", "::all", "supplier", ["s_acctbal", "::>", 9800], "::all", "s_name"]]]
    return query_tsv(engine(spark, sf_dir), q, user_columns=["region", "n_nations", "rich_suppliers"])


def query_tsv_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ["embeddings", "::all", ["label", ["embedding", "::slice", ["d0", "d5"]], ["embedding", "::slice", ["d63"]]]]
    return query_tsv(engine(spark, sf_dir), q, user_columns=["id", "label", "first", "second"], expand_matrices=True).withColumns({c: F.col(f"`{c}`").cast("float") for c in ("first.d0", "first.d5", "second.d63")}).withColumnsRenamed({"first.d0": "d0", "first.d5": "d5", "second.d63": "d63"})


def query_tsv_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = query_tsv(engine(spark, sf_dir), ["nation", "::all", [["region", "r_name"], ["supplier", "::count"]]], user_columns=["nation", "region", "n"], transpose=True)
    return df.select("column", F.array_join("cells", ",").alias("cells"))


def retrieve_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("customer", attribute_names=["c_mktsegment", "referrer"], filter='["c_mktsegment[]BUILDING,MACHINERY", "c_name~^Customer#0+1", "referrer=Customer#000000020"]')
    return Retrieval(engine(spark, sf_dir), r).documents().drop("identifier")


def retrieve_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("customer", attribute_names=["restricted", "referrer"], filter="referrer^@")
    return Retrieval(engine(spark, sf_dir), r).documents().drop("identifier")


def retrieve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("customer", record_names=["Customer#000000003", "Customer#000000033", "nobody"], attribute_names=["c_acctbal", "restricted"], order="c_acctbal")
    return Retrieval(engine(spark, sf_dir), r).documents().drop("identifier")


def upsert_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order revises its customer: the last one counts, attribute by attribute; a null of it, too."""
    e = engine(spark, sf_dir)
    rev = e.tables["orders"].join(e.tables["customer"], F.col("o_custkey") == F.col("c_custkey")).select("c_name", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("c_mktsegment"), F.col("o_orderkey").alias("at"))
    return upsert.load(e, {"customer": rev}, order="at")["customer"].select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def upsert_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASIA lists its own nations but those whose key 3 divides, NATION_1 and a new one; NATION_0 revises itself to go to ASIA, too."""
    e = engine(spark, sf_dir)
    nations = e.tables["nation"].join(e.tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    listed = nations.where("r_name = 'ASIA' and n_nationkey % 3 > 0 or n_nationkey = 1").groupBy().agg(F.collect_list("n_name").alias("n"))  # of 25 rows
    lists = listed.select(F.lit("ASIA").alias("r_name"), F.concat("n", F.array(F.lit("ATLANTIS"))).alias("nation"))
    own = nations.where("n_nationkey = 0").select("n_name", F.lit("ASIA").alias("region"))
    return upsert.load(e, {"region": upsert.as_revisions(e.catalog.model("region"), lists), "nation": own})["nation"].select("n_name", "n_regionkey")


def replaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose key 50 divides list two new events: their old ones go, those of others stay."""
    e = engine(spark, sf_dir)
    chosen = e.tables["customer"].where("c_custkey % 50 = 0")
    ids = F.array(*(F.concat(F.lit(f"::temp{i}-"), F.col("c_name")) for i in range(2)))
    lists = chosen.select("c_name", ids.alias("events"))
    new = chosen.select(F.explode(ids).alias("__record"), F.lit("new").alias("event_type"), F.col("c_acctbal").alias("value"))
    out = upsert.load(e, {"customer": lists, "events": upsert.as_revisions(e.catalog.model("events"), new)})["events"]
    return out.select(F.when(F.col("event_type") != "new", F.col("event_id")).alias("event_id"), "user_id", "event_type", "value")


def upsert_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``upsert_repeated``, by way of files of JSON lines."""
    e, path = engine(spark, sf_dir), f"{shared_folder(spark)}/revisions-{uuid.uuid4().hex}"
    rev = e.tables["orders"].join(e.tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
    body = F.to_json(F.struct(F.col("o_orderpriority").alias("c_mktsegment")))
    rev.select(F.lit("customer").alias("model"), F.col("c_name").alias("record"), F.col("o_orderkey").alias("seq"), body.alias("revision")).write.json(path)
    return upsert.load(e, read_revisions(spark, e.catalog, path, ["customer"]))["customer"].select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def unloaded_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations as TSV files, read again as revisions."""
    e, path = engine(spark, sf_dir), f"{shared_folder(spark)}/nation-{uuid.uuid4().hex}"
    unload(e, "nation", path)
    return read_tsv(spark, path, e.catalog.model("nation"))


def file_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots blanked, left for later (so they stay), replaced, and taken away."""
    e = engine(spark, sf_dir)
    kind = F.col("page_id") % 4
    path = F.when(kind == 0, F.lit("::blank")).when(kind == 1, F.lit("::temp")).when(kind == 2, F.concat(F.lit("s3://new/"), F.col("page_id").cast("string"), F.lit(".png")))
    rev = e.tables["pages"].select("page_id", F.struct(path.alias("path"), F.lit("photo.jpg").alias("original_filename")).alias("snapshot"))
    return upsert.load(e, {"pages": rev})["pages"].select("page_id", "snapshot.*")


def upsert_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a revised and a new region: when it was made, and revised."""
    e = engine(spark, sf_dir)
    made, now = (F.lit(t).cast("timestamp_ntz") for t in ("2020-01-01 00:00:00", "2024-05-05 00:00:00"))
    old = replace(e, tables=e.tables | {"region": e.tables["region"].withColumns({"created_at": made, "updated_at": made})})
    rev = e.tables["region"].where("r_name = 'ASIA'").select(F.explode(F.array("r_name", F.lit("ATLANTIS"))).alias("r_name"))
    update = upsert.Update(old, {"region": upsert.as_revisions(e.catalog.model("region"), rev)}, now)
    return update.tables["region"].select("r_name", *(iso_time(F.col(c)).alias(c) for c in ("created_at", "updated_at")))


def complaints_of_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with revisions of every second customer: unknown attribute and nation, values that break validations."""
    e = engine(spark, sf_dir)
    cat = e.catalog.apply([("update_attribute", "customer", "c_acctbal", {"validation": ("Range", -500, 9000)}), ("update_attribute", "customer", "c_mktsegment", {"validation": ("Array", ("BUILDING", "MACHINERY"))})])
    nation = F.when(F.col("c_custkey") % 10 == 0, F.lit("ATLANTIS")).otherwise(F.lit("NATION_6"))
    rev = e.tables["customer"].where("c_custkey % 2 = 0").select("c_name", "c_acctbal", "c_mktsegment", nation.alias("nation"), F.lit("x").alias("nickname"))
    return upsert.Update(replace(e, catalog=cat), {"customer": upsert.as_revisions(cat.model("customer"), rev)}).complaints


def changed(cat: Catalog) -> Catalog:
    """A renamed and a new attribute, a link and a model, as one batch."""
    return cat.apply([("rename_attribute", "customer", "c_acctbal", "balance"), ("add_attribute", "customer", A("nickname", "string")), ("add_link", "supplier", "agent", "customer", "clients"), ("add_model", "codex", "name", "region")])


def migration_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(evolve.steps(catalog(), changed(catalog())), "step string, model string, column string, type string")


def evolved_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked by the new names, of tables brought to the changed catalog."""
    e = engine(spark, sf_dir)
    cat = changed(e.catalog)
    tables = e.tables | {n: evolve.conformed(e.tables[n], cat.model(n)) for n in ("customer", "supplier")}
    return replace(e, catalog=cat, tables=tables).ask(["customer", ["balance", "::>", 9000], "::all", ["balance", "nickname", ["clients", "::count"]]]).flat(["balance", "nickname", "n_clients"])


def retrieve_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("customer", attribute_names=["c_mktsegment"], order="c_acctbal", page=2, page_size=40)
    return Retrieval(engine(spark, sf_dir), r).documents().drop("identifier")


def nested_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested list, a row for each of its entries."""
    df = engine(spark, sf_dir).ask(["nation", "::all", "supplier", "::all", "s_acctbal"]).df
    return df.select("identifier", F.explode("answer").alias("a")).select("identifier", F.col("a.k").alias("supplier"), F.col("a.v").alias("s_acctbal"))


def table_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of columns, two of them lists with filters of their own: empty ones stay as zeros and nulls."""
    columns = [["region", "r_name"], ["supplier", "::count"], ["customer", ["c_acctbal", "::>", 9900], "::count"], ["customer", ["c_acctbal", "::>", 9900], "::first", "c_acctbal"], ["customer", ["orders", ["o_totalprice", "::>", 450000], "::any"], "::count"]]
    return engine(spark, sf_dir).ask(["nation", "::all", columns]).flat(["r_name", "n_suppliers", "n_rich", "first_rich", "n_large"])


def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user sees who may not see restricted records: nothing of those, nor of what lies below."""
    return engine(spark, sf_dir, User()).ask(["orders", "::all", "customer", "c_name"]).df


def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("orders", attribute_names=["o_orderstatus", "o_totalprice", "customer"], filter="o_totalprice>=300000 o_orderstatus=F")
    return Retrieval(engine(spark, sf_dir), r).documents().drop("identifier")


def retrieve_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Retrieval(engine(spark, sf_dir), Request("region", attribute_names=["nation"])).documents()
    return tsv_frame(df.drop("identifier"), renames=["region", "nations"])


def retrieve_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Request("customer", attribute_names=["c_mktsegment", "events"], filter="c_mktsegment=BUILDING")
    return Retrieval(engine(spark, sf_dir), r).tables()["events"].select("event_id", "event_type", "value", "customer")


def retrieve_matrix_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix sliced, and expanded into a column for each of its own."""
    r = Request("embeddings", attribute_names=["vec_id", "label", "embedding"], output_predicate="embedding[]d1,d63", expand_matrices=True, format="tsv")
    df = Retrieval(engine(spark, sf_dir), r).tsv()
    return df.select("vec_id", "label", *(F.col(f"`embedding.{n}`").cast("float").alias(n) for n in ("d1", "d63")))


def dictionary_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no rule of a small dictionary allows."""
    e = engine(spark, sf_dir)
    rules = spark.createDataFrame([(1, ("Array", '["O","F"]'), ("Range", "[0,200000]")), (2, ("String", '"P"'), ("Regexp", '"^[0-9.]+$"'))], "id long, status struct<type:string,value:string>, price struct<type:string,value:string>")
    codex = Model("codex", (A("status", "match"), A("price", "match"), A("orders", "collection")), root=True)
    orders = Model("orders", (*e.catalog.model("orders").attributes, A("codex", "link")), "o_orderkey", "o_orderkey", dictionary=("codex", (("o_orderstatus", "status"), ("o_totalprice", "price"))))
    cat = Catalog("warehouse", e.catalog.models | {"codex": codex, "orders": orders})
    checked = Engine(spark, cat, e.tables | {"codex": rules}, e.user)
    return upsert.unmatched(checked, orders, e.tables["orders"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances and nations as revisions of customers: some are new."""
    e = engine(spark, sf_dir)
    rev = e.tables["supplier"].join(e.tables["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit("Customer#")).otherwise(F.lit("New#")), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.col("n_name").alias("nation"))
    return upsert.load(e, {"customer": rev})["customer"].select("c_name", "c_acctbal", "c_nationkey", "c_mktsegment")


def date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events moved back by their customer's days."""
    e = engine(spark, sf_dir)
    moved = Engine(spark, e.catalog.set_date_shift_root("customer"), e.tables, e.user)
    model = moved.catalog.model("events")
    return upsert.shift_dates(moved, model, e.tables["events"], "salt").select("event_id", iso_time(F.col("ts")).alias("ts"))


def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts(engine(spark, sf_dir))


#: The key "salt" of the date shift's HMAC, padded for its inner and outer hash.
_PADS = tuple(bytes(b ^ x for b in b"salt".ljust(64, b"\0")) for x in (0x36, 0x5C))
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "nested_all": (nested_all, "SELECT n_name AS identifier, s_name AS supplier, s_acctbal FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "table_projection": (table_projection, """
      SELECT n_name AS identifier, r_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS n_rich,
      (SELECT arg_min(c_acctbal, c_name) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS first_rich,
      (SELECT count(DISTINCT c_custkey) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_totalprice > 450000) AS n_large
      FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "restricted": (restricted, "SELECT o_orderkey AS identifier, c_name AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT c_acctbal < 0"),
    "retrieve_filtered": (retrieve_filtered, "SELECT o_orderkey, o_orderstatus, o_totalprice, c_name AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 300000 AND o_orderstatus = 'F'"),
    "retrieve_collections": (retrieve_collections, "SELECT r_name AS region, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "retrieve_table": (retrieve_table, "SELECT event_id, event_type, value, c_name AS customer FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "retrieve_matrix_tsv": (retrieve_matrix_tsv, "SELECT vec_id::VARCHAR AS vec_id, label::VARCHAR AS label, embedding[2] AS d1, embedding[64] AS d63 FROM embeddings"),
    "dictionary_misses": (dictionary_misses, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 0 AND 200000) AND o_orderstatus <> 'P'"),
    "upsert_customers": (upsert_customers, """
      WITH r AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' ELSE 'New#' END || lpad(s_suppkey::VARCHAR, 9, '0') AS name, s_acctbal, s_nationkey FROM supplier)
      SELECT coalesce(c_name, name) AS c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal, coalesce(s_nationkey, c_nationkey) AS c_nationkey, c_mktsegment FROM customer FULL JOIN r ON c_name = name"""),
    "date_shift": (date_shift, f"""
      WITH h AS (SELECT c_custkey, sha256(unhex('{_PADS[1].hex()}') || unhex(sha256(unhex('{_PADS[0].hex()}') || encode(c_name)))) AS h FROM customer)
      SELECT event_id, strftime(ts - to_days(floor(('0x' || h[1:13])::UBIGINT::DOUBLE / 4503599627370496 * 365)::INTEGER), '%Y-%m-%dT%H:%M:%S+00:00') AS ts FROM events LEFT JOIN h ON user_id = c_custkey"""),
    "connected_orders": (connected_orders, "SELECT o_orderkey AS identifier, o_orderstatus AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 > 0 AND c_nationkey <> 3"),
    "disconnected_orders": (disconnected_orders, "SELECT o_orderkey AS identifier, CASE WHEN o_orderkey % 11 > 0 THEN c_name END AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderkey % 11 > 0 AND c_nationkey <> 3)"),
    "quantified_nulls": (quantified_nulls, """
      SELECT c.c_name AS identifier, c.c_name AS answer FROM customer c JOIN customer b ON b.c_custkey // 7 = c.c_custkey AND b.c_custkey >= 7 JOIN nation ON b.c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE c.c_nationkey <> 3 GROUP BY 1 HAVING bool_and(n_nationkey <> 3 AND r_name <> 'ASIA')"""),
    "page_by_bounds": (page_by_bounds, QUESTIONS["order_page"][2]),
    "metrics_of_orders": (metrics_of_orders, "SELECT o_orderkey AS identifier, o_totalprice > 300000 AS expensive, lower(o_orderstatus) AS status FROM orders"),
    "shared_links": (shared_links, """
      SELECT o_orderkey AS identifier, c.c_name, n_name, r.c_name AS referrer, o_orderstatus FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN nation ON c.c_nationkey = n_nationkey LEFT JOIN customer r ON r.c_custkey = c.c_custkey // 7 AND c.c_custkey >= 7"""),
    "query_tsv_nested": (query_tsv_nested, """
      SELECT r_name AS region, count(DISTINCT n_nationkey)::VARCHAR AS n_nations, coalesce('[' || string_agg('"' || s_name || '"', ', ' ORDER BY n_name, s_name) || ']', '') AS rich_suppliers
      FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9800 GROUP BY 1"""),
    "query_tsv_matrix": (query_tsv_matrix, "SELECT vec_id::VARCHAR AS id, label::VARCHAR AS label, embedding[1] AS d0, embedding[6] AS d5, embedding[64] AS d63 FROM embeddings"),
    "query_tsv_transposed": (query_tsv_transposed, """
      WITH n AS (SELECT n_name, r_name, count(s_suppkey)::VARCHAR AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
      SELECT 'nation' AS "column", string_agg(n_name, ',' ORDER BY n_name) AS cells FROM n UNION ALL SELECT 'region', string_agg(r_name, ',' ORDER BY n_name) FROM n UNION ALL SELECT 'n', string_agg(n, ',' ORDER BY n_name) FROM n"""),
    "retrieve_terms": (retrieve_terms, "SELECT c.c_name, c.c_mktsegment, r.c_name AS referrer FROM customer c JOIN customer r ON r.c_custkey = c.c_custkey // 7 AND c.c_custkey >= 7 WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_matches(c.c_name, '^Customer#0+1') AND r.c_name = 'Customer#000000020'"),
    "retrieve_lacking": (retrieve_lacking, "SELECT c_name, CASE WHEN c_acctbal < 0 THEN true WHEN c_acctbal < 5000 THEN false END AS restricted, NULL::VARCHAR AS referrer FROM customer WHERE c_custkey < 7"),
    "retrieve_names": (retrieve_names, "SELECT c_name, c_acctbal, CASE WHEN c_acctbal < 0 THEN true WHEN c_acctbal < 5000 THEN false END AS restricted FROM customer WHERE c_custkey IN (3, 33)"),
    "upsert_repeated": (upsert_repeated, """
      SELECT c_custkey, c_name, CASE WHEN n IS NULL THEN c_mktsegment WHEN s <> 'P' THEN p END AS c_mktsegment, c_acctbal
      FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey"""),
    "upsert_lists": (upsert_lists, """
      WITH a AS (SELECT r_regionkey AS k FROM region WHERE r_name = 'ASIA')
      SELECT n_name, CASE WHEN n_nationkey IN (0, 1) THEN k WHEN n_regionkey = k AND n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation, a UNION ALL SELECT 'ATLANTIS', k FROM a"""),
    "replaced_events": (replaced_events, """
      SELECT event_id, user_id, event_type, value FROM events WHERE user_id % 50 <> 0
      UNION ALL SELECT NULL, c_custkey, 'new', c_acctbal FROM customer, range(2) WHERE c_custkey % 50 = 0"""),
    "upsert_from_json": (upsert_from_json, "SELECT c_custkey, c_name, coalesce(p, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    "unloaded_and_read": (unloaded_and_read, "SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "file_revisions": (file_revisions, """
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN '::blank' WHEN 1 THEN CASE WHEN page_id % 5 > 0 THEN 'store://' || url END WHEN 2 THEN 's3://new/' || page_id || '.png' END AS location,
      CASE page_id % 4 WHEN 0 THEN '::blank' WHEN 1 THEN CASE WHEN page_id % 5 > 0 THEN 'pages-' || page_id || '-snapshot.html' END WHEN 2 THEN 'pages-' || page_id || '-snapshot.png' END AS filename,
      CASE page_id % 4 WHEN 0 THEN '::blank' WHEN 1 THEN CASE WHEN page_id % 5 > 0 THEN string_split(url, '/')[-1] END WHEN 2 THEN 'photo.jpg' END AS original_filename FROM pages"""),
    "upsert_times": (upsert_times, """
      SELECT r_name, '2020-01-01T00:00:00+00:00' AS created_at, CASE WHEN r_name = 'ASIA' THEN '2024-05-05T00:00:00+00:00' ELSE '2020-01-01T00:00:00+00:00' END AS updated_at FROM region
      UNION ALL SELECT 'ATLANTIS', '2024-05-05T00:00:00+00:00', '2024-05-05T00:00:00+00:00'"""),
    "complaints_of_revisions": (complaints_of_revisions, """
      WITH r AS (SELECT * FROM customer WHERE c_custkey % 2 = 0)
      SELECT 'customer' AS model, c_name AS identifier, 'customer has no attribute ''nickname''' AS complaint FROM r
      UNION ALL SELECT 'customer', c_name, 'customer.nation ''ATLANTIS'' does not exist.' FROM r WHERE c_custkey % 10 = 0
      UNION ALL SELECT 'customer', c_name, 'On c_acctbal, ' || c_acctbal::VARCHAR || ' should be greater than or equal to -500 and less than or equal to 9000.' FROM r WHERE NOT c_acctbal BETWEEN -500 AND 9000
      UNION ALL SELECT 'customer', c_name, 'On c_mktsegment, ''' || c_mktsegment || ''' should be one of BUILDING, MACHINERY.' FROM r WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"""),
    "migration_steps": (migration_steps, """
      SELECT * FROM (VALUES ('create_table', 'codex', NULL, NULL), ('add_column', 'codex', 'id', 'bigint'), ('add_column', 'codex', 'name', 'string'), ('add_column', 'codex', 'region_id', 'bigint'), ('add_column', 'codex', 'created_at', 'timestamp_ntz'),
        ('add_column', 'codex', 'updated_at', 'timestamp_ntz'), ('add_column', 'customer', 'nickname', 'string'), ('add_column', 'supplier', 'agent_id', 'bigint')) AS t(step, model, "column", type)"""),
    "evolved_customers": (evolved_customers, "SELECT c_name AS identifier, c_acctbal AS balance, NULL::VARCHAR AS nickname, 0::BIGINT AS n_clients FROM customer WHERE c_acctbal > 9000"),
    "retrieve_page": (retrieve_page, "SELECT c_name, c_mktsegment FROM customer ORDER BY c_acctbal NULLS LAST, c_name LIMIT 40 OFFSET 40"),
    "model_counts": (model_counts, " UNION ALL ".join(f"SELECT '{n}' AS model, count(*) AS n_rows FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "pages", "labels"))),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _asked(q, more) for n, (q, more, _) in QUESTIONS.items()} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (*_, sql) in QUESTIONS.items()} | {n: sql for n, (_, sql) in OTHERS.items() if sql}
