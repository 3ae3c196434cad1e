"""Queries over the relational tables as objects, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import table
from noteweave.operators.arrays import DataArray
from noteweave.plans import ast as A
from noteweave.plans.expressions import Compiler, Val, kind_of_type, of_type
from noteweave.plans.parser import parse_expression, parse_query
from noteweave.plans.store import Planner
from noteweave.plans.tables import relational_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ID = {
    "region": "concat('region/', r_regionkey)", "nation": "concat('nation/', n_nationkey)", "customer": "concat('customer/', c_custkey)", "supplier": "concat('supplier/', s_suppkey)",
    "part": "concat('part/', p_partkey)", "orders": "concat('orders/', o_orderkey)", "events": "concat('events/', event_id)",
    "lineitem": "concat('lineitem/', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey, '/', l_quantity::BIGINT)",
}
_ALL = " UNION ALL ".join(f"SELECT {i} AS id, '{t}' AS typename FROM {t}" for t, i in _ID.items())


def _query(name: str, query: str | A.Query, sql: str) -> None:
    """Register the ids that ``query`` finds. ``sql`` may use {lineitem} and the like for ids, and {all} for all of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Planner(relational_store(spark, sf_dir)).run(query).select("id")

    run.__doc__ = query if isinstance(query, str) else repr(query)
    QUERIES[name] = run
    SQL[name] = sql.format(all=f"({_ALL})", **_ID)


def _q(text: str) -> A.Query:
    return parse_query(text)


# predicates
_query("q_typed", "@lineitem and l_quantity > 30 and !(l_returnflag = \"R\")", "SELECT {lineitem} AS id FROM lineitem WHERE l_quantity > 30 AND NOT coalesce(l_returnflag = 'R', false)")
_query("q_id", 'id("orders/7")', "SELECT {orders} AS id FROM orders WHERE o_orderkey = 7")
_query("q_tag_sub", "#part/Brand-2", "SELECT {part} AS id FROM part WHERE regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g') = 'Brand-2'")
_query("q_tag_exact", A.ByTag("#event/click", exact=True), "SELECT {events} AS id FROM events WHERE event_type = 'click'")
_query("q_path", 'path("tables/nation")', "SELECT {nation} AS id FROM nation")
_query("q_epath", 'epath("tables/supplier")', "SELECT {supplier} AS id FROM supplier")
_query("q_exists", "exists(c_acctbal)", "SELECT {customer} AS id FROM customer")
_query("q_equal_value", A.FieldEquals("o_orderstatus", ("F", "P")), "SELECT {orders} AS id FROM orders WHERE o_orderstatus IN ('F', 'P')")
_query("q_expr_cmp", "o_totalprice >= 400000 and @orders", "SELECT {orders} AS id FROM orders WHERE o_totalprice >= 400000")
_query("q_expr_null_lt", "@part and (p_size < 10 or p_retailprice > 1000)", "SELECT {part} AS id FROM part WHERE p_size < 10 OR p_retailprice > 1000")
_query("q_and", "@customer & c_acctbal < 0 & c_mktsegment = \"BUILDING\"", "SELECT {customer} AS id FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'")
_query("q_or", "@region or @nation and n_regionkey = 1", "SELECT {region} AS id FROM region UNION ALL SELECT {nation} FROM nation WHERE n_regionkey = 1")
_query("q_not", "!(@lineitem or @orders or @events)", "SELECT id FROM {all} WHERE typename NOT IN ('lineitem', 'orders', 'events')")
_query("q_not_vs_expr_not", "expr(!(s_acctbal > 0)) and !exists(r_name)", "SELECT {supplier} AS id FROM supplier WHERE NOT s_acctbal > 0")
_query("q_const", A.And((A.ALL, A.ByType("region"))), "SELECT {region} AS id FROM region")
_query("q_nested_bool", "(@orders and (o_orderpriority = \"1-URGENT\" or o_orderstatus = \"F\")) and !(o_totalprice < 100000)", "SELECT {orders} AS id FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_orderstatus = 'F') AND NOT o_totalprice < 100000")
_query("q_functions", '@part and contains(lower(p_name), "blue") and length(p_name) > 9', "SELECT {part} AS id FROM part WHERE contains(lower(p_name), 'blue') AND length(p_name) > 9")

# trees
_NATION = "SELECT n_nationkey FROM nation WHERE n_regionkey = 2"
_query("q_childof", 'childof(id("region/2"))', f"SELECT {{nation}} AS id FROM nation WHERE n_regionkey = 2 UNION ALL SELECT {{customer}} FROM customer WHERE c_nationkey IN ({_NATION}) UNION ALL SELECT {{supplier}} FROM supplier WHERE s_nationkey IN ({_NATION}) UNION ALL SELECT {{orders}} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN ({_NATION}) UNION ALL SELECT {{lineitem}} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN ({_NATION})")
_query("q_subtree", 'subtree(@customer and c_custkey < 20) and !@lineitem', "SELECT {customer} AS id FROM customer WHERE c_custkey < 20 UNION ALL SELECT {orders} FROM orders WHERE o_custkey < 20 AND o_custkey IN (SELECT c_custkey FROM customer)")
_NEGATIVE = "SELECT c_custkey FROM customer WHERE c_acctbal < 0"
_query("q_subtree_all", "subtree(@customer and c_acctbal < 0)", f"SELECT {{customer}} AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT {{orders}} FROM orders WHERE o_custkey IN ({_NEGATIVE}) UNION ALL SELECT {{lineitem}} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN ({_NEGATIVE})")
_query("q_parentof", "parentof(@orders and o_totalprice > 480000)", "WITH o AS (SELECT DISTINCT c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 480000) SELECT DISTINCT concat('customer/', c_custkey) AS id FROM o UNION SELECT concat('nation/', c_nationkey) FROM o UNION SELECT concat('region/', n_regionkey) FROM o JOIN nation ON c_nationkey = n_nationkey")
_query("q_supertree", "supertree(@supplier and s_acctbal > 9500)", "WITH s AS (SELECT * FROM supplier WHERE s_acctbal > 9500) SELECT {supplier} AS id FROM s UNION SELECT concat('nation/', s_nationkey) FROM s UNION SELECT concat('region/', n_regionkey) FROM s JOIN nation ON s_nationkey = n_nationkey")
_query("q_childof_nested", "@orders and childof(@nation and n_regionkey = 0) and !childof(@customer and c_acctbal < 0)", "SELECT {orders} AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 AND NOT c_acctbal < 0")
_query("q_childof_or", '@orders and (childof(id("nation/3")) or o_totalprice > 490000)', "SELECT {orders} AS id FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 OR o_totalprice > 490000")
_query("q_parent_field", "@orders and $parent.c_acctbal > 9000", "SELECT {orders} AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")

# links
_query("q_linksto", 'linksto(@part and p_size = 7)', "SELECT {lineitem} AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
_query("q_linkedfrom", 'linkedfrom(@lineitem and l_quantity = 50 and l_returnflag = "A")', "WITH l AS (SELECT * FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'A') SELECT concat('part/', l_partkey) AS id FROM l UNION SELECT concat('supplier/', l_suppkey) FROM l")
_query("q_connected", 'connected(id("supplier/1"))', "SELECT {lineitem} AS id FROM lineitem WHERE l_suppkey = 1")
_query("q_linked_k2", A.Linked(A.ById("supplier/1"), "both", 2), "WITH h AS (SELECT * FROM lineitem WHERE l_suppkey = 1) SELECT {lineitem} AS id FROM h UNION SELECT concat('part/', l_partkey) FROM h")
_query("q_linked_inclusive", A.Linked(A.ById("part/5"), "incoming", 1, True), "SELECT {lineitem} AS id FROM lineitem WHERE l_partkey = 5 UNION ALL SELECT 'part/5'")
_query("q_deref", "@orders and o_totalprice > [[orders/3]].o_totalprice", "SELECT {orders} AS id FROM orders WHERE o_totalprice > (SELECT o_totalprice FROM orders WHERE o_orderkey = 3)")


# expressions over one table


def _rows(name: str, source: str, key: str, exprs: dict[str, str], sql: str, extra: str = "") -> None:
    """Register expressions over the rows of a table, or of a relation ``extra`` (SQL for both engines)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        fields = {f.name: f for f in df.schema.fields}
        variable = lambda n: of_type(F.col(n), fields[n].dataType) if n in fields else None
        return df.select(F.col(key).alias("key"), *(Compiler(variable).value(parse_expression(e)).col.alias(n) for n, e in exprs.items()))

    run.__doc__ = "; ".join(exprs.values())
    QUERIES[name] = run
    SQL[name] = f"SELECT {key} AS key, {sql} FROM {source}"


def _rule(c: str) -> str:
    """A number as text, whole ones without a fraction."""
    return f"CASE WHEN {c} = floor({c}) THEN ({c})::BIGINT::VARCHAR ELSE ({c})::DOUBLE::VARCHAR END"


_rows("op_arith", "lineitem", "l_orderkey", {"a": "l_quantity * l_extendedprice", "b": "round(l_extendedprice / l_quantity, 2) >= 0", "c": "l_tax - l_discount + 1"}, "l_quantity * l_extendedprice AS a, true AS b, l_tax - l_discount + 1 AS c")
_rows("op_mod_sign", "customer", "c_custkey", {"m": "floor(c_acctbal) % 7"}, "floor(c_acctbal) % 7 AS m")
_rows("op_div_zero", "part", "p_partkey", {"d": "p_size / (p_size % 3)"}, "CASE WHEN p_size % 3 = 0 THEN (CASE WHEN p_size = 0 THEN 'nan'::DOUBLE ELSE 'infinity'::DOUBLE END) ELSE p_size::DOUBLE / (p_size % 3) END AS d")
_rows("op_concat_text", "part", "p_partkey", {"t": 'p_name + "/" + p_size'}, "concat(p_name, '/', p_size) AS t")
_rows("op_repeat", "part", "p_partkey", {"t": "p_type * (p_size % 4 - 1)"}, "repeat(p_type, greatest(p_size % 4 - 1, 0)::BIGINT) AS t")
_rows("op_compare", "orders", "o_orderkey", {"a": 'o_orderstatus = "F"', "b": "o_totalprice != 5", "c": '1 < o_orderstatus', "d": "null < o_totalprice", "e": "null = o_totalprice"}, "o_orderstatus = 'F' AS a, o_totalprice <> 5 AS b, true AS c, true AS d, false AS e")
_rows("op_logic", "part", "p_partkey", {"a": "p_size % 2 and p_name", "b": '"" or p_size % 3', "c": "!(p_size % 2)"}, "p_size % 2 <> 0 AND p_name <> '' AS a, p_size % 3 <> 0 AS b, NOT (p_size % 2 <> 0) AS c")
_rows("op_date_plus_dur", "orders", "o_orderkey", {"a": "o_orderdate + dur(1 month)", "b": "o_orderdate - dur(2 days, 3 hours)"}, "o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 51 HOUR AS b")
_rows("op_date_diff", "orders", "o_orderkey", {"y": "(o_orderdate - date(1990-01-01)).years", "m": "(o_orderdate - date(1990-01-01)).months"}, "floor(datesub('month', TIMESTAMP '1990-01-01', o_orderdate) / 12)::DOUBLE AS y, (datesub('month', TIMESTAMP '1990-01-01', o_orderdate) % 12)::DOUBLE AS m")
_rows("op_array_concat", "part", "p_partkey", {"n": "length(split(p_name, \" \") + [p_type])", "last": "(split(p_name, \" \") + [p_type])[2]"}, "(len(string_split(p_name, ' ')) + 1)::DOUBLE AS n, list_append(string_split(p_name, ' '), p_type)[3] AS last")
_rows("op_object_merge", "part", "p_partkey", {"a": "({n: p_name, s: p_size} + {s: 1}).s", "b": "({n: p_name} + {s: 1}).n"}, "1.0::DOUBLE AS a, p_name AS b")
_rows("op_index_array", "embeddings", "vec_id", {"a": "embedding[0]", "b": "embedding[64]", "c": "embedding[63]"}, "embedding[1]::DOUBLE AS a, NULL::DOUBLE AS b, embedding[64]::DOUBLE AS c")
_rows("op_index_object", "part", "p_partkey", {"a": '{x: p_name}["X"]', "b": 'default({x: p_name}.y, "none")'}, "p_name AS a, 'none' AS b")
_rows("op_index_date", "events", "event_id", {k: f"ts.{k}" for k in ("year", "month", "day", "hour", "minute", "second", "week")}, ", ".join(f"{k}(ts)::DOUBLE AS {k}" for k in ("year", "month", "day", "hour", "minute", "second", "week")))
_rows("op_truthy", "events", "event_id", {"a": "!value", "b": "!props", "c": "!ts", "d": "!missing"}, "value = 0 AS a, props = '' AS b, false AS c, true AS d")

_rows("fn_lower_upper", "part", "p_partkey", {"a": "lower(p_type)", "b": "upper(p_name)"}, "lower(p_type) AS a, upper(p_name) AS b")
_rows("fn_startswith_endswith", "part", "p_partkey", {"a": 'startswith(p_name, "blue")', "b": 'endswith(p_name, "ring")'}, "starts_with(p_name, 'blue') AS a, ends_with(p_name, 'ring') AS b")
_rows("fn_pad", "part", "p_partkey", {"a": "padleft(p_name, 14, \"*\")", "b": "padright(p_name, 8, \"xy\")"}, "CASE WHEN length(p_name) >= 14 THEN p_name ELSE lpad(p_name, 14, '*') END AS a, CASE WHEN length(p_name) >= 8 THEN p_name ELSE rpad(p_name, 8, 'xy') END AS b")
_rows("fn_substring", "part", "p_partkey", {"a": "substring(p_name, 2, 5)", "b": "substring(p_name, 6, 1)", "c": "substring(p_name, 3)"}, "substr(p_name, 3, 3) AS a, substr(p_name, 2, 5) AS b, substr(p_name, 4) AS c")
_rows("fn_truncate", "part", "p_partkey", {"a": "truncate(p_name, 8)", "b": 'truncate(p_name, 6, "~")'}, "CASE WHEN length(p_name) > 5 THEN concat(substr(p_name, 1, 5), '...') ELSE p_name END AS a, CASE WHEN length(p_name) > 5 THEN concat(substr(p_name, 1, 5), '~') ELSE p_name END AS b")
_rows("fn_replace", "part", "p_partkey", {"a": 'replace(p_name, "e", "3")'}, "replace(p_name, 'e', '3') AS a")
_rows("fn_regexreplace", "part", "p_partkey", {"a": 'regexreplace(p_brand, "Brand#(\\d+)", "B$1")'}, "regexp_replace(p_brand, 'Brand#(\\d+)', 'B\\1', 'g') AS a")
_rows("fn_regextest_match", "part", "p_partkey", {"a": 'regextest("r[a-e]d", p_name)', "b": 'regexmatch("[a-z ]+", p_name)', "c": 'regexmatch("^b", p_name)'}, "regexp_matches(p_name, 'r[a-e]d') AS a, regexp_matches(p_name, '^[a-z ]+$') AS b, regexp_matches(p_name, '^b') AS c")
_rows("fn_split_join", "part", "p_partkey", {"a": 'join(split(p_name, " "), "|")', "b": 'join(split(p_name, " ", 1))'}, "replace(p_name, ' ', '|') AS a, split_part(p_name, ' ', 1) AS b")
_rows("fn_contains", "part", "p_partkey", {"a": 'contains(p_name, "ri")', "b": 'contains(split(p_name, " "), "rin")', "c": 'icontains(p_name, "RED")', "d": 'econtains(split(p_name, " "), "ring")', "e": 'containsword(p_name, "red")'}, "contains(p_name, 'ri') AS a, contains(p_name, 'rin') AS b, contains(lower(p_name), 'red') AS c, list_contains(string_split(p_name, ' '), 'ring') AS d, regexp_matches(p_name, '(?i)\\bred\\b') AS e")
_rows("fn_length", "documents", "doc_id", {"a": "length(lang)", "b": "length(split(source, \"_\"))"}, "coalesce(length(lang), 0)::DOUBLE AS a, len(string_split(source, '_'))::DOUBLE AS b")
_rows("fn_reverse", "part", "p_partkey", {"a": "reverse(p_name)", "b": 'join(reverse(split(p_name, " ")), " ")'}, "reverse(p_name) AS a, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS b")
_rows("fn_round", "lineitem", "l_orderkey", {"a": "round(l_discount * 100)", "b": "round(0 - l_quantity / 2)", "c": "floor(l_extendedprice / 7)", "d": "ceil(l_extendedprice / 7)", "e": "trunc(l_quantity / 3)"}, "floor(l_discount * 100 + 0.5) AS a, floor(-l_quantity / 2 + 0.5) AS b, floor(l_extendedprice / 7) AS c, ceil(l_extendedprice / 7) AS d, trunc(l_quantity / 3) AS e")
_rows("fn_number_string", "part", "p_partkey", {"a": "number(p_brand)", "b": "string(p_size)", "c": "string(p_retailprice)", "d": "typeof(p_name)"}, f"regexp_extract(p_brand, '-?\\d+(\\.\\d+)?')::DOUBLE AS a, p_size::VARCHAR AS b, {_rule('p_retailprice')} AS c, 'string' AS d")
_rows("fn_minmax", "embeddings", "vec_id", {"a": "min(embedding)", "b": "max(embedding)", "c": "min(label, 3, null)", "d": "max(label, 3)"}, "list_min(embedding)::DOUBLE AS a, list_max(embedding)::DOUBLE AS b, least(label, 3)::DOUBLE AS c, greatest(label, 3)::DOUBLE AS d")
_rows("fn_minby_maxby", "part", "p_partkey", {"a": 'minby(split(p_name, " "), (w) => length(w))', "b": 'maxby(split(p_name, " "), (w) => length(w))'}, "CASE WHEN length(split_part(p_name, ' ', 1)) <= length(split_part(p_name, ' ', 2)) THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS a, CASE WHEN length(split_part(p_name, ' ', 1)) > length(split_part(p_name, ' ', 2)) THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS b")
_rows("fn_sum_average", "part", "p_partkey", {"a": "sum([p_size, 2, 3])", "b": "average([p_size, p_size + 2])", "c": "product([p_size, 2])", "d": 'reduce([p_size, 2, 1], "-")', "e": "reduce([p_size, 2], (a, b) => a * 10 + b)"}, "p_size + 5.0::DOUBLE AS a, p_size + 1.0::DOUBLE AS b, p_size * 2.0::DOUBLE AS c, p_size - 3.0::DOUBLE AS d, p_size * 10.0::DOUBLE + 2 AS e")
_rows("fn_lambda", "embeddings", "vec_id", {"a": "length(filter(embedding, (x) => x > 0))", "b": "any(embedding, (x) => x > 1)", "c": "all(embedding, (x) => x < 9)", "d": "none(embedding, (x) => x > 9)", "e": "map(embedding, (x) => x > 0)[1]"}, "len(list_filter(embedding, lambda x: x > 0))::DOUBLE AS a, list_bool_or(list_transform(embedding, lambda x: x > 1)) AS b, list_bool_and(list_transform(embedding, lambda x: x < 9)) AS c, NOT list_bool_or(list_transform(embedding, lambda x: x > 9)) AS d, embedding[2] > 0 AS e")
_rows("fn_sort_slice", "embeddings", "vec_id", {"a": "sort(embedding)[0]", "b": "sort(embedding, (x) => 0 - x)[0]", "c": "length(slice(embedding, 1, 5))"}, "list_min(embedding)::DOUBLE AS a, list_max(embedding)::DOUBLE AS b, 4.0::DOUBLE AS c")
_rows("fn_flat_nonnull", "part", "p_partkey", {"a": "length(flat([[p_size, 1], [2]]))", "b": "length(nonnull([p_size, null, 2]))"}, "3.0::DOUBLE AS a, 2.0::DOUBLE AS b")
_rows("fn_default_choice", "documents", "doc_id", {"a": 'default(lang, "none")', "b": 'choice(n_chars > 1000, "long", "short")', "c": 'ldefault(license_path, "-")'}, "coalesce(lang, 'none') AS a, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS b, coalesce(license_path, '-') AS c")
_rows("fn_list_object_extract", "part", "p_partkey", {"a": "list(p_size, 1)[0]", "b": 'object("k", p_name).k', "c": 'extract({a: p_name, b: p_size}, "b").b'}, "p_size::DOUBLE AS a, p_name AS b, p_size::DOUBLE AS c")
_rows("fn_link_meta", "part", "p_partkey", {"a": 'meta(link(p_name + "#^x", "shown")).path', "b": 'meta(link(p_name + "#^x")).type', "c": "meta(embed(link(p_name))).embed"}, "p_name AS a, 'block' AS b, true AS c")
_rows("fn_date", "orders", "o_orderkey", {"a": 'date("2020-01-05")', "b": "striptime(o_orderdate + dur(5h))", "c": 'date(dateformat(o_orderdate, "yyyy-MM-dd"))', "d": "localtime(o_orderdate)"}, "TIMESTAMP '2020-01-05' AS a, date_trunc('day', o_orderdate) AS b, date_trunc('day', o_orderdate) AS c, o_orderdate AS d")
_rows("fn_dateformat", "events", "event_id", {"a": 'dateformat(ts, "yyyy/MM/dd HH:mm")', "b": 'dateformat(ts, "cccc")'}, "strftime(ts, '%Y/%m/%d %H:%M') AS a, strftime(ts, '%A') AS b")
_rows("fn_dur", "part", "p_partkey", {"a": 'dur(p_size + " hours, 5 min").hours', "b": "(dur(90m) * p_size).minutes", "c": "dur(p_name) = null"}, "p_size::DOUBLE AS a, p_size * 90.0::DOUBLE AS b, NULL::BOOLEAN AS c")
_rows("fn_vectorised", "part", "p_partkey", {"a": 'join(upper(split(p_name, " ")), " ")', "b": 'join(replace(split(p_name, " "), "e", ["1", "2"]), " ")'}, "upper(p_name) AS a, concat(replace(split_part(p_name, ' ', 1), 'e', '1'), ' ', replace(split_part(p_name, ' ', 2), 'e', '2')) AS b")
_rows("fn_hash", "nation", "n_nationkey", {"h": 'hash(n_regionkey) >= 0'}, "true AS h")


# ordered arrays


def _array(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataArray:
    return DataArray.of(table(spark, sf_dir, "orders"), "o_orderkey")


@_array("da_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000")
def _(spark, d):
    return _orders(spark, d).where(F.col("o_totalprice") > 450000).df.select("o_orderkey")


@_array("da_map", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def _(spark, d):
    return _orders(spark, d).map(o_orderkey=F.col("o_orderkey"), twice=F.col("o_totalprice") * 2).df


@_array("da_flatmap", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(spark, d):
    return DataArray.of(table(spark, d, "part"), "p_partkey").flat_map(F.split("p_name", " "), "word").df.select("p_partkey", "word")


@_array("da_to", "SELECT vec_id, unnest(embedding)::DOUBLE AS value FROM embeddings")
def _(spark, d):
    return DataArray.of(table(spark, d, "embeddings"), "vec_id").to("embedding").df.select("vec_id", F.col("value").cast("double").alias("value"))


@_array("da_into", "SELECT doc_id, lang AS value FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    return DataArray.of(table(spark, d, "documents"), "doc_id").into("lang").df.select("doc_id", "value")


@_array("da_sort_asc", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def _(spark, d):
    return _orders(spark, d).sort(F.col("o_totalprice")).limit(100).df.select("o_orderkey")


@_array("da_sort_desc", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100 OFFSET 50")
def _(spark, d):
    return _orders(spark, d).sort(F.col("o_orderpriority"), "desc").slice(50, 150).df.select("o_orderkey")


@_array("da_sort_asc_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders")
def _(spark, d):
    return _orders(spark, d).sort(F.col("o_totalprice")).indexed().select("o_orderkey", "index")


@_array("da_sort_desc_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS index FROM orders")
def _(spark, d):
    return _orders(spark, d).sort(F.col("o_orderpriority"), "desc").indexed().select("o_orderkey", "index")


@_array("da_limit_negative", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT (SELECT count(*) - 5 FROM nation)")
def _(spark, d):
    return DataArray.of(table(spark, d, "nation"), "n_nationkey").limit(-5).df.select("n_nationkey")


@_array("da_concat", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def _(spark, d):
    a = DataArray.of(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "k")
    return a.concat(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).df.select("name")


@_array("da_group_by", "SELECT o_orderpriority AS k, count(*) AS n, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(spark, d):
    groups = _orders(spark, d).group_by(k=F.col("o_orderpriority"))
    return groups.aggregate(n=F.count("*"), first_key=F.min("o_orderkey"), total=F.round(F.sum("o_totalprice"), 2))


@_array("da_group_in", "SELECT o_orderpriority AS k, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return _orders(spark, d).group_by(k=F.col("o_orderpriority")).group_in(s=F.col("o_orderstatus")).aggregate(n=F.count("*"))


@_array("da_group_slice", "WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS i FROM orders) SELECT o_orderpriority AS k, count(*) AS n FROM r WHERE i > 2000 AND i <= 9000 GROUP BY 1")
def _(spark, d):
    return _orders(spark, d).group_by(k=F.col("o_orderpriority")).slice(2000, 9000).aggregate(n=F.count("*"))


@_array("da_distinct_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return _orders(spark, d).distinct("o_custkey").df.select("o_custkey", "o_orderkey")


@_array("da_every_some_none", "SELECT bool_and(o_totalprice > 0) AS every, bool_or(o_totalprice > 499000) AS some, NOT bool_or(o_totalprice < 0) AS none_of FROM orders")
def _(spark, d):
    a = _orders(spark, d)
    p = F.col("o_totalprice")
    return a.df.agg(a.every(p > 0).alias("every"), a.some(p > 499000).alias("some"), a.none(p < 0).alias("none_of"))


@_array("da_first_last", "SELECT min(o_orderkey) AS o_orderkey FROM orders UNION ALL SELECT max(o_orderkey) FROM orders")
def _(spark, d):
    a = _orders(spark, d)
    return a.first().select("o_orderkey").unionByName(a.last().select("o_orderkey"))


@_array("da_find_index", "SELECT count(*) AS at FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    return spark.createDataFrame([(_orders(spark, d).find_index(F.col("o_orderstatus") == "P"),)], "at long")


@_array("da_index_of", "SELECT count(*) AS at, true AS has FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderpriority = '5-LOW')")
def _(spark, d):
    a = _orders(spark, d)
    return spark.createDataFrame([(a.index_of("o_orderpriority", "5-LOW"), a.includes("o_orderpriority", "5-LOW"))], "at long, has boolean")


@_array("da_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS index FROM orders")
def _(spark, d):
    return _orders(spark, d).sort(F.col("o_totalprice"), "desc").indexed().select("o_orderkey", "index")


@_array("da_paging", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return _orders(spark, d).page(2).select("o_orderkey")


@_array("da_join", "SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation")
def _(spark, d):
    a = DataArray.of(table(spark, d, "nation"), "n_nationkey")
    return a.df.agg(a.join_text(F.col("n_name")).alias("names"))


@_array("da_expand", "SELECT 'region' AS level, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def _(spark, d):
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("k"), F.lit("nation").alias("level"), F.array().cast("array<string>").alias("below"), "n_regionkey")
    below = nations.groupBy("n_regionkey").agg(F.collect_list("k").alias("below"))
    regions = table(spark, d, "region").join(below, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("k"), F.lit("region").alias("level"), F.coalesce("below", F.array().cast("array<string>")).alias("below"))
    return DataArray.of(regions, "k").expand(nations.drop("n_regionkey"), key="k", child="below").df.groupBy("level").agg(F.count("*").alias("n"))


# what the queries above show by constants only, by values of the rows
_rows("op_round_digits", "lineitem", "l_orderkey", {"a": "round(l_extendedprice / l_quantity, 1)", "b": "round(l_extendedprice * 1.5, 0)"}, "CASE WHEN (l_extendedprice / l_quantity * 4) % 2 = 1 THEN floor(l_extendedprice / l_quantity * 10 + 0.5) / 10 ELSE printf('%.1f', l_extendedprice / l_quantity)::DOUBLE END AS a, floor(l_extendedprice * 1.5 + 0.5) AS b")
_rows("op_compare_kinds", "orders", "o_orderkey", {"c": "choice(o_totalprice > 200000, 1, 9) < o_orderkey", "d": "default(choice(o_orderkey % 2, o_totalprice, null), 0) < 150000", "e": "choice(o_orderkey % 2, o_totalprice, null) != null"}, "CASE WHEN o_totalprice > 200000 THEN 1 ELSE 9 END < o_orderkey AS c, CASE WHEN o_orderkey % 2 <> 0 THEN o_totalprice ELSE 0 END < 150000 AS d, CASE WHEN o_orderkey % 2 <> 0 AND o_totalprice IS NOT NULL THEN true END AS e")
_rows("op_object_merge_rows", "part", "p_partkey", {"a": "({n: p_name, s: p_size} + {s: p_size * 2}).s", "b": "({n: p_name} + {n: p_brand, s: 1}).n"}, "p_size * 2.0::DOUBLE AS a, p_brand AS b")
_rows("op_index_text", "part", "p_partkey", {"a": "p_name[0]", "b": "p_name[p_size % 7]", "c": "p_name[length(p_name) - 1]"}, "substr(p_name, 1, 1) AS a, nullif(substr(p_name, (p_size % 7 + 1)::BIGINT, 1), '') AS b, substr(p_name, length(p_name), 1) AS c")
_rows("op_index_array_key", "part", "p_partkey", {"a": 'join([{n: p_name}, {n: p_brand}]["n"], "|")', "b": 'sum([{n: p_size}, {n: p_partkey}].n)'}, "concat(p_name, '|', p_brand) AS a, p_size + p_partkey + 0.0::DOUBLE AS b")
_rows("op_dur_sum", "part", "p_partkey", {"h": "(dur(50m) * p_size + dur(40m)).hours", "m": "(dur(50m) * p_size + dur(40m)).minutes", "d": "(dur(50m) * p_size - dur(30m)).minutes"}, "floor(((50 * p_size + 40) % 1440) / 60)::DOUBLE AS h, ((50 * p_size + 40) % 60)::DOUBLE AS m, ((50 * p_size - 30) % 60)::DOUBLE AS d")
_rows("op_method", "part", "p_partkey", {"a": 'p_name.upper().split(" ")[1]', "b": "[p_size, p_partkey].max()", "c": "p_brand.length()"}, "split_part(upper(p_name), ' ', 2) AS a, greatest(p_size, p_partkey)::DOUBLE AS b, length(p_brand)::DOUBLE AS c")
_rows("fn_all_none", "embeddings", "vec_id", {"a": "all(embedding, (x) => x < 2)", "b": "none(embedding, (x) => x > 2)", "c": "all([label % 2, label % 3])", "d": "any(label % 2, label % 3)", "e": "none([label % 2])"}, "list_bool_and(list_transform(embedding, lambda x: x < 2)) AS a, NOT list_bool_or(list_transform(embedding, lambda x: x > 2)) AS b, label % 2 <> 0 AND label % 3 <> 0 AS c, label % 2 <> 0 OR label % 3 <> 0 AS d, label % 2 = 0 AS e")
_rows("fn_array_flat", "part", "p_partkey", {"a": 'join(array(p_name, p_brand), "|")', "b": 'join(flat([[p_name, p_brand], [p_type]]), "|")', "c": 'join(nonnull([p_name, choice(p_size % 2, p_brand, null), p_type]), "|")'}, "concat(p_name, '|', p_brand) AS a, concat(p_name, '|', p_brand, '|', p_type) AS b, concat_ws('|', p_name, CASE WHEN p_size % 2 <> 0 THEN p_brand END, p_type) AS c")
_rows("fn_slice_items", "part", "p_partkey", {"a": 'join(slice(split(p_name + " " + p_type, " "), 1, 3), "|")', "b": 'join(slice([p_name, p_brand, p_type], p_size % 3), "|")'}, "array_to_string(string_split(concat(p_name, ' ', p_type), ' ')[2:3], '|') AS a, array_to_string([p_name, p_brand, p_type][(p_size % 3 + 1)::BIGINT:3], '|') AS b")
_rows("fn_hash_rows", "nation", "n_nationkey", {"h": "hash(n_name) % 1000003"}, "(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 1000003)::DOUBLE AS h")
_rows("fn_length_text", "documents", "doc_id", {"a": "length(text)", "b": "length(split(text, \"\\n\"))"}, "(coalesce(length(text), 0) + coalesce(length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')), 0))::DOUBLE AS a, coalesce(len(string_split(text, chr(10))), 0)::DOUBLE AS b")
_rows("fn_link_rows", "part", "p_partkey", {"b": 'meta(link(p_name + choice(p_size % 2, "#^x", "#Head one"))).type', "c": 'meta(embed(link(p_name), p_size % 2)).embed', "d": 'meta(link(p_name + "#Head, one")).subpath', "e": 'meta(link(p_name, p_brand)).display'}, "CASE WHEN p_size % 2 <> 0 THEN 'block' ELSE 'header' END AS b, p_size % 2 <> 0 AS c, 'Head one' AS d, p_brand AS e")


@_array("da_nested", "SELECT o_orderpriority AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS at, o_orderkey FROM orders")
def _(spark, d):
    groups = _orders(spark, d).group_by(k=F.col("o_orderpriority")).group_in(s=F.col("o_orderstatus")).nested("o_orderkey")
    return groups.select("k", "s", F.posexplode("rows").alias("at", "row")).select("k", "s", F.col("at").cast("long").alias("at"), "row.o_orderkey")


@_array("da_slice_end", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET (SELECT count(*) - 700 FROM orders)")
def _(spark, d):
    return _orders(spark, d).sort(F.col("o_totalprice"), "desc").slice(-700, -200).df.select("o_orderkey")


@_array("da_paged", "SELECT o_orderkey, (SELECT ceil(count(*) / 50) FROM orders)::BIGINT AS pages FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET (SELECT (ceil(count(*) / 50) - 1)::BIGINT * 50 FROM orders)")
def _(spark, d):
    page = _orders(spark, d).paged(10**9)
    return page.rows.select("o_orderkey", F.lit(page.pages).cast("long").alias("pages"))


@_array("da_comparator", "SELECT o_orderkey, row_number() OVER (ORDER BY length(o_orderpriority), o_orderkey) - 1 AS index FROM orders")
def _(spark, d):
    return _orders(spark, d).sort(F.col("o_orderpriority"), comparator=lambda a, b: len(a) - len(b)).indexed().select("o_orderkey", "index")


@_array("da_expand_all", "SELECT 'c' || c_custkey AS k, 0 AS depth FROM customer UNION ALL SELECT 'o' || o_orderkey, 1 FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey || '.' || l_quantity::BIGINT, 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    none = F.array().cast("array<string>")
    items = table(spark, d, "lineitem").select(F.concat(F.lit("l"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"))).alias("k"), none.alias("below"), F.concat(F.lit("o"), "l_orderkey").alias("up"))
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("k"), F.concat(F.lit("c"), "o_custkey").alias("up"))
    held = lambda rows: rows.groupBy(F.col("up").alias("k")).agg(F.collect_list("k").alias("below"))
    middle = orders.join(held(items), "k", "left").select("k", F.coalesce("below", none).alias("below"))
    top = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k")).join(held(orders), "k", "left").select("k", F.coalesce("below", none).alias("below"))
    return DataArray.of(top, "k").expand(middle.unionByName(items.select("k", "below")), key="k", child="below").df.select("k", F.col("_depth").alias("depth"))
