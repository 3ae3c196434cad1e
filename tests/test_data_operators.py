"""The general data operators: against plain Python on the smallest tables, and on odd input."""

import datetime as dt
import json
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from noteweave.operators.arrays import DataArray
from noteweave.operators.instants import fit_notations, normalise_instants
from noteweave.operators.references import canonical_path, orphan_references, orphan_report
from noteweave.operators.shred import adjacency, entities, members, with_parents
from noteweave.operators.wide import wide_table
from noteweave.plans import data_queries as Q
from noteweave.plans import object_queries as O
from noteweave.sources import vault_tables as V
from tests import brute_vault as B

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict(True) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


@pytest.fixture(scope="module")
def types(spark):
    return {r["field_key"]: r["field_type"] for r in rows(spark, "field_types")}


@pytest.fixture(scope="module")
def zones(spark):
    return {r["vault"]: r["zone_name"] for r in rows(spark, "vaults")}


def test_p1_found(spark, types, zones):
    got = Q.p1_found(spark, SF).collect()
    assert {tuple(r) for r in got} == B.misfits(rows(spark, "page_fields"), types, zones) and len(got) == len(set(got)) > 0


def test_p1_wide_has_pages_without_declared_keys(spark, tmp_path):
    for name in ("field_types", "vaults"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    fields = spark.read.parquet(f"{SF}/page_fields.parquet").limit(50)
    other = fields.limit(3).withColumns({"page_path": F.lit("only/undeclared.md"), "entry_key": F.when(F.col("field_id") % 2 == 0, F.lit("no such key"))})
    fields.unionByName(other).write.parquet(f"{tmp_path}/page_fields.parquet")
    got = [r.asDict() for r in Q.p1_wide(spark, str(tmp_path)).collect()]
    alone = [r for r in got if r["page_path"] == "only/undeclared.md"]
    assert len(alone) == 1 and alone[0].pop("misfits") == [] and set(alone[0].values()) == {"only/undeclared.md", None}
    assert {r["page_path"] for r in got} == {r["page_path"] for r in fields.collect() if r["page_path"] is not None} | {"only/undeclared.md"}


def test_p2_found(spark):
    got = Q.p2_found(spark, SF).collect()
    assert {tuple(r) for r in got} == B.orphans(rows(spark, "page_links"), rows(spark, "canvases"), rows(spark, "vault_files")) and len(got) == len(set(got)) > 0


def test_p4_found(spark):
    got = Counter(map(tuple, Q.p4_found(spark, SF).collect()))
    assert got == Counter(B.nodes(rows(spark, "vault_pages"), rows(spark, "canvases")))


def scalar(x, path, kind):
    """The scalar at ``path``; numbers may be stored as texts."""
    for step in path.split("."):
        x = x.get(step) if isinstance(x, dict) else None
    return None if x is None or isinstance(x, (dict, list)) else {"int": int, "bigint": int, "double": float}.get(kind, lambda v: v)(x)


def entity_rows(spark):
    """By kind, each node's file, card, scalars, and its parent's kind and first line (None outside)."""
    out = {k: Counter() for k in V.NODE_KINDS}

    def walk(f, card, v, kind, up, at):
        for x in B.elements(v):
            inside = x.get("$id") if kind == "card" else card
            line = scalar(x, "$position.start", "bigint") if kind != "card" else None
            out[kind][(f, inside, *(scalar(x, *c) for c in Q.SCALARS[kind].values()), up, at)] += 1
            for label, below in zip(V.NODE_LABELS, V.NODE_KINDS):
                walk(f, inside, x.get(label), below, kind, line)

    for p in B.newest(rows(spark, "vault_pages"), "page_path").values():
        walk(p["page_path"], "", p["sections"], "section", "page", None)
    for c in B.newest(rows(spark, "canvases"), "canvas_path").values():
        walk(c["canvas_path"], None, c["cards"], "card", "canvas", None)
    return out


def test_p4_entity_tables(spark):
    """Parents are looked up by their node in the other tables."""
    tables = {k: [r.asDict() for r in Q.QUERIES[f"p4_{k}s"](spark, SF).collect()] for k in V.NODE_KINDS}
    line = {(k, r["file_path"], r["card_id"], r["node"]): r.get("line_from") for k, t in tables.items() for r in t}
    for kind, want in entity_rows(spark).items():
        got = Counter()
        for r in tables[kind]:
            at = None if r["parent"] < 0 else line[r["parent_kind"], r["file_path"], r["card_id"], r["parent"]]
            got[(r["file_path"], r["card_id"], *(r[c] for c in Q.SCALARS[kind]), r["parent_kind"], at)] += 1
        assert got == want and want
    assert any(r["card_id"] for r in tables["section"]) and any(r["parent_kind"] == "item" for r in tables["item"])


def test_p5_found(spark, types, zones):
    want = {(r["field_id"], t) for r in rows(spark, "page_fields") if types.get((r["entry_key"] or "").strip().lower()) == "date" and (t := B.instant(r["entry_raw"], zones.get(r["vault"]))) is not None}
    assert {tuple(r) for r in Q.p5_found(spark, SF).collect()} == want


# references

AT = dt.datetime(2024, 1, 1)
KIDS = "key string, at timestamp, ref_table string, ref_file string, ref_key string, until int, child string"
KIN = "key string, since timestamp, until timestamp, at int"


def day(n):
    return AT + dt.timedelta(days=n)


def orphans(spark, kids, kin, **more):
    df = orphan_references(spark.createDataFrame([(*k, 0, "x") for k in kids], KIDS), spark.createDataFrame([(*k, 0) for k in kin], KIN), **more)
    return {(r["ref_key"], r["orphan_kind"]) for r in df.collect()}


def test_orphan_kinds(spark):
    kin = [("a", day(1), day(5)), ("a", day(8), None), ("b", None, day(2)), (None, day(0), None), ("a", day(1), day(5))]
    kids = [("a", day(0), "t", "f", "late"), ("a", day(1), "t", "f", "there"), ("a", day(5), "t", "f", "deleted"), ("a", day(9), "t", "f", "back"), ("b", day(1), "t", "f", "from ever"), ("b", day(3), "t", "f", "deleted b"),
            ("c", day(1), "t", "f", "missing"), ("c", day(1), "t", "f", "missing"), (None, day(1), "t", "f", "none"), ("a", None, "t", "f", "no time"), ("c", None, "t", None, "no time, missing")]
    want = {("late", "late"), ("deleted", "deleted"), ("deleted b", "deleted"), ("missing", "missing"), ("no time, missing", "missing")}
    assert orphans(spark, kids, kin) == want == orphans(spark, kids, kin, hot_rows=1)


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], [("a", day(1), None)]) == set()
    assert orphans(spark, [("a", day(1), "t", "f", "k")], []) == {("k", "missing")}
    report = orphan_report(spark.createDataFrame([("t", "f", "k", day(40), "late"), ("t", "f", "l", None, "missing")], "ref_table string, ref_file string, ref_key string, at timestamp, orphan_kind string"))
    assert {tuple(r) for r in report.collect()} == {("t", "2024-02", "late", 1), ("t", None, "missing", 1)}


@pytest.mark.parametrize("path,want", [
    ("Notes/A", "notes/a.md"), (" ./Notes/A%20b.md ", "notes/a b.md"), ("/x.PNG", "x.png"), ("100%", "100%.md"), ("a+b", "a+b.md"), ("%2Fa", "a.md"), ("", None), ("  ", None), (None, None), ("/", None), ("v1.2 notes", "v1.2 notes.md"), ("%C3%A9", "é.md"), ("x" * 5000, "x" * 5000 + ".md"),
])
def test_canonical_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(canonical_path(F.col("p"))).collect()[0][0] == want


# instants


def instants(spark, texts, sources=None, zone="UTC", **more):
    data = [(i, s, t, zone, "clash") for i, (t, s) in enumerate(zip(texts, sources or ["s"] * len(texts)))]
    df = spark.createDataFrame(data, "id int, source string, raw string, zone string, readings string")
    out = normalise_instants(df, key="id", source="source", raw="raw", zone="zone", **more)
    return [r for r in out.orderBy("id").collect()]


def test_instants(spark):
    cases = {
        "2024-03-10T02:30": 1710052200000, "2024-11-03T01:30": 1730608200000 + 3600000 * 0, "2024-01-01": 1704085200000, "2024-02-30": None, "1700000000": 1700000000000, "1700000000123": 1700000000123, "12345": None, "": None, None: None,
        " '2024-01-01T00:00:00.123456Z' ": 1704067200123, "1 May 2024": 1714536000000, "x" * 100_000: None, "24.12.2024 25:00": None, "2024-01-01T10:00[Nowhere/City]": None, "2024-01-01 10:00 Asia/Kolkata": 1704083400000, "Wed, 01 May 2024 00:00:00 +0200": 1714514400000,
    }
    got = instants(spark, list(cases), zone="America/New_York")
    want = dict(cases)
    want["2024-03-10T02:30"] = 1710055800000  # skipped: taken with the offset before the change
    want["2024-11-03T01:30"] = 1730611800000  # twice: the first, in summer time
    assert [r["epoch_ms"] for r in got] == list(want.values())
    assert instants(spark, ["2024-01-01"], zone=None)[0]["epoch_ms"] is None and instants(spark, []) == []


def test_instants_by_the_habits_of_a_source(spark):
    texts = ["03/04/2024", "25/12/2024", "26/12/2024", "27/11/2024", "03/04/2024", "12/25/2024", "12/26/2024", "12/27/2024", "03/04/2024", "04/04/2024"]
    got = instants(spark, texts, ["eu"] * 4 + ["us"] * 4 + ["unknown"] * 2)
    date = lambda r: dt.datetime.fromtimestamp(r["epoch_ms"] / 1000, dt.timezone.utc).date()
    assert date(got[0]) == dt.date(2024, 4, 3) and date(got[4]) == dt.date(2024, 3, 4)
    assert got[8]["ambiguous"] and got[8]["epoch_ms"] is None and not got[9]["ambiguous"] and date(got[9]) == dt.date(2024, 4, 4)
    fitted = fit_notations(pd.DataFrame({"source": ["s", "s"], "signature": [["a"], ["a", "b"]], "n": [9, 1]}))
    assert list(fitted["pick"]) == [0, 0] and fitted["posterior"].min() > 0.99


# wide tables


def test_wide_table(spark):
    cells = [("e1", "n", '"1,234.5"', "UTC", 1), ("e1", "b", '"Yes "', "UTC", 1), ("e1", "d", '"2024-01-01"', "Asia/Tokyo", 1), ("e1", "len", '"1h 30m"', "UTC", 1), ("e1", "l", '["a", 1]', "UTC", 1), ("e1", "up", '"[[X|y]]"', "UTC", 1), ("e2", "n", '"high"', "UTC", 1), ("e2", "b", "null", "UTC", 1),
             ("e2", "t", '" "', "UTC", 1), ("e3", "other", "1", "UTC", 1), (None, "n", "1", "UTC", 1), ("e4", None, "1", None, 1), ("e5", "len", '"PT2H"', None, 1), ("e5", "n", None, None, 1), ("e5", "t", json.dumps("x" * 100_000), None, 1), ("e6", "up", '{"$_type": "link", "value": {"path": "P"}}', None, 1)]
    columns = {"n": "number", "b": "boolean", "d": "date", "len": "duration", "l": "list", "up": "link", "t": "text"}
    df = spark.createDataFrame(cells, "e string, attribute string, value string, zone string, p int")
    got = {r["e"]: r for r in wide_table(df, columns, entity="e").collect()}
    assert set(got) == {"e1", "e2", "e3", "e4", "e5", "e6"}
    one = got["e1"]
    assert (one["n"], one["b"], one["d"], one["len"], one["l"], one["up"], one["t"]) == (1234.5, True, dt.datetime(2023, 12, 31, 15), 5400.0, ["a", "1"], "X", None) and one["misfits"] == []
    assert got["e2"]["misfits"] == ["n"] and got["e2"]["n"] is None and got["e3"]["misfits"] == [] and got["e5"]["len"] == 7200.0 and len(got["e5"]["t"]) == 100_000 and got["e6"]["up"] == "P"
    assert wide_table(df.where("false"), columns, entity="e").count() == 0
    with pytest.raises(ValueError):
        wide_table(df, {"misfits": "text"}, entity="e")


def test_wide_dates_follow_the_habit_of_their_source(spark):
    texts = {"us": ["12/25/2023", "01/31/2024", "02/28/2024", "03/04/2024"], "eu": ["25/12/2023", "31.01.2024", "28/02/2024", "03/04/2024"], "none": ["03/04/2024"]}
    data = [(f"{s}{i}", "d", f'"{t}"', "UTC", s) for s, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, "e string, attribute string, value string, zone string, vault string")
    got = {r["e"]: (r["d"] and r["d"].strftime("%m-%d"), r["misfits"]) for r in wide_table(df, {"d": "date"}, entity="e", source="vault").collect()}
    assert got["us3"] == ("03-04", []) and got["eu3"] == ("04-03", []) and got["none0"] == (None, [])
    raw = spark.createDataFrame([(e, s, v.strip('"'), z) for e, _, v, z, s in data], "id string, source string, raw string, zone string")
    same = {r["id"]: r["epoch_ms"] for r in normalise_instants(raw, key="id", source="source", raw="raw", zone="zone").collect()}
    wide = {r["e"]: r["ms"] for r in wide_table(df, {"d": "date"}, entity="e", source="vault").select("e", F.unix_millis("d").alias("ms")).collect()}
    assert wide == same


def test_declared_types_fold_repeats(spark, tmp_path):
    spark.createDataFrame([(" A ", "number"), ("a", "number"), ("b", None), (None, "text")] + [("a", "number")] * 3000, "field_key string, field_type string").write.parquet(f"{tmp_path}/field_types.parquet")
    assert V.declared_types(spark, str(tmp_path)) == {"a": "number", "b": "text"}


def test_wide_table_equals_pivot_for_any_number_of_columns(spark):
    df = spark.range(200).selectExpr("concat('e', id % 17) e", "concat('a', id % 13) attribute", "cast(id as string) value", "'UTC' zone").dropDuplicates(["e", "attribute"])
    for n in (0, 1, 2, 5, 13):
        columns = {f"a{i}": "number" for i in range(n)}
        got = wide_table(df, columns, entity="e")
        assert got.count() == 17 and got.columns == ["e", *columns, "misfits"]
        if n:
            want = df.groupBy("e").pivot("attribute", list(columns)).agg(F.first(F.col("value").cast("double")))
            assert got.drop("misfits").exceptAll(want).isEmpty()


# nested records


def test_members():
    a, b = {"x": 1}, {"x": 2}
    assert members([a, 5, None, b]) == [a, b] and members({"1": b, "0": a}) == [a, b] and members(a) == [a] and members(json.dumps([a])) == [a] and members(json.dumps(json.dumps(a))) == [a]
    assert members(None) == members("not json") == members(5) == members([]) == members({}) == []


def test_adjacency_of_odd_documents(spark):
    deep = {"v": 0}
    for i in range(200):
        deep = {"v": i, "kids": [deep]}
    docs = [("a", json.dumps([{"v": 1, "p": {"s": "7"}, "kids": [{"v": 2.5}, {"v": None}]}])), ("b", json.dumps([deep])), ("c", None), ("d", ""), ("e", "{"), ("a2", "[]"), (None, json.dumps([{"v": 1}])), ("r", '[{"v": 1}]'), ("r", '[{"v": 1}]')]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "k string, t string, node string")
    adj = adjacency(df, key="k", text="t", label="top", lists=["kids"], scalars=["v", "p.s"])
    flat = entities(adj, labels=["top", "kids"], columns={"v": ("v", "double"), "s": ("p.s", "bigint")})
    got = {}
    for r in with_parents(flat, "v").collect():
        got.setdefault(r["doc"], []).append((r["kind"], r["v"], r["s"], r["parent_v"]))
    assert set(got) == {"a", "b", "r"} and Counter(got["a"]) == Counter([(0, 1.0, 7, None), (1, 2.5, None, 1.0), (1, None, None, 1.0)]) and len(got["b"]) == 201 and got["r"] == [(0, 1.0, None, None)]
    assert entities(adj.where("false"), labels=["top"], columns={}).count() == 0


def test_json_list(spark):
    texts = ['[{"$id": "a"}]', '{"0": {"$id": "a"}}', '{"$id": "a"}', json.dumps('[{"$id": "a"}]'), "[]", "{}", None, "nonsense"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(V.json_list(F.col("t"), "struct<`$id`:string>").alias("l"))
    assert [[x["$id"] for x in r["l"] or []] for r in df.collect()] == [["a"]] * 4 + [[]] * 4


# ordered arrays

NODE = "k string, v int, below array<string>"


def test_expand_has_no_limit_of_depth(spark):
    chain = spark.createDataFrame([(f"n{i}", i, [f"n{i + 1}"]) for i in range(70)] + [("n70", 70, [])], NODE)
    got = DataArray.of(chain.where("v = 0"), "v").expand(chain, key="k", child="below")
    assert [(r["_depth"], r["v"]) for r in got.array()] == [(i, i) for i in range(71)] and got.df.columns == ["k", "v", "below", "_depth"]


def test_expand_of_trees_and_cycles(spark):
    data = [("a", 0, ["b", "c"]), ("b", 1, ["d"]), ("c", 2, ["d", "e", "gone"]), ("d", 3, []), ("e", 4, None)]
    tree = spark.createDataFrame(data, NODE)
    got = DataArray.of(tree.where("k = 'a'"), "v").expand(tree, key="k", child="below")
    assert [(r["_depth"], r["k"]) for r in got.array()] == [(0, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "d")]
    assert DataArray.of(tree.where("false"), "v").expand(tree, key="k", child="below").array() == []
    for loop in ([("a", 0, ["a"])], [("r", 0, ["s"]), ("s", 1, ["x", "t"]), ("x", 2, []), ("t", 3, ["u"]), ("u", 4, ["v"]), ("v", 5, ["t"])]):
        df = spark.createDataFrame(loop, NODE)
        with pytest.raises(ValueError, match="below itself"):
            DataArray.of(df.where("v = 0"), "v").expand(df, key="k", child="below")


def test_sorts_give_all_orders_with_their_position(spark):
    orders = sorted(rows(spark, "orders"), key=lambda r: r["o_orderkey"])
    for name, column, down in (("da_sort_asc_all", "o_totalprice", False), ("da_sort_desc_all", "o_orderpriority", True)):
        want = [r["o_orderkey"] for r in sorted(orders, key=lambda r: r[column], reverse=down)]
        got = {r["index"]: r["o_orderkey"] for r in O.QUERIES[name](spark, SF).collect()}
        assert [got[i] for i in range(len(got))] == want and len(want) > 100


def test_subtree_down_to_the_line_items(spark):
    customers = {r["c_custkey"] for r in rows(spark, "customer") if r["c_acctbal"] < 0}
    orders = {r["o_orderkey"] for r in rows(spark, "orders") if r["o_custkey"] in customers}
    items = [r for r in rows(spark, "lineitem") if r["l_orderkey"] in orders]
    got = [r["id"] for r in O.QUERIES["q_subtree_all"](spark, SF).collect()]
    assert Counter(x.split("/")[0] for x in got) == {"customer": len(customers), "orders": len(orders), "lineitem": len(items)}
    assert {x for x in got if x.startswith("orders/")} == {f"orders/{k}" for k in orders} and {x.split("/")[1] for x in got if x.startswith("lineitem/")} == {str(r["l_orderkey"]) for r in items}


def test_comparators_of_ones_own(spark):
    words = ["bb", "A", "ccc", "a", "BB", None]
    a = DataArray.of(spark.createDataFrame(list(enumerate(words)), "i int, w string"), "i")
    size = lambda x, y: (len(x or "") > len(y or "")) - (len(x or "") < len(y or ""))
    fold = lambda x, y: ((x or "").lower() > (y or "").lower()) - ((x or "").lower() < (y or "").lower())
    assert [r["w"] for r in a.sort(F.col("w"), comparator=size).array()] == [None, "A", "a", "bb", "BB", "ccc"]
    assert [r["w"] for r in a.sort(F.col("w"), "desc", comparator=size).array()] == ["ccc", "bb", "BB", "A", "a", None]
    assert sorted(r["n"] for r in a.group_by(fold, w=F.col("w")).aggregate(n=F.count("*")).collect()) == [1, 1, 2, 2]
    assert sorted(r["i"] for r in a.distinct("w", comparator=fold).df.collect()) == [0, 1, 2, 5]


def test_pages_and_positions(spark, monkeypatch):
    from noteweave.operators import arrays

    a = DataArray.of(spark.range(23), "-id")
    p = a.paged(9, 5)
    assert (p.number, p.pages, p.total, [r["id"] for r in p.rows.collect()]) == (4, 5, 23, [2, 1, 0]) and a.paged(-1, 5).number == 0 and a.where(F.lit(False)).paged(3).pages == 0
    for top in (10_000, 3):
        monkeypatch.setattr(arrays, "TOP", top)
        for lo, hi in ((0, 7), (4, 9), (20, None), (-5, None), (0, -20), (-4, -1), (9, 4), (0, None), (30, 40)):
            assert [r["id"] for r in a.slice(lo, hi).array()] == list(range(22, -1, -1))[lo:hi]


def test_no_step_by_position_moves_all_rows_to_one_task(spark):
    a = DataArray.of(spark.range(100_000).withColumn("k", F.col("id") % 3), "id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (a.slice(50).df, a.limit(-5).df, a.slice(20_000, 70_000).df):
        assert "GlobalLimit" not in plan(df) and "SinglePartition" not in plan(df).split("range")[0]
    assert "WindowGroupLimit" in plan(a.distinct("k").df)
