"""A small vault: reading, queries over trees and links, live changes, and the interface."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from noteweave.api import Engine
from noteweave.functions.literals import Duration, Link
from noteweave.plans import ast as A
from noteweave.plans.store import Planner
from noteweave.sources import inline_fields as I
from noteweave.sources.markdown import front_tags, links_of_line as I_links, markdown_objects, objects_of, parse_files, read_vault, vault_store
from noteweave.streaming.live import FILES, LiveIndex

VAULT = {
    "Games/Chess.md": "---\nTags: game, board/old\nrating: 9\ndue: 2024-01-02\nlength: 4h 15m\nup: '[[Index]]'\n---\nText before [[Go|the other]] #intro\n\n# Rules\nPlay slowly. [level:: hard] ^rules\n\n- first #opening\n  - [x] learn [done:: 2024-02-03] ✅ 2024-05-06\n  - [/] more\n- second\n\n```js,ts\n#nottag\n```\n",
    "Games/Go.md": "# Stones\nsee [[Chess#Rules]] and [[Missing]]\n\nRating:: 7\nempty::\n",
    "Games/Deep/Shogi.md": "No heading here, only [[Go]].\nrating:: high\n",
    "Index.md": "[[Games/Chess.md]] [[Shogi]] [[Index]]\n\n    #indented code\n\n```yaml:data\nkind: list\ntags: [data]\n```\n",
    "Other/Go.txt": None,
    "Board.canvas": json.dumps({"nodes": [{"id": "t1", "type": "text", "text": "# Plan\n- [ ] do it #canvas [[Go]]"}, {"id": "f1", "type": "file", "file": "Index.md"}, {"id": "w1", "type": "link", "url": "http://x.invalid"}, {"id": "g", "type": "group"}]}),
}


def files(spark, vault, day=1):
    at = dt.datetime(2024, 1, day)
    return spark.createDataFrame([(p, t, at, at, len(t or "")) for p, t in vault.items()], FILES)


@pytest.fixture(scope="module")
def objects(spark):
    return parse_files(files(spark, VAULT), 1).cache()


@pytest.fixture(scope="module")
def find(objects):
    store = vault_store(objects)
    return lambda q, this=None: sorted(r["id"] for r in Planner(store, this).run(q).select("id").collect())


def test_objects(objects):
    kinds = {r["typename"]: r["n"] for r in objects.groupBy("typename").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"Page": 4, "File": 1, "Canvas": 1, "Text Card": 1, "File Card": 1, "Web Card": 1, "Section": 6, "Block": 6, "List Block": 2, "List Item": 2, "Task": 3, "Codeblock": 2, "Datablock": 1}
    assert objects.groupBy("id").count().where("count > 1").count() == 0


CHESS, RULES = "Games/Chess.md", "Games/Chess.md/section1/Rules"
QUERIES = {
    "@page": [CHESS, "Games/Deep/Shogi.md", "Games/Go.md", "Index.md"],
    "@page and rating >= 9": [CHESS, "Games/Deep/Shogi.md"],  # a text is greater than any number
    "@page and rating = 7": ["Games/Go.md"],
    "@page and !exists(rating)": ["Index.md"],
    "@page and !(rating > 8)": ["Games/Go.md", "Index.md"],
    "@page and expr(!(rating > 8))": ["Games/Go.md"],
    "exists(empty) and @page": ["Games/Go.md"],
    "@page and #board": [CHESS],
    "#opening and @list-item": ["Games/Chess.md/list12"],
    "@task and $completed": ["Games/Chess.md/list13"],
    "@task and $status != \"x\"": ["Board.canvas/t1/list1", "Games/Chess.md/list14"],
    'path("Games/Deep") and @page': ["Games/Deep/Shogi.md"],
    'epath("Games") and @page': [CHESS, "Games/Go.md"],
    'path("Games/Go.md") and @page': ["Games/Go.md"],
    f'childof(id("{RULES}")) and @list-item': ["Games/Chess.md/list12", "Games/Chess.md/list13", "Games/Chess.md/list14", "Games/Chess.md/list15"],
    "parentof(@task and done)": sorted([CHESS, RULES, "Games/Chess.md/block3", "Games/Chess.md/list12"]),
    'supertree(id("Games/Chess.md/list13")) and @list-item': ["Games/Chess.md/list12", "Games/Chess.md/list13"],
    "subtree(@section and $title = \"Stones\") and !@block": ["Games/Go.md/section1/Stones"],
    "linksto([[Go]]) and @page": [CHESS, "Games/Deep/Shogi.md"],
    "[[Go]] and @page": [CHESS, "Games/Deep/Shogi.md"],
    "linkedfrom([[Index]]) and @page": [CHESS, "Games/Deep/Shogi.md"],
    "connected(id(\"Games/Deep/Shogi.md\")) and @page": ["Games/Go.md", "Index.md"],
    "[[Chess#Rules]] and @page": ["Games/Go.md"],
    "@page and length < dur(5h)": [CHESS],
    "@page and due.year = 2024": [CHESS],
    "@codeblock and contains($languages, \"ts\")": ["Games/Chess.md/codeblock17"],
    "@datablock and kind = \"list\"": ["Index.md/datablock4"],
    "@web-card or @canvas-web-card": ["Board.canvas/w1"],
    "#canvas and @canvas": ["Board.canvas"],
}


@pytest.mark.parametrize("q", QUERIES)
def test_query(find, q):
    assert find(q) == QUERIES[q]


def test_links_by_hops(find):
    go = A.ById("Games/Go.md")
    pages = {k: find(A.And((A.ByType("page"), A.Linked(go, "both", k)))) for k in (0, 1, 2)}
    assert pages[0] == [] and pages[1] == [CHESS, "Games/Deep/Shogi.md"] and pages[2] == [CHESS, "Games/Deep/Shogi.md", "Index.md"]
    assert "Games/Go.md" in find(A.Linked(go, "both", 2, True)) and find(A.Linked(go, "both", -1)) == []


def test_logic_of_sets(find):
    everything = set(find(A.ALL))
    a, b = "@page", "#intro"
    assert set(find(f"!({a} or {b})")) == everything - set(find(a)) - set(find(b)) == set(find(f"!{a} and !{b}"))
    assert set(find(f"!(childof({a}) or {b})")) == everything - set(find(f"childof({a})")) - set(find(b))
    assert find(A.FieldEquals("$status", ("x", "/"))) == ["Games/Chess.md/list13", "Games/Chess.md/list14"]
    assert find(A.FieldEquals("rating", (7.0,))) and find("@page and rating = this.want", {"want": 7.0}) == ["Games/Go.md"]


def test_reading_a_folder(spark, tmp_path):
    for p, t in VAULT.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t or "any")
    (tmp_path / "odd + name.png").write_bytes(b"\xff")
    (tmp_path / "Deep dir").mkdir()
    for empty in ("empty.md", "Deep dir/none.txt", "Deep dir/none.canvas"):
        (tmp_path / empty).touch()
    got = {r["id"] for r in read_vault(spark, str(tmp_path)).where("id = file").select("id").collect()}
    assert got == {*VAULT, "odd + name.png", "empty.md", "Deep dir/none.txt", "Deep dir/none.canvas"}


def test_live(spark, tmp_path):
    index, seen = LiveIndex(spark, str(tmp_path / "index")), []
    events = []
    index.listeners.append(lambda *e: events.append(e))
    index.watch("@page and rating = 7", lambda df: seen.append(sorted(r["id"] for r in df.collect())))
    index.apply(files(spark, VAULT))
    index.apply(files(spark, {"Index.md": "rating:: 7\n"}, 2))
    index.apply(None, spark.createDataFrame([("Games/Go.md",)], "path string"))
    index.touch()
    assert seen == [[], ["Games/Go.md"], ["Games/Go.md", "Index.md"], ["Index.md"]]
    assert [r for _, r in events] == [1, 2, 3, 4] and index.objects().where("file = 'Games/Go.md'").isEmpty()
    listing = spark.createDataFrame([("Index.md", dt.datetime(2024, 1, 3)), ("New.md", dt.datetime(2024, 1, 1)), (CHESS, dt.datetime(2024, 1, 1))], "path string, mtime timestamp")
    changed, gone = index.sync(listing)
    assert {r[0] for r in changed.collect()} == {"Index.md", "New.md"} and {r[0] for r in gone.collect()} == {"Games/Deep/Shogi.md", "Other/Go.txt", "Board.canvas"}
    assert index.clear() == 5 and index.objects().isEmpty()


def test_following_a_folder(spark, tmp_path):
    source = tmp_path / "v"
    source.mkdir()
    (source / "a.md").write_text("x:: 1\n")
    index = LiveIndex(spark, str(tmp_path / "index"))
    index.follow(str(source), str(tmp_path / "c"), once=True).awaitTermination()
    index = LiveIndex(spark, str(tmp_path / "index"))  # opened again
    (source / "b.md").write_text("x:: 2\n")
    index.follow(str(source), str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted(r["id"] for r in index.query("@page and x > 0").collect()) == ["a.md", "b.md"]


def test_an_index_goes_on_where_it_ended(spark, tmp_path):
    folder = str(tmp_path / "index")
    first = LiveIndex(spark, folder)
    first.apply(files(spark, {"a.md": "x:: 1\n", "b.md": "x:: 2\n"}))
    second = LiveIndex(spark, folder)
    assert second.revision == 1 and sorted(r["id"] for r in second.query("@page and x > 0").collect()) == ["a.md", "b.md"]
    assert second.apply(files(spark, {"c.md": "x:: 3\n"}), batch=("s", 0)) == 2
    third = LiveIndex(spark, folder)
    assert third.apply(files(spark, {"c.md": "x:: 9\n"}), batch=("s", 0)) == 2  # handed over again
    assert sorted((r["id"], r["revision"]) for r in third.query("@page and x < 9").collect()) == [("a.md", 1), ("b.md", 1), ("c.md", 2)]
    assert third.reindex(files(spark, {"d.md": "x:: 4\n"})) == 3 and [r["id"] for r in LiveIndex(spark, folder).query("@page").collect()] == ["d.md"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    import json as j

    folder = tmp_path / "index"
    index = LiveIndex(spark, str(folder), buckets=8)
    index.apply(files(spark, {f"f{i}.md": f"n:: {i}\n" for i in range(60)}))
    before = dict(index._places)
    for day in (2, 3, 4):
        index.apply(files(spark, {"f7.md": f"n:: {100 * day}\n"}, day), spark.createDataFrame([("none.md",)], "path string") if day == 3 else None)
    changed = {b for b in before if index._places[b] != before[b]}
    assert len(before) == 8 and 1 <= len(changed) <= 2
    assert [r["id"] for r in index.query("@page and n > 59").collect()] == ["f7.md"] and index.query("@page").count() == 60
    held = sorted(p.name for p in (folder / "data").iterdir())
    assert "2" not in held and held[0] == "1" and len(list((folder / "manifests").glob("*.json"))) == 2
    newest = sorted((folder / "manifests").glob("*.json"))[-1]
    newest.write_text(j.dumps({**j.loads(newest.read_text()), "version": 1}))
    (folder / "manifests" / f".{newest.name}.crc").unlink(missing_ok=True)
    old = LiveIndex(spark, str(folder))
    assert old.outdated and old.objects().isEmpty() and old.revision == 4


def test_stored_data_are_released(spark):
    from noteweave.common import release, shelve

    release(spark)
    shelved = shelve(spark.range(3), "any")
    assert shelved.count() == 3 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(shelved.inputFiles()[0]).count()


def test_interface(spark, objects):
    e = Engine(vault_store(objects))
    assert e.page(CHESS)["name"] == "Chess" and e.page("nowhere") is None
    assert not e.try_query("@page and").successful and e.try_query("@page").successful
    assert e.full_query("@page").revision == 1
    assert e.evaluate("[[Go]].rating + 1") == 8 and e.evaluate("a * 2", {"a": 3.0}) == 6
    assert e.resolve_path("Shogi") == "Games/Deep/Shogi.md" and e.resolve_path("Missing") is None
    assert e.local("Games/Go.md").resolve_path("Chess") == CHESS and e.local(CHESS).current_file()["id"] == CHESS
    assert e.element_text(RULES, files(spark, VAULT)).startswith("# Rules\nPlay")
    assert e.coerce.number("a 5") == 5 and e.coerce.duration("1h") == Duration(hours=1) and e.coerce.link("[[X|y]]") == Link("X", display="y") and e.coerce.boolean("TRUE") is True
    assert not e.try_parse_link("x").successful and e.header_link("a", "b") == Link("a", "header", "b")
    assert e.array(e.query("@page")).sort(F.col("name"), "desc").limit(1).array()[0]["name"] == "Shogi"


def test_expanding_children(spark, objects):
    e = Engine(vault_store(objects))
    levels = {r["id"]: r["level"] for r in e.expand('id("Games/Chess.md")', 3).collect()}
    assert levels[CHESS] == 0 and levels[RULES] == 1 and levels["Games/Chess.md/list12"] == 3 and "Games/Chess.md/list13" not in levels
    lists = {(r["root"], r["level"], r["id"]) for r in e.expand("@block-list").collect()}
    assert {(root, id_) for root, level, id_ in lists if level == 0} == {(r["id"], r["id"]) for r in e.query("@block-list").collect()} and len(lists) == 2 + 5
    assert ("Games/Chess.md/block3", 2, "Games/Chess.md/list13") in lists
    assert {r["id"] for r in e.expand('id("Games/Chess.md")').collect()} == {r["id"] for r in e.query('subtree(id("Games/Chess.md"))').collect()}


def test_functions_of_ones_own(objects):
    import sys
    from types import ModuleType

    from noteweave.functions.registry import Modules, register, unregister

    register("twice", lambda x: x * 2, over={1: (0,)})
    e = Engine(vault_store(objects))
    assert e.evaluate("twice([1, 2])") == [2, 4]
    assert [r["id"] for r in e.query("@page and twice(rating) = 14").select("id").collect()] == ["Games/Go.md"]
    unregister("twice")
    a, b = ModuleType("nw_a"), ModuleType("nw_b")
    a.FUNCTIONS, a.REQUIRES, b.REQUIRES = {"three": lambda: 3.0}, ("nw_b",), ("nw_a",)
    sys.modules |= {"nw_a": a, "nw_b": b}
    with pytest.raises(ImportError):
        Modules().require("nw_a")
    b.REQUIRES = ()
    Modules().require("nw_a")
    assert e.evaluate("three() + 1") == 4
    unregister("three")


@pytest.mark.parametrize("line,keys", [
    ("[key:: value] and so, [key2:: value2]", ["key", "key2"]), ("[[[[hello:: 16]]", ["hello"]), ("(a:: [x] y) z", ["a"]), (r"\[no:: 1] [yes:: 2]", ["yes"]), ("**Bold key**:: 5", ["Bold key"]), ("- item:: 3", ["item"]), ("no field", []), ("::", []), ("[a:: 1] b:: 2", ["a"]),
])
def test_inline_fields(line, keys):
    assert [f.key for f in I.fields_of_line(line)] == keys


def test_edits():
    assert I.set_field("a [k:: 1] b", "k", "2") == "a [k:: 2] b" and I.set_field("a [k:: 1] b", "k") == "a b"
    assert I.set_field("a", "k", "1") == "a [k:: 1]" and I.set_completion("- [x] a", "2024-01-02") == "- [x] a ✅ 2024-01-02" and I.set_completion("a ✅ 2024-01-02") == "a"
    assert I.clean_text("do [k:: 1] it \U0001F4C5 2024-01-02 ^id") == "do it" and I.replace_lines("a\nb\nc", 1, 2, str.upper) == "a\nB\nc" and I.line_span("a\nb\nc", 1, 3) == "b\nc"
    assert [(f.key, f.raw) for f in I.task_fields("x ➕ 2024-01-01 ✅2024-01-02")] == [("created", "2024-01-01"), ("completion", "2024-01-02")]
    assert front_tags(["a", ["#b c", None]]) == ["#a", "#b", "#c"]


def test_odd_files():
    assert len(markdown_objects("a.md", "")) == 1 and len(objects_of("c.canvas", "not json")) == 1 and len(objects_of("c.canvas", "")) == 1
    assert objects_of("x/noending", None)[0]["extension"] == "" and len(markdown_objects("l.md", "- a\n" * 5000)) == 5003


# fields of no fixed kind, of parents and of what links lead to

LINKED = {
    "Go.md": "rating:: 7\nborn:: 2001-05-06\n\n# Play\nslow:: true\n",
    "Chess.md": "rating:: 9\nauthor:: [[Go]]\nteam:: [[Go]], [[Sub/Ludo]]\n\n# Rules\nrating:: none\n",
    "Sub/Ludo.md": "rating:: 2\nauthor:: [[Race]]\nspan:: 3h\n\n# Dice\nlink:: [[Race]]\n",
    "Sub/Race.md": "rating:: high\nauthor:: [[/Chess]]\n",
    "Race.md": "rating:: 1\n",
}


@pytest.fixture(scope="module")
def linked(spark):
    return vault_store(parse_files(files(spark, LINKED), 1).cache())


LINK_QUERIES = {
    "@page and rating > [[Go]].rating": ["Chess.md", "Sub/Race.md"],
    "@page and rating > [[Missing]].rating": ["Chess.md", "Go.md", "Race.md", "Sub/Ludo.md", "Sub/Race.md"],
    "@page and author.rating = 7": ["Chess.md"],
    "@page and author.author.rating = 7": ["Sub/Race.md"],
    "@page and author.rating = \"high\"": ["Sub/Ludo.md"],  # read from its own folder
    "@page and author.author.author = [[Go]]": ["Sub/Ludo.md"],
    "@section and $parent.rating = 9": ["Chess.md/section0/Chess", "Chess.md/section1/Rules"],
    "@section and $parent.author.rating = 7": ["Chess.md/section0/Chess", "Chess.md/section1/Rules"],
    "@section and $parent.$name = \"Ludo\" and exists(link)": ["Sub/Ludo.md/section1/Dice"],
    "@section and (link.rating = \"high\" or $parent.rating > 7)": ["Chess.md/section0/Chess", "Chess.md/section1/Rules", "Sub/Ludo.md/section1/Dice", "Sub/Race.md/section0/Race"],
    "@page and contains(map(team, (t) => t.rating), 2)": ["Chess.md"],
    "@page and team.rating[1] = 2": ["Chess.md"],
    "@page and born.year = 2001": ["Go.md"],
    "@page and span > dur(2h) and span < dur(4h)": ["Sub/Ludo.md"],
    "@page and born < date(2002-01-01)": ["Go.md"],
    "@section and slow": ["Go.md/section1/Play"],
    "@section and slow = true": ["Go.md/section1/Play"],
    "@page and rating != 9 and rating < \"m\"": ["Go.md", "Race.md", "Sub/Ludo.md", "Sub/Race.md"],
    "@page and author = [[Go]]": ["Chess.md"],
    "@page and !(author & rating > 5)": ["Go.md", "Race.md", "Sub/Ludo.md"],
    "childof(@page and rating = 9) and @section": ["Chess.md/section0/Chess", "Chess.md/section1/Rules"],
    "@section and ($parent.rating = 9 or childof(@page and author.rating = \"high\"))": ["Chess.md/section0/Chess", "Chess.md/section1/Rules", "Sub/Ludo.md/section0/Ludo", "Sub/Ludo.md/section1/Dice"],
}


@pytest.mark.parametrize("q", LINK_QUERIES)
def test_fields_through_links_and_parents(linked, q):
    got = sorted(r["id"] for r in Planner(linked).run(q).select("id").collect())
    assert got == LINK_QUERIES[q]


def test_plain_field_filters_need_no_python(linked):
    for q in ("@page and rating > [[Go]].rating", "@section and $parent.rating = 9", "@page and born < date(2002-01-01)", "@section and slow", "@page and author = [[Go]]"):
        plan = Planner(linked).run(q)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "ArrowEval" not in plan and "NestedLoop" not in plan, q


def test_what_has_no_value_matches_nothing_unless_strict(linked):
    assert [r["id"] for r in Planner(linked).run("@page and rating - born > 0").collect()] == []
    assert Planner(linked).run("@page and (span / 0) = dur(1h)").count() == 0 and Planner(linked).run("@page and (rating * span) > dur(1h)").count() == 1
    with pytest.raises(Exception, match="no - of"):
        Planner(linked, strict=True).run("@page and rating - born > 0").collect()


def test_fields_of_the_asking_file(linked):
    e = Engine(linked, "Sub/Ludo.md")
    assert e.evaluate("this.author.rating") == "high" and e.local("Go.md").evaluate("this.born.year") == 2001
    assert [r["id"] for r in e.query("@page and rating = this.rating").collect()] == ["Sub/Ludo.md"]
    assert [r["id"] for r in e.query("[[Race]] and @page").collect()] == ["Sub/Ludo.md"] and e.resolve_path("Race") == "Sub/Race.md" and e.local("Go.md").resolve_path("Race") == "Race.md"


def test_links_in_both_notations():
    got = [(x.path, x.type, x.subpath, x.display, x.embed) for x in I_links("a [[X|y]] [t](Note%20one.md) ![p](img/a.png \"t\") [h](B.md#Some-part) [b](<C d.md#^id>) [w](https://x.invalid) [m](mailto:a@b) `[c](D.md)` [e]()")]
    assert got == [("X", "file", None, "y", False), ("Note one.md", "file", None, "t", False), ("img/a.png", "file", None, "p", True), ("B.md", "header", "Some-part", "h", False), ("C d.md", "block", "id", "b", False)]


def test_markdown_links_lead_back(spark):
    store = vault_store(parse_files(files(spark, {"A/a.md": "see [the other](b.md) and [c](../x)", "A/b.md": "b", "b.md": "top"})))
    assert sorted(r["id"] for r in Planner(store).run("linksto(id(\"A/b.md\")) and @page").collect()) == ["A/a.md"]


def test_underlined_headings():
    text = "Top\nline\n===\ntext\n\nSub\n---\n- item\n---\n\n---\n\n> quote\n---\n```\nno\n===\n```\n# Last\n"
    got = [(r["title"], r["level"], r["position"]["start"], r["position"]["end"]) for r in markdown_objects("f.md", text) if r["typename"] == "Section"]
    assert got == [("Top line", 1, 0, 5), ("Sub", 2, 5, 18), ("Last", 1, 18, 20)]


def test_long_files_take_linear_time():
    import time

    def took(n):
        text = "".join(f"{'  ' * (i % 5)}- item {i} #t{i % 7} [k{i % 9}:: {i}]\n" + ("\nword\n\n" if i % 50 == 0 else "") for i in range(n))
        start = time.perf_counter()
        assert len(markdown_objects("l.md", text)) > n
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 14 * took(2_000)


def test_raw_texts_of_fields_and_edits_where_they_stand():
    text = "---\nDue: 2024-01-02\ntags:\n  - a\n---\nx [k:: 1 h]\nWhole:: 5\n"
    page = markdown_objects("f.md", text)[0]
    assert dict(page["raw"]) == {"due": '"2024-01-02"', "tags": '["a"]', "k": "1 h", "whole": "5"} or dict(page["raw"])["due"] == "2024-01-02"
    edit = I.edit_field
    assert edit(text, "due", "2025-01-01").split("\n")[1] == "Due: 2025-01-01" and "  - a" not in edit(text, "tags", "[b]") and "tags: [b]" in edit(text, "tags", "[b]")
    assert edit(text, "new", "1").split("\n")[4] == "new: 1" and edit("x", "a", "1") == "---\na: 1\n---\nx" and edit("x", "a") == "x" and "Due" not in edit(text, "DUE")
    assert edit(text, "K", "2", line=5).split("\n")[5] == "x [k:: 2]" and edit(text, "whole", "6", line=6).split("\n")[6] == "Whole:: 6" and edit(text, "k", line=5).split("\n")[5] == "x"


def test_overloads(objects):
    from noteweave.functions.registry import Overloads, unregister

    f = Overloads("size").add("string", form=lambda s: float(len(s))).add("number", "*", form=lambda n, _: n).vectorize(1, 0).build()
    e = Engine(vault_store(objects))
    assert e.evaluate('size("abc")') == 3 and e.evaluate('size(["a", "bb"])') == [1, 2] and e.evaluate("size(4, null)") == 4 and e.evaluate("size(null)") is None
    assert not e.try_evaluate("size(true)").successful and f.vararg(lambda *a: float(len(a)))(1, 2, 3) == 3
    unregister("size")


def test_equal_queries_share_a_plan(objects):
    e = Engine(vault_store(objects))
    assert e.query("@page and rating > 1") is e.query("(@page) and rating>1") and e.query("@page") is not e.query("@task")
