"""Expressions: text to value by the interpreter, and the same through Spark columns."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from noteweave.functions.interpreter import FUNCTIONS, EvaluationError, Evaluator
from noteweave.functions.columns import COLUMNS
from noteweave.functions.literals import Duration, Link, compare, dumps, loads, to_text
from noteweave.plans import ast as A
from noteweave.plans.expressions import Compiler, Fn, NotStatic, Val, of_type
from noteweave.plans.parser import ParseError, parse_expression, parse_link, parse_query, value_of

D = dt.datetime
CASES = [
    ("map([7, 20, 31], (z) => z * 3 - 1)", [20, 59, 92]), ("min()", None), ("min(8, 5, 13)", 5), ("max([4, 19, 12])", 19), ("min(null, 4)", 4), ("sum([14, 2.5, 3])", 19.5), ('sum(["oak", "-", "elm"])', "oak-elm"),
    ("average([10, 4, 1])", 5), ("product([5, 3, 0.5])", 7.5), ("all(1, [0])", True), ("all([\"x\", \"\"])", False), ("any([0, 1])", True), ("none([0, 0])", True), ("any()", False), ("all()", True),
    ("50 - 6 * 7 + 9 / 4", 10.25), ("((p) => (q, r) => p * q - r)(6)(7, 2)", 40), ('"a" + 5', "a5"), ('5 + "a"', "5a"), ("-5 % 3", -2), ("5 / 0", math.inf), ("null < 5", True), ("5 < null", False), ("null = 5", False),
    ("null != 5", True), ("null = null", None), ("!null", True), ('1 < "a"', True), ('"a" < 1', False), ("true & 0", False), ("false | 1", True), ('"ab" * 3', "ababab"), ('"ab" * -1', ""),
    ('split("kettle;amber;wagon", ";")', ["kettle", "amber", "wagon"]), ('split("x1y22z", "[0-9]+", 2)', ["x", "y"]), ('truncate("thimble and needle", 10)', "thimble..."), ('truncate("oar", 9)', "oar"),
    ('replace(["tin pan","tin cup"], "tin", ["iron","clay"])', ["iron pan", "clay cup"]), ('replace("abc", "b", "x")', "axc"), ('lower("ABC")', "abc"), ('upper(["a", "b"])', ["A", "B"]),
    ('startswith("path/x", "path")', True), ('endswith("path/x", "y")', False), ('padleft("a", 4)', "   a"), ('padright("a", 4, "xy")', "axyx"), ('padleft("abcde", 3)', "abcde"),
    ('substring("lantern", 2, 5)', "nte"), ('substring("lantern", 5, 2)', "nte"), ('substring("lantern", 4)', "ern"), ('regexreplace("abc", "b(c)", "$1x")', "acx"), ('regextest("b", "abc")', True),
    ('regexmatch("b", "abc")', False), ('regexmatch("a|b", "ab")', True), ('regexmatch("^a", "abc")', True), ('contains(["abc"], "b")', True), ('econtains(["abc"], "b")', False), ('icontains("ABC", "b")', True),
    ('contains([1, 2], 2)', True), ('containsword("big word", "WORD")', True), ('containsword("bigword", "word")', False), ("length([1, 2, 3])", 3), ('length("a\U0001F600")', 3), ("length(null)", 0),
    ("round(2.5)", 3), ("round(-2.5)", -2), ("round(1.005, 2)", 1.0), ("round(0.125, 2)", 0.13), ("round([1.4, 1.6])", [1, 2]), ("trunc(-2.7)", -2), ("floor(-2.2)", -3), ("ceil(2.2)", 3),
    ('number("x -3.5 y")', -3.5), ('number("none")', None), ("string(5)", "5"), ("string(5.5)", "5.5"), ("string([1, 2])", "1, 2"), ("string(true)", "true"), ("typeof(5)", "number"), ('typeof("a")', "string"),
    ("reverse([1, 2, 3])", [3, 2, 1]), ('reverse("abc")', "cba"), ("sort([3, 1, 2])", [1, 2, 3]), ("sort([3, 1, 2], (x) => 0 - x)", [3, 2, 1]), ("flat([[1, 2], [3]])", [1, 2, 3]),
    ("reduce([1, 2, 3], \"+\")", 6), ("reduce([8, 2], \"/\")", 4), ("reduce([1, 2, 3], (a, b) => a * 10 + b)", 123), ("filter([1, 2, 3], (x) => x >= 2)", [2, 3]), ("nonnull([1, null, 2])", [1, 2]),
    ("default(null, 3)", 3), ("default([1, null], 0)", [1, 0]), ('choice(1 < 2, "a", "b")', "a"), ("[1, 2, 3][1]", 2), ("[1, 2][5]", None), ("{a: 5}.a", 5), ('{a: 5}["A"]', 5), ("[{a: 1}, {a: 2}].a", [1, 2]),
    ("minby([{a: 2}, {a: 1}], (x) => x.a).a", 1), ("maxby([{k: 1, v: 1}, {k: 1, v: 2}], (x) => x.k).v", 2), ("join([1, 2, 3])", "1, 2, 3"), ('join(["a", "b"], "-")', "a-b"), ("join(4)", "4"),
    ("extract({a: 1, b: 2}, \"b\").b", 2), ("slice([1, 2, 3, 4], 1, 3)", [2, 3]), ("slice([1, 2, 3], -2)", [2, 3]), ("list(1, 2)", [1, 2]), ('object("a", 1).a', 1), ("[1] + [2, 3]", [1, 2, 3]), ("({a: 1} + {a: 2, b: 3}).a", 2),
    ("date(2019-10-31) + dur(4 months)", D(2020, 2, 29)), ("2021-03-04T11:22 - dur(30m)", D(2021, 3, 4, 10, 52)), ("date(2021-03-04).week", 9), ("2021-03-04.year", 2021), ('date("2021-03")', D(2021, 3, 1)),
    ('date("04.11.1998", "dd.MM.yyyy")', D(1998, 11, 4)), ('date("1600000000000", "x")', D(2020, 9, 13, 12, 26, 40)), ('date("nonsense")', None), ("striptime(2021-03-04T11:22)", D(2021, 3, 4)),
    ('dateformat(date(2021-03-04), "yyyy/MM/dd")', "2021/03/04"), ("date(2021-03-31) - date(2021-01-30)", Duration(months=2, days=1)), ("dur(7h 3m)", Duration(hours=7, minutes=3)), ('dur("3 weeks, 5 days")', Duration(weeks=3, days=5)),
    ("dur(90m) + dur(30m)", Duration(hours=2)), ("dur(3h) * 2", Duration(hours=6)), ("dur(6h) / 2", Duration(hours=3)), ("dur(60m) = dur(1h)", True), ("dur(9h 41m).minutes", 41), ('"took " + dur(3h 4m)', "took 3 hours, 4 minutes"),
    ('"on " + date(2021-03-04)', "on March 04, 2021"), ("meta([[Boats/Keel#^oar-7]]).type", "block"), ("[[a/b.md|x]].path", None), ('string([[a/b.md|x]])', "[[a/b.md|x]]"), ('link("X").path', None), ('meta(link("X", "y")).display', "y"), ("meta(embed([[X]])).embed", True),
    ("[[X]] = [[X|other]]", True), ("[1, 2] < [1, 3]", True), ('"a" < "B"', True), ("date(2021-01-01) < date(2021-01-02)", True), ("[1,2,3].filter((x) => x > 1).length()", 2),
]


def plain(v):
    """What a Spark value is in the language."""
    if hasattr(v, "asDict"):
        d = v.asDict()
        return Duration(**{k: float(x) for k, x in d.items()}) if "milliseconds" in d else d
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("text,want", CASES)
def test_interpreter(text, want):
    got = Evaluator().evaluate(parse_expression(text), {})
    assert compare(got, want) == 0, got


def test_columns_agree_with_the_interpreter(spark):
    """All cases in one projection; a case without static kinds must say so."""
    columns, static = [], []
    for i, (text, want) in enumerate(CASES):
        v = Compiler(lambda _: None).value(parse_expression(text))
        columns.append(v.col.alias(f"c{i}"))
        static.append((i, text, want))
    row = spark.range(1).select(*columns).collect()[0]
    wrong = [(text, row[f"c{i}"], want) for i, text, want in static if compare(plain(row[f"c{i}"]), want) != 0]
    assert not wrong


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([(1.0, "a", [1.0, None]), (None, None, None)], "n double, s string, a array<double>")
    names = {f.name: of_type(F.col(f.name), f.dataType) for f in df.schema}
    value = lambda t: Compiler(names.get).value(parse_expression(t)).col
    texts = ["n < 5", "n = 5", "n != 5", "n > 5", 'n + "x"', "lower(s)", "length(a)", "sum(a)", "default(n, 7)", "missing", "missing = n", "!s", "any(a)", "n and s"]
    rows = df.select(*(value(t).alias(f"c{i}") for i, t in enumerate(texts))).collect()
    for row, env in zip(rows, [{"n": 1.0, "s": "a", "a": [1.0, None]}, {"n": None, "s": None, "a": None}]):
        for i, t in enumerate(texts):
            if t == "sum(a)":
                continue  # the interpreter reports the null, a column gives null
            assert compare(row[f"c{i}"], Evaluator().evaluate(parse_expression(t), env)) == 0, t


def test_mixed_kinds_are_not_static():
    for text in ('[1, "a"]', 'choice(true, 1, "a")', 'split("ab", "(a)")'):
        with pytest.raises(NotStatic):
            Compiler(lambda _: None).value(parse_expression(text))
    assert Evaluator().evaluate(parse_expression('split("tar and pitch", "( and )(x)?")'), {}) == ["tar", " and ", "", "pitch"]


def test_every_function_has_a_column_form():
    assert set(FUNCTIONS) == set(COLUMNS)


@pytest.mark.parametrize("text", ["7up", "4.5.6", "nu ll", "(x + 2", "[y, ", '"no end', ""])
def test_bad_expressions(text):
    with pytest.raises(ParseError):
        parse_expression(text)


def test_errors():
    for text in ("null + 5", "nothing(1)", 'date("x", "yyyy")', "{a: 1} < 2 * []"):
        with pytest.raises(EvaluationError):
            Evaluator().evaluate(parse_expression(text), {})


def test_parsing():
    assert parse_expression("left-over + \U0001F680") == A.Bin("+", A.Var("left-over"), A.Var("\U0001F680"))
    assert parse_expression("a and b or c") == A.Bin("|", A.Bin("&", A.Var("a"), A.Var("b")), A.Var("c"))
    assert parse_query("@a or @b and @c") == A.Or((A.ByType("a"), A.And((A.ByType("b"), A.ByType("c")))))
    assert parse_query("#a/b and linkedto([[X]])") == A.And((A.ByTag("#a/b"), A.Linked(A.ByLink(Link("X")), "incoming")))
    assert parse_expression("trueish") == A.Var("trueish")
    assert A.free_variables(parse_expression("map(x, (y) => y + z) + y")) == {"x", "y", "z"}
    assert parse_link("[[a#H x|b]]") == Link("a", "header", "H x", "b")
    assert [value_of(t) for t in ("", "3", "[[a]], [[b]]", "x, y", "1, 2", "4 hours")] == [None, 3.0, [Link("a"), Link("b")], "x, y", [1.0, 2.0], Duration(hours=4)]


def test_simplify():
    t, x = A.ByType("t"), A.ByType("x")
    assert A.simplify(A.And((t, A.And((x, A.ALL))))) == A.And((t, x))
    assert A.simplify(A.Or((t, A.ALL))) == A.ALL
    assert A.simplify(A.NotQ(A.NotQ(t))) == t
    assert A.simplify(A.Tree(A.NONE, True)) == A.NONE and A.simplify(A.Tree(A.ALL, True, True)) == A.ALL
    assert A.simplify(A.Linked(A.ALL, "both")) == A.NONE and A.simplify(A.Linked(t, "both", -1)) == A.NONE


def test_order_is_total_and_json_round_trips():
    values = [None, 1.0, -2.5, "a", "B", True, False, D(2020, 1, 1), Duration(hours=1), Duration(minutes=60), Link("a"), Link("a", "header", "h"), [1.0], [1.0, 2.0], {"a": 1.0}, {"b": None}]
    for a in values:
        for b in values:
            assert compare(a, b) == -compare(b, a)
            for c in values:
                assert not (compare(a, b) <= 0 and compare(b, c) <= 0) or compare(a, c) <= 0
        assert compare(loads(dumps(a)), a) == 0
    assert to_text([1.0, [2.0], {"k": None}]) == "1, [2], { k: - }"
