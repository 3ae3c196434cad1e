"""The expression language over Python values: what single values, constant folding and dynamic rows use."""

from __future__ import annotations

import calendar
import datetime as dt
import functools
import math
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from noteweave.functions.literals import UNITS, Duration, Link, compare, sort_key, to_text, truthy, type_of
from noteweave.plans import ast as A


class EvaluationError(ValueError):
    """An expression has no value: wrong types, unknown function, or a bad pattern."""


FUNCTIONS: dict[str, Callable[..., Any]] = {}
#: Per function, the numbers of arguments and the positions whose arrays are mapped over.
VECTOR: dict[str, dict[int, tuple[int, ...]]] = {}
#: Functions of users' own, which plans send to the workers.
OWN: dict[str, tuple[Callable[..., Any], dict[int, tuple[int, ...]] | None]] = {}


def function(*names: str, over: dict[int, tuple[int, ...]] | None = None) -> Callable:
    """Register a function; ``over`` gives, per number of arguments, the positions that map over arrays."""

    def add(f: Callable) -> Callable:
        for n in names:
            FUNCTIONS[n] = f
            if over:
                VECTOR[n] = over
        return f

    return add


def add_own(own: dict[str, tuple[Callable[..., Any], dict[int, tuple[int, ...]] | None]]) -> None:
    for name, (f, over) in own.items():
        OWN[name] = (f, over)
        FUNCTIONS[name] = f
        VECTOR.pop(name, None)
        if over:
            VECTOR[name] = over


def call(name: str, args: list[Any]) -> Any:
    f = FUNCTIONS.get(name.lower())
    if f is None:
        raise EvaluationError(f"there is no function {name}")
    places = [i for i in VECTOR.get(name.lower(), {}).get(len(args), ()) if i < len(args) and isinstance(args[i], list)]
    if places:
        size = min(len(args[i]) for i in places)
        return [call(name, [a[k] if i in places else a for i, a in enumerate(args)]) for k in range(size)]
    try:
        return f(*args)
    except EvaluationError:
        raise
    except (TypeError, AttributeError, ValueError, IndexError, ArithmeticError, re.error) as e:
        raise EvaluationError(f"{name}({', '.join(map(type_of, args))}): {e}") from e


def _want(v: Any, *kinds: str) -> None:
    if type_of(v) not in kinds:
        raise EvaluationError(f"expected {' or '.join(kinds)}, not {type_of(v)}")


def js_regex(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))


# operators


def binary(op: str, a: Any, b: Any) -> Any:
    try:
        return _binary(op, a, b)
    except (ArithmeticError, ValueError, TypeError) as e:
        if isinstance(e, EvaluationError):
            raise
        raise EvaluationError(f"{type_of(a)} {op} {type_of(b)}: {e}") from e


def _binary(op: str, a: Any, b: Any) -> Any:
    if a is None and b is None:
        return None
    if op in ("<", "<=", ">", ">=", "=", "!="):
        c = compare(a, b)
        return {"<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0, "=": c == 0, "!=": c != 0}[op]
    if op == "&":
        return truthy(a) and truthy(b)
    if op == "|":
        return truthy(a) or truthy(b)
    ta, tb = type_of(a), type_of(b)
    if ta == tb == "number":
        return _arith(op, a, b)
    if op == "+":
        if "string" in (ta, tb):
            return to_text(a) + to_text(b)
        if {ta, tb} == {"date", "duration"}:
            return add_duration(a, b) if ta == "date" else add_duration(b, a)
        if ta == tb == "duration":
            return a.plus(b)
        if ta == tb == "array":
            return a + b
        if ta == tb == "object":
            return {**a, **b}
    if op == "-":
        if ta == tb == "date":
            return date_difference(a, b)
        if (ta, tb) == ("date", "duration"):
            return add_duration(a, b, -1)
        if ta == tb == "duration":
            return a.plus(b, -1)
    if op == "*":
        if {ta, tb} == {"string", "number"}:
            s, n = (a, b) if ta == "string" else (b, a)
            return s * max(0, int(n))
        if {ta, tb} == {"duration", "number"}:
            return (a if ta == "duration" else b).scaled(b if ta == "duration" else a)
    if op == "/" and (ta, tb) == ("duration", "number"):
        return a.scaled(1 / b)
    raise EvaluationError(f"no {op} of {ta} and {tb}")


def _arith(op: str, a: float, b: float) -> float:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return a / b if b else math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
    return math.fmod(a, b) if b and not math.isinf(a) else math.nan


def add_duration(d: dt.datetime, by: Duration, sign: int = 1) -> dt.datetime:
    months = d.year * 12 + d.month - 1 + sign * int(by.years * 12 + by.months)
    year, month = divmod(months, 12)
    day = min(d.day, calendar.monthrange(year, month + 1)[1])
    rest = Duration(weeks=by.weeks, days=by.days, hours=by.hours, minutes=by.minutes, seconds=by.seconds, milliseconds=by.milliseconds).ms
    return d.replace(year=year, month=month + 1, day=day) + sign * dt.timedelta(milliseconds=rest)


def date_difference(a: dt.datetime, b: dt.datetime) -> Duration:
    """``a`` - ``b`` in whole years and months, then days and smaller."""
    sign = 1
    if a < b:
        a, b, sign = b, a, -1
    months = (a.year - b.year) * 12 + a.month - b.month
    if add_duration(b, Duration(months=months)) > a:
        months -= 1
    rest = (a - add_duration(b, Duration(months=months))) / dt.timedelta(milliseconds=1)
    return Duration(years=months // 12, months=months % 12, milliseconds=rest).normal().scaled(sign)


def index(value: Any, key: Any, load: Callable[[Link], Any] | None = None) -> Any:
    kind = type_of(value)
    if kind == "null" or key is None:
        return None
    if kind == "array":
        if type_of(key) == "number":
            return value[int(key)] if 0 <= key < len(value) and key == int(key) else None
        return [index(x, key, load) for x in value]
    if kind == "object":
        k = key if isinstance(key, str) else to_text(key)
        return value.get(k, next((v for n, v in value.items() if n.lower() == k.lower()), None))
    if kind == "string" and type_of(key) == "number":
        return value[int(key)] if 0 <= key < len(value) else None
    if kind == "date":
        part = {"week": lambda: value.isocalendar()[1], "millisecond": lambda: value.microsecond // 1000}.get(key, lambda: getattr(value, key, None) if key in ("year", "month", "day", "hour", "minute", "second") else None)()
        return None if part is None else float(part)
    if kind == "duration":
        return float(getattr(value, key)) if key in UNITS and key != "weeks" else None
    if kind == "link":
        target = load(value) if load else None
        return index(target, key, load) if target is not None else None
    raise EvaluationError(f"no index of {kind}")


# constructors and conversions


@function("list", "array")
def _list(*a):
    return list(a)


@function("object")
def _object(*a):
    if len(a) % 2 or any(type_of(k) != "string" for k in a[::2]):
        raise EvaluationError("object() takes pairs of text and value")
    return dict(zip(a[::2], a[1::2]))


@function("link", over={1: (0,), 2: (0, 1)})
def _link(target, display=None, embed=None):
    if target is None:
        return None
    link = target if isinstance(target, Link) else Link.parse(target)
    link = link.with_(display=display) if display is not None else link
    return link.with_(embed=truthy(embed)) if embed is not None else link


@function("embed", over={1: (0,), 2: (0, 1)})
def _embed(link, on=True):
    return None if link is None or on is None else link.with_(embed=truthy(on))


@function("date", over={1: (0,)})
def _date(v, fmt=None):
    from noteweave.plans.parser import parse_date, shorthand

    if v is None or isinstance(v, dt.datetime):
        return v
    if isinstance(v, Link):
        return next((d for t in (v.display, v.path.rsplit("/", 1)[-1].removesuffix(".md")) if t and (m := re.search(r"\d{4}-\d{2}-\d{2}", t)) and (d := parse_date(m[0]))), None)
    if fmt is not None:
        return parse_format(to_text(v), fmt)
    _want(v, "string")
    return shorthand(v.strip(), dt.datetime.now()) or parse_date(v)


# Tokens of date formats and their strftime codes.
TOKENS = {
    "yyyy": "%Y", "yy": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "M": "%-m", "dd": "%d", "d": "%-d", "HH": "%H", "H": "%-H", "hh": "%I", "h": "%-I",
    "mm": "%M", "m": "%-M", "ss": "%S", "s": "%-S", "a": "%p", "cccc": "%A", "ccc": "%a", "EEEE": "%A", "EEE": "%a", "ooo": "%j", "o": "%-j", "WW": "%V", "kkkk": "%G",
}
_TOKEN = re.compile(r"'([^']*)'|" + "|".join(sorted(TOKENS, key=len, reverse=True)) + r"|SSS|x|X|E|c|q|Z{1,3}|[A-Za-z]+|.", re.S)


def parse_format(text: str, fmt: str) -> dt.datetime:
    if fmt in ("x", "X"):
        try:
            return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=float(text) * (1000 if fmt == "X" else 1))
        except ValueError:
            raise EvaluationError(f"{text!r} is no number of {fmt}") from None
    code = "".join(m[1] if m[1] is not None else TOKENS.get(m[0], "%f" if m[0] == "SSS" else m[0]).replace("%-", "%") for m in _TOKEN.finditer(fmt))
    try:
        return dt.datetime.strptime(text, code)
    except ValueError:
        raise EvaluationError(f"{text!r} doesn't follow {fmt!r}") from None


@function("dateformat", over={2: (0,)})
def _dateformat(d, fmt):
    if d is None:
        return None
    _want(d, "date")
    extra = {"SSS": f"{d.microsecond // 1000:03d}", "x": str(int(d.replace(tzinfo=d.tzinfo or dt.timezone.utc).timestamp() * 1000)), "X": str(int(d.replace(tzinfo=d.tzinfo or dt.timezone.utc).timestamp())), "E": str(d.isoweekday()), "c": str(d.isoweekday()), "q": str((d.month + 2) // 3)}
    return "".join(m[1] if m[1] is not None else d.strftime(TOKENS[m[0]]) if m[0] in TOKENS else extra.get(m[0], m[0]) for m in _TOKEN.finditer(fmt))


@function("dur", over={1: (0,)})
def _dur(v):
    from noteweave.plans.parser import parse_duration

    if v is None or isinstance(v, Duration):
        return v
    _want(v, "string")
    return parse_duration(v)


@function("localtime", over={1: (0,)})
def _localtime(d):
    return None if d is None else d.astimezone() if d.tzinfo else d


@function("number", over={1: (0,)})
def _number(v):
    if v is None or type_of(v) == "number":
        return v
    m = re.search(r"-?\d+(\.\d+)?", v) if isinstance(v, str) else None
    return float(m[0]) if m else None


@function("string")
def _string(v):
    return to_text(v)


@function("typeof")
def _typeof(v):
    return type_of(v)


@function("round", over={1: (0,), 2: (0,)})
def _round(n, digits=0):
    if n is None:
        return None
    _want(n, "number")
    if not digits or digits <= 0:
        return float(math.floor(n + 0.5))
    return float(Decimal(n).quantize(Decimal(1).scaleb(-int(digits)), ROUND_HALF_UP))


@function("trunc", over={1: (0,)})
def _trunc(n):
    return None if n is None else float(math.trunc(n))


@function("floor", over={1: (0,)})
def _floor(n):
    return None if n is None else float(math.floor(n))


@function("ceil", over={1: (0,)})
def _ceil(n):
    return None if n is None else float(math.ceil(n))


@function("striptime", over={1: (0,)})
def _striptime(d):
    return None if d is None else d.replace(hour=0, minute=0, second=0, microsecond=0)


@function("meta")
def _meta(link):
    if link is None:
        return None
    _want(link, "link")
    return {"display": link.display, "embed": link.embed, "path": link.path, "subpath": link.subpath, "type": link.type}


# aggregation over arrays


def _spread(args):
    return list(args[0]) if len(args) == 1 and isinstance(args[0], list) else list(args)


@function("min")
def _min(*a):
    return functools.reduce(lambda x, y: x if y is None or x is not None and compare(x, y) <= 0 else y, _spread(a), None)


@function("max")
def _max(*a):
    return functools.reduce(lambda x, y: x if y is None or x is not None and compare(x, y) > 0 else y, _spread(a), None)


def _by(a, f, last):
    if a is None or not a:
        return None
    keyed = [(f(x), x) for x in a]
    known = [p for p in keyed if p[0] is not None]
    if not known:
        return a[0]
    best = known[0]
    for p in known[1:]:
        c = compare(p[0], best[0])
        if (c >= 0 if last else c < 0):
            best = p
    return best[1]


@function("minby")
def _minby(a, f):
    return _by(a, f, False)


@function("maxby")
def _maxby(a, f):
    return _by(a, f, True)


@function("sum")
def _sum(a):
    return _reduce(a, "+") if isinstance(a, list) else a


@function("product")
def _product(a):
    return _reduce(a, "*") if isinstance(a, list) else a


@function("average")
def _average(a):
    if not isinstance(a, list):
        return a
    return binary("/", _reduce(a, "+"), float(len(a))) if a else None


@function("reduce", over={2: (1,)})
def _reduce(a, by):
    if a is None or not a:
        return None
    if isinstance(by, str):
        if by not in ("+", "-", "*", "/", "&", "|"):
            raise EvaluationError(f"no reduction by {by!r}")
        return functools.reduce(lambda x, y: binary(by, x, y), a)
    return functools.reduce(lambda x, y: x if y is None else by(x, y), a[1:], a[0])


@function("join", over={2: (1,)})
def _join(a, sep=", "):
    return sep.join(to_text(x) for x in a) if isinstance(a, list) else to_text(a)


def _test(args):
    if args and isinstance(args[0], list) and len(args) == 2 and callable(args[1]):
        return [truthy(args[1](x)) for x in args[0]]
    return [truthy(x) for x in (args[0] if len(args) == 1 and isinstance(args[0], list) else args)]


@function("any")
def _any(*a):
    return any(_test(a))


@function("all")
def _all(*a):
    return all(_test(a))


@function("none")
def _none(*a):
    return not any(_test(a))


@function("filter")
def _filter(a, f):
    return None if a is None else [x for x in a if truthy(f(x))]


@function("map")
def _map(a, f):
    return None if a is None else [f(x) for x in a]


@function("nonnull")
def _nonnull(*a):
    return [x for x in _spread(a) if x is not None]


@function("sort")
def _sort(a, f=None):
    return a if not isinstance(a, list) else sorted(a, key=lambda x: sort_key(f(x) if f else x))


@function("reverse")
def _reverse(a):
    return a[::-1] if isinstance(a, (list, str)) else a


@function("flat")
def _flat(a, depth=1):
    if a is None:
        return None
    for _ in range(int(depth)):
        a = [y for x in a for y in (x if isinstance(x, list) else [x])]
    return a


@function("slice")
def _slice(a, start=0, end=None):
    return None if a is None else a[int(start) : None if end is None else int(end)]


@function("length")
def _length(a):
    return 0.0 if a is None else float(len(a.encode("utf-16-le")) // 2 if isinstance(a, str) else len(a))


def _contains(a, x, fold=lambda s: s):
    if isinstance(a, list):
        return any(_contains(y, x, fold) for y in a)
    if isinstance(a, str) and isinstance(x, str):
        return fold(x) in fold(a)
    if isinstance(a, dict):
        return x in a
    return compare(a, x) == 0


@function("contains", over={2: (1,)})
def contains(a, x):
    return _contains(a, x)


@function("icontains", over={2: (1,)})
def icontains(a, x):
    return _contains(a, x, str.lower)


@function("econtains", over={2: (1,)})
def econtains(a, x):
    return any(compare(y, x) == 0 for y in a) if isinstance(a, list) else _contains(a, x)


@function("containsword", over={2: (0, 1)})
def containsword(a, x):
    return None if a is None or x is None else bool(re.search(rf"\b{re.escape(x)}\b", a, re.I))


@function("extract")
def extract(a, *keys):
    if a is None or isinstance(a, list):
        return None if a is None else [extract(x, *keys) for x in a]
    return {k: index(a, k) for k in keys}


@function("default", over={2: (0, 1)})
def default(v, other):
    return other if v is None else v


@function("ldefault")
def ldefault(v, other):
    return other if v is None else v


@function("choice", over={3: (0,)})
def choice(c, a, b):
    return a if truthy(c) else b


@function("hash")
def hash_(*a):
    h = 0
    for c in "\0".join(to_text(x) for x in a):
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return float(h)


# text


@function("regexreplace", over={3: (0, 1, 2)})
def regexreplace(s, pattern, by):
    if s is None or pattern is None or by is None:
        return None
    by = re.sub(r"\$(\d+)", r"\\g<\1>", by.replace("\\", "\\\\")).replace("$&", r"\g<0>")
    return js_regex(pattern).sub(by, s)


@function("regextest", over={2: (0, 1)})
def regextest(pattern, s):
    return False if s is None or pattern is None else bool(js_regex(pattern).search(s))


@function("regexmatch", over={2: (0, 1)})
def regexmatch(pattern, s):
    if s is None or pattern is None:
        return False
    if not pattern.startswith("^") and not pattern.endswith("$"):
        pattern = f"^{pattern}$"
    return bool(js_regex(pattern).search(s))


@function("replace", over={3: (0, 1, 2)})
def replace(s, what, by):
    if s is None or what is None or by is None:
        return None
    return by.join(s) if what == "" else s.replace(what, by)


@function("lower", over={1: (0,)})
def lower(s):
    return None if s is None else s.lower()


@function("upper", over={1: (0,)})
def upper(s):
    return None if s is None else s.upper()


@function("split")
def split(s, pattern, limit=None):
    if s is None or pattern is None:
        return None
    parts = ["" if p is None else p for p in js_regex(pattern).split(s)] if pattern else list(s)
    return parts if limit is None else parts[: int(limit)]


@function("startswith", over={2: (0, 1)})
def startswith(s, x):
    return None if s is None or x is None else s.startswith(x)


@function("endswith", over={2: (0, 1)})
def endswith(s, x):
    return None if s is None or x is None else s.endswith(x)


def _pad(s, n, fill, left):
    if s is None or n is None or fill is None:
        return None
    lack = int(n) - len(s)
    more = (fill * (lack // max(1, len(fill)) + 1))[:lack] if lack > 0 and fill else ""
    return more + s if left else s + more


@function("padleft", over={2: (0, 1), 3: (0, 1, 2)})
def padleft(s, n, fill=" "):
    return _pad(s, n, fill, True)


@function("padright", over={2: (0, 1), 3: (0, 1, 2)})
def padright(s, n, fill=" "):
    return _pad(s, n, fill, False)


@function("substring", over={2: (0, 1), 3: (0, 1, 2)})
def substring(s, start, end=None):
    if s is None or start is None:
        return None
    a, b = (min(max(int(x), 0), len(s)) for x in (start, len(s) if end is None else end))
    return s[min(a, b) : max(a, b)]


@function("truncate", over={2: (0, 1), 3: (0, 1, 2)})
def truncate(s, n, suffix="..."):
    if s is None or n is None or suffix is None:
        return None
    room = int(n) - len(suffix)
    return s[: max(0, room)] + suffix if len(s) > room else s


class Evaluator:
    """Evaluates trees; ``load`` gives the object that a link leads to."""

    def __init__(self, load: Callable[[Link], Any] | None = None):
        self.load = load

    def evaluate(self, n: A.Node, env: dict[str, Any]) -> Any:
        if isinstance(n, A.Lit):
            return n.value
        if isinstance(n, A.Var):
            return dict(env) if n.name == "$row" else index(env, n.name)
        if isinstance(n, A.ListOf):
            return [self.evaluate(x, env) for x in n.items]
        if isinstance(n, A.ObjectOf):
            return {k: self.evaluate(v, env) for k, v in n.items}
        if isinstance(n, A.Bin):
            return binary(n.op, self.evaluate(n.left, env), self.evaluate(n.right, env))
        if isinstance(n, A.Not):
            return not truthy(self.evaluate(n.value, env))
        if isinstance(n, A.Index):
            return index(self.evaluate(n.value, env), self.evaluate(n.key, env), self.load)
        if isinstance(n, A.Lambda):
            return lambda *a: self.evaluate(n.body, {**env, **dict(zip(n.params, a))})
        if isinstance(n, A.Method):
            target = self.evaluate(n.target, env)
            own = target.get(n.name) if isinstance(target, dict) else None
            args = [self.evaluate(a, env) for a in n.args]
            return own(*args) if callable(own) else call(n.name, [target, *args])
        args = [self.evaluate(a, env) for a in n.args]
        if isinstance(n.func, A.Var) and n.func.name.lower() in FUNCTIONS:
            return call(n.func.name, args)
        f = self.evaluate(n.func, env)
        if not callable(f):
            raise EvaluationError(f"{A.text_of(n.func)} is no function")
        return f(*args)
