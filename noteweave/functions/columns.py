"""The function library compiled to Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.common import let
from noteweave.functions.interpreter import VECTOR
from noteweave.functions.literals import UNITS
from noteweave.plans import expressions as X
from noteweave.plans.parser import UNITS as UNIT_NAMES
from noteweave.plans.expressions import BOOLEAN, DATE, DURATION, LINK, NULL, NUMBER, STRING, Fn, Kind, NotStatic, Val, array_of, boolean, null, number, string

COLUMNS: dict[str, Callable[..., Val]] = {}
#: Functions whose result is null when the given argument is null, by position; so a literal null folds.
_NULL_IN = {"lower": 0, "upper": 0, "round": 0, "trunc": 0, "floor": 0, "ceil": 0, "number": 0, "date": 0, "dur": 0, "dateformat": 0, "striptime": 0, "localtime": 0, "link": 0, "meta": 0, "startswith": 0, "endswith": 0, "replace": 0, "regexreplace": 0, "split": 0, "substring": 0, "truncate": 0, "padleft": 0, "padright": 0, "map": 0, "filter": 0, "flat": 0, "reduce": 0, "minby": 0, "maxby": 0, "sum": 0, "product": 0, "average": 0, "extract": 0, "containsword": 0, "slice": 0}


def column(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names:
            COLUMNS[n] = f
        return f

    return add


def call_column(name: str, args: list[Val | Fn]) -> Val:
    name = name.lower()
    f = COLUMNS.get(name)
    if f is None:
        raise NotStatic(f"no column function {name}")
    at = _NULL_IN.get(name)
    if at is not None and at < len(args) and isinstance(args[at], Val) and args[at].kind == NULL:
        return null()
    places = [i for i in VECTOR.get(name, {}).get(len(args), ()) if i < len(args) and isinstance(args[i], Val) and args[i].name == "array"]
    if places:
        return _vector(name, args, places)
    try:
        return f(*args)
    except (TypeError, KeyError) as e:
        raise TypeError(f"{name}: {e}") from e


def _vector(name: str, args: list, places: list[int]) -> Val:
    """``name`` over arrays: as far as the shortest of them reaches, other arguments repeated."""
    item = lambda i, x: Val(x, args[i].kind.item)
    kind = call_column(name, [item(i, F.lit(None)) if i in places else a for i, a in enumerate(args)]).kind
    if len(places) == 1:
        p = places[0]
        return Val(F.transform(args[p].col, lambda x: call_column(name, [item(i, x) if i == p else a for i, a in enumerate(args)]).col), array_of(kind))
    size = F.least(*(F.size(args[i].col) for i in places))
    each = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return Val(F.transform(each, lambda k: call_column(name, [item(i, F.get(args[i].col, k)) if i in places else a for i, a in enumerate(args)]).col), array_of(kind))


def _wants(v: Val, *names: str) -> None:
    if v.name not in names:
        raise TypeError(f"expected {' or '.join(names)}, not {v.name}")


def _int(v: Val) -> Column:
    _wants(v, "number")
    return v.col.cast("int")


# constructors and conversions


@column("list", "array")
def _list(*a):
    return X.list_of(list(a))


@column("object")
def _object(*a):
    if len(a) % 2 or any(k.const is None or k.name != "string" for k in a[::2]):
        raise NotStatic("object() with computed keys")
    return X.object_of([(k.const, v) for k, v in zip(a[::2], a[1::2])])


def header_name(c: Column) -> Column:
    """A header as links name it, see ``literals.normal_header``."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}\p{So}_-]+", " "))


@column("link")
def _link(target, display=None, embed=None):
    if target.name == "string":
        path, _, sub = target.col, None, F.regexp_extract(target.col, r"#\^?([^|]*)", 1)
        kind = F.when(target.col.contains("#^"), "block").when(target.col.contains("#"), "header").otherwise("file")
        alias = F.nullif(F.trim(F.regexp_extract(path, r"\|(.*)$", 1)), F.lit(""))
        c = F.when(path.isNotNull(), F.struct(F.trim(F.regexp_extract(path, r"^([^#|]*)", 1)).alias("path"), kind.alias("type"), F.when(kind == "block", sub).when(kind == "header", header_name(sub)).alias("subpath"), alias.alias("display"), F.lit(False).alias("embed")))
    else:
        _wants(target, "link")
        c = target.col
    if display is not None and display.kind != NULL:
        _wants(display, "string")
        c = c.withField("display", F.coalesce(display.col, c["display"]))
    return Val(c.withField("embed", X.truth(embed)) if embed is not None else c, LINK)


@column("embed")
def _embed(link, on=None):
    _wants(link, "link")
    return Val(link.col.withField("embed", X.truth(on) if on is not None else F.lit(True)), LINK)


@column("meta")
def _meta(link):
    _wants(link, "link")
    names = {"display": STRING, "embed": BOOLEAN, "path": STRING, "subpath": STRING, "type": STRING}
    return Val(F.when(link.col.isNotNull(), F.struct(*(link.col[n].alias(n) for n in names))), Kind("object", None, tuple(names.items())))


# Tokens of date formats and the Java pattern letters for them.
_JAVA_TOKENS = {"cccc": "EEEE", "ccc": "EEE", "o": "D", "ooo": "DDD", "EEEE": "EEEE", "EEE": "EEE"}


def java_format(fmt: str) -> str:
    return re.sub(r"'[^']*'|cccc|ccc|ooo|o", lambda m: _JAVA_TOKENS.get(m[0], m[0]), fmt)


_ISO = r"^(\d{4})-(\d{2})(?:-(\d{2}))?(?:T(\d{2})(?::(\d{2}))?(?::(\d{2}(?:\.\d{1,3})?))?)?(Z|[+-]\d{2}:?\d{2})?$"


@column("date")
def _date(v, fmt=None):
    if v.name == "date":
        return v
    if v.name == "link":
        day = lambda c: F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
        return Val(F.to_timestamp(F.coalesce(day(v.col["display"]), day(F.substring_index(v.col["path"], "/", -1)))), DATE)
    if fmt is not None:
        _wants(fmt, "string")
        if fmt.const in ("x", "X"):
            n = (v.col if v.name == "number" else v.col.try_cast("double")) * (1 if fmt.const == "x" else 1000)
            return Val(F.timestamp_millis(n.cast("long")), DATE)
        if fmt.const is None:
            raise NotStatic("a computed date format")
        return Val(F.try_to_timestamp(v.col, F.lit(java_format(fmt.const))), DATE)
    _wants(v, "string")
    trimmed = F.trim(v.col)
    full = F.regexp_replace(trimmed, _ISO, "$1-$2-$3T$4:$5:$6$7")
    for gap, by in (("-T", "-01T"), ("T:", "T00:"), ("::", ":00:"), (r":(?=$|Z|[+-]\d{2}:?\d{2}$)(?<!\d\d:\d\d:\d\d)", ":00")):
        full = F.regexp_replace(full, gap, by)
    return Val(F.when(trimmed.rlike(_ISO), full.try_cast("timestamp")), DATE)


_DUR_UNITS = {u: "|".join(sorted(names, key=len, reverse=True)) for u, names in UNIT_NAMES.items()}


@column("dur")
def _dur(v):
    if v.name == "duration":
        return v
    _wants(v, "string")
    one = rf"-?\d+(?:\.\d+)?\s*(?:{'|'.join(_DUR_UNITS.values())})(?![\w])"
    valid = F.trim(v.col).rlike(rf"^{one}(?:\s*,?\s*{one})*$")
    amount = lambda names: F.aggregate(F.regexp_extract_all(v.col, F.lit(rf"(-?\d+(?:\.\d+)?)\s*(?:{names})(?![\w])"), F.lit(1)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return Val(F.when(valid, F.struct(*((amount(_DUR_UNITS[u]) if u in _DUR_UNITS else F.lit(0.0)).alias(u) for u in UNITS))), DURATION)


@column("dateformat")
def _dateformat(d, fmt):
    _wants(d, "date")
    if fmt.const is None:
        raise NotStatic("a computed date format")
    if fmt.const in ("x", "X"):
        return string((F.unix_millis(d.col) if fmt.const == "x" else F.unix_seconds(d.col)).cast("string"))
    return string(F.date_format(d.col, java_format(fmt.const)))


@column("localtime")
def _localtime(d):
    _wants(d, "date")
    return d


@column("striptime")
def _striptime(d):
    _wants(d, "date")
    return Val(F.date_trunc("day", d.col), DATE)


@column("number")
def _number(v):
    if v.name == "number":
        return v
    _wants(v, "string")
    return number(F.nullif(F.regexp_extract(v.col, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"))


@column("string")
def _string(v):
    return string(X.text(v))


@column("typeof")
def _typeof(v):
    return string(F.when(v.col.isNull(), "null").otherwise(v.name))


@column("round")
def _round(n, digits=None):
    _wants(n, "number")
    if digits is None or digits.const is not None and digits.const <= 0:
        return number(F.floor(n.col + 0.5))
    if digits.const is None:
        raise NotStatic("a computed number of digits")
    d = int(digits.const)
    # format_number decides by the binary value, but takes the even neighbour of an exact tie; ties are dyadic
    size = F.abs(n.col) * float(10**d)
    tie = (size - F.floor(size) == 0.5) & (F.pmod(n.col * float(2 ** (d + 1)), F.lit(1.0)) == 0)
    away = F.signum(n.col) * F.floor(size + 0.5) / float(10**d)
    return number(F.when(tie, away).when(F.abs(n.col) < 1e15, F.replace(F.format_number(n.col, d), F.lit(","), F.lit("")).try_cast("double")).otherwise(n.col))


@column("trunc")
def _trunc(n):
    _wants(n, "number")
    return number(F.when(n.col < 0, F.ceil(n.col)).otherwise(F.floor(n.col)))


@column("floor")
def _floor(n):
    _wants(n, "number")
    return number(F.floor(n.col))


@column("ceil")
def _ceil(n):
    _wants(n, "number")
    return number(F.ceil(n.col))


# aggregation over arrays


def _spread(args: tuple[Val, ...]) -> Val:
    return args[0] if len(args) == 1 and args[0].name == "array" else X.list_of(list(args))


def _ranked(v: Val, f: Callable[[Column], Val], last: bool) -> Val:
    """The element whose key is greatest (``last``) or least; null keys are passed over, unless all are."""
    keyed = F.transform(v.col, lambda x, i: F.struct(X.sortable(f(x)).alias("k"), i.alias("i"), x.alias("v")))
    known = F.filter(keyed, lambda e: e["k"].isNotNull())
    best = (F.array_max if last else F.array_min)(F.transform(known, lambda e: F.struct(e["k"].alias("k"), e["i"].alias("i"))))
    return Val(F.coalesce(F.get(v.col, best["i"]), F.get(v.col, F.lit(0))), v.kind.item)


@column("min")
def _min(*a):
    if not a:
        return null()
    v = _spread(a)
    return Val(F.array_min(v.col), v.kind.item) if v.kind.item.name in ("number", "boolean", "date") else _ranked(v, lambda x: Val(x, v.kind.item), False)


@column("max")
def _max(*a):
    if not a:
        return null()
    v = _spread(a)
    return Val(F.array_max(v.col), v.kind.item) if v.kind.item.name in ("number", "boolean", "date") else _ranked(v, lambda x: Val(x, v.kind.item), True)


@column("minby")
def _minby(v, f):
    return _ranked(v, lambda x: f(Val(x, v.kind.item)), False)


@column("maxby")
def _maxby(v, f):
    return _ranked(v, lambda x: f(Val(x, v.kind.item)), True)


def _fold(v: Val, step: Callable[[Val, Val], Val]) -> Val:
    item = v.kind.item
    kind = step(Val(F.lit(None), item), Val(F.lit(None), item)).kind
    if kind != item:
        raise NotStatic("a reduction that changes the kind")
    rest = F.slice(v.col, 2, F.greatest(F.size(v.col) - 1, F.lit(0)))
    return Val(F.when(F.size(v.col) > 0, F.aggregate(rest, F.get(v.col, F.lit(0)), lambda s, x: step(Val(s, item), Val(x, item)).col)), item)


@column("reduce")
def _reduce(v, by):
    if isinstance(by, Fn):
        return _fold(v, lambda s, x: Val(F.when(x.col.isNull(), s.col).otherwise(by(s, x).col), s.kind))
    if by.const not in ("+", "-", "*", "/", "&", "|"):
        raise NotStatic("a computed operator")
    return _fold(v, lambda s, x: X.binary(by.const, s, x))


@column("sum")
def _sum(v):
    return _fold(v, lambda s, x: X.binary("+", s, x)) if v.name == "array" else v


@column("product")
def _product(v):
    return _fold(v, lambda s, x: X.binary("*", s, x)) if v.name == "array" else v


@column("average")
def _average(v):
    if v.name != "array":
        return v
    return X.binary("/", _sum(v), number(F.nullif(F.size(v.col), F.lit(0))))


@column("join")
def _join(v, sep=None):
    by = sep.col if sep is not None else F.lit(", ")
    if v.name != "array":
        return string(X.text(v))
    return string(F.array_join(F.transform(v.col, lambda x: X.text(Val(x, v.kind.item))), sep.const if sep is not None and sep.const is not None else ", ") if sep is None or sep.const is not None else F.concat_ws("", F.transform(v.col, lambda x, i: F.concat(F.when(i > 0, by).otherwise(""), X.text(Val(x, v.kind.item))))))


def _tests(args: tuple) -> tuple[Val | list[Column], Callable | None]:
    if len(args) == 2 and isinstance(args[1], Fn):
        return args[0], lambda x: X.truth(args[1](Val(x, args[0].kind.item)))
    if len(args) == 1 and args[0].name == "array":
        return args[0], lambda x: X.truth(Val(x, args[0].kind.item))
    return [X.truth(a) for a in args], None


@column("any")
def _any(*a):
    v, test = _tests(a)
    if test:
        return boolean(F.coalesce(F.exists(v.col, test), F.lit(False)))
    return boolean(F.coalesce(F.greatest(F.lit(False), F.lit(False), *v), F.lit(False)))


@column("all")
def _all(*a):
    v, test = _tests(a)
    if test:
        return boolean(F.coalesce(F.forall(v.col, test), F.lit(True)))
    return boolean(F.least(F.lit(True), F.lit(True), *v))


@column("none")
def _none(*a):
    return boolean(~_any(*a).col)


@column("filter")
def _filter(v, f):
    return Val(F.filter(v.col, lambda x: X.truth(f(Val(x, v.kind.item)))), v.kind)


@column("map")
def _map(v, f):
    kind = f(Val(F.lit(None), v.kind.item)).kind
    return Val(F.transform(v.col, lambda x: f(Val(x, v.kind.item)).col), array_of(kind))


@column("nonnull")
def _nonnull(*a):
    v = _spread(a)
    return Val(F.array_compact(v.col), v.kind)


@column("sort")
def _sort(v, f=None):
    if v.name != "array":
        return v
    item = v.kind.item
    key = (lambda x: f(Val(x, item))) if f else (lambda x: Val(x, item))
    # nulls first, equal keys in their old order
    keyed = F.transform(v.col, lambda x, i: let(X._ordered(key(x)), lambda k: F.struct(k.isNotNull().alias("n"), k.alias("k"), i.alias("i"))))
    return Val(F.transform(F.array_sort(keyed), lambda e: F.get(v.col, e["i"])), v.kind)


@column("reverse")
def _reverse(v):
    return Val(F.reverse(v.col), v.kind) if v.name in ("array", "string") else v


@column("flat")
def _flat(v, depth=None):
    times = 1 if depth is None else int(depth.const if depth.const is not None else 1)
    for _ in range(times):
        if v.kind.item.name != "array":
            break
        v = Val(F.flatten(v.col), v.kind.item)
    return v


@column("slice")
def _slice(v, start=None, end=None):
    size = F.size(v.col)
    at = lambda x, other: other if x is None else F.when(x.col < 0, F.greatest(size + x.col.cast("int"), F.lit(0))).otherwise(F.least(x.col.cast("int"), size))
    lo, hi = at(start, F.lit(0)), at(end, size)
    return Val(F.slice(v.col, lo + 1, F.greatest(hi - lo, F.lit(0))), v.kind)


@column("length")
def _length(v):
    if v.name == "string":
        n = F.octet_length(F.encode(v.col, "UTF-16BE")) / 2
    elif v.name == "object" and v.kind.fields:
        n = F.lit(len(v.kind.fields))
    elif v.kind == NULL:
        return number(F.lit(0))
    else:
        _wants(v, "array", "object")
        n = F.size(v.col)
    return number(F.when(v.col.isNull(), 0).otherwise(n))


def _contains(v: Val, x: Val, fold: Callable[[Column], Column]) -> Column:
    if v.name == "array":
        return F.exists(v.col, lambda e: F.coalesce(_contains(Val(e, v.kind.item), x, fold), F.lit(False)))
    if v.name == x.name == "string":
        return fold(v.col).contains(fold(x.col))
    if v.name == "object":
        if v.kind.fields:
            return x.col.isin([k for k, _ in v.kind.fields])
        return F.map_contains_key(v.col, x.col)
    return F.coalesce(X.compared("=", v, x), F.lit(True))


@column("contains")
def _contains_fn(v, x):
    return boolean(_contains(v, x, lambda c: c))


@column("icontains")
def _icontains(v, x):
    return boolean(_contains(v, x, F.lower))


@column("econtains")
def _econtains(v, x):
    if v.name == "array":
        return boolean(F.exists(v.col, lambda e: F.coalesce(X.compared("=", Val(e, v.kind.item), x), F.lit(True))))
    return boolean(_contains(v, x, lambda c: c))


@column("containsword")
def _containsword(v, x):
    _wants(v, "string")
    escaped = F.regexp_replace(x.col, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return boolean(F.rlike(v.col, F.concat(F.lit(r"(?i)\b"), escaped, F.lit(r"\b"))))


@column("extract")
def _extract(v, *keys):
    if v.name == "array":
        kind = _extract(Val(F.lit(None), v.kind.item), *keys).kind
        return Val(F.transform(v.col, lambda x: _extract(Val(x, v.kind.item), *keys).col), array_of(kind))
    return X.object_of([(k.const, X.Compiler(lambda _: None).index(v, k)) for k in keys])


@column("default", "ldefault")
def _default(v, other):
    if v.kind == NULL or other.kind == NULL:
        return other if v.kind == NULL else v
    if v.kind != other.kind:
        raise NotStatic("a default of another kind")
    return Val(F.coalesce(v.col, other.col), v.kind)


@column("choice")
def _choice(c, a, b):
    if a.kind != b.kind and NULL not in (a.kind, b.kind):
        raise NotStatic("a choice of several kinds")
    return Val(F.when(X.truth(c), a.col).otherwise(b.col), a.kind if a.kind != NULL else b.kind)


# text


@column("regexreplace")
def _regexreplace(s, pattern, by):
    _wants(s, "string")
    swapped = F.replace(by.col, F.lit("$&"), F.lit("$0"))
    return string(F.regexp_replace(s.col, pattern.col, swapped))


@column("regextest")
def _regextest(pattern, s):
    return boolean(F.coalesce(F.rlike(s.col.cast("string"), pattern.col.cast("string")), F.lit(False)))


@column("regexmatch")
def _regexmatch(pattern, s):
    p = pattern.col.cast("string")
    whole = F.when(p.startswith("^") | p.endswith("$"), p).otherwise(F.concat(F.lit("^"), p, F.lit("$")))
    if pattern.const is not None:
        whole = F.lit(pattern.const if pattern.const.startswith("^") or pattern.const.endswith("$") else f"^{pattern.const}$")
    return boolean(F.coalesce(F.rlike(s.col.cast("string"), whole), F.lit(False)))


@column("replace")
def _replace(s, what, by):
    _wants(s, "string")
    if what.const is not None and what.const != "":
        return string(F.replace(s.col, what.col, by.col))
    return string(F.when(what.col != "", F.replace(s.col, what.col, by.col)).when(what.col == "", F.concat_ws("", F.transform(F.split(s.col, ""), lambda x, i: F.when(i > 0, F.concat(by.col, x)).otherwise(x)))))


@column("lower")
def _lower(s):
    _wants(s, "string")
    return string(F.lower(s.col))


@column("upper")
def _upper(s):
    _wants(s, "string")
    return string(F.upper(s.col))


@column("split")
def _split(s, pattern, limit=None):
    _wants(s, "string")
    if pattern.const is None or re.compile(pattern.const).groups:
        raise NotStatic("a split whose pattern has groups")
    parts = F.split(s.col, pattern.const, -1)
    return Val(parts if limit is None else F.slice(parts, F.lit(1), _int(limit)), array_of(STRING))


@column("startswith")
def _startswith(s, x):
    return boolean(F.startswith(s.col, x.col))


@column("endswith")
def _endswith(s, x):
    return boolean(F.endswith(s.col, x.col))


def _padded(s: Val, n: Val, fill: Val | None, pad: Callable) -> Val:
    _wants(s, "string")
    size = _int(n)
    return string(F.when(F.length(s.col) >= size, s.col).otherwise(pad(s.col, size, fill.col if fill is not None else F.lit(" "))))


@column("padleft")
def _padleft(s, n, fill=None):
    return _padded(s, n, fill, F.lpad)


@column("padright")
def _padright(s, n, fill=None):
    return _padded(s, n, fill, F.rpad)


@column("substring")
def _substring(s, start, end=None):
    _wants(s, "string")
    size = F.length(s.col)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), size)
    a, b = clamp(_int(start)), clamp(_int(end)) if end is not None else size
    return string(F.substring(s.col, F.least(a, b) + 1, F.abs(b - a)))


@column("truncate")
def _truncate(s, n, suffix=None):
    _wants(s, "string")
    tail = suffix.col if suffix is not None else F.lit("...")
    room = _int(n) - F.length(tail)
    return string(F.when(F.length(s.col) > room, F.concat(F.substring(s.col, F.lit(1), F.greatest(room, F.lit(0))), tail)).otherwise(s.col))


@column("hash")
def _hash(*a):
    """A hash of the texts, modulo 2**32."""
    codes = F.transform(F.split(F.concat_ws("\0", *(X.text(v) for v in a)), ""), lambda c: F.ascii(c).cast("long"))
    return number(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32))))
