"""Values of the expression language in Python: their types, total order, truth and text.

A value is None, bool, float, str, datetime, Duration, Link, list, dict or a callable. Equality and order
are one total order over all of them: null first, then by the name of the type, then by value.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import math
import re
import unicodedata
import zoneinfo
from dataclasses import dataclass, replace
from typing import Any

NULL_TEXT = "-"
UNITS = ["years", "months", "weeks", "days", "hours", "minutes", "seconds", "milliseconds"]
#: Milliseconds of each unit, with years of 365 and months of 30 days.
UNIT_MS = dict(zip(UNITS, [365 * 86_400_000, 30 * 86_400_000, 7 * 86_400_000, 86_400_000, 3_600_000, 60_000, 1_000, 1]))


@dataclass(frozen=True)
class Duration:
    """An amount of each calendar unit."""

    years: float = 0
    months: float = 0
    weeks: float = 0
    days: float = 0
    hours: float = 0
    minutes: float = 0
    seconds: float = 0
    milliseconds: float = 0

    @property
    def ms(self) -> float:
        return sum(getattr(self, u) * UNIT_MS[u] for u in UNITS)

    def scaled(self, by: float) -> Duration:
        return Duration(*(getattr(self, u) * by for u in UNITS))

    def plus(self, other: Duration, sign: int = 1) -> Duration:
        return Duration(*(getattr(self, u) + sign * getattr(other, u) for u in UNITS)).normal()

    def normal(self) -> Duration:
        """The same length with every smaller unit below the next larger one; months and years stay apart."""
        sub = sum(getattr(self, u) * UNIT_MS[u] for u in UNITS[2:])
        sign, sub, out = (-1 if sub < 0 else 1), abs(sub), {}
        for u in ["weeks", "days", "hours", "minutes", "seconds", "milliseconds"] if self.weeks else ["days", "hours", "minutes", "seconds", "milliseconds"]:
            whole = sub // UNIT_MS[u] if u != "milliseconds" else sub
            out[u] = sign * whole
            sub -= whole * UNIT_MS[u]
        months = self.years * 12 + self.months
        years = math.trunc(months / 12)
        return Duration(years=years, months=months - 12 * years, **out)


@dataclass(frozen=True)
class Link:
    """A reference to a file, a header in it or a block in it."""

    path: str
    type: str = "file"
    subpath: str | None = None
    display: str | None = None
    embed: bool = False

    @staticmethod
    def parse(inner: str, embed: bool = False) -> Link:
        """The link that stands between double brackets: path#header, path#^block, with an alias after a bar."""
        target, alias = inner, None
        for i, c in enumerate(inner):
            if c == "|" and (i == 0 or inner[i - 1] != "\\"):
                target, alias = inner[:i], inner[i + 1 :].strip()
                break
        target = target.replace("\\|", "|").strip().rstrip("\\")
        path, mark, sub = target.partition("#")
        if not mark:
            return Link(path, display=alias, embed=embed)
        if "^" in sub:
            return Link(path, "block", sub.split("^", 1)[1], alias, embed)
        return Link(path, "header", normal_header(sub), alias, embed)

    def markdown(self) -> str:
        target = self.path + (f"#^{self.subpath}" if self.type == "block" else f"#{self.subpath}" if self.type == "header" else "")
        shown = self.display or self.path.rsplit("/", 1)[-1].removesuffix(".md") + (f" > {self.subpath}" if self.subpath else "")
        return f"{'!' if self.embed else ''}[[{target}|{shown}]]"

    def with_(self, **changes: Any) -> Link:
        return replace(self, **changes)


def normal_header(text: str) -> str:
    """A header as links name it: runs of anything but letters, digits, ``_``, ``-`` and symbols are one space."""
    keep = lambda c: c in "_-" or unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "So"
    return " ".join("".join(c if keep(c) else " " for c in text).split())


def type_of(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    for kind, name in ((str, "string"), (Duration, "duration"), (dt.datetime, "date"), (list, "array"), (Link, "link"), (dict, "object")):
        if isinstance(v, kind):
            return name
    return "function"


def collation(s: str) -> tuple:
    """A sort key near to that of the Unicode collation: letters first, then accents, then case."""
    plain = unicodedata.normalize("NFD", s)
    base = "".join(c for c in plain if not unicodedata.combining(c)).casefold()
    order = tuple((1 if c.isalpha() else 0 if not c.isalnum() else 0.5, c) for c in base)
    return order, plain.casefold(), s.swapcase()


def _cmp(a: Any, b: Any) -> int:
    return (a > b) - (a < b)


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1: the total order over all values."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    kind, other = type_of(a), type_of(b)
    if kind != other:
        return _cmp(kind, other)
    if kind == "string":
        return 0 if a == b else _cmp(collation(a), collation(b))
    if kind == "link":
        return _cmp((a.path, a.type, a.subpath is not None, a.subpath or ""), (b.path, b.type, b.subpath is not None, b.subpath or ""))
    if kind == "duration":
        return _cmp(a.ms, b.ms)
    if kind == "date":
        return _cmp(instant(a), instant(b))
    if kind == "array":
        return next((c for x, y in zip(a, b) if (c := compare(x, y))), _cmp(len(a), len(b)))
    if kind == "object":
        keys, others = sorted(a), sorted(b)
        return compare(keys, others) or next((c for k in keys if (c := compare(a[k], b[k]))), 0)
    if kind == "function":
        return 0
    return _cmp(a, b)


sort_key = functools.cmp_to_key(compare)


def instant(d: dt.datetime) -> float:
    return (d if d.tzinfo else d.replace(tzinfo=dt.timezone.utc)).timestamp()


def truthy(v: Any) -> bool:
    kind = type_of(v)
    if kind == "null":
        return False
    if kind == "date":
        return instant(v) != 0
    if kind == "duration":
        return v.ms != 0
    if kind == "link":
        return bool(v.path)
    if kind == "function":
        return True
    return v != 0 if kind == "number" else bool(v)


def number_text(n: float) -> str:
    """A number as it is usually shown: no ``.0``, plain digits below 1e21."""
    if math.isnan(n):
        return "NaN"
    if math.isinf(n):
        return "Infinity" if n > 0 else "-Infinity"
    if n == int(n) and abs(n) < 1e21:
        return str(int(n))
    return repr(float(n)).replace("e-0", "e-")


def date_text(d: dt.datetime) -> str:
    if d.hour == d.minute == d.second == 0:
        return d.strftime("%B %d, %Y")
    return f"{d.hour % 12 or 12}:{d.strftime('%M %p - %B %d, %Y')}"


def duration_text(v: Duration) -> str:
    parts = [(getattr(v, u), u) for u in UNITS]
    shown = [f"{number_text(n)} {u if n != 1 else u[:-1]}" for n, u in parts if n]
    return ", ".join(shown) or "0 seconds"


def to_text(v: Any, inner: bool = False) -> str:
    """The text of a value as it is joined to other text."""
    kind = type_of(v)
    if kind == "null":
        return NULL_TEXT
    if kind == "boolean":
        return "true" if v else "false"
    if kind == "array":
        text = ", ".join(to_text(x, True) for x in v)
        return f"[{text}]" if inner else text
    if kind == "object":
        return "{ " + ", ".join(f"{k}: {to_text(x, True)}" for k, x in v.items()) + " }"
    return {"number": number_text, "string": str, "date": date_text, "duration": duration_text}.get(kind, lambda x: x.markdown() if kind == "link" else "<function>")(v)


def to_json(v: Any) -> Any:
    """Plain JSON; dates, durations and links become objects with ``$_type``."""
    kind = type_of(v)
    if kind == "date":
        return {"$_type": "date", "value": v.isoformat()}
    if kind == "duration":
        return {"$_type": "duration", "value": {u: getattr(v, u) for u in UNITS if getattr(v, u)}}
    if kind == "link":
        return {"$_type": "link", "value": {k: x for k, x in vars(v).items() if x is not None}}
    if kind == "array":
        return [to_json(x) for x in v]
    if kind == "object":
        return {k: to_json(x) for k, x in v.items()}
    return None if kind == "function" else v


def from_json(v: Any) -> Any:
    if isinstance(v, list):
        return [from_json(x) for x in v]
    if isinstance(v, dict):
        tag, inner = v.get("$_type"), v.get("value")
        if tag == "date":
            return _stored_date(inner)
        if tag == "duration":
            return Duration(**inner) if isinstance(inner, dict) else _stored_duration(inner)
        if tag == "link":
            return Link(**inner)
        return {k: from_json(x) for k, x in v.items()}
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def _stored_date(text: str) -> dt.datetime | None:
    from noteweave.plans.parser import parse_date

    m = re.fullmatch(r"(.*)\[([^\[\]]+)\]", text)
    try:
        if m:  # a region in brackets
            return dt.datetime.fromisoformat(m[1]).replace(tzinfo=zoneinfo.ZoneInfo(m[2]))
        return dt.datetime.fromisoformat(text)
    except (ValueError, zoneinfo.ZoneInfoNotFoundError):
        return parse_date(text)


_ISO_SPAN = re.compile(r"P(?=[\dT])(?:([\d.]+)Y)?(?:([\d.]+)M)?(?:([\d.]+)W)?(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?")


def _stored_duration(text: str) -> Duration | None:
    """A duration stored as text: in ISO 8601, or as amounts with their units."""
    from noteweave.plans.parser import parse_duration

    m = _ISO_SPAN.fullmatch(text)
    return Duration(*(float(x or 0) for x in m.groups())) if m else parse_duration(text)


def dumps(v: Any) -> str:
    return json.dumps(to_json(v), ensure_ascii=False)


def loads(s: str) -> Any:
    return from_json(json.loads(s))
