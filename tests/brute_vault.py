"""Plain Python versions of the vault queries, row by row, to hold the operators against."""

import datetime as dt
import json
import re
from urllib.parse import unquote
from zoneinfo import ZoneInfo

UTC = dt.timezone.utc
MON = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def instant(raw, zone):
    """Epoch milliseconds that ``raw`` names, or None."""
    if raw is None:
        return None
    t = raw.strip().strip("\"'").strip()
    if re.fullmatch(r"\d+", t):
        n = int(t)
        lo, hi = 978307200, 4133980800
        return n * 1000 if lo <= n < hi else n if lo * 1000 <= n < hi * 1000 else None
    clock = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:\.(?P<f>\d+))?)?(?: (?P<ap>[AP]M))?"
    tz = r"\s?(?P<z>Z|UTC|[+-]\d\d:?\d\d|\[[\w/]+\]|[A-Z]\w+/\w+)?"
    for date in (r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})", r"(?P<y>\d{4})-(?P<m>\d\d)", r"(?P<y>\d{4})/(?P<m>\d\d)/(?P<d>\d\d)", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})",
                 r"(?:\w{3}, )?(?P<d>\d{1,2}) (?P<n>[A-Za-z]{3})[a-z]* (?P<y>\d{4})", r"(?P<n>[A-Za-z]{3})[a-z]* (?P<d>\d{1,2}), (?P<y>\d{4})"):
        if m := re.fullmatch(f"{date}(?:[T ]{clock}{tz})?", t):
            break
    else:
        m = re.fullmatch(r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?P<z>Z)?", t)
        if not m:
            return None
    g = m.groupdict()
    month = MON.index(g["n"].lower()) + 1 if g.get("n") else int(g["m"])
    hour = int(g.get("h") or 0)
    if g.get("ap"):
        hour = hour % 12 + 12 * (g["ap"] == "PM")
    try:
        x = dt.datetime(int(g["y"]), month, int(g.get("d") or 1), hour, int(g.get("mi") or 0), int(g.get("s") or 0), int((g.get("f") or "0")[:3].ljust(3, "0")) * 1000)
    except ValueError:
        return None
    z = g.get("z")
    if z and z[0] in "+-":
        digits = z[1:].replace(":", "")
        x = x.replace(tzinfo=dt.timezone((1 if z[0] == "+" else -1) * dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))))
    elif z in ("Z", "UTC"):
        x = x.replace(tzinfo=UTC)
    else:
        name = z.strip("[]") if z else zone
        if name is None:
            return None
        x = x.replace(tzinfo=ZoneInfo(name))  # fold=0: the first of two, the offset before a gap
    return (x.astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(milliseconds=1)


def fits(kind, value, zone):
    """None for an empty cell, else whether the JSON literal is of the type."""
    if value is None:
        return None
    try:
        v = json.loads(value)
    except ValueError:
        v = value
    if v is None or isinstance(v, str) and not v.strip():
        return None
    if kind in ("text", "list"):
        return True
    if isinstance(v, list):
        return False
    if isinstance(v, dict):
        return v.get("$_type") == kind and kind in ("date", "duration", "link")
    s = v.strip() if isinstance(v, str) else value.strip()
    if kind == "number":
        return not isinstance(v, bool) and bool(re.fullmatch(r"[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d*)?([eE][+-]?\d+)?|[+-]?\.\d+", s))
    if kind == "boolean":
        return s.lower() in {"true", "false", "yes", "no", "on", "off", "1", "0"}
    if kind == "date":
        return not isinstance(v, bool) and instant(s, zone) is not None
    if not isinstance(v, str):
        return False
    if kind == "link":
        return bool(re.fullmatch(r"\[\[[^\[\]]+\]\]", s))
    iso = re.fullmatch(r"P(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+S)?)?", s)
    return bool(iso or re.fullmatch(r"(\d+ ?(weeks?|days?|hours?|minutes?|min|[wdhm])(, | |$))+", s))


def misfits(fields, types, zones):
    """(page_path, field_key) of the cells with a value of another type. ``fields``: dicts of page_fields."""
    best = {}
    for r in fields:
        k = (r["entry_key"] or "").strip().lower()
        if k in types and r["page_path"] is not None:
            o = (-r["revision"], r["origin"] != "frontmatter", r["line_no"] if r["line_no"] is not None else 1 << 40, r["field_id"])
            c = (r["page_path"], k)
            if c not in best or o < best[c][0]:
                best[c] = (o, r)
    return {c for c, (_, r) in best.items() if fits(types[c[1]], r["entry_value"], zones.get(r["vault"])) is False}


def path(p):
    if p is None:
        return None
    p = unquote(p.strip()).strip()
    while p.startswith(("/", "./")):
        p = p[1:] if p[0] == "/" else p[2:]
    p = p.lower()
    return None if not p else p if re.search(r"\.[^./\s]+$", p) else p + ".md"


def elements(v):
    """The elements of a JSON list, in whatever form it was stored."""
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return []
    if isinstance(v, dict):
        v = list(v.values()) if all(k.isdigit() for k in v) else [v]
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def newest(rows, key):
    """By key the row of the highest revision, among them the last loaded."""
    out = {}
    for r in rows:
        if r[key] is not None and (r[key] not in out or (r["revision"], r["loaded_at"]) > (out[r[key]]["revision"], out[r[key]]["loaded_at"])):
            out[r[key]] = r
    return out


def orphans(links, canvases, files):
    lives = {}
    for f in files:
        k = (path(f["file_path"]), f["ctime"])
        if k not in lives or f["loaded_at"] > lives[k][0]:
            lives[k] = (f["loaded_at"], f["deleted_at"])
    by = {}
    for (p, c), (_, d) in lives.items():
        by.setdefault(p, []).append((c, d))
    refs = {("page_links", r["page_path"], str(r["link_id"]), path(r["link_path"]), r["seen_at"]) for r in links}
    for c in newest(canvases, "canvas_path").values():
        for x in elements(c["cards"]):
            refs.add(("canvases", c["canvas_path"], x.get("$id"), path(x.get("$linkedFile")), c["mtime"]))
    out = set()
    for t, f, k, p, at in refs:
        if p is None or any(c <= at and (d is None or d > at) for c, d in by.get(p, [])):
            continue
        out.add((t, f, k, "missing" if p not in by else "late" if min(c for c, _ in by[p]) > at else "deleted"))
    return out


def line(o):
    p = o.get("$position")
    return int(p["start"]) if isinstance(p, dict) and "start" in p else None


def nodes(pages, canvases):
    """p4_found by recursion."""
    out = []

    def items(f, card, v, kind, at):
        for x in elements(v):
            out.append((f, card, "item", line(x), kind, at))
            items(f, card, x.get("$elements"), "item", line(x))

    def sections(f, card, v, kind):
        for s in elements(v):
            out.append((f, card, "section", line(s), kind, -1))
            for b in elements(s.get("$blocks")):
                out.append((f, card, "block", line(b), "section", line(s)))
                items(f, card, b.get("$elements"), "block", line(b))

    for p in newest(pages, "page_path").values():
        sections(p["page_path"], "", p["sections"], "page")
    for c in newest(canvases, "canvas_path").values():
        for x in elements(c["cards"]):
            out.append((c["canvas_path"], x.get("$id"), "card", -1, "canvas", -1))
            sections(c["canvas_path"], x.get("$id"), x.get("$sections"), "card")
    return out
