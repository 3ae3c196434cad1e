"""Markdown, canvas and other files as objects: pages, sections, blocks, list items, cards and files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import file_system
from noteweave.functions.literals import Link, dumps, normal_header
from noteweave.plans.parser import parse_date, parse_duration
from noteweave.plans.store import Field, ObjectStore
from noteweave.sources.inline_fields import clean_text, fields_of_line

try:
    import yaml
except ImportError:  # then front matter is read line by line
    yaml = None

_LINK_TYPE = "struct<path:string,type:string,subpath:string,display:string,embed:boolean>"
_SPAN = "struct<start:int,end:int>"
OBJECTS = (
    "id string, typename string, types array<string>, file string, folder string, parent_id string, ancestors array<string>, depth int, ordinal int, revision bigint, "
    f"path string, ctime timestamp, mtime timestamp, size bigint, extension string, name string, position {_SPAN}, line_count int, title string, level int, block_type string, block_id string, "
    f"languages array<string>, content_position {_SPAN}, style string, symbol string, text string, cleantext string, parent_line int, status string, completed boolean, url string, linked_file string, "
    f"tags array<string>, link {_LINK_TYPE}, link_key string, links array<{_LINK_TYPE}>, fields map<string,string>, raw map<string,string>"
)
# Intrinsic fields with the name in queries, their column, and the types that have them; the types of
# each kind of object.
_EVERY = frozenset(["Page", "Section", "Block", "List Block", "Codeblock", "Datablock", "List Item", "Task", "File", "Canvas", "Text Card", "File Card", "Web Card"])
_FILES = frozenset(["Page", "File", "Canvas"])
_LINES = frozenset(["Page", "Section", "Block", "List Block", "Codeblock", "Datablock", "List Item", "Task"])
_ITEMS = frozenset(["List Item", "Task"])
INTRINSIC = {
    "$id": Field("id", _EVERY), "$typename": Field("typename", _EVERY), "$types": Field("types", _EVERY), "$file": Field("file", _EVERY), "$revision": Field("revision", _EVERY), "$tags": Field("tags", _EVERY),
    "$link": Field("link", _EVERY), "$path": Field("path", _FILES), "$ctime": Field("ctime", _FILES), "$mtime": Field("mtime", _FILES), "$size": Field("size", _FILES), "$extension": Field("extension", _FILES),
    "$name": Field("name", _FILES | {"Section"}), "$position": Field("position", _LINES), "$lineCount": Field("line_count", _LINES), "$title": Field("title", frozenset(["Section"])), "$level": Field("level", frozenset(["Section"])),
    "$ordinal": Field("ordinal", _LINES - {"Page"}), "$type": Field("block_type", _LINES - {"Page", "Section"}), "$blockId": Field("block_id", _LINES - {"Page", "Section"}), "$languages": Field("languages", frozenset(["Codeblock"])),
    "$style": Field("style", frozenset(["Codeblock"])), "$symbol": Field("symbol", _ITEMS), "$text": Field("text", _ITEMS), "$cleantext": Field("cleantext", _ITEMS), "$parentLine": Field("parent_line", _ITEMS),
    "$status": Field("status", frozenset(["Task"])), "$completed": Field("completed", frozenset(["Task"])), "$url": Field("url", frozenset(["Web Card"])), "$linkedFile": Field("linked_file", frozenset(["File Card"])),
}
_TYPES = {
    "Page": ["file", "markdown", "page", "taggable", "linkable", "links", "fields"], "Section": ["markdown", "section", "taggable", "linkable", "links", "fields"],
    "Block": ["markdown", "block", "links", "taggable", "fields"], "List Block": ["markdown", "block", "block-list", "links", "taggable", "fields"],
    "Codeblock": ["markdown", "block", "codeblock", "links", "taggable", "fields"], "Datablock": ["markdown", "block", "datablock", "links", "taggable", "fields"],
    "List Item": ["markdown", "list-item", "links", "taggable", "fields"], "Task": ["markdown", "list-item", "task", "links", "taggable", "fields"],
    "File": ["file", "fields", "linkable"], "Canvas": ["file", "canvas", "taggable", "linkable", "links", "fields"],
    "Text Card": ["canvas-card", "markdown", "canvas-text-card", "taggable", "linkable", "links", "fields"], "File Card": ["canvas-card", "canvas-file-card", "linkable", "fields"], "Web Card": ["canvas-card", "canvas-web-card", "linkable", "fields"],
}
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*(.*?)\s*$")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])(?:\s+(?:\[(.)\]\s+)?(.*))?$")
_TAG = re.compile(r"(?<![\w/&#])#([^\s#,;.:!@$%^&*()+=\[\]{}<>?'\"`~|\\]*[^\W\d_][^\s#,;.:!@$%^&*()+=\[\]{}<>?'\"`~|\\]*)")
_WIKI = re.compile(r"(!?)\[\[([^\[\]]+?)\]\]")
_CODE_SPAN = re.compile(r"`[^`]*`")
_MARKDOWN_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(\s*(?:<([^<>]*)>|([^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)\s*$")
_NOT_PARAGRAPH = re.compile(r"^(?: {4}|\t|\s*(?:>|\||#{1,6}\s|(?:[-*+]|\d+[.)])(?:\s|$)|`{3,}|~{3,}))")
_BLOCK_ID = re.compile(r"\s\^([\w-]+)\s*$")


def plain_yaml(text: str) -> dict[str, Any]:
    """Front matter as a mapping; what isn't one is empty."""
    if yaml is not None:
        try:
            loaded = yaml.safe_load(text)
            return loaded if isinstance(loaded, dict) else {}
        except (yaml.YAMLError, ValueError):
            return {}
    out: dict[str, Any] = {}
    key = None
    for line in text.split("\n"):
        if (m := re.match(r"^\s+-\s+(.*)$", line)) and key is not None:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), m[1].strip().strip("\"'")]
        elif m := re.match(r"^([^\s:#][^:]*):\s*(.*)$", line):
            key, raw = m[1].strip(), m[2].strip()
            out[key] = json.loads(raw) if re.fullmatch(r"-?\d+(\.\d+)?|true|false|null", raw) else raw.strip("\"'") or None
    return out


def yaml_value(v: Any) -> Any:
    """A YAML value as one of the language: dates, durations and links are found in texts."""
    import datetime as dt

    if isinstance(v, dict):
        return {str(k): yaml_value(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [yaml_value(x) for x in v]
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    if isinstance(v, str):
        if (d := parse_date(v)) is not None:
            return d
        if (d := parse_duration(v)) is not None:
            return d
        return Link.parse(m[2], bool(m[1])) if (m := _WIKI.fullmatch(v.strip())) else v
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def front_tags(v: Any) -> list[str]:
    """Tags of front matter: lists of any depth, texts cut at commas and blanks; all with ``#``."""
    if isinstance(v, list):
        return [t for x in v for t in front_tags(x)]
    return [t if t.startswith("#") else f"#{t}" for t in re.split(r"[,\s]+", str(v)) if t] if v is not None else []


def links_of_line(line: str) -> list[Link]:
    """The links of a line in both notations, ``[[path]]`` and ``[text](path)``; addresses with a scheme are no links, nor is
    what stands in code."""
    line = _CODE_SPAN.sub(lambda m: " " * len(m[0]), line)
    found = [(m.start(), Link.parse(m[2], bool(m[1]))) for m in _WIKI.finditer(line)]
    for m in _MARKDOWN_LINK.finditer(line):
        target = unquote(m[3] if m[3] is not None else m[4])
        if target and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", target):
            link = Link.parse(target.replace("|", "\\|"), bool(m[1]))
            found.append((m.start(), link.with_(display=m[2] or None)))
    return [x for _, x in sorted(found, key=lambda p: p[0])]


def _merge(row: dict, key: str, value: Any, raw: str | None = None) -> None:
    """A field of a row; the first of a key counts."""
    if key.lower() not in row["fields"]:
        row["fields"][key.lower()] = dumps(value)
        row["raw"][key.lower()] = raw


class _Page:
    """One pass over a markdown text; collects the rows of its objects."""

    def __init__(self, file: str, text: str, top: dict[str, Any], prefix: str | None = None):
        self.file, self.top, self.prefix = file, top, prefix or file
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.rows: list[dict] = [top]
        self.code = [False] * len(self.lines)
        self.front: dict[str, Any] = {}

    def row(self, typename: str, id_: str, parent: dict, start: int, end: int, **more: Any) -> dict:
        link = {"path": self.file, "type": "block", "subpath": more["block_id"], "display": None, "embed": False} if more.get("block_id") else None
        r = {
            "id": id_, "typename": typename, "types": _TYPES[typename], "file": self.file, "folder": self.top["folder"], "parent_id": parent["id"], "ancestors": [parent["id"], *parent["ancestors"]], "depth": parent["depth"] + 1,
            "position": {"start": start, "end": end}, "line_count": end - start, "tags": [], "links": [], "fields": {}, "raw": {}, "link": link, **more,
        }
        self.rows.append(r)
        return r

    def run(self) -> list[dict]:
        start = self.front_matter()
        self.mark_code(start)
        heads = self.headings(start)
        cuts = [(*h, k + 1) for k, h in enumerate(heads)]
        first = heads[0][0] if heads else len(self.lines)
        if any(x.strip() for x in self.lines[start:first]):
            cuts.insert(0, (start, start, 1, self.top["name"] or "", 0))
        self.block_count = 0
        for k, (at, body, level, title, ordinal) in enumerate(cuts):
            end = cuts[k + 1][0] if k + 1 < len(cuts) else len(self.lines)
            tail = re.sub(r"[^A-Za-z0-9\-_]+", "-", title[:8])
            section = self.row("Section", f"{self.prefix}/section{ordinal}/{tail}", self.top, at, end, title=title, level=level, ordinal=ordinal, name=title)
            section["link"] = {"path": self.file, "type": "header", "subpath": normal_header(title), "display": None, "embed": False}
            self.blocks(section, body, end)
        self.attribute(start)
        return self.rows

    def headings(self, start: int) -> list[tuple[int, int, int, str]]:
        """(first line, first line after it, level, title) of each heading: marked by ``#``, or a paragraph underlined by
        ``=`` or ``-``."""
        out, paragraph = [], None
        for i in range(start, len(self.lines)):
            line = self.lines[i]
            if self.code[i] or not line.strip():
                paragraph = None
            elif m := _HEADING.match(line):
                out.append((i, i + 1, len(m[1]), m[2]))
                paragraph = None
            elif paragraph is not None and paragraph >= 0 and (m := _UNDERLINE.match(line)):
                out.append((paragraph, i + 1, 1 if m[1][0] == "=" else 2, " ".join(x.strip() for x in self.lines[paragraph:i])))
                paragraph = None
            elif paragraph is None:  # lines that go on a list or a quote are no paragraph of their own
                paragraph = -1 if _NOT_PARAGRAPH.match(line) or _UNDERLINE.match(line) else i
            elif paragraph >= 0 and _NOT_PARAGRAPH.match(line) and not re.match(r"^(?: {4}|\t)", line):
                paragraph = -1
        return out

    def front_matter(self) -> int:
        if self.lines and self.lines[0].strip() == "---":
            for i in range(1, len(self.lines)):
                if self.lines[i].strip() == "---":
                    self.front = plain_yaml("\n".join(self.lines[1:i]))
                    for k, v in self.front.items():
                        value = yaml_value(v)
                        _merge(self.top, str(k), value, v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False))
                        if str(k).lower() in ("tag", "tags"):
                            self.top["tags"] += front_tags(v)
                        self.top["links"] += _links_in(value)
                    return i + 1
        return 0

    def mark_code(self, start: int) -> None:
        fence = None
        for i in range(start, len(self.lines)):
            m = _FENCE.match(self.lines[i])
            if fence is None and m:
                fence = m[1]
                self.code[i] = True
            elif fence is not None:
                self.code[i] = True
                if m and m[1].startswith(fence) and not m[2]:
                    fence = None

    def blocks(self, section: dict, start: int, end: int) -> None:
        i = start
        while i < end:
            line = self.lines[i]
            if not line.strip():
                i += 1
                continue
            self.block_count += 1
            stop = i + 1
            if m := _FENCE.match(line):
                while stop < end and not ((c := _FENCE.match(self.lines[stop])) and c[1].startswith(m[1]) and not c[2]):
                    stop += 1
                inner, stop = stop, min(stop + 1, end)
                if m[2] == "yaml:data":
                    data = plain_yaml("\n".join(self.lines[i + 1 : inner]))
                    b = self.row("Datablock", f"{self.prefix}/datablock{i}", section, i, stop, ordinal=self.block_count, block_type="datablock")
                    for k, v in data.items():
                        _merge(b, str(k), yaml_value(v), v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False))
                        if str(k).lower() in ("tag", "tags"):
                            b["tags"] += front_tags(v)
                else:
                    langs = [x.strip() for x in m[2].split(",") if x.strip()]
                    self.row("Codeblock", f"{self.prefix}/codeblock{i}", section, i, stop, ordinal=self.block_count, block_type="codeblock", languages=langs, style="fenced", content_position={"start": i + 1, "end": inner})
            elif _ITEM.match(line):
                while stop < end and (self.lines[stop].strip() and not _HEADING.match(self.lines[stop]) or stop + 1 < end and not self.lines[stop].strip() and re.match(r"^\s+\S", self.lines[stop + 1])):
                    stop += 1
                b = self.row("List Block", f"{self.prefix}/block{self.block_count}", section, i, stop, ordinal=self.block_count, block_type="list")
                self.items(b, i, stop)
            elif re.match(r"^(?: {4}|\t)", line):
                while stop < end and (re.match(r"^(?: {4}|\t)", self.lines[stop]) or not self.lines[stop].strip() and stop + 1 < end and re.match(r"^(?: {4}|\t)", self.lines[stop + 1])):
                    stop += 1
                for k in range(i, stop):
                    self.code[k] = True
                self.row("Codeblock", f"{self.prefix}/codeblock{i}", section, i, stop, ordinal=self.block_count, block_type="codeblock", languages=[], style="indent", content_position={"start": i, "end": stop})
            else:
                kind = "callout" if re.match(r"^\s*>\s*\[!", line) else "blockquote" if line.lstrip().startswith(">") else "table" if line.lstrip().startswith("|") else "paragraph"
                while stop < end and self.lines[stop].strip() and not _FENCE.match(self.lines[stop]) and not _ITEM.match(self.lines[stop]):
                    stop += 1
                own = _BLOCK_ID.search(" " + self.lines[stop - 1])
                self.row("Block", f"{self.prefix}/block{self.block_count}", section, i, stop, ordinal=self.block_count, block_type=kind, block_id=own[1] if own else None)
            i = stop

    def items(self, block: dict, start: int, end: int) -> None:
        open_items: list[tuple[int, dict]] = []
        first = len(self.rows)

        def close(indent: int) -> None:
            while open_items and open_items[-1][0] >= indent:
                _, done = open_items.pop()
                if open_items:  # an item ends with what is in it
                    above = open_items[-1][1]["position"]
                    above["end"] = max(above["end"], done["position"]["end"])

        for i in range(start, end):
            m = _ITEM.match(self.lines[i])
            if not m:
                for _, r in open_items[-1:]:
                    r["text"].append(self.lines[i].strip())
                    r["position"]["end"] = i + 1
                continue
            indent = len(m[1].expandtabs(4))
            close(indent)
            parent = open_items[-1][1] if open_items else block
            own = _BLOCK_ID.search(" " + (m[4] or ""))
            r = self.row(
                "Task" if m[3] is not None else "List Item", f"{self.prefix}/list{i}", parent, i, i + 1, block_type="task" if m[3] is not None else "list", symbol=m[2], text=[m[4] or ""],
                parent_line=parent["position"]["start"] if open_items else -start, status=m[3], completed=m[3] in ("x", "X") if m[3] is not None else None, block_id=own[1] if own else None,
            )
            open_items.append((indent, r))
        close(-1)
        for r in self.rows[first:]:
            r["text"] = "\n".join(r["text"])
            r["line_count"] = r["position"]["end"] - r["position"]["start"]

    def attribute(self, start: int) -> None:
        """Tags, links and inline fields to the page and to the section, block and items that hold their line."""
        spans = sorted((r for r in self.rows[1:]), key=lambda r: (r["position"]["start"], r["depth"]))
        at, open_now = 0, []  # what holds the line: one of each depth at most
        for i in range(start, len(self.lines)):
            open_now = [r for r in open_now if r["position"]["end"] > i]
            while at < len(spans) and spans[at]["position"]["start"] <= i:
                if spans[at]["position"]["end"] > i:
                    open_now.append(spans[at])
                at += 1
            line = self.lines[i]
            if self.code[i] or not line.strip():
                continue
            deepest = max([self.top, *open_now], key=lambda r: r["depth"])
            holders = [self.top, *(r for r in open_now if r["typename"] in ("Section", "Block", "List Block") or r is deepest)]
            tags = ["#" + m[1] for m in _TAG.finditer(re.sub(r"`[^`]*`|\[\[[^\]]*\]\]|\]\([^)]*\)", " ", line))]
            links = [_link_row(x) for x in links_of_line(line)]
            found = fields_of_line(line, task=deepest["typename"] == "Task")
            for r in holders:
                r["tags"] += tags
                r["links"] += links
                for f in found:
                    _merge(r, f.key, f.value, f.raw)


def _link_row(x: Link) -> dict:
    return {"path": x.path, "type": x.type, "subpath": x.subpath, "display": x.display, "embed": x.embed}


def _links_in(v: Any) -> list[dict]:
    if isinstance(v, Link):
        return [_link_row(v)]
    return [x for y in (v if isinstance(v, list) else v.values() if isinstance(v, dict) else []) for x in _links_in(y)]


def _file_row(typename: str, path: str, stats: dict) -> dict:
    base = path.rsplit("/", 1)[-1]
    stem, dot, ext = base.rpartition(".")
    return {
        "id": path, "typename": typename, "types": _TYPES[typename], "file": path, "folder": path.rpartition("/")[0], "parent_id": None, "ancestors": [], "depth": 0, "path": path, "extension": ext if dot else "", "name": stem if dot else base,
        "tags": [], "links": [], "fields": {}, "raw": {}, "link": _link_row(Link(path)), **stats,
    }


def _finish(rows: list[dict]) -> list[dict]:
    """Distinct tags and links per object, and the texts by which links name it."""
    for r in rows:
        r["tags"] = list(dict.fromkeys(r["tags"]))
        r["links"] = list({(x["path"], x["type"], x["subpath"]): x for x in reversed(r["links"])}.values())[::-1]
        link = r.get("link")
        r["link_key"] = link_text(link) if link else None
        r["fields"], r["raw"] = list(r["fields"].items()), list(r["raw"].items())
        if r.get("text") is not None:
            r["cleantext"] = clean_text(r["text"])
    return rows


def link_text(x: dict) -> str:
    """A link's target as one text."""
    return x["path"] + {"file": "", "header": f"#{x['subpath']}", "block": f"#^{x['subpath']}"}[x["type"]]


def markdown_objects(path: str, text: str, stats: dict | None = None) -> list[dict]:
    """All objects of a markdown file, the page first."""
    top = _file_row("Page", path, stats or {})
    page = _Page(path, text, top)
    top["position"] = {"start": 0, "end": len(page.lines)}
    top["line_count"] = len(page.lines)
    return _finish(page.run())


def canvas_objects(path: str, text: str, stats: dict | None = None) -> list[dict]:
    """A canvas, its cards, and the objects in its text cards; ids below a card begin with the card's. Groups are no cards."""
    top = _file_row("Canvas", path, stats or {})
    rows = [top]
    try:
        nodes = json.loads(text).get("nodes", []) if text.strip() else []
    except (ValueError, AttributeError):
        nodes = []
    for n in nodes:
        kind = {"text": "Text Card", "file": "File Card", "link": "Web Card"}.get(n.get("type"))
        if not kind:
            continue
        own = f"{path}/{n.get('id')}"
        card = {
            **_file_row(kind, path, {}), "id": own, "parent_id": path, "ancestors": [path], "depth": 1, "link": _link_row(Link(path, "block", str(n.get("id")))), "block_id": str(n.get("id")), "path": None, "extension": None,
            "url": n.get("url"), "linked_file": n.get("file"),
        }
        if kind == "Text Card":
            below = _Page(path, n.get("text") or "", card, prefix=own).run()
            rows += below
            top["tags"] += card["tags"]
            top["links"] += card["links"]
        else:
            if kind == "File Card" and n.get("file"):
                top["links"].append(_link_row(Link(n["file"])))
            rows.append(card)
    return _finish(rows)


def objects_of(path: str, text: str | None, stats: dict | None = None) -> list[dict]:
    """The objects of any file by its ending; a file without text is one object."""
    ending = path.rpartition(".")[2].lower()
    if ending in ("md", "markdown"):
        return markdown_objects(path, text or "", stats)
    if ending == "canvas":
        return canvas_objects(path, text or "", stats)
    return _finish([_file_row("File", path, stats or {})])


def parse_files(files: DataFrame, revision: int = 0) -> DataFrame:
    """Objects of ``files``: path, content string (may be null), ctime, mtime, size. Rows without a path give none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(OBJECTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for f in batch.slice(at, 64).to_pylist():
                    rows += objects_of(f["path"], f["content"], {"ctime": f["ctime"], "mtime": f["mtime"], "size": f["size"]})
                for r in rows:
                    r["revision"] = revision
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kept = files.where(F.col("path").isNotNull()).select("path", F.col("content").cast("string").alias("content"), F.col("ctime").cast("timestamp").alias("ctime"), F.col("mtime").cast("timestamp").alias("mtime"), F.col("size").cast("bigint").alias("size"))
    return kept.mapInArrow(run, OBJECTS)


def read_vault(spark: SparkSession, folder: str, revision: int = 0) -> DataFrame:
    """The objects of all files below ``folder``. Content is read for markdown and canvas files only.

    Spark's file sources pass over files of no bytes: those are taken from the listing, each asked for its time.
    """
    root = folder.rstrip("/").removeprefix("file:").lstrip("/") + "/"
    raw = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    relative = F.regexp_replace("path", r"^(?:\w+:)?/*\Q" + root + r"\E", "")
    common = [relative.alias("path"), F.col("modificationTime").alias("ctime"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    text = raw().option("pathGlobFilter", "*.{md,markdown,canvas}").load(folder).select(*common, F.decode("content", "UTF-8").alias("content"))
    whole = raw().load(folder)
    other = whole.where(~F.lower("path").rlike(r"\.(md|markdown|canvas)$")).select(*common, F.lit(None).cast("string").alias("content"))
    return parse_files(text.unionByName(other).unionByName(_empty_files(spark, folder, root)), revision)


def _empty_files(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The files of no bytes below a folder: path, ctime, mtime, size, content. The driver walks the listing."""
    import datetime as dt

    fs, at = file_system(spark, folder)
    rows, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            path = re.sub(r"^(?:\w+:)?/*" + re.escape(root), "", f.getPath().toString())
            when = dt.datetime.fromtimestamp(f.getModificationTime() / 1000, dt.timezone.utc)
            rows.append((path, when, when, 0, "" if re.search(r"\.(md|markdown|canvas)$", path.lower()) else None))
    return spark.createDataFrame(rows, "path string, ctime timestamp, mtime timestamp, size bigint, content string")


def resolve_links(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, type, subpath, folder and any others, rows distinct) with dst_id, the object that a link read
    in ``folder`` leads to: by the path from there, by the path, by either and ``.md``, or by a file name that only
    one file has. A leading ``/`` leaves the folder out. Of several headers of one text the first counts. Rows
    that lead nowhere fall away."""
    o = objects
    files = o.where(F.col("id") == F.col("file")).select(F.col("file").alias("dst_file"))
    bare = lambda df, c: df.where(F.col(c).endswith(".md")).withColumn(c, F.regexp_replace(c, r"\.md$", ""))
    paths = files.select("dst_file", F.col("dst_file").alias("key"))
    names = files.withColumn("key", F.substring_index("dst_file", "/", -1))
    only = names.unionByName(bare(names, "key")).groupBy("key").agg(F.count("*").alias("n"), F.min("dst_file").alias("dst_file")).where("n = 1")
    places = paths.withColumn("at", F.lit(0)).unionByName(bare(paths, "key").withColumn("at", F.lit(1))).select("dst_file", "key", "at", F.lit(False).alias("name"))
    places = places.unionByName(only.select("dst_file", "key", F.lit(0).alias("at"), F.lit(True).alias("name")))
    path = F.regexp_replace("path", "^/+", "")
    near = F.when((F.col("folder") != "") & ~F.col("path").startswith("/"), F.struct(F.lit(0).alias("rank"), F.concat("folder", F.lit("/"), path).alias("key"), F.lit(False).alias("name")))
    ways = F.array_compact(F.array(near, *(F.struct(F.lit(i + 1).alias("rank"), path.alias("key"), F.lit(name).alias("name")) for i, name in enumerate((False, True)))))
    tried = wanted.withColumn("_way", F.explode(ways)).select(*wanted.columns, "_way.*")
    best = tried.join(places, ["key", "name"]).groupBy(*wanted.columns).agg(F.min_by("dst_file", F.struct("rank", "at", "dst_file")).alias("dst_file"))
    text = F.when(F.col("type") == "header", F.concat("dst_file", F.lit("#"), "subpath")).when(F.col("type") == "block", F.concat("dst_file", F.lit("#^"), "subpath")).otherwise(F.col("dst_file"))
    keys = o.where("link_key is not null").groupBy("link_key").agg(F.min_by("id", F.struct(F.col("position.start"), F.col("id"))).alias("dst_id"))
    return best.withColumn("link_key", text).join(keys, "link_key").select(*wanted.columns, "dst_id")


def vault_store(objects: DataFrame) -> ObjectStore:
    """Objects of a vault as a store; for links see ``resolve_links``."""
    o = objects
    resolve = lambda wanted: resolve_links(o, wanted if "folder" in wanted.columns else wanted.withColumn("folder", F.lit(None).cast("string")))

    def resolved() -> DataFrame:
        held = o.where(F.array_contains("types", "linkable")).select(F.col("id").alias("src_id"), "folder", F.explode("links").alias("l")).select("src_id", "folder", "l.path", "l.type", "l.subpath")
        target = ["folder", "path", "type", "subpath"]
        led = resolve(held.select(*target).distinct())  # few distinct targets are looked up, many links joined with them
        same = (F.col("h.path") == F.col("t.path")) & (F.col("h.type") == F.col("t.type")) & F.col("h.subpath").eqNullSafe(F.col("t.subpath")) & F.col("h.folder").eqNullSafe(F.col("t.folder"))
        return held.alias("h").join(led.alias("t"), same).select("h.src_id", "t.dst_id")

    back = resolved().join(o.select(F.col("id").alias("dst_id"), F.col("link_key").alias("dst_key")), "dst_id").select("src_id", "dst_key")
    all_links = o.where(F.array_contains("types", "links")).select(F.col("id").alias("src_id"), F.explode("links").alias("l"))
    exact = all_links.select("src_id", F.concat("l.path", F.when(F.col("l.type") == "header", F.concat(F.lit("#"), F.col("l.subpath"))).when(F.col("l.type") == "block", F.concat(F.lit("#^"), F.col("l.subpath"))).otherwise("")).alias("dst_key"))

    def below(source: DataFrame, inclusive: bool) -> DataFrame:
        roots = source.select(F.col("id").alias("_root"))
        path = F.concat(F.array("id"), "ancestors") if inclusive else F.col("ancestors")
        found = o.select("id", F.explode(path).alias("_root")).join(roots, "_root", "left_semi").select("id").distinct()
        return o.join(found, "id", "left_semi")

    def above(source: DataFrame, inclusive: bool) -> DataFrame:
        own = o.join(source.select("id"), "id", "left_semi")
        return o.join(own.select(F.explode(F.concat(F.array("id"), "ancestors") if inclusive else F.col("ancestors")).alias("id")).distinct(), "id", "left_semi")

    return ObjectStore(o, dict(INTRINSIC), links=exact.unionByName(back).distinct(), resolved=resolved, json_fields="fields", resolve=resolve, descendants=below, ancestors=above)
