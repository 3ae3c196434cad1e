"""Inline fields in lines of text: ``[key:: value]``, ``(key:: value)``, whole lines ``Key:: value``, task marks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from noteweave.plans.parser import value_of

_CLOSE = {"[": "]", "(": ")"}
#: Longer lines hold no fields.
MAX_LINE = 32_768
# Marks of tasks and the fields they stand for.
TASK_MARKS = {"➕": "created", "\U0001F6EB": "start", "⏳": "scheduled", "⌛": "scheduled", "\U0001F4C5": "due", "\U0001F4C6": "due", "\U0001F5D3": "due", "✅": "completion"}
_TASK = re.compile("([" + "".join(TASK_MARKS) + "])️?[ ]?(\\d{4}-\\d{2}-\\d{2})")
_MARKUP = re.compile(r"^[\s>#*+\-_]*(?:\[.\]\s+)?[*_~=`]*")


@dataclass(frozen=True)
class InlineField:
    """A field and where it stands: [start, end) of the whole, ``value_start`` of its value."""

    key: str
    raw: str
    start: int
    value_start: int
    end: int
    wrapping: str | None = None

    @property
    def value(self):
        return value_of(self.raw)


def _closing(line: str, at: int, opener: str) -> int | None:
    """Index of the bracket that closes the one at ``at``; a backslash takes the meaning from the next sign."""
    depth, i = 0, at
    while i < len(line):
        c = line[i]
        if c == "\\":
            i += 1
        elif c == opener:
            depth += 1
        elif c == _CLOSE[opener]:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return None


def bracketed(line: str) -> list[InlineField]:
    """Bracketed fields from left to right; a field inside another bracket counts, overlaps don't."""
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if c == "\\":
            i += 2
            continue
        if c in _CLOSE and (end := _closing(line, i, c)) is not None:
            inner = line[i + 1 : end]
            mark = inner.find("::")
            key = inner[:mark]
            if mark > 0 and key.strip() and not any(b in key for b in "[]()"):
                value = inner[mark + 2 :]
                lead = len(value) - len(value.lstrip())
                out.append(InlineField(key.strip(), value.strip(), i, i + 1 + mark + 2 + lead, end + 1, c))
                i = end + 1
                continue
        i += 1
    return out


def full_line(line: str) -> InlineField | None:
    """The field that a whole line is, after list marks and emphasis before its key."""
    mark = line.find("::")
    if mark <= 0:
        return None
    start = _MARKUP.match(line[:mark]).end()
    key = line[start:mark].strip().strip("*_~`= ")
    if not key or re.search(r"[\[\](){}<>|`]", key) or not re.search(r"\w", key):
        return None
    value = line[mark + 2 :]
    raw = value.strip()
    raw = raw[2:].strip() if raw.startswith("**") else raw
    return InlineField(key, raw, start, mark + 2 + len(value) - len(value.lstrip()), len(line))


def task_fields(line: str) -> list[InlineField]:
    return [InlineField(TASK_MARKS[m[1]], m[2], m.start(), m.start(2), m.end(), "emoji-shorthand") for m in _TASK.finditer(line)]


def fields_of_line(line: str, task: bool = False) -> list[InlineField]:
    """Bracketed fields, else the field that the line is; and the marks of a task."""
    if len(line) > MAX_LINE:
        return []
    marks = task_fields(line) if task else []
    if "::" not in line:
        return marks
    found = bracketed(line)
    if not found and (whole := full_line(line)):
        found = [whole]
    return found + marks


def set_field(line: str, key: str, value: str | None = None) -> str:
    """``line`` with its bracketed field ``key`` set to ``value``, added at the end if it has none; None takes it out.

    A line that holds the field more than twice is left as it is.
    """
    own = [f for f in bracketed(line) if f.key == key]
    if len(own) > 2:
        return line
    if own:
        f = own[0]
        if value is None:
            return (line[: f.start].rstrip() + line[f.end :]) if line[: f.start].endswith(" ") else line[: f.start] + line[f.end :]
        return f"{line[: f.start]}{f.wrapping}{key}:: {value}{_CLOSE[f.wrapping]}{line[f.end :]}"
    return line if value is None else f"{line.rstrip()} [{key}:: {value}]"


def set_completion(line: str, value: str | None = None) -> str:
    """``line`` with the completion mark of a task set to the day ``value``; None takes it out."""
    bare = re.sub("\\s*✅️?[ ]?\\d{4}-\\d{2}-\\d{2}", "", line).rstrip()
    return bare if value is None else f"{bare} ✅ {value}"


def clean_text(text: str) -> str:
    """A list item's text without fields, tags' marks of tasks and block ids."""
    for f in reversed(bracketed(text)):
        text = text[: f.start] + text[f.end :]
    text = _TASK.sub("", text)
    text = re.sub(r"(?m)\s\^[\w-]+\s*$", "", text)
    return re.sub(r"[ \t]{2,}", " ", text).strip()


def line_span(text: str, start: int, end: int) -> str:
    """Lines ``start`` up to ``end``."""
    return "\n".join(text.split("\n")[start:end])


def replace_lines(text: str, start: int, end: int, new) -> str:
    """``text`` with lines ``start`` up to ``end`` rewritten by ``new``."""
    lines = text.split("\n")
    return "\n".join([*lines[:start], new("\n".join(lines[start:end])), *lines[end:]])


def edit_field(text: str, key: str, value: str | None = None, *, line: int | None = None) -> str:
    """The text of a file with a field set to ``value``, or without it where that is None, at the place it came from: in
    ``line``, or else in the front matter, which is made if there is none."""
    if line is not None:
        return replace_lines(text, line, line + 1, lambda x: _edit_line(x, key, value))
    lines = text.split("\n")
    end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None) if lines[0].strip() == "---" else None
    if end is None:
        return text if value is None else f"---\n{key}: {value}\n---\n{text}"
    kept, found, skip = [], False, False
    for x in lines[1:end]:
        named = re.match(r"^([^\s:#-][^:]*?)\s*:(?:\s|$)", x)
        if named:
            skip = named[1].strip("\"'").lower() == key.lower()
            if skip and not found and value is not None:
                kept.append(f"{named[1]}: {value}")
            found = found or skip
        if not skip:
            kept.append(x)
    if not found and value is not None:
        kept.append(f"{key}: {value}")
    return "\n".join([lines[0], *kept, *lines[end:]])


def _edit_line(line: str, key: str, value: str | None) -> str:
    whole = full_line(line) if not bracketed(line) else None
    if whole and whole.key.lower() == key.lower():
        return "" if value is None else line[: whole.value_start].rstrip() + f" {value}"
    own = next((f.key for f in bracketed(line) if f.key.lower() == key.lower()), key)
    return set_field(line, own, value)
