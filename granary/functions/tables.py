"""Tables inside texts: HTML to Markdown, headings of several rows, JSON values as text."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from itertools import accumulate, takewhile
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Two keys of an entry that are written as "first: second".
PAIRS = (("type", "description"), ("offense", "penalty"))


class _Rows(HTMLParser):
    """The rows of the first table: whether each stands in the head, and its cells as [text, rows, columns]."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[bool, list[list[Any]]]] = []
        self.found = self.inside = self.head = self.cell = self.marked = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table" and not self.found:
            self.found = self.inside = True
        if not self.inside:
            return
        self.head |= tag == "thead"
        self.marked |= tag == "thead"
        if tag == "tr":
            self.rows.append((self.head, []))
        elif tag in ("td", "th") and self.rows:
            span = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and (v or "").isdigit()}
            self.rows[-1][1].append(["", span.get("rowspan", 1), span.get("colspan", 1)])
            self.cell = True

    def handle_endtag(self, tag: str) -> None:
        self.inside &= tag != "table"
        self.head &= tag != "thead"
        self.cell &= tag not in ("td", "th")

    def handle_data(self, data: str) -> None:
        if self.inside and self.cell:
            self.rows[-1][1][-1][0] += data.strip()


def _grid(rows: list[list[list[Any]]]) -> list[list[str]]:
    """Every place that a cell covers has its text."""
    width = max((sum(c[2] for c in r) for r in rows), default=0)
    held: dict[tuple[int, int], str] = {}
    for y, cells in enumerate(rows):
        free = iter([x for x in range(width) if (y, x) not in held])
        for text, down, across in cells:
            x = next(free, None)
            if x is None:
                break
            held |= {(y + j, x + i): text for j in range(down) for i in range(across)}
            free = iter([z for z in range(x + across, width) if (y, z) not in held])
    return [[held.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def _heading(column: tuple[str, ...]) -> str:
    names = list(dict.fromkeys(x for x in column if x))
    return f"{names[0]}({', '.join(names[1:])})" if len(names) > 1 else "".join(names)


def _filled(above: list[str], row: list[str]) -> list[str]:
    """``row`` with its leading gaps taken from ``above``; the first value that differs names the one before it, which both rows share."""
    gaps = len(list(takewhile(lambda v: not v, row)))
    row = above[:gaps] + row[gaps:]
    shared = len(list(takewhile(lambda pair: pair[0] == pair[1] != "", zip(above, row, strict=True))))
    if not 0 < shared < len(row):
        return row
    parent, child = row[shared - 1 : shared + 1]
    return row if not child or child == parent else [*row[:shared], f"{parent}({child})", *row[shared + 1 :]]


def table_to_markdown(raw: str) -> str:
    """The first table of ``raw``; a text without a table or without headings comes back as it is."""
    p = _Rows()
    p.feed(raw)
    head = [c for is_head, c in p.rows if is_head] if p.marked else [c for _, c in p.rows[:1]]
    body = [c for is_head, c in p.rows if not is_head] if p.marked else [c for _, c in p.rows[1:]]
    names = [_heading(column) for column in zip(*_grid(head), strict=True)]
    if not names:
        return raw
    rows = [(r + [""] * len(names))[: len(names)] for r in accumulate(_grid(body), _filled)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *rows])


def _cells(line: str) -> list[str] | None:
    line = line.strip()
    return [c.strip() for c in line.split("|")[1:-1]] if line.startswith("|") and line.endswith("|") else None


def one_heading(text: str) -> str:
    """Two heading rows above a separator as one, child in brackets, where the upper row repeats a value and the lower one differs."""
    lines, out, k = text.split("\n"), [], 0
    rule = lambda cells: cells is not None and not "".join(cells).replace("-", "")
    while k < len(lines):
        up, low, sep = (_cells(x) for x in (lines[k : k + 3] + ["", "", ""])[:3])
        fits = up is not None and low is not None and not rule(low) and rule(sep) and len(up) == len(low)
        if fits and len(set(up)) < len(up) and any(a != b and b for a, b in zip(up, low, strict=True)):
            tight = [("".join(a.split()), "".join(b.split())) for a, b in zip(up, low, strict=True)]
            out += ["| " + " | ".join(a if b in ("", a) else f"{a}({b})" for a, b in tight) + " |", lines[k + 2]]
            k += 3
        else:
            out.append(lines[k])
            k += 1
    return "\n".join(out)


def _entry(d: dict[str, Any]) -> str:
    for a, b in PAIRS:
        if a in d and b in d:
            return f"{d[a]}: {d[b]}"
    return ", ".join(f"{k}: {plain(v)}" for k, v in d.items())


def plain(value: Any) -> str:
    """A text as it is, a list in one line, an object or a list of objects in a line each."""
    if isinstance(value, dict):
        return "\n".join(f"{k}: {plain(v)}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(map(_entry, value)) if value and isinstance(value[0], dict) else ", ".join(map(plain, value))
    return value if isinstance(value, str) else str(value)


@F.pandas_udf(T.StringType())
def markdown_table(s: pd.Series) -> pd.Series:
    return s.map(table_to_markdown, na_action="ignore")


@F.pandas_udf(T.StringType())
def single_heading(s: pd.Series) -> pd.Series:
    return s.map(one_heading, na_action="ignore")


@F.pandas_udf(T.StringType())
def json_as_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: plain(json.loads(x)), na_action="ignore")
