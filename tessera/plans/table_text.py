"""Rows as text: simple, grid, pipe, markdown, github, csv and json."""

from __future__ import annotations

import csv
import io
import json

FORMATS = ("simple", "grid", "pipe", "markdown", "github", "csv", "json")


def check_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}: use one of {', '.join(FORMATS)}")
    return name


def _cell(value, width: int | None) -> str:
    text = "" if value is None else json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list)) else str(value)
    text = text.replace("\r", " ").replace("\n", " ")
    return text if width is None or len(text) <= width else text[: max(0, width - 1)] + "…"


def table_text(columns: list[str], rows: list[tuple], format: str = "grid", max_colwidth: int | None = 50) -> str:
    """All rows; the width holds for display formats, never for csv and json."""
    check_format(format)
    if format == "json":
        return json.dumps([dict(zip(columns, r, strict=True)) for r in rows], ensure_ascii=False, indent=2, default=str)
    if format == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(columns)
        writer.writerows([["" if v is None else json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else v for v in r] for r in rows])
        return out.getvalue().rstrip("\n")
    cells = [[_cell(v, max_colwidth) for v in r] for r in rows]
    if format in ("pipe", "markdown", "github"):
        cells = [[c.replace("|", "\\|") for c in r] for r in cells]
    heads = [_cell(c, max_colwidth) for c in columns]
    wide = [max([len(h), 3, *(len(r[i]) for r in cells)]) for i, h in enumerate(heads)]
    right = [bool(rows) and all(isinstance(r[i], (int, float)) and not isinstance(r[i], bool) or r[i] is None for r in rows) for i in range(len(heads))]
    line = lambda r: [c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, wide, right, strict=True)]
    if format == "simple":
        return "\n".join(["  ".join(line(heads)).rstrip(), "  ".join("-" * w for w in wide), *("  ".join(line(r)).rstrip() for r in cells)])
    if format == "grid":
        rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
        row = lambda r: "| " + " | ".join(line(r)) + " |"
        body = [x for r in cells for x in (row(r), rule)]
        return "\n".join([rule, row(heads), rule.replace("-", "="), *body])
    row = lambda r: "| " + " | ".join(line(r)) + " |"
    return "\n".join([row(heads), "|" + "|".join("-" * (w + 1) + (":" if n else "-") for w, n in zip(wide, right, strict=True)) + "|", *map(row, cells)])
