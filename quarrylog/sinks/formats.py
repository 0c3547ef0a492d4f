"""JSON lines, CSV, SARIF and Markdown.

JSON and CSV can be written by the executors (``write_json``, ``write_csv``) or,
like the report formats, by the driver one row at a time: results are read
through an iterator, never collected as a whole.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import time
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame, Row

FILE_COLUMNS = ("file", "path", "filepath", "uri")
LINE_COLUMNS = ("line", "startLine", "start_line")
COLUMN_COLUMNS = ("col", "column", "startCol", "start_col")
TOOL = "quarrylog"


def rows(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator()


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def json_lines(df: DataFrame, out: TextIO) -> int:
    """One object a row; returns the number of rows."""
    n = 0
    for r in rows(df):
        out.write(json.dumps(r.asDict(), ensure_ascii=False, default=str) + "\n")
        n += 1
    return n


def csv_text(df: DataFrame, out: TextIO) -> int:
    """A header and the rows, quoted where RFC 4180 asks for it."""
    writer, n = csv.writer(out, lineterminator="\n"), 0
    writer.writerow(df.columns)
    for r in rows(df):
        writer.writerow(["" if v is None else v for v in r])
        n += 1
    return n


def query_metadata(text: str) -> dict[str, str]:
    """name, description and id from the leading ``/** ... */`` of a query."""
    m = re.match(r"\s*/\*\*(.*?)\*/", text, re.DOTALL)
    out: dict[str, str] = {}
    if m:
        key = None
        for line in m[1].splitlines():
            line = re.sub(r"^\s*\*? ?", "", line).rstrip()
            if tag := re.match(r"@(\w+)\s*(.*)", line):
                key = tag[1]
                out[key] = tag[2]
            elif key and line:
                out[key] = f"{out[key]} {line.strip()}".strip()
            elif not line:
                key = None
    return {k: v for k, v in out.items() if k in ("name", "description", "id")}


def _pick(columns: list[str], names: Iterable[str]) -> str | None:
    return next((c for n in names for c in columns if c == n), None)


def _location(r: Row, columns: list[str]) -> tuple[str | None, int | None, int | None]:
    file, line, col = (_pick(columns, n) for n in (FILE_COLUMNS, LINE_COLUMNS, COLUMN_COLUMNS))
    number = lambda v: int(v) if v is not None and str(v).lstrip("-").isdigit() else None
    return (str(r[file]) if file else None), (number(r[line]) if line else None), (number(r[col]) if col else None)


def sarif(df: DataFrame, out: TextIO, rule: str = "query", version: str = "0.1.0") -> int:
    """A SARIF 2.1.0 log; columns are counted from 0 in relations and from 1 here."""
    found = []
    for r in rows(df):
        file, line, col = _location(r, df.columns)
        result = {"ruleId": rule, "level": "warning", "message": {"text": str(r[0]) if len(r) else "result"}}
        if file:
            region = {k: v for k, v in (("startLine", line), ("startColumn", col + 1 if col is not None else None)) if v}
            physical = {"artifactLocation": {"uri": file}} | ({"region": region} if region else {})
            result["locations"] = [{"physicalLocation": physical}]
        found.append(result)
    run = {"tool": {"driver": {"name": TOOL, "version": version}}, "results": found}
    json.dump({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, out, indent=2, ensure_ascii=False)
    out.write("\n")
    return len(found)


def snippet(root: str, file: str, line: int, around: int = 5) -> str | None:
    """Numbered lines around a place; None if the file lies outside the root or cannot be read."""
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, file))
    if os.path.commonpath([base, path]) != base:
        return None
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            lines = f.read().splitlines()
    except OSError:
        return None
    first, last = max(1, line - around), min(len(lines), line + around)
    width = len(str(last))
    return "\n".join(f"{'>' if i == line else ' '} {i:>{width}} | {lines[i - 1]}" for i in range(first, last + 1))


def markdown(df: DataFrame, out: TextIO, text: str = "", source_root: str | None = None, started: float | None = None) -> int:
    """A report with a heading for each row that has a place, and the source around it."""
    about = query_metadata(text)
    out.write(f"# {about.get('name', 'Query results')}\n\n")
    if "description" in about:
        out.write(f"> {about['description']}\n\n")
    if "id" in about:
        out.write(f"`{about['id']}`\n\n")
    n = 0
    for r in rows(df):
        n += 1
        file, line, _ = _location(r, df.columns)
        said = ", ".join(f"{c}: {v}" for c, v in zip(df.columns, r, strict=True))
        if not file or not line:
            out.write(f"- {said}\n")
            continue
        out.write(f"## {file}:{line}\n\n{said}\n\n")
        if source_root:
            code = snippet(source_root, file, line)
            if code is None:
                out.write("_source not available_\n\n")
            else:
                fence = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", code)), default=0))
                out.write(f"{fence}{os.path.splitext(file)[1].lstrip('.')}\n{code}\n{fence}\n\n")
    took = f" in {time.time() - started:.1f} s" if started else ""
    out.write(f"\n---\n_{n} result(s){took}_\n")
    return n


def to_text(df: DataFrame, form: str, **options) -> str:
    """The result in a format: json, csv, sarif or markdown."""
    out = io.StringIO()
    {"json": json_lines, "csv": csv_text, "sarif": sarif, "markdown": markdown}[form](df, out, **options)
    return out.getvalue()
