"""Writing reports: JSON documents from rows, JSON and Markdown reports, never over what is scanned."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from lumenscan.functions.signing import replace_whole


def refuse(path: Path, inputs: list[Path]) -> None:
    """An output may not be an input, nor lie inside a scanned folder."""
    to = Path(path).resolve()
    for i in map(lambda p: Path(p).resolve(), inputs):
        if to == i or (i.is_dir() and i in to.parents):
            raise ValueError(f"{path} would overwrite or add to what is read")


def write_document(rows: DataFrame, column: str, order: list, frame: tuple[str, str], path: Path, inputs: list[Path] = ()) -> int:
    """Writes frame around the JSON values of column, in order, as one file; rows come to the writer one partition at a time. Returns their number."""
    refuse(path, list(inputs))
    beside = Path(f"{path}.part")
    n = 0
    with open(beside, "w", encoding="utf-8", newline="\n") as f:
        f.write(frame[0])
        for r in rows.orderBy(*order).select(column).toLocalIterator(prefetchPartitions=False):
            f.write(("," if n else "") + "\n" + r[0])
            n += 1
        f.write(frame[1] + "\n")
    beside.replace(path)
    return n


def write_report(report: dict, path: Path, inputs: list[Path] = ()) -> None:
    """A report as JSON (indented by two, LF), and beside it as Markdown."""
    refuse(path, list(inputs))
    replace_whole(Path(path).resolve(), (json.dumps(report, indent=2, ensure_ascii=False) + "\n").encode())
    replace_whole(Path(path).with_suffix(".md").resolve(), markdown(report).encode())


def _cell(x: object) -> str:
    return str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ").replace("<", "&lt;")


def markdown(report: dict) -> str:
    """Fields as a list, lists of rows as tables."""
    out = [f"# {_cell(report.get('tool', 'Report'))}", ""]
    for k, v in report.items():
        if isinstance(v, list) and v and all(isinstance(r, dict) for r in v):
            columns = list(dict.fromkeys(c for r in v for c in r))
            out += ["", f"## {_cell(k)}", "", "| " + " | ".join(map(_cell, columns)) + " |", "|" + " --- |" * len(columns)]
            out += ["| " + " | ".join(_cell(r.get(c, "")) for c in columns) + " |" for r in v]
        elif k not in ("signature", "tool"):
            out.append(f"- {_cell(k)}: {_cell(json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v)}")
    return "\n".join(out) + "\n"
