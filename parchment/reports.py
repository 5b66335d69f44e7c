"""Result tables as payloads and Markdown. Every figure shown comes from a payload."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: Rows of a table that a report may hold; reports are of aggregates, so more is a mistake.
MOST = 2_000


def payload(tables: dict[str, DataFrame], most: int = MOST) -> dict[str, list[dict]]:
    """The rows of small result tables by name, in order of their columns' values."""
    out = {}
    for name, t in tables.items():
        rows = t.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} rows; a report shows aggregates")
        out[name] = sorted((r.asDict(recursive=True) for r in rows), key=lambda r: json.dumps(r, default=str))
    return out


def shown(v) -> str:
    if v is None:
        return "-"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, float):
        return f"{v:,.4f}"
    if isinstance(v, int):
        return f"{v:,}"
    if isinstance(v, list):
        return ", ".join(map(shown, v))
    return str(v).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, data: dict[str, list[dict]], notes: dict[str, str] | None = None) -> str:
    """A heading, and for each table its note and its rows; a table without rows says so."""
    out = [f"# {title}", ""]
    for name, rows in data.items():
        out += [f"## {name}", ""]
        if note := (notes or {}).get(name):
            out += [note, ""]
        if not rows:
            out += ["No rows.", ""]
            continue
        names = list(rows[0])
        out += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
        out += ["| " + " | ".join(shown(r[c]) for c in names) + " |" for r in rows] + [""]
    return "\n".join(out)


def as_json(data: dict[str, list[dict]]) -> str:
    """Keys in order, so that equal payloads are equal files."""
    return json.dumps(data, indent=2, sort_keys=True, default=str, ensure_ascii=False) + "\n"
