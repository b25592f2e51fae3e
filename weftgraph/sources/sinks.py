"""Records for people and programs: a bounded number of rows as Markdown, CSV, JSON or text; tables in bulk by df.write."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

FORMATS = ("markdown", "csv", "json", "text")


def format_records(df: DataFrame, form: str = "markdown", most: int = 100) -> str:
    """The first `most` rows of df; the empty string if there are none."""
    if form not in FORMATS:
        raise ValueError(f"form is one of {', '.join(FORMATS)}")
    rows = [r.asDict(recursive=True) for r in df.limit(most).collect()]
    if not rows:
        return ""
    names = list(rows[0])
    if form == "json":
        return json.dumps(rows, default=str, indent=2)
    if form == "text":
        return "\n".join(", ".join(f"{k}: {r[k]}" for k in names) for r in rows)
    cells = [["" if r[k] is None else str(r[k]) for k in names] for r in rows]
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue()
    widths = [max(len(row[i]) for row in [names, *cells]) for i in range(len(names))]
    line = lambda row: "| " + " | ".join(x.ljust(w) for x, w in zip(row, widths)) + " |"
    return "\n".join([line(names), line(["-" * w for w in widths]), *map(line, cells)])


def write_nodes(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] = ()) -> None:
    """A node or edge table as files that any reader can load again."""
    df.write.format(form).mode("errorifexists").partitionBy(*partition_by).save(path)
