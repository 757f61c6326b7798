"""Writers: JSON, CSV, Parquet and text tables, keyed replacement, and small rendered reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: list[str]) -> None:
    """One CSV file with the given columns in order; null cells are blank. For report tables, not for large data."""
    df.select(*header).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Embeddings as an array column of Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, path: str, line: str, *order: str) -> None:
    """One text line per row, in order over all files: their numbers grow with the order, and so do lines in each."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def replace_keyed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new: delete, then append. A null key replaces nothing."""
    return old.join(new.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(old.columns).unionByName(new, allowMissingColumns=True)


def overwrite_partitions(df: DataFrame, path: str, key: str) -> None:
    """The same for a table partitioned by the key: only the partitions that df has are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def replace_batches(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what a batch says of a key takes the place of all that is there of it. A batch that is run again
    writes the same rows in the same place, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        overwrite_partitions(batch, path, key)

    return write


def pretty_json(df: DataFrame) -> str:
    """A small table as one JSON document, a list of indented records in which characters stay as they are. The rows go
    through the driver one partition at a time."""
    rows = ",\n".join("\n".join("  " + line for line in json.dumps(json.loads(r[0]), indent=2, ensure_ascii=False).split("\n")) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator())
    return f"[\n{rows}\n]" if rows else "[]"


def preview(items: Column, most: int = 8) -> Column:
    """The first of an array's items, and how many more there are."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    more = F.size(items) - most
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def html_table(df: DataFrame, best: str | None = None, whole_row: bool = False, most: int = 100_000) -> str:
    """A report's table as HTML, all its rows. In the column ``best`` the cells with the greatest number are highlighted,
    or with whole_row the first row that has it; cells that are no numbers are passed over. For reports: a table of more
    than ``most`` rows is refused, as the page is made on the driver."""
    if (n := df.limit(most + 1).count()) > most:
        raise ValueError(f"a report shows up to {most} rows")
    if not n:
        return "<p><em>No data</em></p>"
    rows = list(df.toLocalIterator())
    values = [_number(r[best]) if best else None for r in rows]
    top = max((v for v in values if v is not None), default=None)
    first = next((i for i, v in enumerate(values) if v == top and v is not None), -1)
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = []
    for i, (r, v) in enumerate(zip(rows, values)):
        hit = v is not None and abs(v - top) < 1e-12
        cells = "".join(f"<td{' class="best"' if hit and c == best and not whole_row else ''}>{'' if x is None else escape(str(x))}</td>" for c, x in zip(df.columns, r))
        body.append(f"<tr{' class="best"' if whole_row and i == first else ''}>{cells}</tr>")
    return f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table>"


def _number(cell) -> float | None:
    try:
        v = float(cell)
    except (TypeError, ValueError):
        return None
    return v if v == v else None


def html_report(title: str, tables: dict[str, tuple[DataFrame, str | None]]) -> str:
    """A page with a section per table (rows, column whose greatest value is highlighted)."""
    parts = "".join(f"<h2>{escape(name)}</h2>{html_table(df, best)}" for name, (df, best) in tables.items())
    style = "body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:3px 8px}.best{background:#dfd}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{parts}</body></html>'


def markdown_review(df: DataFrame, title: str, snippet: str = "snippet", longest: int = 12_000) -> str:
    """A review sheet: a section per row with its fields and its snippet, cut at ``longest`` characters."""
    out = [f"# {title}", ""]
    for row in df.toLocalIterator():
        x = row.asDict()
        out += [f"## {x.get('rank', '')}. {x.get('pred_time_hms', '')}".rstrip(), ""]
        out += [f"- **{k}**: {v}" for k, v in x.items() if k != snippet] + ["", "> " + str(x.get(snippet) or "")[:longest], ""]
    return "\n".join(out)
