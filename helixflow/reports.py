"""Reports from small results: candidate pages in Markdown, and one HTML page whose sections depend on what is there."""

from __future__ import annotations

import html
import json
import re
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.qc import lower_bound

LIMIT = 1000


def rows(df: DataFrame, limit: int = LIMIT) -> list[dict]:
    """The rows of a result that is small by construction; more than limit is an error, not a cut."""
    got = df.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    return [r.asDict(recursive=True) for r in got]


def extremes(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """The n highest and n lowest rows by value, ties by key."""
    high = df.orderBy(F.col(value).desc(), key).limit(n).withColumn("side", F.lit("high"))
    return high.union(df.orderBy(value, key).limit(n).withColumn("side", F.lit("low")))


# Bounds and parts of group names that go with less and with more of the archaic share.
FEW_SITES = 300_000
CONTAMINATION = 0.01
LOWER_GROUPS = ("african", "levant")
HIGHER_GROUPS = ("han", "east", "siberia", "steppe")


def technical(n: F.Column, data_type: F.Column, contamination: F.Column) -> F.Column:
    """How the data may have moved an estimate, as an array of phrases; contamination is an interval in text."""
    rules = ((n < FEW_SITES, "few sites"), (data_type == "AG", "pseudo-haploid capture"), (lower_bound(contamination) > CONTAMINATION, "contamination"))
    return F.array_compact(F.array(*(F.when(on, F.lit(phrase)) for on, phrase in rules)))


def biological(z: F.Column, group: F.Column) -> F.Column:
    """How ancestry may explain a residual z, as an array of phrases; one that says so if nothing does."""
    low = F.lower(F.coalesce(group, F.lit("")))
    named = lambda words: reduce(or_, (low.contains(w) for w in words))
    rules = ((low.contains("-o"), "outlier of its group"), ((z < 0) & named(LOWER_GROUPS), "admixture with less of it"), ((z > 0) & named(HIGHER_GROUPS), "ancestry with more of it"))
    found = F.array_compact(F.array(*(F.when(on, F.lit(phrase)) for on, phrase in rules)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("chance, as far as known")))


def _cell(v) -> str:
    return f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v)


def markdown_table(items: list[dict]) -> str:
    if not items:
        return "(no rows)\n"
    heads = list(items[0])
    lines = [" | ".join(heads), " | ".join("---" for _ in heads), *(" | ".join(_cell(r[h]) for h in heads) for r in items)]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def write_candidates(df: DataFrame, key: str, folder: str) -> list[str]:
    """A Markdown page for each row and an index; returns the names of the files."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    names = []
    for r in rows(df):
        name = re.sub(r"[^A-Za-z0-9._-]", "_", str(r[key])) + ".md"
        (out / name).write_text(f"# {r[key]}\n\n" + "\n".join(f"- {k}: {_cell(v)}" for k, v in r.items()) + "\n")
        names.append(name)
    (out / "index.md").write_text("# Candidates\n\n" + "\n".join(f"- [{n[:-3]}]({n})" for n in names) + "\n")
    return [*names, "index.md"]


def write_html(sections: dict[str, DataFrame | None], path: str, heading: str = "Report") -> None:
    """One self-contained page; a section that is None is left out."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(heading)}</title></head><body><h1>{html.escape(heading)}</h1>"]
    for name, df in sections.items():
        if df is None:
            continue
        items = rows(df)
        heads = df.columns
        body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(r[h]))}</td>" for h in heads) + "</tr>" for r in items)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in heads)}</tr>{body}</table>")
    Path(path).write_text("".join([*parts, "</body></html>"]))


def write_json(df: DataFrame, path: str) -> None:
    """The one row of df as nested JSON."""
    (row,) = rows(df, 1)
    Path(path).write_text(json.dumps(row, indent=1, default=str))
