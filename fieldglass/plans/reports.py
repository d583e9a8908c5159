"""Reports as Markdown, HTML and JSON over small result tables (a row a column, rule or series)."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row

from fieldglass.operators import bias, privacy, profile


def _cell(value) -> str:
    return "" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value)


#: Rows that a section of a report may have.
MOST_ROWS = 10_000


def read_small(rows: DataFrame) -> list[Row]:
    """All rows of a small table; one of more than ``MOST_ROWS`` is an error, not a shortened report."""
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"a section of more than {MOST_ROWS} rows is no report; write it as a table")
    return found


def table(rows: DataFrame | Sequence[Mapping]) -> tuple[list[str], list[list[str]]]:
    """Header and cells of a small table, whole."""
    if isinstance(rows, DataFrame):
        return rows.columns, [[_cell(v) for v in r] for r in read_small(rows)]
    names = list(rows[0]) if rows else []
    return names, [[_cell(r.get(n)) for n in names] for r in rows]


def markdown(title: str, sections: Mapping[str, DataFrame | Sequence[Mapping] | str]) -> str:
    out = [f"# {title}"]
    for name, body in sections.items():
        out += ["", f"## {name}", ""]
        if isinstance(body, str):
            out.append(body)
            continue
        head, cells = table(body)
        if not cells:
            out.append("none")
            continue
        clean = lambda x: x.replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(clean, c)) + " |" for c in cells)]
    return "\n".join(out) + "\n"


def html_page(title: str, sections: Mapping[str, DataFrame | Sequence[Mapping] | str]) -> str:
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, body in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(body, str):
            parts.append(f"<p>{html.escape(body)}</p>")
            continue
        head, cells = table(body)
        row = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs) + "</tr>"
        parts.append("<table>" + row("th", head) + "".join(row("td", c) for c in cells) + "</table>")
    return "".join(parts) + "</body></html>"


def as_json(sections: Mapping[str, DataFrame | Sequence[Mapping] | str]) -> str:
    return json.dumps({n: [r.asDict(recursive=True) for r in read_small(b)] if isinstance(b, DataFrame) else b for n, b in sections.items()}, default=str, ensure_ascii=False)


def quality_sections(df: DataFrame, attribute: str | None = None, target: str | None = None) -> dict[str, DataFrame | list | str]:
    """The parts of a data-quality report: profile, outliers, strong correlations, types, personal data, bias, recommendations."""
    sections: dict = {"Overview": profile.basic_profile(df), "Completeness": profile.completeness(df), "Uniqueness": profile.uniqueness(df), "Outliers": profile.outlier_counts(df), "Strong correlations": profile.strong_correlation(profile.correlation(df)), "Feature types": profile.feature_types(df), "Privacy": privacy.risk_level(df)}
    gap = None
    if attribute:
        sections["Distribution"] = bias.distribution(df, attribute)
        if target:
            sections["Target by group"] = bias.target_by_group(df, attribute, target)
            gap = bias.parity_gap(df, attribute, target).first()["parity_gap"]
    sections["Recommendations"] = recommendations(df, gap)
    return sections


def recommendations(df: DataFrame, parity_gap: float | None = None) -> list[dict]:
    """issue, column, advice for missing values, outliers, personal data and label gaps."""
    out = [{"issue": "missing", "column": r["column_name"], "advice": "impute or drop"} for r in profile.completeness(df).filter("completeness < 90").collect()]
    out += [{"issue": "outliers", "column": r["column_name"], "advice": "clip at three standard deviations or inspect"} for r in profile.outlier_counts(df).filter("n_outliers > 0").collect()]
    out += [{"issue": r["kind"], "column": r["column_name"], "advice": "hash or remove"} for r in privacy.pii_scan(df).filter("n_rows > 0").collect()]
    if parity_gap is not None and parity_gap > 0.1:
        out.append({"issue": "parity", "column": "", "advice": "rebalance groups"})
    return sorted(out, key=lambda x: (x["issue"], x["column"]))
