"""Reports: aggregated in Spark, rendered from bounded results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITY_LABELS = {1: "🔴 高 / High", 2: "🟡 中 / Medium", 3: "🟢 低 / Low"}


def findings_text(findings: Column) -> Column:
    """Numbered list of findings; '' without any."""
    lines = F.transform(findings, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x, F.lit(""))))
    return F.when(F.size(findings) > 0, F.concat(F.lit("**关键发现 / Key Findings**:\n\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def urls_text(urls: Column, shown: int = 10) -> Column:
    """List of recommended urls, ``shown`` of them, with labels and reasons."""
    label = lambda p: F.when(p == 1, PRIORITY_LABELS[1]).when(p == 2, PRIORITY_LABELS[2]).when(p == 3, PRIORITY_LABELS[3]).otherwise("中 / Medium")
    lines = F.transform(
        F.slice(urls, 1, shown),
        lambda u: F.concat(
            F.lit("- ["), label(F.coalesce(u.priority, F.lit(2))), F.lit("] "), F.coalesce(u.url, F.lit("")), F.when(F.coalesce(u.reason, F.lit("")) != "", F.concat(F.lit("\n  - 原因: "), u.reason)).otherwise("")
        ),
    )
    more = F.when(F.size(urls) > shown, F.concat(F.lit("\n- ... ("), (F.size(urls) - shown).cast("string"), F.lit(" more URLs)"))).otherwise("")
    return F.when(F.size(urls) > 0, F.concat(F.lit("**推荐访问 / Recommended URLs**:\n\n"), F.array_join(lines, "\n"), more, F.lit("\n"))).otherwise("")


def data_text(rollup: DataFrame) -> DataFrame:
    """Markdown lines of extracted values by key ``(key, line)``: ten values shown of all counted."""
    more = F.when(F.col("n_values") > F.size("shown"), F.concat(F.lit(" ("), F.col("n_values").cast("string"), F.lit(" total)"))).otherwise("")
    return rollup.select("key", F.concat(F.lit("- **"), F.col("key"), F.lit("**: "), F.array_join("shown", ", "), more).alias("line"))


def page_section(pages: DataFrame) -> DataFrame:
    """Markdown of each page ``(analysis_id, section)``; one row a page, rendered in parallel."""
    score = F.format_string("%.2f", F.coalesce("relevance_score", F.lit(0.0)))
    return pages.select(
        "analysis_id",
        F.concat(
            F.lit("### "), F.coalesce("url", F.lit("")), F.lit("\n\n- **相关性 / Relevance**: "), score, F.lit("\n\n"),
            F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("**摘要 / Summary**:\n\n> "), F.col("summary"), F.lit("\n\n"))).otherwise(""),
            findings_text(F.coalesce("key_findings", F.array().cast("array<string>"))),
            urls_text(F.coalesce("prioritized_urls", F.array().cast("array<struct<url:string,priority:int,reason:string,link_text:string>>"))),
        ).alias("section"),
    )


def write_report(
    summary: dict, sections: DataFrame, folder: str, name: str, top: int = 100, formats: tuple[str, ...] = ("markdown", "json"), rollup: DataFrame | None = None, footer: str = "*Generated automatically*"
) -> list[str]:
    """Render the ``top`` sections of a report to files, with the roll-up of extracted values
    (as many keys) and a footer; the whole stays a table."""
    rows = sections.orderBy("rank").limit(top).collect()
    data = [r["line"] for r in data_text(rollup).orderBy("key").limit(top).collect()] if rollup is not None else []
    folder_path = Path(folder)
    folder_path.mkdir(parents=True, exist_ok=True)
    out = []
    if "markdown" in formats:
        head = "\n".join(f"- **{k}**: {v}" for k, v in summary.items())
        path = folder_path / f"{name}.md"
        path.write_text("# Crawl report\n\n" + head + "\n\n" + "\n---\n\n".join(r["section"] for r in rows) + ("\n\n## Data\n\n" + "\n".join(data) if data else "") + f"\n\n---\n\n{footer}\n", encoding="utf-8")
        out.append(str(path))
    if "json" in formats:
        path = folder_path / f"{name}.json"
        path.write_text(json.dumps({"summary": summary, "pages": [r.asDict(recursive=True) for r in rows]}, ensure_ascii=False, default=str), encoding="utf-8")
        out.append(str(path))
    return out
