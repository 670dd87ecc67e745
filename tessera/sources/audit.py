"""Audit reports of a job as JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_json(summary: DataFrame, path: str) -> None:
    """One JSON line for each job; the committer makes files appear whole."""
    summary.write.mode("overwrite").json(path)


def markdown(row: dict, title: str = "Job") -> str:
    """One job's summary as a Markdown table."""
    lines = [f"# {title} {row.get('job_id')}", "", "| metric | value |", "|-|-|"]
    return "\n".join([*lines, *[f"| {k} | {json.dumps(v, default=str)} |" for k, v in row.items() if k != "job_id"]]) + "\n"
