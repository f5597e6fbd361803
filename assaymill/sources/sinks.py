"""Where results go: JSON, one text a target, and nothing over what is there unless told so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_texts(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """texts: target_id, text. A folder for each target."""
    texts.select("target_id", "text").write.mode(mode).partitionBy("target_id").option("lineSep", "\n\f\n").text(path)


def scratch(path: str, complete: bool) -> str:
    """The place of a run's output: a run that isn't complete goes beside, never over the complete one."""
    return path if complete else f"{path.rstrip('/')}-scratch"


def exit_code(findings: DataFrame) -> int:
    """1 if anything blocks a target, else 0."""
    return int(bool(findings.agg(F.bool_or(F.col("severity") == "blocker")).head()[0]))
