"""Sources: event tables, onset files, text matrices and file names with key-value entities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def entities(path) -> dict[str, str]:
    """Key-value pairs of a file name such as sub-01_run-2_events.tsv."""
    return dict(re.findall(r"([A-Za-z0-9]+)-([A-Za-z0-9]+)", str(path).rsplit("/", 1)[-1]))


def entity(path, key: str):
    """The value of one key in a column of paths, null if absent."""
    got = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), rf"(?:^|_){key}-([A-Za-z0-9]+)", 1)
    return F.when(got != "", got)


def read_events(spark: SparkSession, paths: list[str], onset: str = "onset", duration: str = "duration", label: str = "trial_type") -> DataFrame:
    """Tab-separated event files, with all their columns and the run of each, rows without a label dropped.

    Runs are numbered by the files' session and run entities in natural order.
    Files may have different columns. Without a label column every event is an ``event``.
    """
    number = lambda v: (0, int(v), "") if v and v.isdigit() else (1, 0, v or "")
    ordered = sorted(paths, key=lambda p: (number(entities(p).get("ses")), number(entities(p).get("run")), p))
    out = None
    for run, path in enumerate(ordered):
        one = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("run", F.lit(run)).withColumn("row", F.monotonically_increasing_id())
        if label not in one.columns:
            one = one.withColumn(label, F.lit("event"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    numbers = {c: F.expr(f"try_cast(`{c}` as double)") for c in (onset, duration) if c in out.columns}
    kept = F.col(label).isNotNull() & ~F.lower(F.trim(F.col(label))).isin("", "n/a")
    return out.withColumns(numbers).where(kept)


def read_onsets(spark: SparkSession, path: str) -> DataFrame:
    """(run, onset) from a text file with one line of onsets for each run; * stands for none. Marks like 12.5:3 lose what follows the colon."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("run", "line"))
    parts = lines.select("run", F.explode(F.split(F.trim("line"), r"\s+")).alias("x")).where("x not in ('', '*')")
    return parts.select("run", F.expr("cast(split(x, ':')[0] as double)").alias("onset"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, values array<double>) from a text matrix; lines that begin with # are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).where("trim(line) <> '' and not startswith(trim(line), '#')")
    row = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")) - 1
    return lines.select(row.alias("row"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def selected(text: str, size: int) -> list[int]:
    """Places named by a selector such as 0,3, 2..8(2) or 5..$ of ``size`` places; order and repeats are kept."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.strip("[]{} ").split(","))):
        m = re.fullmatch(r"(\d+|\$)(?:(?:\.\.|-)(\d+|\$)(?:\((-?\d+)\))?)?", part)
        if not m:
            raise ValueError(f"bad selector {part}")
        a, b = (size - 1 if x == "$" else int(x) if x else None for x in m.group(1, 2))
        step = int(m[3] or 1)
        if step == 0:
            raise ValueError("a step of 0")
        got = [a] if b is None else list(range(a, b + (1 if step > 0 else -1), step if a <= b or step < 0 else -step)) if a <= b else list(range(a, b - 1, -abs(step)))
        if any(not 0 <= k < size for k in got):
            raise ValueError(f"{part} is beyond the {size} there are")
        out += got
    return out


def repeated(text: str) -> list[float]:
    """Numbers of a run-length notation such as 2@0,1."""
    out: list[float] = []
    for part in filter(None, re.split(r"[,\s]+", text)):
        n, _, v = part.rpartition("@")
        out += [float(v)] * (int(n) if n else 1)
    return out
