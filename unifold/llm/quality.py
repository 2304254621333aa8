"""Quality rules with risk-controlled thresholds.

``features`` measures every document; ``thresholds`` picks, per stratum and
rule, a cutoff on labelled holdout rows; ``quality`` applies them.

The guarantee: with probability ``1 - delta`` over the labelled rows, in every
stratum at most ``alpha`` of the documents labelled good are rejected by the
rules' cutoffs. ``alpha`` is split evenly over the rules (union bound), and
``delta`` over strata times rules (Bonferroni). Along one rule's fixed grid the
cutoffs are tested from lenient to strict, each by an exact one-sided binomial
bound, and testing ends at the first that fails (fixed-sequence testing, which
needs no further correction). Among the cutoffs that passed, the one that
separates bad from good rows best is taken; none if no cutoff helps.

Empty inputs: null texts count as empty (no words; they fail the base rules).
Null strata form a stratum of their own. Unlabelled strata get no cutoffs.
Labels with null quality are ignored; labels that contradict each other for one
id count each. Repeated document rows give repeated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, storage

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "shout_ratio", "long_words")
#: Cutoffs from lenient to strict, the same for all data.
GRID = {
    "symbol_ratio": np.geomspace(2, 0.005, 24),
    "dup_line_ratio": np.linspace(0.95, 0.05, 24),
    "repeat_ratio": np.linspace(0.5, 0.02, 24),
    "upper_ratio": np.linspace(0.95, 0.1, 24),
    "shout_ratio": np.geomspace(2, 0.02, 24),
    "long_words": np.geomspace(60, 7, 24),
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_shouts long"


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Marks the words of each row that lie in a window of ``size`` words found twice or more in that row."""
    n = len(hashes)
    marked = np.zeros(n, bool)
    if n < size:
        return marked
    row = kernel.row_of(first)
    starts = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    if not len(starts):
        return marked
    grams = kernel.gram_hashes(hashes, starts, size)
    with np.errstate(over="ignore"):
        grams = kernel.mix(grams + (row[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(size):
        marked[starts[twice] + k] = True
    return marked


def repeated_lines(buf: np.ndarray, offs: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word equal to an earlier one, and lines with a word."""
    feed = np.zeros(len(buf) + 1, bool)
    feed[:-1] = buf == 10
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs[:-1]] = True
    starts = np.flatnonzero(edge[:-1] | np.concatenate([[False], feed[:-2]]) if len(buf) else np.zeros(0, bool))
    row = np.searchsorted(offs, starts, "right") - 1
    nxt = np.append(starts[1:], len(buf))
    ends = nxt - ((nxt > starts) & feed[nxt - 1])
    keep = np.searchsorted(first_word, ends) > np.searchsorted(first_word, starts)
    starts, ends, row = starts[keep], ends[keep], row[keep]
    hashes = kernel.span_hashes(buf, starts, ends)
    with np.errstate(over="ignore"):
        hashes = kernel.mix(hashes + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashes, kind="stable")
    dup = order[1:][hashes[order][1:] == hashes[order][:-1]]
    n = len(offs) - 1
    return np.bincount(row[dup], minlength=n), np.bincount(row, minlength=n)


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = kernel.words(buf, offs)
    n = len(offs) - 1
    z = np.zeros(n, np.int64)
    if not len(buf):
        return {k.split()[0]: z for k in COUNTS.split(", ")}
    hashes = kernel.span_hashes(buf, starts, ends)
    dup, lines = repeated_lines(buf, offs, starts)
    upper = (buf >= 65) & (buf <= 90)
    letters = upper | ((buf >= 97) & (buf <= 122))
    return {
        "n_words": np.diff(first),
        "word_chars": kernel.per_row(~kernel.WHITE[buf] & ((buf & 0xC0) != 0x80), offs),
        "n_symbols": kernel.per_row(SYMBOLS[buf], offs),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": kernel.per_row(repeated_words(hashes, first), first),
        "n_lines": lines.astype(np.int64),
        "n_upper": kernel.per_row(upper, offs),
        "n_letters": kernel.per_row(letters, offs),
        "n_shouts": kernel.per_row(buf == 33, offs),
    }


def features(df: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts and ratios of each row's whole text, with its id and stratum. Map-only."""
    storage.bounded_batches(df.sparkSession)
    narrow = df.select(F.col(id).alias("id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"))

    def run(batches):
        for rows, buf, offs in kernel.slices(batches, 2):
            got = measure(buf, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(x) for x in got.values())], names=["id", "stratum", *got])

    kind = dict(narrow.dtypes)["id"]
    out = narrow.mapInArrow(run, f"id {kind}, stratum string, {COUNTS}")
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (
        out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("symbol_ratio", ratio("n_symbols", "word_chars"))
        .withColumn("dup_line_ratio", ratio("n_dup_lines", "n_lines"))
        .withColumn("repeat_ratio", ratio("n_repeat_words", "n_words"))
        .withColumn("upper_ratio", ratio("n_upper", "n_letters"))
        .withColumn("shout_ratio", ratio("n_shouts", "n_words"))
        .withColumn("long_words", ratio("word_chars", "n_words"))
    )


def upper_bound(k: int, n: int, delta: float, above: float = 1.0) -> float:
    """The exact (Clopper-Pearson) upper bound at level ``delta`` on a rate seen k times in n; 1 if over ``above``."""
    if n == 0 or k >= n or k > above * n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()])

    def at_most(p: float) -> float:
        x = logs + i * math.log(p) + (n - i) * math.log1p(-p)
        return math.exp(x.max()) * float(np.exp(x - x.max()).sum())

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid < 1 and at_most(max(mid, 1e-300)) > delta else (lo, mid)
    return hi


def choose(grid: np.ndarray, good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int, alpha: float, delta: float) -> float:
    """The cutoff for one rule and stratum; good and bad: rows over each cutoff. Infinite if none is certified and of use."""
    best, cut = 0.0, math.inf
    for c, g, b in zip(grid.tolist(), good.tolist(), bad.tolist(), strict=True):
        if upper_bound(int(g), n_good, delta, alpha) > alpha:
            break
        gain = b / max(n_bad, 1) - g / max(n_good, 1)
        if b > 0 and gain > best + 1e-12:
            best, cut = gain, c
    return cut


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Per stratum and rule: cutoff. All labelled rows that pass the base rules count.

    Rows over each cutoff are counted by Spark; what one task then gets for a
    stratum is one row per rule and cutoff, however many documents there are.
    """
    known = labels.where(F.col(quality).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), (F.col(quality) == 1).alias("good"))
    rows = measured.where(~F.col("base_failed")).select("id", "stratum", *RULES).join(known, "id")
    sums = [F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")]
    for r in RULES:
        for side, which in (("g", F.col("good")), ("b", ~F.col("good"))):
            sums.append(F.array(*(F.count_if(which & (F.col(r) > float(c))) for c in GRID[r])).alias(f"{side}_{r}"))
    counted = rows.groupBy("stratum").agg(*sums)
    strata = max(counted.count(), 1)
    each = delta / (strata * len(RULES))

    def pick(batches):
        for pdf in batches:
            out = [(x["stratum"], *(choose(GRID[r], np.asarray(x[f"g_{r}"]), np.asarray(x[f"b_{r}"]), x["n_good"], x["n_bad"], alpha / len(RULES), each) for r in RULES)) for x in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=["stratum", *(f"cut_{r}" for r in RULES)])

    return counted.mapInPandas(pick, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))


def quality(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """Every row's counts, base_failed and kept (not base_failed and no certified cutoff exceeded)."""
    measured = storage.written(features(df, id, text, stratum), "quality")
    cuts = thresholds(measured, labels, alpha, delta, id)
    over = F.lit(False)
    for r in RULES:
        over |= F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return measured.join(cuts, "stratum", "left").select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
