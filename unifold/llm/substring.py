"""Substring dedup by a Relative Lempel-Ziv parse against every indexed block.

The corpus is its own reference. Every run of consecutive ``size``-word windows
whose smallest ``gram``-word hash lies at the same place (a *block*) is indexed:
by the hash of that gram and by the hash of the block's words. Where blocks are
cut depends on the words alone, so two texts that share a passage cut it alike,
but for the blocks at its two ends.

A document's parse is greedy: block after block, each as a whole, is looked up
in the index of all blocks. Blocks found again are factors, and all windows in
them are duplicates. At the boundary of a factor - a block whose gram is found
again but whose words as a whole are not - the single windows are checked, each
against the windows of all other boundary blocks and of one occurrence of every
factor. Nothing else can hold a duplicate window, as equal windows have equal
smallest grams. Hashes of grams and blocks have 64 bits, those of single windows
128; a word is removed only if its window's words start elsewhere too.

What is shuffled is a row of a few numbers per block (about one for 13 words),
with counts summed before the shuffle; texts move once, to meet their spans.

Empty inputs: null and empty texts have no words. Rows with equal id and equal
text are separate occurrences (and so remove each other's long passages), and
all get the same result. Null ids are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, storage

SIZE, GRAM = 35, 10
POSITION = np.uint64((1 << 28) - 1)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by doubling."""
    span, have = 1, values
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def blocks(items: np.ndarray, first: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """(row, first window, windows, gram's place) of each block of each row of word hashes."""
    n = len(items)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none
    row = kernel.row_of(first)
    grams = kernel.gram_hashes(items, np.arange(n - gram + 1), gram)
    packed = (grams & ~POSITION) | (np.arange(n - gram + 1).astype(np.uint64) & POSITION)
    low = smallest(packed, size - gram + 1)  # one for each window start
    valid = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
    if not len(valid):
        return none, none, none, none
    low = low[valid]
    head = np.ones(len(valid), bool)
    head[1:] = (low[1:] != low[:-1]) | (row[valid[1:]] != row[valid[:-1]])
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(valid)))
    start = valid[at]
    place = start + ((low[at] & POSITION).astype(np.int64) - start) % (int(POSITION) + 1)
    return row[start], start, count, place


def _key(id: str, text: str):
    return F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("rid")


def index(df: DataFrame, size: int, gram: int) -> DataFrame:
    """Rows (rid, pf, np, h, e) of every block: row key, first window, windows, hashes of gram and block."""

    def run(batches):
        for rows, buf, offs in kernel.slices(batches, 1):
            starts, ends, first = kernel.words(buf, offs)
            items = kernel.span_hashes(buf, starts, ends)
            row, start, count, place = blocks(items, first, size, gram)
            h = kernel.gram_hashes(items, place, gram)
            e = kernel.gram_hashes(items, start, count + size - 1, 2)
            rid = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array((start - first[row]).astype(np.int32)), pa.array(count.astype(np.int16)), kernel.signed(h), kernel.signed(e)], names=["rid", "pf", "np", "h", "e"])

    return df.mapInArrow(run, "rid long, pf int, np short, h long, e long")


FACTOR, BOUNDARY, SOURCE = 1, 2, 3  #: a factor; a boundary block; a factor that stands for its equals in the index of windows


def parse(df: DataFrame, size: int, gram: int) -> DataFrame:
    """Rows (rid, codes): each document's factors and boundary blocks, as first window * 2**16 + windows * 4 + kind."""
    found = index(df, size, gram).withColumn("at", F.xxhash64("rid", "pf"))
    # Most grams that are found again are found in one block only, time and again: no count by block is needed for them.
    grams = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("at").alias("first")).where("n > 1")
    again = found.join(grams, "h")
    one = again.where("e0 = e1").select("rid", "pf", "np", F.when(F.col("at") == F.col("first"), SOURCE).otherwise(FACTOR).alias("kind"))
    several = again.where("e0 <> e1").select("rid", "pf", "np", "h", "e", "at")
    several = storage.written(several, "rlz-several")
    counts = several.groupBy("h", "e").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1")
    mixed = several.join(counts, ["h", "e"], "left").select("rid", "pf", "np", F.when(F.col("n").isNull(), BOUNDARY).when(F.col("at") == F.col("first"), SOURCE).otherwise(FACTOR).alias("kind"))
    code = F.shiftleft(F.col("pf").cast("long"), 16) + F.col("np") * 4 + F.col("kind")
    return one.union(mixed).select("rid", code.alias("code")).groupBy("rid").agg(F.collect_set("code").alias("codes"))  # rows that repeat have one set


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each entry of a list column; null lists have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def boundary_windows(joined: DataFrame, size: int) -> DataFrame:
    """Rows (rid, p, w, v, open) of the single windows of boundary blocks (open) and of sources. Input: id, rid, text, codes."""

    def run(batches):
        for rows, buf, offs in kernel.slices(batches, 2):
            row, code = listed(rows.column(3))
            keep = (code & 3) != FACTOR
            row, code = row[keep], code[keep]
            starts, ends, first = kernel.words(buf, offs)
            items = kernel.span_hashes(buf, starts, ends)
            count = (code >> 2) & 0x3FFF
            begin = code >> 16
            ends_at = np.cumsum(count)
            p = np.repeat(begin - (ends_at - count), count) + np.arange(ends_at[-1] if len(count) else 0)
            owner = np.repeat(row, count)
            at = first[owner] + p
            rid = rows.column(1).to_numpy(zero_copy_only=False)
            w = kernel.gram_hashes(items, at, size, 1)
            v = kernel.gram_hashes(kernel.mix(items + np.uint64(0x1357)), at, size, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rid[owner]), pa.array(p.astype(np.int32)), kernel.signed(w), kernel.signed(v), pa.array(np.repeat((code & 3) == BOUNDARY, count))], names=["rid", "p", "w", "v", "open"])

    return joined.mapInArrow(run, "rid long, p int, w long, v long, open boolean")


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the places in any of the ranges."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each row's words, joined by one space."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    index = np.repeat(starts - (stop - size), size) + np.arange(stop[-1] if len(size) else 0)
    text = np.append(buf, 0)[index].astype(np.uint8)
    text[stop - 1] = 32
    whole, at = text.tobytes(), np.concatenate([[0], stop])[first].tolist()
    return [whole[a : b - 1] if b > a else b"" for a, b in zip(at, at[1:], strict=False)]


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Per row of ``df``: id, n_words, n_removed, kept (the remaining words joined by one space) and spans removed.

    A window of ``size`` words is a duplicate if its words also start anywhere
    else, and every word in a duplicate window is removed. ``spans`` lists the
    removed ranges of words, [start, end).
    """
    spark = df.sparkSession
    storage.bounded_batches(spark)
    if not 2 <= gram <= size <= gram + 16000:
        raise ValueError("gram must be from 2 to size")
    keyed = df.select(F.col(id).alias("id"), F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("rid"), F.col(text).alias("text"))
    parsed = storage.written(parse(keyed.select("rid", "text"), size, gram), "rlz-parse")
    windows = boundary_windows(keyed.join(parsed.where(F.exists("codes", lambda c: c.bitwiseAND(3) != FACTOR)), "rid").select("id", "rid", "text", "codes"), size)
    twice = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "v")
    single = storage.written(windows.where("open").join(twice, ["w", "v"]).groupBy("rid").agg(F.collect_set("p").alias("singles")), "rlz-singles")

    def cut(batches):
        for rows, buf, offs in kernel.slices(batches, 1):
            starts, ends, first = kernel.words(buf, offs)
            row, code = listed(rows.column(2))
            known = (code & 3) != BOUNDARY
            row, code = row[known], code[known]
            more, p = listed(rows.column(3))
            a = np.concatenate([first[row] + (code >> 16), first[more] + p])
            b = np.concatenate([first[row] + (code >> 16) + ((code >> 2) & 0x3FFF), first[more] + p + 1]) + size - 1
            gone = cover(len(starts), a, b)
            removed = kernel.per_row(gone, first)
            left = np.concatenate([[0], np.cumsum(~gone)])[first]
            kept = joined_words(buf, starts[~gone], ends[~gone], left)
            s, e = kernel.spans(gone, first) if len(gone) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            r = np.searchsorted(first, s, "right") - 1
            pairs = pa.StructArray.from_arrays([pa.array(s - first[r]), pa.array(e - first[r])], names=["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, first).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), lists], names=["id", "n_words", "n_removed", "kept", "spans"])

    kind = dict(keyed.dtypes)["id"]
    whole = keyed.join(parsed, "rid", "left").join(single, "rid", "left").select("id", "text", "codes", "singles")
    return whole.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>").withColumnRenamed("id", id)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
