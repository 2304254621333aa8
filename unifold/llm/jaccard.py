"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Texts with equal shingle sets form a class, and only classes are joined. A
class's shingles are ordered from rare to frequent; two sets of similarity t
share a shingle among the first ``n - ceil(t n) + 1`` of each, so classes are
joined on these. Candidates are cut by length, by the place of their first
common shingle (positional filter) and by how their shingles spread over 16
ranges of hashes (suffix filter: what differs in the ranges' sizes differs in
the sets); what is left is verified on the texts, once per pair.

All pairs of a group of copies are never formed. Every prefix shingle names
leaders, classes whose prefix shingles are common, and each class is first compared with one of the leaders of its shingles.
Then a class outside the main component of one of its shingles is compared
with one class of that component; shingles whose classes have all become one component are
done. At last, only classes outside the main component of a shingle are compared
with the others under it. Every pair that shares a prefix shingle and passes the length and
positional filters is thus compared, or is in one component already, so
components are those of all links.

Frequencies are counts of all documents' shingles in a fixed number of hash
buckets (any order gives exact results, the counts only make it rare-first).

Empty inputs: null texts, and those without words, have no shingles, link with
nothing and are their own component. Texts of fewer words than a shingle have
one, the whole. Rows with equal texts are in one class. A null id counts as
larger than all others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, storage
from .components import SMALL, linked, pick

GRAM = 5
PERCENT = 80
BUCKETS = 1 << 20
CHUNK = 1 << 12
RANGES = 16


def by_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their rows, sorted by row, then hash: by one number, or by both where that can't tell all apart."""
    if len(row) and row[-1] < 1 << 20:
        key = (row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        order = np.argsort(key)
        key, sorted_h = key[order], h[order]
        if not ((key[1:] == key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
            return sorted_h, row[order]
    order = np.lexsort((h, row))
    return h[order], row[order]


def shingles(buf: np.ndarray, offs: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles (A-Z lower-cased), sorted, and each row's first (n rows + 1)."""
    low = kernel.LOWER[buf]
    starts, ends, first = kernel.words(low, offs)
    items = kernel.span_hashes(low, starts, ends)
    n = np.diff(first)
    size = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    stop = np.cumsum(size)
    row = np.repeat(np.arange(len(n)), size)
    at = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + first[:-1][row]
    h = kernel.gram_hashes(items, at, np.minimum(n[row], gram))
    h, row = by_row(h, row)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def prefix(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def least_overlap(total, percent: int = PERCENT):
    """The least intersection of two sets of ``total`` elements together that link."""
    return -((-percent * total) // (100 + percent))


def signatures(df: DataFrame, gram: int) -> DataFrame:
    """(id, rid, n, node, parts) per row: set size, the set's hash and its spread over hash ranges."""

    def run(batches):
        for rows, buf, offs in kernel.slices(batches, 1):
            h, first = shingles(buf, offs, gram)
            with np.errstate(over="ignore"):
                node = kernel.mix(kernel.per_row(kernel.mix(h + np.uint64(7)), first, np.uint64))
            row = kernel.row_of(first)
            parts = np.bincount(row * RANGES + (h >> np.uint64(60)).astype(np.int64), minlength=RANGES * (len(first) - 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) + 1, RANGES, dtype=np.int32)), pa.array(parts))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(first)), kernel.signed(node), lists], names=["id", "rid", "n", "node", "parts"])

    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, rid long, n long, node long, parts array<int>")


def bucket_counts(df: DataFrame, gram: int) -> np.ndarray:
    """How many documents' shingles fall into each of a fixed number of buckets (4 MB, whatever the data)."""
    schema = "chunk int, counts binary"

    def count(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for _, buf, offs in kernel.slices(batches, 1):
            h, _ = shingles(buf, offs, gram)
            sums += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
        packed = [zlib.compress(sums[a : a + CHUNK].tobytes(), 1) for a in range(0, BUCKETS, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed), dtype=np.int32)), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(packed), np.int64)
                sums[chunk] = sums[chunk] + got if chunk in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(BUCKETS, np.int64)
    for r in df.mapInArrow(count, schema).repartition("chunk").mapInArrow(total, schema).toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def tokens(df: DataFrame, counts: np.ndarray, gram: int, percent: int) -> DataFrame:
    """(h, node, n, i) of each prefix shingle: hash, class, set size, place in rare-first order."""
    share = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for rows, buf, offs in kernel.slices(batches, 1):
            h, first = shingles(buf, offs, gram)
            with np.errstate(over="ignore"):
                node = kernel.mix(kernel.per_row(kernel.mix(h + np.uint64(7)), first, np.uint64))
            row, n = kernel.row_of(first), np.diff(first)
            order = np.lexsort((h, share.value[(h >> np.uint64(44)).astype(np.int64)], row))
            place = np.arange(len(h)) - first[:-1][row]
            keep = place < prefix(n, percent)[row]
            row, h = row[keep], h[order][keep]
            yield pa.RecordBatch.from_arrays([kernel.signed(h), kernel.signed(node[row]), pa.array(n[row].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=["h", "node", "n", "i"])

    return df.mapInArrow(run, "h long, node long, n int, i int")


def possible(percent: int):
    """Length and positional filters on a pair's common shingle: what comes from it on must be enough for both."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need)


def filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, that pass the suffix filter. ``pairs``: a, b, na, nb per common shingle."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    first = pairs.select("a", "b", "na", "nb").distinct()
    parts = classes.select("node", "parts")
    spread = first.join(parts.withColumnsRenamed({"node": "a", "parts": "pa"}), "a").join(parts.withColumnsRenamed({"node": "b", "parts": "pb"}), "b")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return spread.where(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets link."""

    def run(batches):
        for batch in batches:
            lo = 0
            left, right = kernel.texts(batch.column(2)), kernel.texts(batch.column(3))
            while lo < batch.num_rows:
                hi = lo + 1
                while hi < batch.num_rows and left[1][hi + 1] - left[1][lo] + right[1][hi + 1] - right[1][lo] < (2 << 20):
                    hi += 1
                sets = []
                for buf, offs in (left, right):
                    h, first = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], gram)
                    sets.append((h, kernel.row_of(first), np.diff(first)))
                h, row = (np.concatenate([sets[0][k], sets[1][k]]) for k in (0, 1))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=hi - lo)
                ok = (100 + percent) * both >= percent * (sets[0][2] + sets[1][2])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])
                lo = hi

    sides = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
    return sides.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Per row of ``df``: id, n_shingles, component_id (the least id reachable by links) and n_links of its class to others found."""
    return grouped(df, id, text, gram, percent).select(F.col("id").alias(id), "n_shingles", "component_id", "n_links")


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` but for those with a near duplicate that comes first: by id (nulls last), then by a hash of id and text.

    Rows without words stay. Of rows that repeat (equal id and text) one stays.
    """
    spark = df.sparkSession
    rid = F.xxhash64(F.col(id).cast("string"), F.col(text))
    found = storage.written(grouped(df, id, text, gram, percent).where("n_shingles > 0").select("rid", "id", "comp"), "near-groups")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid"))["rid"].alias("_r"), F.count(F.lit(1)).alias("_m")).where("_m > 1").select("comp", "_r")
    gone = storage.written(found.join(first, "comp").where("rid <> _r").select("rid").distinct(), "near-gone")
    twice = storage.written(found.groupBy("rid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("rid").join(gone, "rid", "left_anti"), "near-twice")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), rid.alias("rid")).join(gone, "rid", "left_anti")
    if not twice.isEmpty():
        rows = rows.join(twice, "rid", "left_anti").union(rows.join(twice, "rid", "left_semi").dropDuplicates(["rid"]))
    return rows.select("row.*")


def grouped(df: DataFrame, id: str, text: str, gram: int, percent: int) -> DataFrame:
    """Per row of ``df``: rid (a hash of id and text), id, n_shingles, comp (of the row's class; null without words), component_id, n_links."""
    spark = df.sparkSession
    storage.bounded_batches(spark)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("rid"))
    sets = storage.written(signatures(rows, gram), "shingle-sets")
    classes = storage.written(sets.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("parts").alias("parts")), "shingle-classes")
    prefixes = tokens(rows, bucket_counts(rows, gram), gram, percent)
    shared = storage.written(prefixes.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("h", "c"), "shared")
    todo = storage.written(prefixes.join(shared, "h").distinct(), "shared-shingles")
    storage.drop(spark, shared)
    texts = storage.written(class_texts(rows, sets, todo.select("node").distinct()), "class-texts")

    def compare(pairs: DataFrame) -> DataFrame:
        candidates = storage.written(filtered(pairs, classes, percent), "candidates")
        held = pick(texts, candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct())
        got = storage.written(verified(candidates, held, gram, percent), "links")
        storage.drop(spark, candidates)
        return got

    links, comps = linked(todo, ("n", "i"), "n", possible(percent), compare)
    for t in (todo, texts):
        storage.drop(spark, t)
    named = classes.select("node", "least")
    least = comps.join(named, "node").groupBy("comp").agg(F.min("least").alias("component_id"))
    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = named.join(comps, "node", "left").join(least, "comp", "left").join(degree, "node", "left")
    named = named.select("node", F.coalesce("comp", "node").alias("comp"), F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = F.col("n") == 0
    out = sets.select("id", "rid", "n", F.when(~own, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("rid", "id", F.col("n").alias("n_shingles"), "comp", F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def class_texts(rows: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), one row for each of ``nodes``: the text of the class's row of the least rid."""
    chosen = sets.where("n > 0").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid"))
    if nodes.count() <= SMALL:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, "rid").select("node", "text").dropDuplicates(["node"])


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
