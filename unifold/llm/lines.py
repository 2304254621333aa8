"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one line kept per group.

Lines are compared in normal form: A-Z lower-cased, ASCII symbols as blanks, words
joined by one space. Lines without words are left alone, and those of fewer than
``least_words`` words link only with equal ones. Equal lines are one node; nodes
of more words get a 64-bit SimHash of their distinct words. Lines
of edit similarity 0.8 are often 10 bits and more apart, too far for blocks of the
hash as keys. So nodes meet on word sequences that edits leave alone: short
lines on what is left without any one word, others on the ``SMALLEST`` of their
3- or 4-word sequences by hash (two kinds of keys where these ranges of
length overlap). Of those that meet, the ones at most ``BITS`` bits apart are
verified by edit similarity of their normal forms in code points. Of every
connected group the first occurrence (least id, then line) is kept, and all
others are cut from their texts.

Empty inputs: null and empty texts have no lines with words. Rows with equal id
and equal text count as one document and get the same result. Null ids come last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernel, storage
from .components import linked, pick

U = np.uint64
BITS = 13
PAIRS = 4096  #: pairs that one task verifies, about
MASKS = 1 << 31  #: bits that the positions of all code points of a line may take, beyond which the JVM compares it
SMALLEST = 6  #: keys of a line of each kind
LEADERS = 16  #: lines that a key names in a round; each line is compared with the one of the nearest SimHash
WHOLE = 7  #: words of a line that meets others without one of its words, at most
SEQUENCES = (3, 6, 14), (4, 12, 1 << 40)  #: words of a sequence, and of the lines that it is taken from
PERCENT = 80
LEAST_WORDS = 5
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True


def split_lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each line of each row that isn't empty; lines end before a line feed."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    feed = buf == 10
    begin = np.zeros(len(buf) + 1, bool)
    begin[offs[:-1]] = True
    begin[1:] |= feed
    starts = np.flatnonzero(begin[:-1])
    nxt = np.append(starts[1:], len(buf))
    ends = nxt - feed[nxt - 1]
    return np.searchsorted(offs, starts, "right") - 1, starts, ends


def normal_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Word spans and hashes in normal form, and each line's first word (n lines + 1)."""
    low = kernel.LOWER[buf]
    edges = np.append(starts, len(buf))
    ws, we = kernel.spans(WORDY[buf] & (buf != 10), edges) if len(buf) else (np.zeros(0, np.int64),) * 2
    return low, ws, we, kernel.span_hashes(low, ws, we), np.searchsorted(ws, edges)


def top_bits(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Row number and the upper 40 bits of the hash in one number, which sorts fast; rows below 2 ** 24."""
    return (row.astype(np.uint64) << U(40)) | (hashes >> U(24))


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each run's distinct word hashes; no run is empty.

    Each word counts once: in long lines the commonest words would else decide,
    and all long lines of a language would look alike. Eight counters of 8 bits
    are summed at once, for longer lines four of 16 bits (up to 65,535 words count).
    """
    rows = len(first) - 1
    if rows >= 1 << 24:
        half = rows // 2
        return np.concatenate([simhash(hashes[: first[half]], first[: half + 1]), simhash(hashes[first[half] :], first[half:] - first[half])])
    if not rows:
        return np.zeros(0, np.uint64)
    key = np.sort(top_bits(hashes, kernel.row_of(first)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    begin = np.searchsorted(key >> U(40), np.arange(rows, dtype=np.uint64))
    size = np.diff(np.append(begin, len(key)))
    words = kernel.mix(key & U((1 << 40) - 1))
    ones = np.empty((rows, 64), bool)
    for many, width in ((False, 8), (True, 16)):
        own = np.flatnonzero((size > 255) == many)
        if not len(own):
            continue
        member = np.repeat((size > 255) == many, size)
        at = np.cumsum(size[own]) - size[own]
        lanes = 64 // width
        table = sum(((np.arange(1 << lanes, dtype=np.uint64) >> U(j)) & U(1)) << U(width * j) for j in range(lanes))
        for k in range(width):
            part = (words[member] >> U(lanes * k)) & U((1 << lanes) - 1)
            sums = np.add.reduceat(table[part.astype(np.int64)], at)
            ones[own, lanes * k : lanes * (k + 1)] = 2 * sums.view(np.uint8 if width == 8 else np.uint16).reshape(-1, lanes).astype(np.int32) > size[own][:, None]
    return np.packbits(ones, axis=1).view(np.uint64).ravel()


def line_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all keys of each run of word hashes; runs with a common key are compared."""
    size, out = np.diff(first), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for n in np.unique(size[size <= WHOLE]).tolist():
        own = np.flatnonzero(size == n)
        words = hashes[first[own][:, None] + np.arange(n)]
        out.append((own, kernel.gram_hashes(words.ravel(), np.arange(len(own)) * n, n)))
        for k in range(n if n > 1 else 0):
            rest = np.delete(words, k, axis=1).ravel()
            out.append((own, kernel.gram_hashes(rest, np.arange(len(own)) * (n - 1), n - 1)))
    for length, least, most in SEQUENCES:
        own = np.flatnonzero((size >= least) & (size <= most))
        for lo in range(0, len(own), 1 << 24):
            part = own[lo : lo + (1 << 24)]
            count = size[part] - length + 1
            begin = np.cumsum(count) - count
            row = np.repeat(np.arange(len(part)), count)
            grams = kernel.gram_hashes(hashes, np.arange(len(row)) + (first[part] - begin)[row], length)
            short = top_bits(grams, row)
            last = np.sort(short)[begin + np.minimum(count, SMALLEST) - 1] if len(part) else short
            taken = short <= last[row]
            out.append((part[row[taken]], grams[taken]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compared(buf: np.ndarray, offs: np.ndarray, least_words: int):
    """The lines of at least ``least_words`` words: normal bytes, word spans and hashes, row, number, first words, node."""
    row, starts, ends = split_lines(buf, offs)
    low, ws, we, hashes, first = normal_words(buf, starts, ends)
    size = np.diff(first)
    keep = np.flatnonzero(size >= least_words)
    member = np.repeat(size >= least_words, size)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    edge = np.concatenate([[0], np.cumsum(size[keep])])
    hashes = hashes[member]
    return low, ws[member], we[member], hashes, row[keep], number[keep], edge, kernel.gram_hashes(hashes, edge[:-1], np.diff(edge))


def sketches_of(df: DataFrame, least_words: int) -> DataFrame:
    """A row for each line with words: rid, id, line, node, and m, how many of them its row has. ``df``: rid, id, text.

    Where a node of at least ``least_words`` words comes first in a slice, its row
    also has what the node is compared by: keys, SimHash s, length n in code points,
    and text in normal form. So texts are read once.
    """

    def run(batches):
        for rows, buf, offs in kernel.slices(batches, 2):
            low, ws, we, hashes, row, number, edge, node = compared(buf, offs, 1)
            take, many = pa.array(row), np.bincount(row, minlength=rows.num_rows)
            own = np.unique(node, return_index=True)[1]
            own = np.sort(own[np.diff(edge)[own] >= least_words])
            size = np.diff(edge)[own]
            first = np.concatenate([[0], np.cumsum(size)])
            word = np.arange(first[-1]) + np.repeat(edge[own] - first[:-1], size)
            mine = hashes[word]
            line, key = line_keys(mine, first)
            count = np.bincount(line, minlength=len(own))
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), kernel.signed(key[np.argsort(line, kind="stable")]))
            # Words with a blank each, but for the last of a line.
            wide = (we - ws)[word] + 1
            wide[first[1:] - 1] -= 1
            stop = np.cumsum(wide)
            at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(ws[word] - (stop - wide), wide)
            flat = np.append(low, 32)[at].astype(np.uint8)
            blank = np.ones(len(word), bool)
            blank[first[1:] - 1] = False
            flat[stop[blank] - 1] = 32
            edges = np.concatenate([[0], stop])[first]
            text = pa.StringArray.from_buffers(len(own), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat))
            chars = kernel.per_row((flat & 0xC0) != 0x80, edges)
            place = np.full(len(node), -1)
            place[own] = np.arange(len(own))
            place = pa.array(place, mask=place < 0)
            held = [x.take(place) for x in (keys, kernel.signed(simhash(mine, first)), pa.array(chars.astype(np.int32)), text)]
            told = [rows.column(0).take(take), rows.column(1).take(take), pa.array(number.astype(np.int32)), kernel.signed(node), pa.array(many[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*told, *held], names=["rid", "id", "line", "node", "m", "keys", "s", "n", "text"])

    return df.mapInArrow(run, f"rid long, id {dict(df.dtypes)['id']}, line int, node long, m int, keys array<long>, s long, n int, text string")


def within(a: str, b: str, most: int) -> bool | None:
    """Whether the edit distance of the code points of ``a`` and ``b`` is at most ``most``; None where it would take too much memory.

    Common ends go first. What is left is read by bit vectors: a column of the
    distance table is two numbers, of one bit for each code point of the shorter text.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in sorted((a, b), key=len))
    if len(y) - len(x) > most:
        return False
    for _ in range(2):
        differ = x != y[: len(x)]
        same = int(differ.argmax()) if differ.any() else len(x)
        x, y = x[same:][::-1], y[same:][::-1]
    m, n = len(x), len(y)
    if n <= most:
        return True
    if not m:
        return False
    symbols, place = np.unique(x, return_inverse=True)
    if len(symbols) * m > MASKS:
        return None
    eqs = {s: int.from_bytes(np.packbits(place == k, bitorder="little").tobytes(), "little") for k, s in enumerate(symbols.tolist())}
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, left = full, 0, m, n
    for s in y.tolist():
        eq = eqs.get(s, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ((xh | up) ^ full), up & xh
        left -= 1
        if ph & top:
            distance += 1
        elif mh & top:
            distance -= 1
        if distance - left > most:
            return False
        if distance + left <= most:
            return True
        ph = (ph << 1) | 1
        up, down = ((mh << 1) | ((xv | ph) ^ full)) & full, ph & xv
    return distance <= most


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts ``ta`` and ``tb`` have an edit similarity, 1 - distance / longer length, of at least ``percent``.

    Pairs of very long lines of very many different code points are left to the JVM.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                left, right = (part.column(k).to_pylist() for k in (2, 3))
                got = [within(x, y, (100 - percent) * max(len(x), len(y)) // 100) for x, y in zip(left, right, strict=True)]
                own = pa.array([k for k, g in enumerate(got) if g is not False], pa.int64())
                wide = [got[k] is None for k in own.to_pylist()]
                texts = [pa.array([t[k] if w else None for k, w in zip(own.to_pylist(), wide, strict=True)], pa.string()) for t in (left, right)]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(own) for k in (0, 1)), *texts], names=["a", "b", "ta", "tb"])

    most = f"cast((100 - {percent}) * greatest(length(ta), length(tb)) div 100 as int)"
    found = pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, ta string, tb string")
    return found.where(F.expr(f"ta is null or levenshtein(ta, tb, {most}) >= 0")).select("a", "b")


def groups(sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, comp) of every node that links with another one. ``sketches``: a written table as :func:`sketches_of` gives it."""
    spark = sketches.sparkSession
    nodes, same = sketches.where("keys is not null"), Window.partitionBy("h")
    keyed = nodes.select(F.explode("keys").alias("h"), "node", "s", "n").select("*", F.min("node").over(same).alias("lo"), F.max("node").over(same).alias("hi"), F.count(F.lit(1)).over(same).alias("c"))
    todo = storage.written(keyed.where("lo <> hi").select("h", "node", "s", "n", "c").dropDuplicates(["h", "node"]), "line-keys")
    texts = storage.written(pick(nodes.select("node", "text"), todo.select("node").distinct()), "line-texts")

    def compare(pairs: DataFrame) -> DataFrame:
        close = storage.written(pairs.select("a", "b").distinct(), "line-pairs")
        held = pick(texts, close.select(F.col("a").alias("node")).union(close.select("b")).distinct())
        both = close.join(held.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(held.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
        # Pairs are few bytes and much work, so their number tells how many tasks they get.
        got = storage.written(verified(both.repartition(close.count() // PAIRS + 1, "a", "b"), percent), "line-links")
        storage.drop(spark, close)
        return got

    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    possible = (apart <= BITS) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    links, comps = linked(todo, ("s", "n"), "n", possible, compare, LEADERS, apart, True)
    for t in (links, todo, texts):
        storage.drop(spark, t)
    return comps


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``df``: its columns, and kept (the text without its cut lines), n_cut and n_lines, its lines with words.

    ``kept`` joins the lines that stay by line feeds; a text with no line cut is
    returned as it is (null stays null). Input columns named like one of these
    three are replaced; other names may be anything. An empty table gives an empty one. Very long
    texts are read whole, one at a time.
    """
    spark = df.sparkSession
    storage.bounded_batches(spark)
    rid = F.xxhash64(F.col(id).cast("string"), F.col(text))
    rows = df.select(rid.alias("rid"), F.col(id).alias("id"), F.col(text).alias("text"))
    found = storage.written(sketches_of(rows, least_words), "lines")
    comps = groups(found, percent)
    grouped = found.join(comps, "node", "left").select("rid", "id", "line", "m", F.coalesce("comp", "node").alias("comp"))
    grouped = storage.written(grouped, "line-groups")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "rid", "line")
    first = grouped.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("count")).where("count > 1").select("comp", "first")
    extra = ~((F.col("rid") == F.col("first.rid")) & (F.col("line") == F.col("first.line")))
    cuts = grouped.join(first, "comp", "left").groupBy("rid").agg(F.collect_set(F.when(F.col("first").isNotNull() & extra, F.col("line"))).alias("cut"), F.max("m").alias("m"))
    cuts = storage.written(cuts, "line-cuts")
    for t in (found, comps, grouped):
        storage.drop(spark, t)
    names = [c for c in df.columns if c not in ("kept", "n_cut", "n_lines")]

    def cut(batches):
        for batch in batches:
            kept, size = [], []
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = set(c or ())
                kept.append("\n".join([x for k, x in enumerate(t.split("\n")) if k not in gone]) if gone else t)
                size.append(len(gone))
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(kept, pa.string()), pa.array(size, pa.int64()), batch.column(3)], names=[*names, "kept", "n_cut", "n_lines"])

    schema = StructType([df.schema[c] for c in names]).add("kept", "string").add("n_cut", "long").add("n_lines", "long")
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), rid.alias("rid"), F.col(text).alias("text")).join(cuts, "rid", "left")
    return whole.select("row", "text", "cut", F.coalesce("m", F.lit(0)).cast("long").alias("m")).mapInArrow(cut, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_cut", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
