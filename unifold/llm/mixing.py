"""LM scoring by online logistic context mixing.

A text is a sequence of words and one end, and every token a sequence of binary
decisions: the path to it in a Huffman tree of the ``LEXICON`` commonest training
tokens, or the path to *other* and then its bytes, each by its path in a Huffman tree of
the bytes that follow the one before (every context of a spelling knows that one, so
short paths lose nothing). Each decision is predicted in four contexts, hashed into tables of fixed size:

- in the tree: none; the word before; the last very common word (which tells the
  language); the two words before;
- in a spelling: the last two bytes; all bytes of the word so far; the last very
  common word with the last byte; the last four bytes.

The counts of ones and zeros behind each hash come from all training documents.
The four predictions are mixed in the logistic domain by weights that a gate
chooses (tree or spelling, and depth); while a document is read its weights
follow the gradient of its coding cost, block by block, from the same start, so
that a document's score depends on no other's. Last, an adaptive probability
map per gate, also learned along the document, corrects the mix, as far as it has
seen enough. The score is the sum of log10 of all decisions' probabilities, so
bits per byte follow.

Counting is a map over the documents, table chunks summed by a shuffle; what
reaches the driver is the tables, whose size is fixed. Exact counts of rare words
(for the base score) are joined, those of common ones are broadcast, up to a
fixed number.

Empty inputs: null and empty texts are one end. Rows without an id are not
learned from and count as held out. Without training documents all counts are 0.
Repeated rows are learned from as often as they come, and get the same scores.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, storage

LEXICON = 1 << 18
LEAST = 6  #: training occurrences of a word of the lexicon: spellings are learned on the others
COMMON = 300_000  #: words whose exact counts are broadcast (under 5 MB)
MERGED = 1 << 20  #: counts that a task merges before it hands them on
BITS = 20  #: of a table's size
TABLES = 4
CHUNK = 1 << 14
FREQUENT = 48  #: the tokens of least rank that count as very common
SEGMENT = 96, 1536  #: decisions of a document between two changes of its weights: a third of those read, within these bounds
RATE = 0.015, 0.006  #: of learning, in the tree and in spellings
START = np.array([[0.15, 0.35, 0.6, 0.2], [0.28, 0.36, 0.3, 0.3]], np.float32)  #: weights of tree and spelling
GATES = 24
SLICE = 384 << 10
STEPS = 24  #: buckets of the probability map

U = np.uint64
END = U(0xE4D)  #: stands for the hash of the end


def scattered(nodes: np.ndarray) -> np.ndarray:
    """32-bit hashes of nodes."""
    return (kernel.mix(nodes.astype(np.uint64) + U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)


def tokens(buf: np.ndarray, offs: np.ndarray):
    """Lower-cased bytes, word spans, token hashes with ends, and each row's first token (n rows + 1)."""
    low = kernel.LOWER[buf]
    starts, ends, first = kernel.words(low, offs)
    h = kernel.span_hashes(low, starts, ends)
    out = np.insert(h, first[1:], END)
    word = np.insert(np.arange(len(h)), first[1:], -1)
    return low, starts, ends, out, word, first + np.arange(len(first))


class Codes:
    """Huffman codes: for each symbol a run of tree nodes and bits."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        heap = list(zip(weights.tolist(), range(n), strict=True))
        heapq.heapify(heap)
        up, side, node = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8), n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = node
            side[b[1]] = 1
            heapq.heappush(heap, (a[0] + b[0], node))
            node += 1
        root = node - 1
        depth = np.zeros(2 * n, np.int32)
        for k in range(root - 1, -1, -1):
            depth[k] = depth[up[k]] + 1
        self.size = depth[:n].astype(np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.nodes, self.bits = np.empty(self.size.sum(), np.int32), np.empty(self.size.sum(), np.uint8)
        # From the leaves up, all symbols at once.
        here, own = np.arange(n), np.flatnonzero(self.size > 0)
        for step in range(1, int(self.size.max(initial=0)) + 1):
            own = own[self.size[own] >= step]
            place = self.at[own] + self.size[own] - step
            self.bits[place] = side[here[own]]
            here[own] = up[here[own]]
            self.nodes[place] = here[own]


def depths(size: np.ndarray, most: int) -> np.ndarray:
    """0, 1, 2... along each of the runs of ``size``, ``most`` at most."""
    return np.minimum(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), most).astype(np.uint8)


class Spellings:
    """Huffman codes of a byte after each byte: symbol 256 * before + byte; every byte has one, seen or not."""

    def __init__(self, pairs: np.ndarray):
        codes = [Codes(row + 1) for row in pairs.reshape(256, 256)]
        self.size = np.concatenate([c.size for c in codes])
        self.at = np.cumsum(self.size) - self.size
        self.bits = np.concatenate([c.bits for c in codes])
        self.hashes = scattered(np.concatenate([c.nodes + np.int64(k * 512 + (1 << 40)) for k, c in enumerate(codes)]))
        self.gates = GATES - 8 + depths(self.size, 7)


class Index:
    """Finds hashes among sorted ones: their upper bits tell about where, so that few steps are left."""

    def __init__(self, hashes: np.ndarray):
        self.shift = U(64 - max(1, len(hashes).bit_length()))
        self.begin = np.searchsorted(hashes, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)
        self.hashes = np.append(hashes, U(2**64 - 1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the sorted hashes, whether the hash there is the one looked for)."""
        at = np.take(self.begin, (h >> self.shift).astype(np.int64))
        found = np.take(self.hashes, at)
        less = np.flatnonzero(found < h)
        while len(less):
            at[less] += 1
            found[less] = self.hashes[at[less]]
            less = less[found[less] < h[less]]
        return at, (found == h) & (at < len(self.hashes) - 1)


class Lexicon:
    """Symbols: 0 the end, 1 other, from 2 on words from common to rare."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, other: int, pairs: np.ndarray):
        rank = np.lexsort((hashes, -counts))
        order = np.argsort(hashes)
        self.index = Index(hashes[order])
        symbol = np.empty(len(hashes), np.int64)
        symbol[rank] = np.arange(len(hashes)) + 2
        self.symbol = symbol[order]
        self.codes = Codes(np.concatenate([[max(ends, 1), max(other, 1)], counts[rank]]))
        self.codes.hashes, self.codes.gates = scattered(self.codes.nodes), depths(self.codes.size, GATES - 9)
        self.spellings = Spellings(pairs)

    def of(self, h: np.ndarray) -> np.ndarray:
        at, known = self.index.find(h)
        out = np.where(known, np.append(self.symbol, 1)[at], 1)
        out[h == END] = 0
        return out


def slots(context: np.ndarray, size: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slots of all decisions: ``context`` has a 64-bit hash for each run of ``size`` of them, ``node`` a hash for each."""
    key = np.repeat((context >> U(32)).astype(np.uint32), size)
    key ^= node
    key >>= np.uint32(32 - BITS)
    return key.view(np.int32)


def paths(codes, symbols: np.ndarray):
    """(size, hash of each node, bit, gate, end of each run) of the paths of ``symbols``, one after the other."""
    size = codes.size[symbols]
    stop = np.cumsum(size)
    at = np.repeat(codes.at[symbols] - (stop - size), size)
    at += np.arange(len(at))
    return size, np.take(codes.hashes, at), np.take(codes.bits, at), np.take(codes.gates, at), np.concatenate([[0], stop])


def spread(x: np.ndarray) -> np.ndarray:
    return kernel.mix(x.astype(np.uint64) + U(0x2545F491))


def decisions(lex: Lexicon, buf: np.ndarray, offs: np.ndarray):
    """Both streams, tree and spelling: (slots per table, bits, gates, first decision of each row)."""
    low, starts, ends, h, word, first = tokens(buf, offs)
    sym, row = lex.of(h), kernel.row_of(first)
    n = len(sym)
    before = np.zeros(n, np.int64)
    before[1:] = np.where(row[1:] == row[:-1], sym[:-1], 0)
    before2 = np.zeros(n, np.int64)
    before2[1:] = np.where(row[1:] == row[:-1], before[:-1], 0)
    # The word before, if not in the lexicon, by its hash.
    left = np.zeros(n, np.uint64)
    left[1:] = np.where(row[1:] == row[:-1], h[:-1], U(0))
    common = np.where((sym >= 2) & (sym < 2 + FREQUENT), np.arange(n), -1)
    latest = np.concatenate([[-1], np.maximum.accumulate(common)[:-1]])
    latest = np.where(latest >= first[row], latest, -1)
    tongue = np.where(latest >= 0, sym[np.maximum(latest, 0)], 0)
    with np.errstate(over="ignore"):
        contexts = [kernel.mix(left + U(3)), spread(tongue * 8 + 5), kernel.mix(left + spread(before2))]
        size, node, bit, gate, stop = paths(lex.codes, sym)
        tree = [(node >> np.uint32(32 - BITS)).view(np.int32), *(slots(c, size, node) for c in contexts)]
        edges = stop[first]
        # Spellings: the bytes of a word and one blank.
        own = np.flatnonzero(sym == 1)
        a, b = starts[word[own]], ends[word[own]]
        length = b - a + 1
        till = np.cumsum(length)
        k = np.arange(till[-1] if len(own) else 0) - np.repeat(till - length, length)
        place = np.repeat(a, length) + k
        byte = np.append(low, 32)[place].astype(np.uint64)
        byte[till - 1] = 32
        back = [np.concatenate([np.zeros(d, np.uint64), byte[: max(len(byte) - d, 0)]])[: len(byte)] * (k >= d) for d in (1, 2, 3, 4)]
        p, q = kernel.powers(0, len(byte) + 1)
        sums = np.concatenate([[U(0)], np.cumsum((byte + U(1)) * p[: len(byte)])])
        start = np.repeat(till - length, length)
        whole = kernel.mix((sums[:-1] - sums[start]) * q[start] + k.astype(np.uint64))
        pair = back[0] * U(257) + back[1]
        ctx = [
            spread(pair + U(1 << 40)),
            kernel.mix(whole + U(77)),
            spread(back[0] + np.repeat(tongue[own], length).astype(np.uint64) * U(1024) + U(1 << 41)),
            spread(pair * U(66049) + back[2] * U(257) + back[3] + U(1 << 42)),
        ]
        size, node, bit2, gate2, stop = paths(lex.spellings, (back[0] * U(256) + byte).astype(np.int64))
        spelled = [slots(c, size, node) for c in ctx]
    edge2 = stop[np.concatenate([[0], till])[np.searchsorted(own, first)]]
    return (tree, bit, gate, edges), (spelled, bit2, gate2, edge2)


def table_counts(train: DataFrame, lex) -> np.ndarray:
    """Counts (2 * TABLES, 2 ** BITS) of zeros and ones behind each hash, over all documents of ``train`` (text)."""
    schema = "chunk int, counts binary"
    width = 2 * TABLES << BITS

    def count(batches):
        sums = np.zeros((TABLES, 2 << BITS), np.int32)
        for _, buf, offs in kernel.slices(batches, 0, SLICE):
            for found, bit, _, _ in decisions(lex.value, buf, offs):
                for t in range(TABLES):
                    np.add.at(sums[t], found[t] * 2 + bit, np.int32(1))
        flat = sums.ravel()
        for c in range(0, width // CHUNK, 64):
            ids = [k for k in range(c, c + 64) if flat[k * CHUNK : (k + 1) * CHUNK].any()]
            packed = [zlib.compress(flat[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1) for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(packed), np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + got if chunk in sums else got
        # Beyond 65535 only the proportion matters.
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_scaled(x).tobytes()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(width, np.uint16)
    for r in train.mapInArrow(count, schema).repartition("chunk").mapInArrow(total, schema).toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), np.uint16)
    return out.reshape(TABLES, 1 << BITS, 2)


def _scaled(x: np.ndarray) -> np.ndarray:
    pairs = x.reshape(-1, 2)
    over = np.maximum(pairs.max(1), 65535)
    return -(-(pairs * 65535) // over[:, None]).astype(np.uint16).ravel()


def stretched(counts: np.ndarray) -> np.ndarray:
    """ln(p / (1 - p)) of each slot's estimate, drawn to 0 where it has seen little."""
    zero, one = counts[..., 0].astype(np.float32), counts[..., 1].astype(np.float32)
    return (np.log((one + 0.05) / (zero + 0.05)) * ((zero + one) / (zero + one + 0.2))).astype(np.float32)


def cost(table: np.ndarray, stream, start: np.ndarray, rate: float) -> np.ndarray:
    """The natural logarithm of the probability of each row's decisions."""
    found, bit, gate, edges = stream
    out = np.zeros(len(edges) - 1)
    size = np.diff(edges)
    order = np.argsort(-size, kind="stable")
    active = int((size > 0).sum())
    if not active:
        return out
    inputs = [np.take(table[t], found[t]) for t in range(TABLES)]
    weights = [np.full(active * GATES, w, np.float32) for w in start]
    hits = np.zeros((active * STEPS, 2))
    done = 0
    sizes, begins = size[order], edges[:-1][order]
    while active:
        span = min(max(done // 3, SEGMENT[0]), SEGMENT[1])
        take = np.minimum(sizes[:active] - done, span)
        stop = np.cumsum(take)
        at = np.arange(stop[-1]) + np.repeat(begins[:active] + done - (stop - take), take)
        doc = np.repeat(np.arange(active), take)
        key = doc * GATES
        key += np.take(gate, at)
        seen = [np.take(x, at) for x in inputs]
        one = np.take(bit, at)
        dot = seen[0] * np.take(weights[0], key)
        for t in range(1, TABLES):
            dot += seen[t] * np.take(weights[t], key)
        np.minimum(np.maximum(dot, -12, out=dot), 12, out=dot)
        cell = doc * STEPS
        cell += ((dot + np.float32(12)) * np.float32(STEPS / 24.001)).astype(np.int64)
        p = 1 / (1 + np.exp(-dot))
        # The map's estimate leans on the mix until it has seen some hundred decisions.
        lean = 0.5 / (hits[: active * STEPS].sum(1) + 120)
        q = p * np.take((0.5 + 120 * lean).astype(np.float32), cell) + np.take((hits[: active * STEPS, 1] * lean).astype(np.float32), cell)
        # What the decision's own bit had: q of a one, 1 - q of a zero.
        q -= one ^ 1
        out[order[:active]] += np.add.reduceat(np.log(np.abs(q, out=q)), stop - take, dtype=np.float64)
        wrong = (one - p) * np.float32(rate)
        for t in range(TABLES):
            np.add.at(weights[t], key, wrong * seen[t])
        hits[: active * STEPS] += np.bincount(2 * cell + one, minlength=2 * active * STEPS).reshape(-1, 2)
        done += span
        active = int(np.searchsorted(-sizes[:active], -done, "left"))
    return out


def by_length(batches, at: int):
    """Slices of rows of like length, so that the rows of a slice are read in step."""
    import pyarrow.compute as pc

    for batch in batches:
        order = pc.sort_indices(pc.fill_null(pc.binary_length(batch.column(at)), 0))
        yield from kernel.slices([batch.take(order)], at, SLICE)


def held_out(id):
    """Rows whose crc32 of the id as text is 1 modulo 5, and those without an id."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 1, F.lit(True))


def pair_counts(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each byte follows each in words and the blank after them: cell 256 * before + byte, before is 0 at a start."""
    pair = low.astype(np.int32)
    pair[1:] += low[:-1].astype(np.int32) << 8
    pair[starts] = low[starts]
    return np.bincount(pair[~kernel.WHITE[low]], minlength=1 << 16) + np.bincount((low[ends - 1].astype(np.int32) << 8) + 32, minlength=1 << 16)


def token_counts(train: DataFrame) -> DataFrame:
    """(pair, h, c) of every distinct training token, and where ``pair`` of every cell of :func:`pair_counts`."""

    def run(batches):
        sums, held, many = np.zeros(1 << 16, np.int64), [], 0

        def put():
            h, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(place, np.concatenate([x for _, x in held])).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), bool)), kernel.signed(h), pa.array(c)], names=["pair", "h", "c"])

        for _, buf, offs in kernel.slices(batches, 0):
            low, starts, ends, found, _, _ = tokens(buf, offs)
            sums += pair_counts(low, starts, ends)
            held.append(np.unique(found, return_counts=True))
            many += len(held[-1][0])
            if many > MERGED:
                yield put()
                many = 0
        if held:
            yield put()
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(own), bool)), pa.array(own), pa.array(sums[own])], names=["pair", "h", "c"])

    return train.mapInArrow(run, "pair boolean, h long, c long").groupBy("pair", "h").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the commonest tokens, at most ``most``: all those over the least count that keeps to it."""
    steps = counts.where("c > 1").groupBy(F.least("c", F.lit(200_000)).alias("c")).count().orderBy(F.desc("c")).toArrow()
    sums = np.cumsum(steps.column("count").to_numpy())
    over = int((sums <= most).sum())
    least = int(steps.column("c")[over - 1].as_py()) if over else 1 << 60
    got = counts.where(F.col("c") >= least).toArrow()
    return got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()


def score(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = df.sparkSession
    storage.bounded_batches(spark)
    rows = df.select(F.col(id).alias("id"), held_out(F.col(id)).alias("held_out"), F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("rid"), F.col(text).alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    all_counts = storage.written(token_counts(train), "token-counts")
    counts = all_counts.where("not pair").select("h", "c")
    pairs, cells = np.zeros(1 << 16, np.int64), all_counts.where("pair").toArrow()
    pairs[cells.column("h").to_numpy()] = cells.column("c").to_numpy()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    common, times = commonest(counts, COMMON)
    order = np.argsort(common)
    common, times = common[order], times[order]
    top = np.argsort(-times, kind="stable")[: LEXICON + 1]
    top = top[(common[top] != END) & (times[top] >= LEAST)][:LEXICON]
    ends = int(times[common == END].sum()) if len(common) else 0
    lex = spark.sparkContext.broadcast(Lexicon(common[top], times[top], ends, n - ends - int(times[top].sum()), pairs))
    tables = spark.sparkContext.broadcast(stretched(table_counts(train, lex)))
    share = spark.sparkContext.broadcast((Index(common), np.append(times, -1)))
    whole = n + 0.5 * (v + 1)

    def logs(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / whole)

    def lookup(h: np.ndarray) -> np.ndarray:
        """Counts of common tokens, -1 for others."""
        index, c = share.value
        at, known = index.find(h)
        return np.where(known, c[at], -1)

    def rare(batches):
        for part, buf, offs in kernel.slices(batches, 1):
            _, _, _, h, _, first = tokens(buf, offs)
            own = lookup(h) < 0
            h, row = h[own], kernel.row_of(first)[own]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(new)
            lead = np.ones(len(head), bool)
            lead[1:] = row[head[1:]] != row[head[:-1]]
            rid = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(rid[row[head]]), kernel.signed(h[head]), pa.array(np.diff(np.append(head, len(h))).astype(np.int32)), pa.array(lead.astype(np.int32))], names=["rid", "h", "tf", "lead"])

    def scored(batches):
        for part, buf, offs in by_length(batches, 3):
            _, _, _, h, _, first = tokens(buf, offs)
            c = lookup(h)
            base = np.bincount(kernel.row_of(first), np.where(c >= 0, logs(np.maximum(c, 0)), 0), len(offs) - 1)
            total = sum(cost(tables.value, s, START[k], RATE[k]) for k, s in enumerate(decisions(lex.value, buf, offs)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(first)), pa.array(kernel.per_row(c > 0, first)), pa.array(base), pa.array(total / np.log(10)), pa.array(np.diff(offs))], names=["id", "held_out", "rid", "n_tokens", "known", "base", "score", "n_bytes"])

    kind = dict(rows.dtypes)["id"]
    main = rows.mapInArrow(scored, f"id {kind}, held_out boolean, rid long, n_tokens long, known long, base double, score double, n_bytes long")
    others = rows.select("rid", "text").mapInArrow(rare, "rid long, h long, tf int, lead int").join(counts, "h", "left")
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(whole)))
    # Rows that repeat give the same sums again: lead counts them.
    more = others.groupBy("rid").agg((F.sum(F.col("tf") * term) / F.sum("lead")).alias("rare_base"), (F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)) / F.sum("lead")).cast("long").alias("rare_known"))
    return main.join(more, "rid", "left").select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
