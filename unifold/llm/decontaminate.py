"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

Texts and items are compared as words in normal form (A-Z lower-cased, ASCII
symbols as blanks). For each item length there are windows of that many words at
every place of every document, cut short at the text's end. A window is contaminated by
an item if a passage there, of any length, has an edit similarity, 1 - distance /
length of the item in words, of at least ``percent``.

1. Windows that cannot be similar are passed over by an exact bound: with k
   edits allowed, an item of n words keeps at least n - q + 1 - k q of its
   q-word sequences, in a passage of up to n + k words; where there are fewer
   sequences of the item set, no window begins.
2. Windows and items are embedded by CGK random walks: at each step the walk
   shows the word it stands on, and a random bit of step and word says whether
   it moves on. Edit distance becomes Hamming distance of the walks.
3. Each of several repetitions samples some steps of its own walk; windows and
   items of one length that agree on the sample are candidates. The number of
   repetitions follows from the target recall, by the rate at which edited items
   (at the threshold) agree with themselves.
4. Candidates are verified by exact edit distance with free ends, against the
   window and k words of the text on both sides of it.

The benchmark is a stated query set: it is read in blocks of bounded size, each
broadcast and run against all documents. There is no shuffle of texts.

Empty inputs: null and empty texts or items match nothing. Repeated documents
and items give repeated matches, but equal (id, item) rows are merged. Null ids
are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, storage
from .lines import WORDY

PERCENT = 80
SAMPLED = 2  #: steps in a sample
TARGET = 0.98  #: recall at the threshold
BLOCK = 5_000  #: items in a block
STEPS = 3  #: steps of a walk for each word


def normal(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row in normal form, and each row's first (n rows + 1)."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    starts, ends = kernel.spans(WORDY[buf], offs)
    return kernel.span_hashes(kernel.LOWER[buf], starts, ends), np.searchsorted(starts, offs)


def edits(n: int, percent: int) -> int:
    return (100 - percent) * n // 100


def sequence_length(n: int, percent: int) -> tuple[int, int]:
    """(q, least number of q-word sequences that a similar window shares), q as long as the bound tells something."""
    for q in (3, 2, 1):
        least = n - q + 1 - edits(n, percent) * q
        if least >= 1:
            return q, least
    return 1, 0


def walk(words: np.ndarray, first: np.ndarray, size: int | np.ndarray, steps: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The words on which CGK walks over ``words[f : f + size]`` stand (0 past the end).

    One walk for each seed, looked at at its own increasing steps:
    (seeds, steps of each, windows).
    """
    place = np.zeros((len(seeds), len(first)), np.int64)
    out = np.zeros((len(seeds), steps.shape[1], len(first)), np.uint64)
    for j in range(int(steps.max()) + 1):
        here = np.where(place < size, words[np.minimum(first[None] + place, len(words) - 1)], np.uint64(0))
        who, which = np.nonzero(steps == j)
        out[who, which] = here[who]
        with np.errstate(over="ignore"):
            salt = (seeds.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15)
        place += (kernel.mix(here ^ salt[:, None]) & np.uint64(1)).astype(np.int64)
    return out


def samples(size: int, repeats: int) -> np.ndarray:
    """The steps that each repetition samples, the same for windows and items."""
    rng = np.random.default_rng(size)
    return np.stack([np.sort(rng.choice(STEPS * size, min(SAMPLED, STEPS * size), replace=False)) for _ in range(repeats)])


def keys(words: np.ndarray, first: np.ndarray, size: int, repeats: int, left: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit key of each window for each repetition: (repeats, windows). ``left``: words from each first on to its text's end."""
    got = walk(words, first, size if left is None else np.minimum(size, left), samples(size, repeats), np.arange(repeats))
    key = np.repeat(np.uint64(size * 4096) + np.arange(repeats).astype(np.uint64)[:, None], len(first), 1)
    for k in range(got.shape[1]):
        key = kernel.mix(key ^ got[:, k])
    return key


def free_distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, start) of the passage of each text that is least edits from the item, then the first such; rows of words."""
    unit = np.int64(texts.shape[1] + 1)
    ramp = np.arange(texts.shape[1] + 1) * unit
    # Distances and starts as one number: distance * unit + start.
    row = np.tile(np.arange(texts.shape[1] + 1, dtype=np.int64), (len(texts), 1))
    for k in range(items.shape[1]):
        best = row + unit
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + unit * (texts != items[:, k : k + 1]))
        row = np.minimum.accumulate(best - ramp, axis=1) + ramp
    low = row.min(1)
    return low // unit, low % unit


def repetitions(items: list[np.ndarray], percent: int, target: float = TARGET, trials: int = 200) -> int:
    """How many repetitions reach the target recall for items edited as much as the threshold allows."""
    rng = np.random.default_rng(7)
    long = [x for x in items if edits(len(x), percent)]
    if not long:
        return 4
    agree = []
    for t in range(trials):
        x = long[int(rng.integers(len(long)))]
        n = len(x)
        y = x.tolist()
        for _ in range(edits(n, percent)):
            i, kind = int(rng.integers(len(y))), int(rng.integers(3))
            if kind == 0:
                y[i] = int(rng.integers(1, 2**62))
            elif kind == 1:
                y.insert(i, int(rng.integers(1, 2**62)))
            elif len(y) > 1:
                del y[i]
        y = np.array((y + [int(v) for v in rng.integers(1, 2**62, n)])[:n], np.uint64)
        both = np.concatenate([x, y])
        a, b = walk(both, np.array([0, n]), n, np.arange(STEPS * n)[None], np.array([t]))[0].T
        agree.append(float((a == b).mean()) ** SAMPLED)
    rate = max(float(np.quantile(agree, 0.1)), 0.02)
    return int(np.clip(np.ceil(np.log(1 - target) / np.log(1 - rate)), 4, 64))


class Items:
    """One block of the benchmark: sequences, keys and words of its items, by length."""

    def __init__(self, ids: list, words: list[np.ndarray], percent: int):
        self.percent = percent
        keep = [k for k, w in enumerate(words) if len(w)]
        self.ids, words = [ids[k] for k in keep], [words[k] for k in keep]
        self.repeats = repetitions(words, percent)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.plan = {}  # by length: q, least count
        shared: dict[int, list[tuple[np.ndarray, int]]] = {1: [], 2: [], 3: []}
        for c, n in enumerate(np.unique(self.sizes).tolist()):
            q, least = sequence_length(n, percent)
            self.plan[n] = q, least, np.uint64(1 << c % 64)
            for k in np.flatnonzero(self.sizes == n):
                shared[q].append((kernel.gram_hashes(words[k], np.arange(n - q + 1), q), 1 << c % 64))
        # Each sequence with the lengths of its items, one bit for a length (bits are shared beyond 64 lengths).
        self.shared = {}
        for q, x in shared.items():
            if x:
                h, bit = np.concatenate([y for y, _ in x]), np.concatenate([np.full(len(y), b, np.uint64) for y, b in x])
                known, inverse = np.unique(h, return_inverse=True)
                bits = np.zeros(len(known), np.uint64)
                np.bitwise_or.at(bits, inverse, bit)
                self.shared[q] = known, bits
        self.table = {}
        for n in self.plan:
            own = np.flatnonzero(self.sizes == n)
            for r, key in enumerate(keys(self.words, self.first[own], n, self.repeats)):
                order = np.argsort(key)
                self.table[n, r] = key[order], own[order]

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, item, distance) of every contaminated window that is found."""
        hits = {}
        for q, (known, bits) in self.shared.items():
            h = kernel.gram_hashes(words, np.arange(max(len(words) - q + 1, 0)), q)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            place = np.flatnonzero(known[at] == h)
            hits[q] = place, bits[at[place]]
        row = kernel.row_of(first)
        found = []
        for n, (q, least, bit) in self.plan.items():
            most, last = edits(n, self.percent), len(words)
            begin = np.arange(last)
            if least:
                place, bits = hits[q]
                own = place[(bits & bit) != 0]
                if len(own) < least:
                    continue
                # Windows around each run of ``least`` hits that fits into one.
                low, high = own[least - 1 :] - (n + most - q), own[: len(own) - least + 1]
                fits = low <= high
                edge = np.zeros(last + 1, np.int64)
                np.add.at(edge, np.clip(low[fits], 0, last), 1)
                np.add.at(edge, np.clip(high[fits] + 1, 0, last), -1)
                begin = np.flatnonzero(np.cumsum(edge[:-1]) > 0) if fits.any() else begin[:0]
            left = first[row[begin] + 1] - begin
            begin, left = begin[left >= n - most], left[left >= n - most]
            if not len(begin):
                continue
            pairs = []
            for r, key in enumerate(keys(words, begin, n, self.repeats, left)):
                known, own = self.table[n, r]
                lo, hi = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                some = np.flatnonzero(hi > lo)
                size = (hi - lo)[some]
                stop = np.cumsum(size)
                item = own[np.repeat(lo[some] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
                pairs.append(np.repeat(some, size) * len(self.ids) + item)
            both = np.unique(np.concatenate(pairs))
            window, item = begin[both // len(self.ids)], both % len(self.ids)
            around = np.arange(-most, n + most)
            step = max(1, 10_000_000 // (n * len(around)))
            for lo in range(0, len(both), step):
                w, i = window[lo : lo + step], item[lo : lo + step]
                at = w[:, None] + around
                inside = (at >= first[row[w]][:, None]) & (at < first[row[w] + 1][:, None])
                a = np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(0))
                b = self.words[self.first[i][:, None] + np.arange(n)]
                # Words of the item that the text around the window lacks all need an edit.
                close = (b[:, :, None] == a[:, None]).any(2).sum(1) >= n - most
                w, i = w[close], i[close]
                d, start = free_distances(b[close], a[close])
                ok = d <= most
                place = np.maximum(w - most + start - first[row[w]], 0)
                found.append(np.stack([row[w[ok]], place[ok], i[ok], d[ok]]))
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 4


def contaminated(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, item, start, n_words, distance, similarity): the best passage for each document and item that match.

    ``start`` is the passage's first word, counted in normal form, ``n_words`` the
    item's length; best is the least distance, then the least start.
    """
    spark = df.sparkSession
    storage.bounded_batches(spark)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    # Items of equal text are searched for once, under a hash of their text.
    items = benchmark.select(F.col(item).alias("item"), F.xxhash64(F.col(item_text)).alias("key"), F.col(item_text).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, key long, start long, n_words long, distance long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items.select("key", "text").dropDuplicates(["key"])):
        share = spark.sparkContext.broadcast(Items(*block, percent))

        def run(batches, share=share):
            known = share.value
            keys = np.array(known.ids, np.int64)
            for part, buf, offs in kernel.slices(batches, 1):
                row, place, which, d = known.search(*normal(buf, offs))
                order = np.lexsort((place, d, which, row))
                row, place, which, d = (x[order] for x in (row, place, which, d))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (which[1:] != which[:-1])
                row, place, which, d = (x[new] for x in (row, place, which, d))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(keys[which]), pa.array(place), pa.array(known.sizes[which]), pa.array(d)], names=["id", "key", "start", "n_words", "distance"])

        out = out.union(rows.mapInArrow(run, schema))
    best = out.groupBy("id", "key").agg(F.min(F.struct("distance", "start", "n_words")).alias("b"))
    named = best.join(items.select("key", "item").distinct(), "key")
    return named.select(F.col("id").alias(id), F.col("item").alias(item), "b.start", "b.n_words", "b.distance", (1 - F.col("b.distance") / F.col("b.n_words")).alias("similarity"))


def clean(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` without a benchmark passage, told apart by a hash of id and text, so that null and repeated ids do no harm."""
    rid = F.xxhash64(F.col(id).cast("string"), F.col(text))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), rid.alias("rid"), F.col(text).alias("text"))
    found = contaminated(rows.select("rid", "text"), benchmark, "rid", "text", item, item_text, percent)
    gone = storage.written(found.select("rid").distinct(), "contaminated")
    return rows.join(gone, "rid", "left_anti").select("row.*")


def blocks(items: DataFrame):
    """(keys, word hashes) of up to BLOCK items at a time, streamed partition by partition."""
    ids, texts = [], []
    for r in items.toLocalIterator():
        ids.append(r["key"])
        texts.append((r["text"] or "").encode())
        if len(ids) == BLOCK:
            yield ids, _words(texts)
            ids, texts = [], []
    if ids:
        yield ids, _words(texts)


def _words(texts: list[bytes]) -> list[np.ndarray]:
    words, first = normal(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    return [words[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
