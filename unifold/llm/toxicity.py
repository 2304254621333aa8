"""Toxicity: Levenshtein automata intersected with a lexicon trie, weighed by context.

1. A lexicon is learned from the labelled training rows: whole words and word
   stems (prefixes) whose documents are nearly all toxic.
2. The trie of the lexicon and the Levenshtein automaton of one edit are
   intersected and made deterministic: one table state x letter -> state, run
   over all words of a batch at once. Whole words of 5 letters or more are found
   with one edit too; stems match at the start of words.
3. Each hit is placed in its context: within quotation marks on its line or not,
   and with words of address (you) near it or not.
4. A logistic model on these counts, fitted on at most ``fit_rows`` labelled
   rows, gives the score.

Empty inputs: null texts count as empty and get a score like any other. Rows
without an id are never learned from and count as held out. Labels with null
toxic are ignored. Repeated rows give repeated rows. Without toxic labels the
lexicon is empty and every score is the model's base rate; without labels all are low.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, storage

STEMS = (4, 5, 6)  #: letters of a stem
FUZZY = 5  #: letters from which a whole word is found with one edit
QUOTES = np.array([ord(c) for c in "\"«»“”„"], np.uint32)
ADDRESS = ("you", "your", "youre", "yourself", "du", "dich", "ihr", "tu", "toi", "vous", "usted", "eres", "sie")
NEAR = 6  #: words on each side of a hit that count as its context
BROADCAST = 4_000_000  #: labels that may be broadcast (under 100 MB); beyond, a shuffled join
NAMES = ("whole", "stem", "fuzzy", "quoted", "addressed")


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a batch and each row's first (n rows + 1)."""
    buf, offs = kernel.texts(pc.utf8_lower(column))
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offs]


def runs(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words: runs of letters (a-z and all from U+00C0 on)."""
    is_letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2070)))
    return kernel.spans(is_letter, first)


def spelled(points: np.ndarray, a: int, b: int) -> str:
    return points[a:b].astype("<u4").tobytes().decode("utf-32-le")


def term_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word number, letters) of each word and of its stems; 0 letters for the whole word."""
    items = kernel.mix(points.astype(np.uint64) + np.uint64(0x51ED27))
    size = ends - starts
    out = [(kernel.gram_hashes(items, starts, size, 2), np.arange(len(starts)), np.zeros(len(starts), np.int64))]
    for k in STEMS:
        w = np.flatnonzero(size > k)
        out.append((kernel.gram_hashes(items, starts[w], np.full(len(w), k), 0), w, np.full(len(w), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parts(batches, at: int):
    """Slices of a batch by their text's size, with lower-cased code points."""
    for rows, _, _ in kernel.slices(batches, at, 1 << 20):
        points, first = letters(rows.column(at))
        starts, ends = runs(points, first)
        yield rows, points, first, starts, ends, np.searchsorted(starts, first)


def document_counts(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, one place of each, and in how many rows each is found."""
    order = np.lexsort((row, hashes))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, place = h[new], order[new]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[head], place[head], np.diff(np.append(head, len(h)))


def lexicon(train: DataFrame, least: float = 0.004, least_rows: int = 4, purity: float = 0.8) -> list[tuple[str, int]]:
    """(term, letters of a stem or 0) from rows (text, toxic boolean).

    A term must be in ``least`` of the toxic rows (and in ``least_rows``), which
    bounds how many there can be, and ``purity`` of the rows that have it, after
    smoothing, must be toxic. Toxic rows are scanned for candidates first; the
    others are counted against these candidates only.
    """
    spark = train.sparkSession

    def seen(batches):
        for _, points, first, starts, ends, words in parts(batches, 0):
            h, w, k = term_keys(points, starts, ends)
            h, place, n = document_counts(h, kernel.row_of(words)[w])
            k, a = k[place], starts[w[place]]
            b = np.where(k > 0, a + k, ends[w[place]])
            yield pa.RecordBatch.from_arrays([kernel.signed(h), pa.array([spelled(points, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string()), pa.array(k), pa.array(n)], names=["h", "term", "stem", "n"])

    toxic, clean = train.where("toxic").select("text"), train.where(~F.col("toxic")).select("text")
    total = train.select("toxic").where("toxic").count()
    if not total:
        return []
    floor = max(least_rows, least * total)
    found = toxic.mapInArrow(seen, "h long, term string, stem long, n long").groupBy("h").agg(F.min("term").alias("term"), F.min("stem").alias("stem"), F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow()
    if not found.num_rows:
        return []
    keys = found.column("h").to_numpy()
    order = np.argsort(keys.view(np.uint64))
    share = spark.sparkContext.broadcast(keys.view(np.uint64)[order])

    def against(batches):
        known = share.value
        sums = np.zeros(len(known), np.int64)
        for _, points, _, starts, ends, words in parts(batches, 0):
            h, w, _ = term_keys(points, starts, ends)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            _, place, n = document_counts(at[hit].astype(np.uint64), kernel.row_of(words)[w[hit]])
            sums[at[hit][place]] += n
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["i", "n"])

    other = np.zeros(len(keys), np.int64)
    got = clean.mapInArrow(against, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    other[got.column("i").to_numpy()] = got.column("n").to_numpy()
    bad = found.column("n").to_numpy()[order]
    pure = bad >= purity * (bad + other + 1)
    terms = [(found.column("term")[int(i)].as_py(), int(found.column("stem")[int(i)].as_py()), int(n)) for i, n, p in zip(order, bad, pure, strict=True) if p]
    return pruned(terms)


def pruned(terms: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    """Drop terms that a kept stem covers, and stems that stand for one whole word only."""
    whole = {t: n for t, k, n in terms if not k}
    stems = sorted(((t, n) for t, k, n in terms if k), key=lambda x: (len(x[0]), x[0]))
    kept: list[str] = []
    for t, n in stems:
        if any(t.startswith(s) for s in kept):
            continue
        if any(w.startswith(t) and m >= 0.9 * n for w, m in whole.items()):
            continue
        kept.append(t)
    return sorted([(s, len(s)) for s in kept] + [(w, 0) for w in whole if not any(w.startswith(s) and w != s for s in kept)])


class Automaton:
    """The lexicon's trie intersected with the Levenshtein automaton of one edit, as one deterministic table."""

    MISS, EXACT, STEM, NEAR = 0, 1, 2, 3

    def __init__(self, terms: list[tuple[str, int]]):
        self.alphabet = sorted({c for t, _ in terms for c in t})
        code = {c: i + 1 for i, c in enumerate(self.alphabet)}
        child: list[dict[int, int]] = [{}]
        end: list[int] = [0]  # 1: whole word, 2: stem
        fuzzy: list[bool] = [False]  # a fuzzy word goes through here
        for t, stem in terms:
            node = 0
            fuzzy[0] |= not stem and len(t) >= FUZZY
            for c in t:
                if code[c] not in child[node]:
                    child[node][code[c]] = len(child)
                    child.append({})
                    end.append(0)
                    fuzzy.append(False)
                node = child[node][code[c]]
                if not stem and len(t) >= FUZZY:
                    fuzzy[node] = True
            end[node] = max(end[node], 2 if stem else 1)
        long = {node for node, depth in self._depths(child).items() if end[node] == 1 and depth >= FUZZY}

        def closed(pairs: set) -> frozenset:
            # An unused edit may skip a letter of the term.
            return frozenset(pairs | {(c, 1) for n, e in pairs if e == 0 for c in child[n].values() if fuzzy[c]})

        n_codes = len(self.alphabet) + 1
        done = frozenset({(-1, 0)})
        index = {frozenset(): 0, closed({(0, 0)}): 1, done: 2}
        todo, table, out = [*index], [], []
        for state in todo:
            if state in (frozenset(), done):
                row = [index[state]] * n_codes
            else:
                row = []
                for c in range(n_codes):
                    nxt = set()
                    for n, e in state:
                        if c in child[n]:
                            nxt.add((child[n][c], e))
                        if e == 0:
                            nxt.add((n, 1)) if fuzzy[n] else None
                            nxt |= {(m, 1) for m in child[n].values() if fuzzy[m]}
                    to = done if any(end[n] == 2 and e == 0 for n, e in nxt) else closed({(n, e) for n, e in nxt if e == 0 or (n, 0) not in nxt})
                    if to not in index:
                        index[to] = len(todo)
                        todo.append(to)
                    row.append(index[to])
            table.append(row)
            out.append(self.STEM if state == done else self.EXACT if any(n >= 0 and end[n] == 1 and e == 0 for n, e in state) else self.NEAR if any(n in long for n, _ in state) else self.MISS)
        self.table, self.out = np.array(table, np.int32), np.array(out, np.int8)
        self.code = np.zeros(0x250, np.int32)
        self.rest = {}
        for c, i in code.items():
            if ord(c) < len(self.code):
                self.code[ord(c)] = i
            else:
                self.rest[ord(c)] = i

    @staticmethod
    def _depths(child: list[dict[int, int]]) -> dict[int, int]:
        depth, todo = {0: 0}, [0]
        for n in todo:
            for m in child[n].values():
                depth[m] = depth[n] + 1
                todo.append(m)
        return depth

    def codes(self, points: np.ndarray) -> np.ndarray:
        out = self.code[np.minimum(points, len(self.code) - 1)]
        out[points >= len(self.code)] = 0
        for p, i in self.rest.items():
            out[points == p] = i
        return out

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """MISS, EXACT, STEM or NEAR for each word."""
        codes, out = self.codes(points), np.zeros(len(starts), np.int8)
        alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        while len(alive):
            state = self.table[state, codes[at]]
            at = at + 1
            over = (at == ends[alive]) | (state == 2)
            out[alive[over]] = self.out[state[over]]
            go = ~over & (state != 0)
            alive, state, at = alive[go], state[go], at[go]
        return out


def describe(auto: Automaton, points, first, starts, ends, words) -> np.ndarray:
    """Per row: counts of hits (NAMES) and words."""
    n = len(first) - 1
    out = np.zeros((n, len(NAMES) + 1))
    out[:, -1] = np.diff(words)
    kind = auto.match(points, starts, ends)
    hit = np.flatnonzero(kind)
    if not len(hit):
        return out
    row = np.searchsorted(words, hit, "right") - 1
    marks = np.zeros(len(points) + 1, np.int64)
    np.cumsum(np.isin(points, QUOTES), out=marks[1:])
    lines = np.union1d(first[:-1], np.flatnonzero(points == 10) + 1)
    line = lines[np.searchsorted(lines, starts[hit], "right") - 1]
    quoted = (marks[starts[hit]] - marks[line]) % 2 == 1
    address = np.zeros(len(starts) + 1, np.int64)
    items = kernel.mix(points.astype(np.uint64) + np.uint64(0x51ED27))
    known = np.array([_whole(w) for w in ADDRESS], np.uint64)
    np.cumsum(np.isin(kernel.gram_hashes(items, starts, ends - starts, 2), known), out=address[1:])
    near = address[np.minimum(hit + NEAR + 1, words[row + 1])] > address[np.maximum(hit - NEAR, words[row])]
    for j, which in enumerate((kind[hit] == auto.EXACT, kind[hit] == auto.STEM, kind[hit] == auto.NEAR)):
        out[:, j] = np.bincount(row[which & ~quoted], minlength=n)
    out[:, 3] = np.bincount(row[quoted], minlength=n)
    out[:, 4] = np.bincount(row[near & ~quoted], minlength=n)
    return out


def _whole(word: str) -> np.uint64:
    points = np.array([ord(c) for c in word], np.uint32)
    return kernel.gram_hashes(kernel.mix(points.astype(np.uint64) + np.uint64(0x51ED27)), np.array([0]), np.array([len(points)]), 2)[0]


def inputs(x: np.ndarray) -> np.ndarray:
    """The model's inputs: a constant, each kind of hit as presence and logarithm, and hits per 100 words."""
    hits = x[:, :-1]
    rate = np.minimum(100 * hits[:, :3].sum(1) / np.maximum(x[:, -1], 1), 10)
    return np.column_stack([np.ones(len(x)), hits > 0, np.log1p(hits), rate])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge penalty (none on the constant). Without rows, nothing is toxic."""
    w = np.zeros(x.shape[1])
    if not len(x):
        w[0] = -5.0
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """A lexicon's automaton and the weights of the counts it gives."""

    def __init__(self, auto: Automaton, weights: np.ndarray):
        self.auto, self.weights = auto, weights

    def scores(self, part) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(describe(self.auto, *part[1:])) @ self.weights, -30, 30)))


def held_out(id):
    """Rows whose crc32 of the id as text is 0 modulo 5, and those without an id."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(True))


def learn(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 50_000) -> Model:
    """A model from the labelled rows of ``df`` that aren't held out.

    The weights are fitted on about ``fit_rows`` labelled rows, those of the
    smallest hashes; the lexicon and its counts use all of them.
    """
    spark = df.sparkSession
    storage.bounded_batches(spark)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg((F.max(label) == 1).alias("toxic"))
    known = storage.written(known, "toxic-labels")
    # Texts stay where they are while the labels are few enough to be sent to them; else they are shuffled once and kept.
    few = known.count() <= BROADCAST
    train = rows.where(~held_out(F.col("id"))).join(F.broadcast(known) if few else known, "id").select("id", "text", "toxic")
    train = train if few else storage.written(train, "toxic-train")
    auto = Automaton(lexicon(train.select("text", "toxic")))
    share = spark.sparkContext.broadcast(auto)

    def counted(batches):
        for part in parts(batches, 0):
            x = describe(share.value, *part[1:])
            yield pa.RecordBatch.from_arrays([part[0].column(1), *(pa.array(c) for c in x.T)], names=["toxic", *NAMES, "words"])

    share_of = fit_rows / max(train.select("id").count(), 1)
    sample = train if share_of >= 1 else train.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share_of * 1_000_000))
    got = sample.select("text", "toxic").mapInArrow(counted, "toxic boolean, " + ", ".join(f"{n} double" for n in (*NAMES, "words"))).toArrow()
    x = np.column_stack([got.column(n).to_numpy() for n in (*NAMES, "words")]) if got.num_rows else np.zeros((0, len(NAMES) + 1))
    return Model(auto, fit(inputs(x), np.asarray(got.column("toxic").to_pylist(), float)))


def score(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 50_000) -> DataFrame:
    """id, held_out, score and predicted for each row of ``df``, by a model learned from its labelled rows."""
    share = df.sparkSession.sparkContext.broadcast(learn(df, labels, id, text, label, fit_rows))

    def scored(batches):
        for part in parts(batches, 2):
            s = share.value.scores(part)
            yield pa.RecordBatch.from_arrays([part[0].column(0), part[0].column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id).alias("id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, f"id {dict(rows.dtypes)['id']}, held_out boolean, score double, predicted int").withColumnRenamed("id", id)


def accepted(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``df``, with all their columns, that the model doesn't call toxic. Map-only."""
    share = df.sparkSession.sparkContext.broadcast(learn(df, labels, id, text, label))
    at = df.columns.index(text)

    def kept(batches):
        for part in parts(batches, at):
            yield part[0].filter(pa.array(share.value.scores(part) < 0.5))

    return df.mapInArrow(kept, df.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
