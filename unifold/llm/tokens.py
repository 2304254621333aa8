"""Tokenizer operators: BPE encoding by tree concatenation, and token counts by a digest cache.

Empty inputs: a null text counts as empty (no ids, decoded text empty). Null or
repeated ids and any further columns are left alone: rows map one to one.
"""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bpe, kernel, storage

LEAF = 32 << 10  #: bytes of text that are encoded at once; longer texts are halved
LONG = 4 << 10  #: bytes of a word from which its pieces are encoded by halves too
WINDOW = 128  #: bytes on each side of a join in the first window
SLICE = 4 << 20  #: bytes of text that a worker counts at once
ENCODED = 1 << 20  #: bytes of text that a worker encodes at once: ids and decoded text take several times as much
CACHED = 100_000  #: unusual words whose ids a worker keeps
WORD_STEPS = ["NFC", r"\s+", "Lowercase", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel"]


class Encoded:
    """Units (pieces of words) of some rows of text, in order, with their ids."""

    def __init__(self, starts, ends, ids, first, rows):
        self.starts, self.ends, self.ids, self.first, self.rows = starts, ends, ids, first, rows

    def words_of(self, row: int) -> list[tuple[int, int, int, int]]:
        """(start, end, first id, last id + 1) of the row's units, places within the buffer."""
        a, b = self.rows[row], self.rows[row + 1]
        return list(zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), self.first[a:b].tolist(), self.first[a + 1 : b + 1].tolist(), strict=True))


class Encoder:
    """Encodes texts as the tokenizers library does, by tree concatenation.

    For BPE tokenizers with byte-level pieces that drop white space. A text of
    over ``leaf`` bytes is cut into halves again and again, anywhere between two
    characters; all leaves are encoded side by side. Then windows around each
    join are encoded again, twice as wide each time, until a unit of the window
    agrees with the left half and a later one with the right half, in place and
    ids; there the three are spliced. Words over ``long`` bytes without white
    space go through the same tree on their merges (:meth:`piece`).
    """

    def __init__(self, text: str, leaf: int = LEAF, long: int = LONG, window: int = WINDOW):
        spec = bpe.parse(text)
        if spec["model"]["type"] != "BPE" or bpe.steps(spec) != WORD_STEPS:
            raise ValueError(f"the encoder is for BPE tokenizers with the steps {WORD_STEPS}")
        self.leaf, self.long, self.window = max(leaf, 8), max(long, 8), max(window, 4)
        self.full = bpe.tokenizer(text)
        self.merges = bpe.Merges(spec["model"])
        self.special, self.split = bpe.special_pattern(spec)
        self.suffix = self.merges.suffix
        self.odd: dict[bytes, np.ndarray] = {}
        table = {v: k for k, v in self.full.get_vocab(with_added_tokens=True).items()}
        shown = [table.get(i, "").encode() + b" " for i in range(max(table) + 1)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.cumsum([0, *map(len, shown)])

    # -- words that take the library's steps --------------------------------------

    def odd_word(self, word: bytes) -> np.ndarray:
        got = self.odd.get(word)
        if got is None:
            if len(self.odd) > CACHED:
                self.odd.clear()
            text = word.decode()
            ids = self.full.encode(text, add_special_tokens=False).ids if len(word) <= self.long else self.long_word(text)
            got = np.array(ids, np.int32)
            if len(word) <= self.long:
                self.odd[word] = got
        return got

    def long_word(self, word: str) -> list[int]:
        ids: list[int] = []
        for part in self.split.split(word) if self.split else [word]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(part)):
                    ids += self.piece(piece)
        return ids

    def merged(self, symbols: np.ndarray) -> np.ndarray:
        return self.merges.apply(symbols.copy(), np.array([0, len(symbols)]))[0]

    def piece(self, text: str) -> list[int]:
        """Ids of one unsplit piece: leaves in parallel, then windows around each join.

        Splicing is exact: a sequence of tokens is the encoding of its text if
        each adjacent pair is, and every pair of the result lies within the left
        half, the window or the right half, as these share tokens at each seam.
        """
        places = {c: b for b, c in enumerate(bpe.BYTE_CHARS)}
        raw = np.fromiter((places[c] for c in text), np.uint8, len(text))
        symbols = self.merges.first[raw]
        symbols[-1:] = self.merges.last[raw[-1:]]
        if len(symbols) <= self.long:
            return self.merged(symbols).tolist()
        cuts = [*range(0, len(symbols), self.long), len(symbols)]
        with ThreadPoolExecutor(2) as pool:
            parts = list(pool.map(lambda i: self.merged(symbols[cuts[i] : cuts[i + 1]]), range(len(cuts) - 1)))
        lows = cuts[:-1]
        while len(parts) > 1:
            parts = [self.seam(symbols, lows[i], parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            lows = lows[::2]
        return parts[0].tolist()

    def width(self, ids: np.ndarray) -> int:
        """The bytes that tokens of a piece stand for."""
        names = [bytes(self.shown[self.shown_at[i] : self.shown_at[i + 1] - 1]).decode() for i in ids.tolist()]
        return sum(len(n.removesuffix(self.suffix)) if self.suffix else len(n) for n in names)

    def seam(self, symbols: np.ndarray, low: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        reach, middle = 4, low + self.width(left)
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            got = self.merged(symbols[middle - self.width(left[i:]) : middle + self.width(right[:j])])
            if (i == 0 or np.array_equal(got[:2], left[i : i + 2])) and (j == len(right) or np.array_equal(got[-2:], right[j - 2 : j])):
                return np.concatenate([left[:i], got, right[j:]])
            reach *= 2

    # -- rows of text ---------------------------------------------------------------

    def rows(self, buf: np.ndarray, offs: np.ndarray) -> Encoded:
        """Units and ids of each row, on their own."""
        low, cls, odd = bpe.lowered(buf), bpe.CLASS[buf], bpe.odd_bytes(buf)
        starts, ends, _ = kernel.words(buf, offs)
        if not len(starts):
            z = np.zeros(0, np.int64)
            return Encoded(z, z, z.astype(np.int32), np.zeros(1, np.int64), np.zeros(len(offs), np.int64))
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(odd, out=sums[1:])
        strange = (sums[ends] > sums[starts]) | (ends - starts > self.long)
        begin = np.zeros(len(buf) + 1, bool)
        begin[1:-1] = (cls[1:] != cls[:-1]) | (cls[1:] == bpe.DIGIT)
        begin[:-1] &= cls != bpe.BLANK
        for a, b in zip(starts[strange].tolist(), ends[strange].tolist(), strict=True):
            begin[a:b] = False
        begin[starts] = True
        at = np.flatnonzero(begin)
        word = np.searchsorted(starts, at, "right") - 1
        till = np.minimum(np.append(at[1:], len(buf)), ends[word])
        own = strange[word]
        plain = np.flatnonzero(~own)
        index, inverse = bpe.distinct(kernel.span_hashes(low, at[plain], till[plain]))
        ids, first = self.merges.apply(*self.merges.symbols(low, at[plain][index], till[plain][index]))
        table = np.empty(len(at), np.int64)
        table[plain] = inverse
        if own.any():
            more = [self.odd_word(bytes(buf[a:b])) for a, b in zip(at[own].tolist(), till[own].tolist(), strict=True)]
            table[own] = len(first) - 1 + np.arange(len(more))
            first = np.concatenate([first, first[-1] + np.cumsum([len(x) for x in more])])
            ids = np.concatenate([ids, *more])
        sizes = np.diff(first)[table]
        out = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=out[1:])
        flat = ids[np.repeat(first[table] - out[:-1], sizes) + np.arange(out[-1])]
        return Encoded(at, till, flat, out, np.searchsorted(at, offs))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        cuts, owner = [0], []
        for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            parts = 1
            while (b - a) / parts > self.leaf:
                parts *= 2
            for k in range(1, parts):
                c = a + (b - a) * k // parts
                while c < b and buf[c] & 0xC0 == 0x80:
                    c += 1
                if cuts[-1] < c < b:
                    cuts.append(c)
                    owner.append(r)
            cuts.append(b)
            owner.append(r)
        got = self.rows(buf, np.array(cuts))
        pieces: list[list[np.ndarray]] = [[] for _ in range(len(offs) - 1)]
        by_row: dict[int, list[int]] = {}
        for k, r in enumerate(owner):
            by_row.setdefault(r, []).append(k)
        for r, leaves in by_row.items():
            if len(leaves) == 1:
                pieces[r].append(got.ids[got.first[got.rows[leaves[0]]] : got.first[got.rows[leaves[0] + 1]]])
        halved = {r: leaves for r, leaves in by_row.items() if len(leaves) > 1}
        for r, leaves in halved.items():
            pieces[r] = self.joined(buf, int(offs[r]), int(offs[r + 1]), [cuts[k] for k in leaves[1:]], [[(a, b, got.ids[i:j].tobytes()) for a, b, i, j in got.words_of(k)] for k in leaves])
        return [np.concatenate(x) if len(x) != 1 else x[0] for x in pieces]

    def joined(self, buf: np.ndarray, lo: int, hi: int, joins: list[int], runs: list[list]) -> list[np.ndarray]:
        while len(runs) > 1:
            runs = [self.join(buf, lo, hi, joins[i], runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
            joins = joins[1::2]
        return [np.frombuffer(b"".join([x for _, _, x in runs[0]]), np.int32)]

    def join(self, buf: np.ndarray, lo: int, hi: int, mid: int, left: list, right: list) -> list:
        """Splice two encoded halves where a window over their join agrees with both."""
        reach = self.window
        while True:
            a, b = max(lo, mid - reach), min(hi, mid + reach)
            while a > lo and buf[a] & 0xC0 == 0x80:
                a -= 1
            while b < hi and buf[b] & 0xC0 == 0x80:
                b += 1
            e = self.rows(buf[a:b], np.array([0, b - a]))
            got = [(a + x, a + y, e.ids[i:j].tobytes()) for x, y, i, j in e.words_of(0)]
            # A word may begin before the window or go on behind it: only units beyond a gap count.
            gaps = [k for k in range(1, len(got)) if got[k][0] > got[k - 1][1]]
            before = {x: i for i, x in enumerate(left) if x[0] >= a}
            after = {x: i for i, x in enumerate(right) if x[1] <= b}
            head, tail = (0, []) if a == lo else (None, None), (len(got), []) if b == hi else (None, None)
            if a > lo:
                k = next((k for k in gaps if got[k] in before), None)
                head = (None, None) if k is None else (k, left[: before[got[k]]])
            if b < hi:
                k = next((k for k in reversed(gaps) if got[k - 1] in after), None)
                tail = (None, None) if k is None else (k, right[after[got[k - 1]] + 1 :])
            if head[0] is not None and tail[0] is not None and head[0] <= tail[0]:
                return head[1] + got[head[0] : tail[0]] + tail[1]
            reach *= 2

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Each row's decoded text: its tokens joined by one space."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        sizes = np.diff(self.shown_at)[flat]
        ends = np.cumsum(sizes)
        text = self.shown[np.repeat(self.shown_at[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [text[a : b - 1] if b > a else b"" for a, b in zip(stops, stops[1:], strict=False)]


_HELD: dict[str, object] = {}


def held(kind, text: str, *args):
    """One encoder per Python worker and tokenizer."""
    key = f"{kind.__name__}{hashlib.sha256(text.encode()).hexdigest()}{args}"
    if key not in _HELD:
        _HELD[key] = kind(text, *args)
    return _HELD[key]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """Append ids (binary, little-endian unsigned 32-bit) and the decoded text to every row of ``df``.

    Map-only: no shuffle. ``ids`` and ``decoded`` must not be columns of ``df``.
    Null texts give empty ids and text.
    """
    spark = df.sparkSession
    storage.bounded_batches(spark, 4 << 20)
    spec = spark.sparkContext.broadcast(bpe.load(path))
    if {ids, decoded} & set(df.columns):
        raise ValueError(f"{ids} and {decoded} are columns of the input already")
    at = df.columns.index(text)

    def run(batches):
        e = held(Encoder, spec.value, leaf)
        for rows, buf, offs in kernel.slices(batches, at, ENCODED):
            out = e.encode(buf, offs)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x.astype("<u4").tobytes() for x in out], pa.binary()), pa.array(e.decode(out), pa.binary()).cast(pa.string())], names=[*rows.schema.names, ids, decoded])

    return df.mapInArrow(run, StructType(list(df.schema.fields)).add(ids, "binary").add(decoded, "string"))


# -- counts ---------------------------------------------------------------------

#: White space beyond ASCII, and controls that libraries class differently: such texts are encoded whole.
WIDE = re.compile("[\x1c-\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
MAYBE_WIDE = np.zeros(256, bool)
MAYBE_WIDE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Counter:
    """Token counts of a byte-level BPE tokenizer that splits at words, digits and symbols, with one space before."""

    def __init__(self, text: str):
        spec = bpe.parse(text)
        step = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex"):
            raise ValueError("the counter is for byte-level BPE tokenizers with the usual split pattern and no prefix")
        self.full = bpe.tokenizer(text)
        self.merges = bpe.Merges(spec["model"])
        self.odd: dict[bytes, int] = {}

    def odd_unit(self, unit: bytes) -> int:
        got = self.odd.get(unit)
        if got is None:
            if len(self.odd) > CACHED:
                self.odd.clear()
            got = self.odd[unit] = len(self.full.encode(unit.decode(), add_special_tokens=False).ids)
        return got

    def count(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row. A unit is a run of white space but its last, that last unless a space, or a run of
        one class of characters with the space before; an odd word counts together with the white space before it."""
        if not len(buf):
            return np.zeros(len(offs) - 1, np.int64)
        cls = bpe.CLASS[buf]
        blank = cls == bpe.BLANK
        starts, ends, _ = kernel.words(buf, offs)
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        begin = edge[:-1].copy()
        begin[1:] |= (cls[1:] != cls[:-1]) & ~(~blank[1:] & (buf[:-1] == 32))
        begin[:-1] |= blank[:-1] & ~blank[1:] & ~edge[1:-1]
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(bpe.odd_bytes(buf), out=sums[1:])
        strange = np.flatnonzero(sums[ends] > sums[starts])
        own = np.zeros(len(buf) + 1, bool)
        if len(strange):
            row = np.searchsorted(offs, starts[strange], "right") - 1
            from_ = np.maximum(np.where(strange > 0, ends[strange - 1], 0), offs[row])
            for a, b in zip(from_.tolist(), ends[strange].tolist(), strict=True):
                begin[a:b] = False
            begin[from_] = True
            own[from_] = True
        at = np.flatnonzero(begin)
        till = np.append(at[1:], len(buf))
        counts = np.empty(len(at), np.int64)
        odd = own[at]
        plain = np.flatnonzero(~odd)
        index, inverse = bpe.distinct(kernel.span_hashes(buf, at[plain], till[plain]))
        _, first = self.merges.apply(*self.merges.symbols(buf, at[plain][index], till[plain][index]))
        counts[plain] = np.diff(first)[inverse] if len(plain) else 0
        counts[odd] = [self.odd_unit(bytes(buf[a:b])) for a, b in zip(at[odd].tolist(), till[odd].tolist(), strict=True)]
        out = kernel.per_row(counts, np.searchsorted(at, offs))
        maybe = np.unique(np.searchsorted(offs, np.flatnonzero(MAYBE_WIDE[buf]), "right") - 1)
        for r in maybe.tolist():
            text = bytes(buf[offs[r] : offs[r + 1]]).decode()
            if WIDE.search(text):
                out[r] = len(self.full.encode(text, add_special_tokens=False).ids)
        return out


CACHE = "digest binary, version string, n_tokens long"


def version_of(path: str) -> str:
    return hashlib.sha256(bpe.load(path).encode()).hexdigest()


def count_tokens(df: DataFrame, path: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: id, n_bytes and n_tokens, by way of a cache of counts.

    ``cache`` is a folder of Parquet files (digest, version, n_tokens) on any
    store Spark writes to. Texts are keyed by the SHA-256 of their UTF-8 bytes
    and the tokenizer by that of its file; each distinct text that the cache
    lacks is encoded once and its count appended. Null texts count as empty.
    Repeated rows give repeated rows.
    """
    spark = df.sparkSession
    storage.bounded_batches(spark)
    version = version_of(path)
    spec = spark.sparkContext.broadcast(bpe.load(path))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(F.col(id), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("digest"))

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def run(batches):
        c = held(Counter, spec.value)
        for rows, buf, offs in kernel.slices(batches, 1, SLICE):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([version] * rows.num_rows), pa.array(c.count(buf, offs))], names=["digest", "version", "n_tokens"])

    missing = keyed.select("digest", "text")
    if exists(spark, cache):
        missing = missing.join(stored(), "digest", "left_anti")
    missing.dropDuplicates(["digest"]).mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    return keyed.select(F.col(id), F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(stored(), "digest").drop("digest")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# -- queries ----------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    df = encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return df.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    df = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), storage.new_path(spark, "token-counts"))
    return df.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
