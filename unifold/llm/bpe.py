"""Byte-pair merges over whole batches of pieces, as NumPy array operations."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import kernel

NONE = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    """The character that byte-level tokenizers show for each byte: itself where it prints, else 256 upwards."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def load(path: str) -> str:
    """A tokenizer file's JSON, read by the driver and broadcast (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_padding()
    t.no_truncation()
    return t


def steps(spec: dict) -> list[str]:
    """The kinds or patterns of a tokenizer's normalizing and splitting steps."""
    both = []
    for x in (spec.get("normalizer"), spec.get("pre_tokenizer")):
        both += x.get("normalizers") or x.get("pretokenizers") or [x] if x else []
    return [x.get("pattern", {}).get("Regex", x["type"]) for x in both]


class Merges:
    """A tokenizer's merge table; ``apply`` merges many pieces at once.

    Each round joins, in every piece, all leftmost occurrences of the piece's
    best pair, until none is left. Pairs are looked up in an open-addressing
    table. Work per round is in proportion to the symbols of unfinished pieces.
    """

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in BYTE_CHARS], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in BYTE_CHARS], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * 65536 + vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if max(vocab.values()) > 65535:
            raise ValueError("ids over 65535")
        self.bits = 19
        size = 1 << self.bits
        self.keys = np.full(size, 2**63, np.uint64)
        self.rank = np.full(size, NONE, np.int32)
        self.made = np.zeros(size, np.int32)
        at = self.slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # one key per slot and round
            free = self.keys[at[todo]] == U63
            _, one = np.unique(at[todo], return_index=True)
            put = np.zeros(len(todo), bool)
            put[one] = True
            put &= free
            i = todo[put]
            self.keys[at[i]], self.rank[at[i]], self.made[at[i]] = keys[i], i, made[i]
            todo = todo[~put]
            at[todo] = (at[todo] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The table slot of each pair, or -1."""
        keys = (a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)
        at = self.slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        todo = np.flatnonzero((held != keys) & (held != U63))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (held != U63)]
        return out

    def symbols(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's bytes as symbols, and the pieces' first positions (n + 1)."""
        first = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=first[1:])
        at = np.repeat(starts - first[:-1], ends - starts) + np.arange(first[-1])
        sym = self.first[buf[at]]
        if len(starts):
            sym[first[1:] - 1] = self.last[buf[ends - 1]]
        return sym, first

    def apply(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols (ids) of all pieces and the pieces' first positions. Pieces aren't empty."""
        n = len(first) - 1
        if not n:
            return sym, first
        which, out = np.arange(n), []
        slot = np.full(len(sym), -1, np.int64)
        slot[:-1] = self.find(sym[:-1], sym[1:]) if len(sym) > 1 else slot[:-1]
        slot[first[1:] - 1] = -1
        while True:
            rank = self.rank[slot]  # slot -1 is the last slot: masked below
            rank[slot < 0] = NONE
            best = np.minimum.reduceat(rank, first[:-1])
            done = best == NONE
            sizes = np.diff(first)
            if done.any():
                stay = np.repeat(~done, sizes)
                out.append((which[done], sym[~stay], sizes[done]))
                sym, slot, rank, which, best, sizes = sym[stay], slot[stay], rank[stay], which[~done], best[~done], sizes[~done]
            if not len(which):
                break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            if len(hit) > 1:  # of hits side by side (aaa), every second counts
                new = np.ones(len(hit), bool)
                new[1:] = np.diff(hit) > 1
                if not new.all():
                    run = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
                    hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[slot[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            piece = np.repeat(np.arange(len(which)), sizes)
            sizes = sizes - np.bincount(piece[hit], minlength=len(which))
            moved = np.cumsum(keep) - 1
            at = moved[hit]
            slot[hit] = slot[hit + 1]
            sym, slot = sym[keep], slot[keep]
            first = np.zeros(len(which) + 1, np.int64)
            np.cumsum(sizes, out=first[1:])
            ends = np.zeros(len(sym), bool)
            ends[first[1:] - 1] = True
            starts = np.zeros(len(sym), bool)
            starts[first[:-1]] = True
            changed = np.concatenate([at[~ends[at]], at[~starts[at]] - 1])
            slot[changed] = self.find(sym[changed], sym[changed + 1])
            slot[first[1:] - 1] = -1
        which = np.concatenate([x[0] for x in out])
        sizes = np.concatenate([x[2] for x in out])
        flat = np.concatenate([x[1] for x in out])
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(which, kind="stable")
        first = np.zeros(n + 1, np.int64)
        np.cumsum(sizes[order], out=first[1:])
        return flat[np.repeat(begin[order] - first[:-1], sizes[order]) + np.arange(first[-1])], first


U63 = np.uint64(2**63)

# -- how texts fall into pieces ----------------------------------------------------

OTHER, LETTER, DIGIT, BLANK = 0, 1, 2, 3
CLASS = np.zeros(256, np.uint8)
CLASS[kernel.WHITE] = BLANK
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = LETTER
#: Bytes of words that take the library's own steps: controls, apostrophes (contractions), "<" (special
#: tokens), and all beyond ASCII but the Latin letters U+00C0 to U+00FF.
ODD = np.zeros(256, bool)
ODD[:9] = ODD[14:32] = ODD[127] = ODD[0xC0:] = True
ODD[[0x27, 0x3C]] = True
ODD[0xC3] = False


def odd_bytes(buf: np.ndarray) -> np.ndarray:
    odd = ODD[buf]
    lead = np.flatnonzero(buf == 0xC3)
    lead = lead[lead + 1 < len(buf)]
    odd[lead[(buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)]] = True
    return odd


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin letters U+00C0 to U+00DE."""
    out = kernel.LOWER[buf]
    lead = np.flatnonzero(buf == 0xC3)
    lead = lead[lead + 1 < len(buf)]
    tail = buf[lead + 1]
    up = (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
    out[lead[up] + 1] += 32
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return index, inverse


def parse(text: str) -> dict:
    return json.loads(text)


def special_pattern(spec: dict):
    names = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return names, re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if names else None
