import collections
import hashlib
import re

import numpy as np
import pytest

from unifold.llm import components, jaccard, lines, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Groups:
    def __init__(self, items):
        self.up = {k: k for k in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        x, y = self.find(a), self.find(b)
        self.up[max(x, y)] = min(x, y)


def brute_substrings(rows, size):
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings_of_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_substrings([(r.doc_id, r.text) for r in docs.collect()], 35)
    got = [tuple(r) for r in substring.op1_substring_dedup(spark, sf).collect()]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("size,gram", [(6, 2), (8, 3), (5, 5)])
def test_substrings_small_alphabet(spark, size, gram):
    rng = np.random.default_rng(size)
    rows = [(k, " ".join(rng.choice(list("abcd"), int(rng.integers(0, 60))))) for k in range(60)]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=size, gram=gram).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got], key=str) == brute_substrings(rows, size)


def test_substrings_odd(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = substring.dedup(odd_documents).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got], key=str) == brute_substrings(rows, 35)
    assert substring.dedup(odd_documents.limit(0)).count() == 0


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(UPPER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_jaccard(rows):
    sets = shingle_sets(rows)
    g = Groups(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                g.join(i, j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = g.find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return sorted([(k, len(sets[i]), least[g.find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)], key=str)


def test_jaccard_of_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in jaccard.op5_ngram_jaccard(spark, sf).collect()], key=str) == brute_jaccard(rows)


def test_jaccard_families(spark):
    """Chains of near copies, a common passage, and a large group that differs from its leader."""
    rng = np.random.default_rng(5)
    rows = []
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(80)]
        for _ in range(40):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = f"x{int(rng.integers(1000))}"
            rows.append((len(rows), " ".join(w)))
    for k in range(30):
        rows.append((len(rows), " ".join([f"u{k}v{i}" for i in range(12)] + [f"common{i}" for i in range(15)])))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_jaccard(rows)


def test_jaccard_odd(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = jaccard.near_duplicates(odd_documents).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_jaccard(rows)
    assert jaccard.near_duplicates(odd_documents.limit(0)).count() == 0


def brute_lines(rows, least=5):
    places = collections.defaultdict(list)
    for k, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = re.findall("[0-9a-z\x80-\U0010ffff]+", line.translate(UPPER))
            if w:
                places[" ".join(w)].append((k is None, k, n))
    names = [x for x in places if x.count(" ") >= least - 1]
    buf = np.frombuffer("\n".join(names).encode(), np.uint8)
    _, s, e = lines.split_lines(buf, np.array([0, len(buf)]))
    _, _, _, h, first = lines.normal_words(buf, s, e)
    sim = lines.simhash(h, first)
    g = Groups(range(len(names)))
    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(sim[:i] ^ sim[i]) <= lines.BITS).tolist():
            longer = max(len(names[i]), len(names[j]))
            if levenshtein(names[i], names[j]) <= 20 * longer // 100:
                g.join(i, j)
    groups = collections.defaultdict(list, {x: v for x, v in places.items() if x.count(" ") < least - 1})
    for i, x in enumerate(names):
        groups[g.find(i)] += places[x]
    cut = collections.defaultdict(set)
    for v in groups.values():
        for _, k, n in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))[1:]:
            cut[k].add(n)
    return {k: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in cut[k]) for k, t in rows}


def test_lines_of_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: hashlib.sha256(t.encode()).hexdigest() for k, t in brute_lines(rows).items()}
    assert {r.doc_id: r.kept_sha256 for r in lines.op9_line_dedup(spark, sf).collect()} == want


def test_fuzzy_lines(spark):
    base = "a fairly long line of plain words that is used over and over again in many texts of all kinds"
    rows = [(k, f"own line number {k} stands here alone\n{base if k % 3 else base.replace('plain', 'plaiin')}") for k in range(40)]
    got = {r.doc_id: r.kept for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_short_lines_link_only_with_equal_ones(spark):
    rows = [(1, "Thank you!\n--\n漢字漢字"), (2, "thank  you\n--\nthank you all\n漢字漢字"), (3, "thank you al\n\nThank you!")]
    got = {r.doc_id: (r.kept, r.n_cut, r.n_lines) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0, 2), 2: ("--\nthank you all", 2, 3), 3: ("thank you al\n", 1, 2)}


def test_lines_odd(spark, odd_documents):
    got = lines.dedup(odd_documents)
    assert got.count() == odd_documents.count() and set(odd_documents.columns) < set(got.columns)
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].kept is None and by[4].kept == "" and by[7].n_cut == 0
    assert lines.dedup(odd_documents.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (7, 7), (None, 3), (20, 15), (15, 11)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 15: 10, 20: 10}
