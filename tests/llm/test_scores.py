import collections
import math
import re
import zlib

import numpy as np
import pytest

from unifold.llm import decontaminate, edit, licenses, mixing, quality, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_mixing_base_is_exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = {r.doc_id: [*WORDS.findall((r.text or "").translate(UPPER)), None] for r in rows}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in words}
    c = collections.Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in mixing.op3_context_mixing(spark, sf).collect():
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0


def test_mixing_knows_its_language(spark):
    rng = np.random.default_rng(3)
    tongues = [[f"{p}{i}" for i in range(200)] for p in ("ba", "ko", "zu")]
    rows = [(k, " ".join(rng.choice(tongues[k % 3], 120))) for k in range(600)]
    got = mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_mixing_odd(spark, odd_documents):
    got = mixing.score(odd_documents).collect()
    assert len(got) == odd_documents.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert next(r for r in got if r.doc_id is None).held_out
    assert mixing.score(odd_documents.limit(0)).count() == 0


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = [False] * len(words)
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            marked[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(marked)


def test_quality_counts(spark, sf, odd_documents):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in quality.op4_quality_rules(spark, sf).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality.quality(odd_documents, labels).collect()
    assert len(got) == odd_documents.count()
    assert quality.quality(odd_documents.limit(0), labels).count() == 0


def test_exact_bounds():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    p = quality.upper_bound(7, 50, 0.01)
    assert sum(math.comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(8)) == pytest.approx(0.01, abs=1e-9)
    grid = np.array([4.0, 3.0, 2.0, 1.0])
    assert quality.choose(grid, np.array([0, 0, 5, 900]), np.array([10, 50, 80, 100]), 1000, 100, 0.02, 0.01) == 2.0
    assert quality.choose(grid, np.array([0, 0, 0, 0]), np.array([0, 0, 0, 0]), 1000, 100, 0.02, 0.01) == math.inf


def test_few_labels_certify_nothing():
    assert quality.choose(np.array([1.0]), np.array([0]), np.array([5]), 20, 5, 0.005, 0.01) == math.inf


def test_automaton_is_edit_distance():
    rng = np.random.default_rng(2)
    terms = [("idiot", 0), ("scum", 0), ("worthless", 0), ("lowei", 5)]
    auto = toxicity.Automaton(terms)

    def distance(a, b):
        return int(edit.distances(np.array([ord(c) for c in a]), np.array([0, len(a)]), np.array([ord(c) for c in b]), np.array([0, len(b)]), np.array([9]))[0])

    words = ["idiot", "idoit", "idiiot", "idit", "xidiot", "scum", "scun", "loweisp", "lowie", "worthles", "worthlesss", "worthlexxs"]
    for _ in range(400):
        w = list(terms[int(rng.integers(3))][0])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = chr(97 + int(rng.integers(26)))
        words.append("".join(w))
    points = np.concatenate([[ord(c) for c in w] for w in words]).astype(np.uint32)
    ends = np.cumsum([len(w) for w in words])
    got = auto.match(points, ends - [len(w) for w in words], ends)
    for w, k in zip(words, got.tolist(), strict=True):
        whole = [t for t, s in terms if not s]
        want = auto.EXACT if w in whole else auto.STEM if w.startswith("lowei") else auto.NEAR if any(len(t) >= toxicity.FUZZY and distance(w, t) <= 1 for t in whole) else auto.MISS
        assert k == want, w


def test_toxicity_learns_and_reads_context(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for k in range(800):
        w = list(rng.choice(plain, 60))
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                w[int(rng.integers(60))] = str(rng.choice(["gromit", "blarghs"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got} == {True}
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held) and len(held) > 100


def test_toxicity_odd(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (7, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd_documents, labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd_documents.limit(0), labels.limit(0)).count() == 0
    assert toxicity.accepted(odd_documents, labels.limit(0)).count() == odd_documents.count()


def brute_contaminated(docs, items, percent=80):
    words = decontaminate._words([(t or "").encode() for _, t in docs])
    out = set()
    for (k, _), w in zip(docs, words, strict=True):
        for i, x in zip([i for i, _ in items], decontaminate._words([(t or "").encode() for _, t in items]), strict=True):
            n = len(x)
            if not n or len(w) < n:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(w, n)
            steps = np.arange(len(windows) + 1) * n
            d = edit.distances(windows.ravel(), steps, np.tile(x, len(windows)), steps, np.full(len(windows), decontaminate.edits(n, percent)))
            if d.min() <= decontaminate.edits(n, percent):
                out.add((k, i))
    return out


def test_decontamination_recall(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(12, 50))))) for i in range(25)]
    docs = []
    for k in range(150):
        w = list(rng.choice(vocabulary, 200))
        if k % 2:
            x = items[k % 25][1].split()
            for _ in range(int(rng.integers(0, len(x) // 5 + 1))):
                x[int(rng.integers(len(x)))] = "changed"
            w[50:50] = x
        docs.append((k, " ".join(w)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminated(docs, items)
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(found) >= 0.95 * len(want)


def test_decontamination_odd(spark, odd_documents):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "repeated row of several plain words here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_documents, items).collect()}
    assert got == {(8, 3), (7, None)}
    assert decontaminate.contaminated(odd_documents.limit(0), items).count() == 0
    assert decontaminate.contaminated(odd_documents, items.limit(0)).count() == 0


def test_licenses(spark, odd_documents):
    rows = [
        (1, "text\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "Licensed under CC BY 4.0."),
        (6, "A license to print money, and the copyright of this joke."),
        (7, "Copyright (c) 2020 Some Body. All rights reserved."),
    ]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"), (2, "GPL-3.0"), (3, "GPL-2.0"), (4, "CC-BY-NC-4.0"), (5, "CC-BY-4.0"), (7, "proprietary")}
    assert licenses.scan(odd_documents).count() == 0


def test_winners_are_all_that_brute_force_confirms(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = set()
    for r in docs:
        for n, line in enumerate((r.text or "").split("\n")):
            for name, texts in licenses.TEMPLATES.items():
                if any(licenses.differences(licenses.words(t), licenses.words(line)) is not None for t in texts):
                    want.add((r.doc_id, n, name))
    assert {(r.doc_id, r.line, r.license) for r in licenses.op8_license_scan(spark, sf).collect()} == want
