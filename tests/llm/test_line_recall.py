import numpy as np

from unifold.llm import lines


def levenshtein(a, b):
    row = np.arange(len(b) + 1)
    b = np.array(list(b))
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k, kind = int(rng.integers(len(words))), int(rng.integers(3))
        new = "".join(rng.choice(list("abcdefghij"), 6))
        if kind == 0:
            words[k] = new
        elif kind == 1:
            words.insert(k, new)
        else:
            del words[k]
    return words


def test_lines_of_edit_similarity_are_found(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("klmnopqrstuvwxyz"), int(rng.integers(3, 10)))) for _ in range(2000)]
    rows, pairs = [], []
    for n in (6, 9, 12, 20, 40, 80):
        for _ in range(60):
            line = list(rng.choice(vocabulary, n))
            other = edited(rng, line, int(rng.integers(1, max(2, n // 6 + 1))))
            a, b = " ".join(line), " ".join(other)
            if len(other) >= 5 and levenshtein(a, b) <= 20 * max(len(a), len(b)) // 100:
                pairs.append(2 * len(pairs))
                rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r.doc_id: r.n_cut for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 250
    assert sum(got[k + 1] for k in pairs) >= 0.9 * len(pairs)
    assert not any(got[k] for k in pairs)


def test_bit_vectors_tell_whether_edits_suffice():
    rng = np.random.default_rng(6)
    draw = lambda n: "".join(rng.choice(list("abé漢😀"), n))
    for k in range(3000):
        a = draw(int(rng.integers(0, 90 if k % 10 == 0 else 14)))
        b = draw(int(rng.integers(0, 14))) if k % 2 else "".join(edited(rng, a + "bbb", int(rng.integers(0, 3))))
        most = int(rng.integers(0, 9))
        assert lines.within(a, b, most) == (levenshtein(a, b) <= most), (a, b, most)


def test_lines_of_too_many_code_points_are_compared_in_the_jvm(spark, monkeypatch):
    pairs = [(1, 2, "abcdefghij", "abxdefghij"), (3, 4, "abcdefghij", "axcxefxhij"), (5, 6, "", "")]
    df = spark.createDataFrame(pairs, "a long, b long, ta string, tb string")
    assert lines.verified(df, 80).count() == 2
    monkeypatch.setattr(lines, "within", lambda a, b, most: None)
    assert {tuple(r) for r in lines.verified(df, 80).collect()} == {(1, 2), (5, 6)}
