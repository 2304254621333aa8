import numpy as np

from unifold.llm import decontaminate


def test_passages_with_insertions_and_deletions(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, 50))) for i in range(20)]
    docs, want = [], set()
    for i, text in items:
        for kind in range(4):
            x = text.split()
            for _ in range(1 if kind == 3 else 6):
                k = int(rng.integers(len(x)))
                if kind == 1:
                    x.insert(k, f"new{k}")
                else:
                    del x[k]
            # Removed, inserted, removed in a document of its own, and one word removed there.
            own = kind >= 2
            want.add((len(docs), i))
            docs.append((len(docs), " ".join(x if own else [*rng.choice(vocabulary, 60), *x, *rng.choice(vocabulary, 60)])))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    assert set(found) <= want
    for kind in range(4):
        assert sum(k % 4 == kind for k, _ in found) >= 18
    assert all(r.distance == 1 and r.start == 0 for (k, _), r in found.items() if k % 4 == 3)


def test_free_ends():
    d, start = decontaminate.free_distances(np.array([[1, 2, 3, 4]] * 3), np.array([[9, 1, 2, 3, 4, 9], [9, 9, 1, 2, 4, 9], [1, 2, 8, 3, 4, 9]]))
    assert d.tolist() == [0, 1, 1] and start.tolist() == [1, 2, 0]
