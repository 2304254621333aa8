import re

import corpus_pipeline
from unifold.llm import decontaminate, jaccard, substring

PROSE = "the river runs past the old mill and on to the lake where boats lie at rest in the evening light of a summer day".split()


def near_groups(rows):
    """Brute force: per row, the place of the row that stays for it."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_near_duplicates_without_ids(spark):
    base = [f"{w}{i}" for i in range(4) for w in PROSE]
    near = base[:40] + ["changed"] + base[41:]
    rows = [(None, " ".join(base)), (None, " ".join(near)), (5, " ".join(near)), (7, "a b c d e f"), (7, "g h i j k l"), (7, "a b c d e f"), (None, "x y z"), (None, "x y z"), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, rid int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(docs).collect())
    group, want = near_groups(rows), []
    for g in set(group):
        members = sorted({(k is None, k or 0, t or "") for (k, t), x in zip(rows, group, strict=True) if x == g})
        want.append(members[0])
    assert got == sorted(want)


def test_contaminated_without_ids(spark):
    item = " ".join(f"{w}{i}" for i in range(2) for w in PROSE)
    rows = [(None, f"before {item} after"), (1, item), (1, "quite another text under the same id"), (2, None), (3, "")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, key string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None)], "item_id short, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, rows[2][1]), (2, ""), (3, "")]
    hits = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in hits) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_stages_on_odd_documents(spark, sf, odd_documents):
    """Every stage keeps the columns, drops no clean document and takes an empty table."""
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert out.count() == (len(set(near_groups(rows))) if name == "near_dedup" else len(rows)), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == 11 and all(len(r.ids) == 4 * r.n_tokens for r in last)


def test_repeated_rows_of_substrings_cost_in_proportion(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text)] * 60, "doc_id long, text string")
    parsed = substring.parse(docs.selectExpr("xxhash64(cast(doc_id as string), text) as rid", "text"), 35, 10).collect()
    assert len(parsed) == 1 and len(parsed[0].codes) == len(set(parsed[0].codes)) < 120
    out = substring.dedup(docs).collect()
    assert len(out) == 60 and all(r.n_removed == 120 for r in out)
