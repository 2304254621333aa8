import numpy as np
import pyarrow as pa

from unifold.llm import kernel, lines

def test_sketches_say_what_nodes_are_compared_by(spark):
    rows = [(1, 7, "One line, of SOME words\nshort\n\none line of some words"), (2, 8, "é漢 b c d e"), (3, 9, None)]
    got = {(r.rid, r.line): r for r in lines.sketches_of(spark.createDataFrame(rows, "rid long, id long, text string"), 5).coalesce(1).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 3), (2, 0)} and got[1, 0].node == got[1, 3].node and got[1, 0].m == 3
    assert [(k, got[k].text, got[k].n) for k in sorted(got) if got[k].keys is not None] == [((1, 0), "one line of some words", 22), ((2, 0), "é漢 b c d e", 10)]
    buf, offs = kernel.texts(pa.array([rows[0][2], rows[1][2]]))
    _, _, _, hashes, _, _, edge, _ = lines.compared(buf, offs, 5)
    line, key = lines.line_keys(hashes, edge)
    assert sorted(got[2, 0]["keys"]) == sorted(key[line == 2].view(np.int64).tolist()) and got[2, 0].s == lines.simhash(hashes, edge).view(np.int64)[2]


def test_texts_are_read_once(spark, monkeypatch):
    read = []
    plain = lines.sketches_of
    monkeypatch.setattr(lines, "sketches_of", lambda *args: read.append(args) or plain(*args))
    groups = lines.groups

    def checked(sketches, *args):
        # What lines are grouped by is a table, not the texts again.
        assert sketches.inputFiles() and {"keys", "s", "n", "node", "text"} <= set(sketches.columns)
        return groups(sketches, *args)

    monkeypatch.setattr(lines, "groups", checked)
    rows = [(k, f"one line of some words {k}\nthis line is the same in all of them\n") for k in range(20)]
    got = {r.doc_id: r.n_cut for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(read) == 1 and got[0] == 0 and all(got[k] >= 1 for k in range(1, 20))
