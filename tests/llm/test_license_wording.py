import re
import textwrap

import numpy as np

from unifold.llm import licenses

TYPE = "doc_id long, text string"


def whole(license):
    return max(licenses.TEMPLATES[license], key=len).replace("{}", "some holders")


MIT = whole("MIT")


def scanned(spark, rows):
    return licenses.scan(spark.createDataFrame(rows, TYPE)).collect()


def commented(text):
    return "\n".join(f" * {x}" for x in textwrap.wrap(text, 70))


def test_changed_wording_is_reported(spark):
    changed = MIT.replace("furnished to do so", "supplied to do so").replace("merge, ", "").replace("including without", "including but without")
    rows = [
        (1, "intro\n" + commented(changed)),
        (2, "Permission is hereby given, free of charge, to any person obtaining a copy of this software"),
        (3, MIT.upper()),
    ]
    got = {(r.doc_id, r.line, r.license, r.changed, r.changes) for r in scanned(spark, rows)}
    assert got == {(1, 1, "MIT", 3, "+but -merge furnished>supplied"), (2, 0, "MIT", 1, "granted>given"), (3, 0, "MIT", 0, "")}


def test_whole_notice_wins_over_its_parts_and_kin(spark):
    kin = ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC", "MPL-2.0", "Apache-2.0")
    got = sorted((r.doc_id, r.line, r.license, r.changed) for r in scanned(spark, [(n, commented(whole(k))) for n, k in enumerate(kin)]))
    assert got == [(n, 0, k, 0) for n, k in enumerate(kin)]


def test_notices_in_free_places_stand(spark):
    rows = [(1, "Copyright 2020 Acme. Released under CC0 1.0. All rights reserved."), (2, "Copyright 2019 A\nCopyright 2020 B\nAll rights reserved")]
    got = sorted((r.doc_id, r.line, r.license) for r in scanned(spark, rows))
    assert got == [(1, 0, "CC0-1.0"), (1, 0, "proprietary"), (2, 0, "proprietary"), (2, 1, "proprietary")]


def test_numbers_and_names_never_change(spark):
    rows = [
        (1, "GNU General Public License as published by the Free Software Foundation, either version 1"),
        (2, "GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
        (3, "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ]
    assert scanned(spark, rows) == []


def test_no_allowed_change_is_lost(spark):
    """Every template, with up to a tenth of its words changed, in texts of prose, of other notices and of one long line."""
    rng = np.random.default_rng(5)
    prose = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(["ta", "of the ", "mi", "lo"], n), rng.choice(["re", "na", "software ", "ku"], n), strict=True)) for n in (5, 200, 3000)]
    others = " ".join(t for texts in licenses.TEMPLATES.values() for t in texts if len(t) < 120)
    rows, want = [], {}
    for license, texts in licenses.TEMPLATES.items():
        for t in texts:
            for filler in (*prose, others):
                w = t.replace("{}", "some body").split()
                free = [k for k in range(2, len(w) - 2) if re.fullmatch(r"[a-z,]+", w[k]) and w[k].strip(",") not in licenses.NAMES]
                some = rng.permutation(free)[: len(licenses.words(t.replace("{}", ""))) // 10] if "{}" not in t or len(w) > 20 else []
                for k in some:
                    w[int(k)] = "otherword"
                rows.append((len(rows), f"{filler}\n{' '.join(w)}\n{filler}"))
                want[len(rows) - 1] = license, len(some)
    got = {(r.doc_id, r.license): r.changed for r in scanned(spark, rows) if r.line == 1}
    assert set(got) == {(k, license) for k, (license, _) in want.items()}
    assert all(got[k, license] <= n for k, (license, n) in want.items())


def test_every_block_meets_every_template(monkeypatch):
    s = licenses.Scanner()
    met = []
    monkeypatch.setattr(s, "given", [lambda raw, k=k, c=c: met.append((k, raw)) or c(raw) for k, c in enumerate(s.given)])
    own = licenses.words(" ".join(f"word{i}" for i in range(2000)) + " " + MIT)
    s.appearances(own)
    blocks = {raw for _, raw in met}
    assert len(met) == len(blocks) * len(s.known) and {k for k, _ in met} == set(range(len(s.known)))
    joined, at = " ".join(own).encode(), 0
    for b in sorted(blocks, key=joined.index):
        assert joined.index(b) <= at
        at = joined.index(b) + len(b)
    assert at == len(joined)


def test_license_odd(spark, odd_documents):
    mit = "x\nReleased under the MIT License."
    rows = [(1, mit), (1, mit), (None, mit), (2, None), (3, ""), (4, " \n "), (5, "{}"), (6, "word " * 30_000 + mit.replace("\n", " "))]
    got = sorted((r.doc_id or 0, r.line, r.license) for r in scanned(spark, rows))
    assert got == [(0, 1, "MIT"), (1, 1, "MIT"), (1, 1, "MIT"), (6, 0, "MIT")]
    assert licenses.scan(odd_documents.limit(0)).count() == 0
