"""Whole licences beyond the short ones."""

from __future__ import annotations

import pkgutil

from gleaner.llm import licences


def test_whole_stored_licences_match_with_and_without_titles(spark, tmp_path):
    text = lambda f: pkgutil.get_data("gleaner.llm", f"licence_texts/{f}.txt").decode()
    rows, want = [], []
    for name, file, _ in licences.STORED:
        rows.append(text(file))
        want.append(name)
    apache, gpl, mpl = text("Apache-2.0"), text("GPL-3"), text("MPL-2.0")
    short = dict(reversed([(n, t) for n, t in licences.KNOWN if "\n" in t]))
    more = [
        ("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache[apache.index("TERMS AND"): apache.index("END OF")]),
        ("GPL-3.0", gpl[: gpl.index("How to Apply These")]), ("GPL-3.0", gpl[gpl.index("Copyright (C)"):]), ("MPL-2.0", mpl[: mpl.index("Exhibit A -")]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\n\n" + short["BSD-3-Clause"]), ("BSD-2-Clause", "BSD 2-Clause License\n" + short["BSD-2-Clause"]),
        ("ISC", "ISC License\n\nCopyright 2021 A. Person\n\n" + short["ISC"]), ("0BSD", "BSD Zero Clause License\n" + short["0BSD"]), (None, apache[:5000]), (None, gpl + "\nmore"),
    ]
    rows += [t for _, t in more]
    want += [n for n, _ in more]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.licence for r in licences.scan_licences(spark.read.parquet(path), licences.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == want
