"""The manifest against trees folded by hand; proofs come from the store alone."""

from __future__ import annotations

import hashlib
import zlib

from gleaner.llm import manifest as X
from gleaner.llm import queries


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, lower: bool = False) -> str:
    text = r.text
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h(field(r.doc_id), field(r.source), field(r.lang), field(r.n_chars), field(text))


def climb(level: list[str]) -> tuple[str, list[list]]:
    """The last digest over a row of digests, and per digest its sibling segments from below."""
    paths: list[list] = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        at = [k // 16 for k in at]
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows) -> list[tuple]:
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, below = [], []
    for s in order:
        mine = sorted(by[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        sub, paths = climb([leaf(r) for r in mine])
        subs.append(sub)
        below.append(list(zip(mine, paths)))
    if not subs:
        return []
    root, above = climb(subs)
    out = []
    for sub, top, docs in zip(subs, above, below):
        for r, path in docs:
            path = [*path, *top]
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            d = leaf(r, tampered)
            for before, after in path:
                d = h(before, d, after)
            out.append((r.doc_id, leaf(r), sub, root, h(*(a + b for a, b in path)), d, d == root))
    return sorted(out, key=repr)


def query(spark, df, tmp_path) -> list[tuple]:
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()), key=repr)


def test_edge_rows(spark, edge_docs, tmp_path):
    assert query(spark, edge_docs, tmp_path) == brute(edge_docs.collect())


def test_empty_table(spark, no_docs, tmp_path):
    assert query(spark, no_docs, tmp_path) == []


def test_deep_and_shallow_sources(spark, tmp_path):
    """Sources of 1, 16, 17 and 300 rows, and more than 16 sources."""
    rows = [(i, f"Text {i}", "en", s, i) for s, n in [(None, 1), ("", 16), ("b", 17), ("c", 300), *((f"s{k}", 1 + k % 3) for k in range(20))] for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = query(spark, df, tmp_path)
    assert got == brute(df.collect())
    assert {r[6] for r in got} == {True, False}


def test_one_row_is_its_own_root(spark, tmp_path):
    df = spark.createDataFrame([(3, "a", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = query(spark, df, tmp_path)
    assert row[1] == row[2] == row[3] and row[4] == h("")


def test_requests_for_few_leaves_visit_their_nodes_only(spark):
    rows = [(i, s, f"{s}{i}") for s in "ab" for i in range(600)]
    leaves = spark.createDataFrame([(s, i, h(t)) for i, s, t in rows], "source string, doc_id long, leaf string")
    m = X.build(leaves)
    asked = m.leaves.where("src = 1 and rank in (5, 599)").select("src", "rank", "depth", "leaf", "doc_id")
    assert X.descend(m, asked).count() == 2
    got = X.proofs(m, asked, ["doc_id"]).select("doc_id", X.folded(X.F.col("leaf"), X.F.col("path")).alias("root")).collect()
    assert sorted((r.doc_id, r.root) for r in got) == [(5, m.root), (599, m.root)]
    assert m.nodes.count() == 2 * (38 + 3 + 1) + 1
