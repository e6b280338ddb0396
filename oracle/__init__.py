"""Independent DuckDB SQL oracles, one per registered query key."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracle import analysis, discovery, pages, report, state, stream

    out: dict[str, str] = {}
    out.update(discovery.SQL)
    out.update(analysis.SQL)
    out.update(report.SQL)
    out.update(pages.SQL)
    out.update(state.SQL)
    out.update(stream.SQL)
    return out
