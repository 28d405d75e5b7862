"""Rows of Spark and of DuckDB in one comparable form."""

from __future__ import annotations

import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return f"{v:.7g}" if abs(v) < 1e6 else f"{v:.10g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def table(names: list[str], rows) -> list[str]:
    order = sorted(names)
    at = [names.index(c) for c in order]
    return [str(order), *sorted(str([plain(r[i]) for i in at]) for r in rows)]


def same(frame, relation) -> None:
    ours, theirs = table(frame.columns, frame.collect()), table(relation.columns, relation.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours) == len(theirs)
    assert [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b][:3] == []
