"""Events, spans and run reports, kept in the driver's memory; and counts for each predicate of a query."""

from __future__ import annotations

import logging
import threading
import time
from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("tessera")
#: Events beyond it push out the oldest.
KEPT = 50_000
_events: deque[dict] = deque(maxlen=KEPT)
_on = False
_lock = threading.Lock()


def enable(on: bool = True) -> None:
    global _on
    _on = on


def record(kind: str, **what) -> None:
    if _on:
        with _lock:
            _events.append({"kind": kind, "at": time.time(), **what})
        log.debug("%s %s", kind, what)


@contextmanager
def span(name: str, **what) -> Iterator[None]:
    began = time.perf_counter()
    try:
        yield
    finally:
        record("span", name=name, ms=(time.perf_counter() - began) * 1000, **what)


def marker(name: str, **what) -> None:
    record("marker", name=name, **what)


def metric(name: str, value: float) -> None:
    record("metric", name=name, value=value)


def events() -> list[dict]:
    with _lock:
        return list(_events)


def clear() -> None:
    with _lock:
        _events.clear()


def analyse(given: list[dict] | None = None) -> dict:
    """How many events of each kind there are, and what the spans took."""
    given = events() if given is None else given
    spans: dict[str, list[float]] = {}
    for e in given:
        if e["kind"] == "span":
            spans.setdefault(e["name"], []).append(e["ms"])
    return {"count": len(given), "by_kind": dict(Counter(e["kind"] for e in given)), "spans": {k: {"count": len(v), "total_ms": sum(v), "max_ms": max(v)} for k, v in spans.items()}}


def run_report(given: list[dict] | None = None) -> dict:
    given = events() if given is None else given
    plans = [e for e in given if e["kind"] == "plan"]
    return {**analyse(given), "plans": [{"plan_id": p["plan_id"], "order": list(p["ordered"]), "contradictions": list(p["contradictions"])} for p in plans], "rows": [e["n"] for e in given if e["kind"] == "rows"], "metrics": {e["name"]: e["value"] for e in given if e["kind"] == "metric"}}


def format_run_report(report: dict) -> str:
    lines = [f"{report['count']} events"]
    lines += [f"  {name}: {s['count']} x, {s['total_ms']:.1f} ms, at most {s['max_ms']:.1f} ms" for name, s in report["spans"].items()]
    lines += [f"  {p['plan_id']}: {' and '.join(p['order']) or 'everything'}" for p in report["plans"]]
    return "\n".join(lines)


def observed(query) -> tuple[DataFrame, Observation]:
    """A query's rows, and how many rows satisfy each of its predicates by itself, counted in the same pass."""
    from .ast import conjuncts
    from .compile import Compiler
    from .normalise import label

    node, _ = query.plan()
    compiler, seen = Compiler(query.data.schema), Observation()
    tests = conjuncts(node)
    counts = [F.count_if(compiler.column(x)).alias(f"{i}:{label(x)}") for i, x in enumerate(tests)]
    df = query.data.df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    for x in tests:
        df = df.where(compiler.column(x, strict=False))
    return df, seen
