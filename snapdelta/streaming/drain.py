"""Draining the push queue: one oldest batch of a connector after the other, or all that wait in one run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from snapdelta.plans.run import IndexStep, RunResult, run_connector
from snapdelta.plans.store import Store
from snapdelta.spec import Connector


def drain(
    store: Store,
    connector: Connector,
    run_ts: datetime | None = None,
    most: int | None = None,
    index_step: IndexStep | None = None,
    new_id: Callable[[], str] = lambda: uuid.uuid4().hex,
) -> list[RunResult]:
    """Run the connector until its queue is empty or ``most`` batches are drained.

    An empty queue is a successful run without counts, and writes no commit.
    """
    results: list[RunResult] = []
    while most is None or len(results) < most:
        result = run_connector(store, connector, new_id(), run_ts, index_step=index_step)
        if result.manifest_path is None:
            return results or [result]
        results.append(result)
    return results


def drain_together(
    store: Store,
    connector: Connector,
    run_ts: datetime | None = None,
    index_step: IndexStep | None = None,
    new_id: Callable[[], str] = lambda: uuid.uuid4().hex,
) -> RunResult:
    """One run over every batch that waits: one delta, one commit, the same state as one run each."""
    return run_connector(store, connector, new_id(), run_ts, index_step=index_step, all_waiting=True)
