"""The history fold on a stream: one keyed state a book, updated with each micro-batch of ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(done: list[int], undone: list[int], op: int, action: str) -> tuple[list[int], list[int]]:
    if action == "edit":
        return [*done, op], []
    if action == "undo" and done:
        return done[:-1], [*undone, done[-1]]
    if action == "redo" and undone:
        return [*done, undone[-1]], undone[:-1]
    return done, undone


def folded_stream(log: DataFrame) -> DataFrame:
    """project_id, done, undone after each batch, for books with events in it. Within a batch events go by seq; one that
    arrives after later ones were folded is applied last."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, undone = (list(x) for x in state.get) if state.exists else ([], [])
        for _, _, op, action in sorted((r.seq, i, r.op, r.action) for i, r in enumerate(r for b in batches for r in b.itertuples())):
            done, undone = step(done, undone, int(op), action)
        state.update((done, undone))
        yield pd.DataFrame({"project_id": [key[0]], "done": [done], "undone": [undone]})

    arrays = "done array<long>, undone array<long>"
    return log.groupBy("project_id").applyInPandasWithState(update, f"project_id long, {arrays}", arrays, "update", GroupStateTimeout.NoTimeout)
