"""Linear history: which operations are in force after a stream of edits, undos and redos, and the state they give."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(log: DataFrame) -> DataFrame:
    """project_id, done, undone (operation ids) after a log (project_id, seq, op, action: edit, undo or redo).

    An edit forgets what was undone; an undo takes the latest done operation, a redo the one undone last. An undo or redo
    without an operation to act on changes nothing. The fold runs over a book's ordered events inside the JVM.
    """
    events = log.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "action"))).alias("events"))
    start = F.struct(F.array().cast("array<long>").alias("done"), F.array().cast("array<long>").alias("undone"))

    def step(s, e):
        done, undone = s["done"], s["undone"]
        edit = F.struct(F.array_append(done, e["op"]).alias("done"), F.array().cast("array<long>").alias("undone"))
        back = F.struct(F.slice(done, F.lit(1), F.size(done) - 1).alias("done"), F.array_append(undone, F.get(done, F.size(done) - 1)).alias("undone"))
        again = F.struct(F.array_append(done, F.get(undone, F.size(undone) - 1)).alias("done"), F.slice(undone, F.lit(1), F.size(undone) - 1).alias("undone"))
        return F.when(e["action"] == "edit", edit).when((e["action"] == "undo") & (F.size(done) > 0), back).when((e["action"] == "redo") & (F.size(undone) > 0), again).otherwise(s)

    return events.select("project_id", F.reduce("events", start, step).alias("s")).select("project_id", "s.done", "s.undone")


def flags(states: DataFrame) -> DataFrame:
    """project_id, can_undo, can_redo."""
    return states.select("project_id", (F.size("done") > 0).alias("can_undo"), (F.size("undone") > 0).alias("can_redo"))


def active(log: DataFrame, states: DataFrame) -> DataFrame:
    """The edits of the log that are in force."""
    return log.where("action = 'edit'").join(states.select("project_id", F.explode("done").alias("op")), ["project_id", "op"], "left_semi")


def state(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows (project_id, row_id, value) after changes (project_id, row_id, seq, after): a row's last change counts, null
    deletes it, rows without a change stay."""
    last = changes.groupBy("project_id", "row_id").agg(F.max_by(F.struct("after"), "seq").alias("_last"))
    both = base.join(last, ["project_id", "row_id"], "full")
    return both.select("project_id", "row_id", F.when(F.col("_last").isNotNull(), F.col("_last.after")).otherwise(F.col("value")).alias("value")).where("value is not null")


def reverted(changes: DataFrame) -> DataFrame:
    """What undoing an operation writes: each row as it was before the operation's first change of it."""
    return changes.groupBy("project_id", "op", "row_id").agg(F.min_by(F.struct("before"), "seq").alias("_first")).select("project_id", "op", "row_id", F.col("_first.before").alias("value"))


def reapplied(changes: DataFrame) -> DataFrame:
    """What redoing an operation writes: each row as it was after the operation's last change of it."""
    return changes.groupBy("project_id", "op", "row_id").agg(F.max_by(F.struct("after"), "seq").alias("_last")).select("project_id", "op", "row_id", F.col("_last.after").alias("value"))


def recorded(log: DataFrame) -> DataFrame:
    """The operations that a log leaves: project_id, op (seq of its first record), kind, seqs (its records), undone.

    log: project_id, seq, action (edit, undo or redo), kind, n_changes, coalesce. An edit without changes is no operation;
    another forgets what was undone, and with coalesce goes into the latest operation if that is of its kind. A book's log is
    read once, in order.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        done, undone = [], []
        for r in rows.sort_values("seq").itertuples():
            if r.action == "edit" and r.n_changes:
                undone = []
                if r.coalesce and done and done[-1][1] == r.kind:
                    done[-1][2].append(r.seq)
                else:
                    done.append((r.seq, r.kind, [r.seq]))
            elif r.action == "undo" and done:
                undone.append(done.pop())
            elif r.action == "redo" and undone:
                done.append(undone.pop())
        out = [(key[0], *op, False) for op in done] + [(key[0], *op, True) for op in undone]
        return pd.DataFrame(out, columns=["project_id", "op", "kind", "seqs", "undone"])

    return log.groupBy("project_id").applyInPandas(one, "project_id long, op long, kind string, seqs array<long>, undone boolean")
