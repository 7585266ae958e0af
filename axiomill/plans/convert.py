"""Statements with additions become prompts and targets, whole or action by action, with what became of each."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.functions import render
from axiomill.sources.statements import Definition, clauses, statement

ACTIONS = "row_id string, action_index int, action_count int, prompt string, target string, text string, visible string, families array<string>, outcome string, reason string"


def _limits(target: str, groups: int, many_groups: bool, most_predicates: int) -> str | None:
    facts = sum(len(render.parse_segment(part)[1]) for part in target.split(";") if part.strip())
    if groups != 1 and not many_groups:
        return "multi_target"
    return "too_many_predicates" if 0 <= most_predicates < facts else None


def _converted(visible: str, addition: str, defs: dict[str, Definition], split: bool, many_groups: bool, most_predicates: int) -> list[dict]:
    """The actions of one row with their outcome; a row whose actions do not all hold gives none of them."""
    start = statement(visible)
    if split:
        actions = render.action_sequence(start, addition, defs)
        if "reason" in actions[0]:
            return [{"outcome": "rejected", "reason": actions[0]["reason"]}]
    else:
        prompt, ref = render.prompt(start, defs)
        target, sizes = render.target(addition, defs, ref)
        actions = [{"action_index": 0, "action_count": 1, "prompt": f"{prompt} {render.FIRST}", "target": target, "visible": visible, "groups": sizes["target_groups"]}]
    reason = None
    for a in actions:
        if reason:
            a |= {"outcome": "unreachable"}
            continue
        points = {p for c in statement(a["visible"]).clauses for p in c.points}
        reason = _limits(a["target"], a.pop("groups", 1), many_groups, most_predicates) or render.reject_reason(a["target"], points)
        a |= {"outcome": "rejected" if reason else "written", "reason": reason}
    if reason:
        for a in actions:
            if a["outcome"] == "written":
                a |= {"outcome": "discarded", "reason": "incomplete_action_sequence"}
    return [a | {"text": f"{a['prompt']} {a['target']}"} for a in actions]


def convert_rows(rows: DataFrame, defs: dict[str, Definition], split_actions: bool = False, many_groups: bool = False, most_predicates: int = 2) -> DataFrame:
    """Actions (see ACTIONS) of rows (id, visible, target); those with outcome `written` are the training pairs.

    outcome: written; rejected (with the reason); discarded (fit, but a later action of the row is rejected); unreachable (after a
    rejected one); error (the row can't be read: reason says why). A map over rows. A null statement or target is an error;
    repeated rows are answered one by one; an empty table gives an empty result.
    """
    text = ("row_id", "prompt", "target", "text", "visible", "outcome", "reason")
    types = {x.split()[0]: pa.string() if x.split()[0] in text else pa.int32() for x in ACTIONS.split(", ")} | {"families": pa.list_(pa.string())}

    def run(batches):
        for batch in batches:
            out = []
            for key, visible, addition in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                families = None
                try:
                    if visible is None or addition is None:
                        raise ValueError("no statement or no target")
                    families = sorted({name for c in clauses(addition) for name, _ in c.constructions})
                    found = _converted(visible, addition, defs, split_actions, many_groups, most_predicates)
                except (ValueError, KeyError, IndexError) as e:  # what the parsers raise at a text that they can't read
                    found = [{"outcome": "error", "reason": f"{type(e).__name__}: {e}"[:200]}]
                out += [{"row_id": key, "families": families, **a} for a in found]
            yield pa.RecordBatch.from_arrays([pa.array([a.get(name) for a in out], kind) for name, kind in types.items()], names=list(types))

    return rows.select(F.col("id").cast("string").alias("id"), "visible", "target").mapInArrow(run, ACTIONS)


def conversion_counts(actions: DataFrame) -> DataFrame:
    """One row of counters of convert_rows: rows by id, then sums; ids must be unique."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    rows = actions.groupBy("row_id").agg(n("written").alias("written"), n("rejected").alias("rejected"), n("discarded").alias("discarded"), n("unreachable").alias("unreachable"), n("error").alias("error"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("read"),
        total("written").alias("written"),
        total(F.col("written") + F.col("rejected") + F.col("discarded")).alias("actions_seen"),
        total("rejected").alias("actions_rejected"),
        total("discarded").alias("actions_discarded_with_row"),
        total("unreachable").alias("unreachable_actions"),
        F.count_if(F.col("written") > 0).alias("rows_complete"),
        F.count_if(F.col("discarded") > 0).alias("rows_partial"),
        F.count_if(F.col("rejected") > 0).alias("rows_rejected"),
        total("error").alias("errors"),
    )


def conversion_by_family(actions: DataFrame) -> DataFrame:
    """(family, seen, written, rejected, reasons): actions by construction of their row, reasons as `name: count` joined by commas."""
    seen = actions.where(F.col("outcome").isin("written", "rejected", "discarded")).select(F.explode_outer("families").alias("family"), "outcome", "reason")
    seen = seen.withColumn("family", F.coalesce("family", F.lit("unknown")))
    by = seen.groupBy("family", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "written").alias("written"))
    told = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws(": ", "reason", F.col("n").cast("string"))))), ", ")
    return by.groupBy("family").agg(F.sum("n").alias("seen"), F.sum("written").alias("written"), (F.sum("n") - F.sum("written")).alias("rejected"), told.alias("reasons"))
