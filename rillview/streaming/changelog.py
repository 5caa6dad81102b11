"""A stream of changes as the view's input: every micro-batch is pushed and polled.

The view's own files and, after each batch, a small manifest of them stand beside the stream's checkpoint. After a restart of the
driver a new view takes up the last manifest, so it holds exactly the batches that the checkpoint counts as read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillview.functions.folders import names_in, read_text, remove, write_text
from rillview.operators.fixpoint import Part
from rillview.operators.view import MaterializedView, Relation
from rillview.plans.parser import parse_rule


def save(view: MaterializedView, folder: str, batch: int) -> None:
    """Writes the manifest of a batch, then deletes older ones and the files that only they need."""
    state = {
        "batch": batch, "rules": [[repr(rule), n] for rule, n in view._rules.values()],
        "relations": {n: {"arity": r.arity, "types": None if r.types is None else [t.jsonValue() for t in r.types], "base": [[p.path, p.rows, p.sign] for p in r.base], "rows": [[p.path, p.rows, p.sign] for p in r.rows]} for n, r in view.relations.items()},
    }
    write_text(view.spark, f"{folder}/{batch:012d}.json", json.dumps(state))
    for name in names_in(view.spark, folder):
        if name.endswith(".json") and name < f"{batch:012d}.json":
            remove(view.spark, f"{folder}/{name}")
    view.sweep()


def restore(view: MaterializedView, folder: str) -> int:
    """Takes up the last manifest, if there is one; its batch, or -1."""
    names = sorted(n for n in names_in(view.spark, folder) if n.endswith(".json"))
    if not names:
        return -1
    state = json.loads(read_text(view.spark, f"{folder}/{names[-1]}"))
    parts = lambda rows: [Part(*r) for r in rows]
    for name, r in state["relations"].items():
        types = None if r["types"] is None else [T.StructField.fromJson({"name": "c", "type": t, "nullable": True, "metadata": {}}).dataType for t in r["types"]]
        view.relations[name] = Relation(r["arity"], types, parts(r["base"]), parts(r["rows"]))
    wanted = {k: n for k, n in view._pending_rules.items() if n}
    held = [(parse_rule(text), n) for text, n in state["rules"]]
    view._rules = {rule.key(): (rule, n) for rule, n in held}
    view._seen_rules |= {rule.key(): rule for rule, _ in held}
    # the program that the new view was made with is the stream's: what the manifest has of it is not pushed again
    for key, n in wanted.items():
        view._pending_rules[key] = n - view._rules.get(key, (None, 0))[1]
    for key, (_, n) in view._rules.items():
        if key not in wanted:
            view._pending_rules[key] = -n
    view._safe = False
    view.poll()
    return state["batch"]


def attach_changelog(view: MaterializedView, stream: DataFrame, relations: dict[str, list[str]] | str, checkpoint: str, sink: Callable[[str, DataFrame], None] | None = None, watched: Iterable[str] = (), weight: str | None = "weight") -> StreamingQuery:
    """Reads what is available. relations: a relation's name (all columns but the weight are its terms), or for a mixed log with a
    column `rel` the columns of each relation. weight: the column of weights, None if all rows are pushes. sink gets the frontier of each
    watched relation after each batch (again, if a batch comes again). The view should have its rules and no facts of its own: a new
    one is brought to the state of the checkpoint first. A batch that fails leaves the view as it was; one that comes again after
    it was counted is left out."""
    folder = f"{checkpoint.rstrip('/')}/view"
    if not view.durable:
        view.durable, view._folder = True, f"{folder}/rows"
        view.last_batch = restore(view, folder)

    def batch(rows: DataFrame, number: int) -> None:
        if number <= view.last_batch:
            return
        rows = rows.withColumn("weight", F.col(weight) if weight else F.lit(1)).persist()
        try:
            with view.undone_on_error():
                if isinstance(relations, str):
                    view.push_df(relations, rows, None)
                else:
                    for name, terms in relations.items():
                        view.push_df(name, rows.filter(F.col("rel") == name).select(*terms, "weight"), None)
                view.poll()
        finally:
            rows.unpersist()
        view.last_batch = number
        save(view, folder, number)
        for name in watched if sink else ():
            sink(name, view.query_frontier(name))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
