"""A view that rules define over base facts; facts and rules come and go, poll() brings it up to date.

Base facts are a bag (each has a weight; it holds while its weight is over 0), rules too; the relations are sets. A poll also
leaves the frontier: the rows that came (weight 1) and went (weight -1) with it.

Facts are kept as a log of weighted changes, relations as parts gained and lost; a poll appends to both, and puts them together only
when the parts become many. All of a poll's state is swapped at its end: a poll that fails changes nothing, and what was pushed
stays pending. A DataFrame from query() or query_frontier() reads files that live until the end of the second poll after it;
write it or query again to keep the rows longer.
"""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillview.functions.folders import remove, scratch
from rillview.operators.fixpoint import BROADCAST_ROWS, Change, Component, Part, Rounds, union, within, without
from rillview.plans.analysis import check_arities, column_type, components, infer_types, value_type
from rillview.plans.compiler import columns, empty, literal
from rillview.plans.parser import parse_rule
from rillview.plans.terms import ANY, ArityError, PollingError, Rule, TermTypeError, UnknownRelation

log = logging.getLogger(__name__)
EMPTY_PROGRAM: list[Rule] = []
#: Files' folders that a relation is read from before they are put together.
PARTS = 32


@dataclass
class PollStats:
    seconds: float
    rounds: int
    changed: dict[str, tuple[int, int]]


@dataclass
class Relation:
    arity: int
    types: list[T.DataType] | None = None
    base: list[Part] = field(default_factory=list)  # a log: columns and weight
    rows: list[Part] = field(default_factory=list)
    frontier: DataFrame | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, t) for c, t in zip(columns(self.arity), self.types, strict=True)])


class MaterializedView:
    def __init__(self, spark: SparkSession, program: Iterable[Rule | str] = EMPTY_PROGRAM):
        self.spark = spark
        self.relations: dict[str, Relation] = {}
        self._rules: dict[tuple, tuple[Rule, int]] = {}
        self._facts: dict[str, list[tuple[tuple, int]]] = {}
        self._frames: dict[str, list[tuple[DataFrame, int | None]]] = {}
        self._pending_rules: Counter = Counter()
        self._seen_rules: dict[tuple, Rule] = {}
        self._safe = True
        self._folder: str | None = None
        self._old: set[str] = set()
        #: files that nothing reads any more; kept until sweep() if `durable`
        self._garbage: set[str] = set()
        self.durable = False
        self.push_rules(program)

    # -- changes -------------------------------------------------------------------------------------------------
    def _relation(self, name: str, arity: int) -> Relation:
        relation = self.relations.setdefault(name, Relation(arity))
        if relation.arity != arity:
            raise ArityError(f"{name} has {relation.arity} columns, not {arity}")
        return relation

    def _type(self, name: str, types: list[T.DataType]) -> None:
        relation = self._relation(name, len(types))
        if relation.types is None:
            relation.types = types
        elif relation.types != types:
            raise TermTypeError(f"{name} has the columns {[t.simpleString() for t in relation.types]}, not {[t.simpleString() for t in types]}")

    def push_fact(self, name: str, fact: tuple) -> None:
        self._change(name, fact, 1)

    def retract_fact(self, name: str, fact: tuple) -> None:
        self._change(name, fact, -1)

    def _change(self, name: str, fact: tuple, weight: int) -> None:
        fact = tuple(fact)
        self._type(name, [value_type(v) for v in fact])
        self._facts.setdefault(name, []).append((fact, weight))
        self._safe = False

    def extend_facts(self, facts: Iterable[tuple[str, tuple]]) -> None:
        for name, fact in facts:
            self.push_fact(name, fact)

    def push_df(self, name: str, df: DataFrame, weight: int | None = 1) -> None:
        """All rows of df as facts; with weight None its column `weight` says how often each is pushed (or, below 0, retracted). Rows with a NULL are left out: NULL is no term."""
        terms = [f for f in df.schema.fields if weight is not None or f.name != "weight"]
        types = [column_type(f.dataType) for f in terms]
        self._type(name, types)
        names = columns(len(types))
        frame = df.select(*[F.col(f"`{f.name}`").cast(t).alias(c) for f, t, c in zip(terms, types, names, strict=True)], (F.col("weight") if weight is None else F.lit(weight)).cast("long").alias("weight"))
        self._frames.setdefault(name, []).append((frame.dropna(subset=names), weight))
        self._safe = False

    def retract_df(self, name: str, df: DataFrame) -> None:
        self.push_df(name, df, -1)

    def push_rule(self, rule: Rule | str) -> None:
        self._change_rule(rule, 1)

    def retract_rule(self, rule: Rule | str) -> None:
        self._change_rule(rule, -1)

    def push_rules(self, rules: Iterable[Rule | str]) -> None:
        for rule in rules:
            self.push_rule(rule)

    def _change_rule(self, rule: Rule | str, weight: int) -> None:
        rule = parse_rule(rule) if isinstance(rule, str) else rule
        for name, arity in check_arities([rule], {n: r.arity for n, r in self.relations.items()}).items():
            self._relation(name, arity)
        if weight > 0:  # a rule that contradicts known column types does not enter
            active = [self._seen_rules[k] for k in {*self._rules, *self._pending_rules} if self._rules.get(k, (None, 0))[1] + self._pending_rules[k] > 0]
            infer_types([*active, rule], self._types())
        self._seen_rules.setdefault(rule.key(), rule)
        self._pending_rules[rule.key()] += weight
        self._safe = False

    # -- poll ----------------------------------------------------------------------------------------------------
    def _pending(self, name: str) -> DataFrame | None:
        """The net weights that were pushed to a relation since the last poll."""
        relation, frames = self.relations[name], [f for f, _ in self._frames.get(name, [])]
        if facts := self._facts.get(name):
            net: Counter = Counter()
            for fact, weight in facts:
                net[fact] += weight
            names = columns(relation.arity)
            schema = T.StructType([*[T.StructField(c, t) for c, t in zip(names, relation.types, strict=True)], T.StructField("weight", T.LongType())])
            frames.append(self.spark.createDataFrame([(*f, w) for f, w in net.items()], schema))
        if not frames:
            return None
        return union(frames).groupBy(*columns(relation.arity)).agg(F.sum("weight").alias("weight")).filter("weight <> 0")

    def _types(self) -> dict[str, list[T.DataType]]:
        return {n: r.types for n, r in self.relations.items() if r.types is not None}

    @contextmanager
    def undone_on_error(self) -> Iterator[None]:
        """What is pushed and retracted within goes again if an error leaves it."""
        kept = {n: list(f) for n, f in self._facts.items()}, {n: list(f) for n, f in self._frames.items()}, Counter(self._pending_rules), self._safe
        try:
            yield
        except BaseException:
            self._facts, self._frames, self._pending_rules, self._safe = kept
            raise

    def _apply_base(self, rounds: Rounds) -> tuple[dict[str, Change], dict[str, Change], dict[str, list[Part]]]:
        """The base facts that begin and cease to hold with the pending weights, and the logs with these."""
        plus, minus, logs = {}, {}, {}
        for name in sorted({*self._facts, *self._frames}):
            relation, names = self.relations[name], columns(self.relations[name].arity)
            settled = rounds.settle({name: pending}) if (pending := self._pending(name)) is not None else {}
            if name not in settled:
                continue
            new = settled[name]
            logs[name] = [*relation.base, Part(new.path, new.rows)]
            if not relation.base:
                held = new.frame.agg(F.count_if(F.expr("weight > 0")).alias("p")).first()["p"]
                if held:
                    plus[name] = Change(new.frame.filter("weight > 0").select(*names), held, new.path if held == new.rows else "")
                continue
            # of the log only the rows of the changed facts
            old = self._net(within(self._log(relation, relation.base), new.frame.select(*names), new.rows), names).toDF(*[f"o_{c}" for c in names], "before")
            changed = new.frame.join(old, [F.col(c) == F.col(f"o_{c}") for c in names], "left").select(*names, "weight", F.coalesce("before", F.lit(0)).cast("long").alias("before"))
            moved = changed.filter("(before > 0) <> (before + weight > 0)").select(*names, F.expr("before <= 0").alias("came"))
            for c in rounds.settle({name: moved}).values():
                came = c.frame.agg(F.count_if("came").alias("n")).first()["n"]
                for side, n, rows in ((plus, came, "came"), (minus, c.rows - came, "NOT came")):
                    if n:
                        side[name] = Change(c.frame.filter(rows).select(*names), n, c.path if n == c.rows else "")
            if len(logs[name]) > PARTS:
                logs[name] = [Part(c.path, c.rows) for c in rounds.settle({name: self._net(self._log(relation, logs[name]), names).filter("weight <> 0")}).values()]
        return plus, minus, logs

    def _log(self, relation: Relation, log: list[Part]) -> DataFrame:
        return self.spark.read.schema(T.StructType([*relation.schema.fields, T.StructField("weight", T.LongType())])).parquet(*[p.path for p in log])

    def _net(self, log: DataFrame, names: list[str]) -> DataFrame:
        return log.groupBy(*names).agg(F.sum("weight").alias("weight"))

    def poll(self) -> PollStats:
        """Brings all relations up to date. Raises and changes nothing if the rules contradict each other's or the facts' types."""
        began = time.time()
        self._folder = self._folder or scratch(self.spark, "view")
        rounds = Rounds(self.spark, self._folder)
        try:
            stats = self._poll(rounds)
        except BaseException:
            self._garbage |= rounds.written
            raise
        finally:
            if not self.durable:
                self.sweep()
        stats.seconds = time.time() - began
        log.info("poll: %.0f ms, %d rounds", stats.seconds * 1000, stats.rounds)
        return stats

    def sweep(self) -> None:
        """Deletes the files that nothing reads any more."""
        while self._garbage:
            remove(self.spark, self._garbage.pop())

    def _poll(self, rounds: Rounds) -> PollStats:
        used = self._paths()
        was = {k for k, (_, n) in self._rules.items() if n > 0}
        counts = dict(self._rules)
        for key, weight in self._pending_rules.items():
            counts[key] = (self._seen_rules[key], counts.get(key, (None, 0))[1] + weight)
        now = {k for k, (_, n) in counts.items() if n > 0}
        rule = self._seen_rules
        old_rules, new_rules = [rule[k] for k in counts if k in was], [rule[k] for k in counts if k in now]
        added, removed = [rule[k] for k in counts if k in now - was], [rule[k] for k in counts if k in was - now]
        types = infer_types(new_rules, self._types())
        # nothing of the view changes before the end
        base_plus, base_minus, logs = self._apply_base(rounds)
        before = {n: list(r.rows) for n, r in self.relations.items()}
        after = {n: list(p) for n, p in before.items()}
        schema = lambda n: T.StructType([T.StructField(c, t) for c, t in zip(columns(self.relations[n].arity), types[n], strict=True)])
        old = lambda n: rounds.read(before[n], schema(n)) if before.get(n) else None
        new = lambda n: rounds.read(after[n], schema(n)) if after.get(n) else None

        def holding(name: str, rows: Change) -> DataFrame | None:
            relation = self.relations[name]
            if not (log := logs.get(name, relation.base)):
                return None
            names = columns(relation.arity)
            return self._net(within(self._log(relation, log), rows.frame, rows.rows), names).filter("weight > 0").select(*names)

        plus: dict[str, Change] = {}
        minus: dict[str, Change] = {}
        for names in components([*old_rules, *added], self.relations):
            reads = {a.symbol for r in [*old_rules, *added] if r.head.symbol in names for a in r.body}
            touched = any(n in base_plus or n in base_minus for n in names) or any(n in plus or n in minus for n in reads) or any(r.head.symbol in names for r in [*added, *removed])
            if not touched:
                continue
            own = Component(names, old_rules, new_rules, added, removed, old, new, before, schema, rounds)
            pick = lambda changes, of: {n: c for n, c in changes.items() if n in of}
            came, gone = own.run(pick(base_plus, names), pick(base_minus, names), pick(plus, reads), pick(minus, reads), holding)
            for n in {*came, *gone}:
                if n not in gone:
                    plus[n] = came[n]
                elif n not in came:
                    minus[n] = gone[n]
                else:  # what went and came back is no change
                    net = {"-": without(gone[n].frame, came[n].frame, came[n].rows), "+": without(came[n].frame, gone[n].frame, gone[n].rows)}
                    for sign, c in rounds.settle(net).items():
                        (plus if sign == "+" else minus)[n] = c
                after[n] = own.parts[n]
                lost = sum(p.rows for p in after[n] if p.sign < 0)
                if len(after[n]) > PARTS or lost > BROADCAST_ROWS:
                    after[n] = [Part(c.path, c.rows) for c in rounds.settle({n: own.state(n).repartition(*columns(self.relations[n].arity))}).values()]
        frontiers = {n: union([c.frame.withColumn("weight", F.lit(w).cast("long")) for c, w in ((plus.get(n), 1), (minus.get(n), -1)) if c]) for n in {*plus, *minus}}
        # the swap
        for n, relation in self.relations.items():
            relation.types, relation.base, relation.rows, relation.frontier = types.get(n), logs.get(n, relation.base), after[n], frontiers.get(n)
        self._rules = counts
        self._facts, self._frames, self._pending_rules, self._safe = {}, {}, Counter(), True
        # the last poll's files that nothing reads any more; this poll's stay for the frontier
        self._garbage |= (used | self._old) - self._paths() - rounds.written
        self._old = rounds.written
        return PollStats(0.0, rounds.made, {n: (plus[n].rows if n in plus else 0, minus[n].rows if n in minus else 0) for n in frontiers})

    def _paths(self) -> set[str]:
        return {p.path for r in self.relations.values() for p in [*r.rows, *r.base]}

    def _rows(self, relation: Relation) -> DataFrame | None:
        return Rounds(self.spark, "").read(relation.rows, relation.schema) if relation.rows else None

    # -- reading -------------------------------------------------------------------------------------------------
    def _known(self, name: str) -> Relation:
        if name not in self.relations:
            raise UnknownRelation(name)
        return self.relations[name]

    def _matching(self, frame: DataFrame | None, relation: Relation, goal: tuple | None, weight: bool) -> DataFrame:
        if frame is None:
            frame = empty(self.spark, relation.types or [T.StringType()] * relation.arity)
            frame = frame.withColumn("weight", F.lit(0).cast("long")) if weight else frame
        goal = (ANY,) * relation.arity if goal is None else tuple(goal)
        if len(goal) != relation.arity:
            raise ArityError(f"the relation has {relation.arity} columns, the goal {len(goal)}")
        for i, value in enumerate(goal):
            if value is ANY:
                continue
            same = relation.types is not None and value_type(value) == relation.types[i]
            frame = frame.filter(F.col(f"c{i}") == literal(value) if same else F.lit(False))  # a value of another kind never stands there
        return frame

    def query(self, name: str, goal: tuple | None = None) -> DataFrame:
        """The rows that match the goal (None: all), columns c0, c1, ..."""
        if not self._safe:
            raise PollingError
        relation = self._known(name)
        return self._matching(self._rows(relation), relation, goal, False)

    def query_frontier(self, name: str, goal: tuple | None = None) -> DataFrame:
        """The last poll's changes that match: the columns and weight, 1 or -1."""
        if not self._safe:
            raise PollingError
        relation = self._known(name)
        return self._matching(relation.frontier, relation, goal, True)

    def _of_arity(self, name: str, goal: tuple, n: int, frontier: bool) -> DataFrame:
        if self._known(name).arity != n:
            raise ArityError(f"{name} has {self.relations[name].arity} columns, not {n}")
        return (self.query_frontier if frontier else self.query)(name, goal)

    def query_unary(self, name: str, goal: tuple = (ANY,)) -> DataFrame:
        return self._of_arity(name, goal, 1, False)

    def query_binary(self, name: str, goal: tuple = (ANY, ANY)) -> DataFrame:
        return self._of_arity(name, goal, 2, False)

    def query_ternary(self, name: str, goal: tuple = (ANY, ANY, ANY)) -> DataFrame:
        return self._of_arity(name, goal, 3, False)

    def query_frontier_unary(self, name: str, goal: tuple = (ANY,)) -> DataFrame:
        return self._of_arity(name, goal, 1, True)

    def query_frontier_binary(self, name: str, goal: tuple = (ANY, ANY)) -> DataFrame:
        return self._of_arity(name, goal, 2, True)

    def query_frontier_ternary(self, name: str, goal: tuple = (ANY, ANY, ANY)) -> DataFrame:
        return self._of_arity(name, goal, 3, True)

    def contains(self, name: str, fact: tuple) -> bool:
        if not self._safe:
            raise PollingError
        relation: Any = self.relations.get(name)
        if relation is None or relation.arity != len(fact):
            return False
        return not self._matching(self._rows(relation), relation, tuple(fact), False).limit(1).isEmpty()

    def safe(self) -> bool:
        return self._safe

    def __len__(self) -> int:
        return sum(self._rows(r).count() for r in self.relations.values() if r.rows)
