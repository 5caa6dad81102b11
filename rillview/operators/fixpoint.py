"""Maintains the relations of one strongly connected set: over-delete and re-derive, then semi-naive insertion.

Every round evaluates all rules that a change reaches, keeps only what is new and writes it. A change's rows are counted as they are
written; where they are few, relations are only scanned past them (broadcast semi-joins), never shuffled or written anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillview.plans.compiler import compile_rule
from rillview.plans.terms import Atom, Rule

#: Rows of a change up to which it is broadcast (each has a few columns).
BROADCAST_ROWS = 20_000
#: Bytes of a file, and of a shuffle, that one task reads: rows of few columns are short and compress well, so Spark's own 64 and 128 MB hold many millions of them.
SPLIT, SHUFFLED = 16 << 20, 4 << 20
#: Bytes of the files below a plan for which it has one shuffle partition more (these are coalesced up to SHUFFLED), and the most of them.
SOURCE, MOST = 2 << 20, 20_000
#: Stands for the rows that a re-derivation asks about, as a body atom.
LOST = "@lost"


@dataclass
class Change:
    """Rows with their number; frame is None if there are none."""

    frame: DataFrame | None = None
    rows: int = 0
    path: str = ""


@dataclass(frozen=True)
class Part:
    """Rows below a path that a relation gained (sign 1) or, from the parts before, lost (sign -1)."""

    path: str
    rows: int
    sign: int = 1


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _joined(left: DataFrame, right: DataFrame, rows: int | None, how: str) -> DataFrame:
    other = right.toDF(*[f"n_{c}" for c in right.columns])
    other = F.broadcast(other) if rows is not None and rows <= BROADCAST_ROWS else other
    return left.join(other, [F.col(c.removeprefix("n_")) == F.col(c) for c in other.columns], how)


def without(left: DataFrame, right: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of left that do not stand in right. rows: how many right has, if counted."""
    return _joined(left, right, rows, "left_anti")


def within(left: DataFrame, right: DataFrame, rows: int | None = None) -> DataFrame:
    return _joined(left, right, rows, "left_semi")


def together(changes: list[Change]) -> Change:
    """One change of several. Written ones are read by one scan: a join is planned once, where the branches of a union would each get one, all in the same tasks."""
    if len(changes) == 1:
        return changes[0]
    frames, rows = [c.frame for c in changes], sum(c.rows for c in changes)
    if all(c.path for c in changes):
        return Change(frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[c.path for c in changes]), rows)
    return Change(union(frames), rows)


def _source_bytes(frame: DataFrame) -> int:
    """Bytes below a plan, as far as they are known (of an RDD they are not, which Spark writes as 2^63)."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(n for i in range(leaves.size()) if (n := int(str(leaves.apply(i).stats().sizeInBytes()))) < 1 << 62)


@contextmanager
def bounded(frame: DataFrame) -> Iterator[None]:
    """While it lasts, what a task of the frame's plan reads, and so the memory of its sorts and hash tables, does not grow with the input; the number of tasks does."""
    conf = frame.sparkSession.conf
    have = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
    limits = {"spark.sql.files.maxPartitionBytes": SPLIT, "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLED}
    held = {k: str(v) for k, v in limits.items() if _bytes(frame, conf.get(k)) > v}
    if (need := min(MOST, -(-_source_bytes(frame) // SOURCE))) > have:
        held |= dict.fromkeys(("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"), str(need))
    before = {k: conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _bytes(frame: DataFrame, text: str) -> int:
    return frame.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


@dataclass
class Rounds:
    """Writes what rounds make below a shared folder, so that each plan starts from files: lineage and plans stay short, and a lost executor costs nothing."""

    spark: SparkSession
    folder: str
    made: int = 0
    written: set[str] = field(default_factory=set)

    def read(self, parts: list[Part], like: T.StructType) -> DataFrame | None:
        """The rows of a relation: a scan of all that was gained, past what was lost (few rows, so broadcast)."""
        frame, at = None, 0
        while at < len(parts):
            z = at
            while z < len(parts) and parts[z].sign == parts[at].sign:
                z += 1
            rows = self.spark.read.schema(like).parquet(*[p.path for p in parts[at:z]])
            if parts[at].sign > 0:
                frame = rows if frame is None else frame.unionByName(rows)
            elif frame is not None:
                frame = without(frame, rows, sum(p.rows for p in parts[at:z]))
            at = z
        return frame

    def settle(self, frames: dict[str, DataFrame]) -> dict[str, Change]:
        """Each frame written and counted; those without rows are left out."""
        self.made += bool(frames)
        out = {}
        for p, f in frames.items():
            path, seen = f"{self.folder}/{uuid.uuid4().hex}", Observation()
            self.written.add(path)
            with bounded(f):
                f.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
            if n := seen.get["n"]:
                out[p] = Change(self.spark.read.schema(f.schema).parquet(path), n, path)
        return out

    def fresh(self, seeds: dict[str, list[DataFrame]], known: Callable[[str], tuple[DataFrame, int | None] | None]) -> dict[str, Change]:
        """The distinct rows of the seeds that are not known. known: a relation's rows and their number, if counted.

        The seeds are written first: if they are few, what is known is scanned past them; only many rows are joined by a shuffle."""
        have = {p: k for p in seeds if (k := known(p)) is not None}
        made = self.settle({p: union(f).distinct() for p, f in seeds.items()})
        again = {}
        for p, c in made.items():
            if p not in have:
                continue
            rows, n = have[p]
            if n is not None and n <= BROADCAST_ROWS:
                again[p] = without(c.frame, rows, n)
            elif c.rows <= BROADCAST_ROWS:
                again[p] = without(c.frame, within(rows, c.frame, c.rows), c.rows)
            else:
                again[p] = without(c.frame, rows)
        new = self.settle(again)
        self.made -= bool(again)
        return {p: new[p] if p in have else c for p, c in made.items() if p not in have or p in new}


class Component:
    """One strongly connected set at one poll. old, new: relation -> its rows before and after (sets outside are final)."""

    def __init__(self, names: list[str], old_rules: list[Rule], new_rules: list[Rule], added: list[Rule], removed: list[Rule], old: Callable[[str], DataFrame | None], new: Callable[[str], DataFrame | None], parts: dict[str, list[Part]], schema: Callable[[str], T.StructType], rounds: Rounds):
        self.names, self.rounds = set(names), rounds
        mine = lambda rules: [r for r in rules if r.head.symbol in self.names]
        self.old_rules, self.new_rules, self.added, self.removed = mine(old_rules), mine(new_rules), mine(added), mine(removed)
        self.old, self.new, self.schema = old, new, schema
        self.parts = {p: list(parts.get(p, [])) for p in self.names}

    def state(self, name: str) -> DataFrame | None:
        """The present rows: of the set's own relations as they grow, of others the final ones."""
        if name not in self.names:
            return self.new(name)
        return self.rounds.read(self.parts[name], self.schema(name)) if self.parts[name] else None

    def evaluate(self, rule: Rule, at: int | None, change: Change | None, state: Callable[[str], DataFrame | None]) -> DataFrame | None:
        sources = [change.frame if i == at else state(a.symbol) for i, a in enumerate(rule.body)]
        if any(s is None for s in sources):
            return None
        small = {at} if at is not None and change.rows <= BROADCAST_ROWS else set()
        return compile_rule(rule, sources, at, small)

    def through(self, rules: list[Rule], changes: dict[str, Change], state: Callable[[str], DataFrame | None], whole: set[str] = frozenset()) -> dict[str, list[DataFrame]]:
        """Heads that the changes reach in one step, by relation. whole: relations that had no rows before, so that one place of theirs gives all heads of a rule."""
        out: dict[str, list[DataFrame]] = {}
        for rule in rules:
            places = range(len(rule.body))
            if entire := [i for i in places if rule.body[i].symbol in whole and rule.body[i].symbol in changes]:
                places = [min(entire, key=lambda i: changes[rule.body[i].symbol].rows)]
            for i in places:
                atom = rule.body[i]
                if atom.symbol in changes and (made := self.evaluate(rule, i, changes[atom.symbol], state)) is not None:
                    out.setdefault(rule.head.symbol, []).append(made)
        return out

    def delete(self, base: dict[str, Change], below: dict[str, Change]) -> dict[str, Change]:
        """All that may have lost its ground. base: facts taken back; below: what other sets lost."""
        seeds = self.through(self.old_rules, below, self.old)
        for p, c in base.items():
            seeds.setdefault(p, []).append(c.frame)
        for rule in self.removed:
            if (made := self.evaluate(rule, None, None, self.old)) is not None:
                seeds.setdefault(rule.head.symbol, []).append(made)
        gone: dict[str, list[Change]] = {}
        known = lambda p: (t.frame, t.rows) if p in gone and (t := together(gone[p])) else None
        while seeds:
            fresh = self.rounds.fresh(seeds, known)
            for p, c in fresh.items():
                gone.setdefault(p, []).append(c)
            seeds = self.through(self.old_rules, fresh, self.old)
        return {p: together(c) for p, c in gone.items()}

    def _leave(self, gone: dict[str, Change]) -> None:
        """Takes rows out: few are listed beside the relation, for many it is written anew."""
        few = self.rounds.settle({p: c.frame for p, c in gone.items() if c.rows <= BROADCAST_ROWS and not c.path})
        many = self.rounds.settle({p: without(self.old(p), c.frame) for p, c in gone.items() if c.rows > BROADCAST_ROWS and self.parts[p]})
        for p, c in gone.items():
            if c.rows > BROADCAST_ROWS:
                self.parts[p] = [Part(many[p].path, many[p].rows)] if p in many else []
            elif self.parts[p]:
                self.parts[p].append(Part(c.path or few[p].path, c.rows, -1))

    def run(self, base_plus: dict[str, Change], base_minus: dict[str, Change], plus: dict[str, Change], minus: dict[str, Change], holding: Callable[[str, Change], DataFrame | None]) -> tuple[dict[str, Change], dict[str, Change]]:
        """Changes of this set's relations (rows in, rows out), not yet freed of each other. holding: those of a change's rows that are base facts."""
        gone = self.delete(base_minus, minus) if base_minus or minus or self.removed else {}
        self._leave(gone)
        known_rules = [r for r in self.new_rules if r not in self.added]  # an added rule is evaluated whole below
        seeds = self.through(known_rules, plus, self.state, {p for p in plus if p not in self.names and self.old(p) is None})
        came: dict[str, list[Change]] = {}
        first: dict[str, Change] = {}
        for p, c in base_plus.items():
            if c.path and not self.parts[p] and p not in seeds and not any(r.head.symbol == p for r in [*self.added, *self.new_rules]):
                first[p] = c  # the files of the facts are the relation
            else:
                seeds.setdefault(p, []).append(c.frame)
        for rule in self.added:
            if (made := self.evaluate(rule, None, None, self.state)) is not None:
                seeds.setdefault(rule.head.symbol, []).append(made)
        for p, lost in gone.items():  # what still has ground: rules are asked about the lost rows only
            if (base := holding(p, lost)) is not None:
                seeds.setdefault(p, []).append(base)
            for rule in self.new_rules:
                if rule.head.symbol != p:
                    continue
                asked = Rule(rule.head, [Atom(LOST, rule.head.terms), *rule.body])
                if (made := self.evaluate(asked, 0, lost, self.state)) is not None:
                    seeds.setdefault(p, []).append(made)
        known = lambda p: (s, None) if (s := self.state(p)) is not None else None
        fresh = first
        while seeds or fresh:
            fresh = fresh | self.rounds.fresh(seeds, known) if seeds else fresh
            for p, c in fresh.items():
                came.setdefault(p, []).append(c)
                self.parts[p].append(Part(c.path, c.rows))
            seeds, fresh = self.through(self.new_rules, {p: c for p, c in fresh.items() if p in self.names}, self.state), {}
        return {p: together(c) for p, c in came.items()}, gone
