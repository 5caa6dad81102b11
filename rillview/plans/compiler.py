"""A rule as a DataFrame: filters, renamed columns, equi-joins on shared variables, a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillview.plans.analysis import value_type
from rillview.plans.terms import Atom, Const, Rule


def columns(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def literal(value):
    return F.lit(value).cast(value_type(value))


def atom_frame(atom: Atom, source: DataFrame, place: int) -> DataFrame:
    """One column for each variable, named for the atom's place, so that attributes never meet twice."""
    frame = source.toDF(*[f"p{place}_{i}" for i in range(len(atom.terms))])
    first: dict[str, str] = {}
    for i, term in enumerate(atom.terms):
        own = f"p{place}_{i}"
        if isinstance(term, Const):
            frame = frame.filter(F.col(own) == literal(term.value))
        elif term.name in first:
            frame = frame.filter(F.col(own) == F.col(first[term.name]))
        else:
            first[term.name] = own
    if not first:  # a ground atom: at most one row, which holds or not
        return frame.select(F.lit(True).alias(f"p{place}_g")).limit(1)
    return frame.select(*[F.col(c).alias(f"p{place}:{v}") for v, c in first.items()])


def join_order(rule: Rule, first: int | None) -> list[int]:
    """Atoms as they are joined: the changed one first, then those that share most with what is bound, cross joins last."""
    left = list(range(len(rule.body)))
    score = lambda i: (len([t for t in rule.body[i].terms if isinstance(t, Const)]), -i)
    order = [first if first is not None else max(left, key=score)]
    left.remove(order[0])
    bound = set(rule.body[order[0]].variables)
    while left:
        best = max(left, key=lambda i: (len(rule.body[i].variables & bound), *score(i)))
        order.append(best)
        left.remove(best)
        bound |= rule.body[best].variables
    return order


def compile_rule(rule: Rule, sources: list[DataFrame], changed: int | None = None, small: set[int] = frozenset()) -> DataFrame:
    """The rule's heads, which may repeat. sources: for each body atom; changed: the place of the atom that stands for a change; small: places whose counted size allows a broadcast."""
    order = join_order(rule, changed)
    needed_after: list[set[str]] = []
    later = set(rule.head.variables)
    for i in reversed(order):
        needed_after.insert(0, set(later))
        later |= rule.body[i].variables
    frame, bound = None, {}
    for k, i in enumerate(order):
        atom = rule.body[i]
        right = atom_frame(atom, sources[i], i)
        own = {v: f"p{i}:{v}" for v in atom.variables}
        if frame is None:
            frame, bound = right, dict(own)
        else:
            shared = sorted(set(own) & set(bound))
            fresh = (set(own) - set(bound)) & needed_after[k]
            right = right.select(*[F.col(f"`{own[v]}`") for v in [*shared, *sorted(fresh)]]) if own else right
            if i in small:
                right = F.broadcast(right)
            on = [F.col(f"`{bound[v]}`") == F.col(f"`{own[v]}`") for v in shared]
            if not fresh and shared:
                frame = frame.join(right, on, "left_semi")
            elif not shared and not fresh:  # only whether it holds at all
                frame = frame.crossJoin(right.limit(1).select(F.lit(True).alias(f"p{i}_any")))
            else:
                if order[0] in small and k == 1:
                    frame = F.broadcast(frame)
                frame = frame.join(right, on, "inner") if shared else frame.crossJoin(right)
                bound |= {v: own[v] for v in fresh}
        live = [v for v in bound if v in needed_after[k]]
        if live:
            dropped = len(live) < len(bound)
            frame = frame.select(*[F.col(f"`{bound[v]}`") for v in live])
            if dropped and k + 1 < len(order):
                frame = frame.distinct()  # variables died: fewer rows enter the next join
        bound = {v: bound[v] for v in live}
    head = [literal(t.value) if isinstance(t, Const) else F.col(f"`{bound[t.name]}`") for t in rule.head.terms]
    return frame.select(*[h.alias(c) for h, c in zip(head, columns(len(head)), strict=True)])


def empty(spark, types: list[T.DataType]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in zip(columns(len(types)), types, strict=True)]))
