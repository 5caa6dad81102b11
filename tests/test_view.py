import random

import pytest

from rillview import ANY, ArityError, MaterializedView, PollingError, TermTypeError, UnknownRelation, parse_program, parse_rule

TC = "tc(?x, ?y) <- [e(?x, ?y)], tc(?x, ?z) <- [e(?x, ?y), tc(?y, ?z)]"


def rows(df):
    return {tuple(r) for r in df.collect()}


def view(spark, program, **facts):
    out = MaterializedView(spark, parse_program(program))
    for name, own in facts.items():
        out.extend_facts((name, f) for f in own)
    return out


def closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


def test_push_and_retract(spark):
    edges = [(1, 2), (1, 5), (2, 3), (3, 4), (4, 5)]
    v = view(spark, TC, e=edges)
    assert not v.safe()
    with pytest.raises(PollingError):
        v.contains("e", (1, 2))
    v.poll()
    assert v.safe() and rows(v.query("tc")) == closure(edges) and len(v) == 15
    assert rows(v.query_frontier("tc")) == {(*r, 1) for r in closure(edges)}
    v.retract_fact("e", (4, 5))
    v.poll()
    left = {(1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (1, 4), (1, 5)}
    assert rows(v.query_binary("tc")) == left  # (1, 5) holds by the direct edge
    assert rows(v.query_frontier_binary("tc")) == {(*r, -1) for r in closure(edges) - left}
    assert rows(v.query_frontier("e")) == {(4, 5, -1)}
    assert v.contains("tc", (1, 4)) and not v.contains("tc", (4, 5)) and not v.contains("nothing", (1,))


def test_rules_come_and_go(spark):
    base, step, goal = "tc(?x, ?y) <- [e(?x, ?y)]", "tc(?x, ?z) <- [e(?x, ?y), tc(?y, ?z)]", "tc1(1, ?x) <- [tc(1, ?x)]"
    v = view(spark, "", e=[(1, 2), (2, 3), (3, 4)])
    v.poll()
    sizes = [len(v)]
    for change, rule in [(v.push_rule, base), (v.push_rule, step), (v.push_rule, goal), (v.retract_rule, goal), (v.retract_rule, step), (v.retract_rule, base)]:
        change(rule)
        assert not v.safe()
        v.poll()
        sizes.append(len(v))
    assert sizes == [3, 6, 9, 12, 9, 6, 3]


def test_shapes(spark):
    v = view(spark, 't(?a, ?b, ?c) <- [e(?a, ?b), e(?b, ?c), e(?c, ?a)], loop(?x) <- [e(?x, ?x)], pair(?x, "k", ?y) <- [u(?x), u(?y)], has(?x) <- [u(?x), e(?a, ?b)], odd(?x, ?y) <- [e(?x, ?y)], even(?x, ?z) <- [odd(?x, ?y), e(?y, ?z)], odd(?x, ?z) <- [even(?x, ?y), e(?y, ?z)], yes(1) <- [e(1, 2)]', e=[(1, 2), (2, 3), (3, 1), (4, 4)], u=[(7,), (8,)])
    v.poll()
    assert rows(v.query_ternary("t")) == {(1, 2, 3), (2, 3, 1), (3, 1, 2), (4, 4, 4)}
    assert rows(v.query_unary("loop")) == {(4,)} and rows(v.query("yes")) == {(1,)}
    assert rows(v.query("pair")) == {(a, "k", b) for a in (7, 8) for b in (7, 8)} and rows(v.query("has")) == {(7,), (8,)}
    assert rows(v.query("even", (1, ANY))) == {(1, 1), (1, 2), (1, 3)}


def test_bags_and_mixed_relations(spark):
    v = view(spark, "p(?x) <- [q(?x)]", q=[(1,), (1,)], p=[(2,)])
    v.retract_fact("q", (3,))
    v.push_fact("q", (3,))
    v.poll()
    assert rows(v.query("p")) == {(1,), (2,)}
    v.retract_fact("q", (1,))
    v.retract_fact("p", (1,))  # p(1) is derived only: it stays
    v.poll()
    assert rows(v.query("p")) == {(1,), (2,)} and rows(v.query_frontier("p")) == set()
    v.retract_fact("q", (1,))
    v.poll()
    assert rows(v.query("p")) == {(2,)}
    rule = parse_rule("p(?x) <- [q(?x)]")
    v.push_rule(rule)
    v.retract_rule(rule)
    v.push_fact("q", (9,))
    v.poll()
    assert rows(v.query("p")) == {(2,), (9,)}


def test_refused_and_empty(spark):
    v = view(spark, "p(?x) <- [q(?x)]")
    v.poll()
    assert rows(v.query("p")) == set()
    with pytest.raises(UnknownRelation):
        v.query("zzz")
    with pytest.raises(ArityError):
        v.push_fact("q", (1, 2))
    for bad in (1.5, None, {}):
        with pytest.raises(TermTypeError):
            v.push_fact("q", (bad,))
    v.push_fact("q", (1,))
    with pytest.raises(TermTypeError):
        v.push_fact("q", ("a",))
    v.poll()
    assert rows(v.query("p", ("never seen",))) == set()
    v.push_df("q", spark.createDataFrame([(5,), (None,)], "x int"))
    v.poll()
    assert rows(v.query("p")) == {(1,), (5,)}


def test_random_changes_equal_a_fresh_view(spark):
    rng = random.Random(4)
    pool = ["tc(?x, ?y) <- [e(?x, ?y)]", "tc(?x, ?z) <- [tc(?x, ?y), tc(?y, ?z)]", "s(?y, ?x) <- [tc(?x, ?y), f(?x)]", "tc(?x, ?x) <- [s(?x, ?y)]"]
    v, edges, active = MaterializedView(spark), {}, {}
    before = set()
    for _ in range(6):
        for _ in range(3):
            e, w = (rng.randrange(4), rng.randrange(4)), rng.choice([1, 1, -1])
            edges[e] = edges.get(e, 0) + w
            (v.push_fact if w > 0 else v.retract_fact)("e", e)
        r, w = rng.choice(pool), rng.choice([1, 1, -1])
        active[r] = active.get(r, 0) + w
        (v.push_rule if w > 0 else v.retract_rule)(r)
        v.push_fact("f", (rng.randrange(4),))
        v.poll()
        fresh = MaterializedView(spark, [r for r, n in active.items() if n > 0])
        fresh.extend_facts(("e", e) for e, n in edges.items() if n > 0)
        fresh.push_df("f", v.query("f"))
        fresh.poll()
        now = rows(v.query("tc")) if "tc" in v.relations else set()
        assert now == (rows(fresh.query("tc")) if "tc" in fresh.relations else set())
        if "tc" in v.relations:
            change = rows(v.query_frontier("tc"))
            assert {r[:2] for r in change if r[2] > 0} == now - before and {r[:2] for r in change if r[2] < 0} == before - now
        before = now


def test_changelog(spark, tmp_path):
    from rillview.streaming.changelog import attach_changelog

    spark.createDataFrame([("e", 1, 2, 1), ("e", 2, 3, 1), ("f", 9, 9, 1)], "rel string, x long, y long, weight long").write.parquet(f"{tmp_path}/in")
    v = MaterializedView(spark, parse_program(TC))
    stream = spark.readStream.schema("rel string, x long, y long, weight long").parquet(f"{tmp_path}/in")
    seen = []
    attach_changelog(v, stream, {"e": ["x", "y"], "f": ["x"]}, f"{tmp_path}/ck", sink=lambda n, f: seen.append((n, f.count())), watched=["tc"]).awaitTermination()
    assert rows(v.query("tc")) == {(1, 2), (2, 3), (1, 3)} and rows(v.query("f")) == {(9,)} and seen == [("tc", 3)]


def test_a_refused_poll_changes_nothing(spark):
    v = view(spark, 'p(?x) <- [e("a", ?x)]')
    v.push_fact("e", (1, 2))  # contradicts the rule's constant, which is known at the poll
    for _ in range(2):
        with pytest.raises(TermTypeError):
            v.poll()
    v.retract_rule('p(?x) <- [e("a", ?x)]')
    v.poll()
    assert rows(v.query("e")) == {(1, 2)}
    v.retract_fact("e", (1, 2))  # pushed once, so one retraction ends it
    v.poll()
    assert rows(v.query("e")) == set() and rows(v.query_frontier("e")) == {(1, 2, -1)}
    with pytest.raises(TermTypeError):
        v.push_rule('q(?x) <- [e("a", ?x)]')  # the types are known now: it does not enter
    v.push_fact("e", (3, 4))
    v.poll()
    assert rows(v.query("e")) == {(3, 4)}


def test_frontiers_of_all_arities_with_goals(spark):
    v = view(spark, "u(?x) <- [t(?x, ?y, ?z)], w(?z, ?y, ?x) <- [t(?x, ?y, ?z)]", t=[(1, 2, 3), (4, 5, 6)])
    v.poll()
    v.retract_fact("t", (1, 2, 3))
    v.push_fact("t", (7, 2, 9))
    v.poll()
    assert rows(v.query_frontier_unary("u")) == {(1, -1), (7, 1)} and rows(v.query_frontier_unary("u", (7,))) == {(7, 1)}
    assert rows(v.query_frontier_ternary("w", (ANY, 2, ANY))) == {(3, 2, 1, -1), (9, 2, 7, 1)} and rows(v.query_frontier_ternary("w", (9, ANY, 7))) == {(9, 2, 7, 1)}
    with pytest.raises(ArityError):
        v.query_frontier_binary("u", (ANY, ANY))


def test_a_small_change_shuffles_no_relation(spark, monkeypatch):
    """The plans that a poll of one fact writes hold exchanges of the change only: nothing but broadcasts and aggregates of few rows."""
    from rillview.operators import fixpoint

    v = view(spark, TC)
    v.push_df("e", spark.range(3000).selectExpr("id AS x", "id div 3 AS y"))
    v.poll()
    size = len(v)
    written, settle = [], fixpoint.Rounds.settle

    def seen(self, frames):
        written.extend(f._jdf.queryExecution().executedPlan().toString() for f in frames.values())
        return settle(self, frames)

    monkeypatch.setattr(fixpoint.Rounds, "settle", seen)
    v.push_fact("e", (9000, 7))
    v.poll()
    assert rows(v.query_frontier("tc")) == {(9000, 7, 1), (9000, 2, 1), (9000, 0, 1)} and len(v) == size + 4
    v.retract_fact("e", (9000, 7))
    v.poll()
    assert len(v) == size and rows(v.query_frontier("e")) == {(9000, 7, -1)}
    assert written and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in written)


def test_changelog_survives_a_new_driver_and_a_failing_batch(spark, tmp_path):
    from rillview.sources.tables import facts, frontier_writer
    from rillview.streaming.changelog import attach_changelog

    put = lambda n, part: spark.createDataFrame(part, "x long, y long, weight long").write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("x long, y long, weight long").parquet(f"{tmp_path}/in")
    program = parse_program(TC)
    put(0, [(1, 2, 1), (2, 3, 1)])
    v = MaterializedView(spark, program)
    attach_changelog(v, read(), "e", f"{tmp_path}/ck", frontier_writer(f"{tmp_path}/out"), ["tc"]).awaitTermination()
    assert rows(facts(spark, f"{tmp_path}/out/tc")) == {(1, 2, 1), (2, 3, 1), (1, 3, 1)}
    put(1, [(3, 4, 1), (1, 2, -1)])
    v2 = MaterializedView(spark, program)  # as after a restart: nothing in memory
    poll, calls = v2._poll, []

    def fails_once(rounds):
        calls.append(1)
        if len(calls) == 2:  # the first poll takes up the manifest
            raise RuntimeError("lost")
        return poll(rounds)

    v2._poll = fails_once
    with pytest.raises(Exception, match="lost"):
        attach_changelog(v2, read(), "e", f"{tmp_path}/ck").awaitTermination()
    attach_changelog(v2, read(), "e", f"{tmp_path}/ck").awaitTermination()
    assert rows(v2.query("e")) == {(2, 3), (3, 4)} and rows(v2.query("tc")) == {(2, 3), (3, 4), (2, 4)}
    v3 = MaterializedView(spark, program)
    attach_changelog(v3, read(), "e", f"{tmp_path}/ck").awaitTermination()
    assert rows(v3.query("tc")) == rows(v2.query("tc"))
    v3.push_fact("e", (1, 2))
    v3.poll()
    assert v3.contains("tc", (1, 4))


def test_retracting_many_rows_joins_them_once(spark, monkeypatch):
    """What was lost in many rounds is read by one scan: no plan holds a join for each round's rows in the same tasks."""
    from rillview.operators import fixpoint

    edges = [(n, n // 2) for n in range(1, 200)]
    v = view(spark, TC, e=edges)
    v.poll()
    monkeypatch.setattr(fixpoint, "BROADCAST_ROWS", 10)
    written, settle = [], fixpoint.Rounds.settle

    def seen(self, frames):
        written.extend(f._jdf.queryExecution().optimizedPlan().toString() for f in frames.values())
        return settle(self, frames)

    monkeypatch.setattr(fixpoint.Rounds, "settle", seen)
    v.retract_fact("e", (3, 1))
    v.poll()
    assert rows(v.query("tc")) == closure([e for e in edges if e != (3, 1)])
    assert max(p.count("Join") for p in written) <= 6


def test_memory_of_a_task_does_not_grow_with_what_is_pushed(spark, tmp_path, monkeypatch):
    """Partitions follow the files below a plan, and settings are as before afterwards; a rule over new relations is joined once."""
    from rillview.operators import fixpoint

    spark.range(40000).selectExpr("id AS x", "id % 1000 AS y").write.parquet(f"{tmp_path}/e")
    spark.range(1000).selectExpr("id AS x", "id % 7 AS y").write.parquet(f"{tmp_path}/f")
    monkeypatch.setattr(fixpoint, "SOURCE", 10_000, raising=False)
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(k, None) for k in keys]
    held, plans, settle, parquet = [], [], fixpoint.Rounds.settle, type(spark.range(0).write).parquet

    def seen(self, frames):
        plans.extend(f._jdf.queryExecution().optimizedPlan().toString() for f in frames.values())
        return settle(self, frames)

    def writes(self, path, *more, **options):
        held.append([spark.conf.get(k, None) for k in keys])
        return parquet(self, path, *more, **options)

    monkeypatch.setattr(fixpoint.Rounds, "settle", seen)
    monkeypatch.setattr(type(spark.range(0).write), "parquet", writes)
    v = MaterializedView(spark, ["r(?x, ?z) <- [e(?x, ?y), f(?y, ?z)]"])
    for name in ("e", "f"):
        v.push_df(name, spark.read.parquet(f"{tmp_path}/{name}"))
    v.poll()
    assert rows(v.query("r")) == {(n, n % 1000 % 7) for n in range(40000)}
    assert max(int(h[0]) for h in held) > 4 and all(h[1] == str(4 << 20) and h[3] == str(16 << 20) for h in held)
    assert [spark.conf.get(k, None) for k in keys] == before
    assert max(p.count("Join") for p in plans) == 1
    v.push_fact("f", (999, 8))
    v.push_fact("e", (-1, 5))
    v.poll()
    assert rows(v.query_frontier("r")) == {(-1, 5, 1), *((n, 8, 1) for n in range(999, 40000, 1000))}
