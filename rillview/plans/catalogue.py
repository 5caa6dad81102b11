"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillview.functions.folders import scratch
from rillview.operators.view import MaterializedView
from rillview.plans.parser import parse_program
from rillview.plans.terms import ANY
from rillview.sources.tables import RELATIONS, relation
from rillview.streaming.changelog import attach_changelog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TC = "tc(?x, ?y) <- [parent(?x, ?y)], tc(?x, ?z) <- [parent(?x, ?y), tc(?y, ?z)]"
RING_TC = TC.replace("parent", "ring")


def _with(base: tuple[str, ...], sql: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{b} AS ({RELATIONS[b]})" for b in base) + (", " if sql.startswith("@") else " ") + sql.removeprefix("@")


def closure(base: str, condition: str = "", name: str = "tc", source: str | None = None) -> str:
    """SQL text of a transitive closure, to stand among the WITH clauses."""
    source = source or base
    return f"{name}(c0, c1) AS (SELECT c0, c1 FROM {source} UNION SELECT {name}.c0, e.c1 FROM {name} JOIN {source} e ON {name}.c1 = e.c0)"


def _view(spark: SparkSession, sf_dir: str, base: tuple[str, ...], program: str) -> MaterializedView:
    view = MaterializedView(spark, parse_program(program))
    for name in base:
        view.push_df(name, relation(spark, sf_dir, name))
    return view


def rules(name: str, base: tuple[str, ...], program: str, head: str, goal: tuple | None, sql: str, recursive: bool = False) -> None:
    """A query that answers a goal over one poll."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = _view(spark, sf_dir, base, program)
        view.poll()
        return view.query(head, goal)

    QUERIES[name] = run
    ORACLE_SQL[name] = _with(base, sql, recursive)


def steps(name: str, base: tuple[str, ...], sql: str, recursive: bool = True) -> Callable[[Query], Query]:
    """A query of several polls, written as a function."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        ORACLE_SQL[name] = _with(base, sql, recursive)
        return f

    return add


# -- selection, projection, joins -----------------------------------------------------------------------------------
rules("q_project", ("line",), "r(?p) <- [line(?o, ?p, ?s)]", "r", None, "SELECT DISTINCT c1 AS c0 FROM line")
rules("q_permute", ("lives",), "r(?n, ?c, ?s) <- [lives(?c, ?s, ?n)]", "r", None, "SELECT DISTINCT c2 AS c0, c0 AS c1, c1 AS c2 FROM lives")
rules("q_head_const", ("in_region",), 'r("nation", ?n, 7) <- [in_region(?n, ?r)]', "r", None, "SELECT DISTINCT 'nation' AS c0, c0 AS c1, CAST(7 AS BIGINT) AS c2 FROM in_region")
rules("q_const_filter", ("lives",), 'r(?c, ?n) <- [lives(?c, "BUILDING", ?n)]', "r", None, "SELECT DISTINCT c0, c2 AS c1 FROM lives WHERE c1 = 'BUILDING'")
rules("q_repeated_var", ("line",), "r(?o, ?p) <- [line(?o, ?p, ?p)]", "r", None, "SELECT DISTINCT c0, c1 FROM line WHERE c1 = c2")
rules("q_join2", ("placed", "cust"), "r(?o, ?n) <- [placed(?c, ?o), cust(?c, ?n)]", "r", None, "SELECT DISTINCT p.c1 AS c0, c.c1 FROM placed p JOIN cust c ON p.c0 = c.c0")
rules("q_join_star", ("line", "placed", "cust"), "r(?n, ?p) <- [line(?o, ?p, ?s), placed(?c, ?o), cust(?c, ?n)]", "r", None, "SELECT DISTINCT c.c1 AS c0, l.c1 FROM line l JOIN placed p ON l.c0 = p.c1 JOIN cust c ON p.c0 = c.c0")
rules("q_join_multikey", ("line", "placed", "cust", "supp"), "r(?o, ?s, ?n) <- [line(?o, ?p, ?s), placed(?c, ?o), cust(?c, ?n), supp(?s, ?n)]", "r", None, "SELECT DISTINCT l.c0, l.c2 AS c1, c.c1 AS c2 FROM line l JOIN placed p ON l.c0 = p.c1 JOIN cust c ON p.c0 = c.c0 JOIN supp s ON l.c2 = s.c0 AND s.c1 = c.c1")
rules("q_self_join", ("parent",), "r(?x, ?z) <- [parent(?x, ?y), parent(?y, ?z)]", "r", None, "SELECT DISTINCT a.c0, b.c1 FROM parent a JOIN parent b ON a.c1 = b.c0")
rules("q_cross", ("region_key",), "r(?x, ?y) <- [region_key(?x), region_key(?y)]", "r", None, "SELECT a.c0, b.c0 AS c1 FROM region_key a CROSS JOIN region_key b")
rules("q_exists", ("cust", "placed"), "r(?c) <- [cust(?c, ?n), placed(?c, ?o)]", "r", None, "SELECT c0 FROM cust WHERE EXISTS (SELECT 1 FROM placed WHERE placed.c0 = cust.c0)")
rules("q_union_rules", ("cust", "supp"), "r(?n, ?k) <- [cust(?k, ?n)], r(?n, ?k) <- [supp(?k, ?n)]", "r", None, "SELECT c1 AS c0, c0 AS c1 FROM cust UNION SELECT c1, c0 FROM supp")
rules("q_intersect", ("ring", "in_region"), "r(?x, ?y) <- [ring(?x, ?y), in_region(?x, ?y)]", "r", None, "SELECT c0, c1 FROM ring INTERSECT SELECT c0, c1 FROM in_region")
rules("q_triangle", ("ring",), "r(?a, ?b, ?c) <- [ring(?a, ?b), ring(?b, ?c), ring(?c, ?a)]", "r", None, "SELECT DISTINCT x.c0, y.c0 AS c1, z.c0 AS c2 FROM ring x JOIN ring y ON x.c1 = y.c0 JOIN ring z ON y.c1 = z.c0 AND z.c1 = x.c0")
rules("q_triangle_region", ("in_region", "cust", "supp"), "r(?n, ?g) <- [in_region(?n, ?g), cust(?c, ?n), supp(?s, ?n)]", "r", None, "SELECT DISTINCT i.c0, i.c1 FROM in_region i JOIN cust c ON c.c1 = i.c0 JOIN supp s ON s.c1 = i.c0")

# -- recursion ------------------------------------------------------------------------------------------------------
PARENT_TC = "@" + closure("parent") + " SELECT c0, c1 FROM tc"
rules("q_tc_linear_right", ("parent",), TC, "tc", None, PARENT_TC, True)
rules("q_tc_linear_left", ("parent",), "tc(?x, ?y) <- [parent(?x, ?y)], tc(?x, ?z) <- [tc(?x, ?y), parent(?y, ?z)]", "tc", None, PARENT_TC, True)
rules("q_tc_nonlinear", ("parent",), "tc(?x, ?y) <- [parent(?x, ?y)], tc(?x, ?z) <- [tc(?x, ?y), tc(?y, ?z)]", "tc", None, PARENT_TC, True)
rules("q_tc_cyclic", ("ring",), RING_TC, "tc", None, "@" + closure("ring") + " SELECT c0, c1 FROM tc", True)
rules("q_mutual_even_odd", ("ring",), "odd(?x, ?y) <- [ring(?x, ?y)], even(?x, ?z) <- [odd(?x, ?y), ring(?y, ?z)], odd(?x, ?z) <- [even(?x, ?y), ring(?y, ?z)]", "even", None, "@walk(c0, c1, odd) AS (SELECT c0, c1, 1 FROM ring UNION SELECT walk.c0, ring.c1, 1 - odd FROM walk JOIN ring ON walk.c1 = ring.c0) SELECT DISTINCT c0, c1 FROM walk WHERE odd = 0", True)
rules("q_same_generation", ("parent",), "sg(?x, ?y) <- [parent(?x, ?p), parent(?y, ?p)], sg(?x, ?y) <- [parent(?x, ?p), sg(?p, ?q), parent(?y, ?q)]", "sg", None, "@sg(c0, c1) AS (SELECT a.c0, b.c0 FROM parent a JOIN parent b ON a.c1 = b.c1 UNION SELECT a.c0, b.c0 FROM sg JOIN parent a ON a.c1 = sg.c0 JOIN parent b ON b.c1 = sg.c1) SELECT c0, c1 FROM sg", True)
rules("q_rdf_type", ("rdf",), 'type(?o) <- [rdf(?s, "rdf:type", ?o)]', "type", None, "SELECT DISTINCT c2 AS c0 FROM rdf WHERE c1 = 'rdf:type'")
rules("q_rdfs_subclass", ("rdf",), 'sub(?s, ?o) <- [rdf(?s, "rdf:type", ?o)], sub(?s, ?o) <- [rdf(?s, "in", ?o)], sub(?s, ?t) <- [sub(?s, ?o), sub(?o, ?t)]', "sub", None, "@e AS (SELECT c0, c2 AS c1 FROM rdf), " + closure("e") + " SELECT c0, c1 FROM tc", True)
rules("q_view_over_view", ("parent",), TC + ", tc1(97, ?y) <- [tc(97, ?y)]", "tc1", None, "@" + closure("parent") + " SELECT c0, c1 FROM tc WHERE c0 = 97", True)

# -- goals ----------------------------------------------------------------------------------------------------------
_GOALS: dict[str, tuple[str, dict[str, tuple]]] = {
    "region_key": ("", {"f": (ANY,), "b": (3,)}),
    "in_region": ("", {"ff": (ANY, ANY), "bf": (3, ANY), "fb": (ANY, 1), "bb": (3, 4)}),
    "lives": ("", {"fff": (ANY, ANY, ANY), "bff": (7, ANY, ANY), "fbf": (ANY, "MACHINERY", ANY), "ffb": (ANY, ANY, 5), "bbf": (7, "MACHINERY", ANY), "bfb": (7, ANY, 5), "fbb": (ANY, "MACHINERY", 5), "bbb": (7, "MACHINERY", 5)}),
}
for _base, (_, _goals) in _GOALS.items():
    for _kind, _goal in _goals.items():
        _where = " AND ".join(f"c{_i} = {_v!r}" for _i, _v in enumerate(_goal) if _v is not ANY) or "1 = 1"
        rules(f"q_goal_{_kind}", (_base,), f"r({', '.join('?v' + str(_i) for _i in range(len(_goal)))}) <- [{_base}({', '.join('?v' + str(_i) for _i in range(len(_goal)))})]", "r", _goal, f"SELECT * FROM {_base} WHERE {_where}")


def _row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@steps("q_contains", ("parent",), "@" + closure("parent") + " SELECT (SELECT count(*) FROM tc WHERE c0 = 97 AND c1 = 3) > 0 AS has, (SELECT count(*) FROM tc WHERE c0 = 3 AND c1 = 97) > 0 AS has_not")
def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir, ("parent",), TC)
    view.poll()
    return _row(spark, has=view.contains("tc", (97, 3)), has_not=view.contains("tc", (3, 97)))


@steps("q_len", ("ring",), "@" + closure("ring") + " SELECT (SELECT count(*) FROM ring) + (SELECT count(*) FROM tc) AS n")
def _len(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir, ("ring",), RING_TC)
    view.poll()
    return _row(spark, n=len(view)).select(F.col("n").cast("long"))


@steps("q_safe", (), "SELECT true AS at_start, false AS after_push, true AS after_poll", False)
def _safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = MaterializedView(spark)
    start = view.safe()
    view.push_df("ring", relation(spark, sf_dir, "ring"))
    pushed = view.safe()
    view.poll()
    return _row(spark, at_start=start, after_push=pushed, after_poll=view.safe())


ORACLE_SQL["q_safe"] = "SELECT true AS at_start, false AS after_push, true AS after_poll"

# -- changes: the edge (1, 5000000) joins the tree's root to a new node; part 7's edge goes ----------------------------
NEW = "more AS (SELECT c0, c1 FROM parent UNION ALL SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT))"
LESS = "less AS (SELECT c0, c1 FROM parent WHERE c0 <> 7)"
EXTRA = "extra AS (SELECT c0, c1 FROM parent UNION SELECT CAST(28 AS BIGINT), CAST(3 AS BIGINT))"


def _pushed(spark: SparkSession, sf_dir: str) -> MaterializedView:
    view = _view(spark, sf_dir, ("parent",), TC)
    view.poll()
    view.push_fact("parent", (0, -1))
    view.poll()
    return view


def _retracted(spark: SparkSession, sf_dir: str, more: tuple | None = None) -> MaterializedView:
    view = _view(spark, sf_dir, ("parent",), TC)
    if more:
        view.push_fact("parent", more)
    view.poll()
    view.retract_fact("parent", (7, 3))
    view.poll()
    return view


@steps("q_push_consolidated", ("parent",), "@" + NEW + ", " + closure("more") + " SELECT c0, c1 FROM tc")
def _push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pushed(spark, sf_dir).query("tc")


@steps("q_push_frontier", ("parent",), "@" + NEW + ", " + closure("more") + ", " + closure("parent", name="tc_old") + " SELECT c0, c1, CAST(1 AS BIGINT) AS weight FROM (SELECT c0, c1 FROM tc EXCEPT SELECT c0, c1 FROM tc_old) d")
def _push_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pushed(spark, sf_dir).query_frontier("tc")


@steps("q_retract_consolidated", ("parent",), "@" + LESS + ", " + closure("less") + " SELECT c0, c1 FROM tc")
def _retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retracted(spark, sf_dir).query("tc")


@steps("q_retract_frontier", ("parent",), "@" + LESS + ", " + closure("less") + ", " + closure("parent", name="tc_old") + " SELECT c0, c1, CAST(-1 AS BIGINT) AS weight FROM (SELECT c0, c1 FROM tc_old EXCEPT SELECT c0, c1 FROM tc) d")
def _retract_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retracted(spark, sf_dir).query_frontier("tc")


@steps("q_retract_rederive", ("parent",), "@" + EXTRA + ", extra_less AS (SELECT c0, c1 FROM extra WHERE NOT (c0 = 7 AND c1 = 3)), " + closure("extra_less") + " SELECT c0, c1 FROM tc")
def _rederive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retracted(spark, sf_dir, (28, 3)).query("tc")


@steps("q_bag_edb", ("ring",), "@" + closure("ring") + " SELECT c0, c1 FROM tc")
def _bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir, ("ring",), RING_TC)
    view.push_fact("ring", (0, 1))
    view.poll()
    view.retract_fact("ring", (0, 1))
    view.poll()
    return view.query("tc")


RULE1 = "from97(97, ?y) <- [tc(97, ?y)]"


def _rule_pushed(spark: SparkSession, sf_dir: str, again: bool = False) -> MaterializedView:
    view = _view(spark, sf_dir, ("parent",), TC)
    view.poll()
    view.push_rule(RULE1)
    view.poll()
    if again:
        view.retract_rule(RULE1)
        view.poll()
    return view


FROM97 = "@" + closure("parent") + " SELECT c0, c1{} FROM tc WHERE c0 = 97"


@steps("q_push_rule", ("parent",), FROM97.format(""))
def _push_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_pushed(spark, sf_dir).query("from97")


@steps("q_push_rule_frontier", ("parent",), FROM97.format(", CAST(1 AS BIGINT) AS weight"))
def _push_rule_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_pushed(spark, sf_dir).query_frontier("from97")


@steps("q_retract_rule", ("parent",), "SELECT c0, c1 FROM parent WHERE 1 = 0", False)
def _retract_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_pushed(spark, sf_dir, True).query("from97")


@steps("q_retract_rule_frontier", ("parent",), FROM97.format(", CAST(-1 AS BIGINT) AS weight"))
def _retract_rule_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_pushed(spark, sf_dir, True).query_frontier("from97")


@steps("q_stream_changelog", ("did",), "SELECT c0, c1 FROM did", False)
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = MaterializedView(spark, parse_program("active(?u, ?t) <- [did(?u, ?t)]"))
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_type")
    attach_changelog(view, stream, "did", scratch(spark, "stream"), weight=None).awaitTermination()
    return view.query("active")
