import pytest
from hypothesis import given
from hypothesis import strategies as st

from rillview import Atom, Const, Rule, RuleError, UnsafeRule, Var, parse_program, parse_rule
from rillview.plans.analysis import check_arities, components
from rillview.plans.terms import ArityError

TERM = st.one_of(st.from_regex(r"[a-z][a-z0-9_]{0,4}", fullmatch=True).map(Var), st.integers(-9, 99).map(Const), st.booleans().map(Const), st.text(max_size=6).filter(lambda s: "\0" not in s and "\r" not in s and "\t" not in s).map(Const))


@given(st.lists(st.lists(TERM, min_size=1, max_size=3), min_size=1, max_size=3))
def test_printing_reads_back(body):
    atoms = [Atom(f"r{i}", t) for i, t in enumerate(body)]
    rule = Rule(Atom("h", atoms[0].terms), atoms)
    assert parse_rule(repr(rule)) == rule


def test_builder_and_text_are_one():
    built = Rule(("tc", (Var("x"), Var("z"))), [("e", (Var("x"), Var("y"))), ("tc", (Var("y"), Var("z")))])
    assert parse_rule("tc(?x, ?z) <- [e(?x, ?y), tc(?y, ?z)]") == built
    assert parse_rule("tc(?a, ?c) <- [e(?a, ?b), tc(?b, ?c)]").key() == built.key()
    assert len(parse_program("a(?x) <- [b(?x)], c(1usize, ?x) <- [a(?x)],")) == 2


def test_refused():
    with pytest.raises(UnsafeRule):
        parse_rule("a(?x) <- [b(?y)]")
    with pytest.raises(RuleError):
        parse_rule("a(?x) <- []")
    with pytest.raises(RuleError):
        parse_rule("a(?x) <- b(?x)")
    with pytest.raises(ArityError):
        check_arities(parse_program("a(?x) <- [b(?x)], a(?x, ?x) <- [b(?x)]"), {})


def test_integers_are_not_booleans():
    assert Const(1) != Const(True) and Const(0) != Const(False)


def test_order_of_evaluation():
    found = components(parse_program("p(?x) <- [q(?x)], q(?x) <- [p(?x)], q(?x) <- [e(?x)], r(?x) <- [p(?x)]"), ["lone"])
    assert [set(c) for c in found if set(c) & {"e", "p", "r"}] == [{"e"}, {"p", "q"}, {"r"}]
