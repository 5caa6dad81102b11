"""Incrementally maintained rule views on Spark."""

from rillview.operators.view import EMPTY_PROGRAM, MaterializedView, PollStats
from rillview.plans.parser import parse_program, parse_rule
from rillview.plans.terms import ANY, ArityError, Atom, Const, PollingError, Rule, RuleError, TermTypeError, UnknownRelation, UnsafeRule, Var

__all__ = ["ANY", "EMPTY_PROGRAM", "ArityError", "Atom", "Const", "MaterializedView", "PollStats", "PollingError", "Rule", "RuleError", "TermTypeError", "UnknownRelation", "UnsafeRule", "Var", "parse_program", "parse_rule"]
