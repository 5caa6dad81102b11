"""Rules as data: terms, atoms, rules; they print in the syntax that the parser reads."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class RuleError(ValueError):
    """A rule that cannot be evaluated."""


class UnsafeRule(RuleError):
    """A head variable that no body atom binds."""


class ArityError(RuleError):
    """A relation used with two numbers of columns."""


class TermTypeError(RuleError, TypeError):
    """Columns or constants of different kinds that would have to be equal, or a kind without usable equality."""


class PollingError(RuntimeError):
    """The view was changed since it was last polled."""

    def __init__(self) -> None:
        super().__init__("polling is needed to obtain correct results")


class UnknownRelation(KeyError):
    """No fact and no rule ever named this relation."""


class _Any:
    def __repr__(self) -> str:
        return "ANY"


#: Stands for any value in a goal.
ANY = _Any()


@dataclass(frozen=True)
class Var:
    name: str

    def __repr__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Const:
    value: Any

    def __repr__(self) -> str:
        if isinstance(self.value, bool):
            return str(self.value).lower()
        if isinstance(self.value, str):
            return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        return repr(self.value)

    def key(self) -> tuple:
        """Integers of any width are one constant; true is not 1."""
        kind = "bool" if isinstance(self.value, bool) else "int" if isinstance(self.value, int) else type(self.value).__name__
        return (kind, self.value)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Const) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash(self.key())


Term = Var | Const


@dataclass(frozen=True)
class Atom:
    symbol: str
    terms: tuple[Term, ...]

    def __init__(self, symbol: str, terms: Any):
        object.__setattr__(self, "symbol", symbol)
        object.__setattr__(self, "terms", tuple(terms))
        if not self.terms:
            raise ArityError(f"{symbol}: an atom needs at least one term")
        for t in self.terms:
            if not isinstance(t, Var | Const):
                raise RuleError(f"{symbol}: {t!r} is neither Var nor Const")

    @property
    def variables(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Var)}

    def __repr__(self) -> str:
        return f"{self.symbol}({', '.join(map(repr, self.terms))})"


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]

    def __init__(self, head: Any, body: Any):
        as_atom = lambda a: a if isinstance(a, Atom) else Atom(a[0], a[1])
        object.__setattr__(self, "head", as_atom(head))
        object.__setattr__(self, "body", tuple(as_atom(a) for a in body))
        if not self.body:
            raise RuleError("rule body must be non-empty")
        unbound = self.head.variables - set().union(*(a.variables for a in self.body))
        if unbound:
            raise UnsafeRule(f"{self!r}: the body does not bind {', '.join(sorted('?' + v for v in unbound))}")

    def key(self) -> tuple:
        """The rule with its variables numbered by first occurrence: rules that differ in variable names only are one."""
        seen: dict[str, int] = {}
        term = lambda t: ("v", seen.setdefault(t.name, len(seen))) if isinstance(t, Var) else ("c", t.key())
        return tuple((a.symbol, tuple(term(t) for t in a.terms)) for a in (*self.body, self.head))

    def __repr__(self) -> str:
        return f"{self.head!r} <- [{', '.join(map(repr, self.body))}]"
