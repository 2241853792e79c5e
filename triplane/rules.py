"""Rules as plain Python values. A name that begins with ? is a variable, anything else a constant.

    Rule([("?x", "ancestor", "?z")], [("?x", "parent", "?y"), ("?y", "ancestor", "?z")])

Expressions are functions of the variables that return Spark Columns: ``Filter(lambda v: v.age >= 18)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class Variables:
    """Columns of variables by attribute or item; remembers which were asked for."""

    def __init__(self, place: Callable[[str], Column] = F.col) -> None:
        self._place, self._used = place, []

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        name = name.lstrip("?$")
        self._used.append(name)
        return self._place(name)


Expression = Callable[[Variables], Column]


def used(expression: Expression) -> set[str]:
    """Names of the variables in an expression."""
    v = Variables()
    expression(v)
    return set(v._used)


@dataclass(frozen=True)
class Pattern:
    s: object
    p: str
    o: object

    def variables(self) -> list[str]:
        return [name(x) for x in (self.s, self.p, self.o) if is_variable(x)]


@dataclass(frozen=True)
class Path:
    """A sequence of steps from s to o; a step that begins with ^ goes backwards."""

    s: object
    steps: tuple[str, ...]
    o: object

    def variables(self) -> list[str]:
        return [name(x) for x in (self.s, self.o) if is_variable(x)]


@dataclass(frozen=True)
class Filter:
    test: Expression


@dataclass(frozen=True)
class Not:
    """No solution of the inner patterns and filters under what is bound before it."""

    body: tuple

    def __init__(self, *body: object) -> None:
        object.__setattr__(self, "body", tuple(clause(x) for x in body))


@dataclass(frozen=True)
class Set:
    """Binds a variable to a value; a null value drops the row. ``volatile``: a new value for each evaluation;
    ``term``: the value is term text, not a plain value."""

    name: str
    value: Expression
    volatile: bool = False
    term: bool = False


def is_variable(x: object) -> bool:
    return isinstance(x, str) and x[:1] in ("?", "$")


def name(x: object) -> str:
    return str(x)[1:]


def clause(x: object) -> object:
    return Pattern(*x) if isinstance(x, tuple) else x


@dataclass(frozen=True)
class Rule:
    head: tuple[Pattern, ...]
    body: tuple
    label: str = field(default="", compare=False)

    def __init__(self, head: Sequence, body: Sequence = (), label: str = "") -> None:
        object.__setattr__(self, "head", tuple(Pattern(*x) if isinstance(x, tuple) else x for x in ([head] if isinstance(head, tuple) else head)))
        object.__setattr__(self, "body", tuple(clause(x) for x in body))
        object.__setattr__(self, "label", label)

    @property
    def run_once(self) -> bool:
        """Rules that assign and negate, or assign volatile values, run once after the others of their stratum."""
        sets = [x for x in self.body if isinstance(x, Set)]
        return any(x.volatile for x in sets) or bool(sets) and any(isinstance(x, Not) for x in self.body)


@dataclass(frozen=True)
class Transitive:
    predicate: str


def symmetric(p: str) -> list[Rule]:
    return [Rule(("?y", p, "?x"), [("?x", p, "?y")], f"symmetric {p}")]


def inverse(p: str, q: str) -> list[Rule]:
    return [Rule(("?y", q, "?x"), [("?x", p, "?y")], f"{p} to {q}"), Rule(("?y", p, "?x"), [("?x", q, "?y")], f"{q} to {p}")]
