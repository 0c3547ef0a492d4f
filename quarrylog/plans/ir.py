"""Logic programs as data: terms, formulas, rules and queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Union


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: int | float | str


@dataclass(frozen=True)
class Wild:
    """A column that is not looked at."""


@dataclass(frozen=True)
class Arith:
    """left op right; op is one of + - * / % (+ joins strings), or neg with right None."""

    op: str
    left: "Term"
    right: "Term | None"


Term = Union[Var, Const, Wild, Arith]


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[Term, ...]

    @property
    def key(self) -> tuple[str, int]:
        return self.pred, len(self.args)


@dataclass(frozen=True)
class NamedAtom:
    """An atom that names some columns of a stored relation; the others are wild."""

    pred: str
    args: tuple[tuple[str, Term], ...]


@dataclass(frozen=True)
class Cmp:
    op: str  # = != < > <= >=
    left: Term
    right: Term


@dataclass(frozen=True)
class Builtin:
    """A scalar function as a relation: inputs, and a result unless it is a test."""

    name: str
    inputs: tuple[Term, ...]
    result: Term | None


@dataclass(frozen=True)
class Not:
    body: tuple["Formula", ...]


@dataclass(frozen=True)
class Or:
    branches: tuple[tuple["Formula", ...], ...]


@dataclass(frozen=True)
class Exists:
    names: tuple[str, ...]
    body: tuple["Formula", ...]


@dataclass(frozen=True)
class Forall:
    """For all values of names with guard, body holds; ``some`` asks for one such value too (forex)."""

    names: tuple[str, ...]
    guard: tuple["Formula", ...]
    body: tuple["Formula", ...]
    some: bool = False


@dataclass(frozen=True)
class If:
    test: tuple["Formula", ...]
    then: tuple["Formula", ...]
    other: tuple["Formula", ...]


@dataclass(frozen=True)
class Truth:
    """any() or none()."""

    value: bool


@dataclass(frozen=True)
class Agg:
    """result = func(names | body | expr), grouped by the variables that body shares with its surroundings."""

    func: str
    names: tuple[str, ...]
    body: tuple["Formula", ...]
    expr: Term | None
    result: Term
    separator: str = ","


@dataclass(frozen=True)
class Closure:
    """pred+(left, right), or pred*(left, right) if reflexive."""

    pred: str
    left: Term
    right: Term
    reflexive: bool = False


Formula = Union[Atom, NamedAtom, Cmp, Builtin, Not, Or, Exists, Forall, If, Truth, Agg, Closure]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Formula, ...] = ()


@dataclass(frozen=True)
class Query:
    select: tuple[tuple[Term, str | None], ...]
    body: tuple[Formula, ...]


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)
    query: Query | None = None


class LogicError(ValueError):
    """A program that is not safe, not stratified, or refers to what is not there."""


def term_vars(t: Term | None) -> Iterator[str]:
    if isinstance(t, Var):
        yield t.name
    elif isinstance(t, Arith):
        yield from term_vars(t.left)
        yield from term_vars(t.right)


def free_vars(f: Formula) -> set[str]:
    """Variables that a formula shares with its surroundings, by name."""
    if isinstance(f, Atom):
        return {v for a in f.args for v in term_vars(a)}
    if isinstance(f, NamedAtom):
        return {v for _, a in f.args for v in term_vars(a)}
    if isinstance(f, (Cmp, Closure)):
        return {*term_vars(f.left), *term_vars(f.right)}
    if isinstance(f, Builtin):
        return {v for a in (*f.inputs, f.result) for v in term_vars(a)}
    if isinstance(f, Not):
        return body_vars(f.body)
    if isinstance(f, Or):
        return set().union(*map(body_vars, f.branches))
    if isinstance(f, Exists):
        return body_vars(f.body) - set(f.names)
    if isinstance(f, Forall):
        return (body_vars(f.guard) | body_vars(f.body)) - set(f.names)
    if isinstance(f, If):
        return body_vars(f.test) | body_vars(f.then) | body_vars(f.other)
    if isinstance(f, Agg):
        inner = body_vars(f.body) | set(term_vars(f.expr))
        return (inner - set(f.names)) | set(term_vars(f.result))
    return set()


def body_vars(body: tuple[Formula, ...]) -> set[str]:
    return set().union(*map(free_vars, body)) if body else set()


def subformulas(f: Formula) -> tuple[tuple[Formula, ...], ...]:
    """The bodies within a formula."""
    if isinstance(f, (Not, Exists, Agg)):
        return (f.body,)
    if isinstance(f, Or):
        return f.branches
    if isinstance(f, Forall):
        return f.guard, f.body
    if isinstance(f, If):
        return f.test, f.then, f.other
    return ()


def rename_term(t, names: dict[str, str]):
    if isinstance(t, Var):
        return Var(names.get(t.name, t.name))
    if isinstance(t, Arith):
        return Arith(t.op, rename_term(t.left, names), rename_term(t.right, names))
    return t


def rename(f: Formula, names: dict[str, str]) -> Formula:
    """The formula with free variables renamed."""
    body = lambda b, m=names: tuple(rename(x, m) for x in b)
    if isinstance(f, Atom):
        return Atom(f.pred, tuple(rename_term(a, names) for a in f.args))
    if isinstance(f, NamedAtom):
        return NamedAtom(f.pred, tuple((c, rename_term(a, names)) for c, a in f.args))
    if isinstance(f, (Cmp, Closure)):
        return replace(f, left=rename_term(f.left, names), right=rename_term(f.right, names))
    if isinstance(f, Builtin):
        return Builtin(f.name, tuple(rename_term(a, names) for a in f.inputs), rename_term(f.result, names))
    if isinstance(f, Not):
        return Not(body(f.body))
    if isinstance(f, Or):
        return Or(tuple(body(b) for b in f.branches))
    if isinstance(f, If):
        return If(body(f.test), body(f.then), body(f.other))
    if isinstance(f, (Exists, Forall, Agg)):
        inner = {k: v for k, v in names.items() if k not in f.names}
        if isinstance(f, Exists):
            return Exists(f.names, body(f.body, inner))
        if isinstance(f, Forall):
            return replace(f, guard=body(f.guard, inner), body=body(f.body, inner))
        return replace(f, body=body(f.body, inner), expr=rename_term(f.expr, inner), result=rename_term(f.result, names))
    return f


def dependencies(rule: Rule) -> Iterator[tuple[tuple[str, int], bool]]:
    """Predicates that a rule's body uses: (name, arity), and whether under negation or an aggregate."""

    def walk(body: tuple[Formula, ...], below: bool) -> Iterator[tuple[tuple[str, int], bool]]:
        for f in body:
            if isinstance(f, Atom):
                yield f.key, below
            elif isinstance(f, Closure):
                yield (f.pred, 2), below
            elif isinstance(f, NamedAtom):
                yield (f.pred, -1), below
            elif isinstance(f, If):
                yield from walk(f.test, True)
                yield from walk(f.then, below)
                yield from walk(f.other, below)
            else:
                for b in subformulas(f):
                    yield from walk(b, below or isinstance(f, (Not, Forall, Agg)))

    yield from walk(rule.body, False)
