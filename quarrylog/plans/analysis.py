"""What a program needs before it is compiled: normal forms, reachability, strata."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from quarrylog.plans import ir

Key = tuple[str, int]
_fresh = itertools.count()


def fresh(stem: str = "v") -> str:
    return f"_{stem}{next(_fresh)}"


def normal(body: Iterable[ir.Formula]) -> tuple[ir.Formula, ...]:
    """exists inlined under fresh names, if and p* as alternatives, expressions out of atoms' arguments."""
    out: list[ir.Formula] = []
    for f in body:
        if isinstance(f, ir.Exists):
            out += normal(_renamed(f))
        elif isinstance(f, ir.If):
            out.append(ir.Or((normal((*f.test, *f.then)), normal((ir.Not(f.test), *f.other)))))
        elif isinstance(f, ir.Closure):
            plus = ir.Atom(f.pred + "+", (f.left, f.right))
            out.append(ir.Or((normal((ir.Cmp("=", f.left, f.right),)), normal((plus,)))) if f.reflexive else plus)
        elif isinstance(f, ir.Or):
            out.append(ir.Or(tuple(map(normal, f.branches))))
        elif isinstance(f, ir.Not):
            out.append(ir.Not(normal(f.body)))
        elif isinstance(f, ir.Forall):
            names = {n: fresh(n) for n in f.names}
            guard, inner = (normal(ir.rename(x, names) for x in b) for b in (f.guard, f.body))
            out.append(ir.Forall(tuple(names.values()), guard, inner))
            if f.some:
                again = {n: fresh(n) for n in f.names}
                out += normal(ir.rename(x, again) for x in f.guard)
        elif isinstance(f, ir.Agg):
            names = {n: fresh(n) for n in f.names}
            inner = normal(ir.rename(x, names) for x in f.body)
            out.append(ir.Agg(f.func, tuple(names.values()), inner, ir.rename_term(f.expr, names), f.result, f.separator))
        elif isinstance(f, ir.Atom) and any(isinstance(a, ir.Arith) for a in f.args):
            args, extra = [], []
            for a in f.args:
                if isinstance(a, ir.Arith):
                    v = ir.Var(fresh("e"))
                    extra.append(ir.Cmp("=", v, a))
                    a = v
                args.append(a)
            out += [ir.Atom(f.pred, tuple(args)), *extra]
        else:
            out.append(f)
    return tuple(out)


def _renamed(f: ir.Exists) -> list[ir.Formula]:
    names = {n: fresh(n) for n in f.names}
    return [ir.rename(x, names) for x in f.body]


def alternatives(body: tuple[ir.Formula, ...]) -> list[tuple[ir.Formula, ...]]:
    """The bodies whose union is the body, without disjunctions on the top level."""
    choices = [[b for branch in f.branches for b in alternatives(branch)] if isinstance(f, ir.Or) else [(f,)] for f in body]
    return [tuple(itertools.chain.from_iterable(pick)) for pick in itertools.product(*choices)]


def independent(body: tuple[ir.Formula, ...], head: set[str]) -> tuple[str | None, list[tuple[ir.Formula, ...]]] | None:
    """Parts of a body that share no variable, or just one of the head, which comes first; None if there are not at least two.

    The rows of the body are the parts' rows, each reduced to the head's variables, joined on that variable. With one, a part must
    have a variable that the head does not show, for which the whole would be joined before it is dropped; evenly cut parts win.
    """
    if not all(isinstance(f, (ir.Atom, ir.Cmp, ir.Builtin, ir.Not, ir.Forall, ir.Truth)) for f in body):
        return None
    shared = [ir.free_vars(f) & (head | ir.body_vars(tuple(x for x in body if x is not f))) if isinstance(f, (ir.Not, ir.Forall)) else ir.free_vars(f) for f in body]
    best = None
    for cut in (None, *sorted(head)):
        groups: list[tuple[set[str], list[int]]] = []
        loose = []
        for i, names in enumerate(shared):
            if not names - {cut}:
                loose.append(i)
                continue
            touched = [g for g in groups if g[0] & names - {cut}]
            groups = [g for g in groups if g not in touched]
            groups.append((names.union(*(g[0] for g in touched)), [i, *(j for g in touched for j in g[1])]))
        groups.sort(key=lambda g: min(g[1]))
        atoms = [sum(isinstance(body[i], ir.Atom) for i in g[1]) for g in groups]
        if len(groups) < 2 or not all(atoms):
            continue
        if cut is not None:
            if not all(cut in g[0] and g[0] & head - {cut} for g in groups) or not any(n > 1 and g[0] - head for g, n in zip(groups, atoms, strict=True)):
                continue
        groups[0][1].extend(loose)
        if best is None or min(atoms) > best[0]:
            best = min(atoms), cut, [tuple(body[i] for i in sorted(g[1])) for g in groups]
        if cut is None:
            break
    return best and best[1:]


def closure_rules(pred: str) -> list[ir.Rule]:
    """Rules of pred+, the transitive closure of a binary predicate."""
    x, y, z = map(ir.Var, "xyz")
    name = pred + "+"
    return [
        ir.Rule(ir.Atom(name, (x, y)), (ir.Atom(pred, (x, y)),)),
        ir.Rule(ir.Atom(name, (x, y)), (ir.Atom(name, (x, z)), ir.Atom(pred, (z, y)))),
    ]


def components(graph: dict[Key, set[Key]]) -> list[list[Key]]:
    """Strongly connected components, those depended on first (Tarjan's method without recursion)."""
    index: dict[Key, int] = {}
    low: dict[Key, int] = {}
    on, stack, out = set(), [], []
    for root in graph:
        if root in index:
            continue
        work = [(root, iter(sorted(graph[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in graph:
                    continue
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(sorted(graph[to]))))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    found = []
                    while True:
                        top = stack.pop()
                        on.discard(top)
                        found.append(top)
                        if top == node:
                            break
                    out.append(found[::-1])
    return out


def check_strata(rules: dict[Key, list[ir.Rule]], groups: list[list[Key]]) -> None:
    """No predicate may depend on its own negation or aggregate."""
    for group in groups:
        inside = set(group)
        for key in group:
            for r in rules.get(key, ()):
                for k, below in ir.dependencies(r):
                    if below and k in inside:
                        raise ir.LogicError(f"{key[0]}/{key[1]} depends on {k[0]}/{k[1]} under negation or an aggregate within a recursion")


def simplified(body: tuple[ir.Formula, ...], empty: set[Key]) -> tuple[ir.Formula, ...] | None:
    """The body without what holds because relations are empty; None if it cannot hold."""
    out: list[ir.Formula] = []
    for f in body:
        if isinstance(f, ir.Atom):
            if f.key in empty:
                return None
        elif isinstance(f, ir.Not):
            inner = simplified(f.body, empty)
            if inner is None:
                continue
            f = ir.Not(inner)
        elif isinstance(f, ir.Or):
            branches = tuple(b for b in (simplified(b, empty) for b in f.branches) if b is not None)
            if not branches:
                return None
            f = ir.Or(branches)
        elif isinstance(f, ir.Forall):
            if simplified(f.guard, empty) is None:
                continue
        elif isinstance(f, ir.Agg):
            if simplified(f.body, empty) is None:
                return None
        out.append(f)
    return tuple(out)


def pruned(rules: dict[Key, list[ir.Rule]], keys: Iterable[Key], empty: set[Key], stored: Iterable[Key]) -> tuple[dict[Key, list[ir.Rule]], set[Key]]:
    """Rules that can give rows, and all relations known to be empty: those given, and derived ones left without rules."""
    live, empty, stored = {k: rules[k] for k in keys if k in rules}, set(empty), set(stored)
    while True:
        after = {k: [ir.Rule(r.head, b) for r in rs if (b := simplified(r.body, empty)) is not None] for k, rs in live.items()}
        gone = {k for k, rs in after.items() if not rs and k not in stored}
        live = {k: rs for k, rs in after.items() if rs}
        if not gone - empty:
            return live, empty
        empty |= gone


def without_implied(rules: dict[Key, list[ir.Rule]], groups: list[list[Key]], stored: Iterable[Key]) -> dict[Key, list[ir.Rule]]:
    """The rules without atoms that hold wherever another atom of the same body does, as the classes of members do. groups: as from components()."""
    stored = set(stored)
    sure: dict[Key, set[tuple[Key, tuple[int, ...]]]] = {}
    for key, rs in rules.items():  # what holds for each row of a relation that alone makes up a rule
        for r in rs:
            if len(r.body) == 1 and isinstance(r.body[0], ir.Atom) and r.head.args and all(isinstance(a, (ir.Var, ir.Wild)) for a in (*r.head.args, *r.body[0].args)):
                names = [a.name for a in r.body[0].args if isinstance(a, ir.Var)]
                if len(set(names)) == len(names) and all(isinstance(a, ir.Var) and a.name in names for a in r.head.args):
                    sure.setdefault(r.body[0].key, set()).add((key, tuple(r.body[0].args.index(a) for a in r.head.args)))

    def held(f: ir.Atom) -> set[tuple[Key, tuple]]:
        return {(k, tuple(f.args[i] for i in places)) for k, places in sure.get(f.key, ()) if all(isinstance(f.args[i], ir.Var) for i in places)}

    for group in groups:
        key = group[0]
        if len(group) > 1 or key in stored or not rules.get(key) or any(k == key for r in rules[key] for k, _ in ir.dependencies(r)):
            continue
        each = []
        for r in rules[key]:
            atoms = [f for f in r.body if isinstance(f, ir.Atom)]
            found = {(f.key, f.args) for f in atoms if f.args and all(isinstance(a, ir.Var) for a in f.args)}.union(*map(held, atoms))
            each.append({(k, tuple(r.head.args.index(a) for a in args)) for k, args in found if set(args) <= set(r.head.args)})
        sure.setdefault(key, set()).update(set.intersection(*each) - {(key, tuple(range(key[1])))})
    out = {}
    for key, rs in rules.items():
        out[key] = []
        for r in rs:
            body = list(r.body)
            for f in [f for f in body if isinstance(f, ir.Atom)]:
                if any(x is not f and isinstance(x, ir.Atom) and x.key != f.key and (f.key, f.args) in held(x) for x in body):
                    body = [x for x in body if x is not f]
            out[key].append(ir.Rule(r.head, tuple(body)))
    return out
