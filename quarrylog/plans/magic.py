"""Magic sets: derive only what a query's constants ask for.

Catalyst cannot push a filter through a fixpoint that the driver runs. So for
atoms with bound arguments, rules are specialised: a demand relation holds the
bound arguments that are asked for, specialised rules begin with it, and each
derived atom in their bodies passes demand on, from left to right. Negations and
aggregates keep to the original predicates, so strata stay as they are.
"""

from __future__ import annotations

from quarrylog.plans import analysis, ir

Key = tuple[str, int]


def demand_name(pred: str, pattern: str) -> str:
    return f"demand:{pred}@{pattern}"


class _Rewriter:
    def __init__(self, engine):
        self.engine = engine
        self.done: set[tuple[Key, str]] = set()
        self.todo: list[tuple[Key, str]] = []
        self.rules: list[ir.Rule] = []

    def derived(self, key: Key) -> bool:
        return key in self.engine.rules and key not in self.engine.stored

    def pattern(self, atom: ir.Atom, bound: set[str]) -> str:
        return "".join("b" if isinstance(a, ir.Const) or isinstance(a, ir.Var) and a.name in bound else "f" for a in atom.args)

    def want(self, key: Key, pattern: str) -> str:
        if (key, pattern) not in self.done:
            self.done.add((key, pattern))
            self.todo.append((key, pattern))
        return f"{key[0]}@{pattern}"

    def body(self, formulas: tuple[ir.Formula, ...], guard: list[ir.Formula], bound: set[str]) -> list[ir.Formula]:
        """The body with derived atoms specialised; adds the rules by which they are demanded."""
        out, passed, rest = [], list(guard), list(formulas)
        while rest:
            # conditions as soon as they can be, then the first atom that something binds
            at = next((i for i, f in enumerate(rest) if isinstance(f, ir.Cmp) and self._ready(f, bound)), None)
            if at is None:
                at = next((i for i, f in enumerate(rest) if isinstance(f, ir.Atom) and "b" in self.pattern(f, bound)), None)
            if at is None:
                at = next((i for i, f in enumerate(rest) if isinstance(f, ir.Atom)), 0)
            f = rest.pop(at)
            if isinstance(f, ir.Atom):
                if self.derived(f.key) and "b" in (pattern := self.pattern(f, bound)):
                    name = self.want(f.key, pattern)
                    asked = tuple(a for a, p in zip(f.args, pattern, strict=True) if p == "b")
                    self.rules.append(ir.Rule(ir.Atom(demand_name(f.pred, pattern), asked), tuple(passed)))
                    f = ir.Atom(name, f.args)
                passed.append(f)
                bound |= ir.free_vars(f)
            elif isinstance(f, ir.Cmp) and self._ready(f, bound):
                passed.append(f)
                bound |= ir.free_vars(f)
            out.append(f)
        return out

    @staticmethod
    def _ready(f: ir.Cmp, bound: set[str]) -> bool:
        free = ir.free_vars(f)
        if free <= bound:
            return True
        sides = ((f.left, f.right), (f.right, f.left))
        return f.op == "=" and any(isinstance(a, ir.Var) and set(ir.term_vars(b)) <= bound and not isinstance(b, ir.Wild) for a, b in sides)

    def specialise(self, key: Key, pattern: str) -> None:
        for rule in self.engine.rules[key]:
            for body in analysis.alternatives(rule.body):
                args, extra = [], []
                for a, p in zip(rule.head.args, pattern, strict=True):
                    if p == "b" and isinstance(a, ir.Arith):
                        v = ir.Var(analysis.fresh("m"))
                        extra.append(ir.Cmp("=", v, a))
                        a = v
                    args.append(a)
                asked = tuple(a for a, p in zip(args, pattern, strict=True) if p == "b")
                guard: list[ir.Formula] = [ir.Atom(demand_name(key[0], pattern), asked)]
                new = self.body(tuple([*extra, *body]), guard, {v for a in asked for v in ir.term_vars(a)})
                self.rules.append(ir.Rule(ir.Atom(f"{key[0]}@{pattern}", tuple(args)), tuple([*guard, *new])))


def rewrite(engine, query: ir.Query) -> ir.Query:
    """The query over specialised predicates, whose rules are added to the engine; unchanged if nothing is bound."""
    for name in {f.pred for f in analysis.normal(query.body) if isinstance(f, ir.Atom)}:
        engine._resolve([(name, 2)] if name.endswith("+") else [])
    r = _Rewriter(engine)
    body = r.body(analysis.normal(query.body), [], set())
    while r.todo:
        r.specialise(*r.todo.pop())
    for rule in r.rules:
        if rule not in engine.rules.get(rule.head.key, []):
            engine._add(rule)
    return ir.Query(query.select, tuple(body))
