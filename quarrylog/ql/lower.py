"""Lowering of syntax trees to logic programs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from quarrylog.functions.builtins import BUILTINS
from quarrylog.plans import ir
from quarrylog.plans.analysis import fresh
from quarrylog.ql import syntax as s

PRIMITIVE = {"int", "float", "string", "boolean", "date"}
OWN = "!own"


class ResolveFault(ir.LogicError):
    """A name that is undefined, defined twice, or inherits from itself."""


@dataclass
class Scope:
    """Types of the variables in view, and where we are."""

    types: dict[str, str | None]
    path: str = ""
    owner: ClassInfo | None = None
    member: s.Predicate | None = None

    def plus(self, types: dict[str, str | None]) -> Scope:
        return Scope({**self.types, **types}, self.path, self.owner, self.member)


@dataclass
class ClassInfo:
    name: str  # qualified
    path: str  # of the enclosing module
    node: s.Class
    supers: list[ClassInfo] = field(default_factory=list)
    below: list[ClassInfo] = field(default_factory=list)

    def ancestors(self) -> list[ClassInfo]:
        out, todo = [], [self]
        while todo:
            c = todo.pop(0)
            if c not in out:
                out.append(c)
                todo += c.supers
        return out


class Lowering:
    """Formulas and expressions to IR; classes and modules are added by Resolver."""

    typed = False

    def type_atoms(self, type_: str | None, var: str, scope: Scope) -> list[ir.Formula]:
        return []

    def formula(self, f, scope: Scope) -> list[ir.Formula]:
        if f is None:
            return []
        if isinstance(f, s.AllOf):
            return [x for p in f.parts for x in self.formula(p, scope)]
        if isinstance(f, s.AnyOf):
            return [ir.Or(tuple(tuple(self.formula(p, scope)) for p in f.parts))]
        if isinstance(f, s.Negated):
            return [ir.Not(tuple(self.formula(f.part, scope)))]
        if isinstance(f, s.Constant):
            return [ir.Truth(f.value)]
        if isinstance(f, s.Compare):
            left, a, _ = self.expression(f.left, scope)
            right, b, _ = self.expression(f.right, scope)
            return [*a, *b, ir.Cmp(f.op, left, right)]
        if isinstance(f, s.Holds):
            return self.holds(f.call, scope)
        if isinstance(f, s.InstanceOf):
            value, extra, _ = self.expression(f.value, scope)
            return [*extra, *self.type_test(f.type, value, scope)]
        if isinstance(f, s.Conditional):
            return [ir.If(*(tuple(self.formula(x, scope)) for x in (f.test, f.then, f.other)))]
        if isinstance(f, s.Quantified):
            inner = scope.plus({d.name: d.type for d in f.decls})
            names = tuple(d.name for d in f.decls)
            types = [a for d in f.decls for a in self.type_atoms(d.type, d.name, scope)]
            guard, body = self.formula(f.guard, inner), self.formula(f.body, inner)
            if f.kind == "exists":
                return [ir.Exists(names, tuple([*types, *guard, *body]))]
            return [ir.Forall(names, tuple([*types, *guard]), tuple(body), f.kind == "forex")]
        raise TypeError(f)

    def type_test(self, type_: str, value: ir.Term, scope: Scope) -> list[ir.Formula]:
        return [ir.Atom(type_, (value,))]

    def holds(self, call, scope: Scope) -> list[ir.Formula]:
        if isinstance(call, s.Call):
            if call.named:
                parts = [self.expression(a, scope) for a in call.args]
                return [x for _, e, _ in parts for x in e] + [ir.NamedAtom(call.name, tuple(zip(call.named, (t for t, _, _ in parts), strict=True)))]
            args, extra = self._args(call.args, scope)
            return [*extra, self.predicate_atom(call.name, args, call.closure, scope)]
        args, extra, receiver = self._method_args(call, scope)
        return [*extra, *self.method(call, receiver, args, None, scope)[0]]

    def _args(self, args, scope: Scope) -> tuple[list[ir.Term], list[ir.Formula]]:
        done = [self.expression(a, scope) for a in args]
        return [t for t, _, _ in done], [x for _, e, _ in done for x in e]

    def _method_args(self, call: s.Method, scope: Scope):
        if call.receiver is None:
            receiver = (ir.Var("this"), [], None)
        else:
            receiver = self.expression(call.receiver, scope)
        args, extra = self._args(call.args, scope)
        return args, [*receiver[1], *extra], receiver

    def predicate_atom(self, name: str, args: list[ir.Term], closure: str, scope: Scope) -> ir.Formula:
        if closure:
            if len(args) != 2:
                raise ir.LogicError(f"{name}{closure} takes two arguments")
            return ir.Closure(name, args[0], args[1], closure == "*")
        return ir.Atom(name, tuple(args))

    def method(self, call: s.Method, receiver, args: list[ir.Term], result: ir.Term | None, scope: Scope) -> tuple[list[ir.Formula], str | None]:
        """Formulas of a method call (result None: as a formula), and the type of its result."""
        if call.name in BUILTINS:
            kind = BUILTINS[call.name][1]
            if (kind is None) != (result is None):
                if result is None:
                    result = ir.Wild()
                else:
                    raise ir.LogicError(f"{call.name} has no result")
            return [ir.Builtin(call.name, (receiver[0], *args), result)], {"bigint": "int", "string": "string", None: None}[kind]
        raise ir.LogicError(f"no method {call.name}")

    def expression(self, e, scope: Scope) -> tuple[ir.Term, list[ir.Formula], str | None]:
        """A term, formulas that bind its variables, and its type if known."""
        if isinstance(e, s.Lit):
            kind = "boolean" if isinstance(e.value, bool) else "int" if isinstance(e.value, int) else "float" if isinstance(e.value, float) else "string"
            return ir.Const(int(e.value) if kind == "boolean" else e.value), [], kind
        if isinstance(e, s.Blank):
            return ir.Wild(), [], None
        if isinstance(e, s.Name):
            self.known_variable(e.name, scope)
            return ir.Var(e.name), [], scope.types.get(e.name)
        if isinstance(e, s.Bin):
            left, a, kind = self.expression(e.left, scope)
            if e.right is None:
                return ir.Arith("neg", left, None), a, kind
            right, b, other = self.expression(e.right, scope)
            return ir.Arith(e.op, left, right), [*a, *b], "string" if "string" in (kind, other) else kind
        if isinstance(e, s.Cast):
            value, extra, _ = self.expression(e.value, scope)
            return value, [*extra, *self.type_test(e.type, value, scope)], e.type
        if isinstance(e, s.Call):
            args, extra = self._args(e.args, scope)
            out = ir.Var(fresh("r"))
            return out, [*extra, self.predicate_atom(e.name, [*args, out], e.closure, scope)], self.result_type(e.name, len(args), scope)
        if isinstance(e, s.Method):
            args, extra, receiver = self._method_args(e, scope)
            out = ir.Var(fresh("r"))
            more, kind = self.method(e, receiver, args, out, scope)
            return out, [*extra, *more], kind
        if isinstance(e, s.AggExpr):
            inner = scope.plus({d.name: d.type for d in e.decls})
            types = [a for d in e.decls for a in self.type_atoms(d.type, d.name, scope)]
            body = [*types, *self.formula(e.body, inner)]
            value, kind = None, e.decls[0].type
            if e.value is not None:
                value, extra, kind = self.expression(e.value, inner)
                body += extra
            out = ir.Var(fresh("a"))
            kind = "string" if "concat" in e.func else "int" if "count" in e.func or e.func == "rank" else kind
            separator = e.separator if e.separator is not None else ","
            return out, [ir.Agg(e.func, tuple(d.name for d in e.decls), tuple(body), value, out, separator)], kind
        raise TypeError(e)

    def known_variable(self, name: str, scope: Scope) -> None:
        pass

    def result_type(self, name: str, arity: int, scope: Scope) -> str | None:
        return None


class Resolver(Lowering):
    """Lowers a module with classes, submodules and imports to a program."""

    typed = True

    def __init__(self, module: s.Module, loader: Callable[[str], str | None] | None = None, entity: Callable[[str], tuple[str, int] | None] | None = None):
        self.loader, self.entity = loader or (lambda path: None), entity or (lambda name: None)
        self.classes: dict[str, ClassInfo] = {}
        self.predicates: dict[tuple[str, int], tuple[str, s.Predicate]] = {}
        self.loaded: set[str] = set()
        self.aliases: dict[str, str] = {}
        self.warnings: list[str] = []
        self._collect(module, "")
        self._link()
        self.module = module

    # ---- names

    def _collect(self, m: s.Module, path: str) -> None:
        for name, alias in m.imports:
            if alias:
                self.aliases[alias] = ""
            if name in self.loaded:
                continue
            self.loaded.add(name)
            text = self.loader(name)
            if text is None:
                raise ResolveFault(f"no library {name}")
            self._collect(s.parse_module(text) if isinstance(text, str) else text, path)
        for c in m.classes:
            full = path + c.name
            if full in self.classes:
                raise ResolveFault(f"class {full} is defined twice")
            self.classes[full] = ClassInfo(full, path, c)
        for p in m.predicates:
            key = (path + p.name, len(p.params) + (p.result is not None))
            if key in self.predicates:
                raise ResolveFault(f"predicate {key[0]} with {len(p.params)} parameters is defined twice")
            self.predicates[key] = (path, p)
        for inner in m.modules:
            self._collect(inner, f"{path}{inner.name}::")

    def _scopes(self, path: str):
        while True:
            yield path
            if not path:
                return
            path = path[: path[:-2].rfind("::") + 2] if "::" in path[:-2] else ""

    def _unalias(self, name: str) -> str:
        head, mark, rest = name.partition("::")
        return self.aliases[head] + rest if mark and head in self.aliases else name

    def find_class(self, name: str, path: str) -> ClassInfo | None:
        name = self._unalias(name)
        return next((self.classes[p + name] for p in self._scopes(path) if p + name in self.classes), None)

    def find_predicate(self, name: str, arity: int, path: str):
        name = self._unalias(name)
        return next(((p + name, self.predicates[p + name, arity][1]) for p in self._scopes(path) if (p + name, arity) in self.predicates), None)

    def _link(self) -> None:
        for c in self.classes.values():
            for name in c.node.supers:
                if name in PRIMITIVE or name.startswith("@"):
                    continue
                up = self.find_class(name, c.path)
                if up is None:
                    raise ResolveFault(f"class {c.name} extends {name}, which is not defined")
                c.supers.append(up)
                up.below.append(c)
        for c in self.classes.values():
            seen, todo = set(), list(c.supers)
            while todo:
                up = todo.pop()
                if up is c:
                    raise ResolveFault(f"class {c.name} inherits from itself")
                if up.name not in seen:
                    seen.add(up.name)
                    todo += up.supers

    def type_atoms(self, type_: str | None, var: str, scope: Scope) -> list[ir.Formula]:
        return self.type_test(type_, ir.Var(var), scope) if type_ else []

    def type_test(self, type_: str, value: ir.Term, scope: Scope) -> list[ir.Formula]:
        if type_ in PRIMITIVE:
            return []
        if type_.startswith("@"):
            found = self.entity(type_[1:])
            return [ir.Atom(found[0], (value, *[ir.Wild()] * (found[1] - 1)))] if found else []
        c = self.find_class(type_, scope.path)
        if c is None:
            raise ResolveFault(f"type {type_} is not defined")
        return [ir.Atom(c.name, (value,))]

    def known_variable(self, name: str, scope: Scope) -> None:
        if name not in scope.types:
            raise ResolveFault(f"variable {name} is not defined")

    def predicate_atom(self, name: str, args: list[ir.Term], closure: str, scope: Scope) -> ir.Formula:
        found = self.find_predicate(name, len(args), scope.path)
        if found is None and scope.owner is not None:  # a member of this
            for c in scope.owner.ancestors():
                if any(m.name == name and len(m.params) + (m.result is not None) == len(args) for m in c.node.members):
                    return super().predicate_atom(f"{c.name}_{name}", [ir.Var("this"), *args], closure, scope)
        if found is None and len(args) == 1 and (c := self.find_class(name, scope.path)) and not closure:
            return ir.Atom(c.name, tuple(args))
        return super().predicate_atom(found[0] if found else self._unalias(name), args, closure, scope)

    def result_type(self, name: str, arity: int, scope: Scope) -> str | None:
        found = self.find_predicate(name, arity + 1, scope.path)
        return found[1].result if found else None

    def method(self, call: s.Method, receiver, args: list[ir.Term], result: ir.Term | None, scope: Scope) -> tuple[list[ir.Formula], str | None]:
        has = lambda c: next((m for m in c.node.members if m.name == call.name and len(m.params) == len(args)), None)
        if call.receiver is None:
            found = [(c, m) for c in scope.owner.ancestors()[1:] if (m := has(c))][:1]
            suffix = OWN
        else:
            own = self.find_class(receiver[2], scope.path) if receiver[2] and receiver[2] not in PRIMITIVE and not receiver[2].startswith("@") else None
            suffix = ""
            if own:
                found = [(c, m) for c in own.ancestors() if (m := has(c))][:1]
            elif receiver[2] in (None, "string", "int") and call.name in BUILTINS and not (receiver[2] is None and any(has(c) for c in self.classes.values())):
                return super().method(call, receiver, args, result, scope)
            else:
                found = [(c, m) for c in self.classes.values() if (m := has(c))]
                if len(found) > 1:
                    raise ResolveFault(f"the type of the receiver of {call.name} is not known")
        if not found:
            if call.name in BUILTINS:
                return super().method(call, receiver, args, result, scope)
            raise ResolveFault(f"no method {call.name} with {len(args)} arguments" + (f" in {receiver[2]}" if receiver[2] else ""))
        c, m = found[0]
        if (m.result is None) != (result is None):
            if m.result is None:
                raise ResolveFault(f"{call.name} has no result")
            result = ir.Wild()
        terms = [receiver[0], *args, *([result] if result is not None else [])]
        if call.closure:
            return [super().predicate_atom(f"{c.name}_{m.name}", terms, call.closure, scope)], m.result
        return [ir.Atom(f"{c.name}_{m.name}{suffix}", tuple(terms))], m.result

    # ---- rules

    def program(self) -> ir.Program:
        out = ir.Program()
        for c in self.classes.values():
            out.rules += self._class_rules(c)
        for (name, _), (path, p) in self.predicates.items():
            if p.body is None:
                continue
            scope = Scope({d.name: d.type for d in p.params} | ({"result": p.result} if p.result else {}), path, None, p)
            head = [ir.Var(d.name) for d in p.params] + ([ir.Var("result")] if p.result else [])
            types = [a for d in p.params for a in self.type_atoms(d.type, d.name, scope)]
            out.rules.append(ir.Rule(ir.Atom(name, tuple(head)), tuple([*types, *self.formula(p.body, scope)])))
        if self.module.select:
            decls, where, items = self.module.select
            scope = Scope({d.name: d.type for d in decls})
            body = [a for d in decls for a in self.type_atoms(d.type, d.name, scope)] + self.formula(where, scope)
            terms = []
            for value, label in items:
                t, extra, _ = self.expression(value, scope)
                body += extra
                terms.append((t, label))
            out.query = ir.Query(tuple(terms), tuple(body))
        return out

    def _domain(self, c: ClassInfo) -> list[ir.Formula]:
        """What an instance is before subclasses are looked at: its supertypes' instances with its characteristic."""
        this = ir.Var("this")
        scope = Scope({"this": c.name}, c.path, c)
        out: list[ir.Formula] = []
        for up in c.supers:
            out += self._domain(up) if up.node.abstract else [ir.Atom(up.name, (this,))]
        if c.node.character is None:
            for name in c.node.supers:
                if name.startswith("@"):
                    out += self.type_test(name, this, scope)
        return out + self.formula(c.node.character, scope)

    def _class_rules(self, c: ClassInfo) -> list[ir.Rule]:
        this = ir.Var("this")
        head = ir.Atom(c.name, (this,))
        if c.node.abstract:
            rules = [ir.Rule(head, (ir.Atom(b.name, (this,)),)) for b in c.below]
            if not rules:
                rules = [ir.Rule(ir.Atom(c.name, (ir.Const(0),)), (ir.Truth(False),))]
        else:
            rules = [ir.Rule(head, tuple(self._domain(c)))]
        for m in c.node.members:
            args = [this, *(ir.Var(d.name) for d in m.params), *([ir.Var("result")] if m.result else [])]
            name = f"{c.name}_{m.name}"
            overriding = self._overriding(c, m)
            if m.body is not None:
                scope = Scope({"this": c.name} | {d.name: d.type for d in m.params} | ({"result": m.result} if m.result else {}), c.path, c, m)
                types = [a for d in m.params for a in self.type_atoms(d.type, d.name, scope)]
                rules.append(ir.Rule(ir.Atom(name + OWN, tuple(args)), (ir.Atom(c.name, (this,)), *types, *self.formula(m.body, scope))))
                rules.append(ir.Rule(ir.Atom(name, tuple(args)), (ir.Atom(name + OWN, tuple(args)), *(ir.Not((ir.Atom(b.name, (this,)),)) for b in overriding))))
            rules += [ir.Rule(ir.Atom(name, tuple(args)), (ir.Atom(f"{b.name}_{m.name}", tuple(args)),)) for b in overriding]
            if m.body is None and not overriding:
                types = [None, *(d.type for d in m.params), m.result][: len(args)]
                blank = tuple(ir.Const("" if t == "string" else 0) for t in types)
                rules.append(ir.Rule(ir.Atom(name, blank), (ir.Truth(False),)))
        return rules

    def _overriding(self, c: ClassInfo, m: s.Predicate) -> list[ClassInfo]:
        """The nearest subclasses that define the member anew."""
        out, todo = [], list(c.below)
        while todo:
            b = todo.pop(0)
            if b in out:
                continue
            if any(x.name == m.name and len(x.params) == len(m.params) for x in b.node.members):
                out.append(b)
            else:
                todo += b.below
        return out


def lower_module(text: str, loader=None, entity=None) -> ir.Program:
    """A program of the object-oriented language as a logic program."""
    return Resolver(s.parse_module(text), loader, entity).program()
