"""From formulas to DataFrames.

A body becomes a DataFrame whose columns are its variables. Literals are taken
in an order that keeps every join connected: conditions as soon as their
variables are bound, then negations, then atoms that share variables, cartesian
products last. The physical strategy is Catalyst's business.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.functions.builtins import BUILTINS, CONSTANT_INPUTS
from quarrylog.operators.spread import spread_join
from quarrylog.plans import analysis, ir

Lookup = Callable[[tuple[str, int]], DataFrame]


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    return "string" if isinstance(t, T.StringType) else t.simpleString()


def comparable(a: str, b: str) -> bool:
    return a == b or {a, b} == {"int", "real"}


class Compiler:
    """Compiles bodies over the relations that ``lookup`` gives (columns c0, c1, ...)."""

    def __init__(self, spark, lookup: Lookup, columns_of: Callable[[str], list[str]], is_set: Callable[[tuple[str, int]], bool] = lambda _: False):
        self.spark, self.lookup, self.columns_of, self.is_set = spark, lookup, columns_of, is_set

    # ---- terms

    def term(self, t: ir.Term, cur: DataFrame) -> tuple[Column, str]:
        """A column for a term whose variables are bound, and its kind; null where it has no value."""
        if isinstance(t, ir.Const):
            v = t.value
            if isinstance(v, bool) or isinstance(v, int):
                return F.lit(int(v)).cast("long"), "int"
            return F.lit(v), "real" if isinstance(v, float) else "string"
        if isinstance(t, ir.Var):
            return F.col(f"`{t.name}`"), kind_of(cur.schema[t.name].dataType)
        if isinstance(t, ir.Arith):
            a, ka = self.term(t.left, cur)
            if t.op == "neg":
                return F.try_subtract(F.lit(0).cast("long"), a) if ka == "int" else -a, ka
            b, kb = self.term(t.right, cur)
            if "string" in (ka, kb):
                if t.op != "+":
                    raise ir.LogicError(f"strings do not take {t.op}")
                return F.concat(a.cast("string"), b.cast("string")), "string"
            if ka == kb == "int":
                some = b != 0
                return {
                    "+": lambda: F.try_add(a, b), "-": lambda: F.try_subtract(a, b), "*": lambda: F.try_multiply(a, b),
                    "/": lambda: F.when(some, F.call_function("div", a, F.when(some, b))), "%": lambda: F.when(some, a % F.when(some, b)),
                }[t.op](), "int"
            a, b = a.cast("double"), b.cast("double")
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.when(b != 0, a % F.when(b != 0, b))}[t.op], "real"
        raise ir.LogicError("_ has no value")

    def condition(self, f: ir.Cmp, cur: DataFrame) -> Column:
        (a, ka), (b, kb) = self.term(f.left, cur), self.term(f.right, cur)
        if not comparable(ka, kb):
            return F.lit(f.op == "!=")
        test = {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[f.op]
        return F.coalesce(test, F.lit(False)) if isinstance(f.left, ir.Arith) or isinstance(f.right, ir.Arith) else test

    def builtin(self, f: ir.Builtin, cur: DataFrame) -> tuple[Column | None, Column]:
        """Result and condition of a builtin whose inputs are bound."""
        if f.name not in BUILTINS:
            raise ir.LogicError(f"no builtin {f.name}")
        kinds, _, _, use = BUILTINS[f.name]
        if len(kinds) != len(f.inputs):
            raise ir.LogicError(f"{f.name} takes {len(kinds)} arguments")
        args, fixed = [], CONSTANT_INPUTS.get(f.name, ())
        for i, (t, want) in enumerate(zip(f.inputs, kinds, strict=True)):
            if i in fixed:
                if not (isinstance(t, ir.Const) and isinstance(t.value, str)):
                    raise ir.LogicError(f"argument {i} of {f.name} must be a string constant")
                args.append(t.value)
                continue
            col, kind = self.term(t, cur)
            if kind != ("string" if want == "string" else "int"):
                return (None if f.result is None else F.lit(None).cast(BUILTINS[f.name][1])), F.lit(False)
            args.append(col)
        result, condition = use(*args)
        condition = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        # outside its condition a result is not computed, so that nothing can fail there
        return (None if result is None else F.when(condition, result)), condition

    # ---- atoms

    def atom(self, f: ir.Atom) -> DataFrame:
        """The relation's rows that fit the atom, with a column for each variable."""
        rel = self.lookup(f.key)
        seen: dict[str, str] = {}
        for i, a in enumerate(f.args):
            c = f"c{i}"
            if isinstance(a, ir.Const):
                col, kind = self.term(a, rel)
                rel = rel.where(F.col(c) == col if comparable(kind, kind_of(rel.schema[c].dataType)) else F.lit(False))
            elif isinstance(a, ir.Var):
                if a.name in seen:
                    rel = rel.where(F.col(c) == F.col(seen[a.name]))
                else:
                    seen[a.name] = c
                    if rel.schema[c].nullable:
                        rel = rel.where(F.col(c).isNotNull())  # a null is no value and fits nothing
        return rel.select(*(F.col(c).alias(v) for v, c in seen.items())) if seen else rel.select(F.lit(1).alias("__one"))

    def join(self, cur: DataFrame | None, rel: DataFrame, bag: bool) -> DataFrame:
        """Natural join; without new variables a semi-join, as sets need no more."""
        if rel.columns == ["__one"]:
            if cur is None:
                return rel if bag else rel.limit(1)
            return cur.crossJoin(rel.drop("__one").withColumn("__n", F.lit(1))).drop("__n") if bag else cur.join(rel.limit(1), F.lit(True), "left_semi")
        if cur is None:
            return rel
        if cur.columns == ["__one"]:
            return cur.crossJoin(rel).drop("__one") if bag else rel.join(cur.limit(1), F.lit(True), "left_semi")
        shared = [c for c in rel.columns if c in cur.columns]
        if not shared:
            return cur.crossJoin(rel)
        for c in shared:
            if not comparable(kind_of(cur.schema[c].dataType), kind_of(rel.schema[c].dataType)):
                return cur.join(rel.drop(*shared), F.lit(False), "inner")
        how = "left_semi" if len(shared) == len(rel.columns) and not bag else "inner"
        return cur.join(rel, shared, how)

    # ---- bodies

    def body(self, formulas: tuple[ir.Formula, ...], start: DataFrame | None = None, wanted: frozenset[str] = frozenset(), bag: bool = False) -> DataFrame:
        """A DataFrame over the variables of the formulas (and of start); ``wanted`` are used outside."""
        cur, todo = start, [self._positional(f) for f in formulas]
        while todo:
            bound = set(cur.columns) if cur is not None else set()
            outside = [bound | wanted | ir.body_vars(tuple(x for x in todo if x is not f)) for f in todo]
            ranked = sorted(((self._rank(f, bound, out), i) for i, (f, out) in enumerate(zip(todo, outside, strict=True))))
            ranked = self._choices_first(ranked, todo, bound)
            error = None
            for rank, i in ranked:
                if rank is None or rank[0] >= 90:
                    continue
                try:
                    cur = self._take(todo[i], cur, frozenset(outside[i]), bag)
                except ir.LogicError as e:
                    error = e
                    continue
                del todo[i]
                break
            else:
                raise error or ir.LogicError(f"unsafe: nothing binds {sorted(set().union(*map(ir.free_vars, todo)) - bound)}")
        if cur is None:
            cur = self.spark.range(1).select(F.lit(1).alias("__one"))
        return cur

    @staticmethod
    def _choices_first(ranked: list[tuple], todo: list[ir.Formula], bound: set[str]) -> list[tuple]:
        """A disjunction before the next atom, where it binds what the atom would and is tied to more that is bound: the atom then
        only selects, and does not pair all its rows with all there are."""
        _, first = ranked[0]
        if not bound or not isinstance(todo[first], ir.Atom):
            return ranked
        free = ir.free_vars(todo[first])

        def ties(f: ir.Formula) -> bool:
            return isinstance(f, ir.Or) and free & bound < ir.free_vars(f) and all(free - bound <= names and names & bound - free for names in map(ir.body_vars, f.branches))

        early = [r for r in ranked if free - bound and ties(todo[r[1]])]
        return early + [r for r in ranked if r not in early]

    def _positional(self, f: ir.Formula) -> ir.Formula:
        if not isinstance(f, ir.NamedAtom):
            return f
        names, given = self.columns_of(f.pred), dict(f.args)
        if unknown := set(given) - set(names):
            raise ir.LogicError(f"{f.pred} has no column {sorted(unknown)}")
        return ir.Atom(f.pred, tuple(given.get(c, ir.Wild()) for c in names))

    def _rank(self, f: ir.Formula, bound: set[str], outside: set[str]) -> tuple:
        """A number that is small for what should be taken now, and 90 or more for what cannot."""
        free = ir.free_vars(f)
        if not bound and not free and not isinstance(f, ir.Atom):
            return (85,)  # after the first atom
        if isinstance(f, ir.Truth):
            return (0,)
        if isinstance(f, ir.Cmp):
            if free <= bound:
                return (1,)
            single = [s for s, t in ((f.left, f.right), (f.right, f.left)) if isinstance(s, ir.Var) and s.name not in bound and set(ir.term_vars(t)) <= bound and not isinstance(t, ir.Wild)]
            return (2,) if f.op == "=" and single else (99,)
        if isinstance(f, ir.Builtin):
            return (3,) if {v for t in f.inputs for v in ir.term_vars(t)} <= bound else (99,)
        if isinstance(f, (ir.Not, ir.Forall)):
            return (4,) if free & outside <= bound else (99,)
        if isinstance(f, ir.Atom):
            constants = sum(isinstance(a, ir.Const) for a in f.args)
            if not bound:
                return (6, -constants)
            if free <= bound:
                return (5, -constants)
            return (6, -constants, len(free - bound), -len(free & bound)) if free & bound else (80, -constants)
        if isinstance(f, ir.Agg):
            return (7,)
        if isinstance(f, ir.Or):
            return (8,) if free & outside <= bound else (20,)
        return (99,)

    def _take(self, f: ir.Formula, cur: DataFrame | None, outside: frozenset[str], bag: bool) -> DataFrame:
        if isinstance(f, ir.Truth):
            cur = cur if cur is not None else self.spark.range(1).select(F.lit(1).alias("__one"))
            return cur if f.value else cur.where(F.lit(False))
        if isinstance(f, ir.Atom):
            return self.join(cur, self.atom(f), bag)
        if isinstance(f, ir.Agg):
            return self._aggregate(f, cur, outside, bag)
        if isinstance(f, ir.Or):
            return self._either(f, cur, outside, bag)
        if cur is None:
            cur = self.spark.range(1).select(F.lit(1).alias("__one"))
        if isinstance(f, ir.Cmp):
            return self._compare(f, cur)
        if isinstance(f, ir.Builtin):
            result, condition = self.builtin(f, cur)
            if f.result is None or isinstance(f.result, ir.Wild):
                return cur.where(condition)
            return self._equate(f.result, result, cur.where(condition), BUILTINS[f.name][1])
        shared = sorted(ir.free_vars(f) & set(cur.columns))
        if isinstance(f, ir.Not):
            return self._without(f.body, cur, shared)
        # none of the guard's rows fails: conditions are tested on them as they are read
        return self._without((*f.guard, ir.Not(f.body)), cur, shared)

    def _equate(self, target: ir.Term, value: Column, cur: DataFrame, kind: str | None = None) -> DataFrame:
        if isinstance(target, ir.Var) and target.name not in cur.columns:
            return cur.withColumn(target.name, value)
        col, have = self.term(target, cur)
        if kind and not comparable(have, "string" if kind == "string" else "int"):
            return cur.where(F.lit(False))
        return cur.where(col == value)

    def _compare(self, f: ir.Cmp, cur: DataFrame) -> DataFrame:
        bound = set(cur.columns)
        if ir.free_vars(f) <= bound:
            return cur.where(self.condition(f, cur))
        new, other = (f.left, f.right) if isinstance(f.left, ir.Var) and f.left.name not in bound else (f.right, f.left)
        col, _ = self.term(other, cur)
        out = cur.withColumn(new.name, col)
        return out.where(F.col(f"`{new.name}`").isNotNull()) if isinstance(other, ir.Arith) else out

    def _as_condition(self, body: tuple[ir.Formula, ...], cur: DataFrame) -> Column | None:
        """The body as one boolean column, if it has only conditions on bound variables."""
        parts = []
        for f in body:
            if not ir.free_vars(f) <= set(cur.columns):
                return None
            if isinstance(f, ir.Cmp):
                parts.append(self.condition(f, cur))
            elif isinstance(f, ir.Truth):
                parts.append(F.lit(f.value))
            elif isinstance(f, ir.Builtin):
                result, condition = self.builtin(f, cur)
                if f.result is not None and not isinstance(f.result, ir.Wild):
                    col, _ = self.term(f.result, cur)
                    condition = condition & F.coalesce(col == result, F.lit(False))
                parts.append(condition)
            elif isinstance(f, (ir.Not, ir.Or)):
                inner = [self._as_condition(b, cur) for b in ir.subformulas(f)]
                if any(x is None for x in inner):
                    return None
                parts.append(~inner[0] if isinstance(f, ir.Not) else reduce(lambda a, b: a | b, inner))
            else:
                return None
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def _without(self, body: tuple[ir.Formula, ...], cur: DataFrame, shared: list[str]) -> DataFrame:
        condition = self._as_condition(body, cur)
        if condition is not None:
            return cur.where(~condition)
        try:
            found = self.body(body, wanted=frozenset(shared))
            if not set(shared) <= set(found.columns):
                raise ir.LogicError("needs its surroundings")
        except ir.LogicError:
            found = self.body(body, cur.select(*shared).distinct() if shared else None, frozenset(shared))
        return self._anti(cur, found, shared)

    def _anti(self, cur: DataFrame, found: DataFrame, shared: list[str]) -> DataFrame:
        if not shared:
            return cur.join(found.limit(1).select(F.lit(1).alias("__x")), F.lit(True), "left_anti")
        same = [c for c in shared if comparable(kind_of(cur.schema[c].dataType), kind_of(found.schema[c].dataType))]
        # distinct before the shuffle, since a value with many rows would send them all to one task
        return cur.join(found.select(*shared).distinct(), shared, "left_anti") if same == shared else cur

    def _either(self, f: ir.Or, cur: DataFrame | None, outside: frozenset[str], bag: bool) -> DataFrame:
        if cur is not None:
            condition = self._as_condition((f,), cur)
            if condition is not None:
                return cur.where(condition)
        needed = ir.free_vars(f) & outside
        try:
            parts = [self.body(b, wanted=frozenset(needed)) for b in f.branches]
            if not all(needed <= set(p.columns) for p in parts) or not needed:
                raise ir.LogicError("a branch leaves open what is used outside")
            names = sorted(needed)
            union = reduce(lambda a, b: a.unionByName(b), (p.select(*names) for p in parts)).distinct()
            return self.join(cur, union, bag)
        except ir.LogicError:
            if cur is None:
                if needed:
                    raise
                cur = self.spark.range(1).select(F.lit(1).alias("__one"))
        names = sorted(set(cur.columns) | needed)
        parts = [self.body(b, cur, frozenset(needed)) for b in f.branches]
        for p in parts:
            if missing := set(names) - set(p.columns):
                raise ir.LogicError(f"unsafe: a branch does not bind {sorted(missing)}")
        return reduce(lambda a, b: a.unionByName(b), (p.select(*names) for p in parts)).distinct()

    # ---- aggregates

    def _aggregate(self, f: ir.Agg, cur: DataFrame | None, outside: frozenset[str], bag: bool) -> DataFrame:
        inner = (ir.body_vars(f.body) | set(ir.term_vars(f.expr))) - set(f.names)
        keys = sorted(inner & (outside - set(ir.term_vars(f.result))))
        wanted = frozenset({*keys, *f.names, *ir.term_vars(f.expr)})
        try:
            rows = self.body(f.body, wanted=wanted, bag=True)
            if not set(keys) <= set(rows.columns):
                raise ir.LogicError("needs its surroundings")
        except ir.LogicError:
            if cur is None or not set(keys) <= set(cur.columns):
                raise
            rows = self.body(f.body, cur.select(*keys).distinct() if keys else None, wanted, bag=True)
        value, kind = None, "int"
        source = f.expr if f.expr is not None else ir.Var(f.names[0]) if f.names else None
        if source is not None and not isinstance(source, ir.Wild):
            value, kind = self.term(source, rows)
        elif f.func not in ("count", "strictcount"):
            raise ir.LogicError(f"{f.func} needs a value")
        out = "__result"
        if f.func == "rank":
            # the ordinals of a group are 1 to its size, whatever its order; large groups are counted out in blocks
            sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
            block = F.lit(1 << 16).cast("long")
            blocks = sizes.select(*keys, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(__n - 1) div 65536"))).alias("__b"))
            last = F.least(F.col("__n"), (F.col("__b") + 1) * block)
            found = blocks.select(*keys, F.explode(F.sequence(F.col("__b") * block + 1, last)).alias(out))
        else:
            found = rows.groupBy(*keys).agg(*self._measures(f, value, kind, out)).where(F.col(out).isNotNull())
            if f.func in ("count", "strictcount"):
                found = found.where(F.col(out) > 0)
            found = found.select(*keys, out)
        if isinstance(f.result, ir.Var) and (cur is None or f.result.name not in cur.columns):
            return self.join(cur, found.withColumnRenamed(out, f.result.name), bag)
        if isinstance(f.result, ir.Wild):
            return self.join(cur, found.drop(out), bag)
        joined = self.join(cur, found, True)
        col, _ = self.term(f.result, joined)
        return joined.where(col == F.col(out)).drop(out)

    def _measures(self, f: ir.Agg, v: Column | None, kind: str, out: str) -> list[Column]:
        if f.func in ("count", "strictcount"):
            return [F.count(F.lit(1)).alias(out)]
        if f.func in ("min", "max", "strictmin", "strictmax"):
            return [(F.min if f.func.endswith("min") else F.max)(v).alias(out)]
        if f.func in ("sum", "strictsum"):
            if kind not in ("int", "real"):
                raise ir.LogicError("sum takes numbers")
            return [F.try_sum(v).alias(out)]
        if f.func == "avg":
            if kind == "real":
                return [F.avg(v).alias(out)]
            if kind != "int":
                raise ir.LogicError("avg takes numbers")
            return [F.call_function("div", F.try_sum(v), F.count(v)).alias(out)]
        if f.func in ("concat", "strictconcat"):
            return [F.array_join(F.sort_array(F.collect_list(v)).cast("array<string>"), f.separator).alias(out)]
        if f.func == "unique":
            return [F.when(F.min(v) == F.max(v), F.min(v)).alias(out)]
        raise ir.LogicError(f"no aggregate {f.func}")

    # ---- rules

    def _theta(self, body: tuple[ir.Formula, ...], wanted: frozenset[str]) -> DataFrame | None:
        """The rows over ``wanted``, each once, of two atoms with comparisons between them; their pairs can be as many as the square of the rows.

        Pairs of rows that alone have their values in the head differ as they are; only pairs with other rows are made distinct.
        """
        atoms = [f for f in body if isinstance(f, ir.Atom)]
        if len(atoms) != 2 or not all(isinstance(f, (ir.Atom, ir.Cmp)) for f in body):
            return None
        names = [ir.free_vars(f) for f in atoms]
        on = sorted(names[0] & names[1])
        across = [f for f in body if isinstance(f, ir.Cmp) and not any(ir.free_vars(f) <= n for n in names)]
        if not on or not across or not all(f.op != "=" and ir.free_vars(f) <= names[0] | names[1] for f in across) or not wanted <= names[0] | names[1]:
            return None
        shown = [sorted(wanted & n) for n in names]
        if not all(set(s) - set(on) for s in shown):
            return None
        sides = []
        for f, own, keys in zip(atoms, names, shown, strict=True):
            local = [x for x in body if isinstance(x, ir.Cmp) and ir.free_vars(x) <= own]
            used = sorted(own & set(on).union(wanted, *map(ir.free_vars, across)))
            side = self.body((f, *local), wanted=frozenset(used)).select(*used)
            rest = [c for c in used if c not in keys]
            if not rest:
                sides.append((side, side.distinct(), None))
                continue
            spans = side.groupBy(*keys).agg(*(g(c).alias(f"{n}:{c}") for c in rest for n, g in (("low", F.min), ("high", F.max))))
            same = reduce(lambda a, b: a & b, (F.col(f"`low:{c}`") == F.col(f"`high:{c}`") for c in rest))
            alone = spans.where(same).select(*keys, *(F.col(f"`low:{c}`").alias(c) for c in rest)).select(*used)
            sides.append((side, alone, side.join(spans.where(~same).select(*keys), keys, "left_semi").select(*used)))
        (_, one, several), (right, other, others) = sides
        if any(one.schema[c].dataType != other.schema[c].dataType for c in on):
            return None

        def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
            joined = spread_join(a, b, on)
            for f in across:
                joined = joined.where(self.condition(f, joined))
            return joined.select(*sorted(wanted))

        rest = [pairs(a, b) for a, b in ((several, right), (one, others)) if a is not None and b is not None]
        return reduce(lambda a, b: a.union(b), [pairs(one, other)] + ([reduce(lambda a, b: a.union(b), rest).distinct()] if rest else []))

    def head(self, rule: ir.Rule) -> DataFrame:
        """The rule's rows: columns c0, c1, ..., each row once."""
        wanted = frozenset(ir.free_vars(rule.head))
        formulas = tuple(map(self._positional, rule.body))
        rows = self._in_parts(formulas, wanted)
        if rows is None:
            rows = self._theta(formulas, wanted)
        once = rows is not None or self._keeps_sets(formulas, wanted)
        if rows is None:
            rows = self.body(formulas, wanted=wanted)
        if missing := wanted - set(rows.columns):
            raise ir.LogicError(f"unsafe: nothing binds {sorted(missing)} in the head of {rule.head.pred}")
        cols = [self.term(a, rows)[0].alias(f"c{i}") for i, a in enumerate(rule.head.args)]
        out = rows.select(*cols) if cols else rows.select(F.lit(1).alias("c0")).limit(1)
        for i, a in enumerate(rule.head.args):
            if isinstance(a, ir.Arith):
                out = out.where(F.col(f"c{i}").isNotNull())
        return out if once and not any(isinstance(a, ir.Arith) for a in rule.head.args) else out.distinct()

    def _keeps_sets(self, body: tuple[ir.Formula, ...], wanted: frozenset[str]) -> bool:
        """Whether the body's rows are distinct as they are: joined sets of which no column is left out."""
        for f in body:
            if isinstance(f, ir.Atom):
                if not self.is_set(f.key) or any(isinstance(a, ir.Wild) for a in f.args) or not ir.free_vars(f) <= wanted:
                    return False
            elif not isinstance(f, (ir.Cmp, ir.Builtin, ir.Not, ir.Forall, ir.Truth)):
                return False
        return bool(wanted)

    def _in_parts(self, body: tuple[ir.Formula, ...], wanted: frozenset[str]) -> DataFrame | None:
        """The body's rows over ``wanted``, each once, where it falls into parts: their distinct rows are joined, so the result needs no distinct()."""
        found = analysis.independent(body, set(wanted))
        if found is None:
            return None
        cut, parts = found
        on, out, exist = [cut] if cut else [], None, []
        for part in parts:
            names = sorted(ir.body_vars(part) & wanted)
            try:
                rows = self.body(part, wanted=frozenset(names))
            except ir.LogicError:
                return None
            if not set(names) <= set(rows.columns):
                return None
            if not names:
                exist.append(rows.limit(1))
                continue
            rows = rows.select(*names).distinct()
            if out is None:
                out = rows
            elif not on:
                out = out.crossJoin(rows)
            elif out.schema[cut].dataType == rows.schema[cut].dataType:
                out = spread_join(out, rows, on)
            else:
                return None
        if out is None:
            return None
        return reduce(lambda a, b: a.join(b, F.lit(True), "left_semi"), exist, out)
