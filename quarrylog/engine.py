"""The engine: relations, rules, fixpoints and queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.operators.materialize import Workspace
from quarrylog.plans import analysis, ir
from quarrylog.plans.compiler import Compiler

Key = tuple[str, int]


class IterationLimit(RuntimeError):
    """A recursion did not end within the allowed number of rounds."""


class BindingLimit(RuntimeError):
    """A rule of a recursion gave more rows than allowed."""


class Engine:
    """Evaluates logic programs over DataFrames.

    Relations are sets of non-null tuples, known by name and arity. Predicates
    without recursion stay lazy, so Catalyst sees through them; a recursive
    group runs as a semi-naive loop whose deltas are written to the shared
    checkpoint folder.
    """

    def __init__(self, spark: SparkSession, max_iterations: int = 100, allow_partial: bool = False, max_bindings: int = 0):
        self.spark = spark
        self.max_iterations, self.allow_partial, self.max_bindings = max_iterations, allow_partial, max_bindings
        self.stored: dict[Key, DataFrame] = {}
        self.sets: set[Key] = set()
        self.columns: dict[str, list[str]] = {}
        self.declared: dict[Key, T.StructType] = {}
        self.rules: dict[Key, list[ir.Rule]] = {}
        self.workspace = Workspace(spark)
        self.rounds: dict[Key, int] = {}

    def close(self) -> None:
        """Delete the tables of fixpoints; results that read them must have been used."""
        self.workspace.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ---- relations and rules

    def add_relation(self, name: str, df: DataFrame, distinct: bool = False) -> Engine:
        """A stored relation. Integers become 64 bits wide; a null is no value and fits no variable or constant."""
        cols = []
        for i, f in enumerate(df.schema.fields):
            c = F.col(f"`{f.name}`")
            wide = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType))
            cols.append((c.cast("int").cast("long") if isinstance(f.dataType, T.BooleanType) else c.cast("long") if wide else c).alias(f"c{i}"))
        out = df.select(*cols)
        self.columns[name] = df.columns
        self.stored[name, len(cols)] = out.distinct() if distinct else out
        (self.sets.add if distinct else self.sets.discard)((name, len(cols)))
        return self

    def declare(self, name: str, schema: T.StructType) -> Engine:
        """A relation that may stay empty."""
        self.declared[name, len(schema)] = T.StructType([T.StructField(f"c{i}", f.dataType, False) for i, f in enumerate(schema)])
        self.columns.setdefault(name, schema.names)
        return self

    def add_rules(self, program: str | list[ir.Rule]) -> Engine:
        if isinstance(program, str):
            from quarrylog.ql.datalog import parse_program

            program = parse_program(program).rules
        for r in program:
            self._add(r)
        return self

    def _add(self, rule: ir.Rule) -> None:
        head = rule.head
        if any(isinstance(a, ir.Wild) for a in head.args):
            raise ir.LogicError(f"_ in the head of {head.pred}")
        self.rules.setdefault(head.key, []).append(ir.Rule(head, analysis.normal(rule.body)))

    def columns_of(self, pred: str) -> list[str]:
        if pred in self.columns:
            return self.columns[pred]
        raise ir.LogicError(f"the columns of {pred} have no names")

    # ---- evaluation

    def query(self, query: str | ir.Query) -> DataFrame:
        """The rows of a query, each once; columns are named by label, or col0, col1, ..."""
        if isinstance(query, str):
            from quarrylog.ql.datalog import parse_program

            program = parse_program(query)
            for r in program.rules:
                self._add(r)
            query = program.query
            if query is None:
                raise ir.LogicError("the program has no query")
        head = ir.Atom("__query", tuple(t for t, _ in query.select))
        rule = ir.Rule(head, analysis.normal(query.body))
        roots = [k for k, _ in ir.dependencies(rule)]
        results, empty = self._evaluate(roots)
        body = analysis.simplified(rule.body, empty)
        if body is None and any(k not in self.declared for k in empty.intersection(self._resolve(roots))):
            results, _ = self._evaluate(roots, prune=False)  # for the columns' types
            body = rule.body
        rows = self._compiler(results).head(ir.Rule(head, rule.body if body is None else body))
        return rows.toDF(*(label or f"col{i}" for i, (_, label) in enumerate(query.select)))

    def relation(self, name: str, arity: int) -> DataFrame:
        """A derived or stored relation, columns c0, c1, ..."""
        results, empty = self._evaluate([(name, arity)])
        if (name, arity) in empty and (name, arity) not in self.declared:
            results, _ = self._evaluate([(name, arity)], prune=False)
        return self._lookup(results)((name, arity))

    def explain(self, query: str | ir.Query) -> str:
        """The physical plan of a query."""
        return self.query(query)._jdf.queryExecution().toString()

    def _compiler(self, results: dict[Key, DataFrame]) -> Compiler:
        return Compiler(self.spark, self._lookup(results), self.columns_of, lambda key: key in results or key in self.sets)

    def _lookup(self, results: dict[Key, DataFrame]):
        def find(key: Key) -> DataFrame:
            if key in results:
                return results[key]
            if key in self.stored:
                return self.stored[key]
            if key in self.declared:
                return self.spark.createDataFrame([], self.declared[key])
            others = sorted({a for n, a in {*results, *self.stored, *self.declared, *self.rules} if n == key[0]})
            raise ir.LogicError(f"no predicate {key[0]} with {key[1]} arguments" + (f" (it takes {others})" if others else ""))

        return find

    def _resolve(self, keys) -> list[Key]:
        """Arity of atoms with named columns, and rules of closures, which are made when first used."""
        out = []
        for name, arity in keys:
            if arity == -1:
                arity = len(self.columns_of(name))
            if name.endswith("+") and (name, 2) not in self.rules:
                self.rules[name, 2] = analysis.closure_rules(name[:-1])
            out.append((name, arity))
        return out

    def _graph(self, rules: dict[Key, list[ir.Rule]], roots) -> dict[Key, set[Key]]:
        """What each predicate that the roots need depends on."""
        graph: dict[Key, set[Key]] = {}
        todo = self._resolve(roots)
        while todo:
            key = todo.pop()
            if key not in graph:
                graph[key] = set(self._resolve(k for r in rules.get(key, ()) for k, _ in ir.dependencies(r)))
                todo += graph[key]
        return graph

    def _evaluate(self, roots, prune: bool = True) -> tuple[dict[Key, DataFrame], set[Key]]:
        """Results of all derived predicates that the roots need, and relations known to be empty without looking.

        Declared relations that were not given are empty, and so is what depends on them: rules over them are left out.
        """
        graph = self._graph(self.rules, roots)
        analysis.check_strata(self.rules, analysis.components(graph))
        nothing = {k for k in graph if k in self.declared and k not in self.stored and k not in self.rules} if prune else set()
        self._live, empty = analysis.pruned(self.rules, graph, nothing, self.stored)
        self._live = analysis.without_implied(self._live, analysis.components(self._graph(self._live, roots)), self.stored)
        live = self._graph(self._live, roots)
        results: dict[Key, DataFrame] = {}
        for group in analysis.components(live):
            if not any(k in self._live for k in group):
                continue
            if len(group) == 1 and group[0] not in live[group[0]]:
                results[group[0]] = self._plain(group[0], results)
            else:
                self._fixpoint(group, results)
        return results, empty

    def _facts(self, key: Key) -> DataFrame | None:
        if key in self.stored:
            return self.stored[key].distinct()
        return None

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        names = [f"c{i}" for i in range(len(parts[0].columns))]
        kinds = [{p.schema[c].dataType.simpleString() for p in parts} for c in names]
        wide = ["double" if k == {"bigint", "double"} else None for k in kinds]
        cast = [p.select(*(F.col(c).cast(w) if w else F.col(c) for c, w in zip(names, wide, strict=True))) for p in parts]
        return cast[0] if len(cast) == 1 else reduce(lambda a, b: a.union(b), cast).distinct()

    def _plain(self, key: Key, results: dict[Key, DataFrame]) -> DataFrame:
        compiler = self._compiler(results)
        parts = [compiler.head(r) for r in self._live[key]]
        facts = self._facts(key)
        return self._union(parts + ([facts] if facts is not None else []))

    def _fixpoint(self, group: list[Key], results: dict[Key, DataFrame]) -> None:
        """Semi-naive evaluation of mutually recursive predicates."""
        inside = set(group)
        first: dict[Key, list[DataFrame]] = {k: [] for k in group}
        steps: list[tuple[Key, ir.Rule, int]] = []
        compiler = self._compiler(results)
        for key in group:
            for rule in self._live.get(key, ()):
                for body in analysis.alternatives(rule.body):
                    r = ir.Rule(rule.head, body)
                    places = [i for i, f in enumerate(body) if isinstance(f, ir.Atom) and f.key in inside]
                    nested = [k for f in body if not isinstance(f, ir.Atom) for b in ir.subformulas(f) for k, _ in ir.dependencies(ir.Rule(r.head, b)) if k in inside]
                    if nested:
                        raise ir.LogicError(f"the recursion through {nested[0][0]} lies within a subformula of {key[0]}")
                    if places:
                        steps += [(key, r, i) for i in places]
                    else:
                        first[key].append(compiler.head(r))
            facts = self._facts(key)
            if facts is not None:
                first[key].append(facts)
        known: dict[Key, list[DataFrame]] = {}
        schemas = self._schemas(group, first, steps, results)
        empty = {k: self.spark.createDataFrame([], schemas[k]) for k in group}
        typed = lambda key, df: df.select(*(F.col(c.name).cast(c.dataType) for c in schemas[key]))
        sources = [k for k in group if first[k]]
        begun = self.workspace.settle_all([typed(k, self._union(first[k])) for k in sources])
        delta = {**empty, **{k: df for k, (df, _) in zip(sources, begun, strict=True)}}
        rows = {k: n for k, (_, n) in zip(sources, begun, strict=True)}
        for key in group:
            known[key] = [delta[key]]
        rounds = 0
        while any(rows.values()):
            if self.max_iterations and rounds >= self.max_iterations:
                if self.allow_partial:
                    break
                raise IterationLimit(f"{', '.join(k[0] for k in group)}: no fixpoint after {rounds} rounds")
            rounds += 1
            whole = {k: reduce(lambda a, b: a.union(b), v) for k, v in known.items()}
            fresh: dict[Key, list[DataFrame]] = {k: [] for k in group}
            for key, rule, place in steps:
                literal = rule.body[place]
                if not rows.get(literal.key):
                    continue  # nothing new to join with
                changed = ("Δ" + literal.pred, literal.key[1])
                body = tuple(ir.Atom(changed[0], f.args) if i == place else f for i, f in enumerate(rule.body))
                at = {**results, **whole, changed: delta[literal.key]}
                fresh[key].append(self._compiler(at).head(ir.Rule(rule.head, body)))
            grown = [k for k in group if fresh[k]]
            unseen = [typed(k, self._union(fresh[k])).join(whole[k], schemas[k].names, "left_anti").select(*schemas[k].names) for k in grown]
            done = dict(zip(grown, self.workspace.settle_all(unseen), strict=True))
            rows = {k: n for k, (_, n) in done.items()}
            for key, n in rows.items():
                if self.max_bindings and n > self.max_bindings:
                    raise BindingLimit(f"{key[0]}: more than {self.max_bindings} rows in a round")
            after = {k: done[k][0] if rows.get(k) else empty[k] for k in group}
            for key in group:
                if rows.get(key):
                    known[key].append(after[key])
                if len(known[key]) > 8:  # few files to read, and a short plan
                    merged = self.workspace.settle(reduce(lambda a, b: a.union(b), known[key][:-1]))
                    for old in known[key][:-1]:
                        self.workspace.forget(old)
                    known[key] = [merged, known[key][-1]]
            delta = after
        for key in group:
            results[key] = reduce(lambda a, b: a.union(b), known[key])
            self.rounds[key] = rounds

    def _schemas(self, group: list[Key], first, steps, results) -> dict[Key, T.StructType]:
        """Column types of a recursive group, from the rules without recursion, then through the others."""
        found: dict[Key, T.StructType] = {}
        for key in group:
            if first[key]:
                found[key] = self._union(first[key]).schema
            elif key in self.declared:
                found[key] = self.declared[key]
        for _ in group:
            for key, rule, _ in steps:
                needs = {f.key for f in rule.body if isinstance(f, ir.Atom) and f.key in group}
                if key not in found and needs <= set(found):
                    empty = {k: self.spark.createDataFrame([], found[k]) for k in needs}
                    found[key] = self._compiler({**results, **empty}).head(rule).schema
        if missing := [k[0] for k in group if k not in found]:
            raise ir.LogicError(f"{', '.join(missing)}: every rule is recursive")
        return {k: T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(s)]) for k, s in found.items()}
