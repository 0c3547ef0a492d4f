"""Derived relations over code facts, and the class library over them."""

import pytest

from quarrylog.library import bridge, relations
from quarrylog.library.code import code_engine, read_facts
from quarrylog.ql.lower import lower_module
from quarrylog.sources import factfile
from quarrylog.sources.tables import save_relations


def facts(spark, **given):
    return {n: spark.createDataFrame(rows, relations.schema(n)) for n, rows in given.items()}


def ask(spark, name, arity, **given):
    return sorted(map(tuple, code_engine(spark, facts(spark, **given)).relation(name, arity).collect()))


FLOW = {"SymInFunction": [(1, 9), (2, 9), (3, 9), (4, 9)], "ExprMayRef": [(101, 1), (102, 2), (103, 3), (104, 4)]}


def test_call_graph(spark):
    assert ask(spark, "CallTarget", 2, CallCalleeSym=[(10, 20)], FunctionSymbol=[(20, 30)]) == [(10, 30)]
    classes = {"MethodCall": [(1, 50, "run")], "ExprType": [(50, 7)], "InterfaceDecl": [(7, "I", 0)], "Implements": [(8, 7), (9, 7)], "ClassDecl": [(8, "A", 0), (9, "B", 0)], "MethodDecl": [(8, "run", 80), (9, "run", 90)]}
    assert ask(spark, "CallTarget", 2, **classes) == [(1, 80), (1, 90)]
    assert ask(spark, "CallTargetRTA", 2, NewExpr=[(5, 9)], **classes) == [(1, 90)]
    assert ask(spark, "MethodDeclInherited", 3, Extends=[(2, 1), (3, 2)], MethodDecl=[(1, "m", 11), (1, "n", 12), (2, "n", 22)], ClassDecl=[(1, "a", 0), (2, "b", 0), (3, "c", 0)]) == [(2, "m", 11), (3, "m", 11), (3, "n", 22)]


def test_local_flow_and_summaries(spark):
    given = {**FLOW, "Assign": [(0, 101, 2)], "VarDecl": [(0, 3, 102, 1)], "ReturnStmt": [(9, 0, 103)], "ReturnSym": [(9, 4)], "Parameter": [(9, 0, "p", 0, 1, "")]}
    assert ask(spark, "LocalFlow", 3, **given) == [(9, 1, 2), (9, 2, 3), (9, 3, 4)]
    assert len(ask(spark, "LocalFlowStar", 3, **given)) == 6
    assert ask(spark, "ParamToReturn", 2, **given) == [(9, 0)]
    assert ask(spark, "ParamToCallArg", 4, CallArg=[(60, 1, 103)], FunctionContains=[(9, 60)], CallCalleeSym=[(60, 77)], **given) == [(9, 0, 77, 1)]
    assert ask(spark, "ParamToFieldWrite", 3, FieldWrite=[(61, 5, "f", 103)], FunctionContains=[(9, 61)], **given) == [(9, 0, "f")]
    assert ask(spark, "ParamToSink", 3, TaintSink=[(103, "sql")], **given) == [(9, 0, "sql")]
    assert ask(spark, "SourceToReturn", 2, TaintSource=[(101, "in")], FunctionContains=[(9, 101)], **given) == [(9, "in")]


def test_composition_and_higher_order(spark):
    given = {"CallCalleeSym": [(60, 70)], "FunctionSymbol": [(70, 9), (71, 8)], "CallArg": [(60, 0, 200), (61, 0, 201)], "ExprMayRef": [(200, 20), (201, 71), (202, 21), (101, 1), (104, 4)], "CallResultSym": [(60, 30)],
             "Parameter": [(9, 0, "p", 0, 1, ""), (8, 0, "q", 0, 5, "")], "Assign": [(0, 101, 4)], "SymInFunction": [(1, 9), (4, 9)], "ReturnSym": [(9, 4)], "MethodCall": [(61, 202, "map")]}
    assert ask(spark, "InterFlow", 2, **given) == [(20, 30), (21, 5)]
    assert (20, 30) in ask(spark, "FlowStar", 2, **given)
    assert ask(spark, "FlowStar", 2, AdditionalFlowStep=[(1, 2)], AdditionalTaintStep=[(2, 3)]) == [(1, 2), (1, 3), (2, 3)]


def test_taint(spark):
    given = {**FLOW, "TaintSource": [(101, "in")], "Assign": [(0, 101, 2)], "TaintSink": [(102, "sql"), (104, "xss")]}
    assert ask(spark, "TaintedSym", 2, **given) == [(1, "in"), (2, "in")]
    assert ask(spark, "TaintAlert", 4, **given) == [(101, 102, "in", "sql")]
    cut = {"SymbolType": [(2, 5)], "NonTaintableType": [(5,)]}
    assert ask(spark, "TaintAlert", 4, **given, **cut) == []
    fields = {**FLOW, "TaintSource": [(101, "in")], "FieldWrite": [(0, 4, "f", 101)], "FieldRead": [(103, 4, "f")]}
    assert ask(spark, "TaintedField", 3, **fields) == [(4, "f", "in")]
    assert (3, "in") in ask(spark, "TaintedSym", 2, **fields)
    inside = {"TaintSource": [(1, "in")], "VarDecl": [(0, 7, 1, 0)], "TaintSink": [(50, "xss")], "Contains": [(50, 51), (51, 52)], "ExprMayRef": [(52, 7)]}
    assert ask(spark, "TaintAlert", 4, **inside) == [(1, 50, "in", "xss")]


def test_frameworks(spark):
    handler = {"CallArg": [(1, 1, 40)], "ExprMayRef": [(40, 41), (60, 71)], "FunctionSymbol": [(41, 9)], "Parameter": [(9, 0, "req", 0, 70, ""), (9, 1, "res", 0, 71, "")], "FieldRead": [(80, 70, "query"), (81, 70, "url"), (82, 70, "other")]}
    express = {**handler, "MethodCall": [(1, 0, "get"), (2, 60, "send")], "CallArg": [(1, 1, 40), (2, 0, 90)]}
    assert ask(spark, "TaintSource", 2, **express) == [(80, "http_input")]
    assert ask(spark, "TaintSink", 2, **express) == [(90, "xss")]
    http = {**handler, "CallCalleeSym": [(1, 5)], "ImportBinding": [(5, "http", "createServer")]}
    assert ask(spark, "TaintSource", 2, **http) == [(81, "http_input")]
    exported = {**handler, "ExportBinding": [("handler", 41, 0)]}
    assert ask(spark, "TaintSource", 2, **exported) == [(80, "http_input"), (81, "http_input"), (82, "http_input")]
    sql = {"ImportBinding": [(5, "pg", "Client")], "MethodCall": [(1, 60, "execute")], "ExprMayRef": [(60, 5)], "CallArg": [(1, 0, 90)]}
    assert ask(spark, "TaintSink", 2, **sql) == [(90, "sql")]
    assert ask(spark, "Sanitizer", 2, ImportBinding=[(5, "he", "encode"), (6, "shell-quote", "quote")], FunctionSymbol=[(5, 50), (6, 60)]) == [(50, "xss"), (60, "command_injection")]


def test_value_flow(spark):
    given = {"ExprValueSource": [(1, 1), (8, 8)], "VarDecl": [(0, 7, 1, 1)], "ExprMayRef": [(2, 7), (3, 9)], "CallCalleeSym": [(5, 6)], "FunctionSymbol": [(6, 4)], "CallArg": [(5, 0, 2)], "Parameter": [(4, 0, "p", 0, 9, "")], "Await": [(10, 3)], "ObjectLiteralField": [(11, "f", 10)]}
    assert ask(spark, "ParamBinding", 4, **given) == [(4, 0, 9, 2)]
    assert [v for v, s in ask(spark, "MayResolveTo", 2, **given) if s == 1] == [1, 2, 3, 10, 11]
    assert ask(spark, "ParamBinding", 4, ParameterRest=[(4, 0)], **given) == []
    assert ask(spark, "CallTargetCrossModule", 2, CallCalleeSym=[(5, 6)], ImportBinding=[(6, "./m", "f")], ExportBinding=[("f", 8, 0)], FunctionSymbol=[(8, 80)]) == [(5, 80)]


def test_class_library(spark):
    given = facts(spark, Function=[(1, "f", 0, 1, 0, 0), (2, "g", 1, 0, 0, 0)], Parameter=[(1, 0, "x", 0, 0, ""), (1, 1, "y", 0, 0, "")], Call=[(5, 6, 4)], Node=[(6, 0, "Identifier", 3, 1, 3, 9)], TaintAlert=[(1, 2, "in", "sql")])
    run = lambda text: sorted(map(tuple, (lambda p: code_engine(spark, given).add_rules(p.rules).query(p.query))(lower_module(text, bridge.Loader(), relations.entity)).collect()))
    assert run("import code::functions from Function f where f.isAsync() select f.getName()") == [("f",)]
    assert run("import code::functions from Function f, Parameter p where p = f.getAParameter() select f, p.getName()") == [(1, "x"), (1, "y")]
    assert run("import code::base import code::calls from Call c where c.getArity() > 3 select c, c.getCalleeNode().getKind()") == [(5, "Identifier")]
    assert run("import code::taint from TaintAlert a select a.getSrcKind(), a.getSinkKind()") == [("in", "sql")]
    assert run("import javascript from CallExpr c select c.getNumArgument()") == [(4,)]


@pytest.mark.parametrize("library", list(bridge.LIBRARIES))
def test_every_library_lowers(library):
    program = lower_module(f"import code::{library} select 1", bridge.Loader(), relations.entity)
    assert program.query and program.rules


def test_fact_files(spark, tmp_path):
    given = {"Symbol": [(-5, "näme", 2, 3), (7, "", 0, 0)], "Call": [], "FieldRead": [(1, 2, "f")]}
    data = factfile.encode(given)
    path = tmp_path / "x.db"
    path.write_bytes(data)
    got = factfile.read(spark, str(path))
    assert {n: sorted(map(tuple, df.collect())) for n, df in got.items()} == {n: sorted(v) for n, v in given.items()}
    for bad in (b"", data[:4] + b"\xff" * 4 + data[8:]):
        with pytest.raises(factfile.FactFileError):
            factfile.parse(bad)
    save_relations(code_engine(spark, got), str(tmp_path / "out"), ("FieldRead", 3))
    assert read_facts(spark, str(tmp_path / "out"))["FieldRead"].first().fieldName == "f"


def test_named_columns_of_derived_relations_and_empty_ones(spark):
    e = code_engine(spark, facts(spark, CallCalleeSym=[(10, 20)], FunctionSymbol=[(20, 30)]))
    assert e.query("select c, f where CallTarget(call: c, fn: f).").collect() == [(10, 30)]
    assert e.query("select c where CallTarget(c, _), not TaintAlert(c, _, _, _).").collect() == [(10,)]
    assert e.query("select s where TaintAlert(s, _, _, _).").collect() == []
    assert e.query("select s where ArgSym(s, _, _).").collect() == []
    assert e.query("select n where n = count(s | TaintAlert(s, _, _, _)).").collect() == []
    assert e.query("select c where CallTarget(c, _), (TaintAlert(c, _, _, _) or c = 10).").collect() == [(10,)]


def ask_ql(spark, given, text):
    parsed = lower_module(text, bridge.Loader(), relations.entity)
    return sorted(map(tuple, code_engine(spark, given).add_rules(parsed.rules).query(parsed.query).collect()))


#: Declarations contain their patterns: 1 is a declaration, 2 its pattern. Calls are their own expressions.
CONTEXT = {
    "VarDecl": [(1, 10, 100, 1), (2, 0, 201, 1), (3, 0, 102, 1)], "CallCalleeSym": [(100, 90), (201, 91), (202, 12), (203, 92)], "ExprIsCall": [(101, 201), (104, 202), (301, 203)], "Cast": [(102, 104)],
    "ImportBinding": [(90, "react", "createContext"), (91, "react", "useState"), (92, "react", "useContext")], "ArrayDestructure": [(21, 1, 11)], "JsxElement": [(5, 50, 0)], "FieldRead": [(50, 10, "Provider")],
    "JsxAttribute": [(5, "value", 60)], "Contains": [(60, 61), (2, 21), (3, 31)], "ObjectLiteralSpread": [(61, 62)], "ObjectLiteralField": [(62, "set", 63)], "ExprMayRef": [(63, 11), (64, 10)], "FunctionSymbol": [(12, 9)], "ReturnStmt": [(9, 0, 301)],
    "CallArg": [(203, 0, 64)], "DestructureField": [(31, "set", "set", 13, 0)],
}


def test_react_context(spark):
    given = facts(spark, **CONTEXT)
    run = lambda text: ask_ql(spark, given, "import code::react " + text)
    assert run("from int s where isUseStateSetterSym(s) select s") == [(11,)]
    assert run("from int c, string f, int s where contextProviderField(c, f, s) select c, f, s") == [(10, "set", 11)]
    assert run("from int c, string f, int s where contextDestructureBinding(c, f, s) select c, f, s") == [(10, "set", 13)]
    assert run("from int s where useStateSetterAliasV2(s) select s") == [(11,), (13,)]


def test_setters_called_in_updaters(spark):
    """Outer calls 401 (direct setter) and 402 (through the context), with updaters that call each other's setter, one of them two functions deep."""
    more = {
        "CallCalleeSym": [(401, 11), (402, 13), (411, 13), (412, 11), (420, 11)], "Call": [(401, 501, 1), (402, 502, 1), (411, 511, 1), (412, 512, 1), (420, 520, 1)],
        "Node": [(501, 0, "Identifier", 7, 1, 7, 9), (502, 0, "Identifier", 8, 1, 8, 9), (520, 0, "Identifier", 9, 1, 9, 9), (401, 0, "CallExpression", 70, 1, 70, 9)],
        "CallArg": [(401, 0, 601), (402, 0, 602), (420, 0, 603)], "Function": [(601, "", 1, 0, 0, 0), (602, "", 1, 0, 0, 0), (603, "", 1, 0, 0, 0), (604, "", 1, 0, 0, 0), (605, "", 1, 0, 0, 0)],
        "FunctionContains": [(601, 411), (602, 604), (604, 605), (605, 412)],
    }
    given = facts(spark, **{k: CONTEXT.get(k, []) + more.get(k, []) for k in {*CONTEXT, *more}})
    run = lambda name: ask_ql(spark, given, f"import code::react from int c, int l where {name}(c, l) select c, l")
    assert run("setStateUpdaterCallsFn") == [(401, 7)]
    assert run("setStateUpdaterCallsOtherSetState") == []
    assert run("setStateUpdaterCallsOtherSetStateThroughProps") == []
    assert run("setStateUpdaterCallsOtherSetStateThroughContext") == [(401, 7), (402, 8)]
    assert run("setStateUpdaterCallsOtherSetStateThroughContext_outerCtx") == [(402, 8)]
    assert run("setStateUpdaterCallsOtherSetStateThroughContext_innerCtx") == [(401, 7)]


def test_dataflow_configuration(spark):
    steps = [(1, 2), (2, 3), (3, 4), (5, 6), (8, 9)]
    given = facts(spark, Symbol=[(i, f"s{i}", 0, 0) for i in range(1, 10)], LocalFlow=[(0, a, b) for a, b in steps], LocalFlowStar=[(0, a, b) for a in range(1, 5) for b in range(a + 1, 5)] + [(0, 5, 6), (0, 8, 9)])
    config = """import code::pathgraph class C extends DataFlow::Configuration {{ C() {{ Symbol(this, "s7", _, _) }}
      override predicate isSource(DataFlow::Node n) {{ n.getName() = "s1" or n.getName() = "s8" or n.getName() = "s5" }} override predicate isSink(DataFlow::Node n) {{ n.getName() = "s4" or n.getName() = "s6" or n.getName() = "s9" or n.getName() = "s5" }}
      {} }} from C c, DataFlow::Node a, DataFlow::Node b where c.hasFlow(a, b) select a, b"""
    assert ask_ql(spark, given, config.format("")) == [(1, 4), (5, 5), (5, 6), (8, 9)]
    assert ask_ql(spark, given, config.format('override predicate isBarrier(DataFlow::Node n) { n.getName() = "s3" or n.getName() = "s9" }')) == [(5, 5), (5, 6)]
    assert ask_ql(spark, given, config.format('override predicate isAdditionalFlowStep(DataFlow::Node a, DataFlow::Node b) { a.getName() = "s2" and b.getName() = "s5" }')) == [(1, 4), (1, 5), (1, 6), (5, 5), (5, 6), (8, 9)]
