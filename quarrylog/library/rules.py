"""Derived relations over code facts, as logic programs.

Framework knowledge is data: which calls register handlers, which request fields
bring in input, which response methods send it out. A few helper relations
(ArgSym, Param, Callback, ReceiverSym, Handler) carry the joins that most rules
share.
"""

from __future__ import annotations

HELPERS = """
ArgSym(call, i, s) :- CallArg(call, i, e), ExprMayRef(e, s).
Param(fn, i, s) :- Parameter(fn, i, _, _, s, _).
Callback(call, i, fn) :- ArgSym(call, i, s), FunctionSymbol(s, fn).
ReceiverSym(call, m, s) :- MethodCall(call, e, m), ExprMayRef(e, s).
ReceiverType(call, m, t) :- MethodCall(call, e, m), ExprType(e, t).
Implementation(i, c) :- InterfaceDecl(i, _, _), Implements(c, i).
"""

CALL_GRAPH = """
CallTarget(call, fn) :- CallCalleeSym(call, s), FunctionSymbol(s, fn).
CallTarget(call, fn) :- ReceiverType(call, m, c), ClassDecl(c, _, _), MethodDecl(c, m, fn).
CallTarget(call, fn) :- ReceiverType(call, m, i), Implementation(i, c), MethodDecl(c, m, fn).
Instantiated(c) :- NewExpr(_, c).
CallTargetRTA(call, fn) :- ReceiverType(call, m, i), Implementation(i, c), Instantiated(c), MethodDecl(c, m, fn).
MethodDeclDirect(c, m, fn) :- MethodDecl(c, m, fn), ClassDecl(c, _, _).
MethodDeclInherited(c, m, fn) :- Extends(c, p), (MethodDecl(p, m, fn); MethodDeclInherited(p, m, fn)), not MethodDeclDirect(c, m, _).
"""

LOCAL_FLOW = """
Moves(a, b) :- Assign(_, e, b), ExprMayRef(e, a).
Moves(a, b) :- VarDecl(_, b, e, _), ExprMayRef(e, a).
Moves(a, b) :- VarDecl(d, _, e, _), DestructureField(d, _, _, b, _), ExprMayRef(e, a).
Moves(a, b) :- FieldRead(e, a, _), ExprMayRef(e, b).
Moves(a, b) :- FieldWrite(_, b, _, e), ExprMayRef(e, a).
LocalFlow(fn, a, b) :- Moves(a, b), SymInFunction(a, fn), SymInFunction(b, fn).
LocalFlow(fn, a, b) :- ReturnStmt(fn, _, e), ExprMayRef(e, a), SymInFunction(a, fn), ReturnSym(fn, b).
LocalFlowStar(fn, a, b) :- LocalFlow(fn, a, b).
LocalFlowStar(fn, a, c) :- LocalFlowStar(fn, a, b), LocalFlow(fn, b, c).
"""

SUMMARIES = """
FromParam(fn, i, s) :- Param(fn, i, p), LocalFlowStar(fn, p, s).
IntoReturn(fn, s) :- ReturnSym(fn, r), LocalFlowStar(fn, s, r).
ParamToReturn(fn, i) :- FromParam(fn, i, r), ReturnSym(fn, r).
ParamToCallArg(fn, i, callee, j) :- FromParam(fn, i, s), ArgSym(call, j, s), FunctionContains(fn, call), CallCalleeSym(call, callee).
ParamToFieldWrite(fn, i, field) :- FromParam(fn, i, s), ExprMayRef(e, s), FieldWrite(w, _, field, e), FunctionContains(fn, w).
ParamToSink(fn, i, kind) :- FromParam(fn, i, s), ExprMayRef(e, s), TaintSink(e, kind).
SourceToReturn(fn, kind) :- TaintSource(e, kind), FunctionContains(fn, e), ExprMayRef(e, s), IntoReturn(fn, s).
CallReturnToReturn(fn, call) :- FunctionContains(fn, call), CallResultSym(call, s), IntoReturn(fn, s).
"""

COMPOSITION = """
InterFlow(a, r) :- CallTarget(call, fn), ArgSym(call, i, a), ParamToReturn(fn, i), CallResultSym(call, r).
InterFlow(a, b) :- CallTarget(call, fn), ArgSym(call, i, a), ParamToCallArg(fn, i, callee, j), FunctionSymbol(callee, g), CallTarget(inner, g), ArgSym(inner, j, b).
FlowStar(a, b) :- LocalFlowStar(_, a, b).
FlowStar(a, b) :- InterFlow(a, b).
FlowStar(a, b) :- AdditionalTaintStep(a, b).
FlowStar(a, b) :- AdditionalFlowStep(a, b).
FlowStar(a, c) :- FlowStar(a, b), FlowStar(b, c).
"""

HIGHER_ORDER = """
ElementArgument("map", 0). ElementArgument("forEach", 0). ElementArgument("filter", 0).
ElementArgument("reduce", 1). ElementArgument("then", 0).
InterFlow(a, p) :- ElementArgument(m, i), ReceiverSym(call, m, a), Callback(call, 0, fn), Param(fn, i, p).
"""

TAINT = """
TaintedSym(s, kind) :- TaintSource(e, kind), (ExprMayRef(e, s); VarDecl(_, s, e, _)).
TaintedSym(b, kind) :- TaintedSym(a, kind), FlowStar(a, b), not SanitizedEdge(a, b, kind).
TaintedSym(s, kind) :- TaintedField(base, field, kind), FieldRead(e, base, field), ExprMayRef(e, s).
TaintedField(base, field, kind) :- FieldWrite(_, base, field, e), ExprMayRef(e, s), TaintedSym(s, kind).
SanitizedEdge(a, r, kind) :- FlowStar(a, r), CallResultSym(call, r), CallTarget(call, fn), Sanitizer(fn, kind).
SanitizedEdge(a, b, kind) :- FlowStar(a, b), SymbolType(b, t), NonTaintableType(t), TaintSource(_, kind).
SinkContains(sink, e) :- TaintSink(sink, _), Contains(sink, e).
SinkContains(sink, e) :- SinkContains(sink, m), Contains(m, e).
SinkRefSym(sink, s) :- TaintSink(sink, _), ExprMayRef(sink, s).
SinkRefSym(sink, s) :- SinkContains(sink, e), ExprMayRef(e, s).
Declared(src, kind, s) :- TaintSource(src, kind), VarDecl(_, s, src, _), TaintedSym(s, kind).
TaintAlert(src, sink, kind, what) :- TaintSource(src, kind), ExprMayRef(src, _), TaintedSym(s, kind), ExprMayRef(sink, s), TaintSink(sink, what).
TaintAlert(src, sink, kind, what) :- Declared(src, kind, s), SinkRefSym(sink, s), TaintSink(sink, what).
TaintAlert(src, sink, kind, what) :- Declared(src, kind, a), FlowStar(a, s), SinkRefSym(sink, s), TaintSink(sink, what).
"""

# Framework methods, fields, modules and sanitizers.
FRAMEWORK_FACTS = {
    "ExpressMethod": ["get", "post", "put", "delete", "use", "patch"],
    "FastifyMethod": ["get", "post", "put", "delete", "patch", "head", "options"],
    "HttpModule": ["http", "https"],
    "RequestField": [
        ("express", "query"), ("express", "params"), ("express", "body"), ("http", "url"), ("http", "headers"), ("http", "method"),
        ("koa", "query"), ("fastify", "body"), ("fastify", "query"), ("fastify", "params"), ("next", "query"), ("next", "body"),
    ],
    "NestedField": [("koa", "request", "body"), ("koa", "request", "query")],
    "ResponseMethod": [("express", "send"), ("http", "write"), ("http", "end"), ("fastify", "send"), ("next", "send"), ("next", "json")],
    "SqlDriver": ["pg", "mysql", "mysql2", "better-sqlite3"],
    "SqlMethod": ["query", "execute"],
    "NoSqlMethod": ["find", "findOne", "aggregate"],
    "SanitizerOf": [
        ("dompurify", "sanitize", "xss"), ("xss", "default", "xss"), ("escape-html", "default", "xss"), ("he", "encode", "xss"), ("he", "escape", "xss"),
        ("sanitize-html", "default", "xss"), ("sqlstring", "escape", "sql"), ("sqlstring", "format", "sql"),
        ("shell-escape", "default", "command_injection"), ("shell-quote", "quote", "command_injection"),
    ],
}

FRAMEWORKS = """
ExpressHandler(fn) :- ExpressMethod(m), MethodCall(call, _, m), Callback(call, _, fn).
HttpHandler(fn) :- HttpModule(mod), ImportBinding(s, mod, "createServer"), CallCalleeSym(call, s), Callback(call, _, fn).
KoaHandler(fn) :- MethodCall(call, _, "use"), Callback(call, _, fn).
FastifyHandler(fn) :- FastifyMethod(m), MethodCall(call, _, m), Callback(call, _, fn).
LambdaHandler(fn) :- ExportBinding("handler", s, _), FunctionSymbol(s, fn).
NextjsHandler(fn) :- ExportBinding("default", s, _), FunctionSymbol(s, fn).
Handler("express", fn) :- ExpressHandler(fn).
Handler("http", fn) :- HttpHandler(fn).
Handler("koa", fn) :- KoaHandler(fn).
Handler("fastify", fn) :- FastifyHandler(fn).
Handler("next", fn) :- NextjsHandler(fn).
TaintSource(e, "http_input") :- Handler(w, fn), RequestField(w, field), Param(fn, 0, s), FieldRead(e, s, field).
TaintSource(e, "http_input") :- Handler(w, fn), NestedField(w, outer, inner), Param(fn, 0, s), FieldRead(o, s, outer), ExprMayRef(o, r), FieldRead(e, r, inner).
TaintSource(e, "http_input") :- LambdaHandler(fn), Param(fn, 0, s), FieldRead(e, s, _).
TaintSink(e, "xss") :- Handler(w, fn), ResponseMethod(w, m), Param(fn, 1, s), ReceiverSym(call, m, s), CallArg(call, 0, e).
TaintSink(e, "xss") :- KoaHandler(fn), Param(fn, 0, s), FieldWrite(_, s, "body", e).
TaintSink(e, "xss") :- JsxAttribute(_, "dangerouslySetInnerHTML", e).
TaintSink(e, "command_injection") :- Function(fn, "exec", _, _, _, _), FunctionSymbol(s, fn), CallCalleeSym(call, s), CallArg(call, 0, e).
TaintSink(e, "sql") :- MethodCall(call, _, "query"), CallArg(call, 0, e).
TaintSink(e, "sql") :- SqlDriver(mod), SqlMethod(m), ImportBinding(s, mod, _), ReceiverSym(call, m, s), CallArg(call, 0, e).
TaintSink(e, "sql") :- ImportBinding(s, "sequelize", _), ReceiverSym(call, "query", s), CallArg(call, 0, e).
TaintSink(e, "nosql") :- NoSqlMethod(m), MethodCall(call, _, m), CallArg(call, 0, e).
Sanitizer(fn, kind) :- SanitizerOf(mod, name, kind), ImportBinding(s, mod, name), FunctionSymbol(s, fn).
"""

VALUE_FLOW = """
Called(call, fn) :- CallTarget(call, fn).
Called(call, fn) :- CallTargetRTA(call, fn).
ParamBinding(fn, i, s, e) :- Called(call, fn), CallArg(call, i, e), Param(fn, i, s), not CallArgSpread(call, i), not ParameterRest(fn, i), not ParameterDestructured(fn, i).
CallTargetCrossModule(call, fn) :- CallCalleeSym(call, s), ImportBinding(s, _, name), ExportBinding(name, x, _), FunctionSymbol(x, fn).
Binds(e, s) :- Assign(_, e, s).
Binds(e, s) :- VarDecl(_, s, e, _).
Binds(e, s) :- ParamBinding(_, _, s, e).
Binds(e, s) :- DestructureField(e, _, _, s, _).
Binds(e, s) :- ArrayDestructure(e, _, s).
Binds(e, s) :- FieldWrite(_, s, _, e).
LocalFlowStep(a, b) :- Binds(a, s), ExprMayRef(b, s).
LocalFlowStep(a, b) :- Returned(a, call), ExprIsCall(b, call).
Returned(e, call) :- CallTarget(call, fn), ReturnStmt(fn, _, e).
LocalFlowStep(a, b) :- ObjectLiteralField(b, _, a).
LocalFlowStep(a, b) :- ObjectLiteralSpread(b, a).
LocalFlowStep(a, b) :- FieldRead(b, s, _), ExprMayRef(a, s).
LocalFlowStep(a, b) :- Await(b, a).
LocalFlowStep(a, b) :- JsxAttribute(elem, prop, w), JsxExpressionInner(w, a), JsxElement(elem, _, tag), FunctionSymbol(tag, fn), Parameter(fn, _, _, p, _, _), ParamDestructurePattern(p, pattern), DestructureField(pattern, prop, _, s, _), ExprMayRef(b, s).
InterFlowStep(a, b) :- CallTargetCrossModule(call, fn), ReturnStmt(fn, _, a), ExprIsCall(b, call).
InterFlowStep(a, b) :- CallTargetRTA(call, fn), ReturnStmt(fn, _, a), ExprIsCall(b, call).
InterFlowStep(a, b) :- ImportBinding(s, _, name), ExportBinding(name, x, _), ExprMayRef(a, x), ExprMayRef(b, s).
FlowStep(a, b) :- LocalFlowStep(a, b).
FlowStep(a, b) :- InterFlowStep(a, b).
MayResolveTo(v, s) :- ExprValueSource(v, s).
MayResolveTo(v, s) :- FlowStep(m, v), MayResolveTo(m, s).
"""


def facts_text() -> str:
    """The framework facts as rules without bodies."""
    out = []
    for name, rows in FRAMEWORK_FACTS.items():
        for row in rows:
            values = row if isinstance(row, tuple) else (row,)
            out.append(f"{name}({', '.join(f'\"{v}\"' for v in values)}).")
    return "\n".join(out)


GROUPS = {
    "helpers": HELPERS, "call graph": CALL_GRAPH, "local flow": LOCAL_FLOW, "summaries": SUMMARIES, "composition": COMPOSITION,
    "higher order": HIGHER_ORDER, "taint": TAINT, "frameworks": FRAMEWORKS, "value flow": VALUE_FLOW,
}
