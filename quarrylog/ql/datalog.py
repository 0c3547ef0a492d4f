"""Plain Datalog: ``head(x, y) :- body.``, facts, and ``select x, y as "name" where body.``

Bodies use the same formulas as the object-oriented language; ``,`` stands for
``and`` and ``;`` for ``or``. Arguments may name columns: ``orders(o_custkey: c)``.
"""

from __future__ import annotations

from quarrylog.plans import ir
from quarrylog.ql import syntax as s
from quarrylog.ql.lower import Lowering, Scope


def parse_program(text: str) -> ir.Program:
    p, out, low, scope = s.Parser(text, datalog=True), ir.Program(), Lowering(), Scope({})
    while p.tok.kind != "eof":
        if p.accept("select"):
            items, body = [], []
            while True:
                term, extra, _ = low.expression(p.expression(), scope)
                label = None
                if p.accept("as"):
                    label = s.unescape(p.tok.text) if p.tok.kind == "string" else p.tok.text
                    p.i += 1
                items.append((term, label))
                body += extra
                if not p.accept(","):
                    break
            if p.accept("where"):
                body = low.formula(p.formula(), scope) + body
            if out.query:
                p.fail("one query")
            out.query = ir.Query(tuple(items), tuple(body))
        else:
            call = p.postfix()
            if not isinstance(call, s.Call) or call.named or call.closure:
                p.fail("a head")
            args, body = low._args(call.args, scope)
            if p.accept(":-"):
                body = low.formula(p.formula(), scope) + body
            out.rules.append(ir.Rule(ir.Atom(call.name, tuple(args)), tuple(body)))
        if p.tok.kind == "end" or p.peek("."):
            p.i += 1
        else:
            p.fail("'.'")
    return out
