"""The object-oriented language: parsing, resolution, classes, modules."""

import pytest

from quarrylog.engine import Engine
from quarrylog.plans import ir
from quarrylog.ql import syntax as s
from quarrylog.ql.lower import ResolveFault, lower_module


def ask(spark, text, relations, loader=None):
    e = Engine(spark)
    for name, (schema, rows) in relations.items():
        e.add_relation(name, spark.createDataFrame(rows, schema))
    p = lower_module(text, loader)
    return e.add_rules(p.rules).query(p.query)


NODES = {"node": ("id long, kind string", [(1, "a"), (2, "a"), (3, "b"), (4, "c")]), "edge": ("x long, y long", [(1, 2), (2, 3), (3, 4)])}
CLASSES = """
/** A node. */
class Node extends @node {
  Node() { node(this, _) }
  string getKind() { node(this, result) }
  Node getNext() { edge(this, result) }
  predicate isLast() { not exists(this.getNext()) or none() }
  string say() { result = "node " + this.getKind() }
}
class ANode extends Node { ANode() { this.getKind() = "a" } override string say() { result = "first " + super.say() } }
class Loud extends ANode { Loud() { this > 1 } override string say() { result = "LOUD " + super.say() } }
"""


def test_dispatch_and_super(spark):
    text = CLASSES.replace("not exists(this.getNext()) or none()", "not edge(this, _)")
    rows = ask(spark, text + 'from Node n select n, n.say() as "said"', NODES)
    assert rows.columns == ["col0", "said"]
    assert sorted(map(tuple, rows.collect())) == [(1, "first node a"), (2, "LOUD first node a"), (3, "node b"), (4, "node c")]
    assert [r[0] for r in ask(spark, text + "from Node n where n.isLast() select n", NODES).collect()] == [4]
    assert sorted(r[0] for r in ask(spark, text + "from Node n where n.getNext().getNext().getKind() = \"c\" select n", NODES).collect()) == [2]
    assert sorted(r[0] for r in ask(spark, text + "from ANode n, Node m where m = n.getNext+() select m", NODES).collect()) == [2, 3, 4]


def test_abstract_classes_and_modules(spark):
    text = """
    abstract class Shape extends int { Shape() { node(this, _) } abstract int size(); }
    class Small extends Shape { Small() { this <= 2 } override int size() { result = 1 } }
    module M { class Big extends Shape { Big() { this > 3 } override int size() { result = 9 } } predicate two(int x) { x = 2 } }
    from Shape s where not M::two(s) select s, s.size()
    """
    assert sorted(map(tuple, ask(spark, text, NODES).collect())) == [(1, 1), (4, 9)]


def test_imports(spark):
    libraries = {"lib.things": "import more predicate far(int x) { node(x, _) and x > low() }", "more": "int low() { result = 2 }"}
    got = ask(spark, "import lib.things from int x where node(x, _) and far(x) select x", NODES, libraries.get)
    assert sorted(r[0] for r in got.collect()) == [3, 4]


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("from Missing m select m", "not defined"), ("select x", "not defined"), ("class A extends B {} class B extends A {} select 1", "inherits from itself"), ("class A extends int {} class A extends int {} select 1", "twice"),
        ("predicate p(int x) { x = 1 } predicate p(int y) { y = 2 } select 1", "twice"), ("import nowhere select 1", "no library"), ("class A extends int { A() { node(this, _) } } from A a select a.nothing()", "no method"),
    ],
)
def test_resolution_faults(text, said):
    with pytest.raises(ResolveFault, match=said):
        lower_module(text)


@pytest.mark.parametrize("text", ["from int x where select x", "class { }", "select", "from int x where x = = 1 select x", "predicate p(int x) { x = 1", 'select "open', "select #"])
def test_syntax_faults(text):
    with pytest.raises(s.SyntaxFault, match=r"line 1, column \d+"):
        lower_module(text)


def test_precedence():
    p = s.Parser("a = 1 or not b = 2 and c = 3 + 4 * -5").formula()
    assert isinstance(p, s.AnyOf) and isinstance(p.parts[1], s.AllOf) and isinstance(p.parts[1].parts[0], s.Negated)
    product = p.parts[1].parts[1].right.right
    assert product.op == "*" and product.right.op == "neg"


def test_undefined_predicates_are_reported(spark):
    with pytest.raises(ir.LogicError, match="no predicate"):
        ask(spark, "from int x where nothing(x) select x", NODES)


def test_comments_flags_and_bodies(spark):
    text = """
    // a comment
    pragma[noinline] private predicate p(int x) { node(x, _) /* all */ }
    deprecated int q(int x) { p(x) and result = x * 10 }
    from int x where if x = 1 then q(x) = 10 else (x = 3 and p(x)) select x
    """
    assert sorted(r[0] for r in ask(spark, text, NODES).collect()) == [1, 3]
