"""Plans whose work or memory would grow faster than input and output."""

from quarrylog.engine import Engine
from quarrylog.operators import spread


def engine(spark, **tables):
    out = Engine(spark)
    for name, (schema, rows) in tables.items():
        out.add_relation(name, spark.createDataFrame(rows, schema))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_a_body_are_made_distinct_before_they_are_joined(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 2)
    sources = [(a, "in" if a % 3 else "out") for a in range(9)] * 2
    tainted, sinks = [(s, "in") for s in range(5)], [(10 + s // 2, s) for s in range(8)]
    e = engine(spark, S=("a long, k string", sources), T=("s long, k string", tainted), R=("b long, s long", sinks))
    out = e.query('Pair(a, b, k) :- S(a, k), T(s, k), R(b, s). select a as "a", b as "b", k as "k" where Pair(a, b, k).')
    assert not optimised(out).startswith("Aggregate")
    assert rows(out) == sorted((a, b, "in") for a in range(9) if a % 3 for b in (10, 11, 12))


def test_parts_without_a_common_variable(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 2)
    e = engine(spark, A=("a long, x long", [(i // 2, i) for i in range(10)]), B=("b long, x long", [(i % 3, i) for i in range(9)]), C=("c long", [(1,)]), D=("d long", []))
    out = e.query("select a, b where A(a, _), B(b, _), C(_).")
    assert not optimised(out).startswith("Aggregate")
    assert rows(out) == [(a, b) for a in range(5) for b in range(3)]
    assert rows(e.query("select a, b where A(a, _), B(b, _), D(_).")) == []


def test_pairs_of_a_theta_join_are_made_distinct_only_where_values_repeat(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 2)
    given = [(i, i % 2, float(i % 7)) for i in range(20)] + [(3, 0, 1.0), (3, 1, 9.0), (4, 0, 4.0), (5, 1, 2.0)]
    e = engine(spark, S=("s long, k long, x double", given))
    out = e.query('select a as "a", b as "b" where S(a, k, x), S(b, k, y), x > y.')
    assert rows(out) == sorted({(a, b) for a, k, x in given for b, j, y in given if k == j and x > y})
    assert optimised(out).startswith("Union")
    out = e.query('select a as "a", k as "k", x as "x", b as "b", y as "y" where S(a, k, x), S(b, k, y), x != y, b > 3.')
    assert rows(out) == sorted({(a, k, x, b, y) for a, k, x in given for b, j, y in given if k == j and x != y and b > 3})


def test_a_disjunction_that_ties_more_goes_before_an_atom_that_would_pair_all(spark):
    p, q = [(1, i) for i in range(8)], [(1, i) for i in range(4, 12)]
    r = [(1, 0, 5), (1, 1, 2), (1, 3, 9), (1, 9, 4)]
    e = engine(spark, P=("k long, a long", p), Q=("k long, b long", q), R=("k long, a long, b long", r))
    out = e.query('select a as "a", b as "b" where P(k, a), Q(k, b), (a = b or R(k, a, b)).')
    assert "LeftSemi" in optimised(out)
    assert rows(out) == [(0, 5), (3, 9), (4, 4), (5, 5), (6, 6), (7, 7)]


def test_what_is_negated_is_distinct_before_it_is_joined(spark):
    e = engine(spark, A=("k long", [(i,) for i in range(6)]), B=("k long, n long", [(i % 3, i) for i in range(30)]))
    out = e.query('select k as "k" where A(k), not B(k, _).')
    assert rows(out) == [(3,), (4,), (5,)]
    assert optimised(out).split("LeftAnti")[1].count("Aggregate") == 1


def test_forall_reads_its_guard_once(spark):
    e = engine(spark, A=("a long", [(i,) for i in range(5)]), B=("a long, q double", [(0, 1.0), (1, 5.0), (1, 1.0), (2, 7.0)]), C=("q double, a long", [(7.0, 2)]))
    out = e.query('select a as "a" where A(a), forall(q | B(a, q) | q < 4.0).')
    assert rows(out) == [(0,), (3,), (4,)]
    assert optimised(out).count("Join") == 1
    assert rows(e.query('select a as "a" where A(a), forall(q | B(a, q) | C(q, a)).')) == [(2,), (3,), (4,)]
    assert rows(e.query('select a as "a" where A(a), forall(q | B(_, q), q > 4.0 | q > a + 1).')) == [(0,), (1,), (2,), (3,)]


def test_atoms_that_another_implies_are_left_out(spark):
    e = engine(spark, R=("a long, n long", [(1, 5), (2, 6), (2, 7)]))
    e.add_rules("Thing(a) :- R(a, _). Big(a) :- Thing(a), R(a, n), n > 5. Top(a) :- Thing(a), Big(a).")
    out = e.query('select a as "a" where Top(a).')
    assert rows(out) == [(2,)]
    assert "Join" not in optimised(out)
    e.add_rules("Other(a) :- R(a, 5). Other(a) :- R(_, a). Small(a) :- Other(a), R(a, _).")
    assert rows(e.query('select a as "a" where Other(a), Thing(a).')) == rows(e.query('select a as "a" where Small(a).')) == [(1,)]
