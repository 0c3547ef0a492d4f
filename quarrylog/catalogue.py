"""The registered queries over the test tables, with their SQL counterparts.

Each entry is a logic program over stored relations named after the tables, and
the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylog.library import bridge, relations
from quarrylog.library.code import code_engine
from quarrylog.operators import statistics
from quarrylog.plans.magic import rewrite
from quarrylog.ql.datalog import parse_program
from quarrylog.ql.lower import lower_module
from quarrylog.sources.tables import TEST_TABLES, engine_over, read_table

FLAGSHIP = "join_three_way"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _tables_in(text: str) -> list[str]:
    return [t for t in TEST_TABLES if t in text]


def logic(name: str, program: str, sql: str | None = None, **options) -> None:
    """Register a Datalog program."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_over(spark, sf_dir, *_tables_in(program), **options).query(program)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def objects(name: str, text: str, sql: str) -> None:
    """Register a program of the object-oriented language."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_over(spark, sf_dir, *_tables_in(text))
        program = lower_module(text)
        engine.add_rules(program.rules)
        return engine.query(program.query)

    QUERIES[name] = run
    ORACLES[name] = sql


# ---- projection, filter, predicate

logic("select_labels", 'select k as "k", n as "name", 7 where nation(n_nationkey: k, n_name: n).', "SELECT n_nationkey::BIGINT AS k, n_name AS name, 7::BIGINT AS col2 FROM nation")
logic("constant_match", 'select p as "p" where part(p_partkey: p, p_size: 15).', "SELECT p_partkey AS p FROM part WHERE p_size = 15")
logic("repeated_variable", 'select o as "o", n as "n" where lineitem(l_orderkey: o, l_linenumber: n, l_suppkey: x, l_partkey: x).', "SELECT l_orderkey AS o, l_linenumber::BIGINT AS n FROM lineitem WHERE l_suppkey = l_partkey")
logic("wildcards", 'select s as "status" where orders(_, _, s, _, _, _).', "SELECT DISTINCT o_orderstatus AS status FROM orders")
logic("comparisons", 'select p as "p" where part(p_partkey: p, p_size: s, p_brand: b, p_retailprice: r), s >= 10, s < 20, b != "Brand#11", b > "Brand#2", r <= 1500.5.', "SELECT p_partkey AS p FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11' AND p_brand > 'Brand#2' AND p_retailprice <= 1500.5")
logic("mixed_comparison", 'select k as "k" where nation(n_nationkey: k, n_name: n), k != n, not k = n.', "SELECT n_nationkey::BIGINT AS k FROM nation")
logic("equality_binding", 'select k as "k", d as "d" where nation(n_nationkey: k), d = e + 1, e = k * 2.', "SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT * 2 + 1 AS d FROM nation")
logic("arithmetic", 'select k as "k", a as "a", b as "b", c as "c", d as "d" where nation(n_nationkey: k), a = (k - 12) * 3, b = a / 5, c = a % 5, d = -k, a / (k - 3) != 1000000.', "SELECT * FROM (SELECT n_nationkey::BIGINT AS k, (n_nationkey::BIGINT - 12) * 3 AS a, ((n_nationkey::BIGINT - 12) * 3) // 5 AS b, ((n_nationkey::BIGINT - 12) * 3) % 5 AS c, -n_nationkey::BIGINT AS d FROM nation WHERE n_nationkey <> 3)")
logic("string_concatenation", 'select s as "s" where region(r_name: n, r_regionkey: k), s = n + "-" + k.', "SELECT r_name || '-' || r_regionkey AS s FROM region")
logic("disjunction", 'select p as "p" where part(p_partkey: p, p_size: s, p_type: t), (s = 1 or s = 2 or t.matches("%BRASS")).', "SELECT p_partkey AS p FROM part WHERE p_size = 1 OR p_size = 2 OR p_type LIKE '%BRASS'")
logic("disjunction_binding", 'select n as "n", k as "k" where (customer(c_nationkey: k, c_mktsegment: n) or supplier(s_nationkey: k, s_name: n)), nation(n_nationkey: k, n_regionkey: 2).', "SELECT DISTINCT n, k FROM (SELECT c_mktsegment n, c_nationkey::BIGINT k FROM customer UNION ALL SELECT s_name, s_nationkey::BIGINT FROM supplier) JOIN nation ON n_nationkey = k WHERE n_regionkey = 2")
logic("negated_comparison", 'select p as "p" where part(p_partkey: p, p_size: s), not s = 15, not (s > 20 and s < 40).', "SELECT p_partkey AS p FROM part WHERE p_size <> 15 AND NOT (p_size > 20 AND p_size < 40)")
logic("negated_formula", 'select c as "c" where customer(c_custkey: c), not (orders(o_orderkey: o, o_custkey: c), lineitem(l_orderkey: o, l_returnflag: "R")).', "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
logic("exists", 'select c as "c" where customer(c_custkey: c), exists(o | orders(o_custkey: c, o_orderpriority: o) | o = "1-URGENT").', "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
logic("forall", 'select o as "o" where orders(o_orderkey: o), forall(q, n | lineitem(l_orderkey: o, l_linenumber: n, l_quantity: q) | q < 40.0).', "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_quantity < 40)")
logic("forex", 'select c as "c" where customer(c_custkey: c), forex(o, s | orders(o_orderkey: o, o_custkey: c, o_orderstatus: s) | s = "F" or s = "O").', "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus NOT IN ('F', 'O'))")
logic("if_then_else", 'select p as "p", k as "kind" where part(p_partkey: p, p_size: s), if s < 25 then k = "small" else k = "large".', "SELECT p_partkey AS p, CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS kind FROM part")
logic("any_none", 'select k as "k" where nation(n_nationkey: k), (any() and k < 3 or none()).', "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey < 3")
logic("boolean_literals", 'select a as "a", b as "b" where a = true, b = false.', "SELECT 1::BIGINT AS a, 0::BIGINT AS b")

# ---- joins and set operations

logic("join_three_way", 'AsianCustomer(c, n) :- customer(c_custkey: c, c_nationkey: k), nation(n_nationkey: k, n_name: n, n_regionkey: r), region(r_regionkey: r, r_name: "ASIA"). select c as "c", n as "nation" where AsianCustomer(c, n).', "SELECT c_custkey AS c, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
logic("join_theta", 'select a as "a", b as "b" where supplier(s_suppkey: a, s_nationkey: k, s_acctbal: x), supplier(s_suppkey: b, s_nationkey: k, s_acctbal: y), x > y.', "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y USING (s_nationkey) WHERE x.s_acctbal > y.s_acctbal")
logic("join_product", 'select a as "a", b as "b" where region(r_name: a), nation(n_name: b, n_regionkey: 1).', "SELECT r_name AS a, n_name AS b FROM region, nation WHERE n_regionkey = 1")
logic("join_semi", 'select c as "c" where customer(c_custkey: c), orders(o_custkey: c, o_orderstatus: "P").', "SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
logic("join_anti", 'select c as "c" where customer(c_custkey: c), not orders(o_custkey: c, o_orderstatus: "P").', "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
logic("join_anti_no_columns", 'select r as "r" where region(r_name: r), not part(p_size: 99).', "SELECT r_name AS r FROM region WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = 99)")
logic("join_self", 'select a as "a", b as "b" where nation(n_nationkey: a, n_regionkey: r), nation(n_nationkey: b, n_regionkey: r), a < b.', "SELECT x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey < y.n_nationkey")
logic("join_four_way", 'select n as "nation", p as "priority" where lineitem(l_orderkey: o, l_suppkey: s, l_returnflag: "R"), orders(o_orderkey: o, o_orderpriority: p), supplier(s_suppkey: s, s_nationkey: k), nation(n_nationkey: k, n_name: n).', "SELECT DISTINCT n_name AS nation, o_orderpriority AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R'")
logic("negated_builtin", 'select p as "p" where part(p_partkey: p, p_name: n), not n.regexpMatch("^[a-m]").', "SELECT p_partkey AS p FROM part WHERE NOT regexp_matches(p_name, '^[a-m]')")
logic("union", 'Trader(k) :- customer(c_nationkey: k, c_acctbal: b), b > 9000.0. Trader(k) :- supplier(s_nationkey: k). select k as "k" where Trader(k).', "SELECT c_nationkey::BIGINT AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey::BIGINT FROM supplier")
logic("intersect", 'select k as "k" where customer(c_nationkey: k), supplier(s_nationkey: k).', "SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier")
logic("except", 'select k as "k" where part(p_size: k), not lineitem(l_linenumber: k).', "SELECT p_size::BIGINT AS k FROM part EXCEPT SELECT l_linenumber::BIGINT FROM lineitem")
logic("facts", 'Band("low", 0, 10). Band("high", 11, 99). select b as "band", p as "p" where part(p_partkey: p, p_size: s), Band(b, x, y), s >= x, s <= y.', "SELECT CASE WHEN p_size <= 10 THEN 'low' ELSE 'high' END AS band, p_partkey AS p FROM part WHERE p_size BETWEEN 0 AND 99")

# ---- aggregates

logic("agg_count", 'select k as "k", n as "n" where nation(n_nationkey: k), n = count(c | customer(c_custkey: c, c_nationkey: k)).', "SELECT c_nationkey::BIGINT AS k, count(*) AS n FROM customer GROUP BY 1")
logic("agg_count_bag", 'select s as "s", n as "n" where n = strictcount(o | orders(o_custkey: o, o_orderstatus: s)).', "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
logic("agg_count_all", 'select n as "n" where n = count(o | orders(o_orderkey: o)).', "SELECT count(*) AS n FROM orders HAVING count(*) > 0")
logic("agg_count_none", 'select k as "k", n as "n" where nation(n_nationkey: k), n = count(c | customer(c_custkey: c, c_nationkey: k, c_acctbal: b), b > 9500.0).', "SELECT c_nationkey::BIGINT AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1")
logic("agg_min_max", 'select b as "brand", x as "x", y as "y" where x = min(s | part(p_brand: b, p_size: s)), y = max(s | part(p_brand: b, p_size: s)).', "SELECT p_brand AS brand, min(p_size)::BIGINT AS x, max(p_size)::BIGINT AS y FROM part GROUP BY 1")
logic("agg_sum", 'select f as "flag", q as "q" where q = sum(n | lineitem(l_returnflag: f, l_linenumber: n)).', "SELECT l_returnflag AS flag, sum(l_linenumber)::BIGINT AS q FROM lineitem GROUP BY 1")
logic("agg_strictsum", 'select b as "brand", x as "x" where x = strictsum(p, s | part(p_partkey: p, p_brand: b, p_size: s) | s * 2).', "SELECT p_brand AS brand, sum(p_size * 2)::BIGINT AS x FROM part GROUP BY 1")
logic("agg_avg", 'select b as "brand", x as "x" where x = avg(s | part(p_brand: b, p_size: s)).', "SELECT p_brand AS brand, sum(p_size)::BIGINT // count(*) AS x FROM part GROUP BY 1")
logic("agg_concat", 'select r as "region", s as "names" where region(r_regionkey: k, r_name: r), s = concat("; " | n | nation(n_name: n, n_regionkey: k)).', "SELECT r_name AS region, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
logic("agg_unique", 'select c as "c", s as "status" where s = unique(x | orders(o_custkey: c, o_orderstatus: x)).', "SELECT o_custkey AS c, min(o_orderstatus) AS status FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
logic("agg_rank", 'select b as "brand", r as "r" where r = rank(s | part(p_brand: b, p_size: s)).', "SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
logic("agg_nested", 'Size(k, n) :- n = count(c | customer(c_custkey: c, c_nationkey: k)). select m as "m" where m = max(n | Size(_, n)).', "SELECT max(n) AS m FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)")
logic("agg_with_builtin", 'select t as "t", n as "n" where n = count(p, l | part(p_partkey: p, p_type: t, p_name: x), l = x.length(), l > 5).', "SELECT p_type AS t, count(*) AS n FROM part WHERE strlen(p_name) > 5 GROUP BY 1")
logic("agg_in_condition", 'select c as "c" where customer(c_custkey: c), count(o | orders(o_orderkey: o, o_custkey: c)) > 15.', "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) > 15")

# ---- recursion

_GRAPH = 'Step(a, b) :- supplier(s_suppkey: a), (b = a * 2 or b = a * 3 + 1), supplier(s_suppkey: b). '
_STEP = "step AS (SELECT DISTINCT a, b FROM (SELECT s_suppkey a, s_suppkey * 2 b FROM supplier UNION ALL SELECT s_suppkey, s_suppkey * 3 + 1 FROM supplier) WHERE b IN (SELECT s_suppkey FROM supplier))"
_PATH = f"WITH RECURSIVE {_STEP}, path AS (SELECT a, b FROM step UNION SELECT p.a, s.b FROM path p JOIN step s ON p.b = s.a) "
logic("recursion_linear", _GRAPH + 'Path(a, b) :- Step(a, b). Path(a, c) :- Path(a, b), Step(b, c). select a as "a", b as "b" where Path(a, b).', _PATH + "SELECT a, b FROM path")
logic("recursion_nonlinear", _GRAPH + 'Path(a, b) :- Step(a, b). Path(a, c) :- Path(a, b), Path(b, c). select a as "a", b as "b" where Path(a, b).', _PATH + "SELECT a, b FROM path")
logic("recursion_mutual", _GRAPH + 'Even(a, a) :- supplier(s_suppkey: a). Even(a, c) :- Odd(a, b), Step(b, c). Odd(a, c) :- Even(a, b), Step(b, c). select a as "a", b as "b" where Odd(a, b).', f"WITH RECURSIVE {_STEP}, walk AS (SELECT s_suppkey a, s_suppkey b, 0 AS odd FROM supplier UNION SELECT w.a, s.b, 1 - odd FROM walk w JOIN step s ON w.b = s.a) SELECT DISTINCT a, b FROM walk WHERE odd = 1")
logic("closure_plus", _GRAPH + 'select b as "b" where Step+(1, b).', _PATH + "SELECT DISTINCT b FROM path WHERE a = 1")
logic("closure_star", _GRAPH + 'select a as "a", b as "b" where supplier(s_suppkey: a), Step*(a, b).', _PATH + "SELECT a, b FROM path UNION SELECT s_suppkey, s_suppkey FROM supplier")
logic("recursion_then_negation", _GRAPH + 'Reached(b) :- Step+(1, b). select s as "s" where supplier(s_suppkey: s), not Reached(s).', _PATH + "SELECT s_suppkey AS s FROM supplier WHERE s_suppkey NOT IN (SELECT b FROM path WHERE a = 1)")
logic("recursion_then_aggregate", _GRAPH + 'Path(a, b) :- Step+(a, b). select a as "a", n as "n" where n = count(b | Path(a, b)).', _PATH + "SELECT a, count(*) AS n FROM path GROUP BY a")
logic("recursion_arithmetic", 'Count(0). Count(n + 1) :- Count(n), n < 30. select n as "n" where Count(n).', "SELECT unnest(range(0, 31)) AS n")
logic("recursion_event_chain", 'Next(a, b) :- events(event_id: a, user_id: u), b = a + 1, events(event_id: b, user_id: u). select a as "a", b as "b" where Next+(a, b).', "WITH RECURSIVE next AS (SELECT x.event_id a, y.event_id b FROM events x JOIN events y ON y.event_id = x.event_id + 1 AND x.user_id = y.user_id), path AS (SELECT a, b FROM next UNION SELECT p.a, n.b FROM path p JOIN next n ON p.b = n.a) SELECT a, b FROM path")

# ---- builtins


def _builtin(name: str, table: str, column: str, calls: list[tuple[str, str, str]], where: str = "true", also: str = "") -> None:
    """Columns (label, call on x, SQL) over distinct values x of a column; where: SQL for rows that every call accepts."""
    labels = [label for label, _, _ in calls]
    program = f'select x as "x", {", ".join(f"{v} as \"{v}\"" for v in labels)} where {table}({column}: x){also}, {", ".join(f"{v} = {call}" for v, call, _ in calls)}.'
    logic(name, program, f"SELECT DISTINCT {column} AS x, {', '.join(f'{sql} AS {v}' for v, _, sql in calls)} FROM {table} WHERE {where}")


_builtin("fn_length", "part", "p_name", [("n", "x.length()", "strlen(p_name)::BIGINT")])
_builtin("fn_case", "part", "p_name", [("u", "x.toUpperCase()", "upper(p_name)"), ("l", "x.toLowerCase()", "lower(p_name)")])
_builtin("fn_trim", "nation", "n_name", [("t", '("  " + x + " ").trim()', "n_name")])
_builtin("fn_index_of", "part", "p_name", [("i", 'x.indexOf("e")', "(strpos(p_name, 'e') - 1)::BIGINT")])
_builtin("fn_substring", "part", "p_name", [("s", "x.substring(2, 7)", "substr(p_name, 3, 5)")], "length(p_name) >= 7")
_builtin("fn_char_at", "part", "p_name", [("c", "x.charAt(3)", "substr(p_name, 4, 1)")], "length(p_name) > 3")
_builtin("fn_replace_all", "part", "p_name", [("r", 'x.replaceAll("e", "33")', "replace(p_name, 'e', '33')")])
_builtin("fn_to_int", "orders", "o_orderpriority", [("i", "x.prefix(1).toInt()", "left(o_orderpriority, 1)::BIGINT")])
_builtin("fn_to_string", "nation", "n_name", [("s", "x.toString()", "n_name")])
_builtin("fn_split_at", "part", "p_name", [("s", "x.splitAt(4)", "substr(p_name, 5)")], "length(p_name) >= 4")
_builtin("fn_prefix_suffix", "part", "p_name", [("p", "x.prefix(3)", "left(p_name, 3)"), ("s", "x.suffix(3)", "right(p_name, 3)")], "length(p_name) >= 3")
_builtin("fn_regexp_find", "part", "p_name", [("f", 'x.regexpFind("[aeiou][a-z]", 1, 0)', "regexp_extract_all(p_name, '[aeiou][a-z]')[2]")], "len(regexp_extract_all(p_name, '[aeiou][a-z]')) > 1")
_builtin("fn_regexp_replace", "part", "p_name", [("r", 'x.regexpReplaceAll("([aeiou])", "<$1>")', r"regexp_replace(p_name, '([aeiou])', '<\1>', 'g')")])
_builtin("fn_abs", "part", "p_partkey", [("a", "(5 - x).abs()", "abs(5 - p_partkey)")])
_builtin("fn_bits", "part", "p_partkey", [("a", "x.bitAnd(12)", "p_partkey & 12"), ("o", "x.bitOr(12)", "p_partkey | 12"), ("z", "x.bitXor(12)", "xor(p_partkey, 12)")])
_builtin("fn_shifts", "part", "p_partkey", [("l", "x.bitShiftLeft(3)", "p_partkey << 3"), ("r", "x.bitShiftRight(2)", "p_partkey >> 2"), ("z", "x.bitShiftLeft(64)", "0::BIGINT"), ("m", "(0 - x).bitShiftRight(70)", "CASE WHEN p_partkey > 0 THEN -1 ELSE 0 END::BIGINT")])
logic("fn_matches", 'select x as "x" where part(p_name: x), x.matches("%e_%").', "SELECT DISTINCT p_name AS x FROM part WHERE p_name LIKE '%e_%'")
logic("fn_regexp_match", 'select x as "x" where part(p_name: x), x.regexpMatch("[aeiou]{2}").', "SELECT DISTINCT p_name AS x FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')")
logic("fn_out_of_range", 'select x as "x", s as "s" where part(p_name: x), s = x.substring(3, 12).', "SELECT DISTINCT p_name AS x, substr(p_name, 4, 9) AS s FROM part WHERE length(p_name) >= 12")
logic("fn_over_texts", 'select d as "d", n as "n" where documents(doc_id: d, text: t), n = t.toLowerCase().length(), t.regexpMatch("[0-9]").', "SELECT doc_id AS d, strlen(lower(text))::BIGINT AS n FROM documents WHERE regexp_matches(text, '[0-9]')")
logic("fn_over_urls", 'select p as "p", h as "h" where pages(page_id: p, url: u), h = u.regexpReplaceAll("^[a-z]+://([^/]+)/?.*$", "$1").', r"SELECT page_id AS p, regexp_replace(url, '^[a-z]+://([^/]+)/?.*$', '\1') AS h FROM pages")

# ---- the object-oriented language

_CLASSES = """
class Nation extends int {
  Nation() { exists(string n, int r | nation(this, n, r)) }
  string getName() { exists(int r | nation(this, result, r)) }
  int getRegion() { exists(string n | nation(this, n, result)) }
  string describe() { result = "nation " + this.getName() }
}
class FarNation extends Nation {
  FarNation() { this.getRegion() >= 3 }
  override string describe() { result = "far " + super.describe() }
}
class OddFarNation extends FarNation {
  OddFarNation() { this % 2 = 1 }
}
"""
objects("ql_classes", _CLASSES + 'from Nation n where n.getRegion() = 2 select n as "n", n.getName() as "name"', "SELECT n_nationkey::BIGINT AS n, n_name AS name FROM nation WHERE n_regionkey = 2")
objects("ql_override", _CLASSES + 'from Nation n select n as "n", n.describe() as "d"', "SELECT n_nationkey::BIGINT AS n, CASE WHEN n_regionkey >= 3 THEN 'far ' ELSE '' END || 'nation ' || n_name AS d FROM nation")
objects("ql_instanceof", _CLASSES + 'from Nation n where n instanceof FarNation and not n instanceof OddFarNation select n as "n"', "SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_regionkey >= 3 AND n_nationkey % 2 = 0")
objects("ql_cast", _CLASSES + 'from int k where nation(k, _, _) select k.(OddFarNation).getName() as "name"', "SELECT n_name AS name FROM nation WHERE n_regionkey >= 3 AND n_nationkey % 2 = 1")
objects("ql_abstract", 'abstract class Party extends int { abstract string getKind(); } class Buyer extends Party { Buyer() { customer(this, _, _, _, _) } override string getKind() { result = "buyer" } } class Seller extends Party { Seller() { supplier(this, _, _, _) } override string getKind() { result = "seller" } } from Party p select p as "p", p.getKind() as "kind"', "SELECT c_custkey AS p, 'buyer' AS kind FROM customer UNION SELECT s_suppkey, 'seller' FROM supplier UNION SELECT c_custkey, 'seller' FROM customer WHERE false")
objects("ql_predicates", 'predicate large(int p, int s) { part(p, _, _, _, s, _) and s > 45 } int double(int x) { result = x * 2 and part(_, _, _, _, x, _) } from int p, int s where large(p, s) select p as "p", double(s) as "twice"', "SELECT p_partkey AS p, (p_size * 2)::BIGINT AS twice FROM part WHERE p_size > 45")
objects("ql_modules", 'module Geo { module Names { predicate region(int k, string n) { region_(k, n) } predicate region_(int k, string n) { nation(_, _, k) and n = "r" + k } } predicate pair(int k, string n) { Names::region(k, n) } } from int k, string n where Geo::pair(k, n) select k as "k", n as "n"', "SELECT DISTINCT n_regionkey::BIGINT AS k, 'r' || n_regionkey AS n FROM nation")
objects("ql_closure", 'predicate step(int a, int b) { supplier(a, _, _, _) and b = a * 2 and supplier(b, _, _, _) } class Source extends int { Source() { supplier(this, _, _, _) } int getNext() { step(this, result) } } from Source s, int t where step+(s, t) select s as "s", t as "t"', "WITH RECURSIVE step AS (SELECT s_suppkey a, s_suppkey * 2 b FROM supplier WHERE s_suppkey * 2 IN (SELECT s_suppkey FROM supplier)), path AS (SELECT * FROM step UNION SELECT p.a, s.b FROM path p JOIN step s ON p.b = s.a) SELECT a AS s, b AS t FROM path")
objects("ql_aggregate", _CLASSES + 'from int r where r = any_region() select r as "r", count(Nation n | n.getRegion() = r) as "n" int any_region() { nation(_, _, result) }', "SELECT n_regionkey::BIGINT AS r, count(*) AS n FROM nation GROUP BY 1")

# ---- derived relations over code facts, with facts made from the test tables


def code(name: str, facts: dict[str, tuple[str, str, str]], program: str, sql: str, ql: bool = False) -> None:
    """Register a program over code relations; facts: {relation: (table, expressions, condition)}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {}
        for relation, (table, columns, where) in facts.items():
            picked = read_table(spark, sf_dir, table).where(where).selectExpr(*columns.split("; "))
            given[relation] = picked.toDF(*relations.schema(relation).names)
        engine = code_engine(spark, given)
        if not ql:
            return engine.query(program)
        parsed = lower_module(program, bridge.Loader(), relations.entity)
        return engine.add_rules(parsed.rules).query(parsed.query)

    QUERIES[name] = run
    ORACLES[name] = sql


_DOUBLE = ("supplier", "s_suppkey; s_suppkey * 2", "true")
_DOUBLED = "step AS (SELECT s_suppkey a, s_suppkey * 2 b FROM supplier)"
code("lib_call_target", {"CallCalleeSym": ("lineitem", "l_orderkey; l_partkey", "true"), "FunctionSymbol": ("part", "p_partkey; p_size", "true")},
     'select c as "call", f as "fn" where CallTarget(c, f).', "SELECT DISTINCT l_orderkey AS call, p_size::BIGINT AS fn FROM lineitem JOIN part ON l_partkey = p_partkey")
code("lib_virtual_calls", {
    "MethodCall": ("orders", "o_orderkey; o_custkey; o_orderpriority", "true"), "ExprType": ("customer", "c_custkey; c_nationkey", "true"), "InterfaceDecl": ("nation", "n_nationkey; n_name; 0", "n_regionkey < 3"),
    "Implements": ("nation", "n_nationkey + 100; n_nationkey", "true"), "NewExpr": ("nation", "n_nationkey; n_nationkey + 100", "n_name > 'C'"), "MethodDecl": ("nation", "n_nationkey + 100; '1-URGENT'; n_nationkey + 500", "true"),
}, 'select c as "call", f as "fn" where CallTargetRTA(c, f).',
     "SELECT o_orderkey AS call, c_nationkey::BIGINT + 500 AS fn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT' AND n_regionkey < 3 AND n_name > 'C'")
code("lib_inherited_methods", {
    "ClassDecl": ("supplier", "s_suppkey; s_name; 0", "true"), "Extends": ("supplier", "s_suppkey * 2; s_suppkey", "true"),
    "MethodDecl": ("supplier", "s_suppkey; concat('m', s_nationkey); s_suppkey", "s_acctbal > 0"),
}, 'select c as "c", m as "m", f as "f" where MethodDeclInherited(c, m, f).',
     f"""WITH RECURSIVE {_DOUBLED}, own AS (SELECT s_suppkey c, 'm' || s_nationkey m FROM supplier WHERE s_acctbal > 0),
     found AS (SELECT b c, m, a f FROM step JOIN own ON c = a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.c = b AND o.m = own.m)
       UNION SELECT b, m, f FROM found JOIN step ON c = a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.c = b AND o.m = found.m)) SELECT c, m, f FROM found""")  # fmt: skip
code("lib_flow_star", {"AdditionalFlowStep": _DOUBLE, "AdditionalTaintStep": ("supplier", "s_suppkey; s_suppkey * 3", "true")},
     'select a as "a", b as "b" where FlowStar(a, b).',
     "WITH RECURSIVE step AS (SELECT s_suppkey a, s_suppkey * 2 b FROM supplier UNION SELECT s_suppkey, s_suppkey * 3 FROM supplier), path AS (SELECT a, b FROM step UNION SELECT p.a, s.b FROM path p JOIN step s ON p.b = s.a) SELECT a, b FROM path")
code("lib_local_flow", {"Assign": ("supplier", "0; s_suppkey; s_suppkey * 2", "true"), "ExprMayRef": ("supplier", "s_suppkey; s_suppkey", "true"), "SymInFunction": ("supplier", "s_suppkey; 1", "true")},
     'select a as "a", b as "b" where LocalFlowStar(1, a, b).',
     "WITH RECURSIVE step AS (SELECT s_suppkey a, s_suppkey * 2 b FROM supplier WHERE s_suppkey * 2 IN (SELECT s_suppkey FROM supplier)), path AS (SELECT a, b FROM step UNION SELECT p.a, s.b FROM path p JOIN step s ON p.b = s.a) SELECT a, b FROM path")
code("lib_taint_alert", {
    "TaintSource": ("supplier", "s_suppkey; 'in'", "s_acctbal > 5000"), "TaintSink": ("supplier", "s_suppkey; 'sql'", "s_acctbal < 5000"), "ExprMayRef": ("supplier", "s_suppkey; s_suppkey", "true"),
    "AdditionalTaintStep": _DOUBLE, "SymbolType": ("supplier", "s_suppkey; s_nationkey", "true"), "NonTaintableType": ("nation", "n_nationkey", "n_regionkey = 0"),
}, 'select a as "src", b as "sink", k as "kind", w as "what" where TaintAlert(a, b, k, w).',
     f"""WITH RECURSIVE {_DOUBLED}, flow AS (SELECT a, b FROM step UNION SELECT p.a, s.b FROM flow p JOIN step s ON p.b = s.a),
     tainted AS (SELECT s_suppkey s FROM supplier WHERE s_acctbal > 5000 UNION SELECT b FROM tainted JOIN flow ON s = a WHERE b NOT IN (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0))
     SELECT x.s_suppkey AS src, s AS sink, 'in' AS kind, 'sql' AS what FROM tainted JOIN supplier y ON y.s_suppkey = s JOIN supplier x ON x.s_acctbal > 5000 WHERE y.s_acctbal < 5000""")  # fmt: skip
code("lib_param_binding", {
    "CallCalleeSym": ("orders", "o_orderkey; o_custkey", "true"), "FunctionSymbol": ("customer", "c_custkey; c_custkey", "true"), "CallArg": ("lineitem", "l_orderkey; l_linenumber; l_partkey", "true"),
    "Parameter": ("customer", "c_custkey; 2; c_name; 0; c_custkey + 1000; ''", "true"), "CallArgSpread": ("lineitem", "l_orderkey; l_linenumber", "l_returnflag = 'R'"), "ParameterRest": ("customer", "c_custkey; 2", "c_nationkey < 3"),
}, 'select f as "f", s as "s", e as "e" where ParamBinding(f, 2, s, e).',
     """SELECT DISTINCT o_custkey AS f, o_custkey + 1000 AS s, l_partkey AS e FROM orders JOIN lineitem l ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
     WHERE l_linenumber = 2 AND c_nationkey >= 3 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = 2 AND x.l_returnflag = 'R')""")  # fmt: skip
code("lib_may_resolve_to", {"ExprValueSource": ("supplier", "s_suppkey; s_suppkey", "s_acctbal > 5000"), "Await": ("supplier", "s_suppkey * 2; s_suppkey", "true")},
     'select v as "v", s as "s" where MayResolveTo(v, s).',
     f"WITH RECURSIVE {_DOUBLED}, found AS (SELECT s_suppkey v, s_suppkey s FROM supplier WHERE s_acctbal > 5000 UNION SELECT b, s FROM found JOIN step ON v = a) SELECT v, s FROM found")
code("lib_classes", {"Function": ("part", "p_partkey; p_name; p_size % 2; 0; 0; 0", "true"), "Parameter": ("lineitem", "l_partkey; l_linenumber; l_returnflag; 0; 0; ''", "true")},
     'import code::functions from Function f, Parameter p where f.isArrow() and p = f.getAParameter() and p.getIndex() = 1 select f as "f", f.getName() as "name"',
     "SELECT DISTINCT p_partkey AS f, p_name AS name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size % 2 = 1 AND l_linenumber = 1", ql=True)

_SETTERS = {
    "VarDecl": ("supplier", "s_suppkey; 0; s_suppkey + 10000000; 1", "true"), "Contains": ("supplier", "s_suppkey; s_suppkey + 20000000", "true"), "ArrayDestructure": ("supplier", "s_suppkey + 20000000; 1; s_suppkey + 30000000", "true"),
    "CallCalleeSym": ("supplier", "s_suppkey + 10000000; s_nationkey", "true"), "ImportBinding": ("nation", "n_nationkey; 'react'; 'useState'", "n_regionkey = 1"),
}
code("lib_react_setters", _SETTERS, 'import code::react from int s where isUseStateSetterSym(s) select s as "s"',
     "SELECT s_suppkey + 30000000 AS s FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1", ql=True)
code("lib_dataflow_config", {"Symbol": ("supplier", "s_suppkey; concat('n', s_nationkey); 0; 0", "true"), "LocalFlowStar": ("supplier", "0; s_suppkey; s_suppkey * 2", "true")},
     """import code::pathgraph class C extends DataFlow::Configuration { C() { this = 1 }
     override predicate isSource(DataFlow::Node n) { n.getName() != "n3" } override predicate isSink(DataFlow::Node n) { n.getName() != "n4" } override predicate isBarrier(DataFlow::Node n) { n.getName() = "n5" } }
     from C c, DataFlow::Node a, DataFlow::Node b where c.hasFlow(a, b) select a as "a", b as "b" """,
     "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON y.s_suppkey IN (x.s_suppkey, 2 * x.s_suppkey) WHERE x.s_nationkey NOT IN (3, 5) AND y.s_nationkey NOT IN (4, 5)", ql=True)

# ---- statistics and demand


def _statistic(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_statistic("stats_columns", lambda spark, d: statistics.compute(spark, {t: read_table(spark, d, t) for t in ("orders", "part")}).select("relation", "column", "rows", "null_fraction"),
           "SELECT 'orders' AS relation, c AS \"column\", (SELECT count(*) FROM orders) AS rows, 0.0::DOUBLE AS null_fraction FROM unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) t(c) UNION ALL SELECT 'part', c, (SELECT count(*) FROM part), 0.0 FROM unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) t(c)")
_statistic("stats_distinct_estimates", lambda spark, d: statistics.column_statistics("lineitem", read_table(spark, d, "lineitem")).select("column", "distinct_values", "histogram"))
_statistic("stats_frequent_values", lambda spark, d: statistics.frequent_values(read_table(spark, d, "part"), "p_type", 32),
           "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32")
_statistic("stats_join_selectivity", lambda spark, d: statistics.join_selectivity(read_table(spark, d, "customer"), "c_custkey", read_table(spark, d, "orders"), "o_custkey"),
           "SELECT count(*) AS rows, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS matched FROM customer")


def _demanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _GRAPH + 'Path(a, b) :- Step(a, b). Path(a, c) :- Step(a, b), Path(b, c). select b as "b" where Path(1, b).'
    parsed = parse_program(program)
    engine = engine_over(spark, sf_dir, "supplier").add_rules(parsed.rules)
    return engine.query(rewrite(engine, parsed.query))


_statistic("magic_sets", _demanded, _PATH + "SELECT DISTINCT b FROM path WHERE a = 1")
