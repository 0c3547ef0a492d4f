"""Result formats, statistics, streaming views, the command line and the registered queries."""

import csv
import io
import json
import os

import duckdb
import pytest

from quarrylog import catalogue, cli
from quarrylog.library.relations import schema
from quarrylog.operators import statistics
from quarrylog.sinks import formats
from quarrylog.streaming.incremental import View

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("bad, \"thing\"", "src/a.ts", 2, 4), ("other", "../secret", 1, 0)], "message string, file string, line long, col long").coalesce(1)


def test_text_formats(rows):
    assert [json.loads(x) for x in formats.to_text(rows, "json").splitlines()][0] == {"message": 'bad, "thing"', "file": "src/a.ts", "line": 2, "col": 4}
    assert list(csv.reader(io.StringIO(formats.to_text(rows, "csv"))))[:2] == [["message", "file", "line", "col"], ['bad, "thing"', "src/a.ts", "2", "4"]]
    log = json.loads(formats.to_text(rows, "sarif", rule="r1"))
    [first, _] = log["runs"][0]["results"]
    assert log["version"] == "2.1.0" and first["ruleId"] == "r1" and first["level"] == "warning"
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "src/a.ts"}, "region": {"startLine": 2, "startColumn": 5}}


def test_markdown(rows, tmp_path):
    os.makedirs(tmp_path / "src")
    (tmp_path / "src/a.ts").write_text("one\ntwo ``` x\nthree\n")
    (tmp_path.parent / "secret").write_text("hidden")
    text = "/**\n * @name My query\n * @description Finds\n *   things.\n * @id a/b\n */ select 1"
    out = formats.to_text(rows, "markdown", text=text, source_root=str(tmp_path))
    assert out.startswith("# My query\n\n> Finds things.\n\n`a/b`") and "## src/a.ts:2" in out and "> 2 | two ``` x" in out and "````ts" in out
    assert "hidden" not in out and "_source not available_" in out and "_2 result(s)_" in out


def test_statistics(spark):
    df = spark.range(1000).selectExpr("id % 500 AS a", "IF(id < 250, NULL, 'x') AS s")
    got = {r.column: r for r in statistics.compute(spark, {"T": df}).collect()}
    assert got["a"].rows == 1000 and abs(got["a"].distinct_values - 500) < 40 and len(got["a"].histogram) == 65
    assert got["s"].null_fraction == 0.25 and got["s"].histogram is None
    assert statistics.frequent_values(df, "a", 2).collect()[0]["count"] == 2
    assert tuple(statistics.join_selectivity(df, "a", spark.range(100), "id").first()) == (1000, 200)
    assert abs(statistics.sample_join_size(df, df, ["a"], 0.5).first()[0] - 2000) < 400


def test_streaming_view(spark, tmp_path):
    program = "Path(x, y) :- Edge(x, y). Path(x, z) :- Path(x, y), Path(y, z)."
    view = View(spark, program, "Path", 2, "Edge", str(tmp_path / "view"))
    assert view.monotone and not View(spark, "P(x, x) :- Edge(x, _), not Edge(_, x).", "P", 2, "Edge", "").monotone
    for i, rows in enumerate([[(1, 2), (2, 3)], [(3, 4)]]):
        spark.createDataFrame(rows, "x long, y long").write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("x long, y long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = view.follow(stream, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    last = max(int(p) for p in os.listdir(tmp_path / "view/derived"))
    assert sorted(map(tuple, view.read(last).collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "f", 0, 0, 0, 0)], schema("Function")).write.parquet(str(tmp_path / "facts/Function.parquet"))
    (tmp_path / "q.ql").write_text("import code::functions from Function f select f.getName() as \"name\"")
    (tmp_path / "bad.ql").write_text("from Nope n select n")
    (tmp_path / "q.dl").write_text("P(x) :- Function(x, _, _, _, _, _). select x where P(1), P(x).")
    assert cli.main(["check", str(tmp_path / "q.ql")]) == 0 and cli.main(["check", str(tmp_path / "bad.ql")]) == 1
    assert cli.main(["query", str(tmp_path / "missing.ql"), "--facts", str(tmp_path)]) == 1
    capsys.readouterr()
    assert cli.main(["query", str(tmp_path / "q.ql"), "--facts", str(tmp_path / "facts"), "--format", "csv"]) == 0
    assert capsys.readouterr().out == "name\nf\n"
    assert cli.main(["query", str(tmp_path / "q.dl"), "--facts", str(tmp_path / "facts"), "--magic-sets", "--print-rel-sizes"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out) == {"col0": 1} and "Function/6: 1" in said.err
    assert cli.main(["stats", "compute", "--facts", str(tmp_path / "facts"), "--output", str(tmp_path / "stats")]) == 0
    assert cli.main(["stats", "inspect", "--output", str(tmp_path / "stats")]) == 0 and "Function" in capsys.readouterr().out


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES])
def test_registered_queries(spark, name):
    con = duckdb.connect()
    for table in catalogue.TEST_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df, want = catalogue.QUERIES[name](spark, SMALL), con.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    rows = lambda found: sorted(repr(tuple(r)) for r in found)
    assert rows(df.select(*(f"`{c}`" for c in columns)).collect()) == rows(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
