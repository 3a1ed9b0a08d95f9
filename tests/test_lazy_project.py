"""What an analysis computes for one question."""

from loomgraph.plans import project
from loomgraph.sources.project import manifests

from .sample_files import sample_rows


def written(monkeypatch):
    names = []
    plain = project.cut
    monkeypatch.setattr(project, "cut", lambda df, name="cut": names.append(name) or plain(df, name))
    return names


def test_imports_cost_no_calls_and_no_workflows(spark, monkeypatch):
    names = written(monkeypatch)
    found = project.analyze(sample_rows(spark))
    assert found.import_edges.count() > 0
    assert names == ["rows", "nodes", "imports"]
    assert found.import_edges is found.import_edges


def test_entry_points_cost_no_import_edges_where_there_are_some(spark, monkeypatch):
    names = written(monkeypatch)
    assert not project.analyze(sample_rows(spark)).entry_points.isEmpty()
    assert names == ["rows", "nodes", "entry", "entries"]


def test_manifests_of_one_pass(spark):
    rows = spark.createDataFrame([("package.json", '{"name": "x",}'), ("a/package.json", "{}"), ("jsconfig.json", "[1]")], "file string, text string")
    assert manifests(rows, "package.json", "tsconfig.json", "jsconfig.json") == [{"name": "x"}, {}, {}]
