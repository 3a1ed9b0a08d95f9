"""How often the calls of a project are dealt out to be resolved."""

from loomgraph.operators.resolve import resolve_calls

FUNCTIONS = "file string, name string, exported boolean, receiver string, calls array<string>"


def resolved(spark, functions):
    imports = spark.createDataFrame([("a", 0, ["g"])], "file string, seq int, names array<string>")
    edges = spark.createDataFrame([("a", 0, "b")], "file string, seq int, to_file string")
    return resolve_calls(spark.createDataFrame(functions, FUNCTIONS), imports, edges)


def kinds(df):
    return {(r.fn, r.call): (r.resolution, r.to_id) for r in df.collect()}


def test_calls_meet_names_by_one_key_where_no_name_has_a_dot(spark):
    df = resolved(spark, [("a", "f", True, None, ["f", "g", "f.x", "h"]), ("b", "g", True, None, [])])
    #: of imports and edges, what a bound name means (two), and two of the calls by one key
    assert df._jdf.queryExecution().sparkPlan().toString().count("Join") == 5
    assert kinds(df) == {("f", "f"): ("local", "a#f"), ("f", "g"): ("cross-file", "b#g"), ("f", "f.x"): ("local-receiver", "a#f"), ("f", "h"): ("unresolved", None)}


def test_names_with_dots_still_answer(spark):
    df = resolved(spark, [("a", "R.prototype.m", True, "R", ["this.n", "R.prototype.n", "this.o"]), ("a", "R.prototype.n", True, "R", [])])
    m = "R.prototype.m"
    assert kinds(df) == {(m, "this.n"): ("local-receiver", "a#R.prototype.n"), (m, "R.prototype.n"): ("local", "a#R.prototype.n"), (m, "this.o"): ("dynamic", None)}


def test_names_that_are_not_found_stay_where_they_are(spark):
    """What imported names mean is looked up, and only what is found comes back."""
    df = resolved(spark, [("a", "f", True, None, ["g", "h"]), ("b", "g", True, None, [])])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8
    #: calls keep what has no match, and so do bound names, but not the lookups
    assert plan.count("LeftOuter") == 3


def test_packages_of_many_files_and_references_without_edges(spark):
    functions = [("a", "f", True, None, ["g", "h", "k.x", "m", "this.n", "this"]), ("b", "g", True, None, []), ("c", "h", True, None, []), ("d", "h", False, None, []), (None, "z", True, None, ["g"])]
    imports = spark.createDataFrame([("a", 0, ["g", "h"]), ("a", 1, ["k"]), ("a", 2, ["m"]), ("a", None, ["f"]), (None, 0, ["g"])], "file string, seq int, names array<string>")
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 0, "c"), ("a", 1, None), ("x", 2, "b"), (None, 0, "b")], "file string, seq int, to_file string")
    got = kinds(resolve_calls(spark.createDataFrame(functions, FUNCTIONS), imports, edges))
    assert got == {
        ("f", "g"): ("cross-file", "b#g"), ("f", "h"): ("cross-file", "c#h"), ("f", "k.x"): ("external", None), ("f", "m"): ("unresolved", None),
        ("f", "this.n"): ("dynamic", None), ("f", "this"): ("unresolved", None), ("z", "g"): ("unresolved", None),
    }
