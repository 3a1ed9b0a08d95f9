"""Work plans: the fill against the fold, lifts against simulation."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ordering, planning
from loomgraph.operators.score import workflow_scores
from loomgraph.plans import project


def fold(tasks, budget):
    taken = set()
    for key in {t[0] for t in tasks}:
        left = Decimal(str(budget))
        own = [t for t in tasks if t[0] == key and t[2] > 0]
        for _, i, effort, _ in sorted(own, key=lambda t: (-(t[3] / t[2]), -t[3], t[1])):
            cost = Decimal(str(effort))
            if cost <= left:
                left -= cost
                taken.add((key, i))
    return taken


@pytest.mark.parametrize("seed,budget,efforts", [(1, 100.0, range(1, 60)), (2, 37.5, [0.25, 0.5, 3, 7.75, 12, 40]), (3, 64.0, [1, 2, 4, 8, 16, 32, 64]), (4, 1.0, [0.001, 0.3, 0.999, 1, 2]), (5, 99.0, [100, 120]), (6, 5000.0, range(1, 4))])
def test_fill_equals_the_fold(spark, seed, budget, efforts, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 3)
    rng = random.Random(seed)
    tasks = [(rng.choice(["a", "b", None, "c"]), k, float(rng.choice(list(efforts))), float(rng.randrange(0, 30))) for k in range(150)] + [("a", 1000, 0.0, 5.0), ("a", 1001, -1.0, 5.0)]
    got = ordering.greedy_fill(spark.createDataFrame(tasks, "k string, id long, effort double, lift double").repartition(5), budget, ["k"])
    assert {(r.k, r.id) for r in got.collect()} == fold(tasks, budget) and got.columns == ["k", "id", "effort", "lift"]


def test_fill_without_a_limit_or_tasks(spark):
    tasks = spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 2, 0.0, 1.0)], "k string, id long, effort double, lift double")
    assert ordering.greedy_fill(tasks, float("inf"), ["k"]).count() == 1
    assert ordering.greedy_fill(tasks.where("false"), 10.0, ["k"]).count() == 0


@pytest.fixture(scope="module")
def repo(spark):
    rng = random.Random(3)
    names = [f"f{k:02}" for k in range(30)]
    files = spark.createDataFrame([(f, rng.choice(["ast", "heuristic"]), True, rng.choice([0, 0, 2]), rng.randrange(9)) for f in names], "file string, parser_kind string, parsed boolean, parse_errors int, n_exports int")
    members = spark.createDataFrame([(w, f) for w in "xyz" for f in names[:24] if rng.random() < 0.5], "workflow string, file string")
    credit = spark.createDataFrame([(f, rng.choice(["untested", "tested-nameonly", "tested-real"])) for f in names], "file string, status string")
    calls = spark.createDataFrame([(rng.choice(names), rng.choice(["unresolved", "cross-file", "dynamic"])) for _ in range(80)], "file string, resolution string")
    orphans = files.select("file").join(members.select("file"), "file", "left_anti")
    return files, members, credit, calls, orphans


def score_of(files, members, credit, calls, covered):
    signals = project.signals(files, members, calls, credit)
    sizes = {r.workflow: r.n for r in members.groupBy("workflow").agg(F.count("*").alias("n")).collect()}
    scores = {r.workflow: r.score for r in workflow_scores(signals).collect()}
    mean = sum(scores[w] * n for w, n in sizes.items()) / sum(sizes.values())
    return 0.9 * mean + 0.1 * covered / files.count()


def test_lifts_are_what_the_scorer_gives(spark, repo):
    files, members, credit, calls, orphans = repo
    covered = members.select("file").distinct().count()
    now = score_of(files, members, credit, calls, covered)
    signals = project.signals(files, members, calls, credit)
    tasks = {r.id: r for r in planning.improvement_candidates(files, members, credit, calls, orphans, signals).collect()}
    assert {r.kind for r in tasks.values()} == {"add-test", "replace-padding", "fix-parse", "resolve-calls", "wire-coverage"}
    seen = set()
    for r in sorted(tasks.values(), key=lambda r: r.id):
        if r.kind in seen:
            continue
        seen.add(r.kind)
        done = [files, members, credit, calls]
        if r.kind in ("add-test", "replace-padding"):
            done[2] = credit.withColumn("status", F.when(F.col("file") == r.file, "tested-real").otherwise(F.col("status")))
        elif r.kind == "fix-parse":
            done[0] = files.withColumn("parse_errors", F.when(F.col("file") == r.file, 0).otherwise(F.col("parse_errors")))
        elif r.kind == "resolve-calls":
            done[3] = calls.withColumn("resolution", F.when(F.col("resolution") == "unresolved", "cross-file").otherwise(F.col("resolution")))
        extra = 1 if r.kind == "wire-coverage" else 0
        assert score_of(*done, covered + extra) - now == pytest.approx(r.lift, abs=1e-8), r.id


def test_plan_and_projection(spark, repo):
    files, members, credit, calls, orphans = repo
    signals = project.signals(files, members, calls, credit)
    tasks = planning.improvement_candidates(files, members, credit, calls, orphans, signals)
    low = planning.improvement_plan(tasks, float("inf"), "low")
    assert {r.risk for r in low.collect()} == {"low"}
    plan = planning.improvement_plan(tasks, 90.0, "medium")
    rows = plan.collect()
    assert 0 < sum(r.effort for r in rows) <= 90
    got = planning.projection(plan, files, members, signals).first()
    done = {r.file for r in rows if r.kind in ("add-test", "replace-padding")}
    parsed = {r.file for r in rows if r.kind == "fix-parse"}
    credit_after = credit.withColumn("status", F.when(F.col("file").isin(*done or [""]), "tested-real").otherwise(F.col("status")))
    files_after = files.withColumn("parse_errors", F.when(F.col("file").isin(*parsed or [""]), 0).otherwise(F.col("parse_errors")))
    calls_after = calls.withColumn("resolution", F.when(F.col("resolution") == "unresolved", "cross-file").otherwise(F.col("resolution"))) if any(r.kind == "resolve-calls" for r in rows) else calls
    covered = members.select("file").distinct().count()
    wired = sum(r.kind == "wire-coverage" for r in rows)
    assert got.before == pytest.approx(score_of(files, members, credit, calls, covered)) and got.after == pytest.approx(score_of(files_after, members, credit_after, calls_after, covered + wired))
    assert got.after > got.before and got.tasks == len(rows)
