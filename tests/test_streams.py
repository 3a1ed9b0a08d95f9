"""The tree as a stream, and changes that come to rest."""

import os
import random
from datetime import datetime, timedelta

import pytest

from loomgraph.streaming import remap, settled, tree


def put(root, files):
    for name, text in files.items():
        path = root / name
        if text is None:
            path.unlink()
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)


class Stream:
    """A stream over a tree that stops after what there is, and begins again."""

    def __init__(self, spark, tmp_path, fail=()):
        self.spark, self.tmp, self.got, self.fail = spark, tmp_path, [], set(fail)

    def once(self):
        def batch(df, n):
            rows = [(r.file, r.change, r.text) for r in df.collect()]
            if n in self.fail:
                self.fail.discard(n)
                raise OSError("lost")
            self.got.append(sorted(rows, key=str))

        source = tree.tree_changes(self.spark, str(self.tmp / "root"), str(self.tmp / "listings"), ".js,.txt", chunk=2)
        query = source.writeStream.foreachBatch(batch).option("checkpointLocation", str(self.tmp / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        before, self.got = self.got, []
        return [r for rows in before for r in rows]


def test_changes_arrive_once_and_after_a_restart(spark, tmp_path):
    root, stream = tmp_path / "root", Stream(spark, tmp_path)
    put(root, {"a.js": "a", "sub/b.js": "b", "c.txt": "c", "d.md": "no", "node_modules/x.js": "no"})
    assert stream.once() == [("a.js", "added", "a"), ("c.txt", "added", "c"), ("sub/b.js", "added", "b")]
    assert stream.once() == []
    put(root, {"a.js": "edited", "c.txt": None, "sub/e.js": ""})
    assert stream.once() == [("a.js", "changed", "edited"), ("c.txt", "removed", None), ("sub/e.js", "added", "")]
    put(root, {"a.js": None, "c.txt": "back"})
    assert stream.once() == [("a.js", "removed", None), ("c.txt", "added", "back")]
    assert stream.once() == [] and len(os.listdir(tmp_path / "listings")) <= 2


def test_a_batch_that_fails_comes_again(spark, tmp_path):
    root, stream = tmp_path / "root", Stream(spark, tmp_path, fail=[1])
    put(root, {"a.js": "a"})
    assert stream.once() == [("a.js", "added", "a")]
    put(root, {"b.js": "b", "a.js": None})
    with pytest.raises(Exception):
        stream.once()
    assert stream.once() == [("a.js", "removed", None), ("b.js", "added", "b")] and stream.once() == []


def test_the_tree_drives_the_watch(spark, tmp_path):
    root, seen = tmp_path / "root", []
    put(root, {"a.js": "a", "b.js": "b"})
    for edit in ({}, {"a.js": "x", "b.js": None}):
        put(root, edit)
        source = tree.tree_changes(spark, str(root), str(tmp_path / "listings")).select("file", "text", "at")
        query = remap.watch(source, str(tmp_path / "state"), str(tmp_path / "check"), lambda df, n: seen.append(sorted(tuple(r) for r in df.collect()))).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert [x for x in seen if x] == [[("a.js", "added"), ("b.js", "added")], [("a.js", "changed"), ("b.js", "removed")]]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, settled.PROVIDER)
    yield
    spark.conf.set(key, before)


def changes_of(seed, n=400):
    rng = random.Random(seed)
    at, rows = datetime(2024, 1, 1), []
    for _ in range(n):
        at += timedelta(milliseconds=rng.choice([0, 10, 100, 900, 1000, 1001, 4000]))
        rows.append((f"f{rng.randrange(6)}", rng.choice(["a", "b", None, "c"]), at))
    return rows


def test_settled_changes_equal_the_batch(spark, tmp_path, rocks):
    schema = "file string, text string, at timestamp"
    rows = changes_of(4)
    for k in range(0, len(rows), 100):
        spark.createDataFrame(rows[k : k + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = settled.settled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), quiet=1.0)
        got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(200)
    end = [(f"z{k}", "end", rows[-1][2] + timedelta(hours=1 + k)) for k in range(3)]
    for row in end:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = settled.settled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), quiet=1.0)
        got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(200)
    stream = sorted(str(tuple(r)) for r in spark.read.parquet(str(tmp_path / "out")).where("file not like 'z%'").collect())
    batch = sorted(str(tuple(r)) for r in settled.settled_batch(spark.createDataFrame(rows, schema), 1.0).collect())
    assert stream == batch and len(batch) > 50


def by_hand(rows, quiet):
    out, reported = [], {}
    for file in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == file), key=lambda r: (r[2], r[1] is not None, r[1] or ""))
        for k, (_, text, at) in enumerate(own):
            if k + 1 == len(own) or own[k + 1][2] - at >= timedelta(seconds=quiet):
                if text != reported.get(file):
                    out.append((file, "added" if reported.get(file) is None else "removed" if text is None else "changed", text, at))
                reported[file] = text
    return sorted(out, key=str)


def test_settled_batch(spark):
    rows = changes_of(9)
    got = settled.settled_batch(spark.createDataFrame(rows, "file string, text string, at timestamp"), 1.0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, 1.0)
