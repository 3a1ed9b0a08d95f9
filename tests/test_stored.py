"""Caches and written files, with runs that end halfway."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.cache import ParseCache
from loomgraph.sources.changes import ChangeStore, UnsafePath

FILES = {f"src/{k}.js": f"let a = {k};\n" for k in range(30)} | {"empty.js": "", "ünï/ß.txt": "é" * 500}


def rows(spark, files):
    return spark.createDataFrame(list(files.items()), "file string, text string").repartition(3)


def entries(df):
    return {r.file: (r.n, r.run) for r in df.collect()}


def compute(run):
    return lambda df: df.select("file", "sha", F.length("text").alias("n"), F.lit(run).alias("run"))


@pytest.fixture
def cache(spark, tmp_path):
    return lambda signature="a": ParseCache(spark, str(tmp_path / "cache"), signature, "n int, run int", buckets=8)


def test_only_changed_files_are_computed(spark, cache):
    assert entries(cache().refresh(rows(spark, FILES), compute(1))) == {f: (len(t), 1) for f, t in FILES.items()}
    after = FILES | {"src/3.js": "edited", "new.js": "new"}
    del after["src/4.js"]
    want = {f: (len(t), 1 if FILES.get(f) == t else 2) for f, t in after.items()}
    assert entries(cache().refresh(rows(spark, after), compute(2))) == want and entries(cache().load()) == want
    assert entries(cache().refresh(rows(spark, after), compute(3))) == want


def test_another_signature_or_layout_is_an_empty_cache(spark, cache, tmp_path):
    cache().refresh(rows(spark, FILES), compute(1))
    assert cache("b").load().count() == 0
    (tmp_path / "cache/manifest.json").write_text("{ half")
    (tmp_path / "cache/.manifest.json.crc").unlink(missing_ok=True)
    assert cache().load().count() == 0
    assert entries(cache().refresh(rows(spark, FILES), compute(2))) == {f: (len(t), 2) for f, t in FILES.items()}


def test_a_crash_before_the_swap_changes_nothing(spark, cache, tmp_path, monkeypatch):
    cache().refresh(rows(spark, FILES), compute(1))
    before = entries(cache().load())
    crash = cache()
    monkeypatch.setattr(crash, "_swap", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        crash.refresh(rows(spark, {"src/1.js": "other", "x": "y"}), compute(2))
    assert entries(cache().load()) == before
    assert entries(cache().refresh(rows(spark, {"src/1.js": "other", "src/2.js": FILES["src/2.js"]}), compute(3))) == {"src/1.js": (5, 3), "src/2.js": (len(FILES["src/2.js"]), 1)}
    cache().refresh(rows(spark, {"src/1.js": "again"}), compute(4))
    versions = [n for n in os.listdir(tmp_path / "cache") if n.startswith("v-")]
    assert len(versions) <= 4


def test_nothing_repeats_and_nulls(spark, cache):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "x"), ("b", "t"), ("b", "u")], "file string, text string")
    got = cache().refresh(df, compute(1)).collect()
    assert sorted((r.file, r.n) for r in got) == [("a", 0), ("b", 1), ("b", 1)]
    assert cache().refresh(df.where("false"), compute(2)).count() == 0 and cache().load().count() == 0


# ---- writes

def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


@pytest.fixture
def changes(spark, tmp_path):
    (tmp_path / "root").mkdir()
    return ChangeStore(spark, str(tmp_path / "root"), str(tmp_path / "store"))


def test_rollback_restores_every_byte(spark, changes, tmp_path):
    root = tmp_path / "root"
    (root / "old.bin").write_bytes(bytes(range(256)))
    first = changes.apply(rows(spark, FILES | {"old.bin": "text"}), "fix")
    held = tree(root)
    assert held == {f: t.encode() for f, t in FILES.items()} | {"old.bin": b"text"}
    second = changes.apply(rows(spark, {"src/1.js": "other", "src/2.js": None, "a/b/c": "new", "gone": None}), "review")
    assert tree(root) == {f: t for f, t in held.items() if f != "src/2.js"} | {"src/1.js": b"other", "a/b/c": b"new"}
    changes.rollback(second)
    assert tree(root) == held
    changes.rollback(first)
    assert tree(root) == {"old.bin": bytes(range(256))}
    assert changes.ids() == [first, second] and [changes.state(c) for c in (first, second, "x")] == ["rolled-back", "rolled-back", "unknown"]
    with pytest.raises(ValueError, match="rolled-back"):
        changes.rollback(first)


def test_a_failing_task_leaves_all_as_it_was(spark, changes, tmp_path):
    root = tmp_path / "root"
    changes.apply(rows(spark, FILES), "fix")
    before = tree(root)
    (root / "src/folder").mkdir()
    (root / "src/folder/x").write_text("in the way")
    with pytest.raises(Exception):
        changes.apply(rows(spark, {f: "changed" for f in FILES} | {"src/folder": "a file over a folder"}), "fix")
    assert tree(root) == before | {"src/folder/x": b"in the way"}
    assert changes.state(changes.ids()[-1]) == "failed"


def test_a_lost_driver_is_made_good(spark, changes, tmp_path, monkeypatch):
    root = tmp_path / "root"
    changes.apply(rows(spark, FILES), "fix")
    before, put = tree(root), changes._put

    def lost(change, which):
        if which == "before":
            raise KeyboardInterrupt
        put(change, which)
        raise KeyboardInterrupt

    monkeypatch.setattr(changes, "_put", lost)
    with pytest.raises(KeyboardInterrupt):
        changes.apply(rows(spark, {"src/1.js": "half", "src/new.js": "x"}), "fix")
    assert tree(root) != before
    again = ChangeStore(spark, str(root), changes.folder)
    assert again.recover() == [again.ids()[-1]] and tree(root) == before and again.recover() == []


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../b", "a//b", "", ".git/config", "sub/.env", "a\\b", None])
def test_unsafe_names_write_nothing(spark, changes, tmp_path, name):
    with pytest.raises(UnsafePath):
        changes.apply(spark.createDataFrame([("ok", "x"), (name, "y")], "file string, text string"), "fix")
    assert tree(tmp_path / "root") == {} and changes.ids() == []


def test_names_given_twice_are_an_error(spark, changes):
    with pytest.raises(ValueError, match="given twice"):
        changes.apply(spark.createDataFrame([("a", "x"), ("a", "y")], "file string, text string"), "fix")
