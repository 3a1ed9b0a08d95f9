"""A persistent cache of what was computed from files, by content.

A cache is a folder: tables of buckets of file names, one folder a version, and
a manifest that names the version of every bucket, the layout and the signature
of the configuration. A save writes only buckets in which something came or
went, and then swaps the manifest; until the swap, readers and a run after a
crash see the state before. A manifest that is missing, unreadable, of another
layout or another signature is an empty cache: all is computed again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard
from . import store

LAYOUT, BUCKETS = 1, 64


class ParseCache:
    """Entries (file, sha, and the columns of ``schema``) in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, signature: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.signature, self.buckets = spark, folder.rstrip("/"), signature, buckets
        self.schema = f"file string, sha string, {schema}"

    def _manifest(self) -> dict:
        got = store.read_json(self.spark, f"{self.folder}/manifest.json")
        fits = isinstance(got, dict) and (got.get("layout"), got.get("signature"), got.get("buckets")) == (LAYOUT, self.signature, self.buckets)
        return got if fits else {"parts": {}}

    def load(self, only: list[int] | None = None) -> DataFrame:
        """The entries, or those of some buckets."""
        by: dict[str, list[str]] = {}
        for bucket, version in self._manifest()["parts"].items():
            if only is None or int(bucket) in only:
                by.setdefault(version, []).append(f"{self.folder}/{version}/bucket={bucket}")
        out = self.spark.createDataFrame([], self.schema)
        for _, paths in sorted(by.items()):
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(*paths))
        return out

    def refresh(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Entries of all of rows (file, text): cached ones where file and
        content are known, others by ``compute``, which gets (file, text, sha)
        and returns a row for each with the cache's columns. Entries of files
        that are gone or changed are evicted. A null text counts as empty; rows
        without a file name go; of equal rows one stays.
        """
        named = rows.where("file is not null").select("file", F.coalesce("text", F.lit("")).alias("text"))
        hashed = named.withColumn("sha", F.sha1("text")).dropDuplicates(["file", "sha"])
        bucket = F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int").alias("bucket")
        live = cut(hashed.select("file", "sha", bucket), "live")
        known = self.load().select("file", "sha", bucket)
        missing = cut(live.join(known, ["file", "sha"], "left_anti"), "missing")
        gone = known.join(live, ["file", "sha"], "left_anti")
        touched = sorted(r.bucket for r in missing.select("bucket").union(gone.select("bucket")).distinct().collect())
        if touched:
            kept = self.load(touched).join(live.select("file", "sha"), ["file", "sha"], "left_semi")
            fresh = compute(hashed.join(missing.select("file", "sha"), ["file", "sha"], "left_semi").select("file", "text", "sha"))
            self._save(kept.unionByName(fresh.select(*kept.columns)).withColumn("bucket", bucket), touched)
        discard(live)
        discard(missing)
        return self.load()

    def _save(self, entries: DataFrame, touched: list[int]) -> None:
        old = self._manifest()
        version = f"v-{uuid.uuid4().hex}"
        entries.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        full = [int(n.split("=")[1]) for n in store.names(self.spark, f"{self.folder}/{version}") if n.startswith("bucket=")]
        parts = {b: v for b, v in old["parts"].items() if int(b) not in touched} | {str(b): version for b in full}
        self._swap({"layout": LAYOUT, "signature": self.signature, "buckets": self.buckets, "parts": parts})
        #: the version before stays for readers that have begun; older ones go
        used = {*parts.values(), *old["parts"].values()}
        for name in store.names(self.spark, self.folder):
            if name.startswith("v-") and name not in used:
                store.delete(self.spark, f"{self.folder}/{name}")

    def _swap(self, manifest: dict) -> None:
        store.replace_json(self.spark, f"{self.folder}/manifest.json", manifest)
