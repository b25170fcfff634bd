"""Keyed tables in versions: a batch rewrites the buckets that hold its keys, and a new manifest makes it visible.

A table is cut into buckets by a hash of its key.  ``merge`` shuffles a batch and the touched buckets once, by bucket, and
writes these buckets anew, in order of their keys and with Bloom filters; all other buckets keep their files.  Key
constraints (no null, no key twice in a batch, with ``insert`` none that is stored) are counted by the pass that writes.
A manifest names the files of all tables, so a change of several tables is seen as a whole or not at all: it is written
last, under the next number, and a second writer of that number fails.  What a failed or killed merge wrote is never
read, and ``vacuum`` deletes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: Tables that are merged at a time.
AT_ONCE = 4


class KeyViolation(ValueError):
    """A batch breaks a table's key constraint."""


class Conflict(RuntimeError):
    """Another writer was faster."""


@dataclass(frozen=True)
class Rule:
    """The key of a table, and the columns whose last known value stays when a later row has null."""

    keys: tuple[str, ...]
    known: tuple[str, ...] = ()


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    # Versions

    def numbers(self) -> list[int]:
        """The numbers of all manifests, written in full or not."""
        if not self._fs.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._root)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _load(self, number: int) -> dict | None:
        text = self.spark.read.text(f"{self.path}/manifest-{number:010d}.json", wholetext=True).first()
        try:
            return json.loads(text[0]) if text else None
        except ValueError:  # its writer was killed
            return None

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest that is whole, or that of a version."""
        for number in reversed(self.numbers() if version is None else [version]):
            if found := self._load(number):
                return found
        if version is not None:
            raise KeyError(version)
        return {"version": 0, "tables": {}}

    def _commit(self, base: list[int], manifest: dict) -> int:
        if self.numbers() != base:
            raise Conflict(f"{self.path} changed since this merge began")
        manifest["version"] = (base[-1] if base else 0) + 1
        try:
            out = self._fs.create(self._at(f"{self.path}/manifest-{manifest['version']:010d}.json"), False)
        except Exception as taken:
            raise Conflict(f"version {manifest['version']} of {self.path} is taken") from taken
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return manifest["version"]

    # Reading

    def schema(self, name: str, manifest: dict | None = None) -> T.StructType:
        return T.StructType.fromJson((manifest or self.manifest())["tables"][name]["schema"])

    def _rows(self, table: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.path}/{p}" for b, p in table["paths"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["tables"][name])

    def names(self) -> list[str]:
        return list(self.manifest()["tables"])

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows with some keys.  ``keys`` has the table's key columns; only the buckets that they fall in are read, and
        of those, where there are few keys, the row groups that can have them."""
        table = self.manifest()["tables"][name]
        columns = {f.name: f.dataType for f in T.StructType.fromJson(table["schema"])}
        wanted = keys.select(*(F.col(k).cast(columns[k]).alias(k) for k in table["keys"])).distinct()
        found = wanted.select(*table["keys"], bucket_of(table).alias("_bucket"))
        few = found.limit(FEW + 1).collect()  # a constant
        if len(few) <= FEW:
            rows = self._rows(table, {r["_bucket"] for r in few})
            for k in table["keys"]:
                rows = rows.where(F.col(k).isin([r[k] for r in few if r[k] is not None]))
            if len(table["keys"]) == 1:
                return rows
        else:
            rows = self._rows(table, {r[0] for r in found.select("_bucket").distinct().collect()})  # at most all buckets
        return rows.join(wanted, table["keys"], "left_semi")

    # Writing

    def merge(self, batches: dict[str, DataFrame], rules: dict[str, Rule], insert: bool = False, buckets: int = BUCKETS) -> int:
        """Merge a batch into each table named, all in one version; tables that aren't there yet are made by their rule.

        A row replaces the stored row with its key, nulls included, but for the columns ``known``.  A row whose columns all
        belong to the key joins a set.  Nothing is ever removed.
        """
        base = self.numbers()
        manifest = self.manifest()
        staged: list[str] = []
        try:
            for name, rows in batches.items():
                if name not in manifest["tables"]:
                    rule = rules[name]
                    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])  # any column may be null
                    manifest["tables"][name] = {"keys": list(rule.keys), "known": list(rule.known), "buckets": buckets, "schema": schema.jsonValue(), "paths": {}}
            with ThreadPoolExecutor(AT_ONCE) as pool:  # the tables don't depend on each other, and small ones don't fill a cluster
                merged = [pool.submit(self._merge_one, name, manifest["tables"][name], rows, insert, staged) for name, rows in batches.items()]
            for one in merged:
                one.result()
        except Exception:
            self._delete(staged)
            raise
        try:
            return self._commit(base, manifest)
        except Conflict:  # after any other error the manifest may be there, so files stay until vacuum()
            self._delete(staged)
            raise

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            self._fs.delete(self._at(path), True)

    def _merge_one(self, name: str, table: dict, rows: DataFrame, insert: bool, staged: list[str]) -> None:
        schema, keys, known = T.StructType.fromJson(table["schema"]), table["keys"], table["known"]
        at = f"data/{name}/{uuid.uuid4().hex}"
        whole, part = f"{self.path}/{at}", f"{self.path}/{at}-batch"
        staged += [whole, part]
        # The batch is written once, as it is needed for the buckets it touches and for the merge.
        batch = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).withColumn("_bucket", bucket_of(table))
        batch.write.parquet(part)
        batch = self.spark.read.schema(batch.schema).parquet(part)
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # at most all buckets
        if touched:
            both = self._rows(table, touched).withColumns({"_bucket": bucket_of(table), "_new": F.lit(0)}).unionByName(batch.withColumn("_new", F.lit(1)))
            others = [f.name for f in schema if f.name not in keys]
            last = [F.max_by(F.struct(*others), "_new").alias("_last")] if others else []
            kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_new"))).alias(f"_known_{c}") for c in known]
            merged = both.repartition(len(touched), "_bucket").groupBy("_bucket", *keys).agg(F.sum("_new").alias("_n"), F.count(F.lit(1)).alias("_all"), *last, *kept)
            bad = (F.col("_n") > 1) | F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
            if insert:
                bad = bad | ((F.col("_n") > 0) & (F.col("_all") > F.col("_n")))
            seen = Observation()
            shown = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
            merged = merged.observe(seen, F.count_if(bad).alias("bad"), F.min(F.when(bad, shown)).alias("key"))
            value = {f.name: F.col(f"_known_{f.name}" if f.name in known else f"_last.{f.name}" if f.name in others else f.name).alias(f.name) for f in schema}
            writer = merged.select("_bucket", *value.values()).sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").option("compression", "zstd")
            for k in keys:
                writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", "100000")
            writer.parquet(whole)
            if seen.get["bad"]:
                raise KeyViolation(f"{name}: {seen.get['bad']} keys are null, repeated or stored already, such as {seen.get['key']}")
            table["paths"] |= {str(b): f"{at}/_bucket={b}" for b in touched}
        self._fs.delete(self._at(part), True)

    # Removing

    def vacuum(self, keep: int = 1) -> None:
        """Delete what none of the newest ``keep`` versions needs; not while another merge runs."""
        whole = [m for n in reversed(self.numbers()) if (m := self._load(n))][:keep]
        used = {p for m in whole for t in m["tables"].values() for p in t["paths"].values()}
        for number in self.numbers():
            if whole and number < whole[-1]["version"]:
                self._fs.delete(self._at(f"{self.path}/manifest-{number:010d}.json"), False)
        data = self._at(f"{self.path}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for made in self._fs.listStatus(table.getPath()):
                own = f"data/{table.getPath().getName()}/{made.getPath().getName()}"
                if not any(p.startswith(f"{own}/") for p in used):
                    self._fs.delete(made.getPath(), True)
                    continue
                for bucket in self._fs.listStatus(made.getPath()):
                    if "=" in bucket.getPath().getName() and f"{own}/{bucket.getPath().getName()}" not in used:
                        self._fs.delete(bucket.getPath(), True)

    def clear(self, confirm: bool = False) -> bool:
        """Remove all tables as one new version; refused without ``confirm``.  Files stay until ``vacuum``."""
        if confirm:
            self._commit(self.numbers(), {"tables": {}})
        return confirm


#: Keys up to which a lookup pushes them down to the row groups.
FEW = 1000


def bucket_of(table: dict) -> Column:
    return F.pmod(F.xxhash64(*table["keys"]), F.lit(table["buckets"])).cast("int")
