"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable runs. Compaction takes the runs of one size tier (a
factor of ``fanout`` in bytes) and, where there are at least ``fanout`` of them, merges them into
files of about the target size; a merged run belongs to a higher tier, so a row is rewritten
once for each tier at most. Merging reads runs side by side and needs no shuffle.

What is visible is the newest manifest: a small JSON file with a version number, the schema and
the live runs. A version is written under a temporary name and renamed to its number without
overwriting, so of two writers one wins and the other starts again from the winner's version;
files of lost or broken attempts are never listed. Old versions stay readable until ``vacuum``.

Everything on the rows' path is DataFrame reading and writing; the driver only handles file
names and sizes of runs.

Defined results: null values, empty texts, repeated rows and further columns come back as they
were; an empty arrival adds a version without runs; a store without versions is an error to read.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopulse.llm.text import shared_folder

TARGET_BYTES = 64 << 20
FANOUT = 4
BASE_BYTES = 1 << 20
ARRIVALS = 16


@dataclass(frozen=True)
class Run:
    """An immutable set of files."""

    path: str
    bytes: int
    files: int
    merges: int = 0


def tier(size: int, fanout: int, base: int = BASE_BYTES) -> int:
    """Size tier of a run: 0 up to ``base`` bytes, then one for each factor of ``fanout``."""
    return max(0, math.ceil(math.log(max(size, 1) / base, fanout))) if size > base else 0


class CommitConflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    """A table of immutable runs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.conf)

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        fs, folder = self._fs(), self._path(f"{self.path}/_manifests")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Run]]:
        """(version, schema, runs) of a version, the newest by default; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, None, []
        stream = self._fs().open(self._path(self._name(version)))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        content = json.loads(text)
        return version, content["schema"], [Run(**r) for r in content["runs"]]

    def _name(self, version: int) -> str:
        return f"{self.path}/_manifests/v{version:09d}.json"

    def _id(self) -> str:
        return self.jvm.java.util.UUID.randomUUID().toString()

    def commit(self, version: int, schema: str | None, runs: list[Run]) -> None:
        """Publish a version; CommitConflict if it exists."""
        fs, temporary = self._fs(), self._path(f"{self.path}/_manifests/.{self._id()}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "schema": schema, "runs": [asdict(r) for r in runs]}).encode()))
        finally:
            out.close()
        final = self._path(self._name(version))
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(temporary, final, options)
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} exists") from e
            raise

    def _run(self, path: str, merges: int = 0) -> Run:
        fs = self._fs()
        sizes = [x.getLen() for x in fs.listStatus(self._path(path)) if x.getPath().getName().startswith("part-")]
        return Run(path, sum(sizes), len(sizes), merges)

    def _publish(self, schema: str | None, added: list[Run], gone: frozenset[str] = frozenset()) -> int:
        while True:
            version, old_schema, runs = self.manifest()
            live = {r.path for r in runs}
            if not gone <= live:
                raise CommitConflict("a run to be replaced is no longer live")
            try:
                self.commit(version + 1, old_schema or schema, [r for r in runs if r.path not in gone] + added)
                return version + 1
            except CommitConflict:
                continue

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Append rows as one run, or as one for each value of ``arrival``; returns the version."""
        folder = f"{self.path}/data/{self._id()}"
        if arrival is None:
            rows.write.parquet(folder)
            runs = [self._run(folder)]
        else:
            name = "_arrival_" + self._id().replace("-", "")
            rows.withColumn(name, arrival).write.partitionBy(name).parquet(folder)
            parts = [x.getPath().toString() for x in self._fs().listStatus(self._path(folder)) if x.isDirectory()]
            runs = [self._run(p) for p in sorted(parts) if not p.rpartition("/")[2].startswith("_temporary")]
        return self._publish(rows.schema.json(), [r for r in runs if r.files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        version, schema, runs = self.manifest(version)
        if not version:
            raise FileNotFoundError(f"no version in {self.path}")
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(r.path for r in runs)) if runs else self.spark.createDataFrame([], kind)

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, base: int = BASE_BYTES) -> int:
        """Merge until no tier has ``fanout`` runs below the target size; returns the number of merges."""
        merges = 0
        while True:
            _, schema, runs = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                if r.bytes < target * max(r.files, 1) * 0.75:  # else its files are large enough
                    tiers.setdefault(tier(r.bytes, fanout, base), []).append(r)
            ready = [t for t, same in tiers.items() if len(same) >= fanout]
            if not ready:
                return merges
            same = tiers[min(ready)]
            folder = f"{self.path}/data/{self._id()}"
            files = max(1, round(sum(r.bytes for r in same) / target))
            kind = T.StructType.fromJson(json.loads(schema))
            self.spark.read.schema(kind).parquet(*(r.path for r in same)).coalesce(files).write.parquet(folder)
            self._publish(schema, [self._run(folder, 1 + max(r.merges for r in same))], frozenset(r.path for r in same))
            merges += 1

    def vacuum(self) -> None:
        """Delete the versions before the newest, and the files that it doesn't list."""
        version, _, runs = self.manifest()
        fs, live = self._fs(), {self._path(r.path).toUri().getPath() for r in runs}
        for v in self.versions():
            if v < version:
                fs.delete(self._path(self._name(v)), False)
        data = self._path(f"{self.path}/data")
        for batch in fs.listStatus(data) if fs.exists(data) else []:
            parts = [x.getPath() for x in fs.listStatus(batch.getPath()) if x.isDirectory()]
            if batch.getPath().toUri().getPath() in live:
                continue
            if not any(p.toUri().getPath() in live for p in parts):
                fs.delete(batch.getPath(), True)
                continue
            for p in parts:
                if p.toUri().getPath() not in live:
                    fs.delete(p, True)


def op4_sharding(docs: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """All documents, appended in ``arrivals`` parts, compacted, and read from the committed version.

    doc_id, lang, source, n_chars, text_md5.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, f"{shared_folder(spark)}/shards/{spark.sql('select uuid()').head()[0]}")
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))
