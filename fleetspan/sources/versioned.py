"""Tables that are updated while they are read.

An update writes its rows as a new segment beside the old files; a small manifest then names the
folders that make up the next version. The manifest is put in place by a rename that fails if that
version exists, so an update is seen whole or not at all, whatever happens to its writer, and of two
writers one is first. The other takes the newer version as its base if they touched different parts,
and is told otherwise.

``path``/data holds segments, ``path``/versions manifests. A part is a segment, or one key bucket of one, so a
manifest is as long as there are buckets or appends since the last compaction.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetspan.operators.grouping import newest_per_key

BUCKET = "key_bucket"
SEGMENT = "segment"
TRIES = 20


class Conflict(RuntimeError):
    """Another writer changed the same part of the table."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file(self.path).getFileSystem(self._conf)

    # -- files --------------------------------------------------------------------------------

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> dict[str, int]:
        """Names in a folder and when they were last changed, in milliseconds."""
        if not self._fs.exists(self._file(folder)):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(self._file(folder))}

    def _put(self, text: str, target: str) -> bool:
        """Create ``target`` with all of its content, or return False if it exists."""
        draft = f"{target}.{uuid.uuid4().hex}.draft"
        out = self._fs.create(self._file(draft), False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        try:
            files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._file(draft).toUri(), self._conf)
            files.rename(self._file(draft), self._file(target), never)
            return True
        except Exception as problem:
            self._fs.delete(self._file(draft), False)
            if "FileAlreadyExists" in str(problem):
                return False
            raise

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    # -- versions -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Parts (name to folder below data), schema, keys and buckets, last batch per job."""
        if version is None:
            known = self.versions()
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "parts": {}, "schema": None, "keyed": None, "jobs": {}}
        source = self._fs.open(self._file(self._manifest_path(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _commit(self, base: dict, touched: set[str] | None, change: Callable[[dict], None]) -> int:
        """Write the version after ``base``; ``touched`` are the parts whose content in ``base`` was used, None: all."""
        for _ in range(TRIES):
            now = self.manifest()
            if now["version"] != base["version"]:
                used = now["parts"].keys() | base["parts"].keys() if touched is None else touched
                other = [p for p in used if now["parts"].get(p) != base["parts"].get(p)]
                if other or (now["keyed"] != base["keyed"] and base["version"]):
                    raise Conflict(f"{self.path}: {len(other)} parts were changed by version {now['version']}")
            change(now)
            now["version"] += 1
            if self._put(json.dumps(now), self._manifest_path(now["version"])):
                return now["version"]
        raise Conflict(f"{self.path}: {TRIES} versions were written by others meanwhile")

    def _done(self, manifest: dict, job: tuple[str, int] | None) -> bool:
        return job is not None and manifest["jobs"].get(job[0], -1) >= job[1]

    # -- reading ------------------------------------------------------------------------------

    def read(self, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The newest version or an older one; ``parts`` reads some of its parts only."""
        return self._read(self.manifest(version), parts)

    def _read(self, manifest: dict, parts: Sequence[str] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise FileNotFoundError(f"no version of {self.path}")
        schema = StructType.fromJson(manifest["schema"])
        folders = [f for p, f in manifest["parts"].items() if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        data = f"{self.path}/data"
        found = self.spark.read.schema(schema).option("basePath", data).parquet(*[f"{data}/{f}" for f in folders])
        return found.select(schema.names)

    # -- writing ------------------------------------------------------------------------------

    def _segment(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        name = f"{SEGMENT}=s{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/data/{name}")
        return name

    def _folders(self, segment: str, column: str) -> dict[str, str]:
        """Part name to folder of a segment that is partitioned by ``column``."""
        return {n: f"{segment}/{n}" for n in self._names(f"{self.path}/data/{segment}") if n.startswith(f"{column}=")}

    def append(self, df: DataFrame, partition_by: Sequence[str] = (), job: tuple[str, int] | None = None) -> int:
        """Add rows. ``job`` (name, batch number) is remembered: a batch that is repeated adds nothing."""
        base = self.manifest()
        if self._done(base, job):
            return base["version"]
        name = self._segment(df, partition_by)

        def change(now: dict) -> None:
            if self._done(now, job):
                raise Conflict(f"{self.path}: batch {job} was written by another run")
            now["parts"][name] = name
            now["schema"] = now["schema"] or df.schema.jsonValue()
            now["jobs"].update([job] if job else [])

        return self._commit(base, set(), change)

    def replace(self, df: DataFrame, partition_by: Sequence[str] = (), job: tuple[str, int] | None = None) -> int:
        """Put ``df`` in place of all rows; conflicts with anything written meanwhile."""
        base = self.manifest()
        if self._done(base, job):
            return base["version"]
        name = self._segment(df, partition_by)

        def change(now: dict) -> None:
            now.update(parts={name: name}, schema=df.schema.jsonValue(), keyed=None)
            now["jobs"].update([job] if job else [])

        return self._commit(base, None, change)

    def replace_parts(self, df: DataFrame, column: str, job: tuple[str, int] | None = None) -> int:
        """Put the rows of ``df`` in place of those with the same values of ``column``, for all its values at once."""
        base = self.manifest()
        if self._done(base, job):
            return base["version"]
        parts = self._folders(self._segment(df.repartition(column), [column]), column)

        def change(now: dict) -> None:
            now["parts"].update(parts)
            now["schema"] = now["schema"] or df.schema.jsonValue()
            now["jobs"].update([job] if job else [])

        return self._commit(base, set(parts), change)

    def compact(self, partition_by: Sequence[str] = ()) -> int:
        """Write all parts of an appended table as one; rows appended meanwhile stay beside it."""
        base = self.manifest()
        if len(base["parts"]) < 2 or not all(p.startswith(SEGMENT) for p in base["parts"]):
            return base["version"]
        name = self._segment(self._read(base), partition_by)

        def change(now: dict) -> None:
            now["parts"] = {name: name} | {p: f for p, f in now["parts"].items() if p not in base["parts"]}

        return self._commit(base, set(base["parts"]), change)

    def upsert(self, batch: DataFrame, keys: Sequence[str], buckets: int, time_col: str, job: tuple[str, int] | None = None) -> int:
        """Insert new keys, replace known ones by their newest row; only the buckets that the batch touches are written.

        ``keys`` and ``buckets`` are chosen once per table. A bucket without stored rows is the batch's own
        files. A repeated batch changes nothing.
        """
        base = self.manifest()
        if self._done(base, job):
            return base["version"]
        keyed = {"keys": list(keys), "buckets": buckets}
        if base["version"] and base["keyed"] != keyed:
            raise ValueError(f"{self.path} is kept by {base['keyed']}, not {keyed}")
        number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        newest = newest_per_key(batch, keys, time_col).withColumn(BUCKET, number)
        staged = self._segment(newest.repartition(BUCKET), [BUCKET])
        parts = self._folders(staged, BUCKET)
        touched = set(parts)
        stored = touched & base["parts"].keys()
        columns = newest.drop(BUCKET).columns
        if stored:
            old = self._read(base, sorted(stored)).select(columns)
            new = self.spark.read.parquet(f"{self.path}/data/{staged}").where(F.col(BUCKET).isin([int(b.split("=")[1]) for b in stored])).select(columns)
            both = old.unionByName(new).withColumn(BUCKET, number).repartition(BUCKET)
            merged = self._segment(newest_per_key(both, [BUCKET, *keys], time_col), [BUCKET])
            parts.update(self._folders(merged, BUCKET))

        def change(now: dict) -> None:
            now["parts"].update(parts)
            now.update(schema=now["schema"] or newest.drop(BUCKET).schema.jsonValue(), keyed=keyed)
            now["jobs"].update([job] if job else [])

        return self._commit(base, touched, change)

    def clean(self, keep: int = 2, changed_before_ms: int | None = None) -> int:
        """Remove all but the newest ``keep`` versions and the files that none of them names; returns the folders removed.

        Files that no version names may belong to an update that is being written: only those last changed before
        ``changed_before_ms`` (default: the newest kept version's own time) go.
        """
        known = self.versions()
        kept = known[-keep:]
        if not kept:
            return 0
        if changed_before_ms is None:
            changed_before_ms = self._names(f"{self.path}/versions")[f"{kept[-1]:012d}.json"]
        named = {f for v in kept for f in self.manifest(v)["parts"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._file(self._manifest_path(v)), False)
        removed = 0
        for segment, changed in self._names(f"{self.path}/data").items():
            inner = {f.split("/")[1] for f in named if f.startswith(f"{segment}/")}
            if segment in named or changed >= changed_before_ms:
                continue
            parts = [n for n in self._names(f"{self.path}/data/{segment}") if "=" in n]
            gone = [f"{segment}/{n}" for n in parts if n not in inner] if inner else [segment]
            for folder in gone:
                self._fs.delete(self._file(f"{self.path}/data/{folder}"), True)
                removed += 1
        return removed
