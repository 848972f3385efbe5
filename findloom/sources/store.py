"""Runs and tables in versions: written first, then published by one small file.

A version's rows are Parquet in a folder of its own that nobody reads until a manifest names it. A
manifest is made whole under another name and renamed to its place, which fails if the version exists:
of two writers one wins, the other is told. A writer that dies before the rename leaves the old version
readable and its folder complete or not; ``publish`` of the same rows takes a complete one over instead
of writing it again, ``unpublished`` lists what is left.

A run is a table named by its target and time; ``runs`` are read from the manifests alone, so choosing a
baseline opens no data, and a run's rows are read from just its own folder.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom import schema
from findloom.functions.coerce import run_timestamp
from findloom.functions.url import none_if_empty, query_keys, with_target
from findloom.operators import predicates

#: The version of the finding schema, stated in every manifest and payload.
SCHEMA_VERSION = "2.0"
_NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.=-]*")
_MANIFEST = "table string, version long, path string, digest string, rows long, schema string, schema_version string, target_slug string, run_ts string"


class Conflict(Exception):
    """Another writer has published the version first, or the table isn't at the expected one."""


class RunStore:
    """Versioned tables and runs below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._at(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _folders(self, path: str) -> list[str]:
        at = self._at(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _text(self, path: str) -> str:
        reader = self.spark._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._at(path))
        try:
            return reader.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str, replace: bool = False) -> None:
        """The file whole at its place, or not at all."""
        aside = self._at(f"{self.root}/_aside/{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        to = self._at(path)
        self._fs.mkdirs(to.getParent())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(to), how)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"{path} is there already") from e
            raise

    def versions(self, table: str) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(n[1:-5]) for n in self._folders(f"{self.root}/manifests/{table}") if re.fullmatch(r"v[0-9]{12}\.json", n))

    def manifest(self, table: str, version: int | None = None) -> dict | None:
        """What a version's manifest says; of the newest if none is named; None if there is none."""
        known = self.versions(table)
        if not known or (version is not None and version not in known):
            return None
        return json.loads(self._text(f"{self.root}/manifests/{table}/v{known[-1] if version is None else version:012d}.json"))

    def stage(self, table: str, rows: DataFrame, digest: str | None = None) -> tuple[str, str]:
        """Write ``rows`` where nobody reads them yet; (path, digest). A complete folder of the same digest is taken over.

        ``digest`` names the content; without one the rows are written anew.
        """
        if not _NAME.fullmatch(table):
            raise ValueError(f"no name for a table: {table!r}")
        digest = digest or uuid.uuid4().hex
        for name in self._folders(f"{self.root}/data/{table}"):
            if name.startswith(f"{digest}-") and self._fs.exists(self._at(f"{self.root}/data/{table}/{name}/_SUCCESS")):
                return f"{self.root}/data/{table}/{name}", digest
        path = f"{self.root}/data/{table}/{digest}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        return path, digest

    def publish(self, table: str, rows: DataFrame, digest: str | None = None, expect: int | None = None, run: tuple[str, str] | None = None) -> int:
        """Write ``rows`` as the next version of ``table``; the version.

        ``expect`` is the version that the rows were made from (0: none); ``Conflict`` if it is not the
        newest any more, so that no writer's rows are lost. A version that says the same digest as the
        newest is not published twice.
        """
        newest = self.manifest(table)
        at = newest["version"] if newest else 0
        if expect is not None and expect != at:
            raise Conflict(f"{table} is at version {at}, not {expect}")
        if newest and digest and newest["digest"] == digest:
            return at
        path, digest = self.stage(table, rows, digest)
        written = self.spark.read.parquet(path)
        slug, ts = run or (None, None)
        entry = {"table": table, "version": at + 1, "path": path.removeprefix(f"{self.root}/"), "digest": digest, "rows": written.count(), "schema": written.schema.json(), "schema_version": SCHEMA_VERSION, "target_slug": slug, "run_ts": ts}
        self._put(f"{self.root}/manifests/{table}/v{at + 1:012d}.json", json.dumps(entry))
        return at + 1

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A version's rows, of the newest if none is named; None if it isn't there."""
        entry = self.manifest(table, version)
        if entry is None:
            return None
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/{entry['path']}")

    def unpublished(self, table: str) -> list[str]:
        """Folders of the table's data that no manifest names."""
        named = {self.manifest(table, v)["path"] for v in self.versions(table)}
        return [p for p in (f"data/{table}/{n}" for n in self._folders(f"{self.root}/data/{table}")) if p not in named]

    def save_run(self, findings: DataFrame, slug: str, run_ts: str, digest: str | None = None) -> int:
        """Validate, write and publish a run, then point the target's ``latest`` at it if none newer is known."""
        predicates.assert_valid(findings)
        version = self.publish(f"run={slug}={run_ts}", findings, digest, run=(slug, run_ts))
        last = self.latest(slug)
        if last is None or last <= run_ts:
            self._put(f"{self.root}/latest/{slug}.json", json.dumps({"target_slug": slug, "run_ts": run_ts}), replace=True)
        return version

    def latest(self, slug: str) -> str | None:
        """The time of the run that the target's pointer names."""
        path = f"{self.root}/latest/{slug}.json"
        return json.loads(self._text(path))["run_ts"] if self._fs.exists(self._at(path)) else None

    def runs(self, slug: str, exclude: str | None = None) -> DataFrame:
        """(run_ts, version, rows, table) of a target's published runs with a valid time, newest first; ``exclude`` is the current one's time."""
        if not any(n.startswith(f"run={slug}=") for n in self._folders(f"{self.root}/manifests")):
            return self.spark.createDataFrame([], "run_ts string, version long, rows long, table string")
        entries = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifests/run={slug}=*/")
        newest = entries.filter((F.col("target_slug") == slug) & run_timestamp(F.col("run_ts")).isNotNull() & ~F.col("run_ts").eqNullSafe(F.lit(exclude))).groupBy("run_ts").agg(F.max_by(F.struct("version", "rows", "table"), "version").alias("m"))
        return newest.select("run_ts", "m.*").orderBy(F.desc("run_ts"))

    def read_run(self, slug: str, run_ts: str) -> DataFrame | None:
        return self.read(f"run={slug}={run_ts}")


def upgraded(findings: DataFrame) -> DataFrame:
    """Findings of older schema versions with what their asset id says: host, scheme, port, path and query keys where missing.

    Each field is filled on its own and none is overwritten; findings without an asset id stay.
    ``meta.parameter`` is never filled: which parameter was tested can't be told from an address.
    """
    staged, t = with_target(findings, F.coalesce("asset_id", F.lit("")))
    m = F.col("meta")
    fill = {"host": F.coalesce(none_if_empty(m["host"]), t["host"]), "scheme": F.coalesce(none_if_empty(m["scheme"]), t["scheme"]), "port": F.coalesce(m["port"], t["port"]), "path": F.coalesce(none_if_empty(m["path"]), t["path"]), "query_keys": F.coalesce(m["query_keys"], query_keys(t["query"]))}
    known = F.coalesce(F.trim("asset_id"), F.lit("")) != ""
    meta = F.struct(*[F.when(known, fill[f.name]).otherwise(m[f.name]).cast(f.dataType).alias(f.name) if f.name in fill else m[f.name].alias(f.name) for f in schema.META.fields])
    return staged.withColumn("meta", meta).select(*findings.columns)


#: Fields that say something of a whole result, beside its findings.
_RESULT = "struct<schema_version:string, target:string, run_folder:string, scan_date:string>"


def read_results(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, schema_version, target, finding, extra) of the findings in result files of any version, in one scan.

    A file is one JSON object. Findings of files that don't say ``SCHEMA_VERSION`` are ``upgraded``; what
    the schema doesn't know of a finding or its metadata is kept in ``extra``, a variant of the two.
    Files that are no JSON objects have no rows. ``pos`` is a finding's place in its file.
    """
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"), F.col("value").alias("raw"))
    head = files.select("file", "v", F.from_json("raw", _RESULT).alias("head"))
    each = head.lateralJoin(spark.tvf.variant_explode(F.try_variant_get("v", "$.all_findings", "variant").outer()).alias("e")).filter("e.pos IS NOT NULL AND e.key IS NULL")
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    unknown = lambda v, kind: F.to_variant_object(F.map_filter(fields(v), lambda k, _: ~k.isin([f.name for f in kind.fields])))
    rows = each.select("file", F.col("e.pos").alias("pos"), F.col("head.schema_version").alias("schema_version"), F.col("head.target").alias("target"), F.from_json(F.to_json("e.value"), schema.FINDING).alias("f"), F.to_variant_object(F.struct(unknown(F.col("e.value"), schema.FINDING).alias("finding"), unknown(F.try_variant_get("e.value", "$.meta", "variant"), schema.META).alias("meta"))).alias("extra"))
    flat = rows.select("file", "pos", "schema_version", "target", "extra", "f.*")
    has_meta = F.struct(*[F.col(f"meta.{f.name}").alias(f.name) for f in schema.META.fields])
    flat = flat.withColumn("meta", has_meta)
    old = ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))
    filled = upgraded(flat.withColumn("_old", old))
    return flat.filter(~old).unionByName(filled.filter("_old").drop("_old"))


def baseline_files(runs: DataFrame, legacy: DataFrame, current: str | None) -> DataFrame:
    """(path, place) of the files to compare with, in the order to try them.

    ``runs(run_ts, name, path)`` has the artifacts of a target's runs: of each run but ``current`` (its
    time) the normalised one, else the raw one, newest run first. Then ``legacy(path, modified)``, newest
    first. A path is taken once. The list is as long as a target's history.
    """
    order = F.when(F.col("name") == "normalized.json", 0).when(F.col("name") == "scan_results.json", 1)
    good = runs.filter(order.isNotNull() & run_timestamp(F.col("run_ts")).isNotNull() & ~F.col("run_ts").eqNullSafe(F.lit(current)))
    own = good.groupBy("run_ts").agg(F.min_by("path", order).alias("path")).select("path", F.lit(0).alias("kind"), F.col("run_ts").alias("at"))
    old = legacy.select("path", F.lit(1).alias("kind"), F.date_format("modified", "yyyyMMdd_HHmmss.SSSSSS").alias("at"))
    first = own.unionByName(old).groupBy("path").agg(F.min_by(F.struct("kind", "at"), F.col("kind")).alias("x"))
    return first.select("path", F.row_number().over(Window.orderBy("x.kind", F.desc("x.at"), "path")).alias("place"))
