"""Several tables that change together: parts are only added, a manifest for each version says what is read.

A commit writes new parts and lists of deleted keys first and then the manifest of the next version, by a
rename that fails where that version exists. What a commit that broke off has written is in no manifest, so
readers go on with the version before. A deleted key takes away the rows of older parts only: a document that
is put again later is there. ``compact`` writes a table anew without deleted rows.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the version that a rewrite was based on an old one."""


class Tables:
    """Tables under a folder that all executors reach. ``keys`` names the column by which rows of a table are deleted; ``key`` holds for the others."""

    #: Times that appends and deletes are tried on top of another writer's version.
    TRIES = 10

    def __init__(self, spark: SparkSession, root: str, key: str = "document_hash", keys: dict[str, str] | None = None):
        self.spark, self.root, self.key, self.keys = spark, root.rstrip("/"), key, keys or {}
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._fs.Path("/".join(parts))

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        folder = self._path(self.root, "_versions")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{table: {"schema", "parts": [[version, path]], "deletes": [[version, path]]}}"""
        n = self.version() if version is None else version
        if n == 0:
            return {}
        text = self.spark.read.text(f"{self.root}/_versions/{n:012d}.json", wholetext=True).head()
        return json.loads(text[0])

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table at a version, the last one if none is given. KeyError for a table that it has not."""
        entry = self.manifest(version)[name]
        schema, key = StructType.fromJson(entry["schema"]), self.keys.get(name, self.key)
        groups: dict[tuple, list[str]] = {}
        for made, path in entry["parts"]:
            later = tuple(p for at, p in entry["deletes"] if at > made)
            groups.setdefault(later, []).append(path)
        out = []
        for later, paths in groups.items():
            rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])
            if later:
                gone = self.spark.read.schema(f"_gone {schema[key].dataType.simpleString()}").parquet(*[f"{self.root}/{p}" for p in later])
                rows = rows.join(gone, rows[key] == gone["_gone"], "left_anti")
            out.append(rows)
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], schema)

    def commit(self, put: dict[str, DataFrame] | None = None, drop: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, base: int | None = None, split: dict[str, tuple[Column, str]] | None = None) -> int:
        """Add rows, delete keys (the first column of a frame) and replace whole tables, all in one new version; gives its number.

        ``split`` sends what is put into a table to another one where a condition does not hold; both are written in one pass.

        Within one commit deletes go before additions. With ``replace``, or a ``base`` that is given, the commit stands only on that
        version and raises Conflict if there is a later one; others are put on top of what other writers did meanwhile.
        """
        put, drop, replace = put or {}, drop or {}, replace or {}
        at = self.version() if base is None else base
        tag = uuid.uuid4().hex
        written: dict[tuple, tuple[str, StructType]] = {}
        frames: dict[int, str] = {}
        for kind, group in (("put", put), ("replace", replace)):
            for name, df in group.items():
                path = f"{name}/{tag}-{kind}"
                if kind == "put" and name in (split or {}):
                    holds, other = split[name]
                    df.withColumn("_holds", F.coalesce(holds, F.lit(False)).cast("int")).write.partitionBy("_holds").parquet(f"{self.root}/{path}")
                    for to, part in ((name, f"{path}/_holds=1"), (other, f"{path}/_holds=0")):
                        self._files.mkdirs(self._path(self.root, part))  # where no row went there
                        written[kind, to] = part, df.schema
                    continue
                df.write.parquet(f"{self.root}/{path}")
                written[kind, name] = path, df.schema
        for name, df in drop.items():  # one frame for several tables is written once
            if id(df) not in frames:
                frames[id(df)] = f"_deletes/{tag}-{len(frames)}"
                df.select(F.col(df.columns[0]).alias("_gone")).where("_gone is not null").distinct().write.parquet(f"{self.root}/{frames[id(df)]}")
            written["drop", name] = frames[id(df)], df.schema
        for _ in range(self.TRIES):
            manifest = self.manifest(at)
            for (kind, name), (path, schema) in sorted(written.items(), key=lambda w: ("drop", "replace", "put").index(w[0][0])):
                if kind == "drop":
                    if name in manifest:
                        manifest[name]["deletes"].append([at + 1, path])
                    continue
                plain = json.loads(schema.json())
                entry = manifest.setdefault(name, {"schema": plain, "parts": [], "deletes": []})
                if kind == "replace":
                    manifest[name] = entry = {"schema": plain, "parts": [], "deletes": []}
                if [(c["name"], c["type"]) for c in entry["schema"]["fields"]] != [(c["name"], c["type"]) for c in plain["fields"]]:
                    raise ValueError(f"{name} has other columns: {schema.simpleString()}")
                entry["parts"].append([at + 1, path])
            if self._publish(at + 1, manifest):
                return at + 1
            if replace or base is not None:
                raise Conflict(f"version {at + 1} was made by another writer")
            at = self.version()
        raise Conflict(f"{self.TRIES} versions were made by other writers meanwhile")

    def _publish(self, version: int, manifest: dict) -> bool:
        """Write a manifest beside its place and rename it; False if the version exists."""
        target, draft = self._path(self.root, "_versions", f"{version:012d}.json"), self._path(self.root, "_drafts", uuid.uuid4().hex)
        out = self._files.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        self._files.mkdirs(target.getParent())
        context = self._fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(target), none)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" not in str(e):
                raise
            self._files.delete(draft, False)
            return False
        return True

    def compact(self, *names: str) -> int:
        """Write tables anew without deleted rows, as one part each. Conflict if another writer committed meanwhile."""
        at = self.version()
        return self.commit(replace={n: self.read(n, at) for n in names or self.names(at)}, base=at)

    def vacuum(self) -> None:
        """Remove parts that the last version does not read; older versions can no longer be read then, and a commit that is under way would break."""
        n = self.version()
        held = {p for e in self.manifest(n).values() for _, p in [*e["parts"], *e["deletes"]]}
        for folder in self._files.listStatus(self._path(self.root)):
            name = folder.getPath().getName()
            for part in self._files.listStatus(folder.getPath()):
                if name == "_versions" and part.getPath().getName() == f"{n:012d}.json" or f"{name}/{part.getPath().getName()}" in held:
                    continue
                if any(p.startswith(f"{name}/{part.getPath().getName()}/") for p in held):  # written for two tables at once
                    for side in self._files.listStatus(part.getPath()):
                        if side.isDirectory() and f"{name}/{part.getPath().getName()}/{side.getPath().getName()}" not in held:
                            self._files.delete(side.getPath(), True)
                    continue
                self._files.delete(part.getPath(), True)

    def removed(self, name: str, version: int) -> DataFrame:
        """Rows that a version has not any more but the one before had, for a table whose key's rows go together."""
        key = self.keys.get(name, self.key)
        return self.read(name, version - 1).join(self.read(name, version).select(key).distinct(), key, "left_anti")


def upload(tables: Tables, files: DataFrame) -> DataFrame:
    """Take files (path, filename, sha256, curated and more) into the table ``files``, one for each content; gives (path, filename, saved_path, state).

    state: ``saved``, ``duplicate`` of a file that is there or comes first by path, and ``rejected`` for names that do not end in .pdf. saved_path is the
    place of the content: of several, a curated one, then the first by path. Null hashes are rejected too.
    """
    pdf = F.lower("filename").endswith(".pdf") & F.col("sha256").isNotNull()
    known = tables.read("files") if "files" in tables.names() else files.limit(0)
    kept = known.groupBy("sha256").agg(F.min(F.struct((~F.col("curated")).alias("after"), F.col("path").alias("path"))).alias("held"))
    nth = F.row_number().over(Window.partitionBy("sha256").orderBy("path", "filename"))
    rows = files.where(pdf).withColumn("_nth", nth).join(kept, "sha256", "left")
    new = rows.where((F.col("_nth") == 1) & F.col("held").isNull()).select(*files.columns)
    at = tables.version()
    tables.commit(put={"files": new}, base=at)
    first = F.first("path").over(Window.partitionBy("sha256").orderBy("path", "filename"))
    out = rows.select("path", "filename", F.coalesce("held.path", first).alias("saved_path"), F.when((F.col("_nth") == 1) & F.col("held").isNull(), "saved").otherwise("duplicate").alias("state"))
    return out.unionByName(files.where(~F.coalesce(pdf, F.lit(False))).select("path", "filename", F.lit(None).cast("string").alias("saved_path"), F.lit("rejected").alias("state")))


def delete_documents(tables: Tables, hashes: DataFrame) -> tuple[int, DataFrame]:
    """Delete documents by content (the first column of ``hashes``) from every table that has a document_hash, and from ``files`` unless curated.

    All tables change in one version. Gives its number and (document_hash, table, n), the rows that went. A document that no table has is no row.
    """
    at = tables.version()
    known = [n for n in tables.names(at) if n != "files"]
    wanted = hashes.select(F.col(hashes.columns[0]).alias("document_hash")).distinct()
    drop = {n: wanted for n in known if tables.keys.get(n, tables.key) == "document_hash"}
    count = lambda rows, n: rows.groupBy("document_hash").agg(F.count("*").alias("n")).select("document_hash", F.lit(n).alias("table"), "n")
    parts = [count(tables.read(n, at).join(wanted, "document_hash", "left_semi"), n) for n in drop]
    if "files" in tables.names(at):
        own = tables.read("files", at).where(~F.col("curated")).select(F.col("sha256").alias("document_hash"), "path").join(wanted, "document_hash", "left_semi")
        drop["files"] = own.select("path")
        parts.append(count(own, "files"))
    version = tables.commit(drop=drop, base=at)
    return version, reduce(DataFrame.unionByName, parts) if parts else wanted.select("document_hash", F.lit("").alias("table"), F.lit(0).cast("long").alias("n")).limit(0)
