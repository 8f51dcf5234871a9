"""A store of immutable packages: contents by digest, files, sources, and one active retrieval record per document.

A put checks everything first, writes what the store lacks to folders of its own and then commits them with one small file
that names them. Readers only see folders that a commit names, so a failed or repeated put leaves the store as it was.
Contents are partitioned by the first two digits of their digest; no package is gathered, however many files it has.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGEST = "^[a-f0-9]{64}$"
TABLES = {
    "objects": "sha256 string, content binary, prefix string",
    "packages": "package_hash string, entrypoint string",
    "files": "package_hash string, path string, sha256 string, bytes long",
    "sources": "package_hash string, source_url string, commit string",
}


class Refused(ValueError):
    """A put that would break the store; nothing of it is stored."""


class PackageStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """The stages that commits name."""
        fs, at = self._fs(), self._path("commits")
        if not fs.exists(at):
            return []
        rows = self.spark.read.schema("stage string").json(f"{self.folder}/commits").distinct().collect()
        return sorted(r["stage"] for r in rows)

    def _commit(self, stage: str) -> None:
        """A rename makes the commit visible as a whole."""
        fs, hidden = self._fs(), self._path(f"commits/.{stage}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps({"stage": stage}).encode() + b"\n"))
        out.close()
        if not fs.rename(hidden, self._path(f"commits/{stage}.json")):
            raise OSError(f"commit {stage} could not be made")

    def table(self, name: str) -> DataFrame:
        """objects, packages, files or sources. Two puts at once may store a row twice; it is read once."""
        stages = self.commits()
        if not stages:
            return self.spark.createDataFrame([], TABLES[name])
        base = f"{self.folder}/{name}"
        df = self.spark.read.schema(TABLES[name]).option("basePath", base).parquet(*[f"{base}/stage={s}" for s in stages]).drop("stage")
        key = {"objects": ["sha256"], "packages": ["package_hash"], "files": ["package_hash", "path"]}.get(name)
        return df.dropDuplicates(key)

    def put(self, packages: DataFrame, files: DataFrame) -> None:
        """Stores packages (package_hash, entrypoint, source_url, commit) with their files (package_hash, path, sha256, content).

        Refused: hashes that are no digests, contents that do not have theirs, a path twice in a package, files without
        package or package without its entry point, and a known package with another entry point or other files. A known
        package only adds its source. Nulls in any column but commit are refused, too.
        """
        files = files.select("package_hash", "path", "sha256", F.col("content").cast("binary").alias("content"))
        names = files.select("package_hash", "path", "sha256", F.octet_length("content").cast("long").alias("bytes"))
        packages = packages.select("package_hash", "entrypoint", "source_url", F.coalesce("commit", F.lit("")).alias("commit"))

        def none(df: DataFrame, fault: str) -> None:
            bad = df.limit(1).collect()
            if bad:
                raise Refused(f"{fault}: {', '.join(str(v)[:80] for v in bad[0].asDict().values())}")

        def valid(column: str):
            return F.coalesce(F.col(column).rlike(DIGEST), F.lit(False))

        none(packages.where(~valid("package_hash") | F.col("entrypoint").isNull() | F.col("source_url").isNull()).select("package_hash"), "no valid package")
        right = valid("package_hash") & F.col("path").isNotNull() & F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
        none(files.where(~right).select("package_hash", "path"), "a content without its digest")
        none(names.groupBy("package_hash", "path").agg(F.countDistinct("sha256").alias("n")).where("n > 1"), "a path with two contents")
        none(names.select("package_hash").join(packages, "package_hash", "left_anti"), "files without package")
        none(packages.groupBy("package_hash").agg(F.countDistinct("entrypoint").alias("n")).where("n > 1"), "a package with two entry points")
        own = packages.select("package_hash", F.col("entrypoint").alias("path")).join(names, ["package_hash", "path"], "left_anti")
        none(own, "a package without its entry point")
        known, old = self.table("packages"), self.table("files")
        clash = packages.join(known.withColumnRenamed("entrypoint", "known"), "package_hash").where("entrypoint <> known")
        none(clash.select("package_hash"), "another package has this hash")
        both = names.join(known.select("package_hash"), "package_hash", "left_semi").select("package_hash", "path", "sha256")
        before = old.join(packages.select("package_hash"), "package_hash", "left_semi").select("package_hash", "path", "sha256")
        changed = both.subtract(before).unionByName(before.subtract(both))
        none(changed.select("package_hash"), "another package has this hash")

        stage = uuid.uuid4().hex
        new = files.join(self.table("objects").select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])
        prefixed = new.select("sha256", "content", F.substring("sha256", 1, 2).alias("prefix"))
        prefixed.write.partitionBy("prefix").parquet(f"{self.folder}/objects/stage={stage}")
        fresh = packages.join(known, "package_hash", "left_anti")
        fresh.select("package_hash", "entrypoint").distinct().write.parquet(f"{self.folder}/packages/stage={stage}")
        names.join(fresh.select("package_hash"), "package_hash", "left_semi").distinct().write.parquet(f"{self.folder}/files/stage={stage}")
        sources = packages.select("package_hash", "source_url", "commit").distinct()
        sources.join(self.table("sources"), ["package_hash", "source_url", "commit"], "left_anti").write.parquet(f"{self.folder}/sources/stage={stage}")
        self._commit(stage)

    def damaged(self) -> DataFrame:
        """(sha256) of stored contents that do not have their digest any more."""
        return self.table("objects").where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def activate_records(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """Retrieval records (doc_id, record_hash, text, active) after new ones: these are active, older ones of the same
    documents are not. A record that is known already is replaced; of two incoming ones with one hash, one stays."""
    new = incoming.dropDuplicates(["record_hash"]).withColumn("active", F.lit(True)).select("doc_id", "record_hash", "text", "active")
    old = records.join(new.select("record_hash"), "record_hash", "left_anti")
    touched = new.select("doc_id").where("doc_id is not null").distinct().withColumn("touched", F.lit(True))
    old = old.join(touched, "doc_id", "left")
    old = old.select("doc_id", "record_hash", "text", (F.col("active") & F.col("touched").isNull()).alias("active"))
    return old.unionByName(new)
