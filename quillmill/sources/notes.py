"""Reading notes from files, and state to and from the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.config import Settings
from quillmill.functions.text import in_folder, is_markdown


def read_notes(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """``path, name, content`` of the Markdown files under ``root``, whole or of the settings' folder.

    Paths are relative to ``root``. A folder scope without a folder holds no file. The scope is a filter on the path, so
    files outside it aren't kept.
    """
    settings = settings or Settings()
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("_uri"), F.col("value").alias("content"))
    )
    full = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = full.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(full).toUri().getPath().rstrip("/")
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("_uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", ""), r"\+", "%2B"))
    rows = files.withColumn("path", F.substring(plain, len(base) + 2, 1 << 20)).filter(is_markdown("path"))
    if settings.knowledge_scope_mode != "wholeVault":
        rows = rows.filter(in_folder("path", settings.knowledge_folder))
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


class Snapshot:
    """Versions of an index under one folder: tables as Parquet, a manifest that names the version in force.

    A version is written to a fresh folder and comes into force with the manifest, so readers never see half of one.
    """

    TABLES = ("chunks", "postings", "embeddings", "files")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict | None:
        """The manifest, or None where there is none or it can't be parsed."""
        fs, p = self._fs(f"{self.root}/manifest.json")
        if not fs.exists(p):
            return None
        try:
            text = "".join(r[0] for r in self.spark.read.text(p.toString(), wholetext=True).collect())
            return json.loads(text)
        except ValueError:
            return None

    def save(self, tables: dict[str, DataFrame], settings: Settings) -> int:
        old = self.manifest()
        version = (old["version"] if old else 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        body = {"version": version, "signature": settings.signature(), "embedding_model": settings.embedding_model, "tables": sorted(tables)}
        fs, p = self._fs(f"{self.root}/manifest.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return version

    def load(self, settings: Settings) -> dict[str, DataFrame] | None:
        """The tables in force; None if they were built with other settings, without vectors if of another model."""
        m = self.manifest()
        if not m or m.get("signature") != settings.signature():
            return None
        names = [n for n in m["tables"] if n != "embeddings" or m.get("embedding_model") == settings.embedding_model]
        return {n: self.spark.read.parquet(f"{self.root}/v{m['version']}/{n}") for n in names}
