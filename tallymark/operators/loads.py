"""Loading published files as one step: staged, then published by one rename, so that readers see all of a load or nothing.

A store is a folder. Its tables lie in folders of the runs that wrote them; a manifest names the folders that make up each
table now, and the manifest of the highest number counts. A load writes only what it adds to companies, aliases and
domains, and the facts of its own source; other sources' facts are not touched.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize
from ..sources import registry
from . import facts, store

SCHEMAS = {
    "companies": "company_id long, canonical_name string, normalized_name string, country string",
    "aliases": "company_id long, alias string, normalized_alias string, source string",
    "domains": "company_id long, domain string",
    "facts": "company_id long, country string, year int, metric string, value decimal(24,2), source_id string, published_date date",
}
RUN = "run_id string, source_id string, status string, rows_ingested long, published_date date, at timestamp, notes string"


class CompanyStore:
    """Companies, aliases, domains and facts under a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.root, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _put(self, text: str, *parts: str) -> None:
        """Writes a small file beside its place and renames it there; a file that is there already is an error."""
        half = self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        out = self._fs.create(half, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._path(*parts)) or not self._fs.rename(half, self._path(*parts)):
            self._fs.delete(half, False)
            raise RuntimeError(f"{'/'.join(parts)} was written by another load meanwhile; this one is not published")

    def manifest(self) -> dict:
        """The folders that make up each table: lists, and for facts one of each source."""
        versions = [n for n in self._names("manifests") if not n.startswith(".")]
        if not versions:
            return {"version": 0, "companies": [], "aliases": [], "domains": [], "facts": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{versions[-1]}").collect()))

    def table(self, name: str, manifest: dict | None = None, source_id: str | None = None) -> DataFrame:
        """A table as of a manifest, the latest by default; facts of one source if it is given."""
        folders = (manifest or self.manifest())[name]
        if isinstance(folders, dict):
            folders = [f for k, f in folders.items() if source_id in (None, k)]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def runs(self) -> DataFrame:
        """A row for each run: `running` until it ended, then `success` or `failed` with what went wrong."""
        if not self._names("runs"):
            return self.spark.createDataFrame([], RUN)
        rank = F.when(F.col("status") == "running", 0).otherwise(1)
        rest = [c.split()[0] for c in RUN.split(", ")[1:]]
        told = self.spark.read.schema(RUN).json(f"{self.root}/runs")
        return told.groupBy("run_id").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("run_id", "r.*")

    def _tell(self, run: str, source_id: str, status: str, **more) -> None:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        self._put(json.dumps({"run_id": run, "source_id": source_id, "status": status, "at": now, **more}), "runs", f"{run}-{status}.json")

    def load(self, records: DataFrame, source_id: str) -> int:
        """Loads the facts of one published file; gives the number of fact rows it wrote.

        records: company_name, country, year, metric, value, published_date, and as they come seq, aliases, domains. Rows
        of one company, year and metric are summed; they take the place of what an earlier file said for that key. A
        failed load leaves a `failed` run and the tables as they were, and the same file twice changes nothing.
        """
        registry.source(source_id)
        run = uuid.uuid4().hex
        self._tell(run, source_id, "running")
        try:
            rows, published = self._load(records, source_id, run)
        except Exception as error:
            self._tell(run, source_id, "failed", rows_ingested=0, notes=str(error)[:2000])
            raise
        self._tell(run, source_id, "success", rows_ingested=rows, published_date=published and str(published))
        return rows

    def _load(self, records: DataFrame, source_id: str, run: str) -> tuple[int, datetime.date | None]:
        now = self.manifest()
        none = F.array().cast("array<string>")
        records = store.in_order(records).withColumn("source_id", F.lit(source_id))
        for column in ("aliases", "domains"):
            records = records.withColumn(column, F.coalesce(column, none) if column in records.columns else none)
        kept = self._write(records, run, "records")  # the file is read once; what follows reads this
        held = self.table("companies", now)
        fresh = self._write(store.upsert_companies(held, kept).join(held.select("company_id"), "company_id", "left_anti"), run, "companies")
        companies = held.unionByName(fresh)
        self._write(store.new_aliases(kept, companies, self.table("aliases", now)), run, "aliases")
        self._write(store.new_domains(kept, companies, self.table("domains", now)), run, "domains")
        columns = [c.split()[0] for c in SCHEMAS["facts"].split(", ")]
        told = store.with_ids(kept, companies).select(*columns)
        self._write(facts.upsert(self.table("facts", now, source_id), told).select(*columns), run, "facts")
        place = {name: f"data/{run}/{name}" for name in SCHEMAS}
        after = {k: [*now[k], place[k]] for k in ("companies", "aliases", "domains")} | {"facts": now["facts"] | {source_id: place["facts"]}}
        rows, published = told.select(*facts.KEY).distinct().count(), kept.agg(F.max("published_date")).first()[0]
        self._put(json.dumps(after | {"version": now["version"] + 1}), "manifests", f"{now['version'] + 1:010d}.json")
        return rows, published

    def _write(self, df: DataFrame, run: str, name: str) -> DataFrame:
        path = f"{self.root}/data/{run}/{name}"
        if name in SCHEMAS:
            kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
            df = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def seed_aliases(self, pairs: DataFrame) -> tuple[int, DataFrame]:
        """Adds curated (canonical_name, alias, country); gives the number of those with a company, and those without one."""
        now, run = self.manifest(), uuid.uuid4().hex
        named = pairs.withColumn("normalized_name", normalize(F.col("canonical_name")))
        companies = self.table("companies", now).select("company_id", "normalized_name", "country")
        found = named.join(companies, ["normalized_name", "country"])
        missing = named.join(companies, ["normalized_name", "country"], "left_anti").select("canonical_name", "alias", "country")
        fresh = store.seeded(pairs, self.table("companies", now), self.table("aliases", now))
        self._write(fresh, run, "aliases")
        n = found.count()
        self._put(json.dumps(now | {"aliases": [*now["aliases"], f"data/{run}/aliases"], "version": now["version"] + 1}), "manifests", f"{now['version'] + 1:010d}.json")
        return n, missing
