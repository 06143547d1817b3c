"""Tables that keep their versions, and files that are written again only where nobody touched them.

A version is a folder of Parquet files and an entry of a log. Rows are written to a folder that no entry names, read
back and compared both ways; then the entry is created under the next number. The creation is the commit: it fails where the
number is taken, so of two writers that saw the same state one is refused, and what an aborted one wrote is never read.

Versions of a day have letters, a to z, and content like that of the latest version makes no new one: content is
compared by a digest that Spark computes from the hashes of all rows, whatever their order."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import snapshot
from tidewrack.operators.sinks import next_version


class Conflict(ValueError):
    """Another writer has committed since the state was read."""


@dataclass(frozen=True)
class Entry:
    number: int
    name: str
    digest: str
    folder: str
    rows: int


def digest(df: DataFrame) -> tuple[str, int]:
    """A digest of the columns' names and of all rows, in any order, and the number of rows. One row comes to the driver."""
    names = sorted(df.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    hashes = df.select(F.xxhash64(F.to_json(row, {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), F.to_json(row, {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("b"))
    sums = hashes.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).first()
    text = F.sha2(F.lit(f"{names} {sums['a']} {sums['b']} {sums['n']}").cast("binary"), 256)
    return df.sparkSession.range(1).select(text).first()[0], sums["n"]


class Versions:
    """A table with a log of its versions, below a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def log(self) -> list[Entry]:
        """The entries in order. A log has one small file for each version."""
        fs, folder = self._at("log")
        if not fs.exists(folder):
            return []
        rows = self.spark.read.schema("number int, name string, digest string, folder string, rows long").json(f"{self.root}/log").where("number is not null")
        return sorted((Entry(**r.asDict()) for r in rows.collect()), key=lambda e: e.number)

    def read(self, name: str | None = None) -> DataFrame | None:
        """The rows of a version, or of the latest; null if there is none."""
        entries = [e for e in self.log() if name is None or e.name == name]
        return self.spark.read.parquet(f"{self.root}/{entries[-1].folder}") if entries else None

    def stage(self, df: DataFrame) -> str:
        """Writes rows where no entry names them, reads them back, and refuses if any differs."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        back = self.spark.read.parquet(f"{self.root}/{folder}")
        if not (back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()):
            raise ValueError("what was read back differs from what was written")
        return folder

    def commit(self, entry: Entry) -> None:
        fs, folder = self._at("log")
        fs.mkdirs(folder)
        fs, place = self._at(f"log/{entry.number:08d}.json")
        try:
            out = fs.create(place, False)  # fails if it is there
        except Exception as e:
            if fs.exists(place):
                raise Conflict(f"version {entry.number} was written meanwhile") from e
            raise
        try:
            out.write(bytearray(json.dumps(asdict(entry)).encode()))
        finally:
            out.close()

    def publish(self, df: DataFrame, day: str, seen: int | None = None) -> Entry | None:
        """Adds a version; none if the latest has the same content. seen: the number of the version that df was made from."""
        entries = self.log()
        last = entries[-1] if entries else None
        if seen is not None and seen != (last.number if last else 0):
            raise Conflict(f"version {last.number if last else 0} is the latest, not {seen}")
        own, rows = digest(df)
        if last and last.digest == own:
            return None
        name = next_version([e.name for e in entries], day, own, {e.name: e.digest for e in entries})
        if name is None:
            return None
        entry = Entry((last.number if last else 0) + 1, name, own, self.stage(df), rows)
        self.commit(entry)
        return entry

    def leftovers(self) -> list[str]:
        """Folders of rows that no entry names: of aborted writers, or of one that is at work."""
        fs, folder = self._at("data")
        known = {e.folder for e in self.log()}
        return sorted(f"data/{s.getPath().getName()}" for s in (fs.listStatus(folder) if fs.exists(folder) else []) if f"data/{s.getPath().getName()}" not in known)


def content_digest(content: str = "content"):
    return F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)


class Files:
    """(path, content) rows that people may edit, with the digest of what was last written to each."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = Versions(spark, root)
        self.spark = spark

    def state(self) -> tuple[DataFrame, int]:
        """(path, content, written) and the number of the version."""
        entries = self.table.log()
        rows = self.table.read()
        return (rows if rows is not None else self.spark.createDataFrame([], "path string, content string, written string")), entries[-1].number if entries else 0

    def plan(self, wanted: DataFrame, force: bool = False) -> DataFrame:
        """(path, plan) of a write of (path, content): create, same, replace or keep."""
        rows, _ = self.state()
        registry = rows.select("path", "written", content_digest().alias("current"))
        return snapshot.fingerprint_plan(wanted.select("path", content_digest().alias("new")), registry, "path", "new", force).select("path", "plan")

    def write(self, wanted: DataFrame, day: str, force: bool = False) -> DataFrame:
        """Carries a plan out, and gives (path, plan). A rerun with the same rows finds them all the same and writes nothing."""
        rows, number = self.state()
        new = wanted.select(F.col("path").alias("to"), F.col("content").alias("text"), content_digest().alias("new"))
        plan = self.plan(wanted, force).select(F.col("path").alias("of"), "plan")
        met = rows.join(new, F.col("path") == F.col("to"), "full").withColumn("at", F.coalesce("path", "to")).join(plan, F.col("at") == F.col("of"), "left")
        put = F.coalesce(F.col("plan").isin("create", "replace"), F.lit(False))
        after = met.select(F.col("at").alias("path"), F.when(put, F.col("text")).otherwise(F.col("content")).alias("content"), F.when(put, F.col("new")).otherwise(F.col("written")).alias("written"))
        done = snapshot.cut_lineage(self.plan(wanted, force))  # of the state before
        self.table.publish(after, day, seen=number)
        return done

    def edit(self, changed: DataFrame, day: str) -> None:
        """What somebody else wrote: contents change, and what was last written here stays on record."""
        rows, number = self.state()
        new = changed.select(F.col("path").alias("to"), F.col("content").alias("text"))
        met = rows.join(new, F.col("path") == F.col("to"), "left")
        self.table.publish(met.select("path", F.when(F.col("to").isNotNull(), F.col("text")).otherwise(F.col("content")).alias("content"), "written"), day, seen=number)
