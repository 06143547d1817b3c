"""Study files: front matter, sections, Markdown tables, action lists, field records, and which file is current."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions.text import ids_in_cell
from tidewrack.operators.graph import cut_lineage

DELIMITERS = (",", ";", "\t", "|")
#: An action list is known by these columns.
KNOWN_COLUMNS = ("id", "action", "libelle", "gain", "effort", "horizon", "score")
RENAMES = {"action": "libelle", "delai_realisation": "delai_realisation_jours", "delai_effet_mesurable": "delai_effet_mesurable_jours"}
#: Ratings of a field metric, in the order of its histogram.
RATINGS = ("good", "needs-improvement", "poor")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def front_matter(text: Column) -> Column:
    """The `key: value` lines between the two rulers as a map; comments are skipped, and any other line is an error."""
    body = F.regexp_extract(text, r"(?s)\A﻿?---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    checked = F.transform(lines, lambda x: F.when(x.rlike(r"^[A-Za-z_][\w-]*\s*:"), x).otherwise(F.raise_error(F.concat(F.lit("not a front-matter line: "), x)).cast("string")))
    pairs = F.transform(checked, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)\s*:", 1).alias("key"), F.regexp_extract(x, r"^[\w-]+\s*:\s*(.*)$", 1).alias("value")))
    return F.map_from_entries(pairs)


def section(text: Column, title: str) -> Column:
    """What stands under a level-two heading, without comments; null if the heading is absent or nothing stands there."""
    body = F.regexp_extract(text, rf"(?s)(?:\A|\n)##[ \t]+{title}[^\n]*\n(.*?)(?=\n##[ \t]|\z)", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"^\s+|\s+$", "")), F.lit(""))


def table_rows(texts: DataFrame, text: str, cells: int) -> DataFrame:
    """(..., line, section, cells): rows of Markdown tables of one width, under the numbered heading last seen, with the other
    columns of their text (a path, say).

    A numbered row of another width is an error. One file at a time is ordered by line; texts alike in all columns are one."""
    kept = [c for c in texts.columns if c != text]
    names = texts.withColumn("_file", F.xxhash64(*kept, text)).dropDuplicates([*kept, text])
    lines = names.select("_file", *kept, F.posexplode(F.split(text, r"\r?\n")).alias("line", "value"))
    w = Window.partitionBy("_file", *kept).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.nullif(F.regexp_extract("value", r"^##\s+\d{1,2}\.\s+(.+?)\s*(?:—|--).*$", 1), F.lit(""))
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where(F.col("value").rlike(r"^\|\s*\d{1,2}\s*\|"))
    own = F.transform(F.split(F.regexp_replace("value", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    own = F.when(F.size(own) == cells, own).otherwise(F.raise_error(F.concat(F.lit("a row is not of the table's width: "), "value")).cast("array<string>"))
    return rows.select(*kept, "line", "section", own.alias("cells"))


def sniff(header: str) -> str:
    """The delimiter under which a header line names known columns."""
    header = header.lstrip("﻿")
    for d in DELIMITERS:
        if {c.strip().strip('"') for c in header.split(d)} & set(KNOWN_COLUMNS) and (d in header or len(header.split()) == 1):
            return d
    raise ValueError("no delimiter gives a known column")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """An action list whose delimiter is found from its header; node_ids are the numbers of its node cell."""
    first = spark.read.text(path).limit(1).first()
    d = sniff(first["value"] if first else "")
    rows = spark.read.csv(path, sep=d, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    return rows.withColumn("node_ids", ids_in_cell(F.col("noeuds_couverts"))) if "noeuds_couverts" in rows.columns else rows


def csv_records(text: Column) -> Column:
    """The records of a CSV text: lines, where a line break between quotes ends none; empty lines are left out."""
    found = F.regexp_extract_all(F.regexp_replace(text, "^\ufeff", ""), F.lit(r'((?:[^"\r\n]++|"[^"]*+"?)+)'), 1)
    return F.filter(found, lambda r: F.trim(r) != "")


def csv_cells(record: Column, delimiter: str) -> Column:
    """The cells of a record; quotes around a cell go, and two quotes within one are one."""
    d = {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)
    parts = F.regexp_extract_all(record, F.lit(rf'(?:^|(?<={d}))((?:"[^"]*+"?|[^"{d}]++)*+)(?={d}|\z)'), 1)
    return F.transform(parts, lambda c: F.when(F.trim(c).startswith('"'), F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(c)))


def dialect(text: Column) -> Column:
    """The first delimiter under which a CSV text's header names a known column; null for none."""
    header = F.get(csv_records(text), 0)
    fits = lambda d: F.arrays_overlap(csv_cells(header, d), F.array(*map(F.lit, KNOWN_COLUMNS)))
    return F.coalesce(*[F.when(fits(d), F.lit(d)) for d in DELIMITERS])


def read_action_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, delimiter, line, cells map) of every action list below a folder, each with a delimiter of its own.

    A file without one that gives a known column is refused by its name; a record of another width than its header too."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    known = files.withColumn("delimiter", dialect(F.col("text")))
    refused = F.raise_error(F.concat(F.lit("no delimiter gives a known column: "), "path")).cast("string")
    known = known.withColumn("delimiter", F.coalesce("delimiter", refused))
    cells = lambda r: F.coalesce(*[F.when(F.col("delimiter") == d, csv_cells(r, d)) for d in DELIMITERS])
    rows = known.select("path", "delimiter", cells(F.get(csv_records(F.col("text")), 0)).alias("header"), F.posexplode(F.slice(csv_records(F.col("text")), 2, 1 << 30)).alias("line", "record"))
    rows = rows.select("path", "delimiter", (F.col("line") + 1).alias("line"), "header", cells(F.col("record")).alias("values"))
    odd = F.raise_error(F.concat(F.lit("a record is not as wide as its header: "), "path", F.lit(" "), F.col("line").cast("string"))).cast("array<string>")
    whole = F.when(F.size("values") == F.size("header"), F.col("values")).otherwise(odd)
    return rows.select("path", "delimiter", "line", F.map_from_arrays("header", whole).alias("cells"))


def as_snapshot_actions(actions: DataFrame) -> DataFrame:
    """The list's columns under the names that a snapshot uses."""
    return actions.withColumnsRenamed(RENAMES)


FIELD_SCHEMA = "struct<record: struct<key: map<string, string>, metrics: map<string, struct<histogram: array<struct<start: string, end: string, density: double>>, percentiles: struct<p75: string>>>>>"


def field_metrics(records: DataFrame, body: str = "body") -> DataFrame:
    """(metric, p75, p75_number, good, needs_improvement, poor) of each record; ratings go by place, no threshold is applied.

    An error body has no record and so no row."""
    parsed = records.withColumn("_r", F.from_json(F.col(body), FIELD_SCHEMA))
    rows = parsed.select(*records.drop(body).columns, F.explode("_r.record.metrics").alias("metric", "m"))
    share = lambda i: F.get(F.col("m.histogram"), i)["density"]
    return rows.select(*records.drop(body).columns, "metric", F.col("m.percentiles.p75").alias("p75"), F.col("m.percentiles.p75").try_cast("double").alias("p75_number"), *[share(i).alias(r.replace("-", "_")) for i, r in enumerate(RATINGS)])


def usable_field_data(records: DataFrame, body: str = "body") -> bool:
    """Whether any record has a metric."""
    return not field_metrics(records, body).isEmpty()


def discover(files: DataFrame, name_rule: str, excluded: tuple[str, ...] = (), depth: int = 12) -> DataFrame:
    """(path, name, copies): files whose name meets a rule, outside some folders and no deeper than `depth`, with how many share the name."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("name", name).where(F.col("name").rlike(name_rule) & (F.size(F.split("path", "/")) <= depth + 1))
    for folder in excluded:
        rows = rows.where(~F.contains("path", F.lit(f"/{folder}/")))
    copies = rows.groupBy(F.col("name").alias("_n")).agg(F.count("*").alias("copies"))  # one name may be that of most files
    return rows.select("path", "name").join(copies, F.col("name") == F.col("_n")).select("path", "name", "copies")


def _listed(root: str):
    """Lists folders given by their paths below the root, in a task."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        base = base.rstrip("/")
        for batch in batches:
            found = []
            for folder in batch.column(0).to_pylist():
                for i in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    found.append((i.path[len(base) + 1 :], i.is_file, i.size if i.is_file else None))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int64()))], ["path", "is_file", "bytes"])

    return run


def scan(spark: SparkSession, root: str, name_rule: str, excluded: tuple[str, ...] = (), depth: int = 12) -> DataFrame:
    """(path, name, bytes, copies): the files below a folder whose name meets a rule; paths are relative to it.

    A level of folders is listed by tasks, and its folders but the excluded ones are the next level, `depth` levels at most: what an
    excluded folder holds is never listed."""
    level, files = spark.createDataFrame([("",)], "path string"), None
    for _ in range(depth):
        found = cut_lineage(level.repartition("path").mapInArrow(_listed(root), "path string, is_file boolean, bytes long"))
        own = found.where("is_file").select("path", "bytes")
        files = own if files is None else files.unionByName(own)
        name = F.element_at(F.split("path", "/"), -1)
        level = found.where("not is_file").where(~name.isin(*excluded)).select("path")
        if level.isEmpty():
            break
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").rlike(name_rule))
    copies = named.groupBy(F.col("name").alias("_n")).agg(F.count("*").alias("copies"))
    return named.join(copies, F.col("name") == F.col("_n")).select("path", "name", "bytes", "copies")


def evolution_registry(spark: SparkSession, path: str) -> DataFrame:
    """Evolutions of a grid: (de, vers, date, motif, correspondances map, identifiants_retires, identifiants_nouveaux)."""
    schema = "version_courante string, evolutions array<struct<de: string, vers: string, date: string, motif: string, correspondances: map<string, int>, identifiants_retires: array<int>, identifiants_nouveaux: array<int>>>"
    return spark.read.json(path, schema=schema, multiLine=True).select(F.explode("evolutions").alias("e")).select("e.*")
