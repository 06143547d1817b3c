"""Sheets of a study against the grid of nodes: completeness, carry-over, scope by model, readings of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import enumeration
from tidewrack.operators.snapshot import STATES

#: Acquisition models.
MODELS = ("b2b-lead-gen", "e-commerce", "local", "media-affiliation", "saas")


def with_sheets(nodes: DataFrame, sheets: DataFrame, key: str = "chemin") -> DataFrame:
    """Nodes that have a sheet; where both name a field, the sheet's value counts, except for the id."""
    both = [c for c in sheets.columns if c in nodes.columns and c not in (key, "id")]
    n, s = nodes.alias("n"), sheets.alias("s")
    only = [F.col(f"n.{c}") for c in nodes.columns if c not in both]
    return n.join(s, key).select(*[F.col(key) if str(c) == key else c for c in only if c is not None], *[F.coalesce(f"s.{c}", f"n.{c}").alias(c) for c in both], *[F.col(f"s.{c}") for c in sheets.columns if c not in nodes.columns])


def require_all(nodes: DataFrame, sheets: DataFrame, key: str = "chemin") -> DataFrame:
    """The same, but an error names nodes without a sheet."""
    absent = [r[0] for r in nodes.join(sheets, key, "left_anti").select(key).limit(20).collect()]
    if absent:
        raise ValueError(f"no sheet for {absent}")
    return with_sheets(nodes, sheets, key)


def carry_over(nodes: DataFrame, earlier: DataFrame, moves: DataFrame | None = None, fields: tuple[str, ...] = ("constat", "verdict")) -> DataFrame:
    """Adds earlier findings to nodes, by branch and node name in any case and never by id.

    moves: (branche, noeud, old_branche, old_noeud), declared renames, which come before equal names."""
    low = lambda c: F.lower(F.trim(c))
    old = earlier.select(low(F.col("branche")).alias("_b"), low(F.col("noeud")).alias("_n"), *[F.col(f).alias(f"_{f}") for f in fields])
    here = nodes.withColumn("_hb", low(F.col("branche"))).withColumn("_hn", low(F.col("noeud")))
    if moves is not None:
        m = moves.select(low(F.col("branche")).alias("_hb"), low(F.col("noeud")).alias("_hn"), low(F.col("old_branche")).alias("_ob"), low(F.col("old_noeud")).alias("_on"))
        here = here.join(m, ["_hb", "_hn"], "left").withColumn("_hb", F.coalesce("_ob", "_hb")).withColumn("_hn", F.coalesce("_on", "_hn")).drop("_ob", "_on")
    met = here.join(old, (F.col("_hb") == F.col("_b")) & (F.col("_hn") == F.col("_n")), "left")
    return met.select(*nodes.columns, *[F.col(f"_{f}").alias(f) for f in fields])


def models_of(nodes: DataFrame, scopes: DataFrame, key: str = "id") -> DataFrame:
    """Adds `modeles`: the models of the id range a node lies in, or all models where no range names it. scopes: (lo, hi, modeles)."""
    spelt = scopes.withColumn(key, F.explode(F.sequence("lo", "hi"))).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("modeles")))).alias("modeles"))
    return nodes.join(spelt, key, "left").withColumn("modeles", F.coalesce("modeles", F.array(*map(F.lit, MODELS))))


def in_model(models: Column, model: str) -> Column:
    return F.array_contains(models, model)


def node_projection(nodes: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """(body): each node as JSON in which an optional field without a value is left out, not null."""
    for c in [c for c in required if c not in nodes.columns]:
        nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    present = [c for c in optional if c in nodes.columns]
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return nodes.select(F.to_json(F.struct(*required, *present), {"ignoreNullFields": "true"}).alias("body"), missing.alias("missing"))


def states_by(nodes: DataFrame, group: str, state: str = "etat") -> DataFrame:
    """A row for each group, a column for each known state."""
    rows = nodes.withColumn("_s", F.coalesce(state, F.lit(STATES[0])))
    return rows.groupBy(group).agg(*[F.count_if(F.col("_s") == s).alias(s.replace("-", "_")) for s in STATES], F.count("*").alias("total"))


def reading(text: Column) -> Column:
    """What a semicolon list says in numbers: how many items, the sum of their first numbers, the least and greatest last number; null for no list."""
    items = enumeration(text)
    numbers = F.transform(items, lambda i: F.transform(F.regexp_extract_all(i, F.lit(r"(\d+(?:[.,]\d+)?)"), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")))
    with_number = F.filter(numbers, lambda n: F.size(n) > 0)
    first, last = F.transform(with_number, lambda n: F.element_at(n, 1)), F.transform(with_number, lambda n: F.element_at(n, -1))
    total = F.aggregate(first, F.lit(0.0), lambda a, x: a + x)
    return F.when(items.isNotNull(), F.struct(F.size(items).alias("items"), total.alias("total"), F.array_min(last).alias("lowest"), F.array_max(last).alias("highest")))


def content_rows(documents: DataFrame, body: str = "body") -> DataFrame:
    """(id, content) of JSON documents that map node ids to content. Code is never run to get content."""
    parsed = F.from_json(F.col(body), "map<string, string>")
    return documents.select(F.explode(parsed).alias("id", "content")).withColumn("id", F.col("id").try_cast("int"))


def content_list(documents: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """(position, id, fields map) of JSON lists of objects, in their order; an object without the key is an error, and so is a text that is no list."""
    parsed = F.from_json(F.col(body), "array<map<string, string>>")
    known = F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("the content is no list of objects")).cast("array<map<string, string>>"))
    rows = documents.select(F.posexplode(known).alias("position", "fields"))
    named = F.coalesce(F.try_element_at("fields", F.lit(key)), F.raise_error(F.concat(F.lit("an object without a key at "), F.col("position").cast("string"))).cast("string"))
    return rows.select("position", named.alias("id"), "fields")
