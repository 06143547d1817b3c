"""Snapshots of a study: states, evidence, debt, runs, and the contract they must meet."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.numbers import percent
from tidewrack.operators.graph import cut_lineage

#: States of a sheet, verdicts that assert something, reasons by instrumentation status, fields of a sheet.
STATES = ("a-faire", "en-cours", "fait", "hors-perimetre")
VERDICTS = ("conforme", "partiel", "non-conforme", "non-mesure", "sans-objet")
AFFIRMATIVE = ("conforme", "partiel", "non-conforme")
TIERS = ("T1", "T2", "T3", "T4")
OUT_OF_SCOPE_STATUSES = ("PY", "NM", "EX", "CA", "RV")
SHEET_FIELDS = (
    "id", "branche", "noeud", "volet", "statut_instrumentation", "source_requise", "doublon_de", "modeles", "etat",
    "motif_hors_perimetre", "verdict", "niveau_preuve", "date_mesure", "actions_liees",
)


#: Fixed value: nodes of the grid, which a study's counters are out of.
GRID_NODES = 89


def state_counters(sheets: DataFrame, state: str, total: int | None = GRID_NODES) -> DataFrame:
    """Sheets in each state, out of the grid's nodes, or of the rows if total is None. A null state is still to do; unknown states count in the total only."""
    n = lambda s: F.count_if(F.col(state) == s)
    return sheets.agg((F.count("*") if total is None else F.lit(total).cast("long")).alias("total"), n("fait").alias("fait"), n("en-cours").alias("en_cours"), n("hors-perimetre").alias("hors_perimetre"), F.count_if(F.col(state).isNull() | (F.col(state) == "a-faire")).alias("a_faire"))


def tier_distribution(rows: DataFrame, tier: str, not_measured: str) -> DataFrame:
    """Rows and whole percent of each evidence tier; what is not measured is NM whatever its tier, and unknown tiers are left out."""
    name = F.when(F.col(not_measured), "NM").when(F.col(tier).isin(*TIERS), F.col(tier))
    counts = rows.select(name.alias("tier")).where("tier is not null").groupBy("tier").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def not_instructed(state: Column) -> Column:
    return F.coalesce(state, F.lit("a-faire")).isin("a-faire", "en-cours")


def out_of_model(state: Column, reason: Column) -> Column:
    return (state == "hors-perimetre") & F.startswith(F.lower(F.coalesce(reason, F.lit(""))), F.lit("modèle d'acquisition"))


def needs_field_data(source: Column) -> Column:
    return F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit("crux"))


def not_reproducible(reserve: Column) -> Column:
    return F.contains(F.lower(F.coalesce(reserve, F.lit(""))), F.lit("non reproductible"))


def sheet_state(found: Column, verdict: Column, status: Column, previous_state: Column, needs_field: Column, has_field: Column) -> tuple[Column, Column]:
    """State and verdict of a sheet: a finding is done, a status with a reason puts it out of scope, else it is to do.

    A sheet that is out of scope already stays so without a finding. An affirmative verdict that needs field data
    which nobody has becomes "non-mesure"."""
    state = F.when(found, "fait").when(previous_state == "hors-perimetre", "hors-perimetre").when(status.isin(*OUT_OF_SCOPE_STATUSES), "hors-perimetre").otherwise("a-faire")
    kept = F.when(needs_field & verdict.isin(*AFFIRMATIVE) & ~F.coalesce(has_field, F.lit(False)), "non-mesure").otherwise(verdict)
    return state, F.when(found, kept).when(state == "hors-perimetre", "sans-objet")


def debt(declared: DataFrame, bare: DataFrame, key: str) -> DataFrame:
    """Declared rows, then rows that none declares: (key, origin)."""
    first = declared.select(key).distinct().withColumn("origin", F.lit("declared"))
    return first.unionByName(bare.select(key).distinct().join(first, key, "left_anti").withColumn("origin", F.lit("uncovered")))


def instrumentation_debt(nodes: DataFrame) -> DataFrame:
    """Nodes out of scope for want of an instrument: not by the study's model, and not a mere pointer to another node."""
    return nodes.where((F.col("etat") == "hors-perimetre") & ~out_of_model(F.col("etat"), F.col("motif_hors_perimetre")) & (F.coalesce("statut_instrumentation", F.lit("")) != "RV"))


def latest_previous(runs: DataFrame, key: str, order: list[str], run: str, value: str) -> DataFrame:
    """The latest run of each key, the one before it, and the change of a value between them (null without a previous one)."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    two = runs.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    at = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    return two.groupBy(F.col(key).alias("key")).agg(at(run, 1).alias("latest"), at(run, 2).alias("previous"), (at(value, 1) - at(value, 2)).alias("change"))


def latest_by_file(df: DataFrame, path: Column, domain: Column) -> DataFrame:
    """Adds domain, date (YYYYMMDD in the file's name) and place, 1 for the latest of each domain."""
    date = F.try_to_date(F.regexp_extract(path, r"(\d{8})[^/]*$", 1), "yyyyMMdd")
    out = df.withColumn("domain", domain).withColumn("date", date)
    return out.withColumn("place", F.dense_rank().over(Window.partitionBy("domain").orderBy(F.desc_nulls_last("date"))))


def merge(base: DataFrame, fresh: DataFrame, key: str, fresh_fields: list[str]) -> DataFrame:
    """The previous snapshot with the fields that this run measured; what people wrote stays."""
    b, f = base.alias("b"), fresh.alias("f")
    met = b.join(f, key, "full")
    columns = [c for c in dict.fromkeys([*base.columns, *fresh.columns]) if c != key]
    value = lambda c: (F.coalesce(f"f.{c}", f"b.{c}") if c in base.columns else F.col(f"f.{c}")) if c in fresh_fields and c in fresh.columns else F.col(f"b.{c}") if c in base.columns else F.col(f"f.{c}")
    return met.select(key, *[value(c).alias(c) for c in columns])


def step_guard(steps: DataFrame, study: str, order: str, status: str) -> DataFrame:
    """Whether a step may close: all steps before it are closed."""
    w = Window.partitionBy(study).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("may_close", F.coalesce(F.min((F.col(status) == "fait").cast("int")).over(w), F.lit(1)) == 1)


def fingerprint_plan(wanted: DataFrame, registry: DataFrame, key: str, digest: str, force: bool = False) -> DataFrame:
    """What an idempotent write does with each file: create it, leave it, replace an untouched one, or keep an edited one.

    wanted: (key, new); registry: (key, written, current) digests of what was written and of what is there now."""
    rows = wanted.join(registry, key, "left")
    untouched = F.col("written").eqNullSafe(F.col("current"))
    plan = F.when(F.col("current").isNull(), "create").when(F.col("current") == F.col(digest), "same").when(untouched & F.lit(force), "replace").otherwise("keep")
    return rows.withColumn("plan", plan)


# --- contract --------------------------------------------------------------------------------------------------

#: How the kinds of a contract read as the kinds of a parsed value.
KINDS = {"object": "OBJECT.*", "array": "ARRAY.*", "string": "STRING", "null": "VOID", "boolean": "BOOLEAN", "integer": r"BIGINT|DECIMAL\((?:19|[23]\d),0\)", "number": r"BIGINT|DOUBLE|DECIMAL.*"}
NONE = "array<string>"
PENDING = "array<struct<path: string, ref: string, value: variant>>"


def _equals(value: Column, kind: Column, wanted: Any) -> Column:
    """Whether a parsed value is one JSON scalar: of its kind, and equal."""
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, int | float):
        return kind.rlike(f"^(?:{KINDS['number']})$") & (F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))
    return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))


class Contract:
    """A JSON Schema (type, const, enum, properties, required, additionalProperties, items, minItems, maxItems, minimum,
    maximum, local $ref) compiled once into expressions over parsed JSON.

    Each keyword gives an array of messages with the path of what breaks it. A value of a wrong kind, or outside its
    const or enum, is told as that alone. Where a schema holds itself, its expressions stop: what lies there is `pending`, as
    (path, ref, value), and is judged in a further round by the schema that the ref names."""

    def __init__(self, schema: dict):
        self.root = schema

    def named(self, ref: str) -> dict:
        return reduce(lambda node, part: node[part], [p for p in ref.removeprefix("#").split("/") if p], self.root)

    def resolve(self, schema: dict, seen: tuple[str, ...]) -> tuple[dict | None, tuple[str, ...], str | None]:
        """The schema behind the refs; or none and the ref that is seen a second time."""
        here: tuple[str, ...] = ()
        while "$ref" in schema:
            ref = schema["$ref"]
            if ref in here:
                raise ValueError(f"a ref that names itself: {ref}")
            if ref in seen:
                return None, seen, ref
            here, seen, schema = (*here, ref), (*seen, ref), self.named(ref)
        return schema, seen, None

    def pending_refs(self, schema: dict | None = None, seen: tuple[str, ...] = ()) -> set[str]:
        """The refs at which the expressions of a schema stop."""
        schema, seen, again = self.resolve(self.root if schema is None else schema, seen)
        if again:
            return {again}
        inner = [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]
        return set().union(*[self.pending_refs(x, seen) for x in inner])

    def pending(self, schema: dict, value: Column, path: Column, seen: tuple[str, ...] = ()) -> Column | None:
        """What the expressions of `violations` leave to a further round; null where there is nothing such."""
        schema, seen, again = self.resolve(schema, seen)
        if again:
            return F.array(F.struct(path.alias("path"), F.lit(again).alias("ref"), value.alias("value")))
        kind, out = F.schema_of_variant(value), []
        for key, sub in schema.get("properties", {}).items():
            if self.pending_refs(sub, seen):
                entries = F.try_variant_get(value, "$", "map<string, variant>")
                inner = self.pending(sub, F.try_element_at(entries, F.lit(key)), F.concat(path, F.lit(f".{key}")), seen)
                out.append(F.when(kind.startswith("OBJECT") & F.map_contains_key(entries, key), inner))
        if "items" in schema and self.pending_refs(schema["items"], seen):
            values = F.try_variant_get(value, "$", "array<variant>")
            each = F.transform(values, lambda v, i: self.pending(schema["items"], v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen))
            out.append(F.when(kind.startswith("ARRAY"), F.flatten(each)))
        if not out:
            return None
        whole = F.concat(*[F.coalesce(x, F.array().cast(PENDING)) for x in out]) if len(out) > 1 else F.coalesce(out[0], F.array().cast(PENDING))
        broken = self.shape(schema, value, kind)
        return F.when(reduce(Column.__and__, [F.coalesce(ok, F.lit(False)) for ok, _ in broken]), whole).otherwise(F.array().cast(PENDING)) if broken else whole

    def shape(self, schema: dict, value: Column, kind: Column) -> list[tuple[Column, str]]:
        """Conditions that must hold before anything inside a value is looked at, each with its message."""
        wanted = schema.get("type", [])
        kinds = [wanted] if isinstance(wanted, str) else wanted
        out = []
        if "const" in schema:
            out.append((_equals(value, kind, schema["const"]), f": is not {schema['const']!r}"))
        if "enum" in schema:
            out.append((reduce(Column.__or__, [_equals(value, kind, e) for e in schema["enum"]]), f": is not one of {schema['enum']!r}"))
        if kinds:
            out.append((kind.rlike(f"^(?:{'|'.join(KINDS[k] for k in kinds)})$"), f": is not of type {wanted!r}"))
        return out

    def violations(self, schema: dict, value: Column, path: Column, seen: tuple[str, ...] = ()) -> Column:
        schema, seen, again = self.resolve(schema, seen)
        if again:
            return F.array().cast(NONE)
        kind = F.schema_of_variant(value)
        says = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), F.concat(path, F.lit(text)))
        messages = lambda *found: F.filter(F.array(*found), lambda m: m.isNotNull())
        inside: list[Column] = []
        if {"properties", "required", "additionalProperties"} & schema.keys():
            inside.append(F.when(kind.startswith("OBJECT"), self.fields(schema, F.try_variant_get(value, "$", "map<string, variant>"), path, seen)))
        if {"items", "minItems", "maxItems"} & schema.keys():
            inside.append(F.when(kind.startswith("ARRAY"), self.members(schema, F.try_variant_get(value, "$", "array<variant>"), path, seen)))
        bounds = [(b, op, word) for b, op, word in (("minimum", Column.__ge__, "below"), ("maximum", Column.__le__, "above")) if b in schema]
        if bounds:
            number = F.try_variant_get(value, "$", "double")
            inside.append(F.when(kind.rlike(f"^(?:{KINDS['number']})$"), messages(*[says(op(number, F.lit(float(schema[b]))), f": is {word} {schema[b]}") for b, op, word in bounds])))
        deep = F.concat(*[F.coalesce(x, F.array().cast(NONE)) for x in inside]) if inside else F.array().cast(NONE)
        shape = [says(ok, text) for ok, text in self.shape(schema, value, kind)]
        if not shape:
            return deep
        first = F.coalesce(*shape)
        return F.when(first.isNotNull(), F.array(first)).otherwise(deep)

    def fields(self, schema: dict, entries: Column, path: Column, seen: tuple[str, ...]) -> Column:
        known, required = schema.get("properties", {}), schema.get("required", [])
        named = lambda keys, text: F.transform(keys, lambda k: F.concat(path, F.lit("."), k, F.lit(text)))
        names = lambda keys: F.array(*map(F.lit, keys)).cast(NONE)
        out = [named(F.array_except(names(required), F.map_keys(entries)), ": is missing")]
        if schema.get("additionalProperties") is False:
            out.append(named(F.array_except(F.map_keys(entries), names(known)), ": is unknown"))
        for key, sub in known.items():
            value = F.try_element_at(entries, F.lit(key))
            out.append(F.when(F.map_contains_key(entries, key), self.violations(sub, value, F.concat(path, F.lit(f".{key}")), seen)).otherwise(F.array().cast(NONE)))
        return F.concat(*out)

    def members(self, schema: dict, values: Column, path: Column, seen: tuple[str, ...]) -> Column:
        n = F.size(values)
        out = [F.when(n < schema.get("minItems", 0), F.array(F.concat(path, F.lit(f": has fewer than {schema.get('minItems')} items"))))]
        if "maxItems" in schema:
            out.append(F.when(n > schema["maxItems"], F.array(F.concat(path, F.lit(f": has more than {schema['maxItems']} items")))))
        if "items" in schema:
            out.append(F.flatten(F.transform(values, lambda v, i: self.violations(schema["items"], v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen))))
        return F.concat(*[F.coalesce(x, F.array().cast(NONE)) for x in out])


def contract_violations(documents: DataFrame, schema: dict, body: str = "body") -> DataFrame:
    """Adds `violations` to rows of JSON text; text that is not JSON, or repeats a key, is a violation of its own.

    A contract that holds itself is judged in rounds, one for each time that a document goes round it."""
    contract, parsed = Contract(schema), F.try_parse_json(F.col(body))
    unreadable = F.array(F.lit("$: is not readable JSON"))
    first = F.when(parsed.isNull(), unreadable).otherwise(contract.violations(schema, parsed, F.lit("$")))
    refs = contract.pending_refs()
    if not refs:
        return documents.withColumn("violations", first)
    names = [F.xxhash64(F.lit(i), body).alias(n) for i, n in enumerate(("_a", "_b"))]  # texts that are alike are judged once
    texts = documents.select(F.col(body).alias("_text")).where("_text is not null").distinct().select(*[F.xxhash64(F.lit(i), "_text").alias(n) for i, n in enumerate(("_a", "_b"))], F.try_parse_json("_text").alias("value"))
    start = contract.pending(schema, F.col("value"), F.lit("$"))
    level = texts.where("value is not null").select("_a", "_b", F.explode(start).alias("p")).select("_a", "_b", "p.*")
    told = None
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            break
        messages, beyond = F.array().cast(NONE), F.array().cast(PENDING)
        for ref in sorted(refs | set().union(*[contract.pending_refs(contract.named(r), (r,)) for r in refs])):
            own = F.col("ref") == ref
            messages = F.when(own, contract.violations(contract.named(ref), F.col("value"), F.col("path"), (ref,))).otherwise(messages)
            more = contract.pending(contract.named(ref), F.col("value"), F.col("path"), (ref,))
            beyond = beyond if more is None else F.when(own, more).otherwise(beyond)
        found = level.select("_a", "_b", F.explode(messages).alias("message"))
        told = found if told is None else told.unionByName(found)
        level = level.select("_a", "_b", F.explode(beyond).alias("p")).select("_a", "_b", "p.*")
    judged = documents.withColumn("violations", first).withColumns({c: n for c, n in zip(("_a", "_b"), names, strict=True)})
    if told is None:
        return judged.drop("_a", "_b")
    later = told.groupBy(F.col("_a").alias("_x"), F.col("_b").alias("_y")).agg(F.array_sort(F.collect_list("message")).alias("_later"))
    met = judged.join(later, (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "left")
    return met.withColumn("violations", F.concat("violations", F.coalesce("_later", F.array().cast(NONE)))).select(*documents.columns, "violations")


#: Levels of nesting that a round of `tagged_metrics` opens.
LEVELS = 4


def tagged_metrics(documents: DataFrame, body: str = "body") -> DataFrame:
    """(path, cle, preuve) of every object, at any depth, that has a key and an evidence tier.

    A round opens some levels of nesting; the objects and lists below them are written to the shared folder for the next
    round, until there are none."""
    kept = [c for c in documents.columns if c != body]
    is_kind = lambda k: F.schema_of_variant("value").startswith(k)
    level = documents.select(*kept, F.lit("$").alias("path"), F.try_parse_json(F.col(body)).alias("value")).where("value is not null")
    out = None
    while True:
        level = cut_lineage(level.where(is_kind("OBJECT") | is_kind("ARRAY")))
        if out is not None and level.isEmpty():
            return out
        for _ in range(LEVELS):
            here = level.withColumn("entries", F.when(is_kind("OBJECT"), F.try_variant_get("value", "$", "map<string, variant>")))
            members = F.when(is_kind("ARRAY"), F.try_variant_get("value", "$", "array<variant>"))
            has = F.map_contains_key("entries", "cle") & F.map_contains_key("entries", "preuve")
            found = here.where(has).select(*kept, "path", F.try_variant_get("value", "$.cle", "string").alias("cle"), F.try_variant_get("value", "$.preuve", "string").alias("preuve"))
            out = found if out is None else out.unionByName(found)
            sub = lambda name, v: F.struct(F.concat("path", name).alias("path"), v.alias("value"))
            # A variant is no part of a map's entry array, so children are looked up by name.
            children = F.coalesce(
                F.transform(F.map_keys("entries"), lambda k: sub(F.concat(F.lit("."), k), F.try_element_at("entries", k))),
                F.transform(members, lambda v, i: sub(F.concat(F.lit("["), i.cast("string"), F.lit("]")), v)),
            )
            level = here.select(*kept, F.explode(children).alias("child")).select(*kept, "child.path", "child.value").where(is_kind("OBJECT") | is_kind("ARRAY"))
