"""Templates, seasons, documents of any depth, versions, collations, folders."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewrack.operators import snapshot, table, templates, versions
from tidewrack.sources import documents, pages


def test_blocks_and_their_paths(spark):
    html = "<html><head><title>t</title><body><nav><ul><li><a href=/>Home</a><li>Two</ul></nav><p>a<b>b</b> c<br>d<p>e &amp; f<script>x<p>y</script><div>in <span>side</span><p>g</div>tail</body>"
    df = spark.createDataFrame([("k", html), ("none", None), ("empty", "")], "k string, html string")
    got = [(r["position"], r["path"], r["text"]) for r in pages.blocks(df, "k").orderBy("position").collect()]
    assert got == [(0, "html/body/nav/ul/li", "Home"), (1, "html/body/nav/ul/li", "Two"), (2, "html/body/p", "ab c d"), (3, "html/body/p", "e & f"), (4, "html/body/div", "in side"), (5, "html/body/div/p", "g"), (6, "html/body", "tail")]


def test_template_of_a_host(spark):
    rows = []
    for i in range(10):
        rows += [("a", i, 0, "nav", "Home"), ("a", i, 1, "nav", "Home"), ("a", i, 2, "p", f"own text {i}"), ("a", i, 3, "foot", "shared" if i < 3 else f"foot {i}")]
    rows += [("b", 20, 0, "nav", "Home"), (None, 21, 0, "nav", "x"), (None, 22, 0, "nav", "x")]
    blocks = spark.createDataFrame(rows, "host string, page long, position int, path string, text string")
    template = templates.template_blocks(blocks)
    assert {(r["host"], r["text"], r["pages"]) for r in template.collect()} == {("a", "Home", 10), ("a", "shared", 3), (None, "x", 2)}
    own = templates.own_blocks(blocks, template)
    share = {r["page"]: (r["words"], r["own_words"], r["ok"]) for r in templates.own_share(own).collect()}
    assert share[0] == (6, 3, True) and share[5] == (7, 5, True) and share[20] == (1, 1, True) and share[21] == (1, 0, False)
    text = {r["page"]: r["text"] for r in templates.own_text(own).collect()}
    assert text[5] == "own text 5\nfoot 5" and 21 not in text


def test_sketches_find_near_pages(spark):
    """Recall of the sketches against all pairs, and no pair that is none."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = {}
    for g in range(60):
        base = [word() for _ in range(120)]
        for m in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            texts[g * 10 + m] = " ".join(w)
    texts |= {1000 + i: "copy of one page with quite a few words in it" for i in range(200)} | {2000: "", 2001: "one"}
    df = spark.createDataFrame(list(texts.items()), "page long, text string")
    grams = templates.shingles(df)
    sets = {}
    for x in grams.collect():
        sets.setdefault(x["page"], set()).add(x["s"])
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in sets if b < a]
    near = {a for a, b in pairs if like(a, b) >= 0.8}
    got = templates.near_pages(grams).collect()
    assert all(abs(like(x["page"], x["like"]) - x["similarity"]) < 1e-12 and x["similarity"] >= 0.8 for x in got)
    assert len({x["page"] for x in got} & near) >= 0.9 * len(near) and len(near) > 230
    assert sum(x["page"] >= 1000 for x in got) == 199  # a group of copies gives each page one partner
    estimate = {x["page"]: x["sketch"] for x in templates.sketches(grams).collect()}
    for a, b in r.sample(pairs, 300):
        assert abs(sum(p == q for p, q in zip(estimate[a], estimate[b], strict=True)) / templates.SIZE - like(a, b)) < 0.3


@pytest.mark.parametrize("ratio", [False, True])
def test_seasons_of_a_made_series(spark, ratio):
    index = [5, -3, 1, 0, 2, -4, 3, 1, -2, -1, 0, -2] if not ratio else [1.2, 0.8, 1.1, 1.0, 0.9, 1.05, 0.95, 1.0, 1.1, 0.9, 1.15, 0.85]
    value = lambda i: (100 + 2 * i + index[i % 12]) if not ratio else 100 * index[i % 12]
    rows = [("a", f"{2020 + i // 12}-{i % 12 + 1:02d}-01", float(value(i))) for i in range(48)] + [("short", f"2020-{m:02d}-01", 1.0) for m in range(1, 13)] + [("gap", f"{2020 + i // 12}-{i % 12 + 1:02d}-01", 1.0) for i in range(30) if i != 15]
    series = spark.createDataFrame(rows, "key string, month string, value double").withColumn("month", F.to_date("month"))
    got = table.seasonal(series, "key", "month", "value", ratio=ratio).orderBy("key", "month").collect()
    mine = [r for r in got if r["key"] == "a"]
    assert [r["trend"] is None for r in mine] == [i < 6 or i >= 42 for i in range(48)]
    for i, r in enumerate(mine):
        assert r["seasonal"] == pytest.approx(index[i % 12], abs=1e-6)
        if r["trend"] is not None:
            assert r["trend"] == pytest.approx(100 + 2 * i if not ratio else 100) and r["remainder"] == pytest.approx(1 if ratio else 0, abs=1e-6)
    assert all(r["trend"] is None and r["seasonal"] is None for r in got if r["key"] == "short")
    assert sum(r["trend"] is not None for r in got if r["key"] == "gap") == 5  # months 6 to 8, 22 and 23 have all thirteen around them


def nest(n, tier="T1"):
    out = {"cle": "k0", "preuve": tier}
    for i in range(1, n):
        out = {"cle": f"k{i}", "preuve": "T1", "more": [out]}
    return out


CONTRACT = {
    "type": "object", "required": ["root"], "properties": {"root": {"$ref": "#/$defs/metric"}, "other": {"$ref": "#/$defs/tree"}},
    "$defs": {
        "metric": {"type": "object", "required": ["cle"], "additionalProperties": False, "properties": {"cle": {"type": "string"}, "preuve": {"enum": ["T1", "T2"]}, "more": {"type": "array", "items": {"$ref": "#/$defs/metric"}}}},
        "tree": {"type": "object", "properties": {"left": {"$ref": "#/$defs/tree"}, "right": {"$ref": "#/$defs/tree"}, "value": {"type": "integer", "minimum": 0}}},
    },
}


def plain_violations(schema, value, path="$"):
    while "$ref" in schema:
        at = CONTRACT
        for part in schema["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        schema = at
    kinds = {"object": dict, "array": list, "string": str, "integer": int}
    if "enum" in schema and value not in schema["enum"]:
        return [f"{path}: is not one of {schema['enum']!r}"]
    if "type" in schema and not isinstance(value, kinds[schema["type"]]):
        return [f"{path}: is not of type {schema['type']!r}"]
    out = []
    if isinstance(value, dict):
        out += [f"{path}.{k}: is missing" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: is unknown" for k in value if k not in known]
        for k, sub in known.items():
            if k in value:
                out += plain_violations(sub, value[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += plain_violations(schema["items"], v, f"{path}[{i}]")
    if "minimum" in schema and value < schema["minimum"]:
        out.append(f"{path}: is below {schema['minimum']}")
    return out


def test_contracts_that_hold_themselves(spark):
    tree = {"value": 1, "left": {"value": -1, "right": {"value": -2, "left": {"value": "x"}}}, "right": {"left": {}, "right": 3}}
    bodies = [{"root": nest(40, "T9")}, {"root": nest(3), "other": tree}, {"root": {"cle": "a", "more": [nest(2, "T9"), {"preuve": "T1", "odd": 1}, 7]}}, {"root": nest(1)}, {}, {"root": {"cle": 1, "more": 3}}]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(100, json.dumps(bodies[1])), (101, "no json"), (102, None)]
    df = spark.createDataFrame(rows, "id long, body string")
    got = {r["id"]: r["violations"] for r in snapshot.contract_violations(df, CONTRACT).collect()}
    for i, b in enumerate(bodies):
        assert sorted(got[i]) == sorted(plain_violations(CONTRACT, b)), i
    assert len(got[0]) == 1 and got[0][0].count(".more[0]") == 39 and got[100] == got[1] and len(got[1]) == 4
    assert got[101] == ["$: is not readable JSON"]
    with pytest.raises(ValueError, match="names itself"):
        snapshot.contract_violations(df, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}})


def test_metrics_forty_levels_deep(spark):
    df = spark.createDataFrame([(1, json.dumps(nest(40))), (2, json.dumps([[[nest(1)]], "x", {"cle": "no"}])), (3, "bad"), (4, None), (5, "3")], "id long, body string")
    got = sorted((r["id"], len(r["path"]), r["cle"]) for r in snapshot.tagged_metrics(df).collect())
    assert got == sorted([(1, 1 + 8 * (39 - i), f"k{i}") for i in range(40)] + [(2, len("$[0][0][0]"), "k0")])


def test_versions(spark, tmp_path):
    kept = versions.Versions(spark, f"file://{tmp_path}/v")
    assert kept.read() is None and kept.log() == []
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n long, t string")
    first = kept.publish(rows, "20260101")
    assert (first.number, first.name, first.rows) == (1, "20260101a", 3)
    assert kept.publish(rows.orderBy(F.desc("n")).repartition(3), "20260101") is None and kept.publish(rows, "20260102") is None
    assert kept.publish(rows.distinct(), "20260101").name == "20260101b" and kept.publish(rows.limit(0), "20260102").name == "20260102a"
    assert sorted(map(tuple, kept.read("20260101a").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr) and kept.read().count() == 0
    staged = kept.stage(rows)  # a writer that was stopped before its commit
    assert kept.leftovers() == [staged] and len(kept.log()) == 3
    with pytest.raises(versions.Conflict):
        kept.publish(rows, "20260103", seen=2)
    with pytest.raises(versions.Conflict):
        kept.commit(versions.Entry(3, "x", "", staged, 0))
    assert kept.publish(rows, "20260103", seen=3).number == 4 and [e.number for e in kept.log()] == [1, 2, 3, 4]


def test_digests(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "n long, t string")
    same = spark.createDataFrame([(None, 2), ("x", 1)], "t string, n long")
    assert versions.digest(a) == versions.digest(same)
    for other in ([(1, "x")], [(1, "x"), (2, "")], [(1, "x"), (2, None), (2, None)]):
        assert versions.digest(spark.createDataFrame(other, "n long, t string")) != versions.digest(a)


def test_files_that_people_edit(spark, tmp_path):
    files = versions.Files(spark, f"file://{tmp_path}/f")
    rows = lambda *x: spark.createDataFrame(list(x), "path string, content string")
    plan = lambda df: {r["path"]: r["plan"] for r in df.collect()}
    now = lambda: {r["path"]: r["content"] for r in files.state()[0].collect()}
    assert plan(files.write(rows(("a", "1"), ("b", "1"), ("c", None)), "20260101")) == {"a": "create", "b": "create", "c": "create"}
    assert plan(files.write(rows(("a", "1"), ("b", "1"), ("c", "")), "20260101")) == {"a": "same", "b": "same", "c": "same"} and files.state()[1] == 1
    files.edit(rows(("b", "mine")), "20260101")
    files.table.stage(rows(("a", "never seen")))  # an aborted run
    assert plan(files.write(rows(("a", "2"), ("b", "2"), ("d", "2")), "20260102")) == {"a": "keep", "b": "keep", "d": "create"}
    assert now() == {"a": "1", "b": "mine", "c": None, "d": "2"}
    assert plan(files.write(rows(("a", "2"), ("b", "2"), ("d", "2")), "20260102", force=True)) == {"a": "replace", "b": "keep", "d": "same"}
    assert now() == {"a": "2", "b": "mine", "c": None, "d": "2"}
    assert plan(files.plan(rows(("b", "mine")))) == {"b": "same"}


def test_collations(spark):
    words = ["cœur", "coeur", "COEUR", "côte", "cote", "Côté", "straße", "STRASSE", "ﬁn", "fin", "ångström", "Angstrom", None, ""]
    df = spark.createDataFrame(list(enumerate(words)), "id long, w string")
    found = lambda wanted: {words[r["id"]] for r in table.locale_search(df, ["w"], wanted).collect()}
    assert found("OEU") == {"cœur", "coeur", "COEUR"} and found("strasse") == {"straße", "STRASSE"} and found("FIN") == {"ﬁn", "fin"} and found("angstrom") == {"ångström", "Angstrom"}
    groups = {r["w"]: (r["n"], r["forms"]) for r in table.locale_groups(df.union(df), "w").collect()}
    assert groups["COEUR"] == (6, 3) and groups["Côté"] == (6, 3) and groups["STRASSE"] == (4, 2) and groups[""] == (2, 1) and len(groups) == 6
    ordered = [words[r["id"]] for r in table.locale_sort(df, "w", key="id").collect()]
    assert ordered[-2:] == [None, ""] and ordered.index("cœur") < ordered.index("cote") < ordered.index("fin") < ordered.index("straße")
    mixed = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate([("10 b", "2,5"), ("9 a", "x"), ("Élan", "10"), ("eau", None), ("9 a", "-3"), ("", "1")])], "id long, g string, v string")
    assert [r["id"] for r in table.locale_sort(mixed, "v", group="g", key="id").collect()] == [4, 1, 0, 3, 2, 5]
    assert [r["id"] for r in table.locale_sort(mixed, "v", descending=True, key="id").collect()][-1] == 3


FILES = {
    "a.csv": "﻿id,libelle,gain\n1,\"x, \"\"y\"\"\nz\",3\n\n2,,\n", "sub/b.csv": "id;action\r\n1;\"a;b\"\r\n2; c \r\n", "c.csv": "id\tgain\n7\t5", "d.csv": "id|libelle|note\n1|\"p|q\"|\n",
}


def folder(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def test_files_of_four_dialects(spark, tmp_path):
    got = documents.read_action_folder(spark, folder(tmp_path, FILES)).collect()
    rows = {(r["path"].rsplit("/", 1)[1], r["line"]): (r["delimiter"], r["cells"]) for r in got}
    assert rows == {
        ("a.csv", 1): (",", {"id": "1", "libelle": 'x, "y"\nz', "gain": "3"}), ("a.csv", 2): (",", {"id": "2", "libelle": "", "gain": ""}), ("b.csv", 1): (";", {"id": "1", "action": "a;b"}), ("b.csv", 2): (";", {"id": "2", "action": "c"}),
        ("c.csv", 1): ("\t", {"id": "7", "gain": "5"}), ("d.csv", 1): ("|", {"id": "1", "libelle": "p|q", "note": ""}),
    }


@pytest.mark.parametrize(("text", "says"), [("nothing,known\n1,2\n", "no delimiter gives a known column.*odd.csv"), ("id,gain\n1,2,3\n", "not as wide as its header.*odd.csv 1")])
def test_files_that_are_refused(spark, tmp_path, text, says):
    with pytest.raises(Exception, match=says):
        documents.read_action_folder(spark, folder(tmp_path, FILES | {"odd.csv": text})).collect()


def test_files_are_found_without_entering_excluded_folders(spark, tmp_path):
    root = folder(tmp_path, {"run-1.json": "x", "a b/run-1.json": "xy", "a b/é/run-2.json": "", "node_modules/deep/run-3.json": "", "a b/node_modules/run-4.json": "", "a b/other.txt": "", "1/2/3/run-5.json": ""})
    os.chmod(f"{root}/node_modules", 0)  # listing it would fail for anybody but root
    try:
        got = {(r["path"], r["name"], r["bytes"], r["copies"]) for r in documents.scan(spark, root, r"^run-.*\.json$", ("node_modules",)).collect()}
        assert got == {("run-1.json", "run-1.json", 1, 2), ("a b/run-1.json", "run-1.json", 2, 2), ("a b/é/run-2.json", "run-2.json", 0, 1), ("1/2/3/run-5.json", "run-5.json", 0, 1)}
        assert documents.scan(spark, f"file://{root}", r"^run-", ("node_modules",), depth=2).count() == 2
        assert documents.scan(spark, root, "^none$", ("node_modules",)).count() == 0
    finally:
        os.chmod(f"{root}/node_modules", 0o755)


def test_tables_of_several_files(spark):
    text = "## 1. Idea — x\n| 1 | a |\n## 2. Base — y\n| 2 | b |\n"
    df = spark.createDataFrame([("one.md", text), ("two.md", text), ("two.md", text)], "path string, text string")
    got = sorted((r["path"], r["line"], r["section"], r["cells"]) for r in documents.table_rows(df, "text", 2).collect())
    assert got == [(p, n, s, c) for p in ("one.md", "two.md") for n, s, c in ((1, "Idea", ["1", "a"]), (3, "Base", ["2", "b"]))]


def test_alternates_and_open_graph(spark):
    html = '<link rel="alternate" hreflang="FR"><link rel=alternate hreflang=de href=" /d "><meta name="og:title" content="N"><meta property="OG:Title" content="P"><meta property="og:image" content=""><meta name="og:image" content=" i "><meta property="og:url" name="robots" content="u"><link rel=canonical href=""><link rel=canonical href="/c">'
    found = pages.signals(html)
    assert found["hreflang"] == [{"lang": "fr", "href": None}, {"lang": "de", "href": "/d"}]
    assert dict(found["og"]) == {"og:title": "N", "og:image": "i", "og:url": "u"} and found["canonical"] == "/c" and found["robots"] == "u"
