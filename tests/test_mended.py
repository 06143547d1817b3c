"""Robots rules against the standard library, labels, heads, refusals, and plans that gather nothing."""

import random
import re
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import text
from tidewrack.operators import checks, grid, migrate, redirects, rules, scoring, snapshot, table
from tidewrack.sources import sitemaps

LINES = [
    "User-agent: *", "User-agent: crawler", "user-agent: Other # x", "Disallow: /a", "Disallow: /a/b?x", "Allow: /a/b", "Disallow:", "Allow: /", "Disallow: /", "Disallow: /%61b", "Disallow: *", "", " ", "# only a comment",
    "Sitemap: https://a.com/s.xml", "Crawl-delay: 3", "no colon", "Disallow: /caf%C3%A9", "Disallow /c", "Allow: /a%2Fb",
]
URLS = ["https://a.com/", "https://a.com", "https://a.com/a", "https://a.com/ab", "https://a.com/a/b", "https://a.com/a/b?x=1", "https://a.com/café/x", "https://a.com/caf%C3%A9", "https://a.com/c", "https://a.com/*"]


@pytest.mark.parametrize("agent", ["*", "crawler", "my-Other/2.0", "none"])
def test_robots_against_the_standard_parser(spark, agent):
    r = random.Random(len(agent))
    bodies = {str(i): "\n".join(r.choice(LINES) for _ in range(r.randint(0, 12))) for i in range(150)}
    robots = spark.createDataFrame(list(bodies.items()), "host string, body string")
    rows = [(h, u) for h in [*bodies, "unknown"] for u in URLS]
    got = {(x["host"], x["url"]): x["allowed"] for x in sitemaps.judge_robots(spark.createDataFrame(rows, "host string, url string"), robots, agent).collect()}
    for h, body in bodies.items():
        plain = RobotFileParser()
        plain.parse(body.splitlines())
        for u in URLS:
            assert got[h, u] == plain.can_fetch(agent, u), (body, u)
    assert all(got["unknown", u] for u in URLS)


def plain_head(value, longest=170):
    t = " ".join((value or "").split())
    ends = [i for i in (t.find(e) for e in text.UNIT_ENDS) if 0 < i <= longest]
    return t[: min(ends)].strip(text.UNIT_MARKS) if ends else t


def test_heads_of_texts(spark):
    r = random.Random(3)
    values = [None, "", " . ", "One. Two.", "A : b — c", "x – y", "no end", "a;b ; c", "v. 1.2 is out. Now", "word " * 60 + ". late", " a  : b", " : starts", "— : —. x"]
    values += ["".join(r.choice(["word", " ", ". ", " : ", ";", " — ", "\n", " ; ", "é"]) for _ in range(r.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, t string")
    got = {x["id"]: x["h"] for x in df.select("id", text.first_sentence(F.col("t")).alias("h")).collect()}
    assert got == {i: plain_head(v) for i, v in enumerate(values)}


def test_evidence_and_absence(spark):
    values = ["12 Entrées", "3 ENTRÉE", "« abc »", "`ab`", "`abc`", "12 links", "2 URLs et", "1 ligne", "x12 section", "Introuvable", "n'existe pas", "not found", "absente", "404", "4040", ""]
    df = spark.createDataFrame(list(enumerate(values)), "id long, t string")
    got = {x["id"]: (x["a"], x["b"]) for x in df.select("id", text.read_evidence(F.col("t")).alias("a"), text.says_absent(F.col("t")).alias("b")).collect()}
    assert got == {i: (bool(re.search(text.READ, v, re.IGNORECASE)), bool(re.search(text.ABSENT, v, re.IGNORECASE))) for i, v in enumerate(values)}


def test_labels_of_actions(spark):
    rows = [(0, None, "PAYANT", None, None, None), (1, " 0 ", "GRATUIT", "28", None, "IA"), (2, "-", None, "", "3,5", "MANUEL"), (3, "1 200 €", "PAYANT", "two weeks", "7", ""), (4, "0.00", "PAYANT", None, " 4 ", None)]
    df = spark.createDataFrame(rows, "id long, cost string, axis string, d1 string, d2 string, x string")
    got = {r["id"]: (r["c"], r["d"], r["f"]) for r in df.select("id", scoring.cost_label(F.col("cost"), F.col("axis")).alias("c"), scoring.delay_label(F.col("d1"), F.col("d2")).alias("d"), scoring.channel_label(F.col("x"), F.col("axis")).alias("f")).collect()}
    assert got == {0: ("—", "", "? + PAYANT"), 1: ("gratuit", "28 jours", "IA + GRATUIT"), 2: ("gratuit", "3,5 jours", "MANUEL + ?"), 3: ("1 200 €", "two weeks", "? + PAYANT"), 4: ("0.00", "4 jours", "? + PAYANT")}


def test_quadrants_without_actions(spark):
    empty = spark.createDataFrame([], "id string, axe_execution string, axe_cout string, effort string, score double, action string, libelle string")
    assert {tuple(r) for r in scoring.fixed_quadrants(empty).collect()} == {(f"{x} + {c}", 0, 0, "—") for x in ("IA", "MANUEL") for c in ("GRATUIT", "PAYANT")}
    rows = spark.createDataFrame([("b", "IA", "GRATUIT", "2", 1.0, "Second", None), ("a", "IA", "GRATUIT", "x", 1.0, None, "First : now"), ("c", "IA", "GRATUIT", "3.7", None, "Third", None), ("d", "IA", None, "9", 9.0, "Odd", None)], empty.schema)
    assert ("IA + GRATUIT", 3, 5, "First") in {tuple(r) for r in scoring.fixed_quadrants(rows).collect()}


def test_counters_out_of_the_grid(spark):
    df = spark.createDataFrame([("fait",), (None,), ("odd",)], "s string")
    assert snapshot.state_counters(df, "s").first().asDict() == {"total": 89, "fait": 1, "en_cours": 0, "hors_perimetre": 0, "a_faire": 1}
    assert snapshot.state_counters(df, "s", total=None).first()["total"] == 3


def test_conditions_that_cover_many(spark):
    cases = {
        'http.host eq "a"': True, 'http.request.uri.path eq "/a"': False, 'http.request.uri.path in {"/a"}': False, 'http.request.uri.path=="/a"': None, 'ends_with(http.request.uri, "x")': True, 'http.request.full_uri wildcard r#"a*"#': True,
        'http.request.uri.path wildcard "a"': None, 'http.cookie contains "x" and http.request.uri.path eq "/a"': True, 'http.request.uri.path eq "/a~b"': False, 'http.host ~ "x" and http.request.uri.path eq "/"': True, 'starts_with(http.host, "a") and http.request.uri.path eq "/b"': False,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, c string")
    got = {r["c"]: r["many"] for r in df.select("c", redirects.covers_many(F.col("c")).alias("many")).collect()}
    assert got == cases


def test_migrations_are_written_to_an_empty_place(spark, tmp_path):
    sheets = spark.createDataFrame([(1, "a")], "id long, t string")
    none = spark.createDataFrame([], "reason string, id string")
    migrate.write_migrated(sheets, f"file://{tmp_path}/new", none)
    assert spark.read.parquet(f"{tmp_path}/new").count() == 1
    with pytest.raises(ValueError, match="not empty"):
        migrate.write_migrated(sheets, f"file://{tmp_path}/new", none)
    with pytest.raises(ValueError, match="collision .2, first 3."):
        migrate.write_migrated(sheets, f"file://{tmp_path}/other", spark.createDataFrame([("collision", "4"), ("collision", "3")], "reason string, id string"))
    (tmp_path / "empty").mkdir()
    migrate.refuse_filled(spark, f"file://{tmp_path}/empty")


def test_long_chains_of_versions(spark):
    arcs = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(25)], "de string, vers string")
    got = {r["version"]: r["hops"] for r in migrate.chains(arcs, "v0").collect()}
    assert got["v25"] == 25 and len(got) == 26


def test_lossless_counts_rows(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, None, 3)], "n long, t string, i long")
    assert migrate.lossless(a, a.withColumn("i", F.lit(0).cast("long")), ["i"])
    assert not migrate.lossless(a, a.distinct().where("i <> 2"), ["i"]) and not migrate.lossless(a, a.withColumn("t", F.coalesce("t", F.lit(""))), ["i"])


def test_groups_are_not_gathered(spark):
    """Sizes and first rows come from partial aggregates; samples are cut in each task."""
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    plan = table.group_headers(df, "g", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_" in plan
    facts = checks.facts({"a": df.select(F.col("id").alias("subject")), "b": df.where("false").select(F.col("id").alias("subject"))})
    assert "WindowGroupLimit" in facts._jdf.queryExecution().executedPlan().toString()
    got = {r["name"]: (r["ok"], r["n"], r["examples"]) for r in facts.collect()}
    assert got == {"a": (False, 1000, ["0", "1", "10", "100", "101"]), "b": (True, 0, [])}
    for out in (grid.theme_concentration(df, "g"), grid.referrer_share(df, "g", ["1"]), table.filter_values(df, "g")):
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["value"], r["n"]) for r in table.filter_values(df, "g").collect()} == {(0, 666), (1, 334)} and table.filter_values(df.limit(4), "g").count() == 0


def test_alternates_without_an_address_are_not_judged(spark):
    pages = spark.createDataFrame([("u", 200, [], None, [("fr", None), ("de", "u")], False)], "url string, status int, redirects array<string>, canonical string, hreflang array<struct<lang: string, href: string>>, in_sitemap boolean")
    got = {r["rule"]: (r["verdict"], r["subjects"]) for r in rules.declared_urls(pages).collect()}
    assert got["U2"] == ("PASS", 1) and got["U1"] == ("SANS_OBJET", 0)
