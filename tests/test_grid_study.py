import pytest
from pyspark.sql import functions as F

from tidewrack.operators import grid, study


def test_sheets_meet_nodes(spark):
    nodes = spark.createDataFrame([("a", 1, "Idea", "N1", "x"), ("b", 2, "Idea", "N2", "y")], "chemin string, id int, branche string, noeud string, verdict string")
    sheets = spark.createDataFrame([("a", 9, "conforme", "seen")], "chemin string, id int, verdict string, constat string")
    row = study.with_sheets(nodes, sheets).first()
    assert (row["chemin"], row["id"], row["verdict"], row["constat"]) == ("a", 1, "conforme", "seen")
    with pytest.raises(ValueError, match="b"):
        study.require_all(nodes, sheets)
    earlier = spark.createDataFrame([("IDEA", "n1", "old", "partiel"), ("Was", "Before", "moved", "conforme")], "branche string, noeud string, constat string, verdict string")
    moves = spark.createDataFrame([("Idea", "N2", "was", "before")], "branche string, noeud string, old_branche string, old_noeud string")
    got = study.carry_over(nodes.drop("verdict"), earlier, moves).collect()
    assert {r["id"]: r["constat"] for r in got} == {1: "old", 2: "moved"}


def test_models_states_and_readings(spark):
    nodes = spark.createDataFrame([(1, None), (26, "fait"), (62, "hors-perimetre")], "id int, etat string")
    scopes = spark.createDataFrame([(60, 64, ["local"]), (26, 26, ["local", "e-commerce"])], "lo int, hi int, modeles array<string>")
    got = {r["id"]: r["modeles"] for r in study.models_of(nodes, scopes).collect()}
    assert got[62] == ["local"] and got[26] == ["e-commerce", "local"] and len(got[1]) == 5
    row = study.states_by(nodes.withColumn("g", F.lit(1)), "g").first()
    assert (row["a_faire"], row["fait"], row["hors_perimetre"], row["total"]) == (1, 1, 1, 3)
    body = study.node_projection(nodes.where("id = 1"), ["id"], ["etat"]).first()
    assert body["body"] == '{"id":1}' and body["missing"] == []
    r = spark.range(1).select(study.reading(F.lit("a 3 x 10 ; b 4,5 x 20; c")), study.reading(F.lit("one; two"))).first()
    assert tuple(r[0]) == (3, 7.5, 10.0, 20.0) and r[1] is None
    assert study.content_rows(spark.createDataFrame([('{"3": "x", "k": "y"}',)], "body string")).where("id = 3").count() == 1


def test_metrics(spark):
    f = spark.createDataFrame
    themes = f([("a",)] * 7 + [("b",)] + [("c",)] + [("d",)], "t string")
    assert grid.theme_concentration(themes, "t").first()["value"] == 0.9
    assert grid.theme_concentration(themes.where("false"), "t").first()["value"] is None
    assert not grid.share_meeting(f([(1,), (2,)], "x int"), F.col("x") > 1, least=0.7).first()["ok"]
    assert grid.enough(f([("a",), ("a",)], "x string"), 2, "x").first()["ok"] is False
    q = f([("a", 12), ("b", 3), ("c", 20)], "query string, position int")
    assert [r[0] for r in grid.hidden_queries(q, q, f([("c",)], "query string")).collect()] == ["a"]
    pages = f([("m", 1), ("m", 1), ("n", 3), ("o", 1)], "query string, depth int")
    assert {r[0] for r in grid.one_page_each(pages, "query", "depth").collect()} == {"m", "n"}
    money = f([(i, 100 - i, i < 2, i) for i in range(20)], "id int, links int, money boolean, depth int")
    assert grid.money_pages_in_top_decile(money, "links", "money").first()["ok"]
    assert grid.money_depth(money, "depth", "money").first()["deep_money_pages"] == 0
    assert grid.long_tail(f([(5,), (5,), (90,)], "clicks int"), "clicks").first()["state"] == "dependent"
    assert grid.rate_gaps(f([("1", 0.1), ("1", 0.1), ("1", 0.02)], "band string, rate double"), "band", "rate").count() == 1
    words = f([(1, "a b c d e f".split()), (2, "a b c d e z".split()), (3, [])], "id int, w array<string>")
    assert {r["id"]: r["value"] for r in grid.unique_content(words, "id", "w").collect()} == {1: 0.5, 2: 0.5}
    chains = f([(1, ["a"]), (2, ["a", "b", "a"]), (3, ["a", "b", "c"])], "id int, c array<string>")
    assert {r["id"]: r["loop"] for r in grid.chain_faults(chains, "c").collect()} == {2: True, 3: False}
    nap = f([(1, "12-34"), (1, "1234"), (2, "1"), (2, "2")], "id int, tel string")
    assert [r["id"] for r in grid.divergent(nap, "id", ["tel"]).collect()] == [2]
    assert grid.citation_rate(f([("a", True), ("a", False), ("b", True), ("b", True)], "q string, cited boolean"), "q", "cited").first()["rate"] == 0.75
    urls = f([("/a",), ("/b",)], "url string")
    assert [r[0] for r in grid.useless_pages(urls, urls.where("url = '/a'"), urls.where("false"), urls.where("false")).collect()] == ["/b"]
    answers = f([("## What?\n\none two three\n",), ("## No\n\nx",)], "t string")
    assert [r["answer_words"] for r in grid.answer_length(answers, "t").collect()] == [3, None]
