from __future__ import annotations

import duckdb
import pytest

from demandpanel.llm import url_filter as uf

PAGES = "page_id long, url string, html string"
CASES = {
    "http://a.com/x": ("a.com", "/x", "com/", "allow"),
    "HTTP://WWW.Example.COM/en/1?q=/en/#t": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "https://m.example.com/en/7": ("m.example.com", "/en/7", "example.com/en/", "block"),
    "https://b.www.example.com/en/": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
    "https://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "https://x.net/esx": ("x.net", "/esx", None, None),
    "https://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "https://anet/fr/": ("anet", "/fr/", None, None),
    "https://a.com": ("a.com", "", None, None),
    "https://a.com?x=/": ("a.com", "", None, None),
    "https://u:p@É.com:80/a": ("u:p@É.com:80", "/a", None, None),
    "x://y://z.com/q": ("y:", "//z.com/q", None, None),
    "a.com/x": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "http:///en/": ("", "/en/", None, None),
    "https://line\nbreak.com/a\nb?c": ("line\nbreak.com", "/a\nb", "com/", "allow"),
}


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(CASES)], PAGES)
    got = {r["page_id"]: r for r in uf.judge(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(CASES.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def frame(spark):
    rows = [(i, f"https://{'good-' if i % 2 else 'bad-'}site{i % 40}.{'com' if i % 2 else 'net/es'}/{'cat' if i % 2 else 'win'}{i % 90}", "h") for i in range(400)]
    rows += [(1000, "https://good-cat.org/cat7", "h"), (1001, "https://bad-win.org/win7", "h"), (1002, "https://" + "a" * 5000 + ".org/", "h"), (1003, None, None)]
    rows += [(2000 + i, "https://hot.org/cat", "h") for i in range(300)]
    return spark.createDataFrame(rows, PAGES)


def test_the_model_tells_likely_urls_apart_and_sql_agrees(spark):
    pages = frame(spark)
    out = uf.judge(pages).toPandas().sort_values("page_id").reset_index(drop=True)
    said = out.set_index("page_id")
    assert said.loc[1000, "score"] > said.loc[1001, "score"] and said.loc[1003, "score"] == 0 and said.loc[1001, "verdict"] == "block"
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    sql = con.execute(uf.judge_sql()).df().sort_values("page_id").reset_index(drop=True)
    for c in ("page_id", "host", "path", "verdict"):
        assert out[c].tolist() == sql[c].tolist()


def test_models_keep_every_ngram(spark):
    pages = frame(spark)
    known = pages.filter("url LIKE '%.com%' OR url LIKE '%.net%'").selectExpr("url", "IF(url LIKE '%.com%', 'allow', 'block') AS verdict", "1L AS n")
    seen = set()
    for row in known.collect():
        marked = uf.OPEN + row["url"].lower() + uf.CLOSE
        seen |= {marked[i - n:i] for i in range(2, len(marked) + 1) for n in range(1, min(uf.ORDERS, i) + 1)}
    assert {r["gram"] for r in uf.model(known).collect()} == seen


def test_nothing_to_learn_from_and_empty(spark):
    rows = [(1, "https://a.org/x", "h"), (1, "https://a.org/x", "h"), (None, "ftp://b.org", None)]
    out = uf.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == 3 and {r["verdict"] for r in out} == {"allow"} and {r["score"] for r in out} == {0.0}
    assert uf.judge(spark.createDataFrame([], PAGES)).collect() == []


def test_allowed_keeps_rows_as_they_are(spark):
    pages = frame(spark).withColumnRenamed("html", "host")
    left = uf.allowed(pages)
    assert left.columns == pages.columns
    judged = {r["page_id"] for r in uf.judge(pages).filter("verdict = 'allow'").collect()}
    assert {r["page_id"] for r in left.collect()} == judged


@pytest.mark.parametrize("text,says", [("net/es/", "block"), ("com/", "allow")])
def test_ties_of_equal_rules_go_to_the_first(spark, text, says):
    url = f"https://x.{text}y"
    row = spark.range(1).selectExpr(f"'{url}' AS u")
    host, path = uf.host_path(row["u"])
    rule, verdict = uf.ruled(host, path)
    assert tuple(row.select(rule, verdict).first()) == (text, says)
