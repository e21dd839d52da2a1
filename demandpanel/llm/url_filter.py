"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule allows or blocks teach two variable-order Markov models. A
character's context is used as far as it was seen: every n-gram is kept,
so the models grow with the input. Probabilities are smoothed from order to order
(Dirichlet). An n-gram's value is what it adds to the
log-likelihood difference over its shorter form, so a URL's difference is the sum
over the n-grams it holds, divided by its length. The threshold maximises the
mean of both classes' hit rates on a held-out fifth of the ruled URLs.

All work is DataFrame functions. URLs are scored once however often they occur.

Defined results: a null URL is empty; without ``://`` host and path are empty; an
empty URL scores 0; with no ruled URLs the threshold is 0 and every score 0, so
the verdict is allow; of rules of equal length the first in order wins; rows that
repeat get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import staged

#: (rule, verdict) of the given table's rules.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDERS = 5
#: Pseudo counts of the shorter context, and of each symbol at order one.
PRIOR, SYMBOL = 4.0, 0.5
#: Steps of the threshold in one unit of the difference per character.
STEPS = 200
OPEN, CLOSE = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each n-gram of each URL, marks of both ends included; the opening mark alone is left out."""
    marked = F.concat(F.lit(OPEN), F.translate("url", _UPPER, _LOWER), F.lit(CLOSE))
    at = urls.select(*keep, marked.alias("u")).select(*keep, "u", F.explode(F.sequence(F.lit(2), F.length("u"))).alias("i"))
    upto = F.transform(F.sequence(F.lit(1), F.least(F.lit(ORDERS), F.col("i"))), lambda n: F.substr(F.col("u"), F.col("i") - n + 1, n))
    return at.select(*keep, F.explode(upto).alias("gram"))


def _is_held(url: str = "url") -> Column:
    return F.conv(F.substring(F.md5(F.col(url)), 1, 4), 16, 10).cast("long") % 5 == 0


def model(known: DataFrame) -> DataFrame:
    """(gram, value) from URLs (url, verdict, n): what each n-gram adds to log P(accepted) - log P(rejected)."""
    good, bad = F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0), F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)
    counts = _grams(known.select("url", good.alias("good"), bad.alias("bad")), "good", "bad").groupBy("gram").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("order", F.length("gram"))
    totals = known.agg(F.coalesce(F.sum(good * (F.length("url") + 1)), F.lit(0)).alias("all_good"),
                       F.coalesce(F.sum(bad * (F.length("url") + 1)), F.lit(0)).alias("all_bad"),
                       F.coalesce(F.sum(good), F.lit(0)).alias("urls_good"), F.coalesce(F.sum(bad), F.lit(0)).alias("urls_bad")).first()
    kept = staged(counts)
    symbols = kept.filter("order = 1").count()

    def first(n: str, every: int) -> Column:
        return (F.col(n) + SYMBOL) / F.lit(every + SYMBOL * symbols)

    level = kept.filter("order = 1").select("gram", first("good", totals["all_good"]).alias("pg"), first("bad", totals["all_bad"]).alias("pb"))
    levels = [level.select("gram", F.log(F.col("pg") / F.col("pb")).alias("value"))]
    opening = kept.sparkSession.range(1).select(F.lit(OPEN).alias("before"), F.lit(totals["urls_good"]).alias("cg"), F.lit(totals["urls_bad"]).alias("cb"))
    for order in range(2, ORDERS + 1):
        context = kept.filter(F.col("order") == order - 1).select(F.col("gram").alias("before"), F.col("good").alias("cg"), F.col("bad").alias("cb"))
        shorter = level.select(F.col("gram").alias("after"), F.col("pg").alias("sg"), F.col("pb").alias("sb"))
        own = kept.filter(F.col("order") == order).withColumns({"before": F.expr(f"left(gram, {order - 1})"), "after": F.expr(f"right(gram, {order - 1})")})
        context = context.unionByName(opening) if order == 2 else context
        joined = own.join(context, "before").join(shorter, "after")
        level = joined.select("gram", ((F.col("good") + PRIOR * F.col("sg")) / (F.col("cg") + PRIOR)).alias("pg"),
                              ((F.col("bad") + PRIOR * F.col("sb")) / (F.col("cb") + PRIOR)).alias("pb"), "sg", "sb")
        levels.append(level.select("gram", (F.log(F.col("pg") / F.col("pb")) - F.log(F.col("sg") / F.col("sb"))).alias("value")))
        level = level.select("gram", "pg", "pb")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return staged(out)


def scores(urls: DataFrame, values: DataFrame) -> DataFrame:
    """(url, score) of distinct URLs: log-likelihood difference for each character."""
    # The planner broadcasts few values; of many, the adaptive join splits the n-grams that most URLs hold.
    return _grams(urls.select("url").filter("url <> ''"), "url").join(values, "gram").groupBy("url").agg(F.sum("value").alias("total")).select(
        "url", (F.col("total") / (F.length("url") + 1)).alias("score"))


def threshold(scored: DataFrame) -> float:
    """What maximises the sum of both hit rates over (score, verdict, n), halfway to the next lower score; 0 without examples."""
    steps = scored.select(F.floor(F.col("score") * STEPS).alias("step"), F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0).alias("good"),
                          F.when(F.col("verdict") == "block", F.col("n")).otherwise(0).alias("bad")).groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    above, every = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    gain = F.sum("good").over(above) / F.sum("good").over(every) - F.sum("bad").over(above) / F.sum("bad").over(every)
    lower = F.lead("step").over(Window.orderBy(F.desc("step"))) + 1
    best = steps.select("step", gain.alias("gain"), F.coalesce(lower, F.col("step")).alias("lower")).filter("gain IS NOT NULL").orderBy(F.desc("gain"), "step").first()
    return (best["step"] + best["lower"]) / 2 / STEPS if best else 0.0


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row; score is null where a rule decides."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    distinct = pages.select(url.alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    host, path = host_path(F.col("url"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    urls = staged(distinct.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": says}))
    known = urls.filter("rule IS NOT NULL")
    values = model(known.filter(~_is_held()))
    wanted = urls.filter(F.col("rule").isNull() | _is_held())
    scored = staged(wanted.join(scores(wanted, values).withColumnRenamed("url", "u"), F.col("url") == F.col("u"), "left").select(
        "url", "verdict", "rule", "n", F.coalesce("score", F.lit(0.0)).alias("score")))
    least = threshold(scored.filter("rule IS NOT NULL"))
    learned = scored.filter("rule IS NULL").select("url", "score")
    judged = urls.join(learned, "url", "left").withColumn(
        "verdict", F.coalesce("verdict", F.when(F.col("score") >= least, "allow").otherwise("block")))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("_url"))
    return rows.join(judged, rows["_url"] == judged["url"]).select("page_id", "host", "path", "rule", "verdict", "score")


def allowed(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, unchanged."""
    good = judge(pages, rules, url_col, url_col).filter("verdict = 'allow'").select(F.coalesce("page_id", F.lit("")).alias("__url")).distinct()
    return pages.join(good, F.coalesce(pages[url_col], F.lit("")) == good["__url"], "left_semi")


def judge_sql() -> str:
    """The same verdicts in DuckDB."""
    rules = ", ".join(f"('{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{v}')" for t, v in RULES)
    held = "CAST('0x' || substr(md5(url), 1, 4) AS INT) % 5 = 0"
    kept = "SELECT g.*, length(gram) AS ord FROM counts g"
    levels = f"l1 AS (SELECT gram, (kept.good + {SYMBOL}) / (all_good + {SYMBOL} * s) AS pg, (kept.bad + {SYMBOL}) / (all_bad + {SYMBOL} * s) AS pb, NULL::DOUBLE AS sg, NULL::DOUBLE AS sb FROM kept, tot, (SELECT count(*) AS s FROM kept WHERE ord = 1) WHERE ord = 1)"
    for o in range(2, ORDERS + 1):
        levels += f""", l{o} AS (SELECT k.gram, (k.good + {PRIOR} * s.pg) / (c.good + {PRIOR}) AS pg, (k.bad + {PRIOR} * s.pb) / (c.bad + {PRIOR}) AS pb, s.pg AS sg, s.pb AS sb
            FROM kept k JOIN ctx c ON c.gram = left(k.gram, {o - 1}) JOIN l{o - 1} s ON s.gram = right(k.gram, {o - 1}) WHERE k.ord = {o})"""
    values = "SELECT gram, ln(pg / pb) AS value FROM l1" + "".join(f" UNION ALL SELECT gram, ln(pg / pb) - ln(sg / sb) FROM l{o}" for o in range(2, ORDERS + 1))
    lower = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE rules(rule, name, start, says) AS (VALUES {rules}),
    d AS (SELECT coalesce(url, '') AS url, count(*) AS n FROM pages GROUP BY 1),
    r AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM d),
    h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
    p AS (SELECT url, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    u AS (SELECT p.*, (SELECT max_by([rule, says], length(rule)) FROM rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS hit FROM p),
    k AS (SELECT *, hit[1] AS rule, hit[2] AS says FROM u),
    e AS (SELECT url, n, says, chr(2) || {lower} || chr(3) AS t FROM k),
    i AS (SELECT url, n, says, t, unnest(range(2, length(t) + 1)) AS i FROM e),
    g AS (SELECT url, n, says, substr(t, i - o + 1, o) AS gram FROM i, range(1, {ORDERS + 1}) AS r(o) WHERE o <= i),
    counts AS (SELECT gram, sum(CASE WHEN says = 'allow' THEN n ELSE 0 END) AS good, sum(CASE WHEN says = 'block' THEN n ELSE 0 END) AS bad FROM g WHERE says IS NOT NULL AND NOT {held} GROUP BY 1),
    tot AS (SELECT coalesce(sum(CASE WHEN says = 'allow' THEN n * (length(url) + 1) END), 0) AS all_good, coalesce(sum(CASE WHEN says = 'block' THEN n * (length(url) + 1) END), 0) AS all_bad,
            coalesce(sum(CASE WHEN says = 'allow' THEN n END), 0) AS good, coalesce(sum(CASE WHEN says = 'block' THEN n END), 0) AS bad FROM k WHERE says IS NOT NULL AND NOT {held}),
    kept AS ({kept}), ctx AS (SELECT gram, good, bad FROM kept UNION ALL SELECT chr(2), good, bad FROM tot),
    {levels}, v AS ({values}),
    s AS (SELECT k.url, any_value(k.says) AS says, any_value(k.n) AS n, CASE WHEN k.url = '' THEN 0 ELSE coalesce(sum(v.value), 0) / (length(k.url) + 1) END AS score FROM k JOIN g USING (url) LEFT JOIN v USING (gram) GROUP BY k.url),
    b AS (SELECT floor(score * {STEPS}) AS step, sum(CASE WHEN says = 'allow' THEN n ELSE 0 END) AS good, sum(CASE WHEN says = 'block' THEN n ELSE 0 END) AS bad FROM s WHERE says IS NOT NULL AND {held} GROUP BY 1),
    c AS (SELECT step, coalesce(lead(step) OVER (ORDER BY step DESC) + 1, step) AS lower_, sum(good) OVER w / sum(good) OVER () - sum(bad) OVER w / sum(bad) OVER () AS gain FROM b WINDOW w AS (ORDER BY step DESC ROWS UNBOUNDED PRECEDING)),
    th AS (SELECT coalesce((SELECT (step + lower_) / 2 FROM c WHERE gain IS NOT NULL AND NOT isnan(gain) ORDER BY gain DESC, step LIMIT 1), 0) / {STEPS} AS least)
    SELECT page_id, host, path, rule, coalesce(k.says, CASE WHEN s.score >= th.least THEN 'allow' ELSE 'block' END) AS verdict
    FROM pages JOIN k ON k.url = coalesce(pages.url, '') JOIN s ON s.url = k.url, th"""
