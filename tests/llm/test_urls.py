import duckdb

from quillflow.llm import urls as R


def test_parts():
    assert R.split_url("HTTP://A.Com:80/P?q#f") == ("a.com:80", "/P")
    assert R.split_url("x://h?q/a") == ("h", "") and R.split_url("x://h#/a") == ("h", "")
    assert R.split_url("no host") == ("", "") and R.split_url(None) == ("", "")


def brute(url):
    low, weights = (url or "").lower(), {**dict.fromkeys(R.SOFT, 1), **dict.fromkeys(R.STRICT, R.LIMIT)}
    alnum = set("abcdefghijklmnopqrstuvwxyz0123456789")
    hits = {t for t in weights for i in range(len(low)) if low.startswith(t, i) and not (i and low[i - 1] in alnum) and low[i + len(t) : i + len(t) + 1] not in alnum}
    host, path = R.split_url(url)
    rules = [(len(r), r, v) for v, r in R.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if rules:
        return max(rules)[1:]
    return None, "block" if sum(weights[t] for t in hits) >= R.LIMIT else "allow"


URLS = [
    "https://www.example.com/en/1", "https://example.com/en/1", "https://m.example.com/en", "https://m.example.com/en/", "https://a.net/es/x", "https://net/fr/", "https://xnet/fr/",
    "http://com", "http://com/", "http://spam-farm.example.org/", "http://spam.example.org/", "http://spamfarm.org/", "http://x.org/casino", "http://x.org/casinos", "http://x.org/free?a=free",
    "http://x.org/free?a=WIN", "free win", None, "", "://", "http://é.org/bet-é-win", "http://x.org/xxx",
]


def test_equals_brute_force_and_sql(spark):
    rows = [(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "h", 1), (0, URLS[0], "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int").repartition(3)
    got = R.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.rule, r.verdict) == brute(URLS[r.page_id]), URLS[r.page_id]
    con = duckdb.connect()
    pages = df.select("page_id", "url").toArrow()  # noqa: F841
    said = con.sql(R.ORACLE)
    key = lambda r: tuple(map(str, r))
    assert sorted(said.fetchall(), key=key) == sorted((tuple(r[c] for c in said.columns) for r in got), key=key)
    assert R.judge(df.limit(0)).collect() == []


def test_long_url_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/" + "x/" * 100_000 + "casino")], "page_id long, url string")
    assert R.judge(df, rules=()).first().verdict == "block" and R.judge(df, rules=(), strict=(), soft=()).first().verdict == "allow"


def test_terms_of_other_languages(spark):
    urls = {"http://a.org/kostenlos/lotto": "block", "http://a.org/kostenlos": "allow", "http://a.org/lottomann-kostenloses": "allow", "http://a.org/tragaperras": "block", "http://a.org/apuestas_gratis": "block", "http://a.org/gratis?x=gratis": "allow"}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {list(urls)[r.page_id]: r.verdict for r in R.judge(df).collect()} == urls
    assert not set(R.STRICT) & set(R.SOFT) and all(t.isalpha() and t.isascii() and t == t.lower() for t in R.STRICT + R.SOFT)
