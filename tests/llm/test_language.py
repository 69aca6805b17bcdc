import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillflow.llm import language as L

TEXTS = {"en": "the thing that was with them and this other one", "de": "und nicht der schöne große auch sich für eine", "fr": "être que les avec où dans une élève ça"}


def model():
    return L.Model.fit([(f"{t} {t[k:]}", lang) for lang, t in TEXTS.items() for k in range(12)])


def reference(m, texts, said, hosts):
    """The posterior in plain Python."""
    n = len(m.languages)
    ll = m.score(pa.array(texts, pa.string()))
    for i, s in enumerate(said):
        if s in m.languages[:-1] or s == L.UNKNOWN:
            ll[i] += np.log((1 - L.DECLARED) / (n - 2))
            ll[i, m.languages.index(s)] += math.log(L.DECLARED / ((1 - L.DECLARED) / (n - 2)))
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            ll[i], ll[i, -1] = -1e9, 0
    own = np.exp(ll - ll.max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    p = (own.sum(axis=0) + 1) / (len(texts) + n)
    p[:-1] *= (1 - L.UNKNOWN_PRIOR) / p[:-1].sum()
    p[-1] = L.UNKNOWN_PRIOR
    parent = (own.sum(axis=0) + L.SUFFIX_WEIGHT * p) / (len(texts) + L.SUFFIX_WEIGHT)
    out = []
    for i, h in enumerate(hosts):
        host = own[[j for j, x in enumerate(hosts) if x == h]].sum(axis=0) - own[i]
        f = ll[i] + np.log(np.maximum(host, 0) + L.HOST_WEIGHT * parent)
        f = np.exp(f - f.max())
        out.append((m.languages[int(f.argmax())], f.max() / f.sum()))
    return out


def test_equals_plain_python(spark):
    m = model()
    texts = ["the thing and that", "schöne große", "élève ça", "a", "12 !!", "", None, "und the", "NICHT DIE", "x"]
    said = ["en", "fr", None, "de", "en", "en", "en", "xx", "", "fr"]
    hosts = ["h", "h", "h", "k", "k", "k", "k", "h", "k", "k"]
    df = spark.createDataFrame(list(zip(range(10), texts, said, hosts, strict=True)), "i int, text string, lang string, source string")
    rows = L.identify(df, m, text=F.col("text"), declared=F.col("lang"), host=F.col("source")).orderBy("i").collect()
    for r, (lang, p) in zip(rows, reference(m, texts, said, hosts), strict=True):
        assert r._language == lang and r._probability == pytest.approx(p, abs=1e-6)
        assert r._kept == (lang != L.UNKNOWN and p >= 0.5)
    assert [r._language for r in rows[4:7]] == ["und"] * 3


def test_host_and_suffix_decide_short_texts(spark):
    rows = [(i, TEXTS["de" if i % 2 else "fr"], None, f"{'b' if i % 2 else 'a'}.example") for i in range(40)] + [(100, "x", None, "a.example"), (101, "x", None, "b.fr"), (102, "x", None, "b.de")]
    df = spark.createDataFrame(rows, "i int, text string, lang string, source string")
    got = {r.i: r._language for r in L.identify(df, model(), text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()}
    assert got[100] == "fr" and got[101] == "fr" and got[102] == "de"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    silent = docs.withColumn("said", F.lit(None).cast("string"))
    m = L.fit(docs.where("doc_id % 2 = 0"), F.col("text"), F.col("lang"))
    held = silent.where("doc_id % 2 = 1 and n_chars > 50")
    got = L.identify(held, m, text=F.col("text"), declared=F.col("said"), host=F.col("said")).select((F.col("_language") == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.95


def test_rare_languages_have_a_model_at_any_size(spark):
    """Few labelled rows among many, long texts only, and many copies of one text."""
    many = spark.range(30_000).select(F.concat(F.lit(TEXTS["en"] + " "), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 3 == 0, "en").alias("l"))
    copies = spark.range(30_000).select(F.lit(TEXTS["de"]).alias("t"), F.lit("de").alias("l"))
    rare = [(f"{TEXTS['fr']} {i} " * 1000, "fr") for i in range(5)] + [(f"nicht {i}", "de") for i in range(4)] + [("che", "it")] * 4
    m = L.fit(many.union(copies).union(spark.createDataFrame(rare, "t string, l string")), F.col("t"), F.col("l"))
    assert m.languages == ["de", "en", "fr", L.UNKNOWN]
    assert [m.languages[i] for i in m.score(pa.array([TEXTS["fr"], "nicht nicht", TEXTS["en"]])).argmax(axis=1)] == ["fr", "de", "en"]


def test_shapes(frame, spark):
    m = model()
    columns = dict(text=F.col("text"), declared=F.col("lang"), host=F.col("source"))
    assert L.identify(frame([]), m, **columns).collect() == []
    odd = frame([(1, "the thing"), (1, "the thing")]).withColumn("_language", F.lit("mine"))
    out = L.identify(odd, m, **columns)
    assert out.columns.count("_language") == 1 and {r._language for r in out.collect()} == {"en"} and out.count() == 2
    long = frame([(1, (TEXTS["de"] + " ") * 20_000)])
    assert L.identify(long, m, **columns).first()._language == "de"
    none = L.Model.fit([])
    assert {r._language for r in L.identify(frame(["x", None]), none, **columns).collect()} == {"und"}


def test_own_labels_are_no_evidence(spark):
    """A text that the model was fitted on is judged without its label; others' declarations still count."""
    rows = [(i, f"{TEXTS['en']} {i}", "de" if i == 3 else "en") for i in range(9)] + [(i, f"{TEXTS['de']} {i}", "de") for i in range(10, 16)]
    docs = spark.createDataFrame([(*r, "h") for r in rows], "doc_id int, text string, lang string, source string")
    m = L.fit(docs, F.col("text"), F.col("lang"))
    assert len(m.fitted) == len(rows)
    both = [{r.doc_id: r._probability for r in L.identify(docs, m, text=F.col("text"), declared=F.col("lang"), host=F.col("source"), labelled=x).collect()} for x in (True, False)]
    silent = {r.doc_id: r._probability for r in L.identify(docs.withColumn("lang", F.lit("")), m, text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()}
    assert both[0] == pytest.approx(silent) and both[1] != silent


def test_pages_by_markup_suffix_and_host(spark, tmp_path):
    """pages_language against the plain fusion, on pages whose markup, suffix and host say something."""
    docs = spark.createDataFrame([(f"{t} {t[k:]}", lang) for lang, t in TEXTS.items() for k in range(12)], "text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pages = [
        ("http://a.example/1", '<html lang="fr-CA"><body>12 x</body></html>'),
        ("http://a.example/2", f"<html><p>{TEXTS['fr']}</p><script>the the the the that was with</script></html>"),
        ("http://b.de/1?x", "<p>x"),
        ("https://b.de:80/2", f"<!-- the thing -->{TEXTS['de']}"),
        ("http://c.at/1", "<html lang=en><p>x</p>"),
        (None, f"<b>{TEXTS['en']}</b>"),
        ("http://d.example/", None),
    ]
    spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id int, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.language, r.probability, r.kept) for r in L.pages_language(spark, str(tmp_path)).orderBy("page_id").collect()]
    m = L.fit(docs, F.col("text"), F.col("lang"))
    strip = lambda h: h and re.sub("<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", h))
    own = m.score(pa.array([strip(h) for _, h in pages], pa.string()))
    n = len(m.languages)
    for i, (said, spoken) in enumerate([("fr", ""), ("", ""), ("", "de"), ("", "de"), ("en", "de"), ("", ""), ("", "")]):
        for x, sure in ((said, L.DECLARED), (spoken, L.SUFFIX)):
            if x:
                own[i] += math.log((1 - sure) / (n - 2))
                own[i, m.languages.index(x)] += math.log(sure / ((1 - sure) / (n - 2)))
    own[6], own[6, -1] = -1e9, 0
    hosts = ["a.example", "a.example", "b.de", "b.de:80", "c.at", "", "d.example"]
    last = ["example", "example", "de", "de", "at", "", "example"]
    share = np.exp(own - own.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    p = (share.sum(axis=0) + 1) / (len(pages) + n)
    p[:-1] *= (1 - L.UNKNOWN_PRIOR) / p[:-1].sum()
    p[-1] = L.UNKNOWN_PRIOR
    for i in range(len(pages)):
        parent = share[[j for j, x in enumerate(last) if x == last[i]]].sum(axis=0) + L.SUFFIX_WEIGHT * p
        parent /= parent.sum()
        host = share[[j for j, x in enumerate(hosts) if x == hosts[i]]].sum(axis=0) - share[i]
        f = own[i] + np.log(np.maximum(host, 0) + L.HOST_WEIGHT * parent)
        f = np.exp(f - f.max())
        assert got[i][0] == m.languages[int(f.argmax())] and got[i][1] == pytest.approx(f.max() / f.sum(), abs=1e-3), i
    assert [x[0] for x in got[:4]] == ["fr", "fr", "de", "de"] and got[6] == ("und", got[6][1], False)


def test_many_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    from quillflow.llm import graph

    rows = [(i, TEXTS["de" if i % 2 else "fr"] if i % 5 else "x", "h" if i % 3 else f"h{i}") for i in range(300)] + [(300, None, None)]
    df = spark.createDataFrame(rows, "i int, text string, source string")
    ask = lambda: {r.i: (r._language, round(r._probability, 9)) for r in L.identify(df, model(), text=F.col("text"), declared=F.lit(""), host=F.col("source")).collect()}
    want = ask()
    monkeypatch.setattr(L, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(graph, "SPLIT_ROWS", 20)
    assert ask() == want and len(want) == 301


def test_chosen_columns_are_scored_once_with_the_same_result(spark, monkeypatch):
    from quillflow.llm import graph

    rows = [(i, TEXTS["de" if i % 2 else "fr"] if i % 5 else "x", "de", "h" if i % 3 else f"h{i}") for i in range(120)] + [(300, None, None, None), (7, "12", "fr", "h")]
    df = spark.createDataFrame(rows, "i int, text string, lang string, source string").repartition(3)

    def ask(**named):
        found = L.identify(df, model(), text=F.col("text"), declared=F.col("lang"), host=F.col("source"), **named)
        return sorted((r.i, r._language, round(r._probability, 9), r._kept) for r in found.collect())

    want = ask()
    assert ask(columns=["i"]) == want and L.identify(df, model(), text=F.col("text"), declared=F.col("lang"), host=F.col("source"), columns=["i"]).columns == ["i", "_language", "_probability", "_kept"]
    monkeypatch.setattr(L, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(graph, "SPLIT_ROWS", 20)
    assert ask(columns=["i"]) == want
