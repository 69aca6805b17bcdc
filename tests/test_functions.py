import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillflow.functions import backoff, backoff_column, canonical, driver_key, parse_query, parse_uri, query_params, uri_fragment, uri_struct, with_retry
from quillflow.functions.uri import cut_uri
from quillflow.model import DEFAULT_POLICY, Policy, Retry


def test_uri_parts():
    u = parse_uri("jsonl://./file.jsonl?batchSize=5#part")
    assert (u.scheme, u.host, u.path, u.query, u.fragment) == ("jsonl", "", "./file.jsonl", {"batchSize": "5"}, "part")
    u = parse_uri("http://localhost:7000/in?path=/chapter")
    assert (u.host, u.path, u.query) == ("localhost:7000", "/in", {"path": "/chapter"})
    assert parse_uri("jsonl://dir/file.jsonl").file_path() == "dir/file.jsonl"
    assert parse_uri("jsonl:///a/b").file_path() == "/a/b"
    assert parse_uri("parquet:/a/b").path == "/a/b"
    with pytest.raises(ValueError):
        parse_uri("not-a-uri")


def test_query_keeps_equal_signs_and_decodes():
    assert parse_query("a=b=c&d=%20&=x&e") == {"a": "b=c", "d": " ", "e": ""}


def test_uri_columns(spark):
    df = spark.createDataFrame([("https://h.x/p/q?a=1&b=2=3&=z&c#f",), ("none",)], "u string")
    rows = df.select(uri_struct(F.col("u")).alias("s"), query_params(uri_struct(F.col("u"))["query"]).alias("q")).collect()
    assert tuple(rows[0].s) == ("https", "h.x", "/p/q", "a=1&b=2=3&=z&c")
    assert [tuple(x) for x in rows[0].q] == [("a", "1"), ("b", "2=3"), ("c", "")]
    assert tuple(rows[1].s) == ("", "", "", "") and rows[1].q == []


@pytest.mark.parametrize(("strategy", "waits"), [("fixed", [1000] * 4), ("linear", [1000, 2000, 3000, 4000]), ("exp", [1000, 2000, 4000, 8000]), (None, [1000] * 4)])
def test_backoff(spark, strategy, waits):
    assert [backoff(strategy, 1000, k) for k in range(4)] == waits
    rows = spark.range(4).select(backoff_column(F.lit(strategy), F.lit(1000), F.col("id")).alias("w")).orderBy("id").collect()
    assert [r.w for r in rows] == waits


@given(st.integers(0, 5), st.integers(0, 8))
def test_attempts_are_bounded(most, failures):
    made, slept = [], []

    def call():
        made.append(1)
        if len(made) <= failures:
            raise OSError("x")
        return "ok"

    if failures <= most:
        assert with_retry(call, Retry(most, 10, "exp"), slept.append) == ("ok", failures + 1)
    else:
        with pytest.raises(OSError) as e:
            with_retry(call, Retry(most, 10, "exp"), slept.append)
        assert e.value.attempts == most + 1
    assert len(made) == min(failures, most) + 1
    assert slept == [0.01 * 2**k for k in range(len(slept))]


def test_policies_merge_by_field():
    p = Policy(Retry(max=5)).over(Policy(Retry(3, 50, "linear"), "skip-item")).over(DEFAULT_POLICY)
    assert p == Policy(Retry(5, 50, "linear"), "skip-item")
    assert Policy().over(DEFAULT_POLICY) == DEFAULT_POLICY


def test_keys_do_not_depend_on_order():
    assert driver_key("t", "1", {"a": 1, "b": 2}) == driver_key("t", "1", {"b": 2, "a": 1})
    assert driver_key("t", "1", {"a": 1}) != driver_key("t", "2", {"a": 1})
    assert canonical({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'


@given(st.text("aZ9+-.:/?#=&% é\n", max_size=14))
def test_uri_parts_put_together_again(raw):
    parts = cut_uri(raw)
    if parts is None:
        with pytest.raises(ValueError):
            parse_uri(raw)
        return
    scheme, host, path, query, fragment = parts
    assert scheme[0].isalpha() and not set(host) & set("/?#") and not set(path) & set("?#") and "#" not in query
    forms = [f"{scheme}:{slashes}{host}{path}" for slashes in ("", "//")]
    assert raw in {f + q + h for f in forms for q in {f"?{query}", ""} for h in {f"#{fragment}", ""}}


def test_uri_columns_equal_the_driver(spark):
    marks = ["a", "Z9", "+", ".", ":", "/", "//", "?", "#", "é", "..", "\n"]
    rng = random.Random(5)
    uris = [*("".join(rng.choices(marks, k=rng.randint(0, 8))) for _ in range(400)), *(f"s://{''.join(rng.choices(marks, k=5))}" for _ in range(200)), "x:y", "s://../p", "s://.../p"]
    df = spark.createDataFrame([(u,) for u in uris] + [(None,)], "u string").select("u", uri_struct(F.col("u")).alias("s"), uri_fragment(F.col("u")).alias("f"))
    for r in df.where("u is not null").collect():
        want = cut_uri(r.u) or ("",) * 4
        assert tuple(r.s) == want[:4] and r.f == r.u.partition("#")[2], r
