"""Language identification by fusing evidence in Bayes' rule.

The posterior of each language multiplies a tempered byte-trigram likelihood of the
text, the chance of the declared markup language, the chance of the address suffix
and a prior of the host. Host priors come from a grouped aggregation of all rows'
own posteriors and are smoothed hierarchically: host towards suffix, suffix towards
the whole. One more class, ``und``, has a uniform text model and stands for no or
unknown language.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quillflow.llm import textops as T
from quillflow.llm.graph import spread_join
from quillflow.llm.staging import small_batches, stage, table

BUCKETS, TEMPER, UNKNOWN = 1 << 16, 3.0, "und"
#: Every language with LEAST_ROWS labelled rows or more has a text model, fitted on the first so many characters of at
#: most TRAIN_TEXTS distinct texts, shared equally between languages, yet up to LEAST_TEXTS of each.
TRAIN_TEXTS, LEAST_TEXTS, TRAIN_CHARS, LEAST_ROWS = 3000, 50, 20_000, 5
#: Chance that a declaration or suffix names the true language; strength of host and suffix smoothing; prior of ``und``.
DECLARED, SUFFIX, HOST_WEIGHT, SUFFIX_WEIGHT, UNKNOWN_PRIOR, LEAST_PROBABILITY = 0.9, 0.6, 20.0, 100.0, 0.001, 0.5
#: Hosts whose priors are broadcast at most (some 100 bytes each); more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
#: Languages that a country's address suffix speaks for (fixed values).
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "ie": "en", "it": "it", "pt": "pt", "nl": "nl"}
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The trigram bucket that starts at each byte; BUCKETS where none does. ASCII other than letters counts as a space."""
    data = _LETTER[data]
    if len(data) < 3:
        return np.full(len(data), BUCKETS, np.int32)
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data = data + np.where(upper, np.uint8(32), np.uint8(0))
    a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    out = np.full(len(data), BUCKETS, np.int32)
    key = ((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(16)
    blank = (b == 32) & ((a == 32) | (c == 32))
    out[:-2] = np.where(blank, BUCKETS, key)
    for back in (1, 2):  # none runs over a row's end
        at = off[1:] - back
        out[at[(at >= off[:-1])]] = BUCKETS
    return out


class Model:
    """Log likelihoods of trigrams by language, with ``und`` last.

    ``fitted`` has the hashes of the texts that it was fitted on, whose labels it knows.
    """

    def __init__(self, languages: list[str], weights: np.ndarray, fitted: frozenset[int] = frozenset()):
        self.languages, self.weights, self.fitted = languages, weights, fitted

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], known: set[str] | None = None) -> Model:
        """From (text, language) rows; the languages are ``known``, or those with LEAST_ROWS rows or more."""
        by: dict[str, list[str]] = {}
        for text, lang in rows:
            by.setdefault(lang, []).append(text)
        languages = sorted(x for x, texts in by.items() if (len(texts) >= LEAST_ROWS if known is None else x in known))
        weights = np.zeros((len(languages) + 1, BUCKETS + 1))
        for i, lang in enumerate(languages):
            n = np.ones(BUCKETS + 1) * 0.05
            for _, data, off in T.chunks(pa.array(by[lang])):
                n += np.bincount(trigrams(data, off), minlength=BUCKETS + 1)
            weights[i] = np.log(n / n[:-1].sum())
        weights[-1] = -np.log(BUCKETS)
        weights[:, -1] = 0
        return cls([*languages, UNKNOWN], (weights / TEMPER).astype(np.float32))

    def score(self, column: pa.Array) -> np.ndarray:
        """Rows by languages: the tempered log likelihood of each text; without letters all but ``und`` are ruled out."""
        out = np.full((len(column), len(self.languages)), -1e9)
        out[:, -1] = 0
        for at, data, off in T.chunks(column):
            key = trigrams(data, off)
            some = at + np.flatnonzero(T.segment_sum((_LETTER[data] != 32).astype(np.int64), off))
            for i, w in enumerate(self.weights):
                out[some, i] = T.segment_sum(w[key].astype(np.float64), off)[some - at]
        return out


def fit(docs: DataFrame, text: Column, label: Column) -> Model:
    """A model of every language with LEAST_ROWS labelled rows or more, from a bounded number of its distinct texts.

    Rows are counted by language over all data, so that a rare language has a model at
    any size. The texts with the lowest hashes are chosen, all of a rare language.
    """
    rows = docs.select(text.cast("string").alias("t"), label.cast("string").alias("l")).where("t is not null and l is not null and l <> ''").withColumn("h", F.xxhash64("t"))
    found = rows.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d")).where(F.col("n") >= LEAST_ROWS).collect()
    if not found:
        return Model.fit([])
    most = max(LEAST_TEXTS, TRAIN_TEXTS // len(found))
    # twice as many as wanted, as distinct texts are counted approximately
    lowest = {r.l: min((1 << 63) - 1, (2 * most << 64) // max(1, r.d) - (1 << 63)) for r in found}
    limit = F.create_map(*(F.lit(x) for kv in lowest.items() for x in kv))[F.col("l")]
    chosen = rows.where(F.col("h") <= limit).select("l", "h", F.substring("t", 1, TRAIN_CHARS).alias("t")).dropDuplicates(["l", "h"])
    chosen = chosen.withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("i") <= most)
    chosen = chosen.select("t", "l", "h").collect()
    model = Model.fit([(r.t, r.l) for r in chosen], set(lowest))
    model.fitted = frozenset(r.h for r in chosen)
    return model


def identify(
    docs: DataFrame, model: Model, *, text: Column, declared: Column, host: Column, labelled: bool = False, names: tuple[str, str, str] = ("_language", "_probability", "_kept"), columns: list[str] | None = None
) -> DataFrame:
    """``docs`` with three more columns, by default ``_language``, ``_probability``, ``_kept``; they replace columns of the same name.

    A row is kept unless its language is ``und`` or its probability is below one half.
    A text that is null, empty or without letters has no likelihood of its own and is
    ``und``. Null or unknown declarations and hosts are no evidence; if the model's
    labels are the declarations (``labelled``), neither is that of a text it was fitted
    on. With ``columns`` only those of ``docs`` come out; they and the scores are then
    written once, else every text is scored twice rather than written. Of languages with the same posterior the first in order wins. Texts count whole,
    a batch of rows is in memory at once. Rows that repeat count as often for their host.
    An empty table stays empty; other columns, whatever their names, pass through.
    """
    spark, n = docs.sparkSession, len(model.languages)
    small_batches(spark)
    tag = "_" + uuid.uuid4().hex[:8]
    own_columns = [c for c in (docs.columns if columns is None else columns) if c not in names]
    language, probability, kept = names
    names = [f"{tag}_{i}" for i in range(n)]
    address = F.lower(F.coalesce(host, F.lit("")))
    last = F.regexp_extract(address, r"\.([a-z]+)(?::\d+)?$", 1)
    spoken = F.coalesce(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[last], F.lit(""))
    said = F.regexp_extract(F.lower(F.coalesce(declared, F.lit(""))), "^[a-z]+", 0)
    if labelled and model.fitted:
        said = F.when(F.xxhash64(text.cast("string")).isin(*sorted(model.fitted)), F.lit("")).otherwise(said)
    own_rows = docs.columns if columns is None else own_columns
    rows = docs.select(*own_rows, text.cast("string").alias(tag + "_text"), said.alias(tag + "_said"), address.alias(tag + "_host"), F.when(last == "", F.lit("")).otherwise(last).alias(tag + "_last"), spoken.alias(tag + "_spoken"))
    shared = spark.sparkContext.broadcast((model.languages, model.weights))

    def scored(df: DataFrame) -> DataFrame:
        keep = [f for f in df.schema if f.name != tag + "_text"]
        place = [df.columns.index(f.name) for f in keep]
        at, said_at, spoken_at = (df.columns.index(tag + x) for x in ("_text", "_said", "_spoken"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(*shared.value)
            places = {x: i for i, x in enumerate(own.languages)}
            for batch in batches:
                ll = own.score(batch.column(at))
                empty = ll[:, 0] == -1e9 if n > 1 else np.ones(len(ll), bool)
                for column, sure in ((said_at, DECLARED), (spoken_at, SUFFIX)):
                    named = np.array([places.get(x, -1) for x in batch.column(column).to_pylist()], np.int64)
                    hit = np.flatnonzero(named >= 0)
                    ll[hit] += np.log((1 - sure) / max(1, n - 2))
                    ll[hit, named[hit]] += np.log(sure / ((1 - sure) / max(1, n - 2)))
                ll[empty] = -1e9
                ll[empty, -1] = 0
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in place), *(pa.array(ll[:, i]) for i in range(n))], [*(f.name for f in keep), *names])

        return df.mapInArrow(run, T_.StructType([*keep, *(T_.StructField(x, T_.DoubleType()) for x in names)]))

    top = lambda cols: F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])

    def shares(df: DataFrame) -> DataFrame:
        """Adds each row's posterior from its own evidence."""
        df = df.withColumn(tag + "_top", top(names))
        df = df.withColumns({f"{tag}_e{i}": F.exp(F.col(c) - F.col(tag + "_top")) for i, c in enumerate(names)})
        return df.withColumn(tag + "_z", F.expr(" + ".join(f"{tag}_e{i}" for i in range(n))))

    if columns is None:
        own = scored(rows.select(*(tag + x for x in ("_text", "_said", "_host", "_last", "_spoken"))))
    else:
        rows = own = stage(scored(rows), "scores")
    own = shares(own)
    rows = rows if columns is None else own
    sums = own.select(tag + "_host", tag + "_last", *(F.expr(f"{tag}_e{i} / {tag}_z").alias(f"s{i}") for i in range(n)))
    hosts = stage(sums.groupBy(tag + "_host", tag + "_last").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n))), "hosts")
    whole = hosts.agg(*(F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(n))).first()
    p = (np.array(whole) + 1) / (sum(whole) + n)
    p[:-1] *= (1 - UNKNOWN_PRIOR) / max(p[:-1].sum(), 1e-9) if n > 1 else 1
    p[-1] = UNKNOWN_PRIOR
    total = lambda x: " + ".join(f"{x}{i}" for i in range(n))
    parents = hosts.groupBy(tag + "_last").agg(*(F.sum(f"s{i}").alias(f"p{i}") for i in range(n)))
    parents = parents.select(tag + "_last", *(F.expr(f"(p{i} + {SUFFIX_WEIGHT * x}) / ({total('p')} + {SUFFIX_WEIGHT})").alias(f"{tag}_p{i}") for i, x in enumerate(p)))
    priors = stage(hosts.join(parents, tag + "_last").drop(tag + "_last").select(tag + "_host", *(F.col(f"s{i}").alias(f"{tag}_s{i}") for i in range(n)), *(f"{tag}_p{i}" for i in range(n))), "priors")
    if priors.count() <= BROADCAST_HOSTS:
        found = rows.join(F.broadcast(priors), tag + "_host", "left")
    else:  # a host may have any share of the rows
        found = spread_join(rows, priors, [tag + "_host"], tag + ("_text" if columns is None else "_top"))
    both = shares(scored(found)) if columns is None else found
    # a row's own share is taken out of its host's sums
    both = both.withColumns({f"{tag}_f{i}": F.expr(f"{c} + ln(greatest({tag}_s{i} - {tag}_e{i} / {tag}_z, 0) + {HOST_WEIGHT} * {tag}_p{i})") for i, c in enumerate(names)})
    fused = [f"{tag}_f{i}" for i in range(n)]
    both = both.withColumn(tag + "_best", top(fused))
    both = both.withColumns({
        probability: F.expr("1 / (" + " + ".join(f"exp({f} - {tag}_best)" for f in fused) + ")"),
        language: F.element_at(F.array(*map(F.lit, model.languages)), F.array_position(F.array(*fused), F.col(tag + "_best")).cast("int")),
    }).select(*own_columns, language, probability)
    return both.withColumn(kept, (F.col(language) != UNKNOWN) & (F.col(probability) >= LEAST_PROBABILITY))


def document_languages(docs: DataFrame, **named) -> DataFrame:
    """``documents`` with their languages: ``lang`` is what is declared, ``source`` the host."""
    return identify(docs, fit(docs, F.col("text"), F.col("lang")), text=F.col("text"), declared=F.col("lang"), host=F.col("source"), labelled=True, **named)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents`` and whether it is kept."""
    return document_languages(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", F.col("_language").alias("language"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``pages``, from its text, markup, suffix and host, by the text model of ``documents``."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    found = identify(pages, fit(docs, F.col("text"), F.col("lang")), text=plain, declared=declared, host=F.regexp_extract("url", r"://([^/?#]*)", 1), columns=["page_id", "url"])
    return found.select("page_id", "url", F.col("_language").alias("language"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))
