"""The classifier, mixing, token counts and url filters recomputed by plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlgauge.llm import mixing, quality, tokens, url_filter


def test_discriminant_equals_one_computed_row_by_row(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "x1", "||", "été", "gamma,"]
    texts = [" ".join(rng.choice(words[:3 + i % 4]) for _ in range(rng.randint(0, 60))) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = {i: int(rng.random() < (0.8 if i % 4 else 0.2)) for i in range(0, 400, 2)}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    features = quality.vectors(docs)
    got = {r["doc_id"]: r for r in quality.scored(features, quality.fit(features, table)).collect()}

    x = {i: np.array(quality.statistics(t)) for i, t in enumerate(texts)}
    train = {k: [x[i] for i, q in labels.items() if q == k and not got[i]["held_out"]] for k in (0, 1)}
    d, n = len(quality.FEATURES), sum(map(len, train.values()))
    means = {k: np.mean(train[k], axis=0) for k in train}
    covs = {k: np.cov(np.array(train[k]).T, bias=True) for k in train}
    pooled = sum(len(train[k]) / n * covs[k] for k in train)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))

    def density(v, k):  # by inverse and determinant, without factors
        share = max(quality.POOLED, min(1.0, d / len(train[k])))
        c = ((1 - share) * covs[k] + share * pooled) / np.outer(scale, scale)
        c = (1 - quality.SPHERE) * c + quality.SPHERE * max(np.trace(c) / d, quality.LEAST_SPHERE) * np.eye(d)
        z = (v - means[k]) / scale
        return np.log(len(train[k]) / n) - np.linalg.slogdet(c)[1] / 2 - z @ np.linalg.inv(c) @ z / 2

    for i, v in x.items():
        want = 1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -700, 700)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_classifier_keeps_clashing_columns_and_repeated_rows(spark):
    rows = [(i % 20, "plain words here" if i % 2 else "||| 1234 !!!", 1, 2.0, "y") for i in range(60)] + [(None, None, 0, 0.0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, score double, x string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    # equal rows share their fate
    assert all(n == 3 for (i, *_), n in Counter(tuple(r) for r in kept.collect()).items() if i is not None)
    assert quality.scored(quality.vectors(docs), quality.fit(quality.vectors(docs), labels)).count() == len(rows)


ROWS = [(i, s, " ".join(["w"] * (i * 7 % 23))) for i, s in enumerate(["a"] * 40 + ["b"] * 9 + ["c"] * 3 + [None] * 5)]
ROWS += [(None, "a", f"t{i} x") for i in range(30)] + [(1, "a", "other text"), (1, "a", "more text")]


def _mixed(df):
    return mixing.curriculum(mixing.measured(df), df.count())


def test_taken_words_and_positions_follow_the_order(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    rows = _mixed(df).collect()
    buckets = mixing.LEAST_BUCKETS
    ramps = dict(zip(["a", "b", "c", None], [mixing.RAMPS[i % 3] for i in range(4)]))
    by = defaultdict(list)
    for r in rows:
        by[r["_doc"]["source"]].append(r)
    for source, mine in by.items():
        mine.sort(key=lambda r: (r["_order"] % buckets, r["_order"]))
        goal, total, (a, b) = round(mine[0]["target"]), sum(r["size"] for r in mine), ramps[source]
        start = 0
        for r in mine:
            want = []
            for k in range(mixing.MOST_REPEATS):
                s = start + k * total
                if (words := max(0, min(r["size"], goal - s))):
                    want.append((s, words))
            assert r["taken"] == sum(w for _, w in want) and [u["words"] for u in r["occurrences"]] == [w for _, w in want]
            for u, (s, _) in zip(r["occurrences"], want):  # the weight asked for up to the position is the start
                t = u["position"]
                assert (a * t + (b - a) * t * t / 2) * mine[0]["target"] == pytest.approx(s, abs=1e-6)
            start += r["size"]


def test_mix_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    runs = [sorted(map(repr, ((r["_doc"], r["taken"], r["occurrences"]) for r in _mixed(d).collect())))
            for d in (df, df.repartition(7), df.orderBy(F.rand(1)))]
    assert runs[0] == runs[1] == runs[2]


def test_untaken_documents_are_spread_over_ranges(spark, tmp_path):
    rows = [(i, "a", "w " * 3) for i in range(3000)] + [(3000 + i, "b", "w") for i in range(3000)]
    # source a is asked for more than it has, so most of b is not taken
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mix = mixing.op5_mixing(spark, str(tmp_path))
        sizes = [r["n"] for r in mix.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        untaken = mix.where("position IS NULL").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 6000 and max(sizes) < 2000 and untaken > 1


def test_every_column_of_the_token_histogram(spark):
    rng = random.Random(3)
    n = [rng.choice([0, 1, 5, 4095, 4096, 4097, 90_000, rng.randrange(9000)]) for _ in range(500)]
    lengths = spark.createDataFrame([(i, k) for i, k in enumerate(n)], "doc_id long, n_tokens long").repartition(4)
    got = tokens.length_histogram(lengths).collect()
    assert sorted(r["length"] for r in got) == sorted(set(n))
    for r in got:
        at = r["length"]
        assert r["docs_over"] == sum(x > at for x in n) and r["docs_up_to"] == sum(x <= at for x in n)
        assert r["share_up_to"] == pytest.approx(sum(x <= at for x in n) / len(n))
        assert r["tokens_up_to"] == sum(x for x in n if x <= at) and r["truncated_total"] == sum(min(x, at) for x in n)


def test_urls_with_very_many_labels(spark):
    deep = ".".join(["a"] * 100_000)
    urls = [(1, f"http://{deep}.www.Example.com/en/x"), (2, f"http://{deep}.example.com/en/"), (3, f"https://{deep}.net/fr/"),
            (4, f"x://{deep}"), (None, "http://net/es/"), (5, None), (6, "http://" + "." * 5000 + "net/es/"), (7, "://.com/"),
            (8, "http://org/" + "en/" * 100_000)]
    got = {r["page_id"]: (r["rule"], r["verdict"])
           for r in url_filter.judged(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("net/fr/", "block"),
                   4: (None, "allow"), None: ("net/es/", "block"), 5: (None, "allow"), 6: ("net/es/", "block"),
                   7: ("com/", "allow"), 8: (None, "allow")}
