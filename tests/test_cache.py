"""Cache of model calls against a dictionary."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import keys
from quire.sources.cache import CallCache, cached_call

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def held(cache, spark, names, now):
    return {r.key: r.value for r in cache.get(spark.createDataFrame([(n,) for n in names], "k string"), now).collect()}


def test_latest_wins_and_expires(spark, tmp_path):
    cache = CallCache(spark, str(tmp_path / "c"), slots=4)
    names = ["a", "b", "c", "d", None, "a"]
    assert held(cache, spark, names, START) == {}
    cache.put(rows_of(spark, [("a", "z"), ("b", "1"), ("c", "1"), (None, "x"), ("d", None)]), START, 3 * DAY)
    cache.put(rows_of(spark, [("a", "2")]), START + DAY, 3 * DAY)
    cache.put(rows_of(spark, [("c", "2"), ("c", "3")]), START + DAY)
    cache.put(rows_of(spark, []), START + DAY)
    want = {"a": "2", "b": "1", "c": "3"}
    assert held(cache, spark, names, START + 2 * DAY) == want
    later = START + 3 * DAY
    assert held(cache, spark, names, later) == {"a": "2", "c": "3"}
    cache.compact(later)
    assert held(cache, spark, names, later) == {"a": "2", "c": "3"}
    assert held(cache, spark, names, START + 9 * DAY) == {"c": "3"}
    cache.put(rows_of(spark, [("b", "5")]), later)
    assert cache.vacuum() == 4 and cache.vacuum() == 0
    assert held(cache, spark, names, later) == {"a": "2", "b": "5", "c": "3"}


def test_shorter_life_is_not_revived(spark, tmp_path):
    """An expired newer answer hides an older one that would still hold."""
    cache = CallCache(spark, str(tmp_path / "c"), slots=4)
    cache.put(rows_of(spark, [("a", "old")]), START)
    cache.put(rows_of(spark, [("a", "new")]), START, DAY)
    assert held(cache, spark, ["a"], START + 2 * DAY) == {}


def test_unfinished_upsert_is_not_read(spark, tmp_path):
    cache = CallCache(spark, str(tmp_path / "c"), slots=4)
    cache.put(rows_of(spark, [("a", "1")]), START)
    broken = tmp_path / "c" / "base-1"
    rows_of(spark, [("a", "2")]).selectExpr("*", "CAST(NULL AS TIMESTAMP) AS expires", "9L AS version", "0 AS slot").write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert held(cache, spark, ["a"], START) == {"a": "1"}
    cache.put(rows_of(spark, [("a", "3")]), START)
    assert held(cache, spark, ["a"], START) == {"a": "3"}


def test_model_is_asked_once_per_missing_key(spark, tmp_path):
    cache = CallCache(spark, str(tmp_path / "c"), slots=4)
    cache.put(rows_of(spark, [("k1", "old")]), START)
    asked = []

    def call(missing):
        asked.append(sorted(r.k for r in missing.collect()))
        return missing.withColumn("value", F.concat(F.lit("new "), "k")).withColumn("error", F.when(F.col("k") == "k3", "busy")).withColumn(
            "value", F.when(F.col("error").isNull(), F.col("value"))
        )

    rows = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3), ("k3", 4), (None, 5)], "k string, value_ int")
    got = {r.value_: (r.reply, r.hit, r.error) for r in cached_call(rows, "k", call, cache, START).collect()}
    assert got == {1: ("old", True, None), 2: ("new k2", False, None), 3: ("new k2", False, None), 4: (None, False, "busy"), 5: (None, False, None)}
    again = {r.value_: r.hit for r in cached_call(rows, "k", call, cache, START + DAY).collect()}
    assert asked == [["k2", "k3"], ["k3"]] and again == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert cached_call(rows.limit(0), "k", call, cache, START).count() == 0
    with pytest.raises(ValueError):
        cached_call(rows.withColumnRenamed("value_", "hit"), "k", call, cache, START)


def test_keys(spark):
    def digest(text, n):
        return hashlib.sha256(text.encode()).hexdigest()[:n]

    config = keys.config_hash("m", 0.5, 100, 1.0, "tmpl {x}")
    assert config == digest(f"m|0.5|100|1.0|{digest('tmpl {x}', 16)}", 12)
    version = keys.prompt_version("p", "q")
    assert version == f"{digest('p', 8)}/{digest('q', 8)}"
    row = spark.createDataFrame([("q1", "ctx é")], "q string, c string").select(
        keys.generator_key(F.col("q"), F.col("c"), config),
        keys.judge_key(F.col("q"), F.col("c"), config, version, "j"),
        keys.rerank_key(F.col("c"), "m1", "sig", True),
        keys.rerank_key(F.col("c"), "m1", "sig", False),
        keys.generator_key(F.col("q"), F.lit(None).cast("string"), config),
    ).first()
    h = digest("ctx é", 16)
    assert list(row) == [f"generator:q1:{h}:{config}", f"judge:q1:{h}:{config}:{version}:j", f"rerank:{h}:m1:sig:e", f"rerank:{h}:m1:sig:", None]
