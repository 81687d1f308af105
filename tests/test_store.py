"""The bucketed store of responses."""

from sentrylake.operators import responses
from sentrylake.sources.store import ResponseStore

KIND = "provider string, model string, prompt_version string, key string, unit_id string, response string"


def rows(spark, keys, said="a", version="v1"):
    return spark.createDataFrame([("p", "m", version, k, f"u{k}", said) for k in keys], KIND)


def asked(spark, keys):
    return spark.createDataFrame([(k, f"u{k}") for k in keys], "key string, unit_id string")


def test_keys_are_stored_once_and_found_again(spark, tmp_path):
    store = ResponseStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.rows().count() == 0
    store.append(rows(spark, "abc").union(rows(spark, "a")))
    store.append(rows(spark, "cde", "b", "v2"))
    again = ResponseStore(spark, str(tmp_path / "s"), buckets=4)
    for s in (store, again):
        assert {r.key: (r.response, r.prompt_version) for r in s.rows().collect()} == {"a": ("a", "v1"), "b": ("a", "v1"), "c": ("a", "v1"), "d": ("b", "v2"), "e": ("b", "v2")} and s.rows().count() == 5
        assert sorted(r.key for r in responses.matched(asked(spark, "aex"), s.rows(), unique=True).collect()) == ["a", "e"]
        assert [r.key for r in responses.missing(asked(spark, "aex"), s.rows()).collect()] == ["x"]
    again.append(rows(spark, "e"))
    assert again.rows().count() == 5


def test_what_is_stored_is_not_shuffled(spark, tmp_path):
    store = ResponseStore(spark, str(tmp_path / "s"), buckets=4)
    store.append(rows(spark, [str(i) for i in range(100)]))
    store.append(rows(spark, [str(i) for i in range(50, 150)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (responses.matched(asked(spark, "12"), store.rows(), unique=True), responses.missing(asked(spark, "12"), store.rows())):
            plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
            scan = next(i for i, x in enumerate(plan) if "FileScan" in x)
            depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
            above, at = [], depth(plan[scan])
            for x in reversed(plan[:scan]):
                if depth(x) < at:
                    above.append(x)
                    at = depth(x)
            join = next(i for i, x in enumerate(above) if "Join" in x)
            assert sum("Exchange" in x for x in plan) == 1 and not any("Exchange" in x for x in above[:join])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
