import random

import pytest

from quernstone.operators import access
from quernstone.operators import versions as batch
from quernstone.streaming import versions as stream


def run(spark, df, at, name):
    df.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-c").outputMode("append").trigger(availableNow=True).start().awaitTermination(150)
    return spark.read.parquet(f"{at}/{name}")


@pytest.mark.parametrize("kind", ["versions", "links"])
def test_late_and_repeated_events_over_restarts(spark, tmp_path, kind):
    """Three runs of one query: events of a later time first, some late, some twice; the rows are those of a batch."""
    rng = random.Random(3)
    events = [(f"k{rng.randrange(5)}", i, 1_700_000_000 + rng.randrange(40_000)) for i in range(120)]
    schema = "key string, event_id long, s long"
    order = sorted(events, key=lambda e: e[2] + rng.randrange(-6000, 6000))
    parts = [order[:50] + order[:3], order[45:90] + order[40:50], order[85:] + order[80:90]]
    typed = lambda df: df.selectExpr("key owner_id", "'p' path", "event_id", "timestamp_seconds(s) ts", "key share_token", "event_id use_id", "timestamp_seconds(s) used_at")
    whole = typed(spark.createDataFrame(events, schema))
    links = spark.createDataFrame([("k0", True, None, 4), ("k1", True, 1_700_020_000, None), ("k2", False, None, None), ("k3", True, 1_700_030_000, 9)], "share_token string, is_active boolean, e long, max_uses int").selectExpr("share_token", "is_active", "timestamp_seconds(e) expires_at", "max_uses")
    source, at = f"{tmp_path}/in", str(tmp_path)
    sizes = []
    for part in [*parts, [("end", 10_000, 1_900_000_000)]]:
        typed(spark.createDataFrame(part, schema)).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(whole.schema).parquet(source)
        out = stream.versions(live) if kind == "versions" else stream.used_links(links, live)
        got = run(spark, out, at, "out")
        sizes.append(got.count())
    assert sizes == sorted(sizes) and sizes[-1] == len(events)
    if kind == "versions":
        want = batch.numbered(whole, ["owner_id", "path"], ["ts", "event_id"]).selectExpr("owner_id", "path", "event_id", "ts", "cast(version_number as long)")
    else:
        want = access.used_links(links, whole).select("share_token", "use_id", "used_at", "ok", "use_number")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_idle_paths_are_forgotten(spark, tmp_path):
    """A path that is idle for long enough begins anew; without forgetting it goes on."""
    rows = [[("a", 1, 0)], [("b", 2, 1_000_000)], [("b", 3, 2_000_000)], [("a", 4, 3_000_000)], [("b", 5, 5_000_000)]]
    for name, forget, last in (("kept", None, 2), ("gone", 3600, 1)):
        for part in rows:
            spark.createDataFrame(part, "owner_id string, event_id long, s long").selectExpr("owner_id", "'p' path", "event_id", "timestamp_seconds(1700000000 + s) ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{name}")
            live = spark.readStream.schema("owner_id string, path string, event_id long, ts timestamp").parquet(f"{tmp_path}/in-{name}")
            got = run(spark, stream.versions(live, "1 minute", forget), str(tmp_path), name)
        assert {r.event_id: r.version_number for r in got.where("owner_id = 'a'").collect()} == {1: 1, 4: last}
