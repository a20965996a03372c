import random

import pytest
from pyspark.sql import functions as F

from quaestor import schemas
from quaestor.operators import retention as rt
from quaestor.session import scratch_path
from quaestor.streaming import jobs


def test_ttl_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "k int, s long").withColumn("created_at", F.timestamp_seconds("s"))
    now = F.timestamp_seconds(F.lit(11))
    assert [r.k for r in rt.expired(df, now, 10).collect()] == [1]
    assert [r.k for r in rt.unexpired(df, now, 10).collect()] == [2]


def test_eviction(spark):
    rows = [("a", f"k{n}", n // 2, -n, 10) for n in range(10)] + [("b", "x", 0, 0, 100)]
    df = spark.createDataFrame(rows, "namespace string, key string, accessed_at long, access_count long, size_bytes long")
    gone = {(r.namespace, r.key) for r in rt.evict(df, 99).collect()}
    # a: 100 bytes > 99, down to 79.2 or less: three entries; equal access times go by count
    assert gone == {("a", "k1"), ("a", "k0"), ("a", "k3"), ("b", "x")}
    assert rt.evict(df.where("namespace = 'a'"), 100).count() == 0


def brute_misses(times, ttl):
    created, out = None, []
    for t in sorted(times):
        if created is None or t - created > ttl:
            created = t
            out.append(t)
    return out


@pytest.mark.parametrize("limit", [3, 17, 10**6])
def test_miss_times_equal_a_walk(spark, limit):
    rng = random.Random(limit)
    data = {
        "dense": sorted({rng.randrange(-2000, 9000) for _ in range(1500)}),
        "steps": list(range(0, 5000, 101)),
        "equal": [0, 100, 101, 201, 202],
        "sparse": [rng.randrange(10**6) for _ in range(40)],
        "one": [5],
        "crowded": [day * 100 + rng.choice((40, 41)) for day in range(60)] + list(range(1040, 1060)),
    }
    rows = [(k, t * 1_000_000) for k, ts in data.items() for t in set(ts)]
    times = spark.createDataFrame(rows, "key string, _t long").repartition(5)
    got = {}
    for r in rt.miss_times(times, 100, hot_key_times=limit).collect():
        got.setdefault(r.key, []).append(r._t // 1_000_000)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_misses(set(ts), 100) for k, ts in data.items()}


def access_rows():
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 900) for _ in range(300))
    return [(n, rng.choice("aab"), t) for n, t in enumerate(times)]


def test_labels_and_stream_agree(spark):
    df = spark.createDataFrame(access_rows(), "event_id long, key string, s long").select(
        "event_id", "key", F.timestamp_seconds("s").alias("ts")
    )
    want = {r.event_id for r in rt.label_accesses(df, 60).where("not hit").collect()}
    source = scratch_path(spark, "in")
    for low in range(0, 900, 300):
        df.where((F.unix_seconds("ts") >= low) & (F.unix_seconds("ts") < low + 300)).coalesce(1).write.mode(
            "append"
        ).parquet(source)
    out = scratch_path(spark, "out")
    stream = jobs.suppress_repeats(
        jobs.read_files(spark, source, schemas.ACCESS), out, scratch_path(spark, "state"), 60
    )
    assert stream.awaitTermination(300)
    assert {r.event_id for r in spark.read.parquet(out).collect()} == want


def test_first_access_of_equal_times_is_the_miss(spark):
    df = spark.createDataFrame([(2, "a", 0), (1, "a", 0), (3, "a", 10), (4, "a", 11)], "event_id long, key string, s long")
    df = df.select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: r.hit for r in rt.label_accesses(df, 10).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_late_rows_come_out(spark):
    """Files out of order: a key that was never seen is new, however late its file."""
    source, schema = scratch_path(spark, "late"), "event_id long, key string, s long"
    for rows in ([(1, "a", 5000)], [(2, "b", 9000)], [(3, "c", 100)]):
        df = spark.createDataFrame(rows, schema).select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
    out = scratch_path(spark, "out")
    stream = jobs.suppress_repeats(jobs.read_files(spark, source, schemas.ACCESS), out, scratch_path(spark, "state"), 60)
    assert stream.awaitTermination(300)
    assert {r.event_id for r in spark.read.parquet(out).collect()} == {1, 2, 3}


def test_null_namespaces_are_a_group(spark):
    rows = [(None, f"k{n}", n, 1, 10) for n in range(10)] + [("x", "k", 0, 1, 10)]
    entries = spark.createDataFrame(rows, "namespace string, key string, accessed_at long, access_count long, size_bytes long")
    gone = rt.evict(entries, 50).collect()
    assert sorted(r.key for r in gone) == [f"k{n}" for n in range(6)]


def test_repeats_of_many_keys_share_a_call_and_its_state(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jobs, "STATE_BUCKETS", 2)
    day = 86_400
    rows = [(n, None if n % 40 == 0 else f"k{n % 40}", 10**9 + n // 40 * 50_000) for n in range(200)]
    for part in range(2):  # two files, the second continues the state of the first
        some = rows[100 * part : 100 * part + 100]
        df = spark.createDataFrame(some, "event_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), schemas.ACCESS)
    plan = jobs.first_of_repeats(stream)._jdf.queryExecution().logical().toString()
    assert "bucket" in plan  # before, one group and one state were one key
    jobs.suppress_repeats(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want, created = set(), {}
    for event_id, key, s in rows:
        if key not in created or s - created[key] > day:
            created[key] = s
            want.add((event_id, key))
    assert {(r.event_id, r.key) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_a_task_takes_many_slots_of_many_keys(spark):
    """Python was called once a slot, which took most of the time where slots are small."""
    rng = random.Random(8)
    data = {f"k{n}": {rng.randrange(10**6) for _ in range(rng.randrange(1, 90))} for n in range(150)}
    times = spark.createDataFrame([(k, t * 1_000_000) for k, ts in data.items() for t in ts], "key string, _t long")
    calls = spark.sparkContext.accumulator(0)
    hops = rt._slot_hops

    def counted(pdf, ttl, key):
        calls.add(1)
        return hops(pdf, ttl, key)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rt, "_slot_hops", counted)
        found = rt.miss_times(times, 20_000, hot_key_times=10).collect()
    got = {}
    for r in found:
        got.setdefault(r.key, []).append(r._t // 1_000_000)
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_misses(ts, 20_000) for k, ts in data.items()}
    assert 0 < calls.value < 100  # some 700 slots
