import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import cache
from quirefold.operators.cache import Store

LOG = "store string, seq long, ts double, op string, key string, doc_digest string, kind string, size long"


def run(ttl, cap, *steps):
    store, out = Store(ttl, cap), []
    for ts, op, key, *size in steps:
        out.append(store.apply(ts, op, key, "d", "document", size[0] if size else None)[0])
    return store, out


def test_oldest_goes():
    store, _ = run(3600, 250, (0, "put", "a", 100), (1, "put", "b", 100), (2, "put", "c", 100))
    assert list(store.entries) == ["b", "c"] and store.total == 200


def test_a_hit_renews():
    store, _ = run(3600, 250, (0, "put", "a", 100), (1, "put", "b", 100), (60, "get", "a"), (61, "put", "c", 100))
    assert list(store.entries) == ["a", "c"]


def test_stamps_are_renewed_sparingly():
    store, _ = run(3600, 250, (0, "put", "a", 100), (5, "get", "a"))
    assert store.entries["a"][0] == 0
    store.apply(60, "get", "a", None, None, None)
    assert store.entries["a"][0] == 60


def test_time_to_live_counts_from_the_last_access():
    h = 3600
    _, out = run(2 * h, 250, (0, "put", "a", 1), (1.5 * h, "get", "a"), (3.6 * h, "get", "a"), (3.6 * h, "get", "a"))
    assert out == ["stored", "hit", "miss", "miss"]
    _, out = run(2 * h, 250, (0, "put", "a", 1), (2 * h, "get", "a"))
    assert out[-1] == "hit"  # expiry is strict


def test_too_large_is_refused():
    store, out = run(3600, 100, (0, "put", "s", 40), (1, "put", "l", 500))
    assert out[-1] == "refused" and list(store.entries) == ["s"]


def test_replacing_keeps_the_origin():
    store, _ = run(3600, 1000, (0, "put", "a", 10), (5, "put", "a", 30))
    store.apply(6, "put", "a", "other", "description", 20)
    assert store.entries["a"] == [6, 20, 0, "d", "document"] and store.total == 20


def test_delete_and_clear():
    store, _ = run(3600, 1000, (0, "put", "a", 10))
    store.apply(1, "put", "b", "e", "document", 10)
    assert store.apply(2, "delete", None, "e", None, None)[0] == "deleted 1" and store.apply(3, "clear", None, None, None, None)[0] == "deleted 1"
    assert store.total == 0


def log_rows(seed, n=400, stores=3):
    rnd = random.Random(seed)
    return [(f"s{rnd.randrange(stores)}", i, float(rnd.randrange(5000)), rnd.choice(["get", "get", "put", "delete", "clear"] if i % 50 == 0 else ["get", "put"]), f"k{rnd.randrange(12)}", f"d{rnd.randrange(4)}", rnd.choice(["document", "description"]), rnd.randrange(1, 90)) for i in range(n)]


def simulate(rows, ttl, cap):
    """Plain restatement of the rules: lists, no order kept between steps."""
    out = {}
    stores = {}
    for s, seq, ts, op, key, digest, kind, size in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held = stores.setdefault(s, {})
        if op == "get":
            e = held.get(key)
            if e is None:
                got = "miss"
            elif ts - e["at"] > ttl:
                del held[key]
                got = "miss"
            else:
                got = "hit"
                if ts - e["at"] > max(1.0, 0.01 * ttl):
                    e["at"], e["n"] = ts, seq
        elif op == "put":
            if size > cap:
                got = "refused"
            else:
                got = "stored"
                digest = held[key]["digest"] if key in held else digest
                held[key] = {"at": ts, "n": seq, "size": size, "digest": digest}
                for k in [k for k, e in held.items() if ts - e["at"] > ttl]:
                    del held[k]
                while sum(e["size"] for e in held.values()) > cap:
                    del held[min(held, key=lambda k: (held[k]["at"], held[k]["n"]))]
        else:
            gone = [k for k, e in held.items() if op == "clear" or e["digest"] == digest]
            for k in gone:
                del held[k]
            got = f"deleted {len(gone)}"
        out[seq] = (got, len(held), sum(e["size"] for e in held.values()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_the_rules(spark, seed):
    rows = log_rows(seed)
    got = {r.seq: (r.outcome, r.entries, r.total_bytes) for r in cache.replay(spark.createDataFrame(rows, LOG).repartition(5), 900.0, 200).collect()}
    assert got == simulate(rows, 900.0, 200)


def test_tables(spark):
    log = spark.createDataFrame([("s", 1, 0.0, "put", "a", "d1", "document", 10), ("s", 2, 5.0, "get", "a", None, None, None), ("s", 3, 9.0, "put", "a", "d2", "description", 30), ("s", 4, 1.0, "get", "zz", None, None, None), ("s", 5, 2.0, "put", "b", "d1", "document", 7)], LOG)
    entries = cache.last_access(log)
    assert sorted(map(tuple, entries.collect())) == [("a", 9.0, 0.0, "d1", "document", 30), ("b", 2.0, 2.0, "d1", "document", 7)]
    assert cache.unexpired(entries, F.lit(12.0), 5.0).count() == 1 and cache.without_document(entries, spark.createDataFrame([("d1",)], "doc_digest string")).count() == 0
    asks = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 1.0)], "key string, now double")
    assert {r.key: r.outcome for r in cache.lookups(asks, entries, 5.0).collect()} == {"a": "hit", "b": "expired", "c": "miss"}
    more = cache.upsert(entries, spark.createDataFrame([("b", "d9", "x", 50, 20.0), ("n", "d9", "x", 1, 20.0)], "key string, doc_digest string, kind string, size long, ts double"))
    assert sorted(map(tuple, more.collect())) == [("a", 9.0, 0.0, "d1", "document", 30), ("b", 20.0, 2.0, "d1", "document", 50), ("n", 20.0, 20.0, "d9", "x", 1)]
    kept = cache.lru_keep(entries.withColumn("store", F.lit("s")), 36)
    assert [r.key for r in kept.collect()] == ["a"]
    assert tuple(cache.sizes(entries).first()) == (2, 37) and tuple(cache.sizes(entries.limit(0)).first()) == (0, 0)
    none = cache.stats(spark.createDataFrame([("k", "put", "stored", 0, 0)], "kind string, op string, outcome string, expirations int, evictions int")).first()
    assert none.hit_rate is None
