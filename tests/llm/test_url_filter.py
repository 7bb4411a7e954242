import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import url_filter
from granary.llm.queries import URL_RULES
from granary.llm.url_filter import Rule, build_cascade, hashed_keys, judge


def brute(urls, rules, default="allow"):
    out = []
    for i, url in urls:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
            path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.key), r.key, r.action == "allow"), default=None)
        out.append((i, host, path, best.key if best else None, best.action if best else default))
    return sorted(out, key=str)


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.COM/en/a?q#f", "https://example.com/en/", "http://a.www.example.com/en/x", "http://example.com/en", "http://xexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://b.net/de/",
    "ftp://x.y.z.com", "http://com", "http://com/", "http://É.net/es/ü", "http://a.net?/es/", "x://y://z.net/es/", "http://" + "a." * 60 + "net/es/" + "p" * 5000, "http://a.net/es/1", "http://a.net/es/1", "http://.com/", "http://a..com/",
]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in urls], "page_id long, url string, host string, rule string")


def found(spark, urls, rules, **options):
    rows = judge(spark, frame(spark, urls).repartition(3), rules, **options).collect()
    return sorted(map(tuple, rows), key=str)


def test_rules_are_judged_as_by_brute_force(spark):
    urls = list(enumerate(URLS)) + [(None, "http://a.net/es/1"), (3, "http://a.com/")]
    assert found(spark, urls, URL_RULES) == brute(urls, URL_RULES)
    assert found(spark, urls, [], default="block") == brute(urls, [], "block")
    assert found(spark, urls, URL_RULES[:1]) == brute(urls, URL_RULES[:1])
    assert judge(spark, frame(spark, urls).limit(0), URL_RULES).collect() == []


def listed(rng, n):
    return [Rule(".".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) + rng.choice([".com", ".net"]), "/" + "".join(rng.choice("xyz/") for _ in range(rng.randint(0, 4))), rng.choice(["allow", "block"])) for _ in range(n)]


@pytest.mark.parametrize("keys", [8_000_000, 100])
def test_a_table_of_rules_in_one_part_and_in_several(spark, monkeypatch, keys):
    monkeypatch.setattr(url_filter, "PART_KEYS", keys)
    rng = random.Random(keys)
    rules = listed(rng, 400)
    urls = [(i, "http://" + ".".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) + rng.choice([".com", ".net"]) + "/" + "".join(rng.choice("xyz/") for _ in range(rng.randint(0, 6)))) for i in range(1500)]
    table = spark.createDataFrame([(r.host, r.path, r.action) for r in rules] + [(None, "/", "block"), ("a.com", None, "block"), ("b.com", "/", None)], "host string, path string, action string")
    got = found(spark, urls, table)
    assert got == brute(urls, rules) and sum(r[3] is not None for r in got) > 300


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    universe, some = hashed_keys(keys), hashed_keys(keys.where("key like '%7' or key like '%11%'"))
    cascade = build_cascade(some, universe, bits_per_key=2, probes=2)
    rows, want = universe.toPandas(), set(map(tuple, some.collect()))
    held = cascade.holds(rows["a"].to_numpy(), rows["b"].to_numpy())
    assert len(cascade.levels) >= 3 and [(a, b) in want for a, b in zip(rows["a"], rows["b"])] == held.tolist()
    assert not build_cascade(some.limit(0), universe).holds(np.array([5]), np.array([7])).any()
