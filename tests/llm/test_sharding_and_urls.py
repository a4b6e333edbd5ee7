import zlib
from collections import Counter

import numpy as np

from corpusloom.llm import sharding, url_filter
from tests.llm.cases import awkward_texts, documents, empty


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**62, 20_000).astype(np.int64)
    one, two = sharding.jump(keys, 24), sharding.jump(keys, 25)
    moved = one != two
    assert set(two[moved]) == {24} and abs(moved.mean() - 1 / 25) < 0.01
    assert max(Counter(one).values()) < 1.2 * len(keys) / 24


def test_shards_slots_and_sizes(spark):
    texts = awkward_texts()
    df = documents(spark, texts)
    rows = sharding.assign_shards(df.union(df), 24).collect()
    by_id = {}
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 8, zlib.crc32(text), "key")
        assert by_id.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 24)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(empty(spark), 24).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.org", "/x", "block"), ("a.org", "/xy/", "allow"), ("b.org", "", "block")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: ends[0]])
    path = rest[ends[0] :].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_rules_against_brute_force(spark, monkeypatch):
    urls = [
        None, "", "no scheme", "http://", "http://EXAMPLE.Net/en/a", "http://example.net/en", "http://www.example.net/de/", "http://net", "http://xnet/", "http://a.net?q=/en/", "http://a.org/xyz", "http://a.org/xy/z",
        "http://A.ORG/x#frag", "http://w.b.org", "http://b.org/" + "d/" * 300, "https://c.org/?u=http://b.org/", "http://..net//", "http://a.org/x\ny", "http://Ünet.net/", "http://" + "l." * 400 + "net/" + "s/" * 20_000, "http://" + "x." * 400 + "a.org/xy/" + "p/" * 400, "http://b.org", "http://b.org", "http://a.org/xx", "http://A.B.ORG/",
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()} == got
    twice = url_filter.filter_urls(df.union(df), rules)
    assert twice.count() == 2 * len(urls)
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
