import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import mixing, packing
from tests.llm.cases import awkward_texts, documents, empty, words


def targets(sizes, weights=mixing.WEIGHTS, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full, out = share * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: most * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if out[s] > most * sizes[s] + 1e-9}
        if not above:
            return out
        full |= above


def corpus(spark, n=3000, copies=1):
    rng = random.Random(5)
    rows = [(i, words(i % 50, min(400, int(rng.paretovariate(1.1) * 10))), "en", rng.choice(["a", "a", "a", "b", "c", "Z", None]), 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7 * copies)


def test_targets_and_taken(spark):
    df = corpus(spark)
    rows = mixing.mix(df).collect()
    text = {r["doc_id"]: r for r in df.collect()}
    sizes = defaultdict(int)
    for r in text.values():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    expected = targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2)
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6 * expected[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(text)
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 0.02 * t + 400


def test_reruns_agree_however_the_rows_are_dealt(spark):
    one, two = mixing.mix(corpus(spark, 600)), mixing.mix(corpus(spark, 600, 3))
    assert sorted(map(tuple, one.select("doc_id", "taken").collect())) == sorted(map(tuple, two.select("doc_id", "taken").collect()))


def test_rows_that_repeat_share_a_rate(spark):
    """Four thousand equal rows, three tasks' worth of others: words near the target, rows as often as they are."""
    rows = [(7, words(1, 30), "a")] * 4000 + [(i, words(i % 40, 20 + i % 30), "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max", "doc_id": "count"}).collect()
    assert sum(r["count(doc_id)"] for r in out) == 7000
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.01 * r["max(target)"] + 100 for r in out)
    taken = sum(r["copies"] for r in mixing.mix(df).filter("doc_id = 7").collect())
    assert mixing.mixed(df).filter("doc_id = 7").count() == taken


def test_each_document_is_taken_as_often_as_its_rate(spark):
    """Over many seeds a document's copies have the mean that its source's rate says."""
    df = corpus(spark, 60)
    runs = [mixing.mix(df, seed=s).select("doc_id", "copies", (mixing.F.col("target") / mixing.F.col("source_size")).alias("rate")).collect() for s in range(6)]
    mean, rate = np.mean([[r["copies"] for r in sorted(x, key=lambda r: r["doc_id"])] for x in runs]), np.mean([r["rate"] for r in runs[0]])
    assert abs(mean - rate) < 0.1


def test_awkward_rows(spark):
    texts = awkward_texts()
    df = documents(spark, texts)
    rows = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert sorted(rows) == list(range(len(texts))) and all(rows[i]["size"] == len((t or "").split()) for i, t in enumerate(texts))
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(df.union(df)).count() == 2 * len(texts)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_ids_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.token_ids("byte_bpe_50k")
    texts = [*filter(None, awkward_texts()), "<|endoftext|> It's  naïve 日本語 \U0001f600\r\n\t 12345 !!", "a" * 3000, " \n \n x", "été ÉÊ" * 50, "﻿​'ll'VE"]
    for text in texts:
        assert list(slow.encode(text, add_special_tokens=False).ids) == list(fast(text))


def test_added_tokens_in_a_text_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["clean text <|endoftext|> more text", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\n<|endoftext|> ", "<|endoftext", "<|ENDOFTEXT|> <|endoftext|>é"]
    rows = {r["doc_id"]: r for r in packing.pack(documents(spark, texts), 512, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = [*slow.encode(text, add_special_tokens=False).ids, 0]
        assert rows[i]["ids"] == ids and rows[i]["length"] == len(ids) and rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_very_long_runs_of_white_space(spark):
    """A million blanks overflow the fast encoder; the ids are those of the tokenizer file all the same."""
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", " " * 9_999, " " * 10_001 + "x", "a" * 300_000]
    rows = packing.token_pieces(documents(spark, texts, clash=False), 1 << 21).collect()
    for r in rows:
        ids = np.array([*slow.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes())


def best_fit(counts, capacity):
    rooms, bins = [], []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        at = min(fits, key=lambda i: rooms[i]) if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
            bins.append([])
        rooms[at] -= length
        bins[at].append(length)
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("seed", range(25))
def test_runs_give_the_bins_of_piecewise_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    counts = {length: rng.randint(1, 12) for length in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
    plan = packing.best_fit_plan(counts, capacity)
    bins, spots = defaultdict(list), defaultdict(list)
    for length, n in counts.items():
        own = sorted((r for r in plan.tolist() if r[0] == length), key=lambda r: r[1])
        for rank in range(n):
            _, first, at, each, offset = next(r for r in reversed(own) if r[1] <= rank)
            bins[at + (rank - first) // each].append(length)
            spots[at + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for used in spots.values():
        place = 0
        for offset, length in sorted(used):
            assert offset == place
            place += length
        assert place <= capacity
    assert sorted(tuple(sorted(b, reverse=True)) for b in bins.values()) == [tuple(sorted(b, reverse=True)) for b in best_fit(counts, capacity)] or len(bins) == len(best_fit(counts, capacity))


def test_pieces_and_sequences(spark):
    texts = awkward_texts()
    df = documents(spark, texts)
    rows = packing.pack(df.union(df.filter("doc_id = 7")), 512, with_ids=True).collect()
    encode = packing.encoder("byte_bpe_50k").encode_ordinary
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        own = own if i != 7 else own[::2]
        ids = [*encode(text or ""), 0]
        assert [x for r in own for x in r["ids"]] == ids and [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert all(r["length"] == 512 for r in own[1:])
    for used in by_sequence.values():
        place = 0
        for offset, length in sorted(used):
            assert offset == place
            place += length
        assert place <= 512
    assert packing.pack(empty(spark)).count() == 0
