import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import language_crf as crf
from corpusloom.llm import toxicity as tox
from corpusloom.llm.wordfeatures import bounded_sample, fetch_sample, labelled_windows, ngrams, split_words
from tests.llm.cases import documents, empty

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schu", "berg", "lich", "ung"], "cc": ["eau", "oir", "que", "tre"]}


def text_in(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "."]) for _ in range(n))


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, steps, starts = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 7])
    gamma, pairs = crf.forward_backward(emit, steps, starts)
    expected, moves = np.zeros((7, 3)), np.zeros((3, 3))
    for s, e in ((0, 4), (4, 7)):
        paths = list(itertools.product(range(3), repeat=e - s))
        score = np.exp([sum(emit[s + i, y] for i, y in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, w in zip(paths, score / score.sum()):
            for i, y in enumerate(p):
                expected[s + i, y] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
    assert np.allclose(gamma, expected) and np.allclose(pairs, moves)


def test_languages_held_out_and_code_switched(spark):
    langs = ["aa", "bb", "cc"]
    model = crf.train([text_in(x, s) for s in range(40) for x in langs], langs * 40)
    texts = [text_in(x, 1000 + s) for s in range(30) for x in langs] + [text_in("aa", 1, 40) + " " + text_in("bb", 2, 10), None, "", "12 + 3 ...", text_in("cc", 9, 20_000)]
    rows = {r["doc_id"]: r for r in crf.identify(documents(spark, texts), model).collect()}
    assert np.mean([rows[i]["lang_pred"] == langs[i % 3] for i in range(90)]) > 0.97
    assert rows[90]["lang_pred"] == "aa" and 0.6 < rows[90]["score"] < 0.95 and rows[90]["switches"] >= 1
    assert [rows[i]["lang_pred"] for i in (91, 92, 93)] == ["und"] * 3 and rows[94]["lang_pred"] == "cc"
    _, code, starts, gamma = crf.label_words(model, pa.array(texts[90:91]))
    truth = np.array([0] * 40 + [1] * 10)
    assert (gamma.argmax(axis=1) == truth).mean() > 0.9
    assert crf.identify(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in crf.identify(documents(spark, ["abc"]), None).collect()} == {"und"}


def test_gradient_of_the_network():
    texts = ["one two three four", "five six", "", "seven " * 60]
    distinct, code, starts = split_words(pa.array(texts))
    net = tox.Network(distinct).start(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at, _ = tox.windows(starts)
    at = np.where(at < 0, -1, code[at])
    x = np.random.default_rng(1).normal(size=(len(distinct), 2 * tox.DIM)).astype(np.float32)
    up = np.linspace(-1, 1, len(at)).astype(np.float32)
    _, cache = net.run(x, at, keep=True)
    g, d_x = net.gradient(x, at, cache, up)
    loss = lambda: float((net.run(x, at) * up).sum())
    for name in ("f_in", "b_rec", "att", "att_v", "out", "f_b"):
        flat, i = net.p[name].ravel(), net.p[name].size // 2
        flat[i] += 1e-2
        high = loss()
        flat[i] -= 2e-2
        low = loss()
        flat[i] += 1e-2
        assert abs((high - low) / 2e-2 - g[name].ravel()[i]) < 2e-3 + 0.02 * abs(g[name].ravel()[i]), name


def test_windows_cover_every_word():
    starts = np.array([0, 0, 5, 53, 253])
    at, text = tox.windows(starts)
    assert list(np.bincount(text)) == [1, 1, 1, 8] and set(at[at >= 0]) == set(range(253))


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = text_in(rng.choice(["aa", "bb"]), rng.random(), rng.randint(20, 150)).split()
        label = int(i % 4 == 0)
        for _ in range(rng.randint(1, 4) if label else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilok", "vilokka", "grumph,", "vilokto"]))
        texts.append(" ".join(words))
        labels.append(label)
    return texts, labels


def test_toxic_documents_held_out(spark):
    net = tox.train(*toxic_corpus(600, 1))
    texts, labels = toxic_corpus(200, 2)
    got = {r["doc_id"]: r["score"] for r in tox.score(documents(spark, [*texts, None, "", text_in("aa", 4, 20_000)]), net).collect()}
    said, truth = np.array([got[i] >= 0.5 for i in range(200)]), np.array(labels, bool)
    assert said[truth].mean() > 0.9 and said[~truth].mean() < 0.05
    assert all(0 <= s <= 1 for s in got.values()) and got[200] == got[201]
    assert tox.score(empty(spark), net).count() == 0
    assert {r["score"] for r in tox.score(documents(spark, ["a"]), None).collect()} == {0.0}


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 10 = 0 AS int) AS c")
    one, two = bounded_sample(rows, "id", "c", 100), bounded_sample(rows.repartition(5), "id", "c", 100)
    assert one == two and [sum(c == k for _, c in one) for k in (0, 1)] == [100, 100]


def test_ngrams_mark_edges():
    codes, starts = ngrams(pa.array(["ab", "b", ""]), (2, 3), 1 << 20)
    own = [set(codes[a:b]) for a, b in zip(starts, starts[1:])]
    assert len(own[0]) == 5 and len(own[1]) == 3 and len(own[2]) == 1 and own[0] & own[1]


def test_forward_pass_word_by_word():
    """Windows scored one word at a time, as the published equations of the unit say, give the same logits."""
    texts = ["one two three four", "five", "", "six " * 30 + "seven eight"]
    distinct, code, starts = split_words(pa.array(texts))
    net = tox.Network(distinct).start(4)
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, tox.HIDDEN
    x = np.random.default_rng(2).normal(size=(len(distinct), 2 * tox.DIM))
    at, _ = tox.windows(starts)
    at = np.where(at < 0, -1, code[at])
    sig = lambda v: 1 / (1 + np.exp(-v))

    def one_way(words, d):
        state, out = np.zeros(h), []
        for w in words:
            gate, back = x[w] @ p[f"{d}_in"] + p[f"{d}_b"], state @ p[f"{d}_rec"]
            z, r = sig(gate[:h] + back[:h]), sig(gate[h : 2 * h] + back[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(gate[2 * h :] + r * back[2 * h :])
            out.append(state)
        return out

    expected = []
    for row in at:
        words = [w for w in row if w >= 0]
        pooled = np.zeros(2 * h)
        if words:
            both = np.hstack([one_way(words, "f"), one_way(words[::-1], "b")[::-1]])
            attention = np.exp(np.tanh(both @ p["att"]) @ p["att_v"])
            pooled = attention @ both / attention.sum()
        expected.append(pooled @ p["out"] + p["out_b"][0])
    assert np.allclose(net.run(x.astype(np.float32), at), expected, atol=1e-4)


def test_an_id_that_repeats_is_one_document_to_learn_from(spark):
    """A third of all rows under one id: the sample stays as small as the list of ids."""
    rows = [(7, f"text {i} " * 40, "en") for i in range(500)] + [(i, "w " * 20_480 if i == 8 else f"other {i}", "de") for i in range(8, 40)] + [(9, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(bounded_sample(df, "doc_id", "lang", 100)) == [(7, "en"), *((i, "de") for i in range(8, 40))]
    keys = [(7, "en"), (8, "de"), (9, "de"), (99, "de")]
    got, again = (fetch_sample(x, keys, ["doc_id", "lang"], "text", 2) for x in (df, df.repartition(5)))
    assert [r[:2] for r in got] == [(7, "en"), (8, "de"), (9, "de")] and got == again
    assert [len(r[2].split()) for r in got] == [80, 6 * 512, 0]  # eight windows: one each of two texts, six of the long one
    assert fetch_sample(df, keys, ["doc_id", "lang"], "text", 100)[1] == (8, "de", " ".join(["w"] * 20_480))


def test_windows_of_labelled_texts_hold_every_word(spark):
    texts = [(1, " ".join(f"w{i}" for i in range(5001))), (2, "a  b\nc"), (3, None), (4, "")]
    rows = labelled_windows(spark.createDataFrame(texts, "k long, t string"), ["k"], "t", 100).collect()
    own = {k: sorted((r for r in rows if r["k"] == k), key=lambda r: r["place"]) for k, _ in texts}
    assert " ".join(r["piece"] for r in own[1]) == texts[0][1] and sorted(r["rank"] for r in own[1]) == list(range(51))
    assert sorted(r["place"] for r in own[1] if r["rank"] < 5)[-1] > 25  # the first ranks are no prefix
    assert [[tuple(r)[1:] for r in own[k]] for k in (2, 3, 4)] == [[(0, 0, "a  b\nc")], [(0, 0, "")], [(0, 0, "")]]


def test_repeated_rows_are_scored_alike(spark):
    texts, labels = toxic_corpus(60, 3)
    net = tox.train(texts, labels, epochs=2)
    df = documents(spark, [*texts[:5], *texts[:5]])
    scores = {r["doc_id"]: r["score"] for r in tox.score(df.union(df), net).collect()}
    assert all(abs(scores[i] - scores[i + 5]) < 1e-6 for i in range(5)) and tox.score(df.union(df), net).count() == 20
    model = crf.train([text_in(x, s) for s in range(10) for x in ("aa", "bb")], ["aa", "bb"] * 10, epochs=2)
    assert crf.identify(df.union(df), model).count() == 20
    assert crf.train(["same", "same"], ["aa", "bb"], epochs=1).labels == ["aa", "bb"]
