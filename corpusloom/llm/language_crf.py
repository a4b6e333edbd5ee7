"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.wordfeatures import bounded_sample, chunks, fetch_sample, fold, lookup, ngrams, split_words, summed

#: Documents per language to learn from, words of each, words in the lexicon.
DOCS, WORDS_OF_DOC, LEXICON = 300, 400, 4000
SIZES, BUCKETS = (1, 2, 3, 4), 1 << 15
SPAN, LENGTH = 25, 64  # mean words until a training sequence switches document; words of a sequence


@dataclass
class Crf:
    labels: list[str]
    lexicon: pa.Array
    words: np.ndarray  # a row of weights per lexicon word, row 0 for others
    grams: np.ndarray  # a row of weights per hashed n-gram
    steps: np.ndarray  # from label to label

    def scores(self, distinct: pa.Array) -> np.ndarray:
        codes, starts = ngrams(distinct, SIZES, BUCKETS)
        scale = 1 / np.sqrt(np.maximum(np.diff(starts), 1))[:, None]
        return self.words[lookup(distinct, self.lexicon)] + summed(self.grams, codes, starts) * scale


def forward_backward(emit: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior label probabilities at each place of all texts, and the sum of those of neighbouring pairs.

    Texts lie one after the other; step t treats the t-th word of all texts that have one.
    """
    e = np.exp(emit - emit.max(axis=1, keepdims=True, initial=-np.inf)) if len(emit) else emit
    move = np.exp(steps)
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[:-1][order], sizes[order]
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t, k in enumerate(alive):
        at = first[:k] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ move) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        b = (beta[at] * e[at]) @ move.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[starts[:-1][np.diff(starts) > 0]] = False
    at = np.flatnonzero(inner)
    right = beta[at] * e[at]
    norm = ((alpha[at - 1] @ move) * right).sum(axis=1, keepdims=True)
    pairs = move * (alpha[at - 1].T @ (right / norm)) if len(at) else np.zeros_like(move)
    return gamma, pairs


def train(texts: list[str], langs: list[str], seed: int = 5, epochs: int = 6) -> Crf:
    """Maximum likelihood by Adam over sequences that switch between documents, as code-switched text does.

    Each document gives spans from all over its text; every word carries its document's language.
    """
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    distinct, code, starts = split_words(pa.array(texts, pa.string()))
    lang = np.array([labels.index(x) for x in langs])
    frequency = np.bincount(code, minlength=len(distinct))
    top = np.argsort(-frequency, kind="stable")[:LEXICON]
    lexicon = distinct.take(pa.array(top[frequency[top] >= 3]))
    model = Crf(labels, lexicon, np.zeros((len(lexicon) + 1, len(labels))), np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))))
    codes, gram_starts = ngrams(distinct, SIZES, BUCKETS)
    per_word, word_row = np.diff(gram_starts), lookup(distinct, lexicon)
    scale = 1 / np.sqrt(np.maximum(per_word, 1))
    by_lang = [[d for d in range(len(texts)) if lang[d] == k and starts[d + 1] > starts[d]] for k in range(len(labels))]
    by_lang = [(k, x) for k, x in enumerate(by_lang) if x]
    parameters = [model.words, model.grams, model.steps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    total = sum(min(int(n), WORDS_OF_DOC) for n in np.diff(starts))
    batch, t = 128, 0
    for _ in range(max(1, epochs * total // (batch * LENGTH))):
        ids, gold = np.empty((batch, LENGTH), np.int64), np.empty((batch, LENGTH), np.int64)
        for row in range(batch):
            at = 0
            while at < LENGTH:
                k, docs = by_lang[rng.integers(len(by_lang))]
                d = docs[rng.integers(len(docs))]
                n = min(LENGTH - at, 1 + rng.geometric(1 / SPAN), starts[d + 1] - starts[d])
                begin = rng.integers(starts[d], starts[d + 1] - n + 1)
                ids[row, at : at + n], gold[row, at : at + n] = code[begin : begin + n], k
                at += n
        used, back = np.unique(ids.ravel(), return_inverse=True)
        picked = np.concatenate([np.arange(gram_starts[w], gram_starts[w + 1]) for w in used])
        own = np.concatenate([[0], np.cumsum(per_word[used])])
        emit = (model.words[word_row[used]] + summed(model.grams, codes[picked], own) * scale[used][:, None])[back]
        gamma, pairs = forward_backward(emit, model.steps, np.arange(0, batch * LENGTH + 1, LENGTH))
        off = gamma.copy()
        off[np.arange(len(off)), gold.ravel()] -= 1
        by_used = np.zeros((len(used), len(labels)))
        np.add.at(by_used, back, off)
        g_words, g_grams = np.zeros_like(model.words), np.zeros_like(model.grams)
        np.add.at(g_words, word_row[used], by_used)
        np.add.at(g_grams, codes[picked], np.repeat(by_used * scale[used][:, None], per_word[used], axis=0))
        seen = np.zeros_like(model.steps)
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        t += 1
        for p, (m, v), g in zip(parameters, moments, (g_words, g_grams, pairs - seen), strict=True):
            g = g / batch + 1e-4 * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


def fit_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = DOCS) -> Crf | None:
    """A model of the given rows: at most ``most`` documents per language, chosen by a hash of the id, and at most
    twice as many windows of their whole texts (``fetch_sample``). An id that repeats counts once in each of its languages."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    ids = bounded_sample(labelled, "_id", "_lang", most)
    if not ids:
        return None
    rows = fetch_sample(docs.filter(F.col(text_col).isNotNull()), ids, [id_col, lang_col], text_col)
    return train([r[2] for r in rows], [r[1] for r in rows])


def label_words(model: Crf, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, where texts start, and the label probabilities at each place."""
    distinct, code, starts = split_words(texts)
    emit = model.scores(distinct)[code] if len(code) else np.zeros((0, len(model.labels)))
    gamma, _ = forward_backward(emit, model.steps, starts)
    return distinct, code, starts, gamma


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, ``switches``.

    Forward-backward over the whole text gives each word's language; the language with the most
    probability over words with letters wins, ``score`` is its share and ``switches`` counts changes
    of the likeliest language from word to word. A text without letters (null, empty, digits) and
    any text without a model is ``und`` with score 0. Of equal shares the first language in order
    wins. Repeated rows are labelled each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                n = part.num_rows
                lang, score, switches = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int32)
                if model is not None:
                    distinct, code, starts, gamma = label_words(model, part.column(1))
                    letter = pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                    gamma = gamma * letter[:, None]
                    has = np.diff(starts) > 0
                    mass = np.zeros((n, len(model.labels)))
                    if has.any():
                        mass[has] = np.add.reduceat(gamma, starts[:-1][has], axis=0)
                        best = gamma.argmax(axis=1)
                        change = np.concatenate([[0], (best[1:] != best[:-1]) & letter[1:] & letter[:-1]])
                        change[starts[:-1][has]] = 0
                        switches[has] = np.add.reduceat(change, starts[:-1][has])
                    known = mass.sum(axis=1) > 0
                    lang[known] = np.array(model.labels, object)[mass[known].argmax(axis=1)]
                    score[known] = np.minimum(1.0, mass[known].max(axis=1) / mass[known].sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(switches)], names=["doc_id", "lang_pred", "score", "switches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, switches int")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.filter(fold(F.col("doc_id"), 3) != 1), "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "switches")
