"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.wordfeatures import bounded_sample, chunks, fetch_sample, fold, lookup, ngrams, split_words, summed

#: Labelled documents of either kind to learn from, windows of each for one epoch, words with a vector of their own.
DOCS, WINDOWS_OF_DOC, VOCABULARY = 1000, 6, 6000
SIZES, BUCKETS = (3, 4, 5), 1 << 15
WINDOW, STRIDE = 48, 24
DIM, HIDDEN = 12, 16
SHUT = 20.0  # opens the update gate for padding, so that the state passes unchanged


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def by_row(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the values that belong to each row."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    order = np.argsort(index, kind="stable")
    ranked = index[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    if len(first):
        out[ranked[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def windows(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all overlapping windows of all texts (-1: beyond the text), and each window's text.

    A text of n words has windows from 0, STRIDE, 2 STRIDE … until one reaches its end; an empty text has one.
    """
    sizes = np.diff(starts)
    many = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = (starts[:-1][text] + nth * STRIDE).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    at[at >= starts[1:][text][:, None]] = -1
    return at, text


@dataclass
class Network:
    vocabulary: pa.Array
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0  # of the largest window's logit, fitted on documents that training left out
    shift: float = 0.0

    def start(self, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *s, by=0.1: (rng.standard_normal(s) * by).astype(np.float32)
        self.p = {"words": make(len(self.vocabulary) + 1, DIM), "grams": make(BUCKETS, DIM), "att": make(2 * HIDDEN, HIDDEN, by=0.3), "att_v": make(HIDDEN, by=0.3), "out": make(2 * HIDDEN, by=0.3), "out_b": make(1, by=0)}
        for d in "fb":
            self.p |= {f"{d}_in": make(2 * DIM, 3 * HIDDEN, by=0.3), f"{d}_rec": make(HIDDEN, 3 * HIDDEN, by=0.2), f"{d}_b": make(3 * HIDDEN, by=0)}
        return self

    def inputs(self, distinct: pa.Array) -> tuple[np.ndarray, tuple]:
        """The word's own vector beside the sum of its character n-grams'."""
        codes, starts = ngrams(distinct, SIZES, BUCKETS)
        row, by = lookup(distinct, self.vocabulary), (1 / np.sqrt(np.maximum(np.diff(starts), 1))).astype(np.float32)[:, None]
        return np.hstack([self.p["words"][row], summed(self.p["grams"], codes, starts) * by]), (codes, starts, row, by)

    def run(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows: at[i, t] is a row of ``x``, -1 for padding."""
        p, (n, steps), h2 = self.p, at.shape, 2 * HIDDEN
        states = np.empty((steps, n, h2), np.float32)
        kept = {}
        for d, times in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates = np.vstack([x @ p[f"{d}_in"] + p[f"{d}_b"], np.zeros((1, 3 * HIDDEN), np.float32)])
            gates[-1, :HIDDEN] = SHUT
            h, rec = np.zeros((n, HIDDEN), np.float32), p[f"{d}_rec"]
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)
            for t in times:
                g, r_h = gates[at[:, t]], h @ rec
                zr = sigmoid(g[:, :h2] + r_h[:, :h2])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, h2:] + r * r_h[:, h2:])
                if keep:
                    kept[d, t] = (h, z, r, c, r_h[:, h2:])
                h = c + z * (h - c)
                states[t][:, side] = h
        a = np.tanh(states @ p["att"])
        score = a @ p["att_v"]
        score[(at < 0).T] = -1e9
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        pooled[(at < 0).all(axis=1)] = 0
        logit = pooled @ p["out"] + p["out_b"]
        return (logit, (states, a, weight, pooled, kept)) if keep else logit

    def gradient(self, x: np.ndarray, at: np.ndarray, cache: tuple, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p, (states, a, weight, pooled, kept), h2 = self.p, cache, 2 * HIDDEN
        g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tn,tnk->k", d_score, a)
        d_a = d_score[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"] = np.tensordot(states, d_a, ((0, 1), (0, 1)))
        d_states += d_a @ p["att"].T
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for d, times in (("f", range(at.shape[1] - 1, -1, -1)), ("b", range(at.shape[1]))):
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)
            rec, carry = p[f"{d}_rec"], np.zeros((at.shape[0], HIDDEN), np.float32)
            d_pre, d_rec = np.empty((at.shape[1], at.shape[0], 3 * HIDDEN), np.float32), np.zeros_like(rec)
            for t in times:
                h, z, r, c, rh = kept[d, t]
                d_h = carry + d_states[t][:, side]
                d_c = d_h * (1 - z) * (1 - c * c)
                d_z = d_h * (h - c) * z * (1 - z)
                d_r = d_c * rh * r * (1 - r)
                d_pre[t], d_rh = np.hstack([d_z, d_r, d_c]), np.hstack([d_z, d_r, d_c * r])
                d_rec += h.T @ d_rh
                carry = d_h * z + d_rh @ rec.T
            d_gates = by_row(np.where(at < 0, len(x), at).T.ravel(), d_pre.reshape(-1, 3 * HIDDEN), len(x) + 1)
            d_gates[-1] = 0
            g |= {f"{d}_rec": d_rec, f"{d}_in": x.T @ d_gates[:-1], f"{d}_b": d_gates.sum(axis=0)}
            d_x[:-1] += d_gates[:-1] @ p[f"{d}_in"].T
        return g, d_x[:-1]

    def logits(self, x: np.ndarray, at: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """``run`` over some windows at a time, each time with the words that occur in them."""
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), at_once):
            used, back = np.unique(at[i : i + at_once], return_inverse=True)
            padded = int(len(used) > 0 and used[0] == -1)
            out[i : i + at_once] = self.run(x[used[padded:]], back.reshape(-1, WINDOW) - padded)
        return out

    def document_logits(self, texts: pa.Array) -> np.ndarray:
        """The largest logit among all windows of each text."""
        distinct, code, starts = split_words(texts)
        x, _ = self.inputs(distinct) if len(distinct) else (np.zeros((0, 2 * DIM), np.float32), None)
        at, text = windows(starts)
        rows = np.where(at < 0, -1, code[at]) if len(code) else at
        return np.maximum.reduceat(self.logits(x, rows), np.searchsorted(text, np.arange(len(texts))))


def train(texts: list[str], toxic: list[int], seed: int = 3, epochs: int = 6, batch: int = 192) -> Network:
    """Adam on windows. A toxic document need not be so throughout: after two epochs only its windows that
    look toxic, at least the one that does most, count as such, and its others are left out. One document
    in six is left out to fit the scale of the final logits."""
    rng = np.random.default_rng(seed)
    y, apart = np.array(toxic), np.arange(len(texts)) % 6 == 5
    distinct, code, starts = split_words(pa.array(texts, pa.string()))
    documents = np.unique(code.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), np.diff(starts))) // max(len(texts), 1)
    frequency = np.bincount(documents, minlength=len(distinct))
    del documents
    top = np.argsort(-frequency, kind="stable")[:VOCABULARY]
    net = Network(distinct.take(pa.array(top[frequency[top] >= 4]))).start(seed)
    x_codes, x_starts = ngrams(distinct, SIZES, BUCKETS)
    row, by, per_word = lookup(distinct, net.vocabulary), (1 / np.sqrt(np.maximum(np.diff(x_starts), 1))).astype(np.float32)[:, None], np.diff(x_starts)
    at, text = windows(starts)
    if len(code):
        np.copyto(at, code.astype(np.int32)[at], where=at >= 0)
    usable = np.flatnonzero(~apart[text])
    moments, t = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    believed = np.zeros(len(text), np.float32)
    for epoch in range(epochs):
        rank = rng.random(len(text))
        if epoch >= 2:  # half of them those that look most toxic, in clean documents too
            rank = np.where(rng.random(len(text)) < 0.5, -believed, rank + 1e6)
        shuffled = usable[np.lexsort((rank[usable], text[usable]))]
        nth = np.arange(len(shuffled)) - np.searchsorted(text[shuffled], text[shuffled])
        chosen = shuffled[nth < WINDOWS_OF_DOC]
        if epoch >= 2:
            most = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(most, text, believed)
            top_of_doc = usable[believed[usable] >= most[text[usable]]]
            chosen = np.union1d(chosen, top_of_doc)
            chosen = chosen[(y[text[chosen]] == 0) | (believed[chosen] > 0) | (believed[chosen] >= most[text[chosen]])]
        chosen = rng.permutation(chosen)
        positive = y[text[chosen]].mean()
        heavy = np.clip((1 - positive) / max(positive, 1e-3), 1, 4)
        for i in range(0, len(chosen), batch):
            own = chosen[i : i + batch]
            used, back = np.unique(at[own], return_inverse=True)
            back = back.reshape(at[own].shape) - (used[0] == -1)
            used = used[used >= 0]
            picked = np.concatenate([np.arange(x_starts[w], x_starts[w + 1]) for w in used]) if len(used) else np.zeros(0, np.int64)
            edges = np.concatenate([[0], np.cumsum(per_word[used])])
            x = np.hstack([net.p["words"][row[used]], summed(net.p["grams"], x_codes[picked], edges) * by[used]])
            logit, cache = net.run(x, back, keep=True)
            target = y[text[own]].astype(np.float32)
            d = (sigmoid(logit) - target) * np.where(target > 0, heavy, 1) / len(own)
            g, d_x = net.gradient(x, back, cache, d.astype(np.float32))
            g["words"] = by_row(row[used], d_x[:, :DIM], len(net.p["words"]))
            g["grams"] = by_row(x_codes[picked], np.repeat(d_x[:, DIM:] * by[used], per_word[used], axis=0), BUCKETS)
            t += 1
            rate = 0.01 * (0.5 if epoch >= epochs - 2 else 1)
            for k, v in net.p.items():
                m, s = moments[k]
                step = g[k] + 1e-5 * v
                m += 0.1 * (step - m)
                s += 0.001 * (step * step - s)
                v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        if epoch >= 1:  # how each window looks now
            x = np.hstack([net.p["words"][row], summed(net.p["grams"], x_codes, x_starts) * by])
            believed = net.logits(x, at)
            del x
    z = np.full(len(texts), -np.inf)
    np.maximum.at(z, text, believed)
    if apart.any() and 0 < y[apart].sum() < apart.sum():
        net.scale, net.shift = calibrate(z[apart], y[apart])
    return net


def calibrate(z: np.ndarray, y: np.ndarray, clean_weighs: float = 4.0) -> tuple[float, float]:
    """Scale 1 and the shift that puts 0.5 between the kinds: the middle of the logits at which the rate
    of missed toxic documents plus ``clean_weighs`` times that of suspected clean ones is least."""
    order = np.sort(z)
    between = np.concatenate([order[:1] - 1, (order[1:] + order[:-1]) / 2, order[-1:] + 1])
    toxic, clean = np.sort(z[y == 1]), np.sort(z[y == 0])
    cost = np.searchsorted(toxic, between) / len(toxic) + clean_weighs * (1 - np.searchsorted(clean, between) / len(clean))
    best = between[cost <= cost.min() + 1e-9]
    return 1.0, -float((best[0] + best[-1]) / 2)


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can; else the driver keeps what training took."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network for the labelled documents: at most ``most`` toxic and three times as many clean ones, chosen by a hash of the id,
    and at most twice as many windows of their whole texts (``fetch_sample``). An id that repeats counts once; one with both labels is left out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_label"))
    ids = bounded_sample(known.filter("_label = 1"), "_id", "_label", most) + bounded_sample(known.filter("_label = 0"), "_id", "_label", 3 * most)
    both = set(ids)
    label = {i: y for i, y in ids if (i, 1 - y) not in both}
    if len(set(label.values())) < 2:
        return None
    rows = fetch_sample(docs, [(i,) for i in label], [id_col], text_col)
    order = np.random.default_rng(1).permutation(len(rows))
    rows = [rows[i] for i in order]
    net = train([r[1] for r in rows], [label[r[0]] for r in rows]) if len({label[r[0]] for r in rows}) == 2 else None
    give_back()
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``score`` from 0 to 1.

    All windows of ``WINDOW`` words that begin every ``STRIDE`` words are scored; the highest tells the
    document's score. Null and empty texts have one empty window. Without a network (no labelled
    documents of both kinds) every score is 0. Repeated rows are scored each; an empty table gives
    an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                z = np.zeros(part.num_rows) if net is None else sigmoid(net.scale * net.document_logits(part.column(1)).astype(np.float64) + net.shift)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that score 0.5 or more, all columns kept; the texts are scored where they are read."""
    net = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    if net is None:
        return docs

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        return pd.Series(np.concatenate([sigmoid(net.scale * net.document_logits(c.column(0)).astype(np.float64) + net.shift) < 0.5 for c in chunks(batch, 0)] or [np.zeros(0, bool)]))

    return docs.filter(clean(F.col(text_col)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 5) != 0)
    scored = score(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
