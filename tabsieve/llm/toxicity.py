"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the hashed vectors of itself and its character 3- to 6-grams (with < and > around it),
so that a misspelling not seen in training shares most vectors with the word it stands for. A text's vector is the mean
of its words' vectors, and a linear softmax over the two classes gives the score. Vectors and softmax are trained
jointly in numpy by AdaGrad with group shrinkage. For two classes a text's log-odds are the mean over its words of a number per word, so
scoring needs one number per bucket, not vectors.

Training takes, of the labelled rows whose crc32(doc_id) mod 5 is not 0, about PER_LABEL of each label at most (those of
smallest id hash; of rows that repeat an id, one) and of each TRAIN_CHARS characters at most.

Results: null and wordless texts get the bias alone; without labelled rows of both classes every score is 0; a doc_id
labelled twice counts as toxic if either says so; rows with null ids are scored but not learned from; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out, in_training, sample_ids, sampled_rows, text_window

PER_LABEL = 6000
TRAIN_CHARS = 6000
BUCKETS = 1 << 19
DIM = 8
STEPS = 1000
BATCH = 64
SEED = 11
#: Batches hold as many toxic as other texts; outside, one text in so many is taken to be toxic.
ONE_IN = 3
RATE = 3.0
#: AdaGrad's sums begin at this: the smaller, the further a bucket that is seldom seen may move.
GRAD_0 = 1e-4
#: Each update shrinks a vector by this much of its pace, to zero if it is short: so buckets that tell texts rather than
#: labels apart stay at nothing.
SHRINK = 3e-4
MIN_N, MAX_N = 3, 6
#: Words of which the number is kept from one batch to the next.
CACHE = 300_000
WORD = regex.compile(r"\p{L}+")
_MULT = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULT
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the words themselves and of their n-grams, row by row; how many each word has). N-grams are of
    characters."""
    raw = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer("".join(raw).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(raw)), size)
    room = np.repeat(start + size, size) - np.arange(len(buf))
    place = (np.arange(len(buf)) - start[word]).astype(np.uint64) * np.uint64(2) + np.uint64(3)
    found = [_mix(np.add.reduceat((buf + np.uint64(1)) * (place * place * _MULT), start) + np.uint64(77 << 40))]
    owner = [np.arange(len(raw))]
    h = np.zeros(len(buf), np.uint64)
    for n in range(1, MAX_N + 1):
        keep = len(buf) - n + 1
        if keep <= 0:
            break
        h = h[:keep] * np.uint64(1_000_003) + buf[n - 1 :] + np.uint64(1)
        if n >= MIN_N:
            at = np.flatnonzero(room[:keep] >= n)
            found.append(_mix(h[at] + np.uint64(n << 40)))
            owner.append(word[at])
    own, val = np.concatenate(owner), np.concatenate(found)
    return val[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(raw))


def train(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = SEED) -> dict:
    """rows: (text, label 0 or 1). Returns a number per bucket and the bias; `const` where there is nothing to learn."""
    number: dict[str, int] = {}
    docs = []
    for text, y in sorted(rows):
        if ws := words_of(text):
            ids, n = np.unique([number.setdefault(w, len(number)) for w in ws], return_counts=True)
            docs.append((ids.astype(np.int32), (n / n.sum()).astype(np.float32), y))
    if len({d[2] for d in docs}) < 2:
        return {"table": None, "bias": 0.0, "const": 0.0}
    words = list(number)
    sub, many = map(np.concatenate, zip(*[subwords(words[i : i + 50_000]) for i in range(0, len(words), 50_000)]))
    at = np.cumsum(many) - many
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    soft[:, 1] = rng.normal(0, 0.5, DIM)
    soft[:, 0] = -soft[:, 1]
    g_emb, g_soft, g_bias = np.full(BUCKETS, GRAD_0, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    by = [[i for i, d in enumerate(docs) if d[2] == y] for y in (0, 1)]
    for step in range(steps):
        rate = RATE * (1 - step / steps)
        pick = [by[y][int(i)] for y in (0, 1) for i in rng.integers(len(by[y]), size=BATCH // 2)]
        words = np.concatenate([docs[i][0] for i in pick])
        share = np.concatenate([docs[i][1] for i in pick])
        sizes = np.fromiter((len(docs[i][0]) for i in pick), np.int64, len(pick))
        doc = np.repeat(np.arange(len(pick)), sizes)
        uniq, inv = np.unique(words, return_inverse=True)
        c = many[uniq]
        flat = np.repeat(at[uniq] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        hit, back = np.unique(sub[flat], return_inverse=True)
        vec = np.add.reduceat(emb[hit][back], np.cumsum(c) - c) / c[:, None]
        text = np.add.reduceat(vec[inv] * share[:, None], np.cumsum(sizes) - sizes)
        z = text @ soft + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        y = np.array([docs[i][2] for i in pick])
        d = p.astype(np.float32)
        d[np.arange(len(y)), y] -= 1
        d_text = d @ soft.T
        for x, g, grad in ((soft, g_soft, text.T @ d / len(y)), (bias, g_bias, d.mean(axis=0))):
            g += grad**2
            x -= 0.1 * grad / np.sqrt(g)
        # of a word: the sum over the texts it is in; of a bucket: the sum over its words
        d_word = _sums(inv, d_text[doc] * share[:, None], len(uniq)) / c[:, None]
        d_hit = _sums(back, np.repeat(d_word, c, axis=0), len(hit))
        g_emb[hit] += (d_hit**2).mean(axis=1)
        pace = rate / np.sqrt(g_emb[hit])[:, None]
        new = emb[hit] - pace * d_hit
        emb[hit] = new * np.maximum(0, 1 - SHRINK * pace / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-30))
    return {"table": emb @ (soft[:, 1] - soft[:, 0]), "bias": float(bias[1] - bias[0]) - math.log(ONE_IN - 1), "const": None}


def _sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(group, weights=values[:, j], minlength=n) for j in range(values.shape[1])], axis=1).astype(np.float32)


class Scorer:
    """A trained model and the numbers of words lately seen."""

    def __init__(self, model: dict):
        self.model, self.words = model, {}

    def _learn(self, fresh: list[str]) -> None:
        table = self.model["table"]
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            sub, many = subwords(part)
            x = np.add.reduceat(table[sub].astype(np.float64), np.cumsum(many) - many) / many
            self.words.update(zip(part, x.tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.model["const"] is not None:
            return [self.model["const"]] * len(texts)
        out = []
        for i in range(0, len(texts), 512):
            bags = [words_of(t) for t in texts[i : i + 512]]
            if len(self.words) > CACHE:
                self.words = {}
            self._learn([w for w in dict.fromkeys(w for b in bags for w in b) if w not in self.words])
            known = self.words.__getitem__
            out += [(sum(map(known, b)) / len(b) if b else 0.0) + self.model["bias"] for b in bags]
        return (1 / (1 + np.exp(-np.clip(out, -500, 500)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, chars: int = TRAIN_CHARS) -> dict:
    """The model from docs' doc_id and text and labels' doc_id and toxic."""
    ys = labels.filter(in_training(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    ids = docs.select(F.col("doc_id").alias("_id")).join(ys, "_id")
    ids = sample_ids(ids, "_y", per_label)
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), text_window(F.col("text"), F.col("doc_id"), chars).alias("t"))
    return train([(r.t, r._y) for r in sampled_rows(rows, ids, ["_id"], "_y").collect()])


def score(docs: DataFrame, model: dict, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for s in batches:
            yield pd.Series(scorer.scores(list(s)), dtype="float64")

    return run(text)


def rate(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, fit(docs, labels, **bounds), F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs not predicted toxic, with their columns."""
    s = free_name(docs, "_toxicity")
    return docs.withColumn(s, score(docs, fit(docs, labels), F.col("text"))).filter(F.col(s) < 0.5).select(*docs.columns)
