"""Language identification by a linear-chain conditional random field over words.

A word's potentials come from hashed features: the word itself (lexicon), prefixes and suffixes up to 3 bytes, and
character 2- to 4-grams. Transitions between the labels of neighbouring words are learned with them, from sequences
spliced from labelled documents of different languages, as in code-switched text. Forward-backward gives each word's
label probabilities; a document's probabilities are their mean over all its words. A document's certainty is the mean of
its words' largest probabilities: high too where languages share a text and none of them leads.

Forward-backward runs over the words of many texts at once: each text is cut into chunks of CHUNK words, the chunks'
transfer matrices are multiplied in step, the short chains of matrices are then walked, and the chunks are run with the
messages that reach them. That equals one pass over the whole text, whatever its length.

Training takes, of the rows with a letter whose crc32(doc_id) mod 5 is not 0, about PER_LABEL of each label at most (those
of smallest id hash; of rows that repeat an id and label, one) and of each TRAIN_CHARS characters at most, of the
MAX_LABELS labels with most rows. A label without a word there is not learned and never given.

Results: lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing could be learned; ties go
to the label that sorts first; keep_identified rejects `und` and texts of little certainty; null ids are neither learned from nor held out; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out, in_training, sample_ids, sampled_rows, text_window

PER_LABEL = 300
TRAIN_CHARS = 4000
MAX_LABELS = 200
BUCKETS = 1 << 17
CHUNK = 32
EPOCHS = 4
SEED = 7
#: Words of which potentials are kept from one batch to the next.
CACHE = 200_000
#: Words run at once.
RUN = 400_000
WORD = regex.compile(r"\p{L}+")
_LETTER = r"\p{L}"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULT
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features, row by row; where each word's begin). A word is seen as bytes with ^ and $ around it."""
    raw = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(raw)), size)
    room = np.repeat(start + size, size) - np.arange(len(buf))  # bytes from here to the word's end
    found, owner = [], []
    h = np.zeros(len(buf), np.uint64)
    for n in range(1, 5):
        keep = len(buf) - n + 1
        if keep <= 0:
            break
        h = h[:keep] * np.uint64(257) + buf[n - 1 :] + np.uint64(1)
        at = np.flatnonzero(room[:keep] >= n)
        if n > 1:
            found.append(_mix(h[at] + np.uint64(n << 40)))
            owner.append(word[at])
    # the 2- to 4-grams with ^ or $ are the prefixes and suffixes of up to 3 bytes
    place = (np.arange(len(buf)) - start[word]).astype(np.uint64) * np.uint64(2) + np.uint64(3)
    total = np.add.reduceat((buf + np.uint64(1)) * (place * place * _MULT), start)
    found.append(_mix(total + np.uint64(9 << 40)))
    owner.append(np.arange(len(raw)))
    own, val = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=len(raw))
    return val[order], np.cumsum(count) - count


def potentials(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, labels): the sum of the weights of each word's features."""
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    out = [np.add.reduceat(weights[f], at) for f, at in (features(words[i : i + 50_000]) for i in range(0, len(words), 50_000))]
    return np.concatenate(out)


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Forward-backward. emit: (words, labels) of all texts in a row; lengths: words of each text, none of them 0;
    trans: (labels, labels). Returns the label probabilities of each word."""
    n, k = emit.shape
    e = np.exp(emit.astype(np.float64) - emit.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max())
    per = -(-lengths // chunk)  # chunks of each text
    first = np.cumsum(per) - per
    text = np.repeat(np.arange(len(lengths)), per)
    begin = (np.cumsum(lengths) - lengths)[text] + (np.arange(len(text)) - first[text]) * chunk
    size = np.minimum(chunk, np.repeat(np.cumsum(lengths), per) - begin)
    # chunks in order of length, so that step t works on those that have a word t
    m = len(begin)
    longest = int(size.max())
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    live = [int(np.searchsorted(-size_o, -t, side="left")) for t in range(longest + 1)]  # live[t]: chunks with size > t
    # the transfer matrix of a chunk: of the state before it to the state at its end
    mat = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(longest):
        c = live[t]
        x = (mat[:c] @ a) * e[begin_o[:c] + t][:, None, :]
        mat[:c] = x / x.sum(axis=(1, 2), keepdims=True)
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    mat = mat[back]
    # messages into each chunk from the left and from the right: walk the chunks of all texts in step
    left, right = np.empty((m, k)), np.empty((m, k))
    many = np.argsort(-per, kind="stable")
    deep = np.array([int(np.searchsorted(-per[many], -s, side="left")) for s in range(int(per.max()) + 1)])
    msg = np.full((len(per), k), np.nan)
    for s in range(int(per.max())):
        some = many[: deep[s]]
        at = first[some] + s
        if s == 0:
            left[at] = np.nan  # a text's first word has no transition before it
            c = at
            fw = e[begin[c]]
            rest = _rest_matrix(c, begin, size, e, a)
            x = np.einsum("ij,ijk->ik", fw, rest)
        else:
            left[at] = msg[some]
            x = np.einsum("ij,ijk->ik", msg[some], mat[at])
        msg[some] = x / x.sum(axis=1, keepdims=True)
    msg = np.ones((len(per), k))
    for s in range(int(per.max()) - 1, -1, -1):
        some = many[: deep[s]]
        at = first[some] + s
        right[at] = msg[some]
        if s:
            x = np.einsum("ijk,ik->ij", mat[at], msg[some])
            msg[some] = x / x.sum(axis=1, keepdims=True)
    # inside the chunks
    alpha = np.empty((n, k))
    cur, begins = left[order], np.isnan(left[order, 0])
    for t in range(longest):
        c = live[t]
        x = cur[:c] @ a
        if t == 0:
            x[begins[:c]] = 1.0
        x *= e[begin_o[:c] + t]
        cur[:c] = x / x.sum(axis=1, keepdims=True)
        alpha[begin_o[:c] + t] = cur[:c]
    cur = right[order]
    for t in range(longest - 1, -1, -1):
        c = live[t]
        at = begin_o[:c] + t
        beta = cur[:c].copy()
        alpha[at] *= beta
        x = (beta * e[at]) @ a.T
        cur[:c] = x / x.sum(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


def _rest_matrix(c: np.ndarray, begin: np.ndarray, size: np.ndarray, e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Transfer matrices of chunks without their first word: from its state to the state at the chunk's end."""
    order = np.argsort(-size[c], kind="stable")
    b, s = begin[c][order], size[c][order]
    k = e.shape[1]
    mat = np.broadcast_to(np.eye(k), (len(c), k, k)).copy()
    for t in range(1, int(s.max())):
        live = int(np.searchsorted(-s, -t, side="left"))
        x = (mat[:live] @ a) * e[b[:live] + t][:, None, :]
        mat[:live] = x / x.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(mat)
    out[order] = mat
    return out


def _splice(rng: np.random.Generator, pool: list[tuple[list[str], int]], count: int, length: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sequences of `length` words: spans of documents of changing languages, the length of a span being drawn anew."""
    words, labels, sizes = [], [], []
    for _ in range(count):
        got = 0
        while got < length:
            ws, y = pool[int(rng.integers(len(pool)))]
            take = min(length - got, int(rng.integers(5, length)))
            at = int(rng.integers(max(1, len(ws) - take + 1)))
            words += (span := ws[at : at + take])
            labels += [y] * len(span)
            got += len(span)
        sizes.append(got)
    return words, np.array(labels), np.array(sizes)


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """rows: (text, label). Maximises the conditional likelihood by AdaGrad on batches of spliced sequences."""
    found = [(ws, y) for text, y in sorted(rows) if (ws := words_of(text))]
    labels = sorted({y for _, y in found})
    k = len(labels)
    weights, trans = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    by: list[list[tuple[list[str], int]]] = [[] for _ in labels]
    for ws, y in found:
        by[labels.index(y)].append((ws, labels.index(y)))
    if k > 1:
        rng = np.random.default_rng(seed)
        even = min(max(map(len, by)), PER_LABEL)
        pool = [b[i % len(b)] for b in by for i in range(even)]
        g_w, g_t = np.full((BUCKETS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
        steps = epochs * max(8, len(pool) // 40)
        for _ in range(steps):
            words, y, sizes = _splice(rng, pool, 40, 100)
            f, at = features(words)
            p = marginals(np.add.reduceat(weights[f], at), sizes, trans)
            err = -p
            err[np.arange(len(y)), y] += 1.0
            inside = np.ones(len(y) - 1, bool)
            inside[np.cumsum(sizes)[:-1] - 1] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1)
            d_t = (seen - pair_sums(np.add.reduceat(weights[f], at), sizes, trans)) / len(y)
            g_t += d_t**2
            trans += 0.2 * d_t / np.sqrt(g_t)
            count = np.diff(np.append(at, len(f)))
            d = (np.repeat(err / len(y), count, axis=0)).astype(np.float32)
            hit, inv = np.unique(f, return_inverse=True)
            d_w = np.stack([np.bincount(inv, weights=d[:, j], minlength=len(hit)) for j in range(k)], axis=1).astype(np.float32)
            g_w[hit] += d_w**2
            weights[hit] += 0.3 * d_w / np.sqrt(g_w[hit])
    return {"labels": labels, "weights": weights, "trans": trans}


def pair_sums(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring label pairs. All texts have the same number of words here."""
    k, n = emit.shape[1], int(sizes[0])
    x = np.exp(emit.astype(np.float64) - emit.max(axis=1, keepdims=True)).reshape(-1, n, k)
    a = np.exp(trans - trans.max())
    fw, bw = np.empty_like(x), np.empty_like(x)
    fw[:, 0], bw[:, -1] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True), 1.0
    for t in range(1, n):
        v = (fw[:, t - 1] @ a) * x[:, t]
        fw[:, t] = v / v.sum(axis=1, keepdims=True)
        v = (bw[:, n - t] * x[:, n - t]) @ a.T
        bw[:, n - t - 1] = v / v.sum(axis=1, keepdims=True)
    joint = fw[:, :-1, :, None] * a * (bw * x)[:, 1:, None, :]
    return (joint / joint.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))


class Labeller:
    """A trained model and the potentials of words lately seen."""

    def __init__(self, model: dict):
        self.labels, self.weights, self.trans = model["labels"], model["weights"], model["trans"]
        self.rows: dict[str, int] = {}
        self.known = np.zeros((0, max(1, len(self.labels))), np.float32)

    def _emit(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.rows]
        if fresh:
            if len(self.rows) + len(fresh) > CACHE:
                self.rows, self.known = {}, self.known[:0]
                fresh = list(dict.fromkeys(words))
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.known = np.concatenate([self.known, potentials(self.weights, fresh)])
        return self.known[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of each word of each text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        some = sizes > 0
        if not some.any():
            return [np.zeros((0, len(self.labels))) for _ in texts]
        p = marginals(self._emit([w for t in texts for w in t]), sizes[some], self.trans)
        return np.split(p, np.cumsum(sizes)[:-1])

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the label, its score and the certainty."""
        preds, scores, sure, batch, held = [], [], [], [], 0

        def flush() -> None:
            for p in self.words(batch):
                mean = p.mean(axis=0) if len(p) else None
                preds.append("und" if mean is None else self.labels[int(mean.argmax())])
                scores.append(0.0 if mean is None else float(min(1.0, mean.max())))
                sure.append(0.0 if mean is None else float(min(1.0, p.max(axis=1).mean())))
            batch.clear()

        for t in texts:
            batch.append(words_of(t) if self.labels else [])
            held += len(batch[-1])
            if held >= RUN:
                flush()
                held = 0
        if batch:
            flush()
        return preds, scores, sure


def fit(docs: DataFrame, per_label: int = PER_LABEL, chars: int = TRAIN_CHARS) -> dict:
    """The model from docs' doc_id, text and lang."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    ok = rows.filter(in_training(F.col("_id")) & F.col("_lang").isNotNull() & F.col("_text").rlike(_LETTER))
    often = ok.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MAX_LABELS).select("_lang")
    ids = sample_ids(ok.select("_id", "_lang").join(F.broadcast(often), "_lang"), "_lang", per_label)
    part = text_window(F.col("_text"), F.col("_id"), chars)
    part = F.when(part.rlike(_LETTER), part).otherwise(F.substr(F.regexp_replace("_text", r"^\P{L}+", ""), F.lit(1), F.lit(chars)))
    got = sampled_rows(ok.select("_id", "_lang", part.alias("t")), ids, ["_id", "_lang"], "_lang")
    return train([(r.t, r._lang) for r in got.collect()])


def predict(docs: DataFrame, model: dict, text: Column) -> Column:
    """A struct column (lang_pred, score, certainty) over docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, certainty double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for s in batches:
            preds, scores, sure = labeller.documents(list(s))
            yield pd.DataFrame({"lang_pred": preds, "score": scores, "certainty": sure})

    return run(text)


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred, score."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(docs, fit(docs, **bounds), F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs whose words' languages are found with a certainty of `least` or more, with their columns."""
    p = free_name(docs, "_lang_pred")
    scored = docs.withColumn(p, predict(docs, fit(docs), F.col("text")))
    return scored.filter((F.col(p)["lang_pred"] != "und") & (F.col(p)["certainty"] >= least)).select(*docs.columns)
