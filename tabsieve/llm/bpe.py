"""Byte-pair encoding by an index of pair occurrences, and decoding.

The words of a batch of texts, each once, are laid out as one array of symbols with links to the next and previous one.
An index maps each mergeable pair (by its rank) to all positions where it stands. Active ranks are taken in ascending
order: all positions of a rank are merged at once, and the pairs that this makes are entered into their lists. Merging
a pair can make a pair of lower rank only where two rules yield the same symbol; a word where that happens is encoded
again one merge at a time, so that the result is always that of the sequential rule.

The vocabulary file is JSON as the tokenizers library writes it: BPE with an end-of-word suffix, NFC, lower case,
words split by a pattern, bytes as printable characters. Special tokens in a text are recognised as the library does.
Without a decoder in the file, decoding joins the tokens with spaces, as the library does; it sees nothing but the ids.

Results: null text is empty text: no tokens, and the digests of nothing; long texts and words are encoded whole;
repeated rows and null ids are kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of which the ids are kept from one batch to the next, and words encoded at once.
CACHE = 150_000
AT_ONCE = 60_000
#: Texts encoded together hold about this many characters.
RUN = 2_000_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(keep))
    return [table[b] for b in range(256)]


class Vocabulary:
    """What the vocabulary file says: symbols, merges by pair, special tokens, pattern."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, norm, pre = spec["model"], spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [n["type"] for n in norm] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("a vocabulary file of another kind")
        self.suffix = model["end_of_word_suffix"] or ""
        self.id_of: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.id_of.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.word = regex.compile(pre[0]["pattern"]["Regex"])
        # what an id adds to a decoded text; ids that no token has add nothing
        self.spoken = pa.array([self.token[i] + " " if i in self.token else "" for i in range(max(self.token) + 1)], pa.large_binary())
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.file, self.library = file, None
        self.usual: set[str] = set()
        chars = byte_characters()
        self.inner = np.array([self.id_of[c] for c in chars], np.int64)
        self.last = np.array([self.id_of[c + self.suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([self.id_of[a] << 20 | self.id_of[b] for a, b in pairs], np.int64)
        self.left, self.right = key >> 20, key & (1 << 20) - 1
        self.made = np.array([self.id_of[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.rank_of = dict(zip(key.tolist(), range(len(key))))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for those that are never merged."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            new = set(text) - self.usual
            self.usual.update(c for c in new if unicodedata.category(c) != "Cn")
            if not new <= self.usual:
                return self.library_words(text)
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case is taken letter by letter: no final form
        return self.word.findall(text.lower())

    def library_words(self, text: str) -> list[str]:
        """The same by the library's own normaliser and splitter: for texts with characters that some Unicode version
        does not know, on which the library and Python may disagree."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file), {ord(c): b for b, c in enumerate(byte_characters())}
        t, back = self.library
        found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        return [bytes(map(back.__getitem__, map(ord, w))).decode("utf-8") for w, _ in found]

    def pieces(self, text: str | None) -> list[str]:
        """Words and special tokens, in order."""
        if not text:
            return []
        if self.split is None or "<|" not in text and not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.split.split(text)):
            out += [part] if k % 2 else self.words(part)
        return out


def merge_words(voc: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, how many each has)."""
    raw = [w.encode("utf-8") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    n = len(buf)
    word = np.repeat(np.arange(len(raw)), size)
    ends = np.cumsum(size) - 1
    sym = voc.inner[buf]
    sym[ends] = voc.last[buf[ends]]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[ends] = -1
    prv[ends - size + 1] = -1
    alive = np.ones(n, bool)
    again = np.zeros(len(raw), bool)  # words to be done one merge at a time

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> np.ndarray:
        """Put the pairs that begin at these positions into the index; returns their ranks."""
        r = voc.rank(sym[at], sym[nxt[at]])
        some = r >= 0
        r_in, at = r[some], at[some]
        if len(at) == 1:
            groups = [(int(r_in[0]), at)]
        else:
            order = np.argsort(r_in, kind="stable")
            r_s, at = r_in[order], at[order]
            cut = np.flatnonzero(r_s[1:] != r_s[:-1]) + 1
            groups = zip(r_s[np.concatenate([[0], cut])].tolist(), np.split(at, cut)) if len(at) else ()
        for k, places in groups:
            if k in index:
                index[k].append(places)
            else:
                index[k] = [places]
                heapq.heappush(active, k)
        return r

    if n:
        enter(np.flatnonzero(nxt >= 0))
    while active:
        k = heapq.heappop(active)
        lists = index.pop(k)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = voc.left[k], voc.right[k]
        at = at[alive[at] & (sym[at] == a) & (nxt[at] >= 0)]
        at = at[sym[nxt[at]] == b]
        if a == b and len(at) > 1:  # of overlapping pairs the first, the third, ...
            joined = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = voc.made[k]
        alive[gone] = False
        nxt[at] = after
        inside = after >= 0
        prv[after[inside]] = at[inside]
        before = prv[at]
        new = np.concatenate([before[before >= 0], at[inside]])
        if len(new):
            r = enter(new)
            if ((r >= 0) & (r < k)).any():
                again[word[new[(r >= 0) & (r < k)]]] = True
    ids, count = sym[alive], np.bincount(word[alive], minlength=len(raw))
    if again.any():
        parts = np.split(ids, np.cumsum(count)[:-1])
        for w in np.flatnonzero(again):
            parts[w] = np.array(merge_one(voc, raw[w]))
        ids, count = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return ids, count


def merge_one(voc: Vocabulary, raw: bytes) -> list[int]:
    """One word, one merge at a time: always the pair of lowest rank, of equal ones the first."""
    sym = [*voc.inner[list(raw[:-1])].tolist(), int(voc.last[raw[-1]])]
    nxt, prv = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
    heap: list[tuple[int, int, int]] = []

    def enter(i: int) -> None:
        key = sym[i] << 20 | sym[nxt[i]]
        if (r := voc.rank_of.get(key)) is not None:
            heapq.heappush(heap, (r, i, key))

    for i in range(len(sym) - 1):
        enter(i)
    while heap:
        r, i, key = heapq.heappop(heap)
        if sym[i] < 0 or nxt[i] < 0 or sym[i] << 20 | sym[nxt[i]] != key:
            continue
        j = nxt[i]
        sym[i], sym[j], nxt[i] = int(voc.made[r]), -1, nxt[j]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
            enter(i)
        if prv[i] >= 0:
            enter(prv[i])
    return [s for s in sym if s >= 0]


class Encoder:
    """Encodes and decodes texts; keeps what it has found for words."""

    def __init__(self, file: str):
        self.voc = Vocabulary(file)
        self._clear()

    def _clear(self) -> None:
        self.ids = {s: int(i).to_bytes(4, "little") for s, i in self.voc.special.items()}

    def _learn(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), AT_ONCE):
            part = fresh[i : i + AT_ONCE]
            ids, count = merge_words(self.voc, part)
            flat, at = ids.astype("<u4").tobytes(), 0
            for w, c in zip(part, count.tolist()):
                self.ids[w] = flat[4 * at : 4 * (at + c)]
                at += c

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        batch: list[list[str]] = []
        held = 0
        for k, t in enumerate(texts):
            batch.append(self.voc.pieces(t))
            held += len(t or "")
            if held < RUN and k < len(texts) - 1:
                continue
            fresh = set().union(*batch).difference(self.ids)
            if len(self.ids) + len(fresh) > CACHE:
                self._clear()
                fresh = set().union(*batch).difference(self.ids)
            self._learn(sorted(fresh))
            for ws in batch:
                yield b"".join(map(self.ids.__getitem__, ws))
            batch, held = [], 0

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: their tokens, joined by spaces."""
        said = self.voc.spoken.take(pa.array(np.frombuffer(ids, "<u4")))
        end = np.frombuffer(said.buffers()[1], np.int64)[len(said)] if len(said) else 0
        return said.buffers()[2][: end - 1].to_pybytes() if end else b""


def public_file(name: str) -> str:
    """The content of one of the public tokenizers' files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, file: str) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. file: the vocabulary file's content, of a size
    that does not depend on the data; it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(file)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        sha = hashlib.sha256
        for s in batches:
            rows = [(len(ids) // 4, sha(ids).hexdigest(), sha(encoder.decode(ids)).hexdigest()) for ids in encoder.encode_batch(list(s))]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run("text").alias("t")).select("doc_id", "t.*")
