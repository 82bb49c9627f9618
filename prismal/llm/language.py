"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, fitted by expectation maximisation over all
segmentations of all words of a bounded sample (`sample_docs` distinct texts, the languages in turn, so that each has rows). A word's score in a language is the sum over all its segmentations, by the forward algorithm; a text's is the
product over its words. Distinct runs of letters, in lower case, are scored once per worker and cached over its tasks.

Defined results: `und` and score 0 where a text is null or has no letter; with nothing to learn from, `und` throughout;
a null language is never learned; repeated rows get equal rows; other columns are ignored. A letter is a character of a Unicode category L; what is left of a run of other word characters is apart.
Segmentations are summed over the whole of a word, however long, in fitting and in scoring (by logarithms over 32 letters). Ties go to the language that comes first in the alphabet.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismal.llm.common import drop_table, table

RUNS = re.compile(r"[^\W\d_]+").findall
PART, UNKNOWN = 32, 1e-8
#: Ranges of the hashes of a language's texts that are counted before its sample is taken.
BINS = 1 << 14


def letters(text: str) -> list[str]:
    """Runs of letters: what other characters stand in a run of word characters (superscripts, fractions, numerals) cuts it."""
    out = []
    for w in RUNS(text):
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


def parts(chunk: str) -> list[str]:
    """The words of a text as the model reads them: lower case, with a mark at the start."""
    return ["▁" + w for w in letters(chunk.lower())]


def pieces(path: str) -> list[str]:
    """Distinct lower-case pieces of a sentencepiece vocabulary, those made of letters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in found if letters(p.removeprefix("▁")) == [p.removeprefix("▁")] or p == "▁")


def posterior(edges: list[tuple[int, int, int]], size: int, prob: list[float]) -> Iterator[tuple[int, float]]:
    """(piece, expected count) of each edge of a long word's lattice; sums are kept as logarithms."""
    a, b, lp = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf), {k: math.log(max(prob[k], 1e-300)) for _, _, k in edges}
    a[0] = b[size] = 0.0
    for i, j, k in edges:
        a[j] = np.logaddexp(a[j], a[i] + lp[k])
    for i, j, k in reversed(edges):
        b[i] = np.logaddexp(b[i], lp[k] + b[j])
    for i, j, k in edges:
        yield k, math.exp(a[i] + lp[k] + b[j] - b[0])


class Trie:
    """The prefixes of the vocabulary by number: first those that go on, then those that end there; 0 is none. A row a prefix that goes on, a column a character."""

    def __init__(self, index: dict[str, int]) -> None:
        inner = dict.fromkeys(p[:k] for p in index for k in range(1, len(p)))
        self.inner = len(inner)
        number = {p: k + 1 for k, p in enumerate([*inner, *(p for p in index if p not in inner)])}
        self.piece = np.array([0, *(index.get(p, 0) for p in number)], "i4")
        self.root, self.column = np.zeros(0x110000, "i4"), np.zeros(0x110000, "i4")
        later = sorted({c for p in index for c in p[1:]})
        self.column[[ord(c) for c in later]] = np.arange(1, len(later) + 1)
        self.next = np.zeros((self.inner + 1, len(later) + 1), "i4")
        for p, k in number.items():
            if len(p) > 1:
                self.next[number[p[:-1]], self.column[ord(p[-1])]] = k
            else:
                self.root[ord(p)] = k


class Model:
    def __init__(self, langs: list[str], vocabulary: list[str]) -> None:
        self.langs = langs
        self.index = {p: k + 1 for k, p in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)
        self.p = np.full((len(vocabulary) + 1, max(1, len(langs))), 1.0 / (len(vocabulary) + 1))
        self.p[0] = UNKNOWN
        self.prior = np.zeros(max(1, len(langs)))
        self._trie: Trie | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": None}  # built where it is used

    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie(self.index)
        return self._trie

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of a word's segmentation lattice; a single character always has an edge, 0 if unknown."""
        out, get = [], self.index.get
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                k = get(word[i:j], 0)
                if k or j == i + 1:
                    out.append((i, j, k))
        return out

    def fit(self, counts: dict[str, dict[str, int]], rounds: int = 4) -> None:
        for at, lang in enumerate(self.langs):
            lattices = [(self.edges(w), len(w), n) for w, n in counts[lang].items()]
            p = np.full(len(self.p), 1e-4)
            for edges, _, n in lattices:
                for i, j, k in edges:
                    p[k] += n * (j - i)
            p /= p.sum()
            for _ in range(rounds):
                p[0] = UNKNOWN
                got, prob = defaultdict(float), p.tolist()
                for edges, size, n in lattices:
                    if size > PART:
                        for k, share in posterior(edges, size, prob):
                            got[k] += n * share
                        continue
                    a, b = [1.0] + [0.0] * size, [0.0] * size + [1.0]
                    for i, j, k in edges:
                        a[j] += a[i] * prob[k]
                    for i, j, k in reversed(edges):
                        b[i] += prob[k] * b[j]
                    for i, j, k in edges:
                        got[k] += n * a[i] * prob[k] * b[j] / b[0]
                p = np.full(len(self.p), 0.02)
                for k, v in got.items():
                    p[k] += v
                p /= p.sum()
            p[0] = UNKNOWN
            self.p[:, at] = p

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Rows: words; columns: languages."""
        out = np.empty((len(words), self.p.shape[1]))
        size = np.array([len(w) for w in words], "i8")
        for k in np.flatnonzero(size > PART):
            out[k] = self.long_likelihood(words[k])
        order = np.argsort(-size, kind="stable")
        order = order[np.count_nonzero(size > PART) :]
        step = max(256, (1 << 15) // self.p.shape[1])
        for at in range(0, len(order), step):
            some = order[at : at + step]
            out[some] = np.log(np.maximum(self.forward([words[k] for k in some], size[some]), 1e-300))
        return out

    def forward(self, words: list[str], size: np.ndarray) -> np.ndarray:
        """The forward algorithm for words of PART letters at most, the longest first. Only substrings that the vocabulary's trie knows are followed."""
        trie, most = self.trie(), int(size[0])
        code = np.array(words, f"U{max(1, most)}").view("u4").reshape(len(words), -1).T.copy()
        column = trie.column[code]
        over = [int(np.count_nonzero(size > k)) for k in range(most + 1)]  # how many words, which come first, have a letter at place k
        alpha = np.zeros((most + 1, len(words), self.p.shape[1]))
        alpha[0] = 1
        for i in range(most):
            here = alpha[i]
            node = trie.root[code[i, : over[i]]]
            alpha[i + 1, : over[i]] += here[: over[i]] * self.p[trie.piece[node]]  # a single character always has an edge
            at = np.flatnonzero((node > 0) & (node <= trie.inner))
            node = node[at]
            for j in range(i + 1, most):
                fit = int(np.searchsorted(at, over[j]))
                at = at[:fit]
                if not fit:
                    break
                node = trie.next[node[:fit], column[j, at]]
                piece = trie.piece[node]
                met = np.flatnonzero(piece)
                to = at[met]
                alpha[j + 1, to] += here[to] * self.p[piece[met]]
                on = np.flatnonzero((node > 0) & (node <= trie.inner))
                at, node = at[on], node[on]
        return alpha[size, np.arange(len(words))]

    def long_likelihood(self, word: str) -> np.ndarray:
        """The same for one long word, by logarithms of the sums at the last places."""
        sums = [np.zeros(self.p.shape[1])]
        for j in range(1, len(word) + 1):
            steps = [(j - i, self.index.get(word[i:j], 0)) for i in range(max(0, j - self.longest), j)]
            here = np.logaddexp.reduce([sums[-back] + np.log(self.p[k]) for back, k in steps if k or back == 1])
            sums = [*sums[1 - self.longest :], here] if self.longest > 1 else [here]
        return sums[-1]


class Scorer:
    """Sums over a text's runs of letters; the vector of a run is computed once and cached, up to `cached` runs."""

    def __init__(self, model: Model, cached: int = 400_000) -> None:
        self.model, self.cached = model, cached
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.model.p.shape[1] + 1))

    def add(self, new: list[str]) -> None:
        """The vectors of new runs: sums over their words, and how many those are."""
        base = len(self.at)
        if base + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:base], np.zeros((max(base, len(new)), self.rows.shape[1]))])
        plain = np.array([x.isalpha() for x in new], bool)
        rows = self.rows[base : base + len(new)]
        rows[plain, :-1] = self.model.log_likelihood(["▁" + x for x in new if x.isalpha()])
        rows[plain, -1] = 1
        for k in np.flatnonzero(~plain):
            words = parts(new[k])
            rows[k] = [*self.model.log_likelihood(words).sum(0), len(words)]
        self.at.update(zip(new, range(base, base + len(new)), strict=True))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods, number of word parts) of the texts."""
        runs = [RUNS(t.lower()) for t in texts]
        need = set().union(*runs)
        new = need.difference(self.at)
        if len(self.at) + len(new) > self.cached and self.at:
            self.clear()
            new = need
        if new:
            self.add(list(new))
        sums = np.zeros((len(texts), self.rows.shape[1]))
        size = np.array([len(x) for x in runs], "i8")
        some = np.flatnonzero(size)
        if len(some):
            at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(runs)), "i8", int(size.sum()))
            sums[some] = np.add.reduceat(self.rows[at], (np.cumsum(size) - size)[some])
        return sums[:, :-1], sums[:, -1]


_SCORERS: list[Scorer] = []


def scorer(model: Model) -> Scorer:
    """The scorer of the model that this worker used last, with what it has cached."""
    if not _SCORERS or _SCORERS[0].model is not model:
        _SCORERS[:] = [Scorer(model)]
    return _SCORERS[0]


def groups(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many characters together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def sample(df: DataFrame, n: int) -> DataFrame:
    """lang, text of at most n distinct rows, or one per language if those are more. Languages take turns, each in the order of a hash of its texts.

    Distinct hashes are counted by language and by BINS ranges of the hash first, and of a language only the first ranges that hold n together are ordered.
    """
    span = 1 << 40
    known = df.filter("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64("text", "lang"), F.lit(span)).alias("h"))
    distinct = table(known.select("lang", "h").distinct(), "text-hashes")
    part = F.floor(F.col("h") / (span // BINS))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = distinct.groupBy("lang", part.alias("part")).agg(F.count("*").alias("texts")).withColumn("before", F.coalesce(F.sum("texts").over(before), F.lit(0)))
    counts = table(counts.filter(F.col("before") < n).groupBy("lang").agg(F.max("part").alias("last")), "languages")
    thinned = distinct.join(F.broadcast(counts), "lang").filter(part <= F.col("last")).select("lang", "h")
    ranked = thinned.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("turn") <= n)
    chosen = table(ranked.orderBy("turn", "h", "lang").limit(max(n, counts.count())).select("lang", "h"), "chosen")
    found = table(known.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text"), "sample")
    for t in (distinct, counts, chosen):
        drop_table(t)
    return found


def train(df: DataFrame, vocabulary: str, sample_docs: int = 4000) -> Model:
    """Fit on all words of the sample of at most sample_docs distinct whole texts (text, lang)."""
    rows = sample(df, sample_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in batches:
            c: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c[lang].update(parts(text))
            yield pa.RecordBatch.from_arrays([pa.array([x for x in c for _ in c[x]], pa.string()), pa.array([w for x in c for w in c[x]], pa.string()), pa.array([n for x in c for n in c[x].values()], pa.int64())], ["lang", "word", "n"])

    found = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in found.orderBy("lang", F.desc("n"), "word").collect():  # the words of the sample
        counts[r.lang][r.word] = r.n
    model = Model(sorted(counts), pieces(vocabulary))
    model.fit(counts)
    return model


def predict(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = scorer(shared.value)
        langs = held.model.langs
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            pred, conf = [], []
            for i, j in groups(texts):
                ll, n = held.score(texts[i:j])
                p = np.exp(ll - ll.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for row, words in zip(p, n, strict=True):
                    known = bool(words) and bool(langs)
                    pred.append(langs[int(row.argmax())] if known else "und")
                    conf.append(float(row.max()) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(conf, pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
