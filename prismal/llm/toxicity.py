"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy by tasks that share the rows.

Words are hashed into 2^22 buckets; buckets seen in `min_docs` training documents, and in 3 of 4,000 of them, have an embedding of their own, all
others share one. Filters of width 1, 2 and 3 run over the whole text, max pooling keeps each filter's strongest
window, a logistic layer gives the score. One embedding dimension starts as the smoothed log-odds of the bucket.
Training reads every labelled row, whole texts. A hash of their ids deals them to parts of about `part_rows` rows; in each round a task passes twice
over its part from the common parameters, and the changes are averaged, those of an embedding over the parts that changed it. One part takes all
passes in one round. A fifth of the rows is set aside to
calibrate a threshold per language (the best F1; a language with under five toxic rows there takes the common one).
The score never sees language, source or id; thresholds are applied after it.

Defined results: a null or empty text gets the score of an empty text; a null label is left out; without
labels of both kinds every score is 0; repeated rows get equal rows; other columns are carried by `drop_toxic`, ignored by `score`.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import drop_table, few, give_back, table
from prismal.llm.language import groups

NOT_LETTERS = re.compile(r"[\W\d_]+")
BUCKETS = 1 << 22
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 12
NAMES = [f"d{k}" for k in range(DIM)]
#: Thresholds that are tried, the share of training documents that a bucket of its own needs, and rounds of training, and passes
#: of a round, where there are several parts.
GRID, SHARE, ROUNDS, PASSES = np.linspace(0.3, 0.9, 25), 3 / 4000, 2, 2


def bucket(chunk: str) -> int:
    """Of a chunk between blanks: its letters in lower case, hashed; 0 without letters."""
    w = NOT_LETTERS.sub("", chunk.lower())
    return 1 + xxhash.xxh64_intdigest(w) % (BUCKETS - 1) if w else 0


def unfold(rows: np.ndarray, width: int) -> np.ndarray:
    """Windows of so many consecutive rows, side by side; the end is filled with zeros."""
    pad = np.concatenate([rows, np.zeros((width - 1, rows.shape[1]), rows.dtype)])
    return np.concatenate([pad[k : len(pad) - width + 1 + k] for k in range(width)], 1)


class Model:
    """rows: sorted buckets with an embedding (row k+2); row 0 is padding, row 1 all others."""

    def __init__(self, rows: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.E = rng.normal(0, 0.1, (len(rows) + 2, DIM)).astype("f4")
        self.E[0] = 0
        self.W = {w: rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype("f4") for w in WIDTHS}
        self.b = {w: np.zeros(FILTERS, "f4") for w in WIDTHS}
        self.V = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype("f4")
        self.c = np.zeros(1, "f4")
        self.thresholds: dict[str | None, float] = {}
        self.threshold = 0.5
        self.constant: float | None = None

    def of(self, buckets: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.rows, buckets), max(0, len(self.rows) - 1))
        return np.where(self.rows[at] == buckets, at + 2, 1) if len(self.rows) else np.ones(len(buckets), "i8")

    def params(self) -> dict[str, np.ndarray]:
        return {"E": self.E, "V": self.V, "c": self.c} | {f"W{w}": self.W[w] for w in WIDTHS} | {f"b{w}": self.b[w] for w in WIDTHS}

    def vectors(self) -> np.ndarray:
        """All parameters as rows of DIM: the embeddings, then the others, filled with zeros."""
        rest = np.concatenate([v.ravel() for k, v in self.params().items() if k != "E"])
        return np.concatenate([self.E, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    def move(self, rows: np.ndarray, by: np.ndarray) -> None:
        """Add to some rows of vectors()."""
        new = self.vectors()
        new[rows] += by
        self.E[:] = new[: len(self.E)]
        rest, at = new[len(self.E) :].ravel(), 0
        for k, v in self.params().items():
            if k != "E":
                v[...] = rest[at : at + v.size].reshape(v.shape)
                at += v.size

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, heavy: float, seed: int = 7) -> None:
        """Passes over documents; a toxic one counts `heavy` times."""
        rng = np.random.default_rng(seed)
        params = self.params()
        m = {k: np.zeros_like(v) for k, v in params.items()}
        s = {k: np.zeros_like(v) for k, v in params.items()}
        weight = np.where(y == 1, heavy, 1.0)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), 32):
                grads = {k: np.zeros_like(v) for k, v in params.items() if k != "E"}
                touched: list[np.ndarray] = []
                flow: list[np.ndarray] = []
                for d in order[at : at + 32]:
                    ids = docs[d] if len(docs[d]) else np.zeros(1, "i8")
                    ids = np.concatenate([ids, np.zeros(max(WIDTHS) - 1, "i8")])
                    n = max(1, len(docs[d]))
                    rows = self.E[ids]
                    pooled, best = [], {}
                    for w in WIDTHS:
                        z = unfold(rows, w)[:n] @ self.W[w] + self.b[w]
                        best[w] = z.argmax(0)
                        pooled.append(np.maximum(0, z[best[w], np.arange(FILTERS)]))
                    h = np.concatenate(pooled)
                    mask = (rng.random(len(h)) > 0.2) / 0.8
                    p = 1 / (1 + np.exp(-np.clip(float((h * mask) @ self.V + self.c[0]), -30, 30)))
                    g = (p - y[d]) * weight[d]
                    grads["V"] += g * h * mask
                    grads["c"] += g
                    dh = g * self.V * mask * (h > 0)
                    for k, w in enumerate(WIDTHS):
                        dz = dh[k * FILTERS : (k + 1) * FILTERS]
                        where = best[w][:, None] + np.arange(w)
                        x = rows[where].reshape(FILTERS, -1)
                        grads[f"W{w}"] += (x * dz[:, None]).T
                        grads[f"b{w}"] += dz
                        touched.append(ids[where].ravel())
                        flow.append((self.W[w].T * dz[:, None]).reshape(-1, DIM))
                t += 1
                rows_at, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                ge = np.zeros((len(rows_at), DIM), "f4")
                np.add.at(ge, inverse, np.concatenate(flow))
                ge[rows_at == 0] = 0
                size = len(order[at : at + 32])
                for k, v in params.items():
                    where = rows_at if k == "E" else slice(None)
                    g = (ge if k == "E" else grads[k]) / size + (1e-4 * v[where] if k[0] == "W" else 0)
                    m[k][where] = 0.9 * m[k][where] + 0.1 * g
                    s[k][where] = 0.99 * s[k][where] + 0.01 * g * g
                    v[where] -= 0.01 * (m[k][where] / (1 - 0.9**t)) / (np.sqrt(s[k][where] / (1 - 0.99**t)) + 1e-6)

    def projected(self) -> list[list[np.ndarray]]:
        """What each row adds to each filter at each place of the window: inference only gathers and adds."""
        return [[self.E @ self.W[w][k * DIM : (k + 1) * DIM] for k in range(w)] for w in WIDTHS]

    def score(self, docs: list[np.ndarray], proj: list[list[np.ndarray]] | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        proj = proj or self.projected()
        pad = np.zeros(max(WIDTHS) - 1, "i8")
        flat = np.concatenate([x for d in docs for x in (d if len(d) else np.zeros(1, "i8"), pad)])
        sizes = np.array([max(1, len(d)) for d in docs])
        starts = np.cumsum(sizes + len(pad)) - sizes - len(pad)
        bounds = np.stack([starts, starts + sizes], 1).ravel()
        flat = np.concatenate([flat, pad])
        n = len(flat) - len(pad)
        pooled = []
        for parts, w in zip(proj, WIDTHS, strict=True):
            z = parts[0][flat[:n]]
            for k in range(1, w):
                z += parts[k][flat[k : n + k]]
            pooled.append(np.maximum(0, np.maximum.reduceat(z, bounds[: len(bounds)], axis=0)[::2] + self.b[w]))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(pooled, 1) @ self.V + self.c[0], -30, 30)))


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4").astype("i8") for x in column.to_pylist()]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cache: dict[str, int] = {}
        words = []
        for t in b.column(1).to_pylist():
            ids = [cache[x] if x in cache else cache.setdefault(x, bucket(x)) for x in (t or "").split()]
            words.append(np.array(ids, "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(words, pa.binary())], ["doc_id", "lang", "toxic", "words"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket and how many toxic and other documents hold it, by batch."""
    for b in batches:
        y = b.column(0).to_numpy() == 1
        seen = [np.unique(w) for w in _words(b.column(1))]
        bucket, at = np.unique(np.concatenate(seen), return_inverse=True)
        toxic = np.repeat(y, [len(x) for x in seen])
        n = [np.bincount(at[toxic == v], minlength=len(bucket)).astype("i8") for v in (True, False)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n[0]), pa.array(n[1])], ["bucket", "pos", "neg"])


def _pass(shared: Broadcast, epochs: int, heavy: float, seed: int) -> Callable[[pa.Table], pa.Table]:
    """A step over one part: the rows of the model's vectors that it changes, and by how much."""

    def step(part: pa.Table) -> pa.Table:
        part = part.sort_by([(k, "ascending") for k in ("h", "doc_id", "words", "toxic")])
        own = copy.deepcopy(shared.value)
        before = own.vectors()
        own.fit([own.of(w) for w in _words(part["words"])], (part["toxic"].to_numpy() == 1).astype("i8"), epochs, heavy, seed)
        by = own.vectors() - before
        at = np.flatnonzero(by.any(1))
        return pa.table([pa.array(at, pa.int64()), *(pa.array(by[at, k].astype("f8")) for k in range(DIM))], ["at", *NAMES])

    return step


def train(docs: DataFrame, labels: DataFrame, part_rows: int = 4000, min_docs: int = 3, epochs: int = 8) -> Model:
    """Fit on all rows of labels (doc_id, toxic) and docs (doc_id, text, lang) that share an id."""
    context = docs.sparkSession.sparkContext
    picked = table(labels.filter("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "marks")
    joined = docs.select("doc_id", "text", "lang").join(few(picked), "doc_id")
    rows = table(joined.mapInArrow(_hashed, "doc_id long, lang string, toxic int, words binary"), "labelled").withColumn("h", F.xxhash64("doc_id"))
    drop_table(picked)
    held = F.pmod("h", F.lit(5)) == 0
    sizes = {(r.held, r.toxic): r["count"] for r in rows.groupBy(held.alias("held"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).count().collect()}
    n_pos, n_neg = (sizes.get((False, v), 0) for v in (1, 0))
    if not n_pos + sizes.get((True, 1), 0) or not n_neg + sizes.get((True, 0), 0):
        drop_table(rows)
        model = Model(np.zeros(0, "i8"))
        model.constant = 0.0
        return model
    used = rows.filter(~held)
    counts = used.select("toxic", "words").mapInArrow(_frequencies, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(min_docs, int(SHARE * (n_pos + n_neg)))
    known = counts.filter((F.col("bucket") > 0) & (F.col("pos") + F.col("neg") >= least)).orderBy("bucket").toArrow()
    a, b = (known[k].to_numpy() for k in ("pos", "neg"))
    odds = np.log((a + 0.5) / (n_pos + 1)) - np.log((b + 0.5) / (n_neg + 1))
    model = Model(known["bucket"].to_numpy())
    model.E[2:, 0] = np.clip(odds, -1, 8) * (a + b) / (a + b + 4) / 2
    model.W[1][:, 0] = 0
    model.W[1][0, 0] = 1
    model.V[0] = 1
    model.b[1][0] = -1

    parts = -(-(n_pos + n_neg) // part_rows) or 1
    heavy = min(4.0, float(np.sqrt(n_neg / max(1, n_pos))))
    dealt = used.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    for turn in range(1 if parts == 1 else ROUNDS):
        shared = context.broadcast(model)

        moved = dealt.groupBy("part").applyInArrow(_pass(shared, epochs if parts == 1 else PASSES, heavy, 7 + turn), "at long, " + ", ".join(f"{x} double" for x in NAMES))
        moved = moved.groupBy("at").agg(*(F.avg(x).alias(x) for x in NAMES)).toArrow()
        model.move(moved["at"].to_numpy(), np.stack([moved[x].to_numpy() for x in NAMES], 1).astype("f4"))
        shared.destroy()

    shared = context.broadcast(model)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, toxic and how many thresholds the score reaches."""
        own, proj = shared.value, shared.value.projected()
        for b in batches:
            words = _words(b.column(2))
            s = np.concatenate([own.score([own.of(w) for w in words[i : i + 64]], proj) for i in range(0, len(words), 64)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.searchsorted(GRID, s, "right"), pa.int64())], ["lang", "toxic", "level"])

    found = rows.filter(held).select("lang", (F.col("toxic") == 1).alias("toxic"), "words").mapInArrow(levels, "lang string, toxic boolean, level long")
    tally: dict[str | None, np.ndarray] = {}
    for r in found.groupBy("lang", "toxic", "level").count().collect():
        for k in (None, r.lang or None) if r.lang else (None,):
            tally.setdefault(k, np.zeros((2, len(GRID) + 1), "i8"))[int(r.toxic), r.level] += r["count"]
    shared.destroy()
    drop_table(rows)

    def best(n: np.ndarray, otherwise: float) -> float:
        if n[1].sum() < 5:
            return otherwise
        over = n[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # at or over each threshold
        f1 = 2 * over[1] / np.maximum(1, over.sum(0) + n[1].sum())
        top = np.flatnonzero(f1 >= f1.max() - 1e-9)
        return float(GRID[top[np.argmin(np.abs(GRID[top] - 0.5))]])

    model.threshold = best(tally[None], 0.5) if tally else 0.5
    model.thresholds = {x: best(n, model.threshold) for x, n in sorted((x, n) for x, n in tally.items() if x)}
    return model


class Scorer:
    def __init__(self, model: Model, cached: int = 400_000) -> None:
        self.model, self.cached, self.at, self.proj = model, cached, {}, model.projected()

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for i, j in groups(texts):
            split = [t.split() for t in texts[i:j]]
            need = set().union(*split)
            new = [x for x in need if x not in self.at]
            if len(self.at) + len(new) > self.cached:
                self.at.clear()
                new = list(need)
            self.at.update(zip(new, self.model.of(np.array([bucket(x) for x in new], "i8")).tolist(), strict=True))
            out.append(self.model.score([np.fromiter(map(self.at.__getitem__, x), "i8", len(x)) for x in split], self.proj))
        return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and over_threshold (by the threshold of the row's language) of every row (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s = scorer.score([t or "" for t in b.column(1).to_pylist()])
            limit = np.array([scorer.model.thresholds.get(x, scorer.model.threshold) for x in b.column(2).to_pylist()], "f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(s >= limit, pa.bool_())], ["doc_id", "score", "over_threshold"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, score double, over_threshold boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, below the threshold of their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s = scorer.score([t or "" for t in b.column(text).to_pylist()])
            limit = np.array([scorer.model.thresholds.get(x, scorer.model.threshold) for x in b.column(lang).to_pylist()], "f8")
            yield b.filter(pa.array(s < limit, pa.bool_()))
        del scorer
        give_back()

    return docs.mapInArrow(run, docs.schema)
