"""Toxicity scores by weak supervision.

Lexicon families and surface patterns vote on sample documents. The sample is cut into folds; the lexicons that vote on one fold
are gathered from the labels of the others, so a voter never sees the label of the document it votes on. From the votes alone a
generative label model estimates, by expectation maximisation, how each voter votes on toxic and on clean documents, and the
correlations of the voters, by which those that repeat each other are discounted; it gives each document a posterior label.
Labels enter the model only as the share of toxic documents. A linear classifier over words and word stems is trained on the
posteriors and scores every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, cut

#: Labelled documents that the model is fitted on at most, the ones with the smallest hash of their id.
FIT_ROWS = 12_000
#: Terms of the classifier, and the least number of sample documents that must hold one.
TERMS, MIN_DOCS = 800, 4
#: Standard deviations by which a term's toxic share must leave the sample's.
MIN_GAP = 4.0
#: Parts of the sample that are voted on with lexicons of the others.
FOLDS = 5
#: Lexicon voters of their own at most; further families share ten more.
FAMILIES = 60
#: Least lower bound of a lexicon term's log odds, and how far it may stay behind the best of its family.
LEAST_ODDS, NEAR_ODDS = 1.5, 1.0
#: Correlations up to this are taken for chance.
NOISE = 0.1
STEMS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")
#: Patterns that vote by the surface of a text. A term of this kind begins with "§".
PATTERNS = {
    "§bangs": re.compile(r"!{2,}"),
    "§shout": re.compile(r"\b[^\W\d_a-z]{4,}\b(?:\W+\b[^\W\d_a-z]{4,}\b){2}"),
    "§masked": re.compile(r"\b\w+[*@#$]{2,}\w*\b"),
    "§you": re.compile(r"\b(?:you(?:'re| are)|du bist|tu es|eres)\b", re.I),
    "§stretch": re.compile(r"([^\W\d_])\1{3,}"),
}


#: What parts words in a text of ASCII alone.
_GAPS = {i: " " for i in range(128) if not chr(i).isalpha()}
_YOU = ("you're", "you are", "du bist", "tu es", "eres")
_MASK = re.compile(r"(?<=\w)[*@#$]{2,}\w")


def words_of(low: str) -> set[str]:
    """Distinct words of a text in lower case."""
    return set(low.translate(_GAPS).split() if low.isascii() else _WORD.findall(low))


def marks(text: str, low: str) -> set[str]:
    """The patterns that occur. A pattern is searched only in texts that have what it can't do without: a run of four capitals or of one letter, or one of the phrases."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far, same = c > 127, c[1:] == c[:-1]
    caps, same = far | (c - np.uint32(65) < 26), same & (far | ((c | np.uint32(32)) - np.uint32(97) < 26))[1:]
    may = {"§bangs": "!!" in text, "§masked": _MASK.search(text) is not None}
    may["§shout"] = bool((caps[:-3] & caps[1:-2] & caps[2:-1] & caps[3:]).any()) and PATTERNS["§shout"].search(text) is not None
    may["§you"] = (any(p in low for p in _YOU) or any(x in text for x in "ſıİ")) and PATTERNS["§you"].search(text) is not None
    may["§stretch"] = bool((same[:-2] & same[1:-1] & same[2:]).any()) and PATTERNS["§stretch"].search(text) is not None
    return {name for name, hit in may.items() if hit}


def terms(text: str | None) -> set[str]:
    """Distinct words in lower case, stems ("abcd*") of longer words, and the patterns that occur."""
    text = text or ""
    low = text.lower()
    words = words_of(low)
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n} | marks(text, low)


def signature(text: str | None) -> list[int]:
    """Three min-hashes over shingles of five words; near copies share one nearly always, other texts never."""
    words = (text or "").lower().split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
    mixed = [h, h * np.uint64(0x9E3779B97F4A7C15), h * np.uint64(0xC2B2AE3D27D4EB4F)]
    return [int(((x ^ (x >> np.uint64(32))) >> np.uint64(1)).min()) for x in mixed]


@dataclass
class Model:
    """A linear classifier over terms; ``score`` is the posterior of the toxic class."""

    bias: float = -2.0
    weights: dict[str, float] = field(default_factory=dict)
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words = {t for t in self.weights if t[-1:] != "*" and t[:1] != "§"}
        self.stems = {n: {t[:-1] for t in self.weights if t[-1:] == "*" and len(t) == n + 1} for n in STEMS}
        self.patterns = [(self.weights[t], t) for t in PATTERNS if self.weights.get(t)]

    def score(self, text: str | None) -> float:
        text = text or ""
        low = text.lower()
        words = words_of(low)
        z = self.bias + sum(self.weights[w] for w in words & self.words)
        for n, known in self.stems.items():
            if known:
                z += sum(self.weights[f"{s}*"] for s in {w[:n] for w in words if len(w) > n} & known)
        found = marks(text, low) if self.patterns else ()
        z += sum(w for w, t in self.patterns if t in found)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_odds(p: np.ndarray, n: np.ndarray, pos: float, total: float, sure: float = 2.0) -> np.ndarray:
    """Lower bounds of log odds of terms in toxic against clean documents; chance finds of rare terms stay below zero or nearly so."""
    odds = np.log((p + 0.5) / (pos + 1)) - np.log((n - p + 0.5) / (total - pos + 1))
    return odds - sure * np.sqrt(1 / (p + 0.5) + 1 / (n - p + 0.5))


def votes(x: np.ndarray, names: list[str], odds: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Documents x voters in {-1 clean, 0 abstain, 1 toxic}: lexicon families, no hit in any of them, and surface patterns.

    odds: folds x terms, each row's taken from all other folds. A family is the words and stems of one beginning; in a fold it
    holds those whose odds are high and near its best. So no voter that looks at a document knows that document's label.
    """
    best = odds.max(0)
    families: dict[str, list[int]] = {}
    for j in np.argsort(-best, kind="stable"):
        if best[j] >= LEAST_ODDS and names[j][0] != "§":
            families.setdefault(names[j][:4].rstrip("*"), []).append(j)
    cols: dict[str, np.ndarray] = {}
    hits = np.zeros(len(x), int)
    for i, (stem, own_) in enumerate(families.items()):
        own, vote = np.array(own_), np.zeros(len(x), np.int8)
        for f in range(len(odds)):
            o = odds[f, own]
            held = own[(o >= LEAST_ODDS) & (o >= o.max() - NEAR_ODDS)]
            vote[fold == f] = x[np.ix_(fold == f, held)].any(1)
        name = f"lexicon {stem}" if i < FAMILIES else f"lexicon rest {xxhash.xxh64_intdigest(stem) % 10}"
        cols[name] = np.maximum(cols.get(name, 0), vote)
        hits += vote
    cols["no hit"] = np.where(hits == 0, -1, 0).astype(np.int8)
    for j, name in enumerate(names):
        if name[0] == "§":
            cols[f"pattern {name[1:]}"] = (x[:, j] * np.sign(odds[fold, j])).astype(np.int8)
    return np.stack([*cols.values()], 1), [*cols]


def label_model(v: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, P(vote | class) as voters x 2 x 3, correlations) by expectation maximisation over the votes alone.

    Accuracies are estimated anew each round, the correlations of the voters' residuals every fifth round once accuracies have
    settled. A voter's log likelihood ratio is divided by one plus its correlations with the others, so voters that see the
    same thing count once together.
    """
    n, m = v.shape
    onehot = np.stack([v == k for k in (-1, 0, 1)], 2).astype(np.float32)
    q = 1 / (1 + np.exp(-(v.sum(1) - 0.5)))
    corr, table = np.zeros((m, m)), None
    for r in range(rounds):
        w = np.stack([1 - q, q], 1)
        table = (np.einsum("nc,nmk->mck", w, onehot) + 0.5) / (w.sum(0)[None, :, None] + 1.5)
        if r >= 10 and r % 5 == 0:
            res = v - np.einsum("nc,mc->nm", w, table[:, :, 2] - table[:, :, 0])
            sd = res.std(0)
            corr = (res.T @ res / n) / np.maximum(np.outer(sd, sd), 1e-9)
            np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.maximum(corr - NOISE, 0).sum(1))
        ratio = np.log(table[:, 1] / table[:, 0]) * share[:, None]
        z = np.log(prior / (1 - prior)) + np.einsum("nmk,mk->n", onehot, ratio)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, table, corr


def linear(x: np.ndarray, q: np.ndarray, rounds: int = 200, decay: float = 2e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam."""
    x = x.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log(max(q.mean(), 1e-3) / max(1 - q.mean(), 1e-3)))
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for i in range(1, rounds + 1):
        e = 1 / (1 + np.exp(-(x @ w + b))) - q
        g = np.concatenate([x.T @ e / len(x) + decay * w, [e.mean()]])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - np.float32(step[-1])
    return w, float(b)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", fit_rows: int = FIT_ROWS, scratch: Scratch | None = None) -> Model:
    """Fits on at most ``fit_rows`` labelled documents that aren't held out. Without any, all texts score alike.

    Null labels are left out; of repeated labels the largest counts, of repeated ids the smallest text. Term counts are
    aggregated on the executors; what reaches the driver is bounded by ``fit_rows`` and TERMS.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    sample = scratch.table(known.orderBy(F.xxhash64(key), key).limit(fit_rows))

    def split(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            own = pa.array([sorted(terms(t)) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own, pa.array(map(signature, texts), pa.list_(pa.int64()))], names=["id", "y", "terms", "sig"])

    rows = docs.select(key, F.col(text).cast("string").alias("t")).join(F.broadcast(sample), key)
    rows = rows.groupBy(F.col(key).cast("string").alias("id"), "y").agg(F.min("t").alias("t"))
    rows = scratch.table(rows.mapInArrow(split, "id string, y int, terms array<string>, sig array<bigint>"))
    # copies would make any of their words look like evidence, so the sample keeps the first of each group of near copies
    seen: set[int] = set()
    keep = []
    for r in sorted(rows.select("id", "sig").toLocalIterator(), key=lambda r: (len(r.id), r.id)):
        if seen.isdisjoint(r.sig):
            keep.append((r.id,))
        seen.update(r.sig)
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(keep, "id string")), "id").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int"))
    by_fold = [F.coalesce(f(F.when(F.col("fold") == k, F.col("y"))), F.lit(0)) for f in (F.count, F.sum) for k in range(FOLDS)]
    total, positive = np.array(rows.agg(*by_fold).first(), float).reshape(2, FOLDS)
    n, pos = int(total.sum()), int(positive.sum())
    if not 0 < pos < n:
        return Model(bias=3.0 if n and pos == n else -3.0)
    counts = rows.select("y", "fold", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("p"), F.count("*").alias("n"), F.array(*by_fold).alias("by_fold")).where(f"n >= {MIN_DOCS}")
    gap = F.abs(F.col("p") - F.col("n") * (pos / n)) / F.sqrt(F.col("n") * (pos / n) * (1 - pos / n))
    best = counts.where(gap >= MIN_GAP).orderBy(gap.desc(), "term").limit(TERMS).collect()
    if not best:
        return Model(bias=float(np.log(pos / (n - pos))))
    names = [r.term for r in best]
    seen_n, seen_p = np.moveaxis(np.array([r.by_fold for r in best], float).reshape(-1, 2, FOLDS), 0, 2)
    odds = np.stack([log_odds(seen_p.sum(0) - seen_p[k], seen_n.sum(0) - seen_n[k], pos - positive[k], n - total[k]) for k in range(FOLDS)])
    index = {t: j for j, t in enumerate(names)}

    def vectors(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[index[t] for t in own if t in index] for own in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["fold", "at"])

    found = rows.select("fold", "terms").mapInArrow(vectors, "fold int, at array<int>").toArrow()
    x = np.zeros((n, len(names)), bool)
    at = found.column("at").combine_chunks()
    x[np.repeat(np.arange(n), np.asarray(at.value_lengths())), at.flatten().to_numpy()] = True
    fold = found.column("fold").to_numpy()
    order = np.lexsort([*x.T[:32], x.sum(1), fold])  # rows come in any order; sums below shouldn't depend on it
    x, fold = x[order], fold[order]
    v, voters = votes(x, names, odds, fold)
    q, table, _ = label_model(v, pos / n)
    w, b = linear(x, q)
    return Model(b, {t: float(z) for t, z in zip(names, w) if abs(z) > 1e-3}, {name: (float(t[1, 2]), float(t[0, 2])) for name, t in zip(voters, table)})


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in ``out`` (a column of that name is replaced); a null text scores as an empty one."""
    names = [c for c in docs.columns if c != out]

    def run(batches):
        for b in batches:
            for part in cut(b, text):
                scores = pa.array([model.score(t) for t in part.column(text).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), scores], names=[*names, out])

    schema = StructType([docs.schema[c] for c in names] + [StructField(out, DoubleType())])
    return docs.select(*names).mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
