"""Toxicity scores of a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first four and five letters, hashed to ``BINS`` numbers; a text is the set
of its terms. The score is the logistic function of bias + sum of weights + sum over pairs of terms of the products of
their factor vectors, so that an insult together with a mention of a group can weigh more than both alone.

Of the sample's terms the machine gets those that tell by themselves and those that tell together with another one: every
pair of terms is tried against what the terms that tell by themselves leave unexplained.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.keep import kept
from quadrat.llm.sampling import held_out, labelled, labelled_sample

BINS = 1 << 20

#: Labelled documents of each label that the model is fitted on at most. Terms that tell by themselves stand in ``LEAST_DOCS``
#: of them or more, and their chi-square statistic against the label is ``LEAST_CHI`` or more.
SAMPLE_PER_LABEL, LEAST_DOCS, LEAST_CHI = 4000, 3, 15.0

#: Probability that chance alone lets any pair of terms tell, and how near to 0 and 1 explained labels count.
CHANCE, NEAR = 0.05, 0.01

#: Factors of a term, rounds over the sample, rounds if pairs tell, step and pull towards zero.
FACTORS, EPOCHS, PAIR_EPOCHS, STEP, DECAY = 4, 10, 100, 0.1, 1e-4

#: Words that one Python worker remembers at most.
REMEMBER = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def _bins(word: str) -> tuple[int, ...]:
    return tuple({zlib.crc32(t.encode("utf-8", "surrogatepass")) % BINS for t in (word, "^4" + word[:4], "^5" + word[:5])})


def terms(text: str | None) -> np.ndarray:
    """Sorted bins of the terms of a text; none for NULL and for texts without letters."""
    known = kept("toxicity terms", dict)
    if len(known) > REMEMBER:
        known.clear()
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        bins = known.get(word)
        if bins is None:
            bins = _bins(word)
            if len(word) <= 100:  # long ones are not kept
                known[word] = bins
        found.update(bins)
    return np.array(sorted(found), np.int64)


def logistic(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


class FactorizationMachine:
    def __init__(self, n: int, factors: int = FACTORS, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n, factors))

    def margins(self, ids: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins of ``n`` texts given the terms ``ids`` of texts ``row``, and the sums of their factors."""
        v = self.v[ids]
        sums = np.stack([np.bincount(row, v[:, k], n) for k in range(v.shape[1])], 1)
        own = np.bincount(row, (v * v).sum(1), n)
        return self.bias + np.bincount(row, self.w[ids], n) + 0.5 * ((sums * sums).sum(1) - own), sums

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, step: float = STEP, decay: float = DECAY, batch: int = 64, seed: int = 7):
        """Logistic loss by adaptive gradient steps over small batches."""
        rng = np.random.default_rng(seed)
        g_w, g_v, g_b = np.full(len(self.w), 1e-4), np.full(self.v.shape, 1e-4), 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                ids = np.concatenate([texts[i] for i in some])
                row = np.repeat(np.arange(len(some)), [len(texts[i]) for i in some])
                margin, sums = self.margins(ids, row, len(some))
                error = (logistic(margin) - labels[some]) / len(some)
                used, place = np.unique(ids, return_inverse=True)
                d_w = np.bincount(place, error[row], len(used)) + decay * self.w[used]
                pull = error[row, None] * (sums[row] - self.v[ids])
                d_v = np.stack([np.bincount(place, pull[:, k], len(used)) for k in range(pull.shape[1])], 1) + decay * self.v[used]
                d_b = error.sum()
                g_w[used] += d_w * d_w
                g_v[used] += d_v * d_v
                g_b += d_b * d_b
                self.w[used] -= step * d_w / np.sqrt(g_w[used])
                self.v[used] -= step / 10 * d_v / np.sqrt(g_v[used])
                self.bias -= step * d_b / np.sqrt(g_b)
        return self


class ToxicityModel:
    """A fitted machine and the bins it knows."""

    def __init__(self, bins: np.ndarray, machine: FactorizationMachine):
        self.bins, self.machine = bins, machine

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return logistic(self.margins([terms(text) for text in texts]))

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = []
        for t in texts:
            place = np.searchsorted(self.bins, t)
            inside = place < len(self.bins)
            rows.append(place[inside][self.bins[place[inside]] == t[inside]])
        ids = np.concatenate([*rows, np.empty(0, np.int64)])
        margin, _ = self.machine.margins(ids, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))
        return margin


def telling_bins(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Bins that stand in enough texts and do so unevenly between the labels."""
    bins, place, times = np.unique(np.concatenate([*texts, np.empty(0, np.int32)]), return_inverse=True, return_counts=True)
    toxic = np.bincount(place, np.repeat(labels.astype(np.float32), [len(t) for t in texts]), len(bins))
    share, n = times / max(1, len(texts)), labels.sum()
    spread = share * (1 - share) * n * (1 - n / max(1, len(texts)))
    return bins[(times >= LEAST_DOCS) & ((toxic - share * n) ** 2 >= LEAST_CHI * np.maximum(spread, 1e-9))]


def _inside(texts: list[np.ndarray], bins: np.ndarray) -> list[np.ndarray]:
    """Places in ``bins`` of the terms of each text that stand there."""
    return [np.searchsorted(bins, t[np.isin(t, bins, assume_unique=True)]) for t in texts]


def balanced(margins: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Probabilities whose sum is that of the labels, by one shift of all margins."""
    low, high = -60.0, 60.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if logistic(margins + middle).sum() < labels.sum() else (low, middle)
    return logistic(margins + low)


def pair_partners(first: int, last: int, texts: list[np.ndarray], labels: np.ndarray, expected: np.ndarray, n: int) -> np.ndarray:
    """Those of the ``n`` terms that tell in a pair with one of the terms ``first`` to ``last``.

    A pair tells if the labels of the texts with both terms differ so far from the expected ones that, by Chernoff's bound,
    chance makes any of all pairs do so with probability ``CHANCE`` at most.
    """
    limit = np.log(max(1, n) ** 2 / CHANCE)
    slope = -np.log(NEAR) / (1 - NEAR)  # the bound grows by no more than this per unit of difference
    where: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        for a in t[np.searchsorted(t, first):np.searchsorted(t, last)].tolist():
            where.setdefault(a, []).append(i)
    off, found = labels - expected, [np.empty(0, np.int64)]
    for a, rows in where.items():
        gap = off[rows]
        if slope * max(gap[gap > 0].sum(), -gap[gap < 0].sum()) < limit:
            continue
        ids, sizes = np.concatenate([texts[i] for i in rows]), [len(texts[i]) for i in rows]
        near = np.flatnonzero(np.abs(np.bincount(ids, np.repeat(gap, sizes), n)) * slope >= limit)
        near = near[near != a]
        if not len(near):
            continue
        times, toxic, hoped = (np.bincount(ids, np.repeat(x, sizes), n)[near] for x in (np.ones(len(rows)), labels[rows], expected[rows]))
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.nan_to_num(toxic * np.log(toxic / hoped)) + np.nan_to_num((times - toxic) * np.log((times - toxic) / (times - hoped)))
        if len(near := near[bound >= limit]):
            found += [near, np.array([a])]
    return np.unique(np.concatenate(found))


def paired_bins(spark: SparkSession, texts: list[np.ndarray], labels: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Bins in enough texts that tell in pairs, beyond what ``expected`` explains. The pairs are tried by Spark tasks."""
    bins, times = np.unique(np.concatenate([*texts, np.empty(0, np.int32)]), return_counts=True)
    bins = bins[times >= LEAST_DOCS]
    if not len(bins):
        return bins
    sent = spark.sparkContext.broadcast(([t.astype(np.int32) for t in _inside(texts, bins)], labels, np.clip(expected, NEAR, 1 - NEAR)))
    n, tasks = len(bins), min(64, len(bins))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for k in df["id"]:
                yield pd.DataFrame({"place": pair_partners(k * n // tasks, (k + 1) * n // tasks, *sent.value, n)})

    found = spark.range(0, tasks, 1, tasks).mapInPandas(search, "place long").distinct().collect()  # at most the sample's terms
    return bins[sorted(r.place for r in found)]


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    The sample's terms come to the driver: at most 2 * ``per_label`` small arrays. Labels without a document and documents
    without a label play no part; without any labels every score is 0.5 or, with one label only, near it. Where the bound
    changes the share of toxic documents, the bias is shifted so that scores refer to the share among all labelled ones.
    """
    marked = labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    sample = labelled_sample(marked, "toxic", per_label)  # two labels: at most 2 * per_label rows of two numbers
    totals = {r["toxic"]: r["count"] for r in labelled(marked, "toxic").groupBy("toxic").count().collect()}

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"doc_id": df["doc_id"], "toxic": df["toxic"], "terms": [terms(t).astype(np.int32).tobytes() for t in df["text"]]})

    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .mapInPandas(collect, "doc_id long, toxic int, terms binary").collect())
    rows.sort(key=lambda r: (r.doc_id, r.toxic, bytes(r.terms)))
    texts = [np.frombuffer(r.terms, np.int32) for r in rows]
    marks = np.array([float(r.toxic) for r in rows])
    bins = telling_bins(texts, marks)
    machine = FactorizationMachine(len(bins))
    if len(rows):
        machine.fit(_inside(texts, bins), marks)
        alone = balanced(ToxicityModel(bins, machine).margins(texts), marks)
        paired = np.setdiff1d(paired_bins(docs.sparkSession, texts, marks, alone), bins) if 0 < marks.mean() < 1 else bins[:0]
        if len(paired):
            bins = np.union1d(bins, paired)
            machine = FactorizationMachine(len(bins)).fit(_inside(texts, bins), marks, PAIR_EPOCHS)
        left_out = {k: max(1.0, n / max(1, per_label)) for k, n in totals.items()}  # labelled documents for each one sampled
        machine.bias += np.log(left_out.get(1, 1.0) / left_out.get(0, 1.0)) if len(left_out) == 2 else 0.0
    return ToxicityModel(bins, machine)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on). NULL and empty texts get the model's bias."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        return pd.Series(np.concatenate([model.scores(values[at:at + 500]) for at in range(0, len(values), 500)] or [np.empty(0)]))

    scored = docs.withColumn("score", score("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    return score_toxicity(docs.select(F.struct(*docs.columns).alias("_row"), "text"), train(docs, labels)).where("predicted = 0").select("_row.*")
