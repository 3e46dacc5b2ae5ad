"""Languages of a document as a mixture, found by expectation maximisation over its n-grams.

Training counts give each language the likelihood of every hashed letter trigram. A document is a mixture of few languages:
its set of languages starts with the likeliest one and grows by the language that raises the likelihood most, as long as the
rise is above the penalty of half a logarithm of the number of n-grams, times ``STRICT``, per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.sampling import held_out, labelled_sample

BITS = 16

#: Labelled documents of a language that counts are taken from at most.
SAMPLE_PER_LANGUAGE = 2000

#: Prior count of a trigram, rounds of expectation maximisation, strictness of the penalty.
PRIOR, ROUNDS, STRICT = 0.3, 8, 4.0

_letters = np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters of a text, other characters being one space between words."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    keep = letter | np.append(True, letter[:-1])  # the first of a run of other characters
    points = points[keep]
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


class MixtureModel:
    """Trigram likelihoods of the learned languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.stack([counts[k] for k in self.languages], 1) + PRIOR if counts else np.ones((1 << BITS, 0))
        self.likelihood = table / table.sum(0)

    @staticmethod
    def _proportions(p: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            joint = p * share
            share = times @ (joint / joint.sum(1, keepdims=True)) / times.sum()
        return share, float(times @ np.log(p @ share))

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """The leading language and its share, and all languages with their shares; ``und`` for texts without a letter."""
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return "und", 0.0, [], []
        grams, times = np.unique(grams, return_counts=True)
        p, times = self.likelihood[grams], times.astype(float)
        alone = times @ np.log(p)
        chosen, share, best = [int(alone.argmax())], np.ones(1), float(alone.max())
        penalty = STRICT * 0.5 * np.log(times.sum() + 1)
        while len(chosen) < len(self.languages):
            tried = [(*self._proportions(p[:, [*chosen, k]], times), k) for k in range(len(self.languages)) if k not in chosen]
            new_share, value, k = max(tried, key=lambda t: t[1])
            if value - best <= penalty:
                break
            chosen, share, best = [*chosen, k], new_share, value
        order = np.argsort(-share, kind="stable")
        names, shares = [self.languages[chosen[i]] for i in order], [float(share[i]) for i in order]
        if len(chosen) == 1 and len(self.languages) > 1:  # how sure one language is against the next
            shares = [float(1 / (1 + np.exp(-np.clip(alone[chosen[0]] - np.delete(alone, chosen[0]).max(), -50, 50))))]
        return names[0], shares[0], names, shares


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> MixtureModel:
    """Trigram counts of a bounded sample of documents of each language, outside the held-out fold.

    Counts are added up per task and language; the driver gets one array of counts for each. Documents without a language
    or text play no part.
    """
    sample = labelled_sample(docs.where(F.col("text").isNotNull()), "lang", per_language).withColumnRenamed("lang", "_lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for df in frames:
            for lang, text in zip(df["lang"], df["text"]):
                sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                np.add.at(sums[lang], trigrams(text), 1)
        yield pd.DataFrame([(k, np.flatnonzero(v), v[v > 0]) for k, v in sums.items()], columns=["lang", "gram", "n"])

    chosen = docs.select("doc_id", "lang", "text").join(sample, "doc_id").where("lang = _lang").select("lang", "text")
    parts = chosen.mapInPandas(count, "lang string, gram array<long>, n array<long>")
    rows = (parts.select("lang", F.explode(F.arrays_zip("gram", "n")).alias("c")).groupBy("lang", "c.gram").agg(F.sum("c.n").alias("n"))
            .groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("counts")).collect())  # at most 2^BITS numbers a language
    counts = {}
    for row in rows:
        counts[row.lang] = np.zeros(1 << BITS)
        counts[row.lang][[c.gram for c in row.counts]] = [c.n for c in row.counts]
    return MixtureModel(counts)


def identify(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """Per document lang_pred, score, languages and proportions."""
    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [model.predict(t) for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                                "languages": [f[2] for f in found], "proportions": [f[3] for f in found]})

    return docs.select("doc_id", "text").mapInPandas(predict, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")


def language_digest(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")
