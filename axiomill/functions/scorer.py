"""Proposals for a prompt: the interface of a scorer, and an n-gram baseline that needs nothing but counts."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Scorer(Protocol):
    def beam_decode(self, prompt: str, k: int) -> list[tuple[str, float]]: ...


def length_penalty(words: int, power: float = 0.6) -> float:
    return ((5 + words) / 6) ** power


class NgramScorer:
    """Log-probabilities of the next word after up to n - 1 words, with back-off to shorter contexts."""

    def __init__(self, counts: dict[tuple[str, ...], dict[str, int]], n: int, most_words: int = 40, totals: dict[tuple[str, ...], int] | None = None):
        self.counts, self.n, self.most_words = counts, n, most_words
        self.totals = totals or {c: sum(words.values()) for c, words in counts.items()}

    @classmethod
    def fit(cls, df: DataFrame, text: str, n: int = 3, proposals: int | None = None) -> NgramScorer:
        """Counts over all rows. With `proposals` the driver keeps that many words of each context, the most frequent ones; a word's probability is its
        share of all that follow the context either way."""
        w = F.filter(F.split(text, " "), lambda x: x != "")
        def of_size(k: int):
            at = lambda i: F.struct(F.array_join(F.slice(F.col("w"), F.greatest(i - k, F.lit(0)) + 1, F.least(i, F.lit(k))), " ").alias("context"), F.get(F.col("w"), i).alias("word"))
            return F.transform(F.sequence(F.lit(0), F.size("w") - 1), at)

        grams = df.select(w.alias("w")).where(F.size("w") > 0).select(F.explode(F.flatten(F.array(*(of_size(k) for k in range(n))))).alias("g"))
        told = grams.groupBy("g.context", "g.word").agg(F.count(F.lit(1)).alias("c"))
        whole = Window.partitionBy("context")
        told = told.withColumn("total", F.sum("c").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("c"), "word")))
        counts: dict[tuple[str, ...], dict[str, int]] = {}
        totals: dict[tuple[str, ...], int] = {}
        for r in (told.where(F.col("place") <= proposals) if proposals else told).collect():
            context = tuple(r.context.split())
            counts.setdefault(context, {})[r.word] = r.c
            totals[context] = r.total
        return cls(counts, n, totals=totals)

    def next_words(self, words: list[str], k: int) -> list[tuple[str, float]]:
        for size in range(min(self.n - 1, len(words)), -1, -1):
            context = tuple(words[len(words) - size :])
            seen = self.counts.get(context)
            if seen:
                return [(w, math.log(c / self.totals[context])) for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:k]]
        return []

    def beam_decode(self, prompt: str, k: int) -> list[tuple[str, float]]:
        """The k best completions up to the first `;`, scores divided by the length penalty."""
        live, done = [(0.0, [])], []
        for _ in range(self.most_words):
            made = []
            for score, words in live:
                for w, s in self.next_words(prompt.split() + words, k):
                    made.append((score + s, [*words, w]))
            made.sort(key=lambda x: (-x[0], x[1]))
            live = []
            for score, words in made[:k]:
                (done if words[-1] == ";" else live).append((score, words))
            if not live or len(done) >= k:
                break
        ranked = sorted(((s / length_penalty(len(w)), " ".join(w)) for s, w in done), key=lambda x: (-x[0], x[1]))
        return [(t, s) for s, t in ranked[:k]]
