"""Language identification by words first: the per-language log frequency of known words, and for unseen words that of
their character n-grams, from long ones back to short ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import bound_batches, materialize, release, unused

if TYPE_CHECKING:  # workers need no pandas
    import pandas as pd

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS_KEPT = 100_000


@dataclass
class LanguageModel:
    """words and grams map a string to its row of logs: log probabilities, a column for each language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray
    longest: int


def _tables(rows: pd.DataFrame, languages: list[str]) -> tuple[list[dict[str, int]], np.ndarray]:
    """For words (kind 0) and n-grams (kind n), log((count + 1/2) / total) by language; each kind has its own total."""
    numbers: list[dict[str, int]] = [{}, {}]
    parts, start = [np.zeros((0, len(languages)))], 0
    column = {x: i for i, x in enumerate(languages)}
    for kind, part in rows.groupby("kind"):
        names, row = np.unique(part["item"].to_numpy(dtype=object).astype(str), return_inverse=True)
        counts = np.full((len(names), len(languages)), 0.5)
        counts[row, part["lang"].map(column).to_numpy()] += part["n"].to_numpy()
        parts.append(np.log(counts) - np.log(counts.sum(0)))
        numbers[int(kind > 0)].update(zip(names.tolist(), range(start, start + len(names)), strict=True))
        start += len(names)
    return numbers, np.concatenate(parts)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 4000, max_words: int = 20_000, max_grams: int = 20_000, longest: int = 5) -> LanguageModel:
    """Learn from a bounded, hash-chosen sample: about max_docs rows of each language, of their whole texts.

    A language keeps its max_words commonest words and, of each length up to longest, its max_grams commonest n-grams of
    words between two marks; ties go to the smaller string. Rows with null text or language teach nothing. Texts are read
    once, for the sample's words; its share is found by the languages alone.
    """
    src = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, F.lit(17)).alias("h")).where("lang is not null")
    per_lang = src.groupBy("lang").count().collect()
    if not per_lang:
        return LanguageModel([], {}, {}, np.zeros((0, 0)), longest)
    share = F.create_map(*[F.lit(x) for r in per_lang for x in (r["lang"], min(1.0, max_docs / r["count"]))])
    taken = src.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).where("text is not null")
    words = taken.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    words = materialize(words.select("lang", "item", "n", F.lit(0).alias("kind")), "words")
    marked = F.concat(F.lit("^"), "item", F.lit("$"))
    lengths = F.array(*[F.lit(i) for i in range(1, longest + 1)])
    grams = words.select("lang", "n", marked.alias("w"), F.explode(lengths).alias("kind")).where("length(w) >= kind")
    grams = grams.select("lang", "n", "kind", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("kind") + 1), lambda i: F.substr(F.col("w"), i, F.col("kind")))).alias("item"))
    grams = grams.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).select("lang", "item", "n", "kind")
    return _collected(words.union(grams), max_words, max_grams, longest)


def _collected(counted: DataFrame, max_words: int, max_grams: int, longest: int) -> LanguageModel:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    kept = counted.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams)).drop("place").toArrow().to_pandas()
    languages = sorted(kept["lang"].unique())
    (words, grams), logs = _tables(kept, languages)
    del kept
    release()
    return LanguageModel(languages, words, grams, logs, longest)


class Scorer:
    """Scores texts; remembers the words seen lately."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._logs = np.concatenate([model.logs, np.zeros((1, len(model.languages)))])  # the last row: nothing known
        self._rows: dict[str, int] = {}
        self._matrix = np.zeros((1024, len(model.languages)))

    def _known(self, word: str) -> list[int]:
        """Rows of which the mean is the word's: its own, or those of its longest n-grams of which any is known."""
        m = self.model
        found = m.words.get(word)
        if found is not None:
            return [found]
        marked = f"^{word}$"
        grams = m.grams
        for n in range(min(m.longest, len(marked)), 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := grams.get(marked[i : i + n])) is not None]
            if known:
                return known
        return [len(m.logs)]

    def fill(self, words: list[str], out: np.ndarray) -> None:
        """Write each word's logs, a column for each language, to the rows of out."""
        for lo in range(0, len(words), 4096):
            lists = [self._known(w) for w in words[lo : lo + 4096]]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            sums = np.add.reduceat(self._logs[np.fromiter(chain.from_iterable(lists), np.int64)], np.cumsum(n) - n)
            out[lo : lo + len(lists)] = sums / n[:, None]

    def _learn(self, words: set[str]) -> None:
        """Make rows for new words; when there are too many, those of other texts than these go."""
        if len(self._rows) > _WORDS_KEPT:
            kept = [w for w in words if w in self._rows]
            matrix = self._matrix[[self._rows[w] for w in kept]]
            self._rows, self._matrix = {w: i for i, w in enumerate(kept)}, matrix
        new = [w for w in words if w not in self._rows]
        start = len(self._rows)
        if start + len(new) > len(self._matrix):
            bigger = np.zeros((2 * (start + len(new)), len(self.model.languages)))
            bigger[:start] = self._matrix[:start]
            self._matrix = bigger
        self.fill(new, self._matrix[start : start + len(new)])
        self._rows.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Likeliest language of each text and its posterior probability; ties go to the first language by name."""
        out = []
        for lo in range(0, len(texts), 256):
            counted = [Counter(_LETTERS.findall((t or "").lower())) for t in texts[lo : lo + 256]]
            if self.model.languages:
                self._learn(set().union(*counted))
            for words in counted:
                # the pattern also takes numerals such as one half, which are no letters
                if not self.model.languages or not any(c.isalpha() for w in words for c in w):
                    out.append((UNKNOWN, 0.0))
                    continue
                rows = np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))
                logs = np.fromiter(words.values(), float, len(rows)) @ self._matrix[rows]
                odds = np.exp(logs - logs.max())
                best = int(odds.argmax())
                out.append((self.model.languages[best], float(odds[best] / odds.sum())))
        return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred and score (0 to 1) for every row, from its whole text alone.

    A null text, one without a letter, or a model that has learned nothing gives "und" and 0. Other columns are dropped.
    Columns in keep that are called lang_pred or score raise ValueError.
    """
    if clash := {"lang_pred", "score"} & {c.lower() for c in keep}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    bound_batches(docs.sparkSession)
    # The tables are bounded by the limits of fit(): they go to the workers once as a broadcast.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = unused("text", keep)
    src = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.predict(batch.column(text).to_pylist())
            one, two = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], one, two], names=[*batch.schema.names[:-1], "lang_pred", "score"])
        del scorer
        release()

    return src.mapInArrow(run, schema)
