"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of its hashed buckets: one for the word and one for each of its marked n-grams,
so that forms never seen in training share what is known of their stems. Trained in numpy with Adam. A filter of width
w over embeddings is a sum of w vectors, one for each place, that depend on the word there alone; scoring computes them
once for each word and is then look-ups, additions and a maximum.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from ._runtime import bound_batches, materialize, release, unused

_WORD = re.compile(r"\w+")
#: Words whose vectors a worker keeps, some 400 bytes each.
_WORDS_KEPT = 120_000
#: Words of one pass; longer texts take several that overlap, whose maxima are those of the whole text.
_PASS = 16_384
#: Length of the n-grams, in bytes of UTF-8.
_GRAM = 5
#: Characters of a word, and those that neighbouring pieces of a longer one share.
_PIECE, _SHARED = 32, 8


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower-cased. A longer run, as scripts without blanks have, is words of _PIECE characters that
    overlap, so that all of it is pooled, place by place."""
    words = _WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= _PIECE:
        return words
    step = _PIECE - _SHARED
    return [p for w in words for p in ([w] if len(w) <= _PIECE else [w[i : i + _PIECE] for i in range(0, len(w) - _SHARED, step)])]


def word_buckets(word: str, buckets: int) -> list[int]:
    """The word's buckets; 0 is kept for no word."""
    b = word.encode("utf-8", "surrogatepass")
    marked = b"<" + b + b">"
    crc, n = zlib.crc32, buckets - 1
    return [1 + crc(b"=" + b) % n, *[1 + crc(marked[i : i + _GRAM]) % n for i in range(len(marked) - _GRAM + 1)]]


def _summed(table: np.ndarray, words: list[str], buckets: int, out: np.ndarray) -> None:
    """Sum of the table's rows over each word's buckets."""
    for lo in range(0, len(words), 1024):
        lists = [word_buckets(w, buckets) for w in words[lo : lo + 1024]]
        starts = np.cumsum([0, *map(len, lists[:-1])])
        out[lo : lo + len(lists)] = np.add.reduceat(table[np.fromiter(chain.from_iterable(lists), np.int64)], starts)


@dataclass
class ToxicityModel:
    """table: for each bucket what it adds to all filters, for width 1, then width 2's first and second place, and so
    on; calibration: language -> the raw score where texts count as toxic ("": any other language)."""

    buckets: int
    widths: tuple[int, ...]
    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    calibration: dict[str, float]
    language: langid.LanguageModel


class Scorer:
    """Raw scores and languages of whole texts; remembers the vectors of words seen lately.

    A word's vector is what it adds to the filters, then its logs by language, so that one look-up serves both."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._tongue = langid.Scorer(model.language)
        self._languages = model.language.languages
        self._width = model.table.shape[1]
        self._rows: dict[str, int] = {}
        self._vectors = np.zeros((1, self._width + len(self._languages)), np.float32)  # row 0: no word

    def _learn(self, words: set[str]) -> None:
        """Make vectors for new words; when there are too many, those of other texts than these go."""
        if len(self._rows) > _WORDS_KEPT:
            kept = [w for w in words if w in self._rows]
            self._vectors[1 : len(kept) + 1] = self._vectors[[self._rows[w] for w in kept]]
            self._rows = {w: i for i, w in enumerate(kept, start=1)}
        new = [w for w in words if w not in self._rows]
        start, end = len(self._rows) + 1, len(self._rows) + 1 + len(new)
        if end > len(self._vectors):
            bigger = np.zeros((min(2 * end, max(end, _WORDS_KEPT + 20_000)), self._vectors.shape[1]), np.float32)
            bigger[:start] = self._vectors[:start]
            self._vectors = bigger
        _summed(self.model.table, new, self.model.buckets, self._vectors[start:end, : self._width])
        if self._languages:
            self._tongue.fill(new, self._vectors[start:end, self._width :])
            odd = [i for i, w in enumerate(new, start=start) if not w.isalpha()]
            self._vectors[odd, self._width :] = 0  # only words of letters tell a language
        self._rows.update(zip(new, range(start, end), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """(raw score, language) of each text; the language is "" where the text tells none."""
        out = []
        for lo in range(0, len(texts), 256):
            part = [words_of(t) for t in texts[lo : lo + 256]]
            self._learn(set().union(*part))
            out += [self._scored(np.fromiter(map(self._rows.__getitem__, ws), np.int32, len(ws))) for ws in part]
        return out

    def _scored(self, words: np.ndarray) -> tuple[float, str]:
        m = self.model
        filters = len(m.bias) // len(m.widths)
        most = np.full(len(m.bias), -np.inf, np.float32)
        spoken = np.zeros(len(self._languages))
        pad = max(m.widths) - 1
        words = np.concatenate([words, np.zeros(max(1, pad), np.int32)])
        for lo in range(0, len(words) - pad, _PASS):
            x = self._vectors[words[lo : lo + _PASS + pad]]
            spoken += x[:_PASS, self._width :].sum(0)
            place = 0
            for i, w in enumerate(m.widths):
                n = len(x) - w + 1
                act = x[:n, place : place + filters]
                for k in range(1, w):
                    act = act + x[k : k + n, place + k * filters : place + (k + 1) * filters]
                own = most[i * filters : (i + 1) * filters]
                np.maximum(own, act.max(0), out=own)
                place += w * filters
        language = self._languages[int(spoken.argmax())] if spoken.any() else ""
        return float(np.maximum(most + m.bias, 0) @ m.out + m.out_bias), language


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
    """Each text as numbers of its words, and the words by number; 0 is no word."""
    number: dict[str, int] = {"": 0}
    rows = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
    return rows, list(number)


def _train(texts: list[np.ndarray], names: list[str], labels: np.ndarray, buckets: int, dim: int, filters: int, widths: tuple[int, ...], epochs: int, seed: int) -> tuple:
    """Adam over mini-batches of 16 texts; only the places that win the pooling get a gradient."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (buckets, dim)).astype(np.float32)
    emb[0] = 0
    kernel = [rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)).astype(np.float32) for w in widths]
    bias = [np.zeros(filters, np.float32) for _ in widths]
    out, out_bias = rng.normal(0, 0.1, filters * len(widths)).astype(np.float32), np.zeros(1, np.float32)
    params = [out, out_bias, *kernel, *bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    first_emb, second_emb = np.zeros_like(emb), np.zeros_like(emb)
    pad = max(1, max(widths) - 1)
    # the buckets of word i are flat[ends[i]:ends[i + 1]]
    lists = [[0], *(word_buckets(w, buckets) for w in names[1:])]
    ends = np.cumsum([0, *(len(x) for x in lists)], dtype=np.int64)
    flat = np.fromiter((b for x in lists for b in x), np.int32, ends[-1])
    del lists

    def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All buckets of the words, and how many each has."""
        n = ends[words + 1] - ends[words]
        return flat[np.repeat(ends[words] - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    share = float(labels.mean())
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 16):
            grads = [np.zeros_like(p) for p in params]
            rows, row_grads = [], []
            batch = order[lo : lo + 16]
            for j in batch:
                t = np.concatenate([texts[j], np.zeros(pad, np.int32)])
                own, place = np.unique(t, return_inverse=True)
                ids, n = spread(own)
                x = np.add.reduceat(emb[ids], np.cumsum(n) - n)[place]
                raw, at = np.empty(filters * len(widths), np.float32), []
                for i, w in enumerate(widths):
                    n = len(t) - w + 1
                    act = x[:n] @ kernel[i][0]
                    for k in range(1, w):
                        act += x[k : k + n] @ kernel[i][k]
                    at.append(act.argmax(0))
                    raw[i * filters : (i + 1) * filters] = act[at[i], np.arange(filters)] + bias[i]
                mask = (rng.random(len(raw)) < 0.8).astype(np.float32) / 0.8
                hidden = np.maximum(raw, 0) * mask
                p = 1 / (1 + np.exp(-float(hidden @ out + out_bias[0])))
                d = np.float32((p - labels[j]) * weight[j] / len(batch))
                grads[0] += d * hidden
                grads[1] += d
                back = d * out * mask * (raw > 0)
                for i, w in enumerate(widths):
                    g = back[i * filters : (i + 1) * filters]
                    grads[2 + len(widths) + i] += g
                    live = np.flatnonzero(g)
                    for k in range(w):
                        place = at[i][live] + k
                        grads[2 + i][k][:, live] += x[place].T * g[live]
                        ids, n = spread(t[place])
                        rows.append(ids)
                        row_grads.append(np.repeat(kernel[i][k][:, live].T * g[live, None], n, axis=0))
            step += 1
            rate = 0.004 * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                params[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-7)
            ids = np.concatenate(rows)
            touched, place = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(place, c, len(touched)) for c in np.concatenate(row_grads).T], 1).astype(np.float32)
            g[touched == 0] = 0
            first_emb[touched] += 0.1 * (g - first_emb[touched])
            second_emb[touched] += 0.001 * (g * g - second_emb[touched])
            emb[touched] -= rate * first_emb[touched] / (np.sqrt(second_emb[touched]) + 1e-7)
    table = np.concatenate([emb @ k for ks in kernel for k in ks], 1)
    return table, np.concatenate(bias), out, float(out_bias[0])


def _calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the most right answers, in the middle of the widest such gap; 0 if only one label is there."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    right = np.r_[y.sum(), y.sum() + np.cumsum(np.where(y == 0, 1, -1))]  # cutting before each rank
    cuts = np.r_[x[0] - 1, (x[1:] + x[:-1]) / 2, x[-1] + 1]
    gaps = np.r_[1, x[1:] - x[:-1], 1]
    best = np.flatnonzero(right == right.max())
    return float(cuts[best[gaps[best].argmax()]])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_docs: int = 6000, min_lang_docs: int = 200, buckets: int = 1 << 16, dim: int = 16, filters: int = 16, widths: tuple[int, ...] = (1, 2, 3), epochs: int = 6, seed: int = 5) -> ToxicityModel:
    """Train on a bounded, hash-chosen sample of max_docs labelled rows (at most half of them of either label where the
    other has enough), with their whole texts; a fifth of it is held out for the thresholds.

    Thresholds are set for each language that langid finds in the texts with min_lang_docs or more rows held out or
    trained on, and one for all others. The language model learns from the sample's own documents.
    Rows with a null text, null id or a label other than 0 and 1 teach nothing; labels of a repeated id count once, the
    largest. With a single label, or none, the model scores every text alike.
    """
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("y"))
    sizes = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    half = max_docs // 2
    quota = {y: max(half, max_docs - sizes.get(1 - y, 0)) for y in (0, 1)}
    place = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_000))
    share = F.when(F.col("y") == 1, min(1.0, quota[1] / max(1, sizes.get(1, 0)))).otherwise(min(1.0, quota[0] / max(1, sizes.get(0, 0))))
    picked = one.where(place < share * 1_000_000)
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), *([F.col("lang")] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")]))
    # at most max_docs rows of 12 bytes; the texts are read once
    joined = materialize(text.join(F.broadcast(picked), "__id").select("__id", "text", "lang", "y"), "labelled")
    rows = joined.select("__id", "text", "lang", "y").toArrow().to_pandas().sort_values(["__id", "text"], kind="stable").reset_index(drop=True)
    tongue = langid.fit(joined, "text", "lang", "__id", max_docs=1000)
    words, names = _numbered(rows["text"].tolist())
    y = rows["y"].to_numpy(dtype=np.int64) if len(rows) else np.zeros(0, np.int64)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(buckets, (1,), np.zeros((buckets, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), 1.0 if y.sum() else -1.0, {"": 0.0}, tongue)
    held = np.array([zlib.crc32(b"%d" % i) % 5 == 0 for i in range(len(rows))])
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    learn = np.flatnonzero(~held)
    table, bias, out, out_bias = _train([words[i] for i in learn], names, y[learn], buckets, dim, filters, widths, epochs if len(learn) >= 2000 else 3 * epochs, seed)
    del words, names
    model = ToxicityModel(buckets, widths, table, bias, out, out_bias, {}, tongue)
    judged = np.flatnonzero(held) if held.any() else learn
    found = Scorer(model).score([rows["text"][i] for i in judged])
    logits, spoken = np.array([x for x, _ in found]), np.array([x for _, x in found])
    model.calibration[""] = _calibrate(logits, y[judged])
    for name in sorted(set(spoken.tolist())):
        own = spoken == name
        if own.sum() * (5 if held.any() else 1) >= min_lang_docs and len(set(y[judged][own].tolist())) == 2:
            model.calibration[name] = _calibrate(logits[own], y[judged][own])
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, score (0 to 1, from the whole text alone) and predicted (1 from 0.5 on).

    Null and empty texts are scored as texts without words. Other columns are dropped. Columns in keep that are called score
    or predicted raise ValueError.
    """
    if clash := {"score", "predicted"} & {c.lower() for c in keep}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size fixed by buckets, filters and fit()'s limits
    text = unused("text", keep)
    src = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for batch in batches:
            scored = scorer.score(batch.column(text).to_pylist())
            raw = np.array([x - m.calibration.get(spoken, m.calibration[""]) for x, spoken in scored])
            found = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])
        del scorer
        release()

    return src.mapInArrow(run, schema)
