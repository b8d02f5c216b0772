"""Secret scans: patterns propose candidates, a random forest trained from labelled findings removes false ones.

DataFrame functions only; the forest is grown on the driver from a bounded list of findings, whose features the same column
expressions make. Its trees are two literal arrays that an expression walks, so that the plan stays small and a document's
candidates are judged where the document lies. Every pattern runs in time proportional to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import DICTIONARY

#: Published forms of credentials, tried in this order. A key's block has at most 64 dashes in its headers.
RULES: tuple[tuple[str, str], ...] = (
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,64}+-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    ("aws_access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{10,}+"),
    ("google_api_key", r"(?<![A-Za-z0-9_-])AIza[0-9A-Za-z_-]{35}"),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)
#: Any long run of such characters with a digit; it starts where the run starts.
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Names of settings that hold secrets, and what may follow them.
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "passphrase", "api[_-]?key", "access[_-]?key", "private[_-]?key", "credential", "auth")
ASSIGNED = r"(?i)(?:" + "|".join(KEYWORDS) + r")[a-z0-9_-]{0,16}[\"']?\s{0,4}(?:=>|:=|=|:)\s{0,4}[\"']?([^\s\"']{6,}+)"
#: Words that neighbour or fill what only looks like a secret, and parts of paths where such things lie.
PLACEHOLDERS = ("example", "sample", "dummy", "test", "fake", "placeholder", "your", "changeme", "redacted", "xxxx", "none", "null", "true", "false")
DIGESTS = ("sha1", "sha256", "sha512", "md5", "commit", "checksum", "digest", "uuid", "etag", "revision", "hash", "version", "build")
TEST_PATHS = ("test", "example", "sample", "fixture", "mock", "docs?", "demo")
FEATURES = ("length", "changes", "vowel_pairs", "digits", "capitals", "distinct", "coverage", "rule", "assigned", "keyword", "placeholder", "digest", "in_path", "test_path", "word_like", "hex")
MASK = "[SECRET]"
#: Characters before and after a place that are its surroundings.
BEFORE, AFTER = 48, 24
#: Characters of the pieces that a text is cut into, so that a place is reached without walking the text.
_PIECE = 2048
#: Running sums are made by blocks of so many.
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(words)).cast("double"), F.lit(0.0))


def rule_of(value: Column) -> Column:
    """Name of the first rule whose form the whole value has, else "opaque" or "assigned"."""
    out = F.when(value.rlike(rf"\A(?:{OPAQUE})\z") & value.rlike("[0-9]"), F.lit("opaque")).otherwise(F.lit("assigned"))
    for name, pattern in reversed(RULES):
        out = F.when(value.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def features(value: Column, before: Column, after: Column, path: Column, rule: Column) -> list[Column]:
    """FEATURES, in that order, as doubles: length and character classes and their changes, how much dictionary words
    cover, the file path, and the neighbouring words."""
    n = F.greatest(F.length(value), F.lit(1))
    changes = _share(value, r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")
    covered = F.lit(1.0) - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n
    return [
        F.least(n, F.lit(200)).cast("double"),
        changes,
        _share(value, r"(?i)[aeiou][b-df-hj-np-tv-z]|[b-df-hj-np-tv-z][aeiou]"),
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40)),
        covered,
        F.when(rule.isin("assigned", "opaque"), 0.0).otherwise(1.0),
        before.rlike(r"(?:=>|:=|=|:)\s*[\"']?\z").cast("double"),
        _any(before, KEYWORDS),
        F.greatest(_any(before, PLACEHOLDERS), _any(after, PLACEHOLDERS), _any(value, PLACEHOLDERS)),
        _any(before, DIGESTS),
        (before.rlike(r"[/\\]\z") | value.rlike(r"/.*/") | after.rlike(r"\A[/\\]")).cast("double"),
        _any(F.coalesce(path, F.lit("")), TEST_PATHS),
        value.rlike(r"\A[\p{L}'-]+[.,;:!?]*\z").cast("double"),
        value.rlike(r"\A[0-9a-fA-F]+\z").cast("double"),
    ]


@dataclass
class SecretModel:
    """Complete binary trees, all of one depth, side by side: the node k of tree t is at t * (2^depth - 1) + k, its
    children are 2k + 1 and, where the feature is over the threshold, 2k + 2; leaves hold a vote 0 or 1."""

    depth: int
    feature: list[int]
    threshold: list[float]
    leaf: list[int]

    @property
    def trees(self) -> int:
        return len(self.leaf) >> self.depth


def _best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
    """(column, threshold) with the least Gini impurity, ties to the earlier column and smaller threshold."""
    n, best = len(y), None
    least = 2 * y.sum() * (n - y.sum()) / n - 1e-12
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, ones = x[order, c], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        k = at + 1
        a, b = ones[at], ones[-1] - ones[at]
        impurity = 2 * a * (k - a) / k + 2 * b * (n - k - b) / (n - k)
        i = int(impurity.argmin())
        if impurity[i] < least:
            least, best = impurity[i], (int(c), float((v[at[i]] + v[at[i] + 1]) / 2))
    return best


def _forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> SecretModel:
    """Trees over bootstrap samples; each split chooses among the square root of the features."""
    rng = np.random.default_rng(seed)
    inner, most = 2**depth - 1, max(1, int(x.shape[1] ** 0.5))
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        # a node without a split sends everything to its left child
        f, t, votes = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1, int)
        stack = [(0, rows)]
        while stack:
            k, own = stack.pop()
            if k >= inner:
                votes[k - inner] = int(2 * y[own].sum() > len(own))
                continue
            split = _best_split(x[own], y[own], rng.permutation(x.shape[1])[:most])
            over = x[own, split[0]] > split[1] if split else np.zeros(len(own), bool)
            if split:
                f[k], t[k] = split
                stack.append((2 * k + 2, own[over]))
            stack.append((2 * k + 1, own[~over]))
        feature += f.tolist()
        threshold += t.tolist()
        leaf += votes.tolist()
    return SecretModel(depth, feature, threshold, leaf)


def fit(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 7, max_findings: int = 20_000) -> SecretModel:
    """Train on labelled findings (value, before, after, path, label 0 or 1): a reviewed list; of more than max_findings
    rows those with the smallest hash are taken.

    Rows with a null value or label teach nothing; null context counts as empty. ValueError unless both labels occur.
    """
    context = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "after", "path")]
    rows = findings.where("value is not null and label in (0, 1)").select("value", *context, F.col("label").cast("int").alias("label"))
    order = F.xxhash64("value", "before", "after", "path", "label")
    rows = rows.withColumn("h", order).orderBy("h", "value", "before", "after", "path", "label").limit(max_findings)
    told = lambda r: F.array(*features(r["value"], r["before"], r["after"], r["path"], rule_of(r["value"])))
    own = _let(F.struct("value", "before", "after", "path"), told)
    got = rows.select("h", "label", own.alias("x")).collect()
    got.sort(key=lambda r: (r["h"], r["label"], r["x"]))
    y = np.array([r["label"] for r in got], int)
    if len(set(y.tolist())) < 2:
        raise ValueError("findings of both labels are needed")
    return _forest(np.array([r["x"] for r in got], float), y, trees, depth, seed)


def _literal(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join("Infinity" if v == float("inf") else repr(v) for v in values)), ",").cast(f"array<{kind}>")


def _score(model: SecretModel, own: Column) -> Column:
    """Share of the trees that vote for the features in own."""
    inner = 2**model.depth - 1
    feature, threshold, leaf = _literal(model.feature, "int"), _literal(model.threshold, "double"), _literal(model.leaf, "int")

    def vote(t: Column) -> Column:
        step = lambda k, _: _let(t * inner + k, lambda at: k * 2 + 1 + (own[feature[at]] > threshold[at]).cast("int"))
        return leaf[t * (inner + 1) + F.aggregate(F.sequence(F.lit(1), F.lit(model.depth)), F.lit(0), step) - inner]

    return F.aggregate(F.sequence(F.lit(0), F.lit(model.trees - 1)), F.lit(0), lambda s, t: s + vote(t)) / F.lit(float(model.trees))


def _running(x: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of join over a non-empty array<long>, made by blocks: one growing array would be copied for each
    element."""

    def block(done: Column, b: Column) -> Column:
        first = F.coalesce(F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(-1)), F.lit(0).cast("long"))
        one = F.aggregate(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)), F.array(first), lambda s, v: F.concat(s, F.array(join(F.element_at(s, -1), v))))
        return F.concat(done, F.array(one))

    blocks = F.sequence(F.lit(0), F.call_function("div", F.size(x) - 1, F.lit(_BLOCK)).cast("int"))
    joined = F.aggregate(blocks, F.array().cast("array<array<long>>"), block)
    return F.flatten(F.transform(joined, lambda s: F.slice(s, 2, _BLOCK)))


#: A place is one long, start (from 0) times _WIDE plus length, as Spark finds distinct longs by hash.
_WIDE = 1 << 31


def _places(text: Column, pattern: str, hits: Column, value: Callable[[Column], Column]) -> Column:
    """array<long>: the places of value(hit), the end of every hit of pattern in text, in order."""

    def located(lengths: Column) -> Column:
        ends = _running(F.transform(lengths, lambda x: x["step"]), lambda a, b: a + b)
        return F.zip_with(ends, lengths, lambda e, x: F.when(x["own"] > 0, (e - x["own"]) * _WIDE + x["own"]))

    gaps = F.split(text, pattern, -1)
    steps = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")), lambda z: F.struct((F.length(z["gap"]) + F.length(z["hit"])).cast("long").alias("step"), F.length(value(z["hit"])).cast("long").alias("own")))
    return F.when(F.size(hits) > 0, F.array_compact(_let(steps, located))).otherwise(F.array().cast("array<long>"))


def _cut(pieces: Column, start: Column, n: Column) -> Column:
    """n characters of the text from start (from 0) on."""
    first = F.call_function("div", start, F.lit(_PIECE)).cast("int")
    last = F.call_function("div", start + n, F.lit(_PIECE)).cast("int")
    return F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (start - first * _PIECE + 1).cast("int"), n.cast("int"))


def _findings(model: SecretModel, text: Column, path: Column, then: Callable[[Column, Column], Column], empty: Column) -> Column:
    """then(pieces, found) for a text with candidates, else empty; found is array<struct(value, rule, start, length,
    score)>, a candidate for each place, in order of start (from 0) and length."""
    known = "|".join(p for _, p in RULES)
    digit = lambda v: F.when(v.rlike("[0-9]"), v).otherwise(F.lit(""))
    kinds = ((known, lambda v: v), (OPAQUE, digit), (ASSIGNED, lambda v: F.regexp_extract(v, ASSIGNED, 1)))

    def hits(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if pattern == OPAQUE:
            return _let(found, lambda h: F.when(F.exists(h, lambda v: v.rlike("[0-9]")), h).otherwise(F.array().cast("array<string>")))
        return found

    def judged(pieces: Column, h: Column) -> Column:
        at = F.sort_array(F.array_distinct(F.concat(*[_places(text, p, h[f"h{i}"], v) for i, (p, v) in enumerate(kinds)])))
        start, n = lambda c: F.call_function("div", c, F.lit(_WIDE)), lambda c: c % _WIDE
        near = F.transform(at, lambda c: F.struct(start(c).alias("start"), n(c).alias("length"), _cut(pieces, start(c), n(c)).alias("value"), _cut(pieces, F.greatest(start(c) - BEFORE, F.lit(0)), F.least(start(c), F.lit(BEFORE))).alias("before"), _cut(pieces, start(c) + n(c), F.lit(AFTER)).alias("after")))
        ruled = F.transform(near, lambda c: F.struct(c.alias("c"), rule_of(c["value"]).alias("rule")))
        told = F.transform(ruled, lambda r: F.struct(r.alias("r"), F.array(*features(r["c"]["value"], r["c"]["before"], r["c"]["after"], path, r["rule"])).alias("x")))
        return F.transform(told, lambda t: F.struct(t["r"]["c"]["value"].alias("value"), t["r"]["rule"].alias("rule"), t["r"]["c"]["start"].alias("start"), t["r"]["c"]["length"].alias("length"), _score(model, t["x"]).alias("score")))

    def cut(h: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
        some = _let(pieces, lambda p: _let(judged(p, h), lambda found: then(p, found)))
        return F.when(sum(F.size(h[f"h{i}"]) for i in range(len(kinds))) > 0, some).otherwise(empty)

    return _let(F.struct(*[hits(p).alias(f"h{i}") for i, (p, _) in enumerate(kinds)]), cut)


_FOUND = "array<struct<value:string,rule:string,start:bigint,length:bigint,score:double>>"


def scan(docs: DataFrame, model: SecretModel, text_col: str = "text", path_col: str | None = "source", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, rule, start, length, score, is_secret, value): a row for each place of a candidate in each whole text,
    start counted from 1 in characters; score is the share of trees that vote for it, by its own surroundings.

    Null and empty texts give no row; equal rows give equal rows; a null path is an empty one. Extra columns are ignored.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    src = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    found = _findings(model, F.col("text"), F.col("path"), lambda _, f: f, F.array().cast(_FOUND))
    rows = src.select("doc_id", F.explode(found).alias("f"))
    return rows.select("doc_id", "f.rule", (F.col("f.start") + 1).alias("start"), "f.length", "f.score", (F.col("f.score") >= threshold).alias("is_secret"), "f.value")


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """docs with every place of a secret in text_col replaced by mask, overlapping ones by one; all rows and columns stay,
    null and empty texts as they are."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.col(text_col)

    def masked(pieces: Column, found: Column) -> Column:
        def rebuilt(own: Column) -> Column:
            # where each secret starts and ends, and how far those before it reach
            ends = F.transform(own, lambda f: f["start"] + f["length"])
            return _let(_running(ends, F.greatest), lambda reach: F.concat(F.array_join(F.transform(own, lambda f, i: part(f, reach, i)), ""), rest(F.element_at(reach, -1))))

        def part(f: Column, reach: Column, i: Column) -> Column:
            return _let(F.when(i > 0, F.try_element_at(reach, i)).otherwise(F.lit(0).cast("long")), lambda at: F.when(f["start"] < at, F.lit("")).otherwise(F.concat(_cut(pieces, at, f["start"] - at), F.lit(mask))))

        rest = lambda at: _cut(pieces, at, F.length(text).cast("long") - at)
        return _let(F.filter(found, lambda f: f["score"] >= threshold), lambda own: F.when(F.size(own) > 0, rebuilt(own)).otherwise(text))

    return docs.withColumn(text_col, F.coalesce(_findings(model, text, path, masked, text), text))
