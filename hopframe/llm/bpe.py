"""BPE encoding by depth-first walks over a trie of distinct words, and decoding.

In merge-ranked BPE every run of leading tokens of an encoding is the encoding of the text that it covers, and a token
sequence is an encoding exactly when each pair of neighbours is. So a prefix is described by its last token alone: of
the vocabulary's tokens that end the prefix, the one that may follow the last token of what stands before it. Words
that begin alike share those states, which are computed once for each trie node.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import BATCH_ROWS, bound_batches, release

#: Encoded words of one generation (a worker keeps two: hot words move to the new one), and token pairs. Where ids are
#: returned, and memory goes to them, words and batches are fewer.
_CHUNKS_KEPT, _CHUNKS_KEPT_WITH_IDS, _PAIRS_KEPT = 240_000, 60_000, 500_000
_BATCH_WITH_IDS = 512
#: What str.split() takes for white space and the files' pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class TrieBpe:
    """Encoder and decoder for a tokenizers file: BPE with an end-of-word suffix over byte-level characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or spec["decoder"]:
            raise ValueError("expected a BPE file with an end-of-word suffix, without unknown token and decoder")
        library = Tokenizer.from_file(path)
        self._normalize, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {(a, b): i for i, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"])}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ended = {s[: -len(self.end)]: s for s in self.vocab if s.endswith(self.end) and s != self.end}
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = np.array([names.get(i) for i in range(max(names) + 1)], object)
        self.longest = max(len(s) for s in self.vocab)
        # the byte-level character of each byte: the vocabulary names the printable ones by themselves
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self._letters = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self._rows: dict[str, dict[str, bool]] = {}
        self._n_pairs = 0
        self._ids: dict[str | int, bytes] = {}
        self._older = self._ids

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE over a short list of symbols."""
        while len(symbols) > 1:
            ranked = [(r, i) for i in range(len(symbols) - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
            if not ranked:
                break
            i = min(ranked)[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _row(self, left: str) -> dict[str, bool]:
        """For tokens seen after left, whether BPE leaves the two apart."""
        row = self._rows.get(left)
        if row is None:
            row = self._rows[left] = {}
        return row

    def _follows(self, left: str, right: str) -> bool:
        """Whether BPE leaves left and right apart."""
        apart = self.merge(self._symbols(left) + self._symbols(right)) == [left, right]
        self._row(left)[right] = apart
        self._n_pairs += 1
        return apart

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word (of byte-level characters).

        The sorted words are the trie, in depth-first order: a word's nodes are its prefixes, and those that it shares
        with the word before are still on the path, with their states. states[k] is the last token of the encoding of the
        first k symbols; the word's end is a symbol of its own.
        """
        if self._n_pairs >= _PAIRS_KEPT:
            self._rows, self._n_pairs = {}, 0
        vocab, ended, row, follows, longest = self.vocab, self.ended, self._row, self._follows, self.longest
        out: dict[str, list[str]] = {}
        states: list[str] = [""]
        rows: list[dict[str, bool]] = [{}]
        before = ""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(states)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], rows[shared + 1 :]
            for depth in range(shared + 1, n):
                for k in range(depth - longest if depth > longest else 0, depth):
                    token = word[k:depth]
                    if token in vocab:
                        if not k:
                            break
                        apart = rows[k].get(token)
                        if apart or apart is None and follows(states[k], token):
                            break
                states.append(token)
                rows.append(row(token))
            for k in range(n - longest if n > longest else 0, n):
                token = ended.get(word[k:])
                if token is not None and (not k or ((apart := rows[k].get(token)) or apart is None and follows(states[k], token))):
                    break
            tokens = [token]
            while k:
                tokens.append(states[k])
                k -= len(states[k])
            tokens.reverse()
            out[word] = tokens
            before = word
        return out

    def _pieces(self, text: str) -> list[str | int]:
        """Runs between blanks of the normalised text, and the ids of special tokens where they stand."""
        out, at = [], 0
        if any(s in text for s in self.special):
            while found := min(((i, s) for s in self.special if (i := text.find(s, at)) >= 0), default=None):
                out += self._normalize(text[at : found[0]]).split(" ")
                out.append(self.special[found[1]])
                at = found[0] + len(found[1])
        if text.isascii() and not at and not _SEPARATORS.search(text):
            return text.lower().split()
        return out + self._normalize(text[at:]).split(" ")

    def _words(self, chunk: str | int) -> list[str]:
        """The words of a run, in byte-level characters; plain ones need no call of the library."""
        if not isinstance(chunk, str) or not chunk:
            return []
        body, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".," else (chunk, "")
        if body.isalpha() and (body.isascii() or max(body) < "\u0250"):  # Latin letters alone, of any Unicode version
            if not body.isascii():
                body = body.encode().decode("latin-1").translate(self._letters)
            return [body, mark] if mark else [body]
        return [w for w, _ in self._split(chunk)]

    def encode_batch(self, texts: list[str], kept: int = _CHUNKS_KEPT) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; some kept words' ids are remembered."""
        pieces = [[c for c in p if c != ""] if "" in p else p for p in map(self._pieces, texts)]
        if len(self._ids) >= kept:
            self._older, self._ids = self._ids, {}
        known, older, vocab = self._ids, self._older, self.vocab
        new = set().union(*pieces).difference(known)
        for c in new.intersection(older):
            known[c] = older[c]
        split = {c: self._words(c) for c in new if c not in known}
        encoded = self.encode_words({w for ws in split.values() for w in ws})
        for c, ws in split.items():
            known[c] = array("I", [vocab[t] for w in ws for t in encoded[w]] if isinstance(c, str) else [c]).tobytes()
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def forget(self) -> None:
        """Drop the words seen so far; what is known of token pairs stays."""
        self._ids = {}
        self._older = self._ids

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The tokens' strings with a blank between two; ids that are no token's are left out."""
        ids = np.asarray(ids, np.int64)
        inside = (ids >= 0) & (ids < len(self.names))
        found = self.names[ids if inside.all() else ids[inside]].tolist()
        return " ".join(found if None not in found else [x for x in found if x is not None])


@cache
def load(path: str) -> TrieBpe:
    """One encoder for each worker and file."""
    return TrieBpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens) of each row's whole text; null is an empty text. path must exist on every worker."""
    return _encoded(docs, path, text_col, id_col, "doc_id long, ids array<int>, n_tokens long")


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, decoded_sha256): as encode(), and the hash of what the ids decode to."""
    return _encoded(docs, path, text_col, id_col, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string")


def digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): round_trip() with a hash in place of the ids."""
    return _encoded(docs, path, text_col, id_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(docs: DataFrame, path: str, text_col: str, id_col: str, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    with_ids = "ids" in names
    bound_batches(docs.sparkSession, _BATCH_WITH_IDS if with_ids else BATCH_ROWS)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        make = {
            "ids": lambda ids: pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
            "n_tokens": lambda ids: pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": lambda ids: pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": lambda ids: pa.array([hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in ids], pa.string()),
        }
        for batch in batches:
            ids = bpe.encode_batch(batch.column("text").to_pylist(), _CHUNKS_KEPT_WITH_IDS if with_ids else _CHUNKS_KEPT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[make[n](ids) for n in names[1:]]], names=names)
        bpe.forget()
        release()

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of rows of ids: their tokens' strings with a blank between two, special ones too. Null and empty ids
    give an empty text; a null among ids, or one that is no token's, is left out."""
    bound_batches(encoded.sparkSession, _BATCH_WITH_IDS)
    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.array_compact(F.coalesce(F.col(ids_col), F.array())).cast("array<long>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
        release()

    return src.mapInArrow(run, "doc_id long, text string")
