"""Operator 3, BPE encoding and decoding with a contiguous rank array.

The vocabulary file is of the tokenizers library's kind: lower-cased words of letters, single digits and runs of other
signs, bytes mapped to letters, a word-end mark on the last symbol. A short word's parts lie in one array beside the
ranks of the adjacent pairs; the smallest rank is sought by a scan, its boundary deleted and the two neighbouring
ranks refreshed. Long words use a heap of the same ranks, so that a word of any length is encoded whole.

Null texts count as empty and have no ids; texts of any length are encoded whole; repeated rows get the same answer;
an empty table gives an empty result; other columns pass through, but columns that the result names are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

#: Words of more symbols than this go to the heap.
SHORT = 256
#: Bytes of a worker's memory of encoded chunks, and what an entry takes beside its key and ids; when full it is emptied.
#: A worker's share of texts has some hundred thousand rare chunks between two of a kind, so a small memory forgets them.
MEMORY_BYTES = 128 << 20
ENTRY_BYTES = 140
#: Chunks of more bytes than this are not remembered.
REMEMBER_BYTES = 64

_NONE = 1 << 60


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """A vocabulary, read from its file, with encode() and decode() for single texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.special_at = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word_at = regex.compile(pattern)
        self.chunks: dict[bytes, bytes] = {}
        self.used = 0

    def _merge_short(self, ids: list[int]) -> list[int]:
        pairs = self.merges
        nothing = (_NONE, 0)
        found = [pairs.get(p, nothing) for p in zip(ids, ids[1:])]
        ranks = [x[0] for x in found]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            ids[at] = pairs[ids[at], ids[at + 1]][1]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = pairs.get((ids[at], ids[at + 1]), nothing)[0]
            if at:
                ranks[at - 1] = pairs.get((ids[at - 1], ids[at]), nothing)[0]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order: smallest rank first, leftmost of equals."""
        pairs, n = self.merges, len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i] = pairs[pair][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], i, p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in pairs:
                heapq.heappush(heap, (pairs[p][0], before[i], p))
        return [x for x, a in zip(ids, alive) if a]

    def _word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return (self._merge_short if len(ids) <= SHORT else self._merge_long)(ids)

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens: normalised, cut into words, merged."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered alone
        out: list[int] = []
        for word in self.word_at.findall(text.lower()):
            out += self._word(word)
        return out

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        ids: list[int] = []
        at = 0
        if b"<|" in chunk:
            for m in self.special_at.finditer(text):
                ids += self._plain(text[at : m.start()])
                ids.append(self.special[m[0]])
                at = m.end()
        ids += self._plain(text[at:])
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. No word crosses ASCII white space, so chunks are remembered."""
        known, out = self.chunks, []
        for chunk in (text or "").encode("utf-8", "replace").split():
            ids = known.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(chunk) <= REMEMBER_BYTES:
                    self.used += len(chunk) + len(ids) + ENTRY_BYTES
                    if self.used > MEMORY_BYTES:
                        known.clear()
                        self.used = 0
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' names with a space between, in UTF-8: the file names no decoder, so marks stay."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The vocabulary of path, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (binary, little-endian unsigned 32-bit) and n_tokens; path must be readable on every executor."""

    @F.pandas_udf("binary")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(path)
        for texts in parts:
            yield pd.Series([bpe.encode(t) for t in texts], dtype=object)

    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    return docs.select(*rest, encoded(F.col(f"`{text}`")).alias("ids")).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """A frame with ids gets the decoded text; a null ids counts as empty."""

    @F.pandas_udf("string")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(path)
        for ids in parts:
            yield pd.Series([bpe.decode(x or b"").decode() for x in ids], dtype=object)

    return encoded.withColumn("decoded", decoded("ids"))


def digest_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encode, decode and digest in one pass, so no ids are moved."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for texts in parts:
            rows = []
            for t in texts:
                ids = bpe.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    small_batches(docs.sparkSession)
    (made,) = unused(docs, "bpe")
    return docs.select(*rest, digested(F.col(f"`{text}`")).alias(made)).select(*rest, f"{made}.*")
