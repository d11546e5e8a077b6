"""Operator 13, byte-level BPE by recursive DuckDB queries inside each Spark partition.

A rank file and a split pattern are parameters. Each task cuts its texts into words by the pattern and hands the words
that it has not met before to DuckDB as rows (word, position, token), one a byte. A recursive query joins adjacent
tokens to the merge table, contracts the leftmost pair of minimum rank and goes on until no pair of a word can merge.
Words of more bytes than the longest token are contracted at every pair that is the leftmost minimum within a window
of that many bytes to both sides: no merge outside of the window can reach the pair first, so the tokens are the same
and a long word takes few rounds. An aggregation ordered by position gives each word's ids and its decoded bytes.

Null texts count as empty and have no ids; texts of any length are encoded whole, by blocks of words; repeated rows
get the same answer; an empty table gives an empty result; other columns pass through, but columns that the result
names are replaced. Strings that look like special tokens are ordinary text. One word is held by one task; Spark
deals out the texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

#: Bytes of a worker's memory of words, and what an entry takes beside its texts; when full, words not in use go.
MEMORY_BYTES = 128 << 20
ENTRY_BYTES = 320
#: Words whose ids are sought together, and bytes of new words in one recursive query.
BLOCK_WORDS = 200_000
QUERY_BYTES = 512 << 10
#: Rounds of one recursive query; words that need more go on in the next.
ROUNDS = 24
#: Texts of more characters than this are cut into words piece by piece.
LONG_TEXT = 4 << 20

# A pair's place in the order of contraction is its rank, then its position in the word: rank * 2^32 + position.
#: Words of at most as many bytes as the longest token: one contraction a round. The last round has the fewest tokens.
_MERGE_SHORT = """
WITH RECURSIVE parts(w, toks) AS (
  SELECT w, list(tok ORDER BY pos) FROM seed GROUP BY w
  UNION ALL
  SELECT w, list_concat(list_concat(toks[:key % 4294967296 - 1], [(key // 4294967296)::INT]), toks[key % 4294967296 + 2:])
  FROM parts JOIN (
    SELECT w, min(m.rank * 4294967296 + pos) AS key
    FROM (SELECT w, pos, toks[pos]::BIGINT * 4294967296 + toks[pos + 1] AS pair FROM (SELECT w, toks, unnest(range(1, len(toks))) AS pos FROM parts))
    JOIN merges m USING (pair) GROUP BY w
  ) USING (w)
)
SELECT w, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM (SELECT w, arg_min(toks, len(toks)) AS toks FROM parts GROUP BY w)
"""
#: Longer words: a contraction a round and window of as many bytes. Words that are not done after the rounds go on.
_MERGE_LONG = """
WITH RECURSIVE pairs AS (
  SELECT w, pos, tok, tok::BIGINT * 4294967296 + lead(tok) OVER (PARTITION BY w ORDER BY pos) AS pair FROM seed
), parts(step, w, pos, tok, key, least, live) AS (
  SELECT 0, w, pos, tok, key, {least}, min(key) OVER (PARTITION BY w) IS NOT NULL
  FROM (SELECT w, pos, tok, m.rank * 4294967296 + pos AS key FROM pairs LEFT JOIN merges m USING (pair))
  UNION ALL
  SELECT step, w, pos, tok, key, {least}, min(key) OVER (PARTITION BY w) IS NOT NULL
  FROM (SELECT step, w, pos, tok, m.rank * 4294967296 + pos AS key FROM (
    SELECT step, w, pos, tok, tok::BIGINT * 4294967296 + lead(tok) OVER (PARTITION BY w ORDER BY pos) AS pair FROM (
      SELECT step + 1 AS step, w, pos, (CASE WHEN key = least THEN key // 4294967296 ELSE tok END)::INT AS tok,
        coalesce(lag(key = least) OVER (PARTITION BY w ORDER BY pos), false) AS absorbed
      FROM parts WHERE live AND step < {rounds}
    ) WHERE NOT absorbed
  ) LEFT JOIN merges m USING (pair))
)
SELECT w, pos, tok, live FROM parts WHERE NOT live OR step = {rounds}
"""
_LEAST = "min(key) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN {window} PRECEDING AND {window} FOLLOWING)"
_ORDERED = """
SELECT w, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS bytes
FROM done JOIN tokens USING (tok) GROUP BY w
"""


class RankedBpe:
    """A rank file in DuckDB tables, and the words that this worker has met: word -> (ids joined by commas, bytes)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranks, self.window = ranks, max(map(len, ranks))
        self.words = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        cut = [(token, rank, ranks.get(token[:i]), ranks.get(token[i:])) for token, rank in ranks.items() for i in range(1, len(token))]
        merges = [(a * 2**32 + b, rank) for _, rank, a, b in cut if a is not None and b is not None]
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "700MB"})
        self._table("merges", pair=np.array([p for p, _ in merges], dtype=np.int64), rank=np.array([r for _, r in merges], dtype=np.int64))
        self._table("tokens", tok=np.array(list(ranks.values()), dtype=np.int32), hex=[t.hex() for t in ranks])
        self.known: dict[str, tuple[str, bytes]] = {}
        self.used = 0

    def _table(self, name: str, **columns) -> None:
        rows = pa.table(columns)
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def _contracted(self, words: list[bytes]) -> list[tuple[int, str, str]]:
        """(index, ids, bytes in hex) of words, each of one byte or more."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self._table("seed", w=np.repeat(np.arange(len(words), dtype=np.int32), lengths), pos=at, tok=self.byte[flat])
        self.db.execute("CREATE OR REPLACE TABLE done (w INT, pos BIGINT, tok INT)")
        if lengths.max() <= self.window:
            self.db.execute("INSERT INTO done " + _MERGE_SHORT)
            return self.db.execute(_ORDERED).fetchall()
        merge = _MERGE_LONG.format(least=_LEAST.format(window=self.window), rounds=ROUNDS)
        while self.db.execute("SELECT count(*) FROM seed").fetchone()[0]:
            self.db.execute("CREATE OR REPLACE TABLE after AS " + merge)
            self.db.execute("INSERT INTO done SELECT w, pos, tok FROM after WHERE NOT live")
            self.db.execute("CREATE OR REPLACE TABLE seed AS SELECT w, pos, tok FROM after WHERE live")
        return self.db.execute(_ORDERED).fetchall()

    def learn(self, words: set[str]) -> None:
        """Add words to those known. A word that is a token is that token; the others are contracted."""
        todo: list[tuple[str, bytes]] = []
        for word in words:
            raw = word.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is None:
                todo.append((word, raw))
            else:
                self._keep(word, str(rank), raw)
        todo.sort(key=lambda x: len(x[1]))
        start = 0
        while start < len(todo):
            end, size = start, 0
            is_short = len(todo[start][1]) <= self.window
            while end < len(todo) and (end == start or size + len(todo[end][1]) <= QUERY_BYTES):
                if is_short != (len(todo[end][1]) <= self.window):
                    break
                size += len(todo[end][1])
                end += 1
            for i, ids, raw in self._contracted([raw for _, raw in todo[start:end]]):
                self._keep(todo[start + i][0], ids, bytes.fromhex(raw))
            start = end

    def _keep(self, word: str, ids: str, raw: bytes) -> None:
        self.known[word] = ids, raw
        self.used += len(ids) + 2 * len(raw) + ENTRY_BYTES

    def _blocks(self, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """Blocks of (index of the text, some of its words in order), of BLOCK_WORDS words or one text's more."""
        block, size = [], 0
        for i, text in enumerate(texts):
            if text and len(text) > LONG_TEXT:
                found = (m[0] for m in self.words.finditer(text))
                pieces = iter(lambda: list(islice(found, BLOCK_WORDS)), [])
            else:
                pieces = [self.words.findall(text or "")]
            for words in pieces:
                block.append((i, words))
                size += len(words)
                if size >= BLOCK_WORDS:
                    yield block
                    block, size = [], 0
        yield block

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
        """(index of the text, its words' ids and decoded bytes in order); a long text comes in several pieces."""
        for block in self._blocks(texts):
            wanted = set().union(*(words for _, words in block))
            fresh = {word for word in wanted if word not in self.known}
            if fresh and self.used > MEMORY_BYTES:
                # frequent words are in every block and stay
                stay = {word: self.known[word] for word in wanted if word in self.known}
                self.known, self.used = stay, sum(len(ids) + 2 * len(raw) + ENTRY_BYTES for ids, raw in stay.values())
            self.learn(fresh)
            for i, words in block:
                yield i, list(map(self.known.__getitem__, words))

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of lists of ids: rows (list, position, id) join the token table and are aggregated in order."""
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        out = [b""] * len(lists)
        if lengths.sum():
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self._table("done", w=np.repeat(np.arange(len(lists), dtype=np.int32), lengths), pos=at, tok=np.concatenate(lists).astype(np.int32))
            for w, _, raw in self.db.execute(_ORDERED).fetchall():
                out[w] = bytes.fromhex(raw)
        return out


_loaded: dict[tuple[str, str], RankedBpe] = {}


def tokenizer(path: str, pattern: str) -> RankedBpe:
    """The rank file of path with its words' pattern, read once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = RankedBpe(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>) and n_tokens; path must be readable on every executor."""

    @F.pandas_udf("array<int>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(path, pattern)
        for texts in parts:
            ids: list[list[int]] = [[] for _ in texts]
            for i, words in bpe.encode(list(texts)):
                ids[i] += [int(x) for word, _ in words for x in word.split(",")]
            yield pd.Series(ids, dtype=object)

    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    return docs.select(*rest, encoded(F.col(f"`{text}`")).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """A frame with ids gets decoded, the bytes of its tokens; a null ids counts as empty."""

    @F.pandas_udf("binary")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(path, pattern)
        for lists in parts:
            yield pd.Series(bpe.decode([np.asarray([] if x is None else x, dtype=np.int32) for x in lists]), dtype=object)

    small_batches(encoded.sparkSession)
    return encoded.withColumn("decoded", decoded("ids"))


def _digest(bpe: RankedBpe, texts: list[str | None]) -> pd.DataFrame:
    counts, ids, raws = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
    for i, words in bpe.encode(texts):
        if words:
            joined = ",".join([x for x, _ in words])
            ids[i].update(("," + joined if counts[i] else joined).encode())
            counts[i] += joined.count(",") + 1
            raws[i].update(b"".join([raw for _, raw in words]))
    return pd.DataFrame({"n_tokens": counts, "ids_sha256": [h.hexdigest() for h in ids], "decoded_sha256": [h.hexdigest() for h in raws]})


def digest_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256: encode and decode in one pass.

    A text's decoded bytes are those that the ordered aggregation gives for its words' ids, in the words' order.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path, pattern)
        for texts in parts:
            yield _digest(bpe, list(texts))

    own = ("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    small_batches(docs.sparkSession)
    (made,) = unused(docs, "bpe")
    return docs.select(*rest, digested(F.col(f"`{text}`")).alias(made)).select(*rest, f"{made}.*")
