"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list, and decoding by concatenation."""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the word pattern of the byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LARGEST_FILE = 64 << 20  # of a vocabulary that is broadcast
CACHED_WORDS = 400_000  # of a worker; the cache starts anew beyond
LONGEST_CACHED = 64  # characters
WORDS_AT_ONCE = 100_000
PLACE_BITS = 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it can be seen, else the next after 255."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    unseen = [b for b in range(256) if b not in set(seen)]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(unseen)}
    return [letters[b] for b in range(256)]


class Words(dict):
    """Packed ids of words; a word that is missing is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        packed = array("I", self.encode(word.encode())).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = packed
        return packed


class Vocabulary:
    """Merges and vocabulary strings of a byte-level tokenizer file."""

    def __init__(self, content: dict):
        model, letters = content["model"], byte_letters()
        ids = model["vocab"]
        self.byte_ids = [ids[x] for x in letters]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(ids[left] << 32 | ids[right], rank)
            self.merged.append(ids[left + right])
        to_byte = {x: b for b, x in enumerate(letters)}
        self.strings = {i: bytes(to_byte[x] for x in token) for token, i in ids.items()}
        added = {x["content"]: x["id"] for x in content.get("added_tokens", [])}
        self.strings |= {i: token.encode() for token, i in added.items()}
        self.added = added
        longest = sorted(map(regex.escape, added), key=len, reverse=True)
        self.split_added = regex.compile(f"({'|'.join(longest)})") if added else None
        self.words = regex.compile(WORDS)
        self.cache = Words(self.merge)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word.

        Symbols form a doubly linked list.  The queue holds (rank, place of the left symbol); an entry whose pair has
        changed since is stale and skipped.  The lowest rank goes first, of equal ranks the leftmost.
        """
        symbols = [self.byte_ids[b] for b in data]
        end = len(symbols)
        if end < 2:
            return symbols
        ranks, after, before = self.ranks, list(range(1, end + 1)), list(range(-1, end - 1))
        queue = []
        for i in range(end - 1):
            rank = ranks.get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << PLACE_BITS | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> PLACE_BITS, entry & (1 << PLACE_BITS) - 1
            j = after[i]
            if symbols[i] < 0 or j == end or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = self.merged[rank], -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                new = ranks.get(symbols[i] << 32 | symbols[k])
                if new is not None:
                    heapq.heappush(queue, new << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                new = ranks.get(symbols[h] << 32 | symbols[i])
                if new is not None:
                    heapq.heappush(queue, new << PLACE_BITS | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of added tokens become their ids."""
        pieces = self.split_added.split(text) if self.split_added else [text]
        out = []
        for piece in pieces:
            if piece in self.added:
                out.append(array("I", [self.added[piece]]).tobytes())
            elif len(piece) < 1 << 20:
                out += map(self.cache.__getitem__, self.words.findall(piece))
            else:
                found = (m.group() for m in self.words.finditer(piece))
                while part := list(islice(found, WORDS_AT_ONCE)):
                    out.append(b"".join(map(self.cache.__getitem__, part)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = array("I", packed)
        return b"".join(map(self.strings.__getitem__, ids)).decode(errors="replace")


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary with its cache for each worker process and broadcast."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Vocabulary(json.loads(shared.value))
    return _loaded[shared.id]


class _Shared:
    """A broadcast file and a name for it that workers can compare."""

    def __init__(self, spark, path: str):
        if os.path.getsize(path) > LARGEST_FILE:
            raise ValueError(f"vocabulary file over {LARGEST_FILE} bytes: {path}")
        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.id, self.content = hash(content), spark.sparkContext.broadcast(content)

    @property
    def value(self) -> str:
        return self.content.value


def _added_column(df: DataFrame, source: str, name: str, kind: T.DataType, make) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    df = df.select(*rest)
    at, schema = rest.index(source), T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            column = pa.array((one(x.as_py()) for x in batch.column(at)), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*rest, name])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", name: str = "token_ids") -> DataFrame:
    """``docs`` with ``token_ids``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    ``path`` is a byte-level tokenizer file on the driver.  A null text has no ids, as the empty one.  Rows stay where they are: nothing is shuffled.
    All columns are kept, one already called ``name`` is replaced.
    """
    shared = _Shared(docs.sparkSession, path)

    def make():
        vocabulary = _vocabulary(shared)
        return lambda text: vocabulary.encode(text or "")

    return _added_column(docs, text_col, name, T.BinaryType(), make)


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", name: str = "decoded") -> DataFrame:
    """``docs`` with ``decoded``: the vocabulary strings of the packed ids, concatenated and read as UTF-8.

    Bytes that are not UTF-8 become replacement characters; null ids give the empty text.
    """
    shared = _Shared(docs.sparkSession, path)

    def make():
        vocabulary = _vocabulary(shared)
        return lambda packed: vocabulary.decode(packed or b"")

    return _added_column(docs, ids_col, name, T.StringType(), make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of a round trip through the ids."""
    encoded = encode(docs.select("doc_id", "text"), path).drop("text")
    return decode(encoded, path).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
