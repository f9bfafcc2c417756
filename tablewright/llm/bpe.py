"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last characters says so, so texts that share a passage share its chunks
wherever it stands. A chunk is encoded once and its tokens are used for every text that holds it; rows are dealt by
their least chunk hash first, so that texts which share chunks tend to meet in one task (Spark splits large lots).

Tokens next to a cut may be wrong, as a cut may go through a word. A position between a letter and a space that a letter
follows is a token boundary in any context. So from every chunk the tokens before its first such position and after its
last are taken off (checked: encoded alone they must agree with the chunk's own first and last tokens), and the stretch
between two chunks' kept tokens is encoded anew. A chunk without two such positions, or that does not agree, becomes
part of that stretch. The result is that of encoding the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

SHORTEST, MEAN_BITS, LONGEST = 512, 11, 16384          # characters of a chunk
REMEMBERED = 16 << 20                                   # characters of chunks kept per task; older ones are encoded again
#: Longer stretches go to the library whose merging is not quadratic in the length of one word; the result is the same.
LONG_STRETCH = 32_768

_GEAR = np.random.default_rng(20240613).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)
_SURE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text; the last is its length. Equal passages are cut alike, save near their ends."""
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    h = _GEAR[(code ^ (code >> np.uint32(16))) & np.uint32(0xFFFF)]
    for step in (1, 2, 4, 8, 16):                       # h[i] = sum of gear[i - k] << k over 32 characters
        wide = h.copy()
        wide[step:] += h[:-step] << np.uint32(step)
        h = wide
    found, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1).tolist():
        while at - last > LONGEST:
            last += LONGEST
            found.append(last)
        if at - last >= SHORTEST and at < n:
            found.append(at)
            last = at
    while n - last > LONGEST:
        last += LONGEST
        found.append(last)
    return [*found, n]


def chunk_key(text: str | None) -> int:
    """The least hash of a text's chunks: texts with the same chunks have the same key, similar ones often."""
    if not text:
        return 0
    ends = cuts(text)
    return min(int.from_bytes(hashlib.blake2b(text[a:b].encode(), digest_size=8).digest(), "little", signed=True) for a, b in zip([0, *ends], ends))


class Codec:
    """A byte-level BPE vocabulary in the ``tokenizers`` JSON format."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]     # bytes that stand for themselves in the vocabulary
        letter = {chr(b): b for b in plain}
        letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(letter[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.special = list(special)
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = token
        self.chunks: dict[str, tuple[np.ndarray, int, int, int, int]] = {}
        self.held = 0

    def straight(self, text: str) -> list[int]:
        """Tokens of a text encoded in one go."""
        if len(text) > LONG_STRETCH:
            return self.exact.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def chunk(self, text: str) -> tuple[np.ndarray, int, int, int, int]:
        """Tokens of a chunk, its first and last sure position, and how many tokens lie before and after them.

        A first position of -1 says that there is nothing to keep.
        """
        known = self.chunks.get(text)
        if known is None:
            tokens = self.straight(text)
            first = _SURE.search(text)
            known = (np.array(tokens, dtype="<u4"), -1, -1, 0, 0)
            if first:
                a = first.start()
                b = a
                reach = 64
                while True:                             # the last sure position, looked for from the end
                    tail = [m.start() for m in _SURE.finditer(text, max(0, len(text) - reach))]
                    if tail or reach >= len(text):
                        b = tail[-1] if tail else a
                        break
                    reach *= 4
                before, after = self.straight(text[:a]), self.straight(text[b:])
                if b > a and tokens[:len(before)] == before and tokens[len(tokens) - len(after):] == after:
                    known = (known[0], a, b, len(before), len(after))
            if self.held > REMEMBERED:
                self.chunks.clear()
                self.held = 0
            self.chunks[text] = known
            self.held += len(text)
        return known

    def encode(self, text: str) -> np.ndarray:
        """Tokens of a whole text, from its chunks and the repaired stretches between them."""
        ends = cuts(text)
        if len(ends) < 2:
            return np.array(self.straight(text), dtype="<u4") if text else np.empty(0, dtype="<u4")
        parts, done = [], 0                             # tokens up to position ``done`` are in ``parts``
        for start, stop in zip([0, *ends], ends):
            tokens, a, b, before, after = self.chunk(text[start:stop])
            if a < 0:
                continue
            if start + a > done:
                parts.append(np.array(self.straight(text[done:start + a]), dtype="<u4"))
            parts.append(tokens[before:len(tokens) - after])
            done = start + b
        if done < len(text):
            parts.append(np.array(self.straight(text[done:]), dtype="<u4"))
        return np.concatenate(parts)

    def decode(self, tokens: np.ndarray) -> str:
        """The text of tokens, special ones included; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[t] for t in tokens.tolist()]).decode("utf-8", errors="replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, made once per worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _dealt(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` dealt by the least chunk hash; lots that are too large are split, small ones joined, by AQE."""
    @F.pandas_udf(LongType())
    def key(texts):
        return texts.map(chunk_key)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("_key", key("text")).hint("rebalance", "_key").select("doc_id", "text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every row; ``ids`` are the tokens as little-endian 32-bit integers in one binary value.

    A null text is an empty one and has no tokens. Repeated rows and null ids are rows like any other; no rows give no
    rows; further columns are ignored. Strings of special tokens in a text become these tokens, as the library does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t.as_py()).tobytes() for t in batch.column(1)], type=pa.binary())], names=["doc_id", "ids"])

    return _dealt(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null ids are no tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.frombuffer(t.as_py() or b"", dtype="<u4")) for t in batch.column(1)], type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and decoded again in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1):
                tokens = own.encode(text.as_py())
                n.append(len(tokens))
                ids.append(hashlib.sha256(tokens.tobytes()).hexdigest())
                back.append(hashlib.sha256(own.decode(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(back, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _dealt(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` without its text but with ``tokens``, the number of tokens of each; counted where the row lies."""
    others = [c for c in docs.columns if c not in ("text", "tokens")]
    place = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n = pa.array([len(own.encode(t.as_py() or "")) for t in batch.column(place)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], n], names=[*others, "tokens"])

    rows = docs.select(*others, "text")
    return rows.mapInArrow(run, rows.drop("text").withColumn("tokens", F.lit(0).cast("long")).schema)
