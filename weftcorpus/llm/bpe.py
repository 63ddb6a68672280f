"""Byte-level BPE encoding and decoding by a prefix-sharing trie.

The last token of a prefix's encoding is a state that its extensions can use: a
token that ends a longer prefix is the right one if and only if it may follow
the last token of what stands before it. So the distinct words of a block are
put into a trie and one depth-first walk gives each node its last token; what
words share at their beginning is computed once. Sorted order is the depth-first
order of a trie, so the trie is kept as the sorted words and a stack of states.

Edge cases: null and empty texts have no token; the text of an added token is
that token, wherever it stands; a repeated row is encoded again; very long texts are
encoded whole, by words; an empty table gives an empty result; other columns aren't
read, but with_ids() passes them through.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from weftcorpus.llm.common import small_batches, table, text_bytes, trim, worker_cache

SCHEMA = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Letters, numbers and spaces below U+0250, where all Unicode versions agree.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: The splitting pattern of the byte-level pre-tokenizer for such texts.
_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_OTHER = "[^\x00-ɏ‐-‧]"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    ones for themselves, the rest from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE model read from a tokenizer's JSON text."""

    def __init__(self, spec: str, known_words: int = 200_000, known_follows: int = 400_000):
        data, to_byte = json.loads(spec), byte_alphabet()
        self.spec, self.known_words, self.known_follows = spec, known_words, known_follows
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.vocab = {raw(k): v for k, v in data["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in data["added_tokens"]):
            raise ValueError("added tokens that strip, stand alone or are normalised aren't supported")
        self.bytes = [b""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for b, i in self.vocab.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.sizes = [len(b) for b in self.bytes]
        self.longest = max(map(len, self.vocab))
        self.split, self.other = re.compile(_SPLIT), re.compile(_OTHER)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.follows: dict[int, bool] = {}  # by before * 2^32 + token
        self.words: dict[str, bytes] = {}
        self.full = None

    def merged(self, word: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; only short strings come here."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the encoding of both strings together is just these two tokens; before -1: whether the token encodes to itself."""
        a, b = (self.bytes[before] if before >= 0 else b""), self.bytes[token]
        return self.merged(a + b) == ([a, b] if a else [b])

    def walk(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of sorted words, depth first through their trie."""
        vocab, follows, longest, sizes = self.vocab, self.follows, self.longest, self.sizes
        stack, before, out = [-1], b"", []
        for word in words:
            depth, n = 0, len(word)
            for depth in range(min(n, len(before)) + 1):
                if word[depth : depth + 1] != before[depth : depth + 1] or depth == n:
                    break
            del stack[depth + 1 :]
            for end in range(depth + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    if (token := vocab.get(word[start:end])) is None:
                        continue
                    key = (stack[start] << 32) + token
                    if (ok := follows.get(key)) is None:
                        ok = follows[key] = self.may_follow(stack[start], token)
                    if ok:
                        stack.append(token)
                        break
                else:
                    raise ValueError(f"the vocabulary lacks a byte of {word!r}")
            ids, at = [], n
            while at:
                ids.append(stack[at])
                at -= sizes[stack[at]]
            out.append(np.array(ids[::-1], "<u4").tobytes())
            before = word
        if len(follows) > self.known_follows:
            follows.clear()
        return out

    def pieces(self, text: str) -> list[str]:
        """Words as the pre-tokenizer splits them. The pattern above is exact for
        Latin texts; others go to the library's own splitter, whose Unicode version counts."""
        if not self.other.search(text):
            return self.split.findall(text)
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_str(self.spec).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.full.pre_tokenize_str(text)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            split.append([self.pieces(p) if k % 2 == 0 else p for k, p in enumerate(parts)])
        need = set(chain.from_iterable(p for parts in split for p in parts if isinstance(p, list)))
        if len(self.words) > self.known_words:
            # of the words known so far, those that this block has too
            self.words = {w: self.words[w] for w in need.intersection(self.words)}
        known = self.words
        order = sorted((w.encode(), w) for w in need.difference(known))
        known.update(zip((w for _, w in order), self.walk([b for b, _ in order])))
        return [b"".join(b"".join(map(known.__getitem__, p)) if isinstance(p, list) else np.uint32(self.added[p]).astype("<u4").tobytes() for p in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def blocks(column: pa.Array, most: int = 1 << 20):
    """Runs of texts of about `most` bytes; only a run's texts are Python strings at a time."""
    _, at = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield [t or "" for t in column.slice(i, j - i).to_pylist()]
        i = j


def codec_of(docs: DataFrame, path: str):
    """The tokenizer's JSON, read by the driver and sent to every worker once."""
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _codec(shared) -> Codec:
    spec = shared.value
    return worker_cache(("bpe", hash(spec)), lambda: Codec(spec))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of each whole text."""
    shared = codec_of(docs, path)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1)):
                ids = [np.frombuffer(x, "<i4") for x in codec.encode_batch(texts)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else [], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])
                at += len(texts)
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each list of ids (null: empty)."""
    shared = codec_of(encoded, path)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _coded(codec: Codec, texts: list[str], kept: bool) -> list[pa.Array]:
    """n_tokens, the digests of ids and decoded text, and the ids themselves where they are kept."""
    ids = codec.encode_batch(texts)
    out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids], pa.string())]
    if kept:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
    return out


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, without moving either."""
    shared = codec_of(docs, path)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *_coded(codec, texts, False)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """All columns of docs and n_tokens, ids_sha256, decoded_sha256 and ids of each whole text; columns of docs with one of these names go."""
    shared = codec_of(docs, path)
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}
    docs = docs.drop(*new)
    names = [*docs.columns, *new]
    at_text = docs.columns.index("text")

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(at_text)):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns), *_coded(codec, texts, True)], names)
                at += len(texts)
        trim()

    schema = S.StructType([*docs.schema.fields, *S.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields])
    return docs.mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
