"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The library encodes; a memo keeps what its model said for each match of the
pre-tokenisation pattern, because byte-level BPE never merges across matches.
Only texts whose characters are all in `LETTERS`, `DIGITS`, ASCII and a few
signs go through the memo: there the pattern below finds just what the library
finds. Any other text, and any text with a special token's string, is given to
the library whole.

Decoding turns ids into bytes by the byte table; bytes join before they are
read as UTF-8, so characters that are split over tokens come out whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from rowloom.llm.common import Memo, bounded_batches, text_of

#: Latin letters and number signs, as the library's pattern classes them.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: Any other character than these leaves the memo.
SETTLED = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ſ–—‘’“”…€]")
#: public_tokenizers.PATTERN over those characters.
MATCHES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
#: Matches that a worker remembers, about 200 bytes each; the memo starts anew beyond that.
MEMO_BYTES = 96 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of `token` just before the merge that makes it."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """JSON of a tokenizers model with the vocabulary and the merge order of `ranks`."""
    alphabet = byte_alphabet()
    name = lambda token: "".join(alphabet[b] for b in token)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        parts = _parts(token, ranks)
        if len(parts) == 2:
            merges.append((name(parts[0]), name(parts[1])))
    made = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def byte_table(tokenizer_json: str) -> list[bytes]:
    """The bytes of every id; an added token stands for its own characters."""
    spec = json.loads(tokenizer_json)
    back = {c: b for b, c in byte_alphabet().items()}
    vocab = spec["model"]["vocab"]
    added = {t["id"]: t["content"] for t in spec.get("added_tokens") or []}
    table = [b""] * (max([*vocab.values(), *added, 0]) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    for i, content in added.items():
        table[i] = content.encode()
    return table


def little_endian(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def splits_as_public(spec: dict) -> bool:
    """Whether a tokenizer cuts texts by the public pattern and by nothing else."""
    pre, level = spec.get("pre_tokenizer") or {}, {}
    if pre.get("type") == "Sequence" and len(pre["pretokenizers"]) == 2:
        split, level = pre["pretokenizers"]
        cut = split.get("type") == "Split" and split.get("pattern") == {"Regex": public_tokenizers.PATTERN} and split.get("behavior") == "Isolated" and not level.get("use_regex")
    else:
        level = pre
        cut = level.get("use_regex", False)
    plain = level.get("type") == "ByteLevel" and not level.get("add_prefix_space")
    return bool(cut and plain and not spec.get("normalizer") and spec["model"].get("type") == "BPE")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        spec = json.loads(tokenizer_json)
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.alphabet = self.library.model, byte_alphabet()
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.remembers = splits_as_public(spec)
        self.memo = Memo(MEMO_BYTES)

    def whole(self, text: str) -> bytes:
        return little_endian(self.library.encode(text, add_special_tokens=False).ids)

    def _match(self, match: str) -> bytes:
        return little_endian([t.id for t in self.model.tokenize(match.encode().decode("latin-1").translate(self.alphabet))])

    def encode(self, text: str) -> bytes:
        if not self.remembers or SETTLED.search(text) or any(a in text for a in self.added):
            return self.whole(text)
        return b"".join(self.memo.answers(MATCHES.findall(text), self._match))


_ENCODERS: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One encoder per worker and vocabulary; a reused worker keeps its memo."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def spans_of(text: str, ids: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point of every token and the one after its last; a token that holds part of a character covers it. sizes: bytes of every id."""
    size = sizes[np.frombuffer(ids, "<u4")]
    if not len(size):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32) - 1  # the character of every byte
    last = np.cumsum(size)
    return char[last - size], char[last - 1] + 1


def decode_bytes(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _with_arrow(docs: DataFrame, keep: list[str], column: str, make, fields: str) -> DataFrame:
    """`docs[keep]` and what `make(texts)` gives for each Arrow batch of texts."""
    narrow = bounded_batches(docs).select(*keep, text_of(column).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__text"), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch.column("__text"))
            kept = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(kept | out)

    return narrow.mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer_json: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", offsets: bool = False) -> DataFrame:
    """`keep` and `ids` (binary, little-endian uint32) of every text.

    With `offsets`, also `char_start` and `char_end`: per token, the code
    points it covers; a token that holds part of a character covers that
    character. A null or empty text has no ids. Repeated rows stay.
    """

    def make(texts: pa.Array) -> dict:
        e = encoder(tokenizer_json)
        if not offsets:
            return {"ids": pa.array([e.encode(t) for t in texts.to_pylist()], pa.binary())}
        sizes, ids, starts, ends = np.array([*map(len, byte_table(tokenizer_json))], np.int64), [], [], []
        for t in texts.to_pylist():
            ids.append(e.encode(t))
            start, end = spans_of(t, ids[-1], sizes)
            starts.append(start)
            ends.append(end)
        return {"ids": pa.array(ids, pa.binary()), "char_start": pa.array(starts, pa.list_(pa.int32())), "char_end": pa.array(ends, pa.list_(pa.int32()))}

    fields = "ids binary" + ", char_start array<int>, char_end array<int>" * offsets
    return _with_arrow(docs, [*keep], text, make, fields)


def decode(encoded: DataFrame, tokenizer_json: str, *, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """`keep`, and `decoded` (binary) of every row's ids; null ids give no bytes."""
    narrow = bounded_batches(encoded).select(*keep, F.coalesce(ids, F.lit(b"")).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__ids"), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(tokenizer_json)
        for batch in batches:
            made = [decode_bytes(i, table) for i in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"decoded": pa.array(made, pa.binary())})

    return narrow.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every text and decode its ids in the same pass: per row the key, the token count, and digests of the ids, the decoded bytes and the tokens' offsets.

    offsets_sha256 is of all starts, then all ends, in code points as
    little-endian signed 32-bit integers. One Python pass, so neither ids nor bytes travel between operators.
    """
    tokenizer_json = tokenizer_from_ranks(read_ranks(ranks_path), pattern)

    def make(texts: pa.Array) -> dict:
        e, table = encoder(tokenizer_json), byte_table(tokenizer_json)
        sizes = np.array([*map(len, table)], np.int64)
        n, digests, decoded, offsets = [], [], [], []
        for t in texts.to_pylist():
            ids = e.encode(t)
            n.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(decode_bytes(ids, table)).hexdigest())
            offsets.append(hashlib.sha256(b"".join(x.astype("<i4").tobytes() for x in spans_of(t, ids, sizes))).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": digests, "decoded_sha256": decoded, "offsets_sha256": offsets}

    return _with_arrow(docs, [key], text, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
