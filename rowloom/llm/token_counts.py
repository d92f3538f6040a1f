"""Exact token counts of every prefix of a text, by dynamic programming over a BPE piece model.

A sequence of BPE tokens is the encoding of its text exactly when each adjacent
pair is the encoding of its own text. So the last token of a prefix is the one
token that ends there and is compatible with the last token of the prefix in
front of it, and count[i] = count[i - len(token)] + 1: one left-to-right pass
gives the counts of all prefixes, and "how many tokens are in the first k
characters" or "how much fits a budget" need no further encoding.

No piece holds anything but white-space marks in front of a white-space mark,
nor a line feed (both checked when the model loads), so a text falls into
chunks that never merge. The table of a chunk is computed once per worker and
distinct chunk; a text's counts are the running sum over its chunks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from rowloom.llm.common import Memo, bounded_batches, text_of

MARK = "▁"  # stands for a space in pieces
#: Of the counts of chunks; and of pairs of pieces, which are short.
MEMO_BYTES, MEMO_PAIRS = 64 << 20, 300_000


class PrefixCounter:
    """Token counts of texts and of all their prefixes, as `SentencePieceProcessor.encode` gives them."""

    def __init__(self, model_path: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = (
            spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
            and spec.trainer_spec.byte_fallback
            and not normal.precompiled_charsmap
            and normal.add_dummy_prefix
            and not normal.remove_extra_whitespaces
            and normal.escape_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)
        )
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        if not plain or any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("prefix counts need a BPE piece model with byte fallback, without normalisation, whose pieces stay within words")
        self.longest: dict[str, int] = {}  # by the last three characters of a piece
        for piece in self.score:
            if len(piece) > 2:
                self.longest[piece[-3:]] = max(self.longest.get(piece[-3:], 0), len(piece))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.starts: dict[str, bool] = {}
        self.totals = Memo(MEMO_BYTES)

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short string: the best-scoring adjacent pair merges first, the leftmost of equals."""
        parts, score = [*text], self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return known

    def _starts(self, piece: str) -> bool:
        known = self.starts.get(piece)
        if known is None:
            known = self.starts[piece] = self._merged(piece) == [piece]
        return known

    def table(self, chunk: str) -> list[int]:
        """Counts of the prefixes of one chunk (mark included), index 0 the empty one."""
        score, longest, fits = self.score, self.longest.get, self._fits
        counts, last = [0], [""]
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - longest(chunk[max(0, end - 3) : end], 2)), end - 1):
                piece = chunk[start:end]
                if piece in score and (fits(last[start], piece) if start else self._starts(piece)):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:  # a single character; one that is no piece becomes its bytes
                piece = chunk[end - 1]
                counts.append(counts[end - 1] + (1 if piece in score else len(piece.encode())))
                last.append(piece)
        return counts

    @staticmethod
    def chunks(text: str) -> Iterator[str]:
        """Chunks of a text, each without its first mark; a chunk after a line feed starts with it and has no mark."""
        for i, line in enumerate(text.replace(MARK, " ").split("\n")):  # the model reads both alike
            words = line.split(" ")
            if i:
                words[0] = "\n" + words[0]
            if "" in words:
                marks = ""
                for word in words[:-1]:
                    if word:
                        yield marks + word
                        marks = ""
                    else:
                        marks += MARK
                yield marks + words[-1]
            else:
                yield from words

    def _chunk(self, key: str) -> tuple[int, str]:
        """Tokens in front of the mark-or-word part, and that part."""
        return (1, key[1:]) if key[:1] == "\n" else (0, MARK + key)

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        return sum(self.totals.answers([*self.chunks(text)], self._counted))

    def _counted(self, key: str) -> int:
        before, chunk = self._chunk(key)
        return before + self.table(chunk)[-1]

    def fitting(self, text: str, budget: int) -> int:
        """The longest prefix, in code points, of at most `budget` tokens.

        Chunks' totals, which are remembered, tell the last chunk that begins
        within the budget; a prefix that ends in a later one has more tokens,
        so the table of that chunk alone settles the rest.
        """
        keys = [*self.chunks(text)] if text else []
        begins = [0, *accumulate(self.totals.answers(keys, self._counted))]
        last = bisect_left(begins, budget, 0, len(keys)) - 1
        if last < 0:
            return 0
        at = sum(len(k) + (k[:1] != "\n") for k in keys[:last]) - (last > 0)  # the first chunk's mark stands for nothing
        before, chunk = self._chunk(keys[last])
        counts = [1] * before + [before + c for c in self.table(chunk)[1 if last else 2 :]]
        return at + next((k + 1 for k in range(len(counts) - 1, -1, -1) if begins[last] + counts[k] <= budget), 0)

    def prefixes(self, text: str) -> list[int]:
        """counts[k]: tokens of the first k code points."""
        counts, base, first = [0], 0, True
        for key in self.chunks(text) if text else ():
            before, chunk = self._chunk(key)
            table = self.table(chunk)
            if before:
                counts.append(base + 1)
            counts += [base + before + c for c in table[2 if first else 1 :]]
            base, first = base + before + table[-1], False
        return counts


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PrefixCounter(model_path)
    return _COUNTERS[model_path]


def count_tokens(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", budgets: tuple[int, ...] = (), prefixes: bool = False) -> DataFrame:
    """`key`, `n_bytes`, `n_tokens` of every text.

    `budgets` adds `fits_<b>`: code points of the longest prefix of at most b
    tokens. `prefixes` adds `prefix_tokens`, an array with the count of every
    prefix. A null or empty text has no tokens and one prefix. Repeated rows
    stay; other columns are not read.
    """
    narrow = bounded_batches(docs).select(key, text_of(text).alias("__text"))
    fields = f"`{key}` {narrow.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    fields += "".join(f", fits_{b} bigint" for b in budgets) + ", prefix_tokens array<int>" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            out = {key: batch.column(key), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64())}
            totals = [c.total(t) for t in texts]
            out["n_tokens"] = pa.array(totals, pa.int64())
            for b in budgets:  # a text within the budget fits whole
                out[f"fits_{b}"] = pa.array([len(t) if n <= b else c.fitting(t, b) for t, n in zip(texts, totals, strict=True)], pa.int64())
            if prefixes:
                out["prefix_tokens"] = pa.array([c.prefixes(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return narrow.mapInArrow(run, fields)


def library(model_path: str) -> sentencepiece.SentencePieceProcessor:
    """The library itself, for tests."""
    return sentencepiece.SentencePieceProcessor(model_file=model_path)
