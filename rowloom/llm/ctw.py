"""Context-tree weighting over bytes, trained on a corpus and scored on all its documents.

A byte is eight binary decisions; each of the 255 decision nodes of a byte has
a context tree over the `DEPTH` bytes in front of it. Every tree node holds a
Krichevsky-Trofimov estimate, and the weighted probability of a node is half
its own block probability and half the product of its children's. A document's
code length mixes the estimates of all depths along its contexts with the
weights that the training counts give; a context never seen predicts one half.

Nothing of the model is broadcast whole, because it grows with the corpus:

* training documents -> blocks of distinct grams (context, byte) and words with
  their counts, one block per input part and bucket. A bucket holds whole
  subtrees: those below the nearest two context bytes, or, where two (three,
  four) bytes make up more than `Limits.share` of all text, those below one
  byte more. Which do is told by a sample of documents; that settles where a
  subtree is computed, not what comes out;
* blocks are added up in two steps, those of neighbouring input parts first, so
  no task meets the blocks of all parts; the nodes above all subtrees, the crown,
  go to the driver as sums, 255 for each of at most 3 / `Limits.share` + 257
  contexts whatever the corpus;
* documents are dealt into chunks of about `Limits.chunk` bytes; a chunk asks
  each bucket for its distinct grams and words as one block, and gets back one
  block of log-probabilities and counts in the same order. There are at most
  `Limits.buckets` buckets, so what a chunk sends is bounded; beyond eight times
  as many chunks, a bucket is answered in several tasks, each for a range of
  chunks.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import bounded_batches, materialise, text_of

DEPTH = 5
END = 0xFF  # no byte of UTF-8; closes every text
DOC_BITS = 16


@dataclass(frozen=True)
class Limits:
    """Sizes of what a task holds; none of them changes a result."""

    chunk: int = 10 << 20  # bytes of documents that are scored together
    part: int = 2 << 20  # characters that are taken apart and sorted at a time
    words: int = 500_000  # distinct words and grams that a training task holds before it hands them over
    grams: int = 2_500_000
    buckets: int = 4096  # at most
    share: float = 1 / 1024  # of all text; contexts beyond it are split by a byte more
    sample: int = 32 << 20  # bytes of the documents that tell which contexts those are
    merged: int = 64  # input parts, two at least, whose blocks are added up first

U = np.uint64
PAD, CLOSE = bytes(DEPTH), bytes([END])


def tokens_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of every byte of every text and its end, and how many each text has; a gram is the nearest context byte first, the byte last."""
    run = np.frombuffer(b"".join(PAD + t + CLOSE for t in texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n = len(run) - DEPTH
    gram = np.zeros(n, U)
    for back in range(1, DEPTH + 1):  # whole slices of the run, text borders included
        gram <<= U(8)
        gram |= run[DEPTH - back : DEPTH - back + n]
    gram <<= U(8)
    gram |= run[DEPTH:]
    inside = np.ones(n, bool)  # a gram that ends in the padding of a later text is none
    later = np.cumsum(size + DEPTH)[:-1] - DEPTH
    for k in range(DEPTH):
        inside[later + k] = False
    return gram[inside], size


#: Split contexts by length (2, 3, 4), sorted; a context is in only if the shorter ones that it begins with are.
Splits = dict[int, np.ndarray]


def prefix(context: np.ndarray, depth: int) -> np.ndarray:
    """The nearest `depth` bytes of contexts."""
    return context >> U(8 * (DEPTH - depth))


def split_at(context: np.ndarray, depth: int, splits: Splits) -> np.ndarray:
    """Whether the node at a depth lies in the crown."""
    if depth < 2:
        return np.ones(len(context), bool)
    own = splits.get(depth)
    if own is None or not len(own):
        return np.zeros(len(context), bool)
    p = prefix(context, depth)
    return own[np.minimum(np.searchsorted(own, p), len(own) - 1)] == p


def bucket_of(gram: np.ndarray, buckets: int, splits: Splits) -> np.ndarray:
    """By the nearest two context bytes, or as many more as are split."""
    context = gram >> U(8)
    key = prefix(context, 2)
    for depth in (2, 3, 4):
        more = split_at(context, depth, splits)
        if more.any():
            key[more] = prefix(context[more], depth + 1) | U((depth - 1) << 48)
    h = (key + U(1)) * U(0x9E3779B97F4A7C15)
    return ((h ^ (h >> U(32))) % U(buckets)).astype(np.int64)


def word_bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def parts_of(texts: list[str], most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of texts, in parts of about `most` characters, with the number of the first text."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i - low + 1 >= 1 << DOC_BITS:
            yield low, [tokens_of(t) for t in texts[low : i + 1]]
            low, size = i + 1, 0
    if low < len(texts):
        yield low, [tokens_of(t) for t in texts[low:]]


def joined(words: list[list[bytes]]) -> list[bytes]:
    return [b" ".join(w) for w in words]


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 0.5: Stirling's series after moving the argument past 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    while (small := x < 8).any():
        shift[small] -= np.log(x[small])
        x[small] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def decisions(gram: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree nodes at a depth, (context << 8 | decision node), with zeros and ones; from grams with counts."""
    context, byte = gram >> U(8), gram & U(0xFF)
    context = context >> U(8 * (DEPTH - depth))
    keys, counts = [], []
    for level in range(8):
        node = U(1 << level) | (byte >> U(8 - level))
        bit = (byte >> U(7 - level)) & U(1)
        keys.append((context << U(9)) | (node << U(1)) | bit)
        counts.append(count)
    key, n = add_up(keys, counts)
    node, where = np.unique(key >> U(1), return_inverse=True)
    bit = (key & U(1)).astype(bool)
    return node, np.bincount(where[~bit], weights=n[~bit], minlength=len(node)), np.bincount(where[bit], weights=n[bit], minlength=len(node))


class Tree:
    """The subtrees of one bucket, all below the crown: per node the share its own estimate has, and that estimate of a one."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, splits: Splits):
        self.splits, self.node, self.share, self.one = splits, {}, {}, {}
        self.tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by depth of the crown's nodes: what their children here come to
        below: tuple[np.ndarray, np.ndarray] | None = None
        for depth in range(DEPTH, 1, -1):
            own_part = ~split_at(gram >> U(8), depth, splits)
            node, n0, n1 = decisions(gram[own_part], count[own_part], depth)
            own = log_kt(n0, n1)
            weighted, share = own, np.ones(len(node))
            if below is not None:
                parent, of = self._parents(below[0])
                inner = ~self._in_crown(parent, depth)
                here = np.zeros(len(node))
                np.add.at(here, np.searchsorted(node, parent[inner]), of_sum(of, below[1], len(parent))[inner])
                weighted = np.logaddexp(own, here) - math.log(2)
                share = np.exp(own - math.log(2) - weighted)
                self._top(depth, parent, of_sum(of, below[1], len(parent)), ~inner)
            self.node[depth], self.share[depth], self.one[depth] = node, share, (n1 + 0.5) / (n0 + n1 + 1)
            below = (node, weighted)
        parent, of = self._parents(below[0])
        self._top(1, parent, of_sum(of, below[1], len(parent)), np.ones(len(parent), bool))

    @staticmethod
    def _parents(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes without their farthest context byte, and which each node goes to."""
        return np.unique(((node >> U(16)) << U(8)) | (node & U(0xFF)), return_inverse=True)

    def _in_crown(self, node: np.ndarray, depth: int) -> np.ndarray:
        return split_at((node >> U(8)) << U(8 * (DEPTH - depth)), depth, self.splits)

    def _top(self, depth: int, node: np.ndarray, sums: np.ndarray, which: np.ndarray) -> None:
        self.tops[depth] = node[which], sums[which]

    def mixed(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one at a decision, from the crown's edge on; one half where nothing was seen."""
        p = np.full(len(node), 0.5)
        for depth in range(DEPTH, 1, -1):
            key = (prefix(context, depth) << U(8)) | node
            if not len(self.node[depth]):
                continue  # whatever was there, a shallower node decides or none does
            at = np.minimum(np.searchsorted(self.node[depth], key), len(self.node[depth]) - 1)
            found = self.node[depth][at] == key
            share = self.share[depth][at]
            own = np.where(found, share * self.one[depth][at] + (1 - share) * p, 0.5)
            p = np.where(split_at(context, depth, self.splits), p, own)
        return p


def of_sum(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n)


class Crown:
    """Depths 0 and 1 and the split contexts, from the sums over all buckets: rows of (depth, node, n0, n1, children)."""

    def __init__(self, depth: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray, splits: Splits):
        self.splits, self.levels = splits, {}
        above: tuple[np.ndarray, np.ndarray] | None = None  # weighted crown nodes of the depth below
        for d in (4, 3, 2, 1):
            at = np.flatnonzero(depth == d)
            at = at[np.argsort(node[at])]
            own, inner = log_kt(n0[at], n1[at]), children[at].copy()
            if above is not None and len(above[0]):
                parent, of = Tree._parents(above[0])
                inner[np.searchsorted(node[at], parent)] += of_sum(of, above[1], len(parent))
            weighted = np.logaddexp(own, inner) - math.log(2)
            self.levels[d] = node[at], np.exp(own - math.log(2) - weighted), (n1[at] + 0.5) / (n0[at] + n1[at] + 1)
            above = node[at], weighted
        one = depth == 1
        root, where = np.unique(node[one] & U(0xFF), return_inverse=True)
        r0, r1 = of_sum(where, n0[one], len(root)), of_sum(where, n1[one], len(root))
        inner = of_sum(np.searchsorted(root, above[0] & U(0xFF)), above[1], len(root))
        own = log_kt(r0, r1)
        self.levels[0] = root, np.exp(own - math.log(2) - (np.logaddexp(own, inner) - math.log(2))), (r1 + 0.5) / (r0 + r1 + 1)

    def mixed(self, context: np.ndarray, node: np.ndarray, below: np.ndarray) -> np.ndarray:
        p = below
        for depth in (4, 3, 2, 1, 0):
            keys, share, one = self.levels[depth]
            inside = split_at(context, depth, self.splits)
            if not len(keys):
                p = np.where(inside, 0.5, p)
                continue
            key = (prefix(context, depth) << U(8)) | node if depth else node
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p = np.where(inside, np.where(keys[at] == key, share[at] * one[at] + (1 - share[at]) * p, 0.5), p)
        return p


def log10_bytes(gram: np.ndarray, tree: Tree, crown: Crown) -> np.ndarray:
    """log10-probability of the last byte of every gram after the bytes in front of it."""
    context, byte = gram >> U(8), gram & U(0xFF)
    total = np.zeros(len(gram))
    for level in range(8):
        node = U(1 << level) | (byte >> U(8 - level))
        one = crown.mixed(context, node, tree.mixed(context, node))
        bit = ((byte >> U(7 - level)) & U(1)).astype(bool)
        total += np.log10(np.where(bit, one, 1 - one))
    return total


def pack_words(words: list[bytes]) -> bytes:
    return b"\n".join(words)  # no word holds white space


def unpack_words(blob: bytes) -> list[bytes]:
    return blob.split(b"\n") if blob else []


BLOCK = "bucket bigint, salt bigint, chunk bigint, words binary, word_counts binary, grams binary, gram_counts binary"
BLOCK_NAMES = [f.split()[0] for f in BLOCK.split(", ")]


def _blocks(words: Counter[bytes] | set[bytes], gram: np.ndarray, count: np.ndarray | None, buckets: int, splits: Splits, salt: int, chunk: int) -> Iterator[tuple]:
    """One block per bucket that has anything; grams are sorted."""
    of_word: dict[int, list[bytes]] = {}
    for w in words:
        of_word.setdefault(word_bucket(w, buckets), []).append(w)
    of_gram = bucket_of(gram, buckets, splits)
    order = np.argsort(of_gram, kind="stable")
    edges = np.searchsorted(of_gram[order], np.arange(buckets + 1))
    for b in range(buckets):
        at, own = order[edges[b] : edges[b + 1]], of_word.get(b, [])
        if len(at) or own:
            n = np.fromiter((words[w] for w in own), np.int64, len(own)).tobytes() if count is not None else b""
            yield b, salt, chunk, pack_words(own), n, gram[at].tobytes(), count[at].tobytes() if count is not None else b""


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    c = [*zip(*rows, strict=True)] or [()] * len(BLOCK_NAMES)
    return pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64() if i < 3 else pa.binary()) for i, (n, x) in enumerate(zip(BLOCK_NAMES, c, strict=True))})


def splits_of(texts: DataFrame, total: int, limits: Limits) -> Splits:
    """Contexts of two to four bytes with more than `limits.share` of the text, told by documents of about `limits.sample` bytes.

    At most 1 / share of each length go to the driver, and from every task at
    most twice as many.
    """
    parts = max(1, total // max(1, limits.sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for _, part in parts_of(batch.column("__text").to_pylist(), limits.part):
                k, n = np.unique(symbols(joined(part))[0] >> U(16), return_counts=True)  # four context bytes
                keys.append(k)
                counts.append(n)
                if len(keys) > 16:
                    keys, counts = ([x] for x in add_up(keys, counts))
        k, n = add_up(keys, counts)
        rows = {"depth": [0], "key": [0], "n": [int(n.sum())]}
        for depth in (2, 3, 4):
            p, of = np.unique(k >> U(8 * (4 - depth)), return_inverse=True)
            c = of_sum(of, n, len(p))
            large = c * 2 > limits.share * n.sum()
            rows["depth"] += [depth] * int(large.sum())
            rows["key"] += p[large].astype(np.int64).tolist()
            rows["n"] += c[large].astype(np.int64).tolist()
        yield pa.RecordBatch.from_pydict({"depth": pa.array(rows["depth"], pa.int32()), "key": pa.array(rows["key"], pa.int64()), "n": pa.array(rows["n"], pa.int64())})

    drawn = texts.filter(F.pmod(F.xxhash64(F.lit("layout"), "__text"), F.lit(parts)) == 0)
    found = drawn.select("__text").mapInArrow(run, "depth int, key bigint, n bigint").groupBy("depth", "key").agg(F.sum("n").alias("n")).collect()
    seen = sum(r["n"] for r in found if r["depth"] == 0)
    splits: Splits = {}
    for depth in (2, 3, 4):
        own = np.array(sorted(r["key"] for r in found if r["depth"] == depth and r["n"] > limits.share * seen), dtype=np.int64).view(U)
        if depth > 2 and len(own):
            shorter = splits[depth - 1]
            own = own[np.isin(own >> U(8), shorter)]
        splits[depth] = own
    return splits


def train_blocks(texts: DataFrame, buckets: int, splits: Splits, limits: Limits) -> DataFrame:
    """Counts of grams and words of every input part, by bucket; a part keeps its distinct ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, counts, salt = [], [], TaskContext.get().partitionId() // limits.merged
        for batch in batches:
            for _, part in parts_of(batch.column("__text").to_pylist(), limits.part):
                for w in part:
                    words.update(w)
                k, n = np.unique(symbols(joined(part))[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > limits.grams:
                    k, n = add_up(keys, counts)
                    keys, counts = [k], [n]
                if len(words) > limits.words or sum(map(len, keys)) > limits.grams:  # bounded memory: hand over and go on
                    yield _frame([*_blocks(words, *add_up(keys, counts), buckets, splits, salt, 0)])
                    words, keys, counts = Counter(), [], []
        yield _frame([*_blocks(words, *add_up(keys, counts), buckets, splits, salt, 0)])

    return texts.select("__text").mapInArrow(run, BLOCK)


MODEL = "bucket bigint, salt bigint, words binary, word_counts binary, grams binary, gram_counts binary, n_words bigint, n_tokens bigint"


def merge_blocks(blocks: DataFrame, parts: int, limits: Limits) -> DataFrame:
    """One row per bucket: its words and grams with their counts over all blocks."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        words: Counter[bytes] = Counter()
        for blob, n in zip(pdf["words"], pdf["word_counts"], strict=True):
            for w, c in zip(unpack_words(blob), np.frombuffer(n, np.int64).tolist(), strict=True):
                words[w] += c
        gram, count = add_up([np.frombuffer(g, U) for g in pdf["grams"]], [np.frombuffer(c, np.int64) for c in pdf["gram_counts"]])
        own = sorted(words)
        counts = np.fromiter((words[w] for w in own), np.int64, len(own))
        return pd.DataFrame([{"bucket": int(pdf["bucket"].iloc[0]), "salt": int(pdf["salt"].iloc[0]) // limits.merged, "words": pack_words(own), "word_counts": counts.tobytes(), "grams": gram.tobytes(), "gram_counts": count.tobytes(), "n_words": len(own), "n_tokens": int(counts.sum())}])

    made, groups = blocks, -(-parts // limits.merged)
    while True:
        made = made.groupBy("bucket", "salt").applyInPandas(merge, MODEL)
        if groups <= 1:
            return made.drop("salt")
        groups = -(-groups // limits.merged)


def crown_of(model: DataFrame, splits: Splits) -> Crown:
    """Sums of the crown's nodes over all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c in zip(batch.column("grams").to_pylist(), batch.column("gram_counts").to_pylist(), strict=True):
                gram, count = np.frombuffer(g, U), np.frombuffer(c, np.int64)
                tops = Tree(gram, count, splits).tops
                for depth in (1, 2, 3, 4):
                    inside = split_at(gram >> U(8), depth, splits)
                    node, n0, n1 = decisions(gram[inside], count[inside], depth)
                    children = np.zeros(len(node))
                    children[np.searchsorted(node, tops[depth][0])] = tops[depth][1]
                    yield pa.RecordBatch.from_pydict({"depth": pa.array([depth] * len(node), pa.int32()), "node": pa.array(node.view(np.int64))} | {n: pa.array(v, pa.float64()) for n, v in (("n0", n0), ("n1", n1), ("children", children))})

    sums = model.select("grams", "gram_counts").mapInArrow(run, "depth int, node bigint, n0 double, n1 double, children double")
    rows = sums.groupBy("depth", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("children").alias("children")).toPandas()
    return Crown(rows["depth"].to_numpy(np.int64), rows["node"].to_numpy(np.int64).view(U), *(rows[c].to_numpy(np.float64) for c in ("n0", "n1", "children")), splits)


ASKED = ["bucket", "range", "chunk", "words", "grams"]


def _requests(pdf: pd.DataFrame, buckets: int, splits: Splits, per_range: int, limits: Limits) -> pd.DataFrame:
    """What a chunk asks of every bucket: its distinct words and grams."""
    words: set[bytes] = set()
    keys: list[np.ndarray] = []
    for _, part in parts_of(list(pdf["__text"]), limits.part):
        for w in part:
            words.update(w)
        keys.append(np.unique(symbols(joined(part))[0]))
    gram = np.unique(np.concatenate(keys)) if keys else np.zeros(0, U)
    chunk = int(pdf["chunk"].iloc[0])
    rows = [*_blocks(words, gram, None, buckets, splits, 0, chunk)]
    return pd.DataFrame([(b, chunk // per_range, c, w, g) for b, _, c, w, _, g, _ in rows], columns=ASKED)


def _answers(asked: pd.DataFrame, model: pd.DataFrame, crown: Crown) -> pd.DataFrame:
    """A bucket's answers: word counts and log-probabilities of every chunk's block, in its order."""
    known = len(model) > 0
    counts = dict(zip(unpack_words(model["words"].iloc[0]), np.frombuffer(model["word_counts"].iloc[0], np.int64).tolist(), strict=True)) if known else {}
    tree = Tree(*((np.frombuffer(model["grams"].iloc[0], U), np.frombuffer(model["gram_counts"].iloc[0], np.int64)) if known else (np.zeros(0, U), np.zeros(0, np.int64))), crown.splits)
    grams = [np.frombuffer(g, U) for g in asked["grams"]]
    every = np.unique(np.concatenate(grams)) if grams else np.zeros(0, U)
    score = np.concatenate([log10_bytes(every[i : i + 500_000], tree, crown) for i in range(0, len(every), 500_000)] or [np.zeros(0)])
    rows = []
    for chunk, words, gram in zip(asked["chunk"], asked["words"], grams, strict=True):
        own = unpack_words(words)
        rows.append((chunk, words, np.fromiter((counts.get(w, 0) for w in own), np.int64, len(own)).tobytes(), gram.tobytes(), score[np.searchsorted(every, gram)].astype(np.float32).tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "words", "word_counts", "grams", "scores"])


def _scores(docs: pd.DataFrame, answers: pd.DataFrame, train_tokens: int, distinct: int, carry: list[str], limits: Limits) -> pd.DataFrame:
    """Sums of a chunk's documents from the answers of all buckets."""
    place: dict[bytes, int] = {}
    for blob in answers["words"]:
        own = unpack_words(blob)
        place.update(zip(own, range(len(place), len(place) + len(own)), strict=True))
    count = np.concatenate([np.frombuffer(c, np.int64) for c in answers["word_counts"]] or [np.zeros(0, np.int64)])
    base = np.log10((count + 1) / (train_tokens + distinct + 1))
    gram = np.concatenate([np.frombuffer(g, U) for g in answers["grams"]])
    score = np.concatenate([np.frombuffer(s, np.float32) for s in answers["scores"]])
    order = np.argsort(gram)
    gram, score = gram[order], score[order]
    out = docs[carry].reset_index(drop=True)
    n_words, known, base_words, total, length = (np.zeros(len(out), kind) for kind in (np.int64, np.int64, np.float64, np.float64, np.int64))
    for low, part in parts_of(list(docs["__text"]), limits.part):
        for i, w in enumerate(part, low):
            at = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
            n_words[i], known[i], base_words[i] = len(at), (count[at] > 0).sum(), base[at].sum()
        g, size = symbols(joined(part))
        g <<= U(DOC_BITS)
        g |= np.repeat(np.arange(len(part), dtype=U), size)
        g.sort()  # equal grams side by side: one look-up each
        both = g
        g, owner = both >> U(DOC_BITS), (both & U((1 << DOC_BITS) - 1)).astype(np.int64)
        first = np.r_[True, g[1:] != g[:-1]]
        own = score[np.searchsorted(gram, g[first])]
        total[low : low + len(part)] = np.bincount(owner, weights=own[np.cumsum(first) - 1], minlength=len(part))
        length[low : low + len(part)] = size
    out["n_words"], out["n_known_words"], out["base_words"], out["n_symbols"], out["score"] = n_words, known, base_words, length, total
    return out


def score(docs: DataFrame, in_training: str, *, carry: tuple[str, ...] = ("doc_id",), text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """`carry`, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row.

    Rows whose column `in_training` is true train the word counts and the
    trees. Tokens are the words and one end; the model scores the words, with
    one space between two, and an end byte. A null or empty text is its end
    alone. Without training rows every bit costs one bit. Repeated rows stay and
    are dealt out by the part of the input that they come from; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    carried = [*dict.fromkeys([*carry, in_training])]
    texts = bounded_batches(docs).select(*carried, text_of(text).alias("__text"))
    measured = texts.select(F.octet_length("__text").alias("bytes"), F.col(in_training).alias("training"), F.spark_partition_id().alias("part"))
    size = measured.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("training"), 1)), F.lit(0)), F.coalesce(F.max("part") + 1, F.lit(1))).first()
    chunks = max(1, math.ceil(size[0] / limits.chunk))
    buckets = min(limits.buckets, max(8, chunks))
    per_range = 8 * buckets
    ranges = -(-chunks // per_range)
    splits = splits_of(texts, int(size[0]), limits)
    model = materialise(merge_blocks(train_blocks(texts.filter(F.col(in_training)), buckets, splits, limits), int(size[3]), limits), "ctw")
    totals = model.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    ends = int(size[2])
    train_tokens, distinct = int(totals[0]) + ends, int(totals[1]) + (ends > 0)
    crown = spark.sparkContext.broadcast(crown_of(model, splits))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), F.spark_partition_id(), *[F.col(c) for c in carried], F.xxhash64("__text")), F.lit(chunks)))
    asked = dealt.groupBy("chunk").applyInPandas(lambda pdf: _requests(pdf, buckets, splits, per_range, limits), "bucket bigint, range bigint, chunk bigint, words binary, grams binary")
    kept = model.select("bucket", "words", "word_counts", "grams", "gram_counts").withColumn("range", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ranges - 1).cast("bigint"))))
    answers = asked.groupBy("bucket", "range").cogroup(kept.groupBy("bucket", "range")).applyInPandas(
        lambda a, m: _answers(a, m, crown.value), "chunk bigint, words binary, word_counts binary, grams binary, scores binary"
    )
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in carried) + ", n_words bigint, n_known_words bigint, base_words double, n_symbols bigint, score double"
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda d, a: _scores(d, a, train_tokens, distinct, carried, limits), fields)
    end = math.log10((ends + 1) / (train_tokens + distinct + 1))
    return scored.select(
        *carried,
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known_words") + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_words") + F.lit(end)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_symbols")).alias("bits_per_byte"),
    )
