"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles. Two
fingerprints within `radius` bits agree, in at least one of the partitions of
the bits, up to that partition's own threshold, whenever the thresholds sum to
radius - partitions + 1. Bits that vary together are put into one partition
(co-occurrence counts over all fingerprints), and a dynamic program gives each
partition its threshold, -1 (not probed at all) included, from the number of
candidates that the exact value histograms predict.

A cell (partition value) with more than `CELL` fingerprints is split again by
the bits outside its partition: those hold at most `radius` differences, so of
radius + 1 further parts one agrees. Within a cell all pairs are verified in
blocks and only a star per linked group leaves the task, never the pairs.

What reaches the driver: 64 x 64 co-occurrence counts and one counter per
partition value (65,536 per partition).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import bounded_batches, materialise, text_of
from rowloom.llm.components import components

BITS, PARTS, WIDTH = 64, 4, 16
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a cell beyond which it is split; and the cost of moving a probe, in verified pairs.
CELL, PROBE_COST = 1024, 500
BLOCK = 1 << 16


def fingerprint(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text; A-Z are lower-cased, words end at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    count, n = np.zeros(BITS, np.int64), max(1, len(w) - words + 1)
    for low in range(0, n, BLOCK):
        part = w[low : min(len(w), low + BLOCK + words - 1)]
        shingles = [b" ".join(part)] if len(w) <= words else map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False))
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype=">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `fp`, the fingerprint as a signed bigint, of every row; a null text counts as empty."""
    narrow = bounded_batches(docs).select(key, text_of(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column("__text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "fp": pa.array(made.view(np.int64))})

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, fp bigint")


def group_bits(together: np.ndarray, ones: np.ndarray, n: int) -> list[list[int]]:
    """Partitions of the bits; each starts at the most correlated free bit and takes the bits most correlated with it."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, parts = [*range(BITS)], []
    for _ in range(PARTS):
        own = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < WIDTH:
            own.append(max(free, key=lambda b: (tie[b, own].sum(), -b)))
            free.remove(own[-1])
        parts.append(sorted(own))
    return parts


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of every fingerprint as one number."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def masks(width: int, radius: int) -> list[int]:
    """Bit patterns of up to `radius` of `width` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def near_counts(histogram: np.ndarray, threshold: int) -> np.ndarray:
    """Per value, the fingerprints within `threshold` bits of it."""
    at = np.arange(len(histogram))
    return sum((histogram[at ^ m] for m in masks(WIDTH, threshold)), np.zeros_like(histogram)) if threshold >= 0 else np.zeros_like(histogram)


def allocate(histograms: list[np.ndarray], radius: int) -> list[int]:
    """Thresholds, -1 or more, that sum to radius - partitions + 1 at the least estimated cost."""
    budget = radius + 1  # of thresholds + 1
    best: list[tuple[float, list[int]] | None] = [(0.0, []), *[None] * budget]
    for h in histograms:
        n = float(h.sum())
        cost = [0.0, *(float(h @ near_counts(h, t)) + PROBE_COST * n * len(masks(WIDTH, t)) for t in range(radius + 1))]
        nxt: list[tuple[float, list[int]] | None] = [None] * (budget + 1)
        for spent, state in enumerate(best):
            for extra in range(budget - spent + 1) if state is not None else ():
                total = state[0] + cost[extra]
                if nxt[spent + extra] is None or total < nxt[spent + extra][0]:
                    nxt[spent + extra] = (total, state[1] + [extra - 1])
        best = nxt
    return best[budget][1]


def statistics(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Co-occurrence of the bits, ones of each bit and number of fingerprints, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            bits = np.stack([(fp >> np.uint64(b)) & np.uint64(1) for b in range(BITS)], axis=1).astype(np.float64)
            total, n = total + bits.T @ bits, n + len(fp)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_pydict({"i": pa.array([*i, -1], pa.int32()), "j": pa.array([*j, -1], pa.int32()), "n": pa.array([*total[i, j].astype(np.int64), n], pa.int64())})

    together, n = np.zeros((BITS, BITS)), 0
    for r in nodes.select("fp").mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            together[r["i"], r["j"]] = together[r["j"], r["i"]] = r["n"]
    return together, np.diag(together).copy(), n


def value_histograms(nodes: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    """Fingerprints per value of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(parts) << WIDTH, np.int64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, bits in enumerate(parts):
                counts += np.bincount((k << WIDTH) | gather(fp, bits), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"v": pa.array(at), "n": pa.array(counts[at])})

    out = np.zeros(len(parts) << WIDTH, np.int64)
    found = nodes.select("fp").mapInArrow(run, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n")).toPandas()
    out[found["v"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return [*out.reshape(len(parts), 1 << WIDTH)]


def cells(nodes: DataFrame, parts: list[list[int]], thresholds: list[int], histograms: list[np.ndarray], radius: int) -> DataFrame:
    """(cell, fp): every fingerprint at the cells where it is indexed or probed."""
    large = [near_counts(h, t) > CELL for h, t in zip(histograms, thresholds, strict=True)]
    rest = [[b for other in parts if other is not p for b in other] for p in parts]
    finer = [[r[k :: radius + 1] for k in range(radius + 1)] for r in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cell, owner = [], []
            for k, (bits, t) in enumerate(zip(parts, thresholds, strict=True)):
                value = gather(fp, bits)
                for m in masks(WIDTH, t) if t >= 0 else ():
                    v, base = value ^ m, (k << WIDTH)
                    split = large[k][v]
                    whole = np.flatnonzero(~split)
                    cell.append((base | v[whole]) << 28)
                    owner.append(whole)
                    again = np.flatnonzero(split)
                    for s, sub in enumerate(finer[k]) if len(again) else ():
                        cell.append((base | v[again]) << 28 | (s + 1) << 24 | gather(fp[again], sub))
                        owner.append(again)
            at = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.concatenate(cell) if cell else np.zeros(0, np.int64)), "fp": pa.array(fp[at].view(np.int64))})

    return nodes.select("fp").mapInArrow(run, "cell bigint, fp bigint")


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Labels 0..n-1 -> the smallest index that the pairs (a, b) link each to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def linked(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the groups that verified links form inside each cell; rows are sorted by cell."""
    n = len(cell)
    ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True]) + 1 if n else np.zeros(0, np.int64)
    begins = np.r_[0, ends[:-1]] if n else ends
    left, right = [], []
    big = (ends - begins) > 64
    small = np.repeat(~big, ends - begins)
    stop = np.repeat(ends, ends - begins)
    rows = np.flatnonzero(small)
    for shift in range(1, 64):
        rows = rows[rows + shift < stop[rows]]
        if not len(rows):
            break
        hit = rows[np.bitwise_count(fp[rows] ^ fp[rows + shift]) <= radius]
        left.append(hit)
        right.append(hit + shift)
    label = stars(np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64), n)
    for low, high in zip(begins[big].tolist(), ends[big].tolist(), strict=True):
        own = np.arange(high - low)
        for row in range(0, high - low, 256):  # all pairs, 256 rows of them at a time
            i, j = np.nonzero(np.bitwise_count(fp[low + row : low + row + 256 if low + row + 256 < high else high, None] ^ fp[None, low + row : high]) <= radius)
            apart = own[i + row] != own[j + row]
            if apart.any():
                own = stars(own[i[apart] + row], own[j[apart] + row], len(own))[own]
        label[low:high] = own + low
    at = np.flatnonzero(label != np.arange(n))
    return fp[at], fp[label[at]]


def links(nodes: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp` that connect just what links of `radius` bits connect."""
    together, ones, n = statistics(nodes)
    parts = group_bits(together, ones, n)
    histograms = value_histograms(nodes, parts)
    thresholds = allocate(histograms, radius)
    dealt = cells(nodes, parts, thresholds, histograms, radius).repartition(F.col("cell")).sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = linked(cell, fp, radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            cell = np.concatenate([held_cell, batch.column("cell").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            if cut:
                yield emit(cell[:cut], fp[:cut])
            held_cell, held_fp = cell[cut:], fp[cut:]
        yield emit(held_cell, held_fp)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """`key`, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest key that links of at most `radius` differing
    bits reach. Empty and null texts have fingerprint zero and link like any
    other. Equal fingerprints are one node. A null key never names a component:
    if a component has no other key, its component_id is null. An empty table
    gives an empty result; other columns are not read.
    """
    made = materialise(fingerprints(docs, key=key, text=text), "fingerprints")
    nodes = materialise(made.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    roots = materialise(components(links(nodes, radius=radius)), "roots").select(F.col("node").alias("fp"), "root")
    members = materialise(nodes.join(roots, "fp"), "members")
    smallest = materialise(members.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = materialise(members.join(smallest, "root").select("fp", "component_id"), "named")
    every = materialise(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "components")
    joined = made.join(every, "fp", "left")
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
