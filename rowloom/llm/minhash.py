"""Near-copies: what SimHash links, and what an exact similarity of word shingles links, a Jaccard of 4/5 or more over five words.

SimHash (`simhash.py`) runs whole: fingerprints of every text, partitions of
their bits with a threshold each, verified links of 3 differing bits or fewer.
These weigh repeated shingles, so they reach copies that share few distinct
ones; a few edits already move more than 3 bits, so the second kind of link
is found beside them, and the components are those of all links together.

Candidates of the second kind come from MinHash: `BANDS` bands of `ROWS` minima each. Two sets of
similarity 0.8 share no band with a probability of (1 - 0.8^6)^40 = 5e-6, and
less above; at 0.3 one pair in 35 shares a band. Texts that share a band are one
cluster (linked to the band's smallest node, so a band of any size gives as many
rows as it has members). Inside a cluster every pair is compared exactly, on the
whole shingle sets. Large clusters are dealt out as pairs of blocks of about
`BLOCK` texts, so no task compares more than two blocks with each other; only a
star per linked group leaves the task.

A node is the 64-bit hash of a text, so equal texts are compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import simhash
from rowloom.llm.common import bounded_batches, materialise, text_of
from rowloom.llm.components import components
from rowloom.llm.simhash import SEED, stars

WORDS = 5
#: Least similarity of a link, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 6
BLOCK = 256
PART = 4096

_RANDOM = np.random.default_rng(SEED)
_ORDERS = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_MIX = _RANDOM.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, words as in simhash; a text of fewer words, or none, is one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    runs = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in runs], dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number per band, equal for two sets where all minima of the band are equal."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), PART):
        np.minimum(least, np.multiply.outer(_ORDERS, hashes[low : low + PART]).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right, i < j where both are on both sides) of similarity SIMILAR or more, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.r_[0, np.cumsum(sizes)]
    over = np.concatenate([ids[begins[j] : begins[j + 1]] for j in right]) if len(right) else np.zeros(0, np.int64)
    starts = np.r_[0, np.cumsum(sizes[right])[:-1]].astype(np.int64)
    has, out_a, out_b = np.zeros(len(values), bool), [], []
    for i in left:
        own = ids[begins[i] : begins[i + 1]]
        has[own] = True
        common = np.add.reduceat(has[over], starts, dtype=np.int64) if len(right) else np.zeros(0, np.int64)
        has[own] = False
        hit = right[(SIMILAR[1] * common >= SIMILAR[0] * (sizes[i] + sizes[right] - common)) & (right != i)]
        out_a.append(np.full(len(hit), i))
        out_b.append(hit)
    return np.concatenate([np.zeros(0, np.int64), *out_a]), np.concatenate([np.zeros(0, np.int64), *out_b])


def compared(node: list[int], block: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Star edges between the nodes of one block, or of two blocks, that are similar."""
    of, at = np.array(block), np.arange(len(node))
    a, b = similar(sets, at[of == of.min()], at[of == of.max()])
    label, nodes = stars(a, b, len(node)), np.array(node, np.int64)
    moved = np.flatnonzero(label != at)
    return nodes[moved], nodes[label[moved]]


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, root): nodes (node, bands) that bands connect; nodes that share none are left out."""
    dealt = nodes.select("node", F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").select("band", "a")
    return components(dealt.join(shared, "band").select("a", F.col("node").alias("b")))


def links(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): edges that connect just what similarity connects inside the clusters `near` (node, root); `sets` (node, shingles)."""
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = near.join(sizes, "root").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    group = placed.select("node", "block", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = bounded_batches(group.join(sets, "node")).repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])

        def emit() -> Iterator[pa.RecordBatch]:
            if len(held[0]) > 1:
                a, b = compared(*held)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            root, low, high, node, block = (batch.column(c).to_pylist() for c in ("root", "low", "high", "node", "block"))
            for k, at in enumerate(zip(root, low, high, strict=True)):
                if at != now:
                    yield from emit()
                    now, held = at, ([], [], [])
                held[0].append(node[k])
                held[1].append(block[k])
                held[2].append(np.frombuffer(batch.column("shingles")[k].as_py(), np.uint64))
        yield from emit()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(a, b): edges that connect just the nodes (node, fp) whose fingerprints are equal or linked by SimHash."""
    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("last")), "prints")
    shared = prints.filter("least < last").select("fp", "least")
    same = nodes.select("fp", "node").join(shared, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    found = materialise(simhash.links(prints.select("fp")), "fingerprint-links")
    ends = found.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("node_a")), "a")
    ends = ends.join(prints.select(F.col("fp").alias("b"), F.col("least").alias("node_b")), "b")
    return same.unionByName(ends.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _per_text(docs: DataFrame, columns: dict[str, tuple[str, Callable]], keep: tuple[str, ...]) -> DataFrame:
    """`keep` and columns (name: type, function of the text) made from each row's __text."""
    narrow = bounded_batches(docs).select(*keep, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            made = {c: [make(t) for t in texts] for c, (_, make) in columns.items()}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | made)

    fields = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(run, ", ".join([*fields, *(f"{c} {kind}" for c, (kind, _) in columns.items())]))


#: What every text gets: its bands, and its fingerprint as a signed number.
SIGNATURES = {"bands": ("array<bigint>", lambda t: bands(shingles(t)).view(np.int64).tolist()), "fp": ("bigint", lambda t: int(np.uint64(simhash.fingerprint(t)).view(np.int64)))}


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and component_id for every row: the smallest key that links of either kind reach.

    Texts without words, and null, are alike. A null key never names a
    component: if a component has no other key, its component_id is null. An
    empty table gives an empty result; other columns are not read.
    """
    given = docs.select(F.col(key).alias("__key"), text_of(text).alias("__text")).withColumn("node", F.xxhash64("__text"))
    made = materialise(_per_text(given, SIGNATURES, ("__key", "node")), "signatures")
    nodes = materialise(made.groupBy("node").agg(F.min("__key").alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "nodes")
    near = materialise(clusters(nodes), "clusters")
    texts = given.select("node", "__text").join(near.select("node"), "node", "left_semi").groupBy("node").agg(F.first("__text").alias("__text"))
    sets = materialise(_per_text(texts, {"shingles": ("binary", lambda t: shingles(t).tobytes())}, ("node",)), "shingles")
    every_link = links(near, sets).unionByName(fingerprint_links(nodes))
    roots = materialise(components(materialise(every_link, "links")), "roots")
    members = materialise(nodes.select("node", "first").join(roots, "node"), "members")
    smallest = materialise(members.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = materialise(members.join(smallest, "root").select("node", "component_id"), "named")
    every = materialise(nodes.select("node", "first").join(named, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")), "components")
    return made.select("__key", "node").join(every, "node", "left").select(F.col("__key").alias(key), "component_id")
