"""Best-fit packing of token sequences through the configuration linear program.

Pieces of at most `capacity` tokens are counted by length; the histogram has at
most `capacity` entries whatever the input, and only it reaches the driver. The
driver covers it with patterns (multisets of lengths that fill one sequence):

1. multiplicative weights solve the covering program min sum(x), A x >= n. A
   length's weight falls as it gets covered; the next pattern is the one of
   greatest weight, priced by a bounded-knapsack dynamic program.
2. the fractional x is rounded to whole sequences, down first and then up by the
   largest fractions, never above a length's count, and the program is solved
   again for what is left.
3. what rounding leaves is filled best fit, longest piece first. Best fit alone
   is the measure: rounding keeps only as many patterns, fullest first, as need
   no more sequences in all, so a plan is never worse than best fit.

The plan is a list of (pattern, number of sequences), a few thousand entries at
most. A piece finds its place from its rank among the pieces of its length:
its rank in its own input block plus the counts of the blocks before it. So no
task ranks more than the blocks' counts of one length, and pieces are shuffled
once, without their tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.bpe import encoder, little_endian
from rowloom.llm.common import bounded_batches, materialise, text_of

#: Share of a length's count that one step covers, steps of one solution, and solutions of what is left.
STEP, STEPS, ROUNDS = 0.5, 700, 2
#: Rounding takes a pattern only from such a share of the capacity on; the rounding that needs fewest sequences stays.
FULL = (0.99, 0.999, 1.0)

Run = tuple[int, list[tuple[int, int]]]  # sequences, and (length, times) in each


def price(values: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Times of each length in the pattern of greatest value that fits.

    Lengths over half the capacity occur once at most, so the bounded-knapsack
    program (binary splitting) runs over the others and one look-up adds the
    best of the long ones.
    """
    items = []  # (index, times)
    for i in np.flatnonzero(2 * lengths <= capacity).tolist():
        left, times = int(most[i]), 1
        while left > 0:
            take = min(times, left)
            items.append((i, take))
            left, times = left - take, times * 2
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), dtype=bool)
    for k, (i, times) in enumerate(items):
        size = int(lengths[i]) * times
        if size <= capacity:
            with_it = best[: capacity + 1 - size] + values[i] * times
            np.greater(with_it, best[size:], out=took[k, size:])
            np.maximum(with_it, best[size:], out=best[size:])
    times_of, room = np.zeros(len(lengths), dtype=np.int64), capacity
    long = np.flatnonzero((2 * lengths > capacity) & (most > 0))
    if len(long):
        with_long = values[long] + best[capacity - lengths[long]]
        if with_long.max() > best[capacity]:
            i = long[int(with_long.argmax())]
            times_of[i], room = 1, capacity - int(lengths[i])
    for k in range(len(items) - 1, -1, -1):
        if took[k, room]:
            i, times = items[k]
            times_of[i] += times
            room -= int(lengths[i]) * times
    return times_of


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(pattern, sequences) that cover the counts about evenly: multiplicative weights with steps at the bottleneck."""
    most = np.minimum(counts, capacity // lengths)
    covered, chosen, rate = np.zeros(len(lengths)), [], np.log(len(lengths) + 1.0) / STEP
    worth = (lengths / capacity) ** 2.0  # weights start higher for long pieces, which few patterns can take
    for _ in range(STEPS):
        if covered.min() >= 1:
            break
        pattern = price(worth * np.exp(-rate * covered), lengths, most, capacity)
        used = pattern > 0
        amount = STEP * float((counts[used] / pattern[used]).min())
        chosen.append((pattern, amount))
        covered[used] += pattern[used] * amount / counts[used]
    mass = sum(float(p @ lengths) * x for p, x in chosen)
    scale = float(lengths @ counts) / mass if mass else 0.0
    return [(p, x * min(1.0, scale)) for p, x in chosen]


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[Run]:
    """Longest first, each into the fullest sequence that has room; like sequences are handled together."""
    rooms: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [sequences, pattern]
    open_ = 0  # bit r: some sequence has room r
    for length, n in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while n:
            above = open_ >> length
            if above:
                room = length + (above & -above).bit_length() - 1
                sequences, pattern = rooms[room].pop()
            else:
                sequences, pattern, room = n, {}, capacity
            fit = min(room // length, n)
            used = min(sequences, n // fit)
            if used < sequences and pattern:
                rooms[room].append([sequences - used, pattern])
            if not rooms[room]:
                open_ &= ~(1 << room)
            rooms[room - fit * length].append([used, pattern | {length: fit}])
            open_ |= 1 << (room - fit * length)
            n -= used * fit
    return [(s, [*p.items()]) for groups in rooms for s, p in groups]


def rounded(chosen: list[tuple[np.ndarray, float]], lengths: np.ndarray, counts: np.ndarray, capacity: int, full: float) -> list[tuple[int, np.ndarray]]:
    """Whole sequences of the fractional solution's patterns that are `full` enough, fullest first: rounded down, then up by the largest fractions while the counts last."""
    merged: dict[bytes, list] = {}
    for p, x in chosen:
        if int(p @ lengths) >= full * capacity:
            merged.setdefault(p.tobytes(), [p, 0.0])[1] += x
    order = sorted(merged.values(), key=lambda m: -int(m[0] @ lengths))
    left, times = counts.copy(), []
    room = lambda p: int((left[p > 0] // p[p > 0]).min())
    for p, x in order:
        times.append(min(int(x), room(p)))
        left = left - times[-1] * p
    for i in sorted(range(len(order)), key=lambda i: times[i] - order[i][1]):
        if times[i] < order[i][1] and room(order[i][0]):
            times[i] += 1
            left = left - order[i][0]
    return [(n, p) for n, (p, _) in zip(times, order, strict=True) if n]


def needed(runs: list[Run]) -> int:
    return sum(n for n, _ in runs)


def parts_of_plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], list[Run]]:
    """Sequences for all pieces of the histogram {length: pieces}: those of the program, and those of best fit around it.

    Every piece has exactly one place; of plans of equally few sequences that
    with most sequences from the program stays.
    """
    lengths = np.array(sorted(x for x, n in histogram.items() if 0 < x < capacity and n), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    fill = lambda left: best_fit(lengths[left > 0], left[left > 0], capacity)

    def kept(runs: list[tuple[int, np.ndarray]], left: np.ndarray, most: int) -> tuple[int, list[Run], np.ndarray]:
        """As many runs, from the first, as need at most `most` sequences together with best fit for what they leave."""
        low, high, best = 0, len(runs), (needed(fill(left)), [], left)
        while low <= high:
            k = high if low == 0 and high == len(runs) else (low + high) // 2
            rest = left - sum((n * p for n, p in runs[:k]), np.zeros_like(left))
            total = sum(n for n, _ in runs[:k]) + needed(fill(rest))
            if total <= min(most, best[0]):
                best = total, [(n, [*zip(lengths[p > 0].tolist(), p[p > 0].tolist(), strict=True)]) for n, p in runs[:k]], rest
                low = k + 1
            else:
                high = k - 1
        return best

    def solved(left: np.ndarray, rounds: int) -> tuple[list[Run], np.ndarray]:
        """Runs of the program, and the counts that they leave to best fit."""
        # rare lengths would make the steps tiny; best fit places them
        on = left * max(1, int((left > 0).sum())) * 8 * capacity >= max(1, int(lengths @ left))
        if not rounds or not on.any():
            return [], left
        chosen, alone = fractional(lengths[on], left[on], capacity), needed(fill(left))
        best: tuple[int, list[Run], np.ndarray] = (alone, [], left)
        for full in FULL:
            whole = []
            for n, p in rounded(chosen, lengths[on], left[on], capacity, full):
                wide = np.zeros_like(left)
                wide[on] = p
                whole.append((n, wide))
            found = kept(whole, left, alone)
            best = min(best, found, key=lambda b: (b[0], -needed(b[1])))
        total, runs, rest = best
        if not runs:
            return [], left
        more, last = solved(rest, rounds - 1)
        better = more and needed(runs) + needed(more) + needed(fill(last)) <= total
        return (runs + more, last) if better else (runs, rest)

    runs, rest = solved(counts, ROUNDS)
    whole = [(n, [(length, 1)]) for length, n in histogram.items() if length == capacity and n]
    return runs, whole + fill(rest)


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """The sequences of both parts."""
    program, rest = parts_of_plan(histogram, capacity)
    return program + rest


@dataclass
class Places:
    """The plan as sorted arrays: for (length, rank) the sequence and the offset."""

    keys: np.ndarray
    times: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    RANK_BITS = 44

    @classmethod
    def of(cls, runs: list[Run]) -> Places:
        rows, taken, sequence = [], {}, 0
        for sequences, pattern in runs:
            offset = 0
            for length, times in pattern:
                rank = taken.get(length, 0)
                rows.append(((length << cls.RANK_BITS) + rank, times, rank, sequence, offset))
                taken[length] = rank + sequences * times
                offset += length * times
            sequence += sequences
        return cls(*(np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True))) if rows else cls(*(np.zeros(0, np.int64) for _ in range(5)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << self.RANK_BITS) + rank, side="right") - 1
        copy, slot = np.divmod(rank - self.first[at], self.times[at])
        return self.sequence[at] + copy, self.offset[at] + slot * length


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    head = n % capacity or capacity
    return [(0, min(n, head)), *((s, capacity) for s in range(head, n, capacity))]


def pieces_of(docs: DataFrame, tokenizer_json: str, *, capacity: int, end_id: int, key: str, text: str, with_ids: bool) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its input block."""
    narrow = bounded_batches(docs).select(key, text_of(text).alias("__text"))
    fields = f"`{key}` {narrow.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, block bigint, local bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end, block, seen = encoder(tokenizer_json), little_endian([end_id]), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, ids_out, row_of = [], [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                ids = e.encode(t) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, zlib.crc32(own), block, local := seen.get(length, 0)))
                    seen[length] = local + 1
                    row_of.append(i)
                    if with_ids:
                        ids_out.append(own)
            columns = [*zip(*rows, strict=True)] or [()] * 6
            out = {key: batch.column(key).take(pa.array(row_of, pa.int64())), "piece": pa.array(columns[0], pa.int32())}
            out |= {n: pa.array(c, pa.int64()) for n, c in zip(("start", "length", "ids_crc32", "block", "local"), columns[1:], strict=True)}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids_out, pa.binary())} if with_ids else {}))

    return narrow.mapInArrow(run, fields)


def pack(docs: DataFrame, tokenizer_json: str, *, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack the tokens of every text, and `end_id`, into sequences of at most `capacity` tokens.

    Per piece: `key`, piece, start, length, ids_crc32, sequence_id, offset, and
    with `with_ids` the piece's `ids` (little-endian uint32). A null or empty
    text is one piece of one token. Repeated rows are packed as often as they
    occur; an empty table gives an empty result; other columns are not read.
    """
    pieces = materialise(pieces_of(docs, tokenizer_json, capacity=capacity, end_id=end_id, key=key, text=text, with_ids=with_ids), "pieces")
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    places = Places.of(plan(histogram, capacity))
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("block", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["block", "length"])
    kept = [key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    fields = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("local").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return ranked.mapInArrow(place, fields)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from pieces packed with their ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))
