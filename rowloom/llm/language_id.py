"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Per language, character n-grams up to `ORDER` inside words (with a start and an
end mark) are counted over a bounded sample of labelled rows and smoothed:
absolute discounts, continuation counts below the top order, interpolation with
the next lower order down to a uniform one. All languages share one sorted
array of 64-bit gram hashes per order, with a row of log-probabilities, one per
language; unseen grams fall back through a second array of context weights.

A text gets the language of lowest cross-entropy per symbol over all its
letters. Part of the sample is kept out of training; its cross-entropies set,
per language, the value from which on a prediction is marked `rejected`.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import bounded_batches, text_of

ORDER = 5
ALPHABET = 1024  # size of the uniform distribution below the unigrams
#: Labelled rows per language that training reads (whole texts), about; and the tenths of them kept for calibration.
SAMPLE_ROWS, KEPT_TENTHS = 1000, 2
#: A prediction is rejected beyond so many standard deviations above the calibration mean, from so many symbols on. Whatever
#: the cross-entropies' distribution, at most one text of a language in 1 + DEVIATIONS^2 = 65 lies there (Cantelli's inequality).
DEVIATIONS, LEAST_SYMBOLS = 8.0, 20
#: Of the totals of tokens, and of the tokens themselves.
MEMO_BYTES = 64 << 20
UNDETERMINED = "und"

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """hashes[n][i]: of the n symbols that end at i; the symbols up to i in its word; the word of i."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    symbols = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    depth = np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size) + 1
    hashes = [np.zeros(len(symbols), np.uint64)]
    for n in range(1, ORDER + 1):
        before = np.concatenate([np.zeros(1, np.uint64), hashes[-1][:-1]])
        hashes.append(_mix(before * np.uint64(0x100000001B3) + symbols + np.uint64(n << 32)))
    return hashes, depth, word


@dataclass
class Level:
    """One order of one language: grams with probabilities, contexts with what they leave to the order below."""

    gram: np.ndarray
    p: np.ndarray
    context: np.ndarray
    rest: np.ndarray


def train(counts: Counter[str]) -> list[Level]:
    """Levels 1..ORDER of the words of one language."""
    words = [*counts]
    hashes, depth, word = grams(words)
    weight = np.fromiter(counts.values(), dtype=np.float64, count=len(words))[word]
    predicted = depth > 1
    levels: list[Level] = []
    above: tuple[np.ndarray, np.ndarray] | None = None  # distinct grams of the order above: hash of the suffix
    tables = []
    for n in range(ORDER, 0, -1):
        at = np.flatnonzero(predicted & (depth >= n))
        raw = at if n == ORDER else at[depth[at] == n]  # a gram that starts its word has no continuation count
        h, c = hashes[n][raw], weight[raw]
        first = raw
        if above is not None:
            h, c, first = np.concatenate([h, hashes[n][above]]), np.concatenate([c, np.ones(len(above))]), np.concatenate([raw, above])
        gram, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        count, place = np.bincount(inverse, weights=c), first[index]
        tables.append((n, gram, count, place))
        distinct = np.unique(hashes[n][at], return_index=True)[1]
        above = at[distinct][depth[at[distinct]] >= n]
    lower: Level | None = None
    for n, gram, count, place in reversed(tables):
        before = hashes[n - 1][place - 1] if n > 1 else np.zeros(len(place), np.uint64)
        context, which = np.unique(before, return_inverse=True)
        total, kinds = np.bincount(which, weights=count), np.bincount(which)
        ones, twos = int((count == 1).sum()), int((count == 2).sum())
        discount = ones / (ones + 2 * twos) if ones else 0.5
        rest = discount * kinds / total
        below = lower.p[np.searchsorted(lower.gram, hashes[n - 1][place])] if lower is not None else np.full(len(gram), 1 / ALPHABET)
        lower = Level(gram, np.maximum(count - discount, 0) / total[which] + rest[which] * below, context, rest)
        levels.append(lower)
    return levels


def _at(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


class Models:
    """All languages' models side by side."""

    def __init__(self, by_language: dict[str, list[Level]]):
        self.languages = sorted(by_language)
        self.gram, self.logp, self.context, self.logrest = [], [], [], []
        for n in range(ORDER):
            levels = [by_language[x][n] for x in self.languages]
            context = np.unique(np.concatenate([x.context for x in levels]))
            rest = np.zeros((len(context), len(levels)), np.float32)
            for k, x in enumerate(levels):
                rest[np.searchsorted(context, x.context), k] = np.log2(x.rest)
            self.context.append(context)
            self.logrest.append(rest)
            self.gram.append(np.unique(np.concatenate([x.gram for x in levels])))
        for n in range(ORDER):
            self.logp.append(np.full((len(self.gram[n]), len(self.languages)), np.nan, np.float32))
            for k, x in enumerate(self.languages):
                self.logp[n][np.searchsorted(self.gram[n], by_language[x][n].gram), k] = np.log2(by_language[x][n].p)

    def fill(self, suffix: list[np.ndarray], before: list[np.ndarray]) -> None:
        """Give a gram that a language hasn't seen what its lower orders give there."""
        for n in range(ORDER):
            at, found = _at(self.context[n], before[n])
            rest = np.where(found[:, None], self.logrest[n][at], 0)
            below = self.logp[n - 1][np.searchsorted(self.gram[n - 1], suffix[n])] if n else np.full_like(rest, -math.log2(ALPHABET))
            self.logp[n] = np.where(np.isnan(self.logp[n]), rest + below, self.logp[n])

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word the log2-probability under every language, and the symbols predicted (its end included)."""
        hashes, depth, word = grams(words)
        total = np.zeros((len(words), len(self.languages)))
        at = np.flatnonzero(depth > 1)
        logp, todo = np.zeros((len(at), len(self.languages)), np.float32), np.minimum(depth[at], ORDER)
        open_ = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            here = open_[todo[open_] >= n]
            place, found = _at(self.gram[n - 1], hashes[n][at[here]])
            logp[here[found]] += self.logp[n - 1][place[found]]
            missed = here[~found]
            place, known = _at(self.context[n - 1], hashes[n - 1][at[missed] - 1] if n > 1 else np.zeros(len(missed), np.uint64))
            logp[missed[known]] += self.logrest[n - 1][place[known]]
            open_ = np.concatenate([open_[todo[open_] < n], missed])
        logp[open_] -= math.log2(ALPHABET)
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(word[at], weights=logp[:, k], minlength=len(words))
        return total, np.bincount(word[at], minlength=len(words))


def models_of(counts: dict[str, Counter[str]]) -> Models:
    """Train every language and lay the models side by side."""
    made = Models({x: train(c) for x, c in counts.items()})
    suffix: list[np.ndarray] = [np.zeros(len(g), np.uint64) for g in made.gram]
    before: list[np.ndarray] = [np.zeros(len(g), np.uint64) for g in made.gram]
    for c in counts.values():
        hashes, depth, _ = grams([*c])
        for n in range(1, ORDER + 1):
            at = np.flatnonzero((depth > 1) & (depth >= n))
            g, index = np.unique(hashes[n][at], return_index=True)
            place, found = _at(made.gram[n - 1], g)
            suffix[n - 1][place[found]] = hashes[n - 1][at[index[found]]]
            before[n - 1][place[found]] = hashes[n - 1][at[index[found]] - 1] if n > 1 else 0
    made.fill(suffix, before)
    return made


class Scorer:
    """Totals per text, with a memo of white-space tokens."""

    def __init__(self, models: Models):
        self.models, self.place = models, {}
        self.rows = np.zeros((1024, len(models.languages) + 1))
        self.held = 0
        self.most = max(1000, MEMO_BYTES // (8 * self.rows.shape[1] + 200))

    def _learn(self, tokens: list[str]) -> None:
        if len(self.place) + len(tokens) > self.most:
            self.place.clear()
        words, owner = [], []
        for i, t in enumerate(tokens):
            for w in LETTERS.findall(t.lower()):
                words.append(w)
                owner.append(i)
        start, end = len(self.place), len(self.place) + len(tokens)
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(end - len(self.rows), len(self.rows)), self.rows.shape[1]))])
        own = np.zeros((len(tokens), self.rows.shape[1]))
        if words:
            total, symbols = self.models.scores(words)
            for k in range(total.shape[1]):
                own[:, k] = np.bincount(owner, weights=total[:, k], minlength=len(tokens))
            own[:, -1] = np.bincount(owner, weights=symbols, minlength=len(tokens))
        self.rows[start:end] = own
        self.place.update(zip(tokens, range(start, end), strict=True))
        self.held += sum(map(len, tokens))

    def totals(self, texts: list[str]) -> np.ndarray:
        """Per text the log2-probabilities and, last, the symbols."""
        out = np.zeros((len(texts), self.rows.shape[1]))
        for low in range(0, len(texts), 128):
            split = [t.split() for t in texts[low : low + 128]]
            if new := {t for tokens in split for t in tokens}.difference(self.place):
                if len(self.place) + len(new) > self.most or self.held > MEMO_BYTES:
                    self.place.clear()
                    self.held = 0
                    new = {t for tokens in split for t in tokens}
                self._learn([*new])
            for i, tokens in enumerate(split):
                if tokens:
                    out[low + i] = self.rows[np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))].sum(axis=0)
        return out


_SCORERS: dict[str, Scorer] = {}


def _scored(docs: DataFrame, shared, keep: list[str], text: str) -> DataFrame:
    """`keep`, the best language, its cross-entropy, the confidence and the symbols."""
    narrow = bounded_batches(docs).select(*keep, text_of(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, cross_entropy double, score double, n_symbols bigint"])

    token = uuid.uuid4().hex  # a reused worker keeps its memo for the same models only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[token] = Scorer(shared.value)
        scorer = _SCORERS[token]
        names = np.array([*scorer.models.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            t = scorer.totals(batch.column("__text").to_pylist())
            n = t[:, -1]
            entropy = -t[:, :-1] / np.maximum(n, 1)[:, None] if t.shape[1] > 1 else np.full((len(t), 1), np.inf)
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(len(t)), best]
            odds = np.exp2(-(entropy - low[:, None]) * np.minimum(n, 32)[:, None]).sum(axis=1)
            none = (n == 0) | ~np.isfinite(low)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {
                "lang_pred": pa.array(names[np.where(none, len(names) - 1, best)], pa.string()),
                "cross_entropy": pa.array(np.where(none, 0.0, low)),
                "score": pa.array(np.where(none, 0.0, 1 / np.where(none, 1, odds))),
                "n_symbols": pa.array(n.astype(np.int64)),
            })

    return narrow.mapInArrow(run, schema)


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS):
    """(models, limits): trained on a sample of about `sample_rows` rows of each language.

    `labelled` rows with a null language or text are left out. A row is in the
    sample, and in its calibration part, by a hash of its key, so the sample is
    the same on every run. limits: language -> cross-entropy of rejection.
    """
    spark = labelled.sparkSession
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not sizes:
        return None, {}
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, math.ceil(1e6 * sample_rows / n)))]), F.col(lang))
    sample = usable.filter(draw < share).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), (F.pmod(F.xxhash64(F.lit("kept"), F.col(key)), F.lit(10)) < KEPT_TENTHS).alias("kept"))
    few = {k for k, n in sizes.items() if n < 20}  # too few rows to keep any from training

    def words(pdf: pd.DataFrame) -> pd.DataFrame:
        c: Counter[str] = Counter()
        for t in pdf["text"]:
            c.update(LETTERS.findall(t.lower()))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "word": [*c], "n": [*c.values()]})

    training = sample.filter(~F.col("kept") | F.col("lang").isin(*few)) if few else sample.filter(~F.col("kept"))
    counts: dict[str, Counter[str]] = {}
    for r in training.groupBy("lang").applyInPandas(words, "lang string, word string, n bigint").toPandas().itertuples():
        counts.setdefault(r.lang, Counter())[r.word] = r.n
    if not counts:
        return None, {}
    shared = spark.sparkContext.broadcast(models_of(counts))
    found = _scored(sample.filter("kept"), shared, ["lang"], "text").filter(f"lang_pred = lang and n_symbols >= {LEAST_SYMBOLS}")
    spread = found.groupBy("lang").agg(F.avg("cross_entropy").alias("m"), F.coalesce(F.stddev("cross_entropy"), F.lit(0.0)).alias("s"), F.count("*").alias("n")).collect()
    return shared, {r["lang"]: r["m"] + DEVIATIONS * max(r["s"], 0.05 * r["m"]) for r in spread if r["n"] >= 5}


def identify(docs: DataFrame, fitted, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, lang_pred, score, cross_entropy, n_symbols, rejected for every row.

    A null text or one without a letter is `und` with score 0 and rejected.
    Without any learned language every text is. Repeated rows stay; an empty
    table gives an empty result. Only `keep` and the text are read.
    """
    shared, limits = fitted
    if shared is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("cross_entropy"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("n_symbols"), F.lit(True).alias("rejected"))
    scored = _scored(docs, shared, [*keep], text)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("lang_pred")) if limits else F.lit(None).cast("double")
    far = (F.col("n_symbols") >= LEAST_SYMBOLS) & (F.col("cross_entropy") > limit)
    return scored.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | F.coalesce(far, F.lit(False)))
