"""Quality rules in DataFrame functions only: repetition counts and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into `BUCKETS` features. Two multinomials over
the features, one of all trusted documents and one of the whole corpus, give
each feature a log-ratio; a document's score is the mean over its features. The
threshold is set by all trusted documents' own scores, so equal inputs always
give equal verdicts, whatever the order or the partitioning.

Everything per document stays inside its row (higher-order functions). Features
are added up by a shuffle of at most `BUCKETS` rows per task; trusted texts meet
their keys in a second shuffle, behind a table of `BITS` bits that keeps most
other texts out of it. The log-ratios reach the executors as one array of
`BUCKETS` numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import SPACE, materialise, text_of

BUCKETS = 1 << 13
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: Bits of the table that keeps texts out of the look-up of trusted keys; broadcast as at most BITS / 64 rows.
BITS = 1 << 23
#: The threshold lies so many standard deviations of the trusted scores below their mean.
DEVIATIONS = 6.0
SMOOTHING = 1.0
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def with_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """`docs` with __words (hashes) and the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.col("__text")
    one = docs.withColumn("__text", text_of(text)).withColumn("__split", words_of(t))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.withColumns({
        "__words": F.transform("__split", lambda w: F.xxhash64(w)),
        "n_words": F.size("__split").cast("bigint"),
        "word_chars": F.char_length(F.array_join("__split", "")).cast("bigint"),
        "n_symbols": F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint"),
        "__lines": F.transform(lines, lambda x: F.xxhash64(x)),
    })
    window = F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*[_at("__words", i + k) for k in range(WINDOW)]))
    three = two.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__windows": F.when(F.col("n_words") > WINDOW, window).otherwise(F.array().cast("array<bigint>")),
    })
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.withColumn("__placed", F.when(repeats, placed))
    again = lambda x, k: (_at("__placed", k - 1)["h"].eqNullSafe(x["h"]) | _at("__placed", k + 1)["h"].eqNullSafe(x["h"]))
    starts = F.sort_array(F.filter(F.transform("__placed", lambda x, k: F.when(again(x, k), x["i"])), lambda i: i.isNotNull()))
    five = four.withColumn("__starts", starts)
    # a word counts once: a window adds what lies before the next repeated window
    added = F.transform("__starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(_at("__starts", k + 1) - s, F.lit(WINDOW))))
    six = five.withColumn("n_repeat_words", F.coalesce(F.aggregate(added, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return six.withColumn("base_failed", failed).drop("__text", "__split", "__lines", "__windows", "__placed", "__starts")


def features(words: str = "__words") -> Column:
    """Buckets of the words and of the pairs of neighbours, from word hashes."""
    single = F.transform(words, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pair = F.transform(words, lambda h, i: F.pmod(F.xxhash64(h, F.coalesce(_at(words, i + 1), F.lit(0).cast("bigint"))), F.lit(BUCKETS)).cast("int"))
    return F.concat(single, pair)


def trusted(labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Keys of all trusted documents: labelled good and not toxic."""
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(key).isNotNull()).select(key).distinct()


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose __doc is a __key, by a shuffle of those alone that a table of hashed bits lets through."""
    kind = keys.schema["__key"].dataType
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(BITS))
    word, bit = lambda c: F.floor(place(c) / 64), lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (place(c) % 64).cast("int"))
    table = keys.groupBy(word("__key").alias("__word")).agg(F.bit_or(bit("__key")).alias("__bits"))
    may = rows.join(F.broadcast(table), (word("__doc") == F.col("__word")) & (F.col("__bits").bitwiseAND(bit("__doc")) != 0), "left_semi")
    return may.join(keys.hint("shuffle_hash"), F.col("__doc") == F.col("__key"), "left_semi")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[list[float], float]:
    """(ratios, threshold): the log-ratio of every bucket, and the score below which a document goes.

    Every document counts in the corpus multinomial, every trusted one in the
    target and in the threshold. Without trusted documents all ratios are zero
    and nothing goes.
    """
    chosen = materialise(trusted(labels, key=key).select(F.col(key).alias("__key")), "trusted")
    given = docs.select(F.col(key).alias("__doc"), text_of(text).alias("__text"))
    hashed = F.transform(words_of(F.col("__text")), lambda w: F.xxhash64(w)).alias("__words")
    # written down: counted, then scored
    own = materialise(among(given, chosen).select(hashed).select(F.size("__words").alias("n"), features().alias("features")), "trusted-features")
    counts = lambda made: {r["bucket"]: r["count"] for r in made.groupBy("bucket").count().collect()}  # noqa: E731  # BUCKETS at most
    raw, target = counts(given.select(hashed).select(F.explode(features()).alias("bucket"))), counts(own.select(F.explode("features").alias("bucket")))
    raws, targets = sum(raw.values()), sum(target.values())
    share = lambda n, total: math.log((n + SMOOTHING) / (total + SMOOTHING * BUCKETS))
    ratios = [round(share(target.get(b, 0), targets) - share(raw.get(b, 0), raws), 6) if targets else 0.0 for b in range(BUCKETS)]
    sample = own.filter(F.col("n") >= LEAST_WORDS).select(_mean(ratios, F.col("features"), F.col("n")).alias("s"))
    spread = sample.agg(F.avg("s"), F.coalesce(F.stddev("s"), F.lit(0.0))).first()
    return ratios, float("-inf") if spread[0] is None or not targets else spread[0] - DEVIATIONS * spread[1]


def _mean(ratios: list[float], made: Column, words: Column) -> Column:
    """Mean log-ratio of the features made of so many words; 0 without words."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one constant
    total = F.aggregate(made, F.lit(0.0), lambda a, f: a + F.get(table, f))
    return F.when(words == 0, F.lit(0.0)).otherwise(total / (2 * words))


def score(ratios: list[float], words: str = "__words") -> Column:
    """Mean log-ratio of a document's features; 0 without words."""
    return _mean(ratios, features(words), F.size(words))


def judge(docs: DataFrame, fitted: tuple[list[float], float], *, text: str = "text") -> DataFrame:
    """`docs` with the rule columns, llr and kept.

    A null or empty text has no words and fails. Repeated rows stay; an empty
    table gives an empty result. Columns of `docs` that bear a result's name
    are replaced.
    """
    ratios, threshold = fitted
    given = docs.drop(*RESULTS)
    counted = with_counts(given, text=text).withColumn("llr", score(ratios))
    counted = counted.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    # a filter on a result must not be pushed below the arrays it comes from: it would compute them once per use
    made = counted.select(*[F.col(f"`{c}`") for c in given.columns], F.explode(F.array(F.struct(*RESULTS))).alias("__result"))
    return made.select(*[F.col(f"`{c}`") for c in given.columns], "__result.*")


#: Columns that `judge` adds.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
