"""Secret scans in DataFrame functions only, with linking of credentials that come in parts.

Three kinds of match are secrets by themselves: assignments, access identifiers
and long hexadecimal runs. Weaker candidates (short identifiers, mixed-case
keys, short hexadecimal runs) are reported only where complementary parts
co-occur: parts are joined as intervals, each candidate's scope of `SCOPE`
characters on both sides against the places of the other parts. A part that
shares a character with the candidate is no complement: one string can't be
both halves of a credential. Scopes are cut into bins, so the join is an
equi-join on (row, bin) and a bin holds a bounded number of parts however long
the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import materialise, text_of

#: Kinds that stand by themselves, their patterns, the group whose length counts, and its least length.
BASE = {
    "assign": (
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # a maximal run, so the same as dropping shorter runs
}
#: No text is longer.
ANY = (1 << 31) - 1
#: Weak candidates and endpoints: pattern, least and greatest length. Longer identifiers and short hexadecimal runs are
#: of a kind in BASE; nothing takes longer keys and endpoints, so these have no greatest length.
PARTS = {
    "weak_id": (r"AKIA[A-Z0-9]{4,}", 8, 19),
    "weak_key": (r"[A-Za-z0-9+/]{20,}", 20, ANY),
    "weak_hex": (r"[0-9a-f]{16,}", 16, 23),
    "endpoint": (r"https?://[A-Za-z0-9.-]+", 10, ANY),
}
KINDS = [*BASE, *PARTS]
SCOPE = 256
BLOCK = 64
#: What every identifier, weak or not, begins with.
IDENTIFIER = "AKIA"
LINKED = "array<struct<start:bigint,kind:string,end:bigint>>"


def _spans(placed: str) -> Column:
    """(start, end) in code points of the wanted matches; column `placed` has each match's gap before it, its length, and whether it is wanted.

    Places are sums of what lies before. They are added up within blocks of
    `BLOCK` matches and then over the blocks, so n matches cost n * BLOCK +
    (n / BLOCK)^2 steps, not n^2.
    """
    one = "struct<start:bigint,end:bigint>"
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{one}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["length"]
        grown = F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["wanted"], grown).otherwise(state["spans"]).alias("spans"))

    def join(state: Column, b: Column) -> Column:
        moved = F.transform(b["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + b["at"]).alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(placed) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda k: F.aggregate(F.slice(placed, k * BLOCK + 1, F.lit(BLOCK)), nothing, step))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{one}>>").alias("spans"))
    return F.flatten(F.aggregate(blocks, start, join, lambda s: s["spans"]))


def _placed(text: Column, matches: Column, pattern: str, wanted: Column) -> Column:
    """Per match: code points between it and the one before, code points in it, and whether it is wanted."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.arrays_zip(between.alias("between"), matches.alias("match"), wanted.alias("wanted"))
    return F.transform(pairs, lambda x: F.struct(F.char_length(x["between"]).cast("bigint").alias("gap"), F.char_length(x["match"]).cast("bigint").alias("length"), x["wanted"].alias("wanted")))


def _long_enough(least: int):
    return lambda v: F.char_length(v) >= least


def _fits(kind: str, least: int, most: int):
    """Whether a candidate counts: its length, and for a key three classes of character (so no hexadecimal run)."""
    within = lambda m: F.char_length(m).between(least, most)
    return (lambda m: within(m) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")) if kind == "weak_key" else within


def _of_kind(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def parts_of(docs: DataFrame, kinds: dict, *, text: str = "text") -> DataFrame:
    """`docs` with one column of (start, end) arrays per kind, __<kind>."""
    t, none = text_of(text), F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = {f"__m_{k}": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, (p, *_) in kinds.items()}
    found["__v_assign"] = F.regexp_extract_all(t, F.lit(BASE["assign"][0]), F.lit(2))
    placed = {}
    for kind, (pattern, *limits) in kinds.items():
        m = F.col(f"__m_{kind}")
        if kind in BASE:
            wanted = F.transform(F.col("__v_assign" if limits[0] else f"__m_{kind}"), _long_enough(limits[1]))
        else:
            wanted = F.transform(m, _fits(kind, *limits))
        placed[f"__p_{kind}"] = F.when(F.size(m) > 0, _placed(t, m, pattern, wanted))
    out = docs.withColumns(found).withColumns(placed)
    made = {f"__{k}": F.when(F.col(f"__p_{k}").isNotNull(), _spans(f"__p_{k}")).otherwise(none) for k in kinds}
    return out.withColumns(made).drop(*found, *placed)


def link(parts: DataFrame) -> DataFrame:
    """(rid, linked): the weak candidates of each row that complementary parts within their scope confirm.

    A part counts by its start, and only if it shares no character with the
    candidate: a key that begins like an identifier doesn't confirm itself. A
    key or a short hexadecimal run needs an identifier, weak or not; a weak
    identifier needs an endpoint and one of key, short run, hexadecimal run or
    assignment.
    """
    every = parts.select("rid", F.explode(F.concat(*[F.transform(f"__{k}", _of_kind(k)) for k in KINDS])).alias("p")).select("rid", "p.*")
    weak = every.filter(F.col("kind").isin("weak_id", "weak_key", "weak_hex"))
    low, high = F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE
    scopes = weak.select("rid", F.col("kind").alias("weak"), F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE))).alias("bin"))
    places = every.select("rid", "kind", "start", "end", F.floor(F.col("start") / SCOPE).alias("bin"))
    near = (F.col("start") >= F.col("w_start") - SCOPE) & (F.col("start") < F.col("w_end") + SCOPE)
    apart = (F.col("end") <= F.col("w_start")) | (F.col("start") >= F.col("w_end"))
    met = scopes.join(places, ["rid", "bin"]).filter(near & apart)
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds))
    flags = met.groupBy("rid", "weak", "w_start", "w_end").agg(has("access", "weak_id").alias("id"), has("weak_key", "weak_hex", "hex", "assign").alias("secret"), has("endpoint").alias("endpoint"))
    confirmed = flags.filter(F.when(F.col("weak") == "weak_id", F.col("secret") & F.col("endpoint")).otherwise(F.col("id")))
    return confirmed.groupBy("rid").agg(F.collect_list(F.struct(F.col("w_start").alias("start"), F.col("weak").alias("kind"), F.col("w_end").alias("end"))).alias("linked"))


def _listed(spans: Column) -> Column:
    """Sorted by start, then kind as listed."""
    return F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, and per row base_spans and spans (arrays of start, rank, kind, end), n_assign, n_access, n_hex.

    `spans` holds the base spans and the confirmed candidates that no base span
    covers. A null or empty text has none. Repeated rows stay, each with its
    own spans; an empty table gives an empty result. Texts without an identifier
    stay in their rows; only those with one are written down and joined.
    """
    given = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col(text).alias("k_text"))
    carried = [c for c in given.columns if c != "k_text"]
    named = F.contains(text_of("k_text"), F.lit(IDENTIFIER))  # nothing links in a text without an identifier
    alone = parts_of(given.filter(~named), BASE, text="k_text").select(*carried, *[f"__{k}" for k in BASE]).withColumn("linked", F.array().cast(LINKED))
    found = parts_of(given.filter(named), BASE | PARTS, text="k_text").drop("k_text")
    found = materialise(found.withColumn("rid", F.monotonically_increasing_id()), "parts")  # numbers are fixed once written
    joined = found.join(link(found.select("rid", *[f"__{k}" for k in KINDS])), "rid", "left")
    both = alone.unionByName(joined.select(*carried, *[f"__{k}" for k in BASE], F.coalesce("linked", F.array().cast(LINKED)).alias("linked")))
    base = F.concat(*[F.transform(f"__{k}", _of_kind(k)) for k in BASE])
    free = F.filter("linked", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    listed = both.withColumn("__base", base).withColumns({"base_spans": _listed(F.col("__base")), "spans": _listed(F.concat("__base", free))})
    return listed.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "base_spans", "spans", *[F.size(f"__{k}").cast("bigint").alias(f"n_{k}") for k in BASE])


def redact(scanned: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of `scan` (text kept) with every span of the text replaced; overlapping spans are one."""
    t = F.col(text)

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(t, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    tail = lambda s: F.concat(s["out"], F.array(F.substring(t, (s["at"] + 1).cast("int"), F.char_length(t))))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, F.array_join(F.aggregate("spans", start, step, tail), "")).otherwise(t))
