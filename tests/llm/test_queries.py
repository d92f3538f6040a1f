"""The registered queries on a small table with every odd row: nulls, empty and long texts, repeated rows, clashing columns, and none at all."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from rowloom.llm import bpe, common, language_id, media, packing, quality, secrets, simhash, token_counts
from rowloom.llm.queries import CAPACITY, QUERIES, tokenizer_json
from tests.llm.test_texts import slow_spans

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank today "
LONG = PROSE * 600
ROWS = [(1, PROSE), (2, PROSE), (3, None), (4, ""), (5, LONG), (5, LONG), (None, PROSE.upper()), (7, "x" * 30_000), (8, "é𝒳 日本 " * 50), (9, "AKIAABCDEFGH12 key Ab3dEf7hIj9kLmN0pQrStUvWxYz12345 at https://s3.example.com/x"), (10, " \t\n "), (11, PROSE.replace("owls", "hawks"))]
CLASHES = "cast('q' as string) as n_tokens, 1 as ids, 'p' as page, 2 as stored, 'k' as block, 3 as chunk, true as held_out, 'f' as fp, 4 as component_id, 'l' as lang_pred, 5 as score, 'd' as digest, 6 as kept, 7 as spans, 8 as sequence_id"
PAGES = [(1, "http://a.com/", "z" * 200), (2, "http://a.com/", "z" * 200), (3, None, None), (None, " \n", "z" * 200), (5, "http://b.com", LONG), (5, "http://b.com", LONG), (6, "u", "short")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(k, t, "en" if k is None or k % 2 else None, "s", None if t is None else len(t)) for k, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.selectExpr("*", *CLASHES.split(", ")).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, None), (5, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'d' as digest", "1 as first", "2 as volume").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").filter("false").write.parquet(f"{at}/{t}.parquet")
    return at


def by_text(rows, key="doc_id"):
    """Rows by key; of repeated rows one, after a look that they are alike."""
    out = {}
    for r in rows:
        assert out.setdefault(r[key], r) == r or key != "doc_id"
    return out


TEXT = {k: t or "" for k, t in ROWS}


@pytest.mark.parametrize("name", [*QUERIES])
def test_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_packing(spark, folder):
    rows = QUERIES["op1_best_fit_packing"](spark, folder).collect()
    library, at = Tokenizer.from_str(tokenizer_json()), {}
    for k, t in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        own = [r for r in rows if r["doc_id"] == k]
        times = sum(x == k for x, _ in ROWS)
        pieces = packing.cut(len(ids), CAPACITY)
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == sorted([(i, s, n, zlib.crc32(np.asarray(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(pieces)] * times)
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= CAPACITY


def test_archives(spark, folder):
    rows = QUERIES["op2_warc"](spark, folder).collect()
    assert len(rows) == len(PAGES)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in rows) == [(0, "revisit", 1), (1, "response", 0), (2, "revisit", 1), (3, "response", 0), (5, "response", 0), (5, "response", 0), (6, "response", 0)]
    assert {r["payload_digest"] for r in rows} == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in PAGES}


def test_token_counts(spark, folder):
    library = token_counts.library(public_tokenizers.path("piece_bpe_32k.model"))
    for k, r in by_text(QUERIES["op3_token_counts"](spark, folder).collect()).items():
        n = len(library.encode(TEXT[k]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(TEXT[k].encode()), n, n > 4096)
        assert len(library.encode(TEXT[k][: r["fits_4096"]])) <= 4096
        if n > 4096:
            assert len(library.encode(TEXT[k][: r["fits_4096"] + 1])) > 4096
        else:
            assert r["fits_4096"] == len(TEXT[k])


def test_context_trees(spark, folder):
    rows = QUERIES["op4_context_tree_weighting"](spark, folder).collect()
    assert len(rows) == len(ROWS)
    kept = [(k, t) for k, t in ROWS if zlib.crc32(str("" if k is None else k).encode()) % 7 != 2]
    train = sum(len((t or "").encode().lower().split()) + 1 for _, t in kept)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2)
        assert r["train_tokens"] == train and r["n_tokens"] == len(TEXT[r["doc_id"]].encode().lower().split()) + 1 and r["score"] < 0


def test_quality(spark, folder):
    rows = by_text(QUERIES["op5_quality_rules"](spark, folder).collect())
    for k, r in rows.items():
        words = [w for w in TEXT[k].replace("\t", " ").replace("\n", " ").split(" ") if w]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hot = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 2000 else set(range(len(words)))
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(hot))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(hot) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_fingerprints(spark, folder):
    rows = QUERIES["op6_simhash"](spark, folder).collect()
    assert len(rows) == len(ROWS)
    groups = {r["doc_id"]: r["component_id"] for r in rows}
    assert all(int(r["fingerprint"], 16) == simhash.fingerprint(TEXT[r["doc_id"]]) for r in rows)
    assert groups[1] == groups[2] == groups[None] == 1 and groups[3] == groups[4] == groups[10] == 3 and groups[7] == 7


def test_ids(spark, folder):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for k, r in by_text(QUERIES["op7_byte_bpe"](spark, folder).collect()).items():
        ids = theirs.encode_ordinary(TEXT[k])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TEXT[k].encode()).hexdigest())


def test_secrets(spark, folder):
    for k, r in by_text(QUERIES["op8_secret_scan"](spark, folder).collect()).items():
        base, every = slow_spans(TEXT[k])
        assert r["spans"] == ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in every)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, kind, e in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == kind for x in base) for kind in secrets.BASE)


def test_media(spark, folder):
    rows = QUERIES["op9_media_columns"](spark, folder).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        payload = media.padded(TEXT[r["doc_id"]].encode())
        picture = media.png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(TEXT[r["doc_id"]].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(picture), hashlib.sha256(picture).hexdigest(), media.feature_of(payload))


def test_languages(spark, folder):
    rows = QUERIES["op10_language_id"](spark, folder).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("en" if any(c.isalpha() for c in TEXT[r["doc_id"]]) else language_id.UNDETERMINED)


def test_stages_without_rows_and_with_odd_ones(spark, folder, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).count() == 0
        found = stage(spark, docs, folder)
        assert found.count() or name == "quality_rules"
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns
    assert corpus_pipeline.run(spark, empty).count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert kept == {None, 1, 3, 7, 8, 9, 11}  # 5 repeats the shingles of 1


def test_quality_threshold_is_of_trusted_texts(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    ratios, threshold = quality.fit(docs, labels)
    assert len(ratios) == quality.BUCKETS and threshold > float("-inf")


def test_shared_folder(spark):
    assert common.shared_dir(spark).endswith(spark.sparkContext.applicationId)


def test_shared_folder_is_refused_where_executors_would_not_share_it(spark, monkeypatch, tmp_path):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Elsewhere)
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert common.materialise(spark.range(3), "three").count() == 3 and (tmp_path / "shared").exists()
    common.release(spark)
    assert not (tmp_path / "shared").exists()
