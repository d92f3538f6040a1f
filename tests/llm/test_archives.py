"""Web archives: write, read back and merge; and the whole pipeline against its parts."""

import gzip
import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rowloom.llm import quality, warc
from rowloom.llm.queries import tokenizer_json
from tests.llm.test_tokens import check_packing


def test_loser_tree():
    random.seed(1)
    for k in range(9):
        runs = [sorted((f"u{random.randint(0, 5)}", "d", str(random.randint(0, 99))) for _ in range(random.randint(0, 12))) for _ in range(k)]
        runs = [sorted(r, key=warc._order) for r in runs]
        merged = [*warc.LoserTree(runs)]
        assert merged == sorted((x for r in runs for x in r), key=warc._order)


@pytest.mark.parametrize(("url", "key"), [("http://www.Example.com:80/a?b#c", "com,example)/a?b"), ("https://x.org:8443", "org,x:8443)/"), (None, ""), ("not a url", "not a url"), ("http://[bad", "http://[bad")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_archive(spark):
    big, other = "<p>é\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 100, "y" * 100
    pages = [(7, "http://a.com/", big), (3, "http://a.com/", big), (9, "http://b.com/\r\nInjected: 1", big), (4, None, other), (5, "http://c.com", "short"), (6, "http://c.com", "short"), (1, "http://z.com", None), (2, "http://z.com", ""), (8, "http://d.com", other), (8, "http://d.com", other)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, digest string").repartition(4)
    found = warc.archive(df).collect()
    first = {}
    for k, _, h in pages:
        b = (h or "").encode()
        first[b] = min(first.get(b, k), k)
    want = []
    for k, _, h in pages:
        b = (h or "").encode()
        f = first[b] if len(b) >= 100 else k
        want.append((str(k), len(b), hashlib.sha256(b).hexdigest(), "response" if f == k else "revisit", None if f == k else str(f)))
    assert sorted((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or "") for r in found) == sorted((*w[:4], w[4] or "") for w in want)
    order = [(r["url_key"], r["date"], len(r["record_id"]), r["record_id"]) for r in found]
    assert order == sorted(order)
    assert warc.archive(df.filter("false")).count() == 0


@pytest.mark.parametrize(("file_bytes", "per_range"), [(2000, 7), (16 << 20, 50_000)])
def test_members_can_be_sought(spark, monkeypatch, file_bytes, per_range):
    """A capture's file, offset and length find its record; many files and ranges give the same history."""
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(warc, "RANGE", per_range)
    random.seed(2)
    pages = [(f" k {i}\r\n%é", f"http://h{i % 3}.com/{i % 5}", "".join(random.choices("abc é\r\n", k=random.choice([0, 50, 3000]))), None if i % 2 else f"2020-01-0{i % 7 + 1}") for i in range(60)]
    pages += [("long", " http://h.com\n", "z" * 3_000_000 + "é", "2020"), (None, None, "q" * 200, None)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string, day string").repartition(3)
    path = warc.write(df, date="day")
    runs = warc.captures(spark, path)
    found = warc.merge(runs).collect()
    assert sorted((r["record_id"] or "", r["payload_bytes"]) for r in found) == sorted((k or "", len(h.encode())) for k, _, h, _ in pages)
    order = [(r["url_key"], r["date"], len(r["record_id"] or ""), r["record_id"] or "") for r in found]
    assert order == sorted(order)
    text = {k or "": h for k, _, h, _ in pages}
    files = {r["path"]: bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").collect()}
    assert len(files) > 8 if file_bytes == 2000 else len(files) <= 3
    for r in found:
        headers, block = warc.record_at(files[r["file"]], r["offset"], r["length"])
        assert headers["warc-type"] == r["record_type"]
        if r["record_type"] == "response":
            assert block.partition(b"\r\n\r\n")[2] == text[r["record_id"] or ""].encode()
    for content in files.values():  # a file is a whole gzip file
        assert sum(1 for _ in warc.records(gzip.decompress(content))) == sum(1 for _ in warc.members(content))


def test_damaged_archives_raise():
    good = warc.packed(warc.record("1", None, "2020", hashlib.sha256(b"x").hexdigest(), b"x"))
    (member, *_), = warc.members(good)
    ((headers, block, *_),) = warc.records(member)
    assert warc.capture_of(headers, block, "here")[2:8] == ("1", None, "response", None, 1, hashlib.sha256(b"x").hexdigest())
    with pytest.raises(ValueError, match="differs"):
        warc.capture_of(headers, block + b"y", "here")
    with pytest.raises(ValueError, match="doesn't end"):
        [*warc.members(good[:-3])]


def test_pipeline(spark, tmp_path):
    """Clean documents stay, one of each group of copies; junk goes; secrets are replaced; all is packed."""
    random.seed(4)
    stems = {"en": ["the", "and", "ing", "er", "wh", "on"], "de": ["sch", "ein", "ung", "der", "keit", "ber"]}
    text = lambda lang, n: " ".join("".join(random.choices(stems[lang], k=random.randint(1, 3))) for _ in range(n))
    rows = [(i, text("en" if i % 3 else "de", 120), "en" if i % 3 else "de", f"s{i % 2}", 0) for i in range(90)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(10)]  # exact copies
    rows += [(300 + i, f"%%% {i} ### " * 40, "en", "s0", 0) for i in range(5)]
    rows += [(400, text("en", 120) + " password=hunter2hunter2", "en", "s1", 0), (401, None, None, None, None), (402, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(301, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(d.columns == columns for d in kept[:-1])
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert ids(kept[0]) == {*range(90), *range(200, 210), 400} and ids(kept[1]) == ids(kept[0])
    assert ids(kept[2]) == {*range(90), 400}
    safe = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    assert safe[400].endswith(" [SECRET]") and "hunter2" not in safe[400] and safe[5] == rows[5][1]
    check_packing([*safe.items()], kept[4].collect(), 1024, Tokenizer.from_str(tokenizer_json()))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()
    assert quality.BUCKETS == 1 << 13


def test_near_duplicate_stage_drops_edited_copies(spark):
    """Copies with four of 250 words changed: similarity 0.85, more than three SimHash bits."""
    random.seed(11)
    words = [f"word{random.randrange(5000)}" for _ in range(250)]
    texts = [" ".join(words)] + [" ".join(f"new{k}" if i % 60 == 9 + k else w for i, w in enumerate(words)) for k in range(4)] + [" ".join(reversed(words))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == {0, 5}


def test_near_duplicate_stage_drops_what_simhash_links(spark):
    """Texts of one repeated phrase: few shingles in common, fingerprints within three bits."""
    phrase = " ".join(f"word{i}" for i in range(41))
    texts = [" ".join([phrase] * 12 + [f"own{k}x{i}" for i in range(60)]) for k in range(3)] + [" ".join(f"other{i}" for i in range(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 3}
