"""WARC, URL lists, token files: round trips and defined edge cases."""

import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from threadline.llm import tokenfile, urlfilter, warc
from threadline.llm.common import scratch


def test_warc_round_trip(spark):
    rows = [(1, "http://a.b/", "same"), (5, "http://a.b/2", "same"), (5, "http://a.b/2", "same"), (2, None, None), (None, "http://c/", "é" * 9000), (9, "u", "")]
    p = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.read_archives(warc.write_archives(warc.with_revisits(p, "page_id", "url", "html"), scratch(spark, "warc"))).collect()
    by = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload or b"").decode()) for r in got)
    assert by == [(-1, "response", None, 18000, "é" * 9000), (1, "revisit", 5, 4, ""), (2, "revisit", 9, 0, ""), (5, "response", None, 4, "same"), (5, "response", None, 4, "same"), (9, "response", None, 0, "")]
    assert all(r.payload_digest == warc.sha1_base32({1: b"same", 5: b"same", 2: b"", 9: b"", None: ("é" * 9000).encode()}[r.page_id]) for r in got)


def test_warc_empty(spark):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(p, "page_id", "url", "html"), scratch(spark, "warc"))).count() == 0


@pytest.mark.parametrize("broken", [lambda r: r.replace(b"WARC/1.1", b"WARC/2.0"), lambda r: r[:-1], lambda r: r.replace(b"abc", b"abd"), lambda r: r.replace(b"WARC-Date", b"WARC-Dat"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1)])
def test_warc_checks(broken):
    good = warc.build_record(1, "u", b"abc", warc.sha1_base32(b"abc"), None, False, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(broken(good))


def test_warc_compressed_dictionary_and_cut_frames():
    d = zstandard.ZstdCompressionDict(b"hello world " * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = zstandard.ZstdCompressor().compress(d.as_bytes())
    got = warc.read_dictionary(struct.pack("<II", warc.DICT_MAGIC, len(body)) + body)
    frame = zstandard.ZstdCompressor(dict_data=d).compress(b"hello world hello")
    parts = iter([frame + frame[:5]])
    with pytest.raises(ValueError):
        list(warc.frames(lambda n: next(parts, b""), len(frame) + 5, got, "t"))


def test_url_lists_as_of_fetch_time(spark):
    cap = spark.createDataFrame(
        [(1, "http://x.bad.com/a", "2024-01-05"), (2, "http://x.bad.com/a", "2024-02-05"), (3, "https://u@BAD.com:80/", "2024-03-02"), (4, None, "2024-01-05"), (5, "http://ok.org", None), (1, "http://x.bad.com/a", "2024-01-05"), (6, "http://x.bad.com", "2024-01-01")],
        "id int, url string, d string",
    ).selectExpr("id", "url", "cast(d as timestamp) fetched", "'mine' as reason")
    ch = spark.createDataFrame([("l", "bad.com", "2024-01-02", "add"), ("l", "bad.com", "2024-02-01", "remove"), ("l", "bad.com", "2024-03-01", "add"), ("k", "x.bad.com", "2024-02-04", "add"), ("l", None, "2024-01-01", "add")], "list_name string, pattern string, e string, action string").selectExpr("list_name", "pattern", "cast(e as timestamp) effective", "action")
    got = sorted((r.id, r.blocked, r.pattern, r.reason) for r in urlfilter.judge(cap, ch).collect())
    assert got == [(1, True, "bad.com", "listed"), (1, True, "bad.com", "listed"), (2, True, "x.bad.com", "listed"), (3, True, "bad.com", "listed"), (4, False, None, "no host"), (5, False, None, "no time"), (6, False, None, "not listed")]
    assert urlfilter.judge(cap.limit(0), ch).count() == 0 and urlfilter.judge(cap, ch.limit(0)).filter("blocked").count() == 0


def test_url_hosts_that_are_addresses(spark):
    urls = ["http://[::1]:8/a", "http://u@[2001:DB8::2]/", "http://10.0.0.5:80/x", "http://a.b.co.uk./", "http://1.2.3.4.example", "ftp://x", "no url", None]
    got = [r.s for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").coalesce(1).select(urlfilter.suffixes(urlfilter.host_of(F.col("url"))).alias("s")).collect()]
    assert got[:6] == [["[::1]"], ["[2001:db8::2]"], ["10.0.0.5"], ["a.b.co.uk", "b.co.uk", "co.uk"], ["1.2.3.4.example", "2.3.4.example", "3.4.example", "4.example"], ["x"]]
    cap = spark.createDataFrame([(1, "http://10.0.0.5/"), (2, "http://[::1]:8/a"), (3, "http://z.0.5")], "id int, url string").selectExpr("id", "url", "timestamp'2024-02-01' as fetched")
    ch = spark.createDataFrame([("l", "0.5", "add"), ("l", "[::1]", "add")], "list_name string, pattern string, action string").selectExpr("list_name", "pattern", "timestamp'2024-01-01' as effective", "action")
    assert {r.id: r.blocked for r in urlfilter.judge(cap, ch).collect()} == {1: False, 2: True, 3: True}


def test_token_files(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = [(3, "it's 12 x²  y\n\n z"), (1, None), (2, "<|endoftext|> a"), (7, "word " * 5000), (None, "n"), (3, "a second")]
    out = scratch(spark, "tok")
    tokenfile.write_token_files(tokenfile.encode_ids(spark.createDataFrame(texts, "doc_id long, text string"), path, end_id=2), out)
    t, want, at = Tokenizer.from_file(path), [], 0
    for i, x in sorted(((-1 if i is None else i), x or "") for i, x in texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.starts_and_digests(spark, out).collect())
    assert got == sorted(want)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) for r in tokenfile.token_index(spark, out).collect()) == sorted(w[:3] for w in want)
    assert sorted(len(r.ids) for r in tokenfile.read_token_files(spark, out, 2, 3).collect()) == sorted(w[2] for w in want if w[0] in (2, 3))


def test_token_parts_against_the_library():
    P = pytest.importorskip("public_tokenizers")
    enc = tokenfile.PartEncoder(P.path("byte_bpe_50k.json"))
    random.seed(3)
    bits = ["'s", "'t", "'", "'ll", " ", "  ", "\n", "\n\n", "\t", " \n", "a", "the", "don", "12", "3", "²", "½", ".", "...", "!?", "é", "ß", "×", "÷", "\u00a0", "\u3000", " ", "日本", "—", "“", "😀", "\x1c", "\x85", "ǅ", "ñ", "x_y", "|", "Ⅷ", "ȡ", "ɐ"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(4000)] + ["", "the " * 30000]
    for run in (texts[:2000], texts[2000:], texts[:2000], ["<|endoftext|>a", " b"]):
        ids, count = enc.encode(run, 2)
        want = [e.ids + [2] for e in enc.tokenizer.encode_batch(run, add_special_tokens=False)]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_cache_has_a_bound(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokenfile, "CACHE_BYTES", 20_000)
    enc = tokenfile.PartEncoder(P.path("byte_bpe_50k.json"))
    for k in range(30):
        run = [f"word{k}x{i} same" for i in range(100)]
        ids, count = enc.encode(run)
        assert ids.tolist() == [i for e in enc.tokenizer.encode_batch(run, add_special_tokens=False) for i in e.ids]
        assert len(enc.known) + len(enc.old) < 900


@pytest.mark.parametrize("delta", [True, False])
def test_token_files_allow_selective_reads(spark, delta):
    P = pytest.importorskip("public_tokenizers")
    out = scratch(spark, "tok")
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(concat('w', id % 97, ' and '), 400) as text", "'x' as ids", "1 as part", "2 as n_tokens")
    tokenfile.write_token_files(tokenfile.encode_ids(docs, P.path("byte_bpe_50k.json"), end_id=2), out, row_group_mb=1, page_kb=16, delta=delta)
    plan = tokenfile.token_index(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split(chr(10))[0]
    ranged = tokenfile.read_token_files(spark, out, 100, 120)
    assert "GreaterThanOrEqual(doc_id,100)" in ranged._jdf.queryExecution().executedPlan().toString() and ranged.count() == 21
    groups = total = 0
    for f in sorted(Path(out.removeprefix("file://")).glob("*.parquet")):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            c = {m.row_group(g).column(i).path_in_schema: m.row_group(g).column(i) for i in range(m.num_columns)}
            groups += c["doc_id"].statistics.min <= 120 and c["doc_id"].statistics.max >= 100
            ids = next(v for k, v in c.items() if k.startswith("ids"))
            assert ids.has_offset_index and c["doc_id"].has_column_index and c["n_tokens"].has_column_index
            assert ("DELTA_BINARY_PACKED" in ids.encodings) == delta and any("DICTIONARY" in e for e in ids.encodings) != delta
            total += 1
    assert groups <= 2 and total >= 4  # the others are skipped by their statistics


def test_token_files_empty(spark):
    P = pytest.importorskip("public_tokenizers")
    out = scratch(spark, "tok")
    tokenfile.write_token_files(tokenfile.encode_ids(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json"), end_id=2), out)
    assert tokenfile.starts_and_digests(spark, out).count() == 0 and tokenfile.token_index(spark, out).count() == 0
