"""Archives and token files: exact round trips."""
import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineaweave.llm import simple8b, token_files, warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, starts = simple8b.pack(v)
    assert (simple8b.unpack(words, starts, len(v)) == v).all()
    assert len(starts) == -(-len(v) // simple8b.BLOCK)
    for k in range(len(starts)):  # any block alone
        end = starts[k + 1] if k + 1 < len(starts) else len(words)
        own = v[k * simple8b.BLOCK:(k + 1) * simple8b.BLOCK]
        assert (simple8b.unpack(words[starts[k]:end], np.array([0]), len(own)) == own).all()


def test_simple8b_is_compact():
    assert len(simple8b.pack(np.ones(simple8b.BLOCK, np.uint64))[0]) == 5


def test_token_files(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = token_files.tokenize_to_files(docs, 2).orderBy("start").collect()
    tokenizer = token_files.BatchEncoder().tokenizer
    texts = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, t) in zip(got, texts, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.tokenize_to_files(docs.where("doc_id < 0"), 2).count() == 0


def test_cut_token_file_is_an_error():
    out = io.BytesIO()
    out.write(token_files.MAGIC)
    token_files.write_segment(out, [np.arange(500)], [1])
    with pytest.raises(ValueError):
        list(token_files.read_segments(io.BytesIO(out.getvalue()[:-3])))


PAGES = "page_id long, url string, html string, digest string, id int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(3)


def test_warc_round_trip(spark):
    long, other = "é<p>" * 60, "y" * 300_000
    rows = [(5, "http://a/x", long), (3, None, long), (9, "http://a/ö\r\nX: 1", long), (4, "u", None), (6, "u", ""),
            (7, "u", "short"), (8, "u", "short"), (None, "u", long), (11, "u", other), (12, "u", other), (12, "u", other)]
    folder = warc.scratch(spark, "test")
    files = warc.write_warc(pages(spark, rows), folder)
    got = warc.read_warc(files, with_payload=True).collect()
    assert len(got) == len(rows)
    first = {long: 3, other: 11}
    for r in got:
        i = None if r["page_id"] is None else int(r["page_id"])
        text = next(t for p, _, t in rows if p == i) or ""
        assert r["payload_bytes"] == len(text.encode())
        assert r["payload_digest"] == hashlib.sha256(text.encode()).hexdigest()
        visits = text in first and first[text] != i
        assert r["record_type"] == ("revisit" if visits else "response")
        assert r["refers_to"] == (str(first[text]) if visits else None)
        assert bytes(r["payload"]) == (b"" if visits else text.encode())
    assert warc.archive_pages(pages(spark, rows).where("page_id < 0")).count() == 0


def test_warc_members_and_errors():
    digest = hashlib.sha256(b"hello").hexdigest()
    one, two = (warc.make_record(p, "http://x/", b"hello", digest, f) for p, f in (("1", None), ("2", "1")))
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")  # a member alone is a gzip file
    kinds = [h["warc-type"] for h, _, _ in warc.read_records(io.BytesIO(one + two))]
    assert kinds == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO((one + two)[:-9])))
    wrong = warc.make_record("1", None, b"hello", "0" * 64, None)
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.read_records(io.BytesIO(wrong)))
