"""Archives and token files: exact round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weirflow.llm import token_files, warc
from weirflow.llm.common import new_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
PAGES = "page_id long, url string, html string, kind string, response string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def captures(spark, df):
    folder = new_dir(spark, "warc")
    names = warc.write_archives(df, folder)
    return warc.resolved(warc.assemble(warc.read_records(spark, folder, names)), F.col("metadata.fields")["page-id"].try_cast("long")).select(
        F.col("metadata.fields")["page-id"].try_cast("long").alias("page_id"), F.col("metadata.fields")["payload-length"].cast("long").alias("n"),
        "response.*", F.col("request.fields")["request-line"].alias("line"), "original",
    )


def test_warc_round_trip(spark):
    big, large, other = "é" * 600, "b" * 3_000_000, "o" * 1000
    rows = [(1, "http://a.example/x?y=1", big), (2, "http://b.example/", big), (3, None, None), (4, "", ""), (5, "http://c.example", "small"), (6, "http://d.example/\r\nX", "small"), (None, "http://e.example/", big), (7, "u", large), (8, "u", "WARC/1.1\r\n\r\n\r\n"), (2, "http://b.example/", big)]
    rows += [(20, "http://f.example/a\r\nb", other), (21, "v", other), (22, "v", other)]
    got = captures(spark, pages(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, _, t in rows}
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got)
    for r in got:
        raw = text[r.page_id].encode()
        assert (r.n, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        keeps = 2 if raw == big.encode() else 22 if raw == other.encode() else None
        revisit = keeps is not None and r.page_id != keeps
        assert r.kind == ("revisit" if revisit else "response")
        assert r.original == (keeps if revisit else None)
        # a record that is named is there; two rows share page 2, so that neither can be named
        assert (r.refers_to is not None) == (revisit and keeps == 22)
        assert r.refers_to is None or (ids[r.refers_to].page_id, ids[r.refers_to].kind) == (22, "response")
        assert revisit or bytes(r.payload) == raw
    assert {r.line for r in got if r.page_id == 1} == {"GET /x?y=1 HTTP/1.1"}
    assert {r.line for r in got if r.page_id == 20} == {"GET /ab HTTP/1.1"}


def test_warc_empty(spark):
    assert captures(spark, pages(spark, [])).count() == 0


def test_warc_moves_only_payloads_that_stay(spark):
    """Of repeated payloads just the kept rows, and what the filters take for such, carry their text."""
    rows = [(i, "u", f"{i % 7}" * 1500) for i in range(700)] + [(1000 + i, "u", f"{i:04d}" * 400) for i in range(50)]
    got = warc.decide(pages(spark, rows), "page_id", "html").collect()
    assert len(got) == 750
    for r in got:
        keep = max(k for k in range(700) if k % 7 == r.page_id % 7) if r.page_id < 700 else None
        assert r.keep_id == keep and r.revisit == (keep is not None and keep != r.page_id) and (r.html is None) == r.revisit and r.size in (1500, 1600)


def test_warc_keeps_unrepeated_payloads_that_a_filter_takes_for_repeated(spark):
    rows = [(i, "u", f"{i // 2:06d}" * 170) for i in range(6000)] + [(10_000 + i, "u", f"x{i:05d}" * 170) for i in range(1000)]
    got = captures(spark, pages(spark, rows)).select("page_id", "kind", "original").collect()
    assert len(got) == 7000
    for r in got:
        keep = r.page_id | 1 if r.page_id < 6000 else r.page_id
        assert (r.kind, r.original) == (("response", None) if r.page_id == keep else ("revisit", keep)), r


DOCS = "doc_id long, text string, start string, part int"


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"], "x", 1) for r in real]
    rows += [(10_001, None, "x", 1), (10_002, "", "x", 1), (10_003, " \n", "x", 1), (10_004, "don't STOP’s  <|endoftext|> 42é́ x\x1cy", "x", 1), (10_004, "aa", "x", 1), (None, "null id", "x", 1), (10_005, "word " * 50_000, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    folder = new_dir(spark, "tokens")
    parts = token_files.write_files(docs, folder, path, seq_len=64)
    got = token_files.read_documents(spark, folder, parts).collect()

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    at, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    # random access: the sequences joined under their masks are the stream
    stream = []
    for part, _, n in parts:
        f = token_files.TokenFile(folder, f"part-{part:06d}.arrow")
        pieces = [f.sequence(k) for k in range(-(-n // 64))]
        stream += [x for ids, mask in pieces for x in ids[mask].tolist()]
    assert len(stream) == at and zlib.crc32(np.array(stream[: want[0][2]], "<u4").tobytes()) == want[0][3]


def test_token_files_empty(spark):
    folder = new_dir(spark, "tokens")
    parts = token_files.write_files(spark.createDataFrame([], DOCS), folder, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_documents(spark, folder, parts).count() == 0


def test_words_of_letters_together():
    """Joined words get the ids that each has alone, in far fewer texts for the library."""
    import random

    rng = random.Random(1)
    odd = ["".join(rng.choices("ab ΣσİßǅﬁéÉ漢字\n  zq1|'s ́ẞ\U0001f600٣ªm", k=rng.randint(0, 60))).encode() for _ in range(500)] + [b"", "ΟΔΟΣ İstanbul ﬁn don't <|endoftext|>x".encode()]
    plain_words = [" ".join("".join(rng.choices("abcdefghijké", k=rng.randint(1, 9))) for _ in range(5000)).encode()]
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, whole, seen = token_files.Encoder(path), token_files.Encoder(path, whole=True), []
    real = enc.tok

    class Tok:
        def encode_batch_fast(self, words, **more):
            seen.extend(words)
            return real.encode_batch_fast(words, **more)

    enc.tok = Tok()
    for texts in (plain_words, odd, odd + plain_words):
        for got, want in zip(enc.encode(texts), whole.encode(texts), strict=True):
            assert got.tolist() == want.tolist()
        if texts is plain_words:
            assert len(seen) * 20 < len(enc.number)
