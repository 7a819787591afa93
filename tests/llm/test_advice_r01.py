"""Cases in which the operators once did less than the whole job."""

import base64
import gzip
import zlib

import numpy as np


import corpus_pipeline
from maskwright.llm import packing, queries, secrets


def spans(text):
    base, added, _, _ = secrets.scan(text)
    return [x[:3] for x in (*base, *added)]


def masked(text):
    return secrets.cover(text, [x[1:] for x in spans(text)], "#")


def test_secret_encoded_twice():
    url, b64 = "%74oken%3Dabcdefgh1", base64.b64encode(b"password=hunter2222 and more").decode()
    assert masked(f"a {url} b {url}") == "a # b #"
    assert len(spans("\n- ".join([b64] * 5))) == 5


def b64(raw):
    return base64.b64encode(raw).decode()


def test_layers_of_any_bytes():
    assert masked("x q=caf%E9&password%3Dhunter2222 y") == "x q=caf%E9&# y"
    for raw in (b"\xff\xfe\x00\x1b token=abcdefgh1 \x0c", b"token=abcdefgh1\0\0"):
        assert len(spans(b64(raw))) == 1
        assert [x[0] for x in spans(b64(gzip.compress(raw)))] == ["assign"]


def test_packed_to_the_end(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 100_000)
    monkeypatch.setattr(secrets, "BLOCK", 10_000)
    secret = b"token=abcdefgh1"
    members = gzip.compress(b"nothing") + gzip.compress(b"") + gzip.compress(secret)
    assert len(spans(b64(members))) == len(spans(b64(zlib.compress(b"\xc3\xa9\n" * 100_000 + secret)))) == 1
    big = b64(gzip.compress(gzip.compress(b"a " * secrets.PIECE + secret + b" " + b"z" * 100)))
    assert [x[0] for x in spans(big)] == ["assign"]
    packed = gzip.compress(secret + b" " + bytes(range(256)) * 40)
    assert secrets.scan(b64(packed[:-9]))[3] == 1 and len(spans(b64(packed[:-9]))) == 1
    parts = [bytes([65 + k % 26]) * 700 + b" token = abcdefgh" + b"%d " % k for k in range(2_000)]
    made = list(secrets._pieces(iter([b"".join(parts)[k : k + 99_999] for k in range(0, 2_000 * 725, 99_999)])))
    assert len(made) > 1 and sum(len(secrets.find(x.decode())) for x in made) == 2_000


def test_base64_in_any_phase_and_wrapped():
    secret = b"token=abcdefgh"
    assert b64(secret) == "dG9rZW49YWJjZGVmZ2g=" and masked(f"x {b64(secret)} y") == "x # y"
    for raw in (b"password=hunter2222", zlib.compress(b"password=hunter2222"), gzip.compress(b"password=hunter2222")):
        for k in range(9):
            for before in ("https://h.example/", "id-", "a_", "b+"):
                assert len(spans(before + "r" * k + "/" + b64(raw) + " z")) == 1
    for raw in (b"- " * 21 + b"password=hunter2222 " + b"- " * 50, gzip.compress(np.random.default_rng(1).choice(list(b"nopqrst "), 600).astype(np.uint8).tobytes() + b" password=hunter2222")):
        for feed in ("\n", "\r\n    "):
            text = "Key:\n" + feed.join(b64(raw)[k : k + 60] for k in range(0, len(b64(raw)), 60)) + "\nend"
            assert [x[0] for x in spans(text)] == ["assign"]


def test_base64_documents_are_scanned(spark):
    rows = [(1, "dG9rZW49YWJjZGVmZ2g="), (2, "plain"), (3, "dG9rZW49YW\n  JjZGVmZ2g="), (4, "dG9rZW49YW"), (5, "JjZGVmZ2g=")]
    got = {r.doc_id: len(r.added) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def test_packing_by_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = {1: "unbelievable transmogrification", 2: "ab12" * 9000, 3: None, 4: "", 5: "日本語 é x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {k: len(own.encode(t or "", add_special_tokens=False).ids) for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in queries.op8_packing(spark, str(tmp_path)).collect()} == want
    got = corpus_pipeline.pack_batches(spark, docs, "").collect()
    assert {r.doc_id: r.n_ids for r in got} == want and all(r.n_ids <= r.bucket_len for r in got)


def test_packing_bounds_are_lengths(spark):
    got = packing.pack(spark.createDataFrame([(k, 9) for k in range(5)], "doc_id long, n long"), length=packing.F.col("n"), budget=18).collect()
    assert {(r.bucket_len, r.batch) for r in got} == {(9, 0), (9, 1), (9, 2)}
