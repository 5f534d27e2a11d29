import hashlib
import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohesia.llm import bpe, queries

@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.tokenizer(queries.BYTE_BPE), Tokenizer.from_file(queries.BYTE_BPE)


def test_random_text_equals_library(both):
    own, lib = both
    rnd = random.Random(3)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x600), *range(0x2000, 0x2100), *range(0x1F600, 0x1F650)]] + list("  \n aeett'") * 40
    for i in range(3000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50)))
        s = s + "<|endoftext|>" + s if i % 40 == 0 else s
        ids = own.encode(s)
        want = lib.encode(s, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids).decode("utf-8", "replace") == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("s", ["a" * 4000, " " * 3000, "ab" * 3000, "1" * 999, "aaab" * 900, "é" * 1500])
def test_long_runs(both, s):
    own, lib = both
    assert own.encode(s).tolist() == lib.encode(s, add_special_tokens=False).ids


def test_window_is_narrower_than_the_search(both, monkeypatch):
    own, lib = both
    rnd = random.Random(6)
    for width in (1, 2, 7, 64):
        monkeypatch.setattr(bpe, "WINDOW", width)
        for _ in range(60):
            s = "".join(rnd.choice("aab ehtinsrléABé") for _ in range(rnd.randint(1, 300))).replace(" ", "")
            assert own.encode_piece(s.encode()).tolist() == lib.encode(s, add_special_tokens=False).ids


def test_memory_of_a_very_long_piece(both):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = both[0].encode("a" * 3_000_000)
    assert both[0].decode(ids) == b"a" * 3_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB; tokens of 8 bytes would take 24 bytes each


def test_decode_of_broken_bytes(both):
    own, lib = both
    ids = [i for i, b in own.bytes_of.items() if len(b) == 1][100:140]
    assert own.decode(np.array(ids)).decode("utf-8", "replace") == lib.decode(ids, skip_special_tokens=False)


def test_frames(spark, odd_docs, both):
    docs = odd_docs.withColumn("tokens", F.lit("clash"))
    out = bpe.decode(bpe.encode(docs, queries.BYTE_BPE), queries.BYTE_BPE).collect()
    assert len(out) == odd_docs.count()
    assert all(r.decoded == (r.text or "") for r in out)
    again = bpe.round_trip(docs, queries.BYTE_BPE).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert bpe.round_trip(odd_docs.limit(0), queries.BYTE_BPE).count() == 0


def test_query(spark, data, both):
    lib = both[1]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, data).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
