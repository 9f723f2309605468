import functools
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@functools.cache
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole_ids(text):
    return whole().encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = [
    None, "", " ", "Thé end, OF it!! 42 a.b@c.org don't", "x́y Été z\x1cq <|endoftext|>ab", "İΣ 中文 \U0001f600...",
    "word " * 5000, "a" * 30000, "one two three " * 40, "\ttab\x0bvt\x0cff\r\nend", "ends: here; now?! ok",
]


def test_word_ids_match_the_whole_tokenizer():
    import pyarrow as pa

    ids, starts = packing.WordIds(PATH, most=3).batch(pa.array(TEXTS), 1)
    for i, t in enumerate(TEXTS):
        assert ids[starts[i] : starts[i + 1]].tolist() == whole_ids(t), repr(t)[:50]


def test_windows_are_full_and_cover_each_token_once():
    rng = random.Random(3)
    for n in (0, 1, 7, 300):
        sizes = [rng.choice([1, 2, 5, 255, 256, 257, 700, 1500, 2047, 2048, 2049, 9000]) for _ in range(n)]
        seen = [np.zeros(s, int) for s in sizes]
        for size, pieces in packing.fill_windows(sizes):
            assert size & (size - 1) == 0 and size <= 2048 and sum(p[2] for p in pieces) == size
            for d, at, m in pieces:
                seen[d][at : at + m] += 1
        assert all((x == 1).all() for x in seen)


def test_round_trip(spark):
    rows = [(i % 9, t, "de", "extra") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, sequence_id string")
    out = packing.pack_documents(docs, PATH).collect()
    want = sorted((str(d), len(whole_ids(t))) for d, t, _, _ in rows)
    sums = {}
    for r in out:
        sums.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for pieces in sums.values():
        at = 0
        for offset, length, total in sorted(pieces):
            assert offset == at
            at += length
        assert at == total
    assert sum(r.length for r in out) == sum(n for _, n in want)
    one = whole_ids(TEXTS[7])
    for r in out:
        if r.doc_tokens == len(one) and r.doc_id == 7:
            assert r.ids_crc32 == zlib.crc32(np.array(one[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
