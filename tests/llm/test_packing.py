import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheafline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODE = packing.Encoder(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_is_the_library(text):
    assert ENCODE(text) == library_ids(text)


@pytest.mark.parametrize("text", ["a <|endoftext|>b  c", "<|endoftext|>" * 3, "x" * 30000, " " * 5000 + "z", "\n\n \t  it's I'LL", "日本語" * 500, " \x85\x1c\x00", "👩‍👩‍👧 ﬁ Ǆ"])
def test_encoder_on_odd_texts(text):
    assert ENCODE(text) == library_ids(text)


def check_pieces(rows, docs, tiers):
    """Every id in exactly one piece, no gaps, windows within limits; returns padding."""
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_window[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for key, ids in docs.items():
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert bytes(r.ids) == np.array(ids[at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tiers[-1]
        padding += 0 if at & (at - 1) == 0 else tiers[-1] - at
    return padding


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: [*library_ids(r.text), 1] for r in docs.collect()}
    rows = packing.pack_documents(docs, PATH).collect()
    assert check_pieces(rows, want, packing.TIERS) == 0
    # the query may read other partitions, so its own pieces are held against the library
    digests = packing.op1_pack_documents(spark, sf).collect()
    at, offset = dict.fromkeys(want, 0), defaultdict(int)
    for r in sorted(digests, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {k: len(v) for k, v in want.items()}
    for r in sorted(digests, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == offset[r.sequence_id]
        offset[r.sequence_id] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in offset.values())


def test_small_pools_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL_TOKENS", 3000)
    rng = random.Random(2)
    texts = [None, "", " ", *(" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 40, 600, 5000]))) for _ in range(80))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, start int, ids string").repartition(3)
    want = {i: [*library_ids(t), 1] for i, t in enumerate(texts)}
    # pools are set on the driver, so call the packer in this process
    windows, rest = packing.pack_pool([len(v) for v in want.values()], packing.TIERS, True)
    assert not rest and all(sum(p[2] for p in pieces) == size for size, pieces in windows)
    rows = packing.pack_documents(df, PATH).collect()
    assert check_pieces(rows, want, packing.TIERS) == 0
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    same = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack_documents(same, PATH).collect()) == 9


def test_pool_rest_is_less_than_a_window():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [rng.randint(1, 5000) for _ in range(rng.randint(1, 200))]
        windows, rest = packing.pack_pool(lengths, packing.TIERS, False)
        assert sum(x[2] for x in rest) < 2048
        assert sum(s for s, _ in windows) + sum(x[2] for x in rest) == sum(lengths)


def test_short_pieces_stay_whole_and_steps_are_even():
    rng = random.Random(7)
    lengths = [int(rng.lognormvariate(6, 1)) + 1 for _ in range(4000)]
    windows, _ = packing.pack_pool(lengths, packing.TIERS, True)
    assert {s for s, _ in windows} >= {2048}
    cut = sum(len(p) for _, p in windows) - sum(-(-n // 2048) for n in lengths)
    assert cut < 0.2 * len(lengths)
    groups = packing.step_groups(windows, 16 * 2048)
    tokens = defaultdict(int)
    for g, (s, _) in zip(groups, windows, strict=True):
        tokens[g] += s
    assert max(tokens.values()) <= 16 * 2048 and min(tokens.values()) > 0.85 * 16 * 2048
