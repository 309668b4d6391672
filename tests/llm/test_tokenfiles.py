"""Token files: ids against the tokenizer, exact round trips, views instead of copies."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, part int, number int, at string"  # the last three clash with names used inside


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def fixed(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS)


IDS = tokenfiles.ByteIds(PATH)
TEXTS = st.text(st.sampled_from(list(" \t\n\r.,'sdtlvermn09½²ªAéß \u0085\x1c\x1f᠎​　中́\U0001f600_-#<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_equal_the_tokenizer(text):
    want = IDS.tokenizer.encode(text, add_special_tokens=False).ids
    assert IDS.fast and IDS.of(text).tolist() == want
    found = IDS.batch(pa.array(["a b", text, f"{text} b", text, f"a\n{text}"]))
    assert [x.tolist() for x in found] == [IDS.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a b", text, f"{text} b", text, f"a\n{text}")]


def test_ids_of_special_tokens_and_documents(spark, tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext", " <|endoftext|>", "It's <|x", "", " ", "  ", " a", "a ", "a  b", "a \nb", "\n a", "é" * 3000]
    texts += [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t, found in zip(texts, IDS.batch(pa.array(texts)), strict=True):
        assert found.tolist() == IDS.of(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def test_round_trip(spark, tokenizer, tmp_path, monkeypatch):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "beta,", "Größe", "x1", "don't"]) for _ in range(r.choice([0, 1, 30, 900])))) for i in range(120)]
    rows += [(None, "none"), (None, None), (500, None), (501, ""), (7, "again"), (7, rows[7][1]), (502, "long word " * 30000), (-5, "first")] + [(600, "same")] * 50
    monkeypatch.setattr(tokenfiles, "BATCH", 3)
    docs = fixed(spark, rows).repartition(3)
    tokenfiles.write(docs, PATH, str(tmp_path / "few"), sequence=64, most=10)
    files = sorted(str(p) for p in (tmp_path / "few").glob("part-*"))
    stream = []
    for p in files:
        shard = tokenfiles.open_shard(p)
        masks = [np.array(shard.mask(i).to_pylist()) for i in range(len(shard))]
        assert all(m.all() for m in masks[:-1])
        stream += [shard.ids(i)[m].tolist() for i, m in enumerate(masks)]
        assert not shard.ids(0).flags.owndata and len(shard.ids(0)) == 64
        assert shard.reader.schema.field("ids").type == pa.list_(pa.uint16(), 64)
    assert len(files) > 4
    whole = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in {t for _, t in rows}}
    flat = [x for s in stream for x in s]
    assert len(flat) == sum(len(whole[t]) for _, t in rows)

    got = [tuple(x) for x in tokenfiles.token_files(docs, PATH, str(tmp_path / "files")).collect()]
    crc = {t: zlib.crc32(np.array(ids, "<u4")) for t, ids in whole.items()}
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted((i is not None, i or 0, len(whole[t]), crc[t]) for i, t in rows)
    at = 0
    for _, start, n, c in sorted(got, key=lambda x: x[1]):
        assert start == at and zlib.crc32(np.array(flat[start : start + n], "<u4")) == c
        at += n
    order = [(x[0] is not None, x[0] or 0) for x in sorted(got, key=lambda x: x[1])]
    assert order == sorted(order)


def test_known_words_are_bounded_and_long_ones_whole(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfiles, "KNOWN", 40)
    monkeypatch.setattr(tokenfiles, "WORD", 30)
    ids = tokenfiles.ByteIds(PATH)
    r = random.Random(9)
    for n in range(20):
        texts = [" ".join("".join(r.choice("abcäé.,'1\t") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(12))) + " x" * (n % 2) for _ in range(15)] + ["a " + "long" * 20 + " b", ""]
        assert [x.tolist() for x in ids.batch(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(ids.known.keys) <= 200 and (np.diff(ids.known.keys) >= 0).all()


def test_no_documents(spark):
    assert tokenfiles.token_files(fixed(spark, []), PATH).count() == 0


def test_wide_ids():
    docs = [(1, np.array([70000, 2], "<u4")), (None, np.array([5], "<u4")), (3, np.arange(9, dtype="<u4"))]
    shard = tokenfiles.open_shard(pa.py_buffer(tokenfiles.encode_file(docs, 4, 2, sequence=4)))
    assert (shard.part, shard.number, len(shard)) == (4, 2, 3)
    assert [(d, a, x.tolist()) for d, a, x in shard.documents()] == [(1, 0, [70000, 2]), (None, 2, [5]), (3, 3, list(range(9)))]
    assert shard.ids(1).tolist() == [1, 2, 3, 4] and shard.mask(2).to_pylist() == [True] * 4
