import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from orrery.llm import token_store
from orrery.llm.tokens import Encoder, encoder

ODD = [
    "a  b", "x \n y", " lead", "trail ", " ", "", "é ñ 'll don't  ", "a\x1cb c", "foo bar baz", "a ́b c", "I'm 12 34,5  x", "a\x1c b", "中文 测试 , ok\n\n new", "Straße İ ΑΣ ΣΑΣ b", "a\xa0 b c\x85d e",
    "foo.\nBar baz\n'll x", "a\nb", "a\n\nb", "\na", "a\tb c\rd", "<|endoftext|> x <|startoftext|>y​ z﻿ q", "a　b   c", "x\n'9", "\x1d\x1e a\x1fb",
]


def plain(name):
    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path(name)))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name, texts):
    encode, every = plain(name), ODD + list(texts.values())
    for text, raw in zip(every, encoder(name).ids(every)):
        assert np.frombuffer(raw, "<u2").tolist() == encode(text), text[:80]
    small = Encoder(str(public_tokenizers.path(name)))
    small.ids(ODD)
    assert [small.ids([t])[0] for t in ODD] == small.ids(ODD)


def test_round_trip(spark, documents, texts):
    folder = token_store.write(documents)
    encode, at = plain("word_bpe_49k.json"), 0
    rows = {r.doc_id: r for r in token_store.read(spark, folder).collect()}
    assert set(rows) == set(texts)
    for d in sorted(texts):
        ids = [*encode(texts[d]), 1]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    names = [r.name for r in spark.read.parquet(f"{folder}/manifest").collect()]
    some = sorted(texts)[0]
    found = [x for n in names for x in token_store.lookup(folder, n, some)]
    assert [x.tolist() for x in found] == [[*encode(texts[some]), 1]]


def test_dictionary_is_needed_and_helps(texts):
    raws = [r for r in encoder("word_bpe_49k.json").ids([t for t in texts.values() if len(t) < 2000])]
    shared, none = token_store.Store(token_store.train(raws)), token_store.Store(b"")
    assert sum(len(shared.pack(r)) for r in raws) < sum(len(none.pack(r)) for r in raws)
    assert all(shared.unpack(shared.pack(r)) == r for r in raws) and shared.hash != none.hash


def test_reader_refuses_another_dictionary(tmp_path):
    store = token_store.Store(b"")
    token_store.write_file(f"file://{tmp_path}/x.zids", [(5, 2, store.pack(b"\1\0\2\0"))], store.hash)
    assert token_store.Reader(f"file://{tmp_path}/x.zids", store).ids(0).tolist() == [1, 2]
    store.hash += 1
    with pytest.raises(ValueError):
        token_store.Reader(f"file://{tmp_path}/x.zids", store)


def test_edge_cases(spark, odd, empty):
    rows = token_store.read(spark, token_store.write(odd)).collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 2
    assert all(r.n_tokens == 1 and r.ids_crc32 == zlib.crc32(b"\1\0\0\0") for r in rows if r.doc_id in (2, 3, 4))
    ordered = sorted(rows, key=lambda r: (r.start, r.n_tokens))
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert token_store.read(spark, token_store.write(empty)).count() == 0


def test_one_id_fills_several_files(spark):
    """A partition that can't be split by id writes file after file."""
    docs = spark.createDataFrame([(5, f"some text of number {k} here") for k in range(400)] + [(1, "first"), (9, "last")], "doc_id long, text string")
    folder = token_store.write(docs, file_bytes=500)
    names = [r.name for r in spark.read.parquet(f"{folder}/manifest").collect()]
    assert len(names) > 3 and any(not n.endswith("-000000.zids") for n in names)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.read(spark, folder).collect())
    at = 0
    for start, _, n in rows:
        assert start == at
        at += n
    assert [d for _, d, _ in rows] == [1] + [5] * 400 + [9]
    assert sum(len(token_store.lookup(folder, n, 5)) for n in names) == 400
