"""Texts that hold the tokenizer file's added token."""

import zlib

import numpy as np
import public_tokenizers


def test_added_tokens_inside_texts_are_the_librarys(spark, monkeypatch):
    from tokenizers import Tokenizer

    from sessionloom.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["plain first text", "a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|><|endoftext|>\n x", "<|endoftext", "long " * 300 + "<|endoftext|>", None, ""]
    assert 50256 in tok.encode(texts[1], add_special_tokens=False).ids
    want = set()
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        want.add((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    out = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in out} == want
    monkeypatch.setattr(packing, "ENCODED", 20)
    assert [len(x) // 4 for x in packing._Encoder(path)([t or "" for t in texts])] == [n - 1 for _, n, _ in sorted(want)]
