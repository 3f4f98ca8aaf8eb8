from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_documents, odd_documents
from pyspark.sql import functions as F

from riskloom.llm import pieces
from riskloom.llm.queries import QUERIES, tokenizer

FILE = tokenizer("piece_bpe_32k.model")
MODEL = pieces.Model(FILE)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)


def ids_of(blob):
    return np.frombuffer(blob, "<u4").tolist()


def check(texts):
    got = [ids_of(b) for b in pieces.encode_texts(MODEL, texts)]
    assert got == LIBRARY.encode(texts)
    for ids in got:
        assert pieces.decode_ids(MODEL, np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


def test_cases():
    check(["", " ", "   ", "Hello  world\n a\tb ", " x", "a\0b", "▁x", "日本 😀 é é", "\n\n", "x\n", "\nx", "a" * 300,
           "ab" * 500 + " " + "9" * 250, "word " * 50, "                                      deep"])


def test_long_part_from_a_heap():
    rng = random.Random(4)
    check(["".join(rng.choice("abcdefgheinrst") for _ in range(3000)), "the" * 900])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\teainrst"))), max_size=6))
def test_equals_the_library(texts):
    # Carriage returns and other controls are ordinary characters here.
    check(texts)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r["doc_id"]: np.array(i, "<u4").tobytes() for r, i in zip(docs, LIBRARY.encode([r["text"] or "" for r in docs]))}
    rows = QUERIES["op7_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = want[r["doc_id"]]
        assert (r["n_ids"], r["ids_crc32"], r["round_trip"]) == (len(ids) // 4, zlib.crc32(ids), True)


def test_suffix_order_and_occurrences():
    codes = np.array([ord(c) + 1 for c in "the then\0 other the"], np.int64)
    codes[8] = 0
    order = pieces.suffix_array(codes, MODEL.width)
    tails = [tuple(codes[i:i + MODEL.width].tolist()) for i in order]
    assert tails == sorted(tails)
    low, high = pieces.occurrences(MODEL, codes, order)
    text = "the then\1 other the"
    for k in np.flatnonzero(high > low):
        piece = LIBRARY.id_to_piece(int(MODEL.ids[k]))
        assert sorted(order[low[k]:high[k]].tolist()) == [i for i in range(len(text)) if text.startswith(piece, i)]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = pieces.encode(docs, FILE).select("*", pieces.decode(F.col("ids"), FILE).alias("back")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert ids_of(r["ids"]) == LIBRARY.encode(r["text"]) and r["back"] == r["text"].replace("▁", " ")
    assert pieces.encode(no_documents(spark), FILE).count() == 0


def test_remembered_parts_give_the_same(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 2)
    check(["one two three", "three two one four"])
    check(["four four one"])


def test_pieces_of_any_length_are_found():
    words = ["a" * 63, "a" * 64, "a" * 65, "b" * 130, "ab"]
    model = pieces.Model.__new__(pieces.Model)
    model.ids, model.lengths = np.arange(len(words)), np.array([len(w) for w in words])
    model.width = 130
    model.codes = np.zeros((len(words), model.width), np.int64)
    for row, word in enumerate(words):
        model.codes[row, :len(word)] = [ord(c) + 1 for c in word]
    text = "a" * 70 + "b" * 140
    edges = pieces._Edges(model, np.array([ord(c) + 1 for c in text], np.int64))
    for size in (2, 63, 64, 65, 66, 129, 130, 131):
        start = np.arange(len(text) - size + 1)
        want = [words.index(text[i:i + size]) if text[i:i + size] in words else -1 for i in start]
        assert edges.find(start, start + size).tolist() == want


def test_other_kinds_of_models_are_refused(tmp_path):
    content = open(FILE, "rb").read()
    assert pieces.model_kind(content) == "bpe"
    # A file whose settings name another kind, or none (the format's default).
    for spec, kind in ((b"\x18\x01", "unigram"), (b"", "unigram"), (b"\x18\x04", "char"), (b"\x0a\x01x\x18\x03", "word")):
        path = tmp_path / f"{kind}{len(spec)}.model"
        path.write_bytes(b"\x12" + bytes([len(spec)]) + spec)
        with pytest.raises(ValueError, match=kind):
            pieces.Model(str(path))
