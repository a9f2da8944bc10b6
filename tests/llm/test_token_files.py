"""Wavelet files of many chunks and widths, and the word encoder, against plain versions."""

from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ridelens.llm import shared, token_files, wavelet
from ridelens.llm.shared import prepare
from ridelens.llm.wavelet import WaveletMatrix

LETTERS = [*"ab 's't're\n\t  ' éÀ漢👍1٣!?\x1c\x85 Σ_\x00 ĸŉſ\xadʼª\xa0½", "<|endoftext|>", "<|", "  ", "'ll", "the", "aaaa", "don't", "..", "Žž€…"]


@pytest.mark.parametrize("n, width", [(0, 16), (1, 16), (5000, 16), (4096, 20), (4097, 3)])
def test_matrices_of_many_chunks(monkeypatch, n, width):
    monkeypatch.setattr(wavelet, "CHUNK", 1024)
    monkeypatch.setattr(wavelet, "OPEN", 3)
    r = np.random.default_rng(n)
    ids = r.choice(np.array([0, 1, 5, 6, (1 << width) - 1]), n)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.pack(ids, width))
    assert (matrix.all() == ids).all() and matrix.n == n
    assert all(matrix.access(i) == ids[i] for i in range(0, n, 37))
    assert len(matrix.rows[0].opened) <= 3
    for value in (0, 5, 2, (1 << width) - 1):
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places) and matrix.count(value, n // 3) == (places < n // 3).sum()
        assert matrix.find(value, len(places)) == -1
        assert all(matrix.find(value, k) == places[k] for k in range(0, len(places), 41))


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="16 bits"):
        WaveletMatrix.pack(np.array([1, 70_000]), 16)
    with pytest.raises(ValueError, match="not a wavelet"):
        WaveletMatrix.from_bytes(b"other")


@pytest.mark.parametrize("most", [60, 100_000])
def test_words_are_encoded_as_by_the_library(most):
    path = public_tokenizers.path(token_files.TOKENIZER)
    encoder, library, r = token_files.WordEncoder(path, most), Tokenizer.from_file(path), random.Random(5)
    assert len(encoder.column(pa.array([], pa.string()))[0]) == 0
    for _ in range(40):
        texts = ["".join(r.choices(LETTERS if r.random() < 0.5 else LETTERS[:14], k=r.randrange(25))) for _ in range(r.randrange(1, 40))]
        ids, ends = encoder.column(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("width", [16, 17])
def test_both_widths_of_stored_ids(spark, monkeypatch, width):
    prepare(spark)
    monkeypatch.setattr(token_files, "width_of", lambda path: width)
    monkeypatch.setattr(token_files, "SHARD", 50)
    texts = {i: "a few words, " * (i % 7) for i in range(60)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, ids string").repartition(4)
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    start = 0
    for row in sorted(token_files.token_files(docs).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[row.doc_id], add_special_tokens=False).ids, token_files.END]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)


def test_small_files_stay_where_they_are(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    plan = token_files.token_files(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_shared_folder_is_asked_for_off_one_machine():
    context = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()
    session = type("Session", (), {"sparkContext": context, "conf": type("Conf", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(ValueError, match="share"):
        shared.shared_folder(session)
