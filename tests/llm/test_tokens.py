"""Token counts and token files against the libraries themselves, and exact round trips."""

import random
import zlib

import numpy as np
import pytest

from aforo.llm import token_files as files
from aforo.llm.segments import split_at_spaces
from aforo.llm.token_counts import count_tokens, default_model, token_counts

PARTS = ["a", "bc", " ", "  ", "\n", "\t", "▁", "é", "<|endoftext|>", "'s", "12", "　", "\xa0", "!", ",", "</s>", "日本", "\x00", "the quick"]


def odd_texts(n=1500):
    r = random.Random(7)
    return ["".join(r.choices(PARTS, k=r.randint(0, 25))) for _ in range(n)] + ["", " ", "  a", "a  ", "x" * 5000, "word, word. word! " * 300]


def test_parts_join_to_the_text():
    assert all(" ".join(split_at_spaces(t)) == t for t in odd_texts())


def test_counts_equal_the_library():
    import sentencepiece

    texts = odd_texts()
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert count_tokens(texts, default_model()) == [len(x) for x in model.encode(texts)]


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    texts = odd_texts()
    t = Tokenizer.from_file(files.default_tokenizer())
    want = [np.array([*e.ids, 2], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert list(files.encode_texts(texts, files.default_tokenizer(), 2)) == want


@pytest.mark.parametrize("top", [1, 2, 7, 2**16, 2**32])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_block_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    ids[::37] = top - 1
    lengths = np.array([n // 3, 0, n - n // 3], np.uint32)
    data = files.encode_file([5, None, 9], lengths, ids)
    keys, sizes, got = files.decode_file(data)
    assert keys == [5, None, 9] and (sizes == lengths).all() and (got == ids).all()
    assert (files.read_document(data, 2) == ids[n // 3 :]).all()


def test_damaged_file_is_an_error():
    with pytest.raises(ValueError):
        files.decode_file(b"nope" + bytes(40))


def test_token_files_on_edge_rows(spark, tmp_path):
    rows = [(3, "c d", 1), (1, None, 1), (2, "", 1), (2, "a b", 1), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    manifest = files.write_token_files(docs, f"file://{tmp_path}", ids_per_file=3)
    got = sorted(files.read_token_files(manifest).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(files.default_tokenizer())
    want = [np.array([*t.encode(x or "").ids, 2], "<u4") for _, x in [(None, "x"), (1, None), (2, ""), (2, "a b"), (3, "c d")]]
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3]
    assert [r.n_tokens for r in got] == [len(x) for x in want] and [r.ids_crc32 for r in got] == [zlib.crc32(x.tobytes()) for x in want]
    assert files.read_token_files(files.write_token_files(docs.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_token_counts_on_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a é", 0), (4, "a " * 5000, 0)], "doc_id long, text string, n_bytes int")
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts(docs).collect()}
    assert got[(1, 0)] == (0, False) and (None, 4) in got and got[(4, 10000)][1]
    assert token_counts(docs.limit(0)).count() == 0


def test_ids_of_many_batches_and_an_emptied_cache():
    from tokenizers import Tokenizer

    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 6))) + r.choice(["", "", ".", ",", "?!", "..a"])
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", " ", "  x"]) for _ in range(400)]
    t = Tokenizer.from_file(files.default_tokenizer())
    want = [np.array([*e.ids, 7], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    known = files._tokenizer(files.default_tokenizer(), 7)[2]
    known.max_parts = 300
    assert list(files.encode_texts(texts, files.default_tokenizer(), 7, 2000)) == want
    assert list(files.encode_texts(texts, files.default_tokenizer(), 7)) == want


@pytest.mark.parametrize("range_bytes", [128_000_000, 1000])
def test_one_doc_id_over_many_ranges(spark, tmp_path, range_bytes):
    rows = [(7 if i % 3 else None, f"{i * 37 % 501} text of row {i} " + "z" * (i % 40)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = files.write_token_files(docs, f"file://{tmp_path}", ids_per_file=500, range_bytes=range_bytes)
    got = sorted(files.read_token_files(manifest).collect(), key=lambda r: r.start)
    want = [len(x) // 4 for x in files.encode_texts([x for _, x in sorted(rows, key=lambda x: (x[0] is not None, x))], files.default_tokenizer(), 2)]
    assert [r.n_tokens for r in got] == want
    if range_bytes == 1000:  # else adaptive execution merges such small ranges
        assert manifest.select("part").distinct().count() > 4
