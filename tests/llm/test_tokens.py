import json
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from shelfline.llm import tokens as K  # noqa: E402
from tests.llm.helpers import EMPTY, documents, save, sentence  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = K.PieceTokenizer(PATH)
LIBRARY = tokenizers.Tokenizer.from_file(PATH)  # as it comes, apart from the operator's own


def own_ids(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ids, counts = TOKENIZER.encode(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def library_ids(texts):
    return [e.ids + [K.END_ID] for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


TEXT = st.text(alphabet=st.sampled_from("ab Z'st  \n\t.,!09é ñ漢🙂-_|<>"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(max_size=30)), min_size=1, max_size=6))
def test_pieces_give_the_librarys_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert own_ids(texts) == library_ids(texts)


def test_added_tokens_and_bounded_memory(monkeypatch):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "|>", "<<|endoftext|>>", "it's we'll  they're \n\n ok. (x) 3.14", "x" * 3000, " lead", "trail "]
    monkeypatch.setattr(K, "REMEMBERED", 5)
    monkeypatch.setattr(K, "WINDOW_BYTES", 64)
    TOKENIZER._forget()
    assert own_ids(texts * 3) == library_ids(texts * 3)
    TOKENIZER._forget()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(1, 9), st.integers(1, 5))
def test_coder_round_trip(ids, lanes, every):
    ids = np.array(ids, dtype=np.uint32)
    coder = K.Coder(K.frequencies(np.bincount(ids, minlength=41), 8), 8)
    frame = coder.encode(ids, lanes, every)
    assert coder.decode(frame).tolist() == ids.tolist()
    if len(ids):
        with pytest.raises(ValueError):
            coder.decode(frame[:-1])
        with pytest.raises(ValueError):
            coder.decode(frame[:33] + bytes([frame[33] ^ 1]) + frame[34:])


def test_segments_decode_apart():
    ids = np.random.default_rng(1).zipf(1.5, 5000).clip(0, 300).astype(np.uint32)
    coder = K.Coder(K.frequencies(np.bincount(ids)))
    frame = coder.encode(ids, 16, 8)
    _, n, lanes, every, segments, _, _ = K.HEADER.unpack_from(frame)
    each = 8 + 8 * lanes
    words = np.frombuffer(frame, dtype="<u4", offset=K.HEADER.size + segments * each).astype(np.uint64)
    assert segments == 40
    assert coder._segment(frame, words, 7, n, lanes, every, each).tolist() == ids[7 * 128 : 8 * 128].tolist()


def test_frequencies_sum_and_cover():
    slots = K.frequencies(np.array([0, 1, 10**9, 3, 0, 7]), 4)
    assert slots.sum() == 16 and (slots > 0).tolist() == [False, True, True, True, False, True]
    with pytest.raises(ValueError):
        K.frequencies(np.ones(17, dtype=np.int64), 4)


@pytest.mark.parametrize("part_bytes", [1 << 24, 200])
def test_files_round_trip(spark, tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(K, "PART_BYTES", part_bytes)
    monkeypatch.setattr(K, "FRAME_TOKENS", 50)
    rows = [(i, f"document {i} with words, {'longer ' * (i % 40)}é", "s") for i in range(60, 5, -1)] + EMPTY + [(None, "null id", "s"), (7, "again", "s")]
    docs = documents(spark, rows).selectExpr("*", "1 as ids", "2 as PART")
    K.write_tokens(docs, f"{tmp_path}/t", PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in K.read_tokens(spark, f"{tmp_path}/t").collect())
    assert [g[0] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])])[:-1].tolist()
    ids = [-1 if g[1] is None else g[1] for g in got]
    assert ids == sorted(ids) and len(ids) == len(rows)
    expected = {(i, np.array(x, dtype="<u4").tobytes()) for (i, _, _), x in zip(rows, library_ids([t or "" for _, t, _ in rows]))}
    assert {(g[1], g[3]) for g in got} == expected
    assert zlib.crc32(got[0][3]) > 0


def test_empty_table(spark, tmp_path):
    K.write_tokens(documents(spark, []), f"{tmp_path}/t", PATH)
    assert K.read_tokens(spark, f"{tmp_path}/t").count() == 0


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    plain = K.span_hashes
    monkeypatch.setattr(K, "span_hashes", lambda data, starts, ends, *base: plain(data, starts, ends, *base) if base else (ends - starts).astype(np.uint64))
    TOKENIZER._forget()
    texts = ["one two six ten", "red dog cat", "é ü"]
    assert own_ids(texts) == library_ids(texts)
    TOKENIZER._forget()


def test_refused_vocabularies(spark, tmp_path):
    big = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
    big["model"] = {"type": "WordLevel", "vocab": {f"w{i}": i for i in range(70_000)}, "unk_token": "w0"}
    (tmp_path / "big.json").write_text(json.dumps(big))
    with pytest.raises(ValueError, match="65535"):
        K.write_tokens(documents(spark, [(1, "w1", "s")]), f"{tmp_path}/t", f"{tmp_path}/big.json")


def test_op2_on_long_and_odd_texts(spark, tmp_path):
    rows = [(9, sentence(1, 30_000), "s"), (2, "x" * 200_000, "s"), (5, "a <|endoftext|> b", "s"), *EMPTY[:2], (7, "é" * 9, None)]
    got = sorted((tuple(r) for r in K.op2_tokens(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()))
    at = 0
    for row, (i, ids) in zip(got, sorted((i, x) for (i, _, _), x in zip(rows, library_ids([t or "" for _, t, _ in rows])))):
        assert row == (i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
