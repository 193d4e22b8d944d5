import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")

from shelfline.llm import packing as P
from tests.llm.helpers import EMPTY, documents, save, sentence

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [P.END_ID]


def laws(rows, capacity, length="length"):
    """Every sequence is gapless from 0 and holds `capacity` at most; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r[length] or 0))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity or len(own) == 1
    return len(by)


def plain_best_fit(lengths, capacity):
    """What every bin holds, longest items first, each into the fullest bin that takes it."""
    bins = []
    for n in sorted(lengths, reverse=True):
        able = [i for i, used in enumerate(bins) if used + n <= capacity]
        if able:
            bins[max(able, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_plain(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0 if seed % 2 else 1, [10, 40, 100, 60, 51, 99][seed], 200)
    into, offset, holds = P.best_fit(lengths, 100)
    assert sorted(holds[holds > 0].tolist()) == sorted(x for x in plain_best_fit(lengths.tolist(), 100) if x)
    for b in set(into.tolist()):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(into == b))
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist()


def items(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "key long, size long")


@pytest.mark.parametrize("kind", ["small", "halves", "large", "one"])
def test_tree_is_as_good_as_one_best_fit(spark, kind):
    rng = np.random.default_rng(7)
    drawn = {
        "small": rng.integers(1, 300, 3000),
        "halves": np.where(rng.random(3000) < 0.5, 52, 47),
        "large": rng.integers(60, 100, 2000),
        "one": np.array([5]),
    }[kind]
    rows = P.pack(items(spark, [int(n) % 100 + 1 for n in drawn]), "key", "size", capacity=100, leaf=8).collect()
    assert len(rows) == len(drawn)
    whole = len(plain_best_fit([int(n) % 100 + 1 for n in drawn], 100))
    assert laws(rows, 100, "size") <= whole * 1.02 + 1


def test_left_sequences_of_many_leaves_merge(spark, monkeypatch):
    monkeypatch.setattr(P, "isqrt", lambda n: 0)
    rows = P.pack(items(spark, [1] * 1000), "key", "size", capacity=1000, leaf=4).collect()
    assert laws(rows, 1000, "size") == 1  # through 250 leaves and two rounds


def test_odd_items(spark):
    odd = spark.createDataFrame([(1, None, "x"), (2, 0, "y"), (3, 100, None), (4, 250, "z"), (5, -3, "w")], "key long, size long, Sequence_ID string")
    rows = P.pack(odd, "key", "size", capacity=100).collect()
    assert {r.key for r in rows} == {1, 2, 3, 4, 5} and {r.sequence_id for r in rows if (r.size or 0) >= 100} == {3, 4}
    assert P.pack(items(spark, []), "key", "size").count() == 0


TEXTS = [
    "The quick  brown\tfox\njumps over THE lazy dog's tail, isn't it? 12345",
    "naïve café Ünïcödé  nbsp em ́combining é ﬁ İstanbul ΣΑΣ 漢字 한글 \U0001f600\U0001f468‍\U0001f469",
    "<|startoftext|>hi <|endoftext|> there<|endoftext|>",
    " lead and trail  ",
    "x" * 500 + " " + "it's we'll 'd " * 3,
    "\x00\x1f control\x7f\x85 next line",
]


def test_ids_are_those_of_the_library(spark, monkeypatch):
    monkeypatch.setattr(P, "WINDOW", 40)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    for r in P.cut_documents(documents(spark, rows), VOCABULARY, capacity=7).collect():
        ids = ids_of(TEXTS[r.doc_id])
        assert (r.start, r.length) == (7 * r.piece, min(7, len(ids) - 7 * r.piece))
        part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
        assert part == bytes(r.ids) and r.ids_crc32 == zlib.crc32(part)


def test_worker_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 30)
    known = P.ChunkIds(VOCABULARY)
    for k in range(9):
        texts = [f"Word{i * k}, other. " + "wx" * i + " " + "y" * 100 for i in range(10)]
        assert known.of(texts) == [np.array(ids_of(t)[:-1], dtype="<u4").tobytes() for t in texts]
        assert len(known.chunks) <= 40 and len(known.words) <= 40


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(seed):
    rng = np.random.default_rng(seed)
    parts = ["Ab", "zé", "ÀÉ", "ß", "É", "ﬁ", "İ", "'s", "'", "’", ".", ",", "&&&", "12", "½", "²", " ", "  ", "\n", "\t", "\u00a0", "\u0301", "\x1c", "\x85", "漢", "<|endoftext|>", "<|", "|>", "_", "-", "×"]
    texts = ["".join(rng.choice(parts, 30)) for _ in range(400)]
    known = P.ChunkIds(VOCABULARY)
    assert known.of(texts) == [np.array(ids_of(t)[:-1], dtype="<u4").tobytes() for t in texts]


def test_op11(spark, tmp_path):
    rows = EMPTY + [(i, sentence(i, 30 + 11 * (i % 40)), "s") for i in range(10, 150)] + [(7, sentence(3, 9000), "b"), (8, "z" * 100_000, "b")]
    rows += [(20, sentence(1), "s")] * 3 + [(None, "no id", None)]
    docs = documents(spark, rows).selectExpr("*", "9 as `KEY`", "9 as `offset`", "9 as node")
    got = P.op11_packing(spark, save(spark, tmp_path, documents=docs)).collect()
    want = []
    for i, t, _ in rows:
        ids = ids_of(t)
        for k in range(0, len(ids), P.CAPACITY):
            part = np.array(ids[k : k + P.CAPACITY], dtype="<u4")
            want.append((i, k // P.CAPACITY, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    assert laws(got, P.CAPACITY) <= len(plain_best_fit([w[3] for w in want], P.CAPACITY)) + 1
    assert P.op11_packing(spark, save(spark, tmp_path / "e", documents=documents(spark, []))).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = [(i, sentence(i, 10 + i % 30), "s") for i in range(60)]
    packed = P.packed_documents(documents(spark, rows), VOCABULARY, capacity=256, with_ids=True)
    texts = {i: ids_of(t) for i, t, _ in rows}
    whole = {i: [None] * len(ids) for i, ids in texts.items()}
    pieces = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for s in P.sequences(packed).collect():
        ids = np.frombuffer(bytes(s.ids), dtype="<u4").tolist()
        assert len(ids) == s.n_tokens <= 256
        for doc, at in zip(s.doc_ids, s.starts):
            r = pieces[s.sequence_id, at]
            whole[doc][r.start : r.start + r.length] = ids[at : at + r.length]
    assert whole == texts
    assert packed.agg(F.countDistinct("sequence_id")).first()[0] == len({r.sequence_id for r in pieces.values()})
