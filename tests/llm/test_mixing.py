import re

import random

import numpy as np
import pytest

from shelfline.llm import mixing as M
from tests.llm.helpers import EMPTY, documents, sentence


def target_by_rounds(sizes):
    """Targets by resharing the excess until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in above}


def corpus(spark):
    rows = [(i, sentence(i, 30 + i * 13 % 400), ["big", "big", "mid", "tiny", None][min(i % 7, 4)]) for i in range(300)]
    rows += [(1000 + i, "one two", "bit") for i in range(2)] + [(900 + i, t, s) for i, t, s in EMPTY] + [(500, "repeated row here", "mid")] * 2
    return rows, documents(spark, rows)


def test_targets_and_taken(spark):
    rows, docs = corpus(spark)
    got = [tuple(r) for r in M.taken_by_document(M.mix(docs)).select("id", "source", "size", "source_size", "target", "taken").collect()]
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(M.TOKEN, text or ""))
    want, taken = target_by_rounds(sizes), {}
    for _, source, size, source_size, target, t in got:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and 0 <= t <= 3 * size
        taken[source] = taken.get(source, 0) + t
    assert all(abs(taken[s] - want[s]) <= 2 * M.BLOCK for s in sizes)
    again = [tuple(r) for r in M.taken_by_document(M.mix(docs)).select("id", "source", "size", "source_size", "target", "taken").collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_rows_cover_what_is_taken(spark):
    _, docs = corpus(spark)
    mixture = M.mix(docs.filter("doc_id <> 500"))
    texts = M.mixed_text(mixture, docs.filter("doc_id <> 500")).collect()
    assert sum(len(r.text.split()) for r in texts) == mixture.rows.agg(M.F.sum("taken")).first()[0]
    assert mixture.rows.groupBy("source", "slot").agg(M.F.sum("taken").alias("t")).filter(f"t > {M.BLOCK}").count() == 0


def test_draws_meet_totals_and_permutations_are_whole(monkeypatch):
    monkeypatch.setattr(M, "SHARD_SLOTS", 100)
    drawn = list(M.draw_slots(1, [500, 0, 37, 1]))
    assert {k: sum(n for _, j, _, n in drawn if j == k) for k in range(4)} == {0: 500, 1: 0, 2: 37, 3: 1}
    assert len({s for s, *_ in drawn}) == 6
    for n in (1, 2, 3, 64, 1000, 1025):
        assert sorted(M.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_documents_and_empty(spark):
    rows, docs = corpus(spark)
    kept = M.mixed_documents(docs.selectExpr("*", "1 as size", "2 as TAKEN"))
    assert kept.columns == [*docs.columns, "size", "TAKEN"]
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert max(n for i, n in counts.items() if i != 500) <= 3 and counts[500] <= 9
    assert M.mix(documents(spark, [])).rows.count() == 0
    assert M.taken_by_document(M.mix(documents(spark, EMPTY))).filter("taken > 0").count() == 1  # "!!" is a token


def test_layout_of_the_table_plays_no_part(spark):
    rows, docs = corpus(spark)
    seen = []
    for laid in (docs.coalesce(1), docs.repartition(7), docs.orderBy(M.F.desc("text")).repartition(3)):
        taken = M.taken_by_document(M.mix(laid)).select("id", "source", "size", "taken")
        seen.append(sorted((tuple(r) for r in taken.collect()), key=str))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)


def str_then_slot(item):
    (source, slot), _ = item
    return str(source), slot


def test_taken_by_brute_force(spark):
    """Slot after slot, a block cut out of plain lists of words, until a source's target is met to a token."""
    rows, docs = corpus(spark)
    mixture = M.mix(docs.filter("doc_id <> 500"))
    at = {r.id: (r.source, r.at, r.size) for r in mixture.documents.collect()}
    streams = {}
    for i, (source, start, size) in sorted(at.items(), key=lambda x: (str(x[1][0]), x[1][1], x[1][2])):
        stream = streams.setdefault(source, [])
        assert start == len(stream) or not size
        stream += [i] * size
    want = dict.fromkeys(at, 0)
    needed = {r.source: round(r.target) for r in mixture.targets.collect()}
    for (source, _), block in sorted({(r.source, r.slot): r.block for r in mixture.rows.collect()}.items(), key=str_then_slot):
        for i in streams[source][block * M.BLOCK : (block + 1) * M.BLOCK][: needed[source]]:
            want[i] += 1
            needed[source] -= 1
    assert not any(needed.values())
    assert {r.id: r.taken for r in M.taken_by_document(mixture).collect()} == want


def test_very_long_text(spark):
    docs = documents(spark, [(1, "word " * 50_000, "a"), (2, "b", "b")])
    taken = {r.id: r.taken for r in M.taken_by_document(M.mix(docs)).collect()}
    assert taken[2] == 3 and abs(taken[1] - 49_998) <= M.BLOCK


def test_small_sources_get_their_target_to_a_token(spark):
    """Three hundred sources of a single text, none of which fills its blocks."""
    rows = [(i, sentence(i, 65 if i % 3 else 1 + i % 130), f"s{i:03}") for i in range(300)]
    taken = M.taken_by_document(M.mix(documents(spark, rows))).collect()
    assert all(r.taken == round(r.target) and r.taken <= 3 * r["size"] for r in taken) and len(taken) == 300


def test_slots_hold_exactly_the_target():
    rng = random.Random(1)
    for _ in range(600):
        size, block, k = rng.randint(1, 400), 64, rng.randint(0, 9)
        target = rng.randint(0, 3 * size)
        slots, used = M.slots_for(target, size, block, 17, k)
        blocks = -(-size // block)
        held = 0
        for s in range(slots):
            (b,) = M.permuted(np.array([s % blocks]), blocks, M._pass_key(17, k, s // blocks)).tolist()
            assert M.place_of(b, blocks, M._pass_key(17, k, s // blocks)) == s % blocks
            length = min(block, size - b * block)
            held += used if s == slots - 1 else length
            assert s < slots - 1 or 0 < used <= length
        assert held == target
