import random
import re

from pyspark.sql import functions as F

from shelfline.llm import near_dedup as N
from tests.llm.helpers import documents, sentence

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, hundredths):
    sets = [(i, shingles(t, n)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= hundredths * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def found(spark, rows, **options):
    out = N.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]), **options).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}, out


def corpus(seed, n):
    rng = random.Random(seed)
    bases = [sentence(k, rng.choice([2, 3, 8, 40, 120])).split() for k in range(6)] + [sentence(99, 700).split()]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = rng.choice(["new", "Other", "third", f"u{i}"])
        if rng.random() < 0.3:
            words += sentence(rng.randrange(50), rng.choice([1, 5, 30])).split()
        rows.append((i * 3 + 1, " ".join(words)))
    return rows


def test_agrees_with_all_pairs(spark):
    rows = corpus(1, 160) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "two  WORDS")]
    assert found(spark, rows, words=3, similarity=0.85)[0] == brute(rows, 3, 85)


def test_default_parameters_and_chains(spark):
    base = sentence(3, 200).split()
    rows = [(i, " ".join([*base[3 * i :], *[f"n{j}" for j in range(3 * i)]])) for i in range(12)]
    want = brute(rows, 5, 80)
    assert found(spark, rows)[0] == want
    assert len({c for _, c, _ in want.values()}) < 12  # a chain: its ends are not similar themselves
    assert 100 * len(shingles(rows[0][1], 5) & shingles(rows[-1][1], 5)) < 80 * len(shingles(rows[0][1], 5) | shingles(rows[-1][1], 5))


def test_many_copies_and_one_passage(spark):
    passage = sentence(7, 40)
    rows = [(i, sentence(5, 80)) for i in range(100)] + [(200 + i, passage + " " + sentence(300 + i, 60)) for i in range(60)]
    assert found(spark, rows, words=3, similarity=0.85)[0] == brute(rows, 3, 85)


def test_empty_null_ids_and_clashes(spark):
    assert found(spark, [])[1] == []
    frame = documents(spark, [(None, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "A b c d e F", "s")])
    rows = N.near_duplicates(frame.selectExpr("*", "1 as uid", "2 as component_id", "3 as n")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (2, 2, True), (2, 2, True), (3, 2, False)]


def test_must_share_is_monotone():
    assert N.must_share(32, 0.85) < N.must_share(32, 0.95) <= 32
    assert 350 < N.must_share(512, 0.85) < 435


def test_rows_that_share_an_id_keep_their_links(spark):
    a, b, c = sentence(1, 60), sentence(2, 60), sentence(3, 60)
    rows = [(5, a), (5, b), (7, a + " one"), (9, b + " one"), (9, c), (9, c), (4, c + " one"), (11, None), (11, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found(spark, rows, words=3, similarity=0.85)[1])
    want = [(5, 58, 5, True), (5, 58, 5, True), (7, 59, 5, False), (9, 59, 5, False), (9, 58, 4, False), (9, 58, 4, False), (4, 59, 4, True), (11, 0, 11, True), (11, 58, 5, False)]
    assert got == sorted(want)


def test_signatures_of_similar_sets_differ_in_few_bits(spark):
    """Sets just at the similarity stay under the limit; sets that share a third are far over it."""
    rng = random.Random(8)
    draw = lambda n: [rng.getrandbits(64) for _ in range(n)]
    pack = lambda values: b"".join(v.to_bytes(8, "little") for v in sorted(values))
    rows, kinds = [], {}
    for k, (n, share) in enumerate([(n, s) for n in (7, 40, 300, 3000) for s in (0.85, 0.85, 0.4, 0.4)]):
        both = draw(int(-(-share * n // 1)))
        rest = n - len(both)
        rows += [(2 * k, len(both) + rest // 2, pack(both + draw(rest // 2))), (2 * k + 1, len(both) + rest - rest // 2, pack(both + draw(rest - rest // 2)))]
        kinds[k] = (n, share)
    sets = spark.createDataFrame(rows, "uid long, n long, hashes binary")
    signed = sets.select("uid", "n").join(N.signatures(sets), "uid")
    x, y = signed.alias("x"), signed.alias("y")
    near = {r.k for r in x.join(y, F.expr("x.uid + 1 = y.uid AND x.uid % 2 = 0")).filter(N._alike("x", "y", 0.85)).selectExpr("x.uid div 2 AS k").collect()}
    assert all((k in near) == (share == 0.85) for k, (n, share) in kinds.items() if n >= 40 or share == 0.85)
    limits = N.most_differing(0.85)
    assert limits == sorted(limits) and all(limit <= 0.15 * u + 1e-9 for u, limit in enumerate(limits))


def test_texts_of_common_blocks_make_few_pairs(spark, monkeypatch):
    """Texts that share everything with others, block by block, but no text with another: hardly a pair is compared."""
    rng = random.Random(6)
    blocks = [" ".join(f"b{k}w{i}" for i in range(40)) for k in range(30)]
    compared, plain = [], N.linked
    monkeypatch.setattr(N, "linked", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    second = {}
    for size in (100, 400):
        rows = [(i, " ".join(rng.sample(blocks, 12))) for i in range(size)]
        compared.clear()
        got = found(spark, rows, words=3, similarity=0.85)[0]
        if size == 100:
            assert got == brute(rows, 3, 85)
        second[size] = compared[1]
    assert second[400] <= 40, second


def test_distant_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    """Copies with edits of their own, each too far from every other: the pairs compared stay in proportion to them."""
    rng, base, rows = random.Random(5), sentence(11, 620).split(), []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(0, 620, 4), rng.choice([17, 20, 24])):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    compared, plain = [], N.linked
    monkeypatch.setattr(N, "linked", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    assert found(spark, rows, words=3, similarity=0.85)[0] == brute(rows, 3, 85)
    assert sum(compared) < 10 * len(rows) < len(rows) ** 2 / 4


def test_copies_just_below_the_similarity_make_few_pairs(spark, monkeypatch):
    """Copies of one text at 0.8 from each other, where 0.85 is asked: far too many for pairs, and each pair is near."""
    rng, base, rows = random.Random(9), sentence(12, 620).split(), []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(0, 620, 4), 12):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    compared, plain = [], N.linked
    monkeypatch.setattr(N, "linked", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    assert found(spark, rows, words=3, similarity=0.85)[0] == brute(rows, 3, 85)
    assert compared[1] < 4 * len(rows), compared


def test_deep_signatures_keep_sets_at_the_similarity(spark):
    rng = random.Random(10)
    draw = lambda n: [rng.getrandbits(64) for _ in range(n)]
    pack = lambda values: b"".join(v.to_bytes(8, "little") for v in sorted(values))
    rows, kinds = [], {}
    for k, (n, share) in enumerate([(n, s) for n in (7, 40, 300, 700, 3000, 20000) for s in (0.85, 0.85, 0.85, 0.7)]):
        both = draw(int(-(-share * n // 1)))
        rest = n - len(both)
        rows += [(2 * k, len(both) + rest // 2, pack(both + draw(rest // 2))), (2 * k + 1, len(both) + rest - rest // 2, pack(both + draw(rest - rest // 2)))]
        kinds[k] = share
    sets = spark.createDataFrame(rows, "uid long, n long, hashes binary")
    signed = sets.select("uid", "n").join(N.signatures(sets), "uid")
    x, y = signed.alias("x"), signed.alias("y")
    near = {r.k for r in x.join(y, F.expr("x.uid + 1 = y.uid AND x.uid % 2 = 0")).filter(N._deeply_alike("x", "y", 0.85)).selectExpr("x.uid div 2 AS k").collect()}
    assert all((k in near) == (share == 0.85) for k, share in kinds.items() if share == 0.85 or k > 4)
