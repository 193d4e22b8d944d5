import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from shelfline.llm import spelling as S
from tests.llm.helpers import EMPTY, documents, save


def plain_counts(rows):
    found = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_groups(counts, ratio=10):
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, own in near.items():
        if own and counts[best := min(own, key=lambda x: (-counts[x], x))] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def grouped(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in S.variant_groups(df).collect())


def test_random_words(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(400):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
        counts[word] = rng.choice([2, 3, 25, 25, 300, 4000])
    assert grouped(spark, counts) == plain_groups(counts)


def test_chains_ties_and_runs_of_letters(spark):
    counts = {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaaaa": 2000, "baaaaaaaaa": 2000, "bbaaaaaaaa": 1 << 40, "ÿaaaaaa": 2, "caaaaaa": 2, "alone": 9, "a": 5, "": 50}
    got = grouped(spark, counts)
    assert got == plain_groups(counts)
    assert ("aaaaaaa", "aaaaaaaa", "aaaaaaaaaa", 2, 3, 20) in got


def test_long_words(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(20_000))
    counts = {long: 100, long[:-1]: 5, long[:9000] + "é" + long[9001:]: 7, long[:1] + long[2:]: 3, "x" + long[2:]: 2}
    assert grouped(spark, counts) == plain_groups(counts)


def test_unknown_words(spark):
    df = spark.createDataFrame([(None, 3), ("monsoon", 40), ("monsson", 4)], "word string, n long")
    assert sorted(tuple(r) for r in S.variant_groups(df).collect()) == [("monsoon", None, "monsoon", 40, 1, None), ("monsson", "monsoon", "monsoon", 4, 1, 40)]
    assert S.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


WORDS = ["government", "governmant", "goverment", "Éclairage", "éclairage", "ÉCLAIRAGE", "straße×strasse", "naïveté÷naivete", "short", "colour", "parliament", "parliamant"]


def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, weights=[60, 2, 3, 5, 5, 5, 3, 3, 9, 9, 50, 2], k=40)), "s") for i in range(80)]
    return rows + EMPTY + [(None, "government " * 5, None)] + [(7, "parliament, parliamant", "x")] * 4 + [(9, "q" * 60_000 + " " + "q" * 60_001 + " ", "y")] * 2


@pytest.mark.parametrize("held", [S.HELD, 2])
def test_op13(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    rows = corpus()
    docs = documents(spark, rows).selectExpr("*", "9 as Word", "9 as n", "9 as id", "9 as kind")
    got = sorted(tuple(r) for r in S.op13_spelling(spark, save(spark, tmp_path, documents=docs)).collect())
    assert got == plain_groups(plain_counts(rows))
    assert any(r[1] for r in got)


def test_sql(spark, tmp_path):
    rows = [r for r in corpus() if r[0] != 9]  # SQL would write out every group of a very long word
    sf = save(spark, tmp_path, documents=documents(spark, rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert sorted(con.execute(S.OP13_SQL).fetchall()) == plain_groups(plain_counts(rows))


def test_empty(spark, tmp_path):
    assert S.op13_spelling(spark, save(spark, tmp_path, documents=documents(spark, EMPTY))).count() == 0
    assert S.op13_spelling(spark, save(spark, tmp_path / "e", documents=documents(spark, []))).count() == 0
