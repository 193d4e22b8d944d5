import re

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import decontamination as D
from tests.llm.helpers import EMPTY, documents

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, window):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            for pattern in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == pattern:
                        hit.update(range(i, i + n))
                        found.add(str(item_id))
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


def found(spark, docs, items, **options):
    frame = documents(spark, [(i, t, "s") for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_contamination(frame, bench, **options).collect()
    return {r.doc_id: (r.n_words, r.n_hit, list(r.hit_items)) for r in rows}, rows


ITEM = "Which river, if any, flows past the old mill towns of the north?"


def test_hits_offsets_and_edges(spark):
    docs = [(10, f"Ça va. {ITEM.upper()} Yes"), (11, "short one"), (12, "A short one!"), (13, "nothing"), *[(i, t) for i, t, _ in EMPTY]]
    items = [(1, ITEM), (2, "short  ONE"), (3, None), (4, "..."), (5, ITEM)]
    got, rows = found(spark, docs, items)
    assert got == brute(docs, items, 10)
    run = next(r for r in rows if r.doc_id == 10).hit_runs[0]
    assert docs[0][1][run["start"] : run["end"]] == ITEM.upper()[:-1]
    cleaned = D.find_contamination(documents(spark, [(10, docs[0][1], "s")]), spark.createDataFrame(items, "item_id long, text string"))
    assert cleaned.select(D.without_runs().alias("t")).first().t == "Ça va. ? Yes"


def test_blocks_agree_with_one_automaton(spark):
    docs = [(i, f"x {ITEM} y short one z" if i % 3 else "clean text") for i in range(9)]
    items = [(1, ITEM), (2, "short one"), (3, "x which river")]
    assert found(spark, docs, items, block_bytes=8)[0] == found(spark, docs, items)[0] == brute(docs, items, 10)


def test_empty_tables_repeats_and_clashing_columns(spark):
    assert found(spark, [(1, "a b")], [])[0] == {1: (2, 0, [])}
    assert found(spark, [], [(1, "a b")])[1] == []
    frame = documents(spark, [(1, "a b c", "s")] * 3)
    frame = frame.selectExpr("*", "'mine' as N_HIT", "1 as hit_runs")
    rows = D.find_contamination(frame, spark.createDataFrame([(None, "a b"), (7, "b c")], "item_id long, text string")).collect()
    assert [(r.n_hit, r.hit_items) for r in rows] == [(3, ["7"])] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "c1", "é", "d"]), max_size=30), st.lists(st.lists(st.sampled_from(["a", "b", "c1", "É", "d"]), max_size=6), max_size=4))
def test_search_is_exact(text, items):
    doc, pairs = "-".join(text), [(k, " ".join(v)) for k, v in enumerate(items)]
    automaton = D._automaton(repr(pairs), D.window_patterns([(str(i), t.encode()) for i, t in pairs], 3))
    n, ids, runs = D._search(doc.encode(), automaton)
    hit = sum(b - a + 1 for a, b in D.merged(runs))
    assert (n, hit, sorted(ids)) == brute([(0, doc)], pairs, 3)[0]
