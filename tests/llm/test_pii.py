import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import pii as P
from tests.llm.helpers import EMPTY, documents, save, sentence

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def base_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", P.base_spans(P.F.coalesce("text", P.F.lit(""))).alias("s")).collect()
    return [[f"{s.kind}:{s.start}:{s.end}" for s in r.s] for r in sorted(rows, key=lambda r: r.i)]


TEXTS = [
    "mail a.b@c.d_e@f.g and x@y.z.w. a@b @c.d q@r-.-s", "é🙂 a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (988) 555-2485 +12 +1 2 3 4 +123456789012345678 ++49-30-1234567)", "4111111111111111 +4111111111111111 0.0.0.0", None, "",
    "a" * 5000 + "@" + "b" * 50, "1" * 3000, "a@b.c" * 300, "+1" + "(" * 2000, "9 " * 1500,
]


def test_base_spans_match_the_plain_patterns(spark):
    assert base_of(spark, TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+- (9_é", max_size=50), min_size=20, max_size=40))
def test_base_spans_on_random_text(spark, texts):
    assert base_of(spark, texts) == [brute(t) for t in texts]


def test_terms_that_reveal_are_found(spark):
    # "zebulon" occurs with the address only, "common" everywhere, "rare" once.
    rows = [(i, f"common talk by zebulon a.b@c.org common end {i}", "s") for i in range(3)] + [(10, "rare x@y.org", "s")]
    rows += [(100 + i, "common words " + sentence(i, 20), "s") for i in range(40)] + [(900 + i, t, s) for i, t, s in EMPTY]
    got = {r.doc_id: r for r in P.sanitise(documents(spark, rows).selectExpr("*", "1 as PII_text", "2 as base")).collect()}
    assert len(got) == len(rows)
    terms = [s.value for s in got[0].pii_spans if s.kind == "term"]
    assert "zebulon" in terms and "common" not in terms
    assert "[EMAIL]" in got[0].pii_text and "zebulon" not in got[0].pii_text
    assert [s.value for s in got[10].pii_spans] == ["x@y.org"]  # one document shows nothing
    assert got[105].pii_spans == [] and got[105].pii_text == rows[9][1] and got[901].pii_text is None and got[902].pii_text == ""


def test_disclosure_by_brute_force(spark):
    rows = [(i, " ".join([*sentence(i % 4, 6).split(), "m@n.org" if i % 3 else "o@p.org", *sentence(i % 5, 4).split()]), "s") for i in range(30)]
    got = {r.doc_id: {(s.start, s.end) for s in r.pii_spans if s.kind == "term"} for r in P.sanitise(documents(spark, rows)).collect()}
    import math

    near, has, term_docs = {}, {}, {}
    for i, text, _ in rows:
        for t in {w.lower() for w in re.findall(r"[^\W_]+", text)}:
            term_docs.setdefault(t, set()).add(i)
        m = re.search(PLAIN["email"], text)
        has.setdefault(m[0], set()).add(i)
        for w in re.finditer(r"[^\W_]+", text):
            if (w.end() <= m.start() or w.start() >= m.end()) and re.search(r"[^\W\d_]", w[0]):
                near.setdefault((m[0], w[0].lower()), {}).setdefault(i, set()).add(w.span())
    want = {i: set() for i, _, _ in rows}
    for (e, t), where in near.items():
        pmi = math.log2(30 * len(where) / (len(has[e]) * len(term_docs[t])))
        if len(where) >= 2 and pmi >= P.ALPHA * math.log2(30 / len(has[e])):
            for i, spans in where.items():
                want[i] |= spans
    assert got == want


@pytest.mark.parametrize("rows", [[], [(1, "a@b.co", "s")] * 3, [(None, "a@b.co", None)]])
def test_empty_repeated_and_null_ids(spark, tmp_path, rows):
    got = P.op8_pii(spark, save(spark, tmp_path, documents=documents(spark, rows))).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [(i, 1, "email:0:6") for i, _, _ in rows]


def whole_texts(rows, alpha, least):
    """Term spans by brute force: a term counts with every entity of its document and is marked wherever it stands."""
    import math

    def base(text):
        return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute(text))]

    def free(text):
        spans = base(text)
        return [m for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]

    texts = [t or "" for _, t, _ in rows]
    has, holds, both = {}, {}, {}
    for i, text in enumerate(texts):
        terms = {w[0].lower() for w in free(text) if re.search(r"[^\W\d_]", w[0])}
        for t in {w.lower() for w in re.findall(r"[^\W_]+", text)}:
            holds.setdefault(t, set()).add(i)
        for e in {f"{k}:{text[a:b].lower()}" for k, a, b in base(text)}:
            has.setdefault(e, set()).add(i)
            for t in terms:
                both.setdefault((e, t), set()).add(i)
    n, action = len(rows), {}
    for (e, t), where in both.items():
        pmi, ic = math.log2(n * len(where) / (len(has[e]) * len(holds[t]))), math.log2(n / len(has[e]))
        if len(where) >= least and pmi >= alpha * ic:
            action[t] = "remove" if pmi - ic >= -1e-9 or action.get(t) == "remove" else "generalise"
    return [[(w.start(), w.end(), action[w[0].lower()]) for w in free(text) if w[0].lower() in action] for text in texts]


def test_terms_count_and_are_marked_over_whole_texts(spark):
    far = sentence(500, 40)  # more than 64 code points between name and address
    rows = [(i, f"Dear Zebulon, {far} {sentence(i, 300)} write to zeb@y.org", "s") for i in range(3)]
    rows += [(10, f"{far} zebulon was here, ZEBULON", "s"), (11, "x zeb@y.org\uffffquux 1.2.3.4abc", "s"), (12, "quux\uffff zeb@y.org 1.2.3.4abc", "s")]
    rows += [(20 + i, f"plain {sentence(i, 30)} é🙂 abc", "s") for i in range(60)] + [(3, rows[0][1], "s"), (3, rows[0][1], "s"), (None, "zebulon", None), (99, None, "s")]
    docs = documents(spark, rows).repartition(5)
    for alpha, least in ((P.ALPHA, P.LEAST_DOCS), (0.4, 1), (1.0, 3)):
        got = {(r.doc_id, r.text): [(s.start, s.end, s.action) for s in r.pii_spans if s.kind == "term"] for r in P.sanitise(docs, alpha=alpha, least_docs=least).collect()}
        assert got == {(i, t): spans for (i, t, _), spans in zip(rows, whole_texts(rows, alpha, least))}
    clean = {r.doc_id: r.pii_text for r in P.sanitise(docs).collect()}
    assert "zebulon" not in clean[0].lower() and "zebulon" not in clean[10].lower()


def test_repeated_rows_count_alike_under_one_id_or_several(spark):
    plain = [(100 + i, sentence(i, 8), "s") for i in range(40)]
    for ids in ([1, 2, 3], [1, 1, 1], [None, None, None]):
        got = P.sanitise(documents(spark, [(i, "zeb a@b.co", "s") for i in ids] + plain)).filter("text like 'zeb%'").collect()
        assert [[(s.kind, s.start, s.end) for s in r.pii_spans] for r in got] == [[("email", 4, 10), ("term", 0, 3)]] * 3
