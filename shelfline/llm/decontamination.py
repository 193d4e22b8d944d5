"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

A text is normalised to its words, lower-cased and joined by single spaces.  Every benchmark item gives its
windows of `window` consecutive words (a shorter item is one window).  The windows, each between two spaces,
are the patterns of one automaton, which reads a document once and reports every occurrence; occurrences are
merged to runs of words and mapped back to code-point offsets of the original text.

The patterns travel to the tasks as a broadcast value whose size is checked first: a benchmark of more than
`block_bytes` is split by a hash of its items into blocks, and the documents are scanned once for each block.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.llm.common import renamed_apart, stored, table

WINDOW = 10
#: Benchmark text in one automaton, at most: a worker needs some 360 MB for 1 MB of distinct words.
BLOCK_BYTES = 1 << 20

#: Bytes of words stay (A-Z as a-z), all others become a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField(
            "hit_runs",
            T.ArrayType(
                T.StructType([T.StructField(c, T.LongType()) for c in ("first_word", "last_word", "start", "end")])
            ),
        ),
    ]
)
ARROW_ADDED = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("hit_items", pa.list_(pa.string())),
        ("hit_runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("first_word", "last_word", "start", "end")]))),
    ]
)

#: Automata that this worker process has built, by the id of their pattern set.
_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def window_patterns(items: list[tuple[str | None, bytes | None]], window: int) -> list[tuple[str, int, list]]:
    """(pattern, words in it, ids of the items that hold it) for every distinct window of `items`."""
    found: dict[tuple[bytes, ...], set] = {}
    for item_id, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item_id)
    return [
        ((b" " + b" ".join(words) + b" ").decode("latin-1"), len(words), sorted(x for x in ids if x is not None))
        for words, ids in found.items()
    ]


def _automaton(key: str, patterns: list[tuple[str, int, list]]) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for pattern, n, ids in patterns:
            made.add_word(pattern, (n, ids))
        made.make_automaton()
        _built[key] = made
    return _built[key]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (first, last) runs of words as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _offsets(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs with their code-point offsets in the original text."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.frombuffer(text.translate(WORD_BYTES), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    points = np.cumsum((raw & 0xC0) != 0x80)
    return [
        {"first_word": a, "last_word": b, "start": int(points[starts[a]]) - 1, "end": int(points[ends[b] - 1])}
        for a, b in runs
    ]


def _search(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple[int, set, list[tuple[int, int]]]:
    """(words of the text, items found, word runs found)."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), set(), []
    hay = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(hay.decode("latin-1")))
    if not found:
        return len(words), set(), []
    spaces = np.flatnonzero(np.frombuffer(hay, dtype=np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]) - 1
    items = {x for _, (_, ids) in found for x in ids}
    return len(words), items, [(int(e) - n + 1, int(e)) for e, (_, (n, _)) in zip(last, found)]


def _scan(docs: DataFrame, text_col: str, items: list[tuple], window: int) -> DataFrame:
    """`docs` with ADDED columns for `items`, joined to what earlier blocks have found."""
    spark = docs.sparkSession
    again = "hit_runs" in docs.columns
    patterns = spark.sparkContext.broadcast(window_patterns(items, window))
    key = uuid.uuid4().hex
    schema = docs.schema if again else T.StructType([*docs.schema.fields, *ADDED.fields])

    def search(batches):
        automaton = _automaton(key, patterns.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary()).to_pylist()
            before = batch.select(["hit_items", "hit_runs"]).to_pylist() if again else [None] * len(texts)
            added: dict[str, list] = {c: [] for c in ARROW_ADDED.names}
            for text, old in zip(texts, before):
                n, items, runs = _search(text, automaton)
                if old:
                    items |= set(old["hit_items"])
                    runs += [(r["first_word"], r["last_word"]) for r in old["hit_runs"]]
                runs = merged(runs)
                added["n_words"].append(n)
                added["n_hit"].append(sum(b - a + 1 for a, b in runs))
                added["hit_items"].append(sorted(items))
                added["hit_runs"].append(_offsets(text, runs) if runs else [])
            kept = [c for c in batch.schema.names if c not in added]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array(added[f.name], f.type) for f in ARROW_ADDED],
                names=kept + ARROW_ADDED.names,
            )

    return docs.mapInArrow(search, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with n_words, n_hit, hit_items (sorted distinct item ids as strings) and hit_runs.

    A run is the words first_word..last_word (from 0), code points start (inclusive) to end (exclusive).
    Input columns named like an added one, in any case, are replaced.  A null or empty text has no words
    and no hits; items without words have no windows; a null item_id hits but is not listed; repeated rows
    are each searched; an empty benchmark hits nothing.
    """
    docs = renamed_apart(docs, ADDED.fieldNames())
    item = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary").alias("text"))
    size = item.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        items = [(r[0], bytes(r[1]) if r[1] is not None else None) for r in item.filter(of == block).collect()]
        docs = _scan(docs, text_col, items, window)
        if block < blocks - 1:
            docs = stored(docs, "decontamination")
    return docs


def without_runs(text_col: str = "text") -> F.Column:
    """The text with every hit run taken out, from the columns of `find_contamination`."""
    text = F.col(f"`{text_col}`")
    pieces = F.aggregate(
        "hit_runs",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, run: F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (run["start"] - acc["at"]).cast("int"))).alias("out"),
            run["end"].alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))),
    )
    return F.when(F.size("hit_runs") == 0, text).otherwise(pieces)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: words, words hit, items hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS n, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(ws) - {WINDOW - 1}, 1))) AS t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
  FROM d, lens, unnest(generate_series(1, len(ws) - n + 1)) AS t(i) WHERE len(ws) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m))
  GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
