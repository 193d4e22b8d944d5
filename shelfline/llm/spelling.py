"""Spelling variants of a corpus's words: near words by wildcard groups, without a pair being built.

Two words are near if exactly one inserted, deleted or replaced character parts them.  Words that are apart by
one replaced character share exactly one (position, prefix, suffix) group, so the groups of a word, taken
together, count each such neighbour once.  A group is kept as its size and its two most frequent words: what a
member has there is the size less itself, and the best word, or the second where the best is the member itself.
A group has one word for each letter at most, and so no group is hot.

The strings that are left when one character is deleted from a word, each taken once, join the vocabulary.  A match
makes the longer word a neighbour of the shorter and the other way round.  Counts and best words of both kinds are
combined by word.

Groups and strings are known by two 64-bit sums of mixed (character, place) codes.  Taking a character out, or
putting the wildcard in its place, changes a sum by a difference of prefix sums, so a word of any length makes as
many rows of one width as it has characters.  Words stand as ids that sort as they do, so that ties need no
strings.  Two of s different strings share both sums with a chance of about s**2 / 2**129.
"""

from __future__ import annotations

import re
import zlib
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form is at least so many times as frequent.
RATIO = 10
#: One run in so many is given without one of its characters.
DELETED = 31
#: Distinct words that a task counts before it passes them on; rows in a batch of wildcard groups, about.
HELD = 200_000
BATCH = 1 << 17

_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])
REPLACED, DELETION, ITSELF = 0, 1, 2
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def varied(doc: str, run: str, one_in: int = DELETED) -> str:
    """`run`, or for one run of a document in `one_in`, chosen by a checksum of both, the run without one character."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of LETTERS in all texts, A-Z lower-cased, as `varied` gives them, with their counts.

    Words of at least `least_length` characters and `least_count` occurrences.  A null or empty text has no words;
    a null id is written as nothing before the colon; repeated rows count as often as they occur; a text of any
    length is taken whole; other columns play no part.  Tasks count before the shuffle, so frequent words are sent
    once for each HELD words.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # a shorter run only becomes shorter

    def count(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text, doc = text.as_py(), doc.as_py()
                if not text:
                    continue
                own: dict[str, int] = {}
                for run in runs.finditer(text):
                    run = run.group().translate(_ASCII_LOWER)
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    word = varied("" if doc is None else doc, run)
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=_WORDS)
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=_WORDS)

    narrow = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    found = narrow.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(letters: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(_mixed(letters + np.uint64(seed)) + places * np.uint64(0x9E3779B97F4A7C15))


#: The wildcard stands for a character that no text holds.
_WILD = np.array([0x110000], dtype=np.uint64)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def wildcard_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(kind, index of the word, [first sums, second sums]) of all groups, deletions and words of `words`.

    A word with a run of equal letters gives each string that is left by a deletion once.
    """
    size = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(size)
    starts = ends - size
    of = np.repeat(np.arange(len(words)), size)
    place = (np.arange(len(letters)) - starts[of]).astype(np.uint64)
    again = np.zeros(len(letters), dtype=bool)
    again[1:] = (letters[1:] == letters[:-1]) & (place[1:] > 0)
    once = np.flatnonzero(~again)
    sums = []
    for seed in _SEEDS:
        here = _codes(letters, place, seed)
        moved = _codes(letters, place - np.uint64(1), seed)
        before = np.concatenate([[np.uint64(0)], np.cumsum(here, dtype=np.uint64)])
        after = np.concatenate([[np.uint64(0)], np.cumsum(moved, dtype=np.uint64)])
        whole = before[ends] - before[starts]
        wild = whole[of] - here + _codes(_WILD, place, seed)
        short = (before[once] - before[starts[of[once]]]) + (after[ends[of[once]]] - after[once + 1])
        sums.append(np.concatenate([wild, short, whole]))
    kind = np.repeat(np.array([REPLACED, DELETION, ITSELF], dtype=np.int8), [len(letters), len(once), len(words)])
    return kind, np.concatenate([of, of[once], np.arange(len(words))]), sums


def _keys_of(vocabulary: DataFrame) -> DataFrame:
    """(kind, a, b, id, n): a row for each wildcard group, each deletion and each word of `vocabulary`."""

    def made(ids, counts, words):
        kind, of, (a, b) = wildcard_keys(words)
        ids, counts = np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64)
        columns = [kind, a.view(np.int64), b.view(np.int64), ids[of], counts[of]]
        for i in range(0, len(kind), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + BATCH]) for c in columns], schema=_KEYS)

    def expand(batches):
        for batch in batches:
            ids, counts, words, held = [], [], [], 0
            for i, n, word in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids.append(i)
                counts.append(n)
                words.append(word)
                held += 2 * len(word) + 1
                if held >= BATCH:
                    yield from made(ids, counts, words)
                    ids, counts, words, held = [], [], [], 0
            if words:
                yield from made(ids, counts, words)

    return vocabulary.select("id", "n", "word").mapInArrow(expand, "kind tinyint, a long, b long, id long, n long")


def _best(n: str, word: str) -> F.Column:
    """Sorts before others if more frequent, or as frequent and first in code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("id"))


def near_words(keys: DataFrame) -> DataFrame:
    """(id, n_near, best) of every word with a near word, from what `_keys_of` gives; best is (-n, id)."""
    groups = (
        keys.filter(F.col("kind") == REPLACED)
        .groupBy("a", "b")
        .agg(F.sort_array(F.collect_list(_best("n", "id"))).alias("of"))  # one word for each letter at most
        .select((F.size("of") - 1).cast("long").alias("others"), F.col("of")[0].alias("top"), F.get("of", F.lit(1)).alias("second"), "of")
        .filter("others > 0")
    )
    replaced = groups.select("others", "top", "second", F.explode("of.id").alias("id")).select(
        "id", F.col("others").alias("n_near"), F.when(F.col("top.id") == F.col("id"), F.col("second")).otherwise(F.col("top")).alias("best")
    )
    shorter = keys.filter(F.col("kind") == ITSELF).select("a", "b", F.col("id").alias("short_id"), F.col("n").alias("short_n"))
    met = keys.filter(F.col("kind") == DELETION).drop("kind").join(shorter, ["a", "b"])
    sides = F.array(
        F.struct(F.col("id"), _best("short_n", "short_id").alias("best")),
        F.struct(F.col("short_id").alias("id"), _best("n", "id").alias("best")),
    )
    indels = met.select(F.explode(sides).alias("x")).select("x.id", F.lit(1).cast("long").alias("n_near"), "x.best")
    return replaced.unionByName(indels).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variant_groups(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of `counts` (word, n): distinct words, any length.

    form is the near word of largest n, the first in code-point order of equal ones, if it is at least `ratio`
    times as frequent, else null.  root is where forms lead at last, or the word itself.  Null words are left
    out, an empty word has no neighbours but words of one letter; no words give no rows.
    """
    scratch = Scratch(counts.sparkSession)
    # Ids rise from partition to partition of a range and within each, and so sort as the words do.
    sorted_ = counts.filter("word IS NOT NULL").select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    vocabulary = scratch.stored(sorted_.withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(scratch.stored(_keys_of(vocabulary), "wildcards"))
    found = vocabulary.select("id", "n").join(near, "id", "left")
    formed = (F.col("best").isNotNull()) & (-F.col("best.less") >= F.lit(ratio) * F.col("n"))
    found = scratch.stored(
        found.select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.id")).alias("form_id"), F.when(formed, -F.col("best.less")).alias("form_n")),
        "near",
    )
    # Each form is `ratio` times as frequent as its word, which bounds the chain; each round doubles what is followed.
    forms = found.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id"))
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    followed = 1
    while followed < log2(max(2, most)) / log2(ratio):
        ahead = forms.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        forms = scratch.stored(forms.join(ahead, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id")), "roots")
        followed *= 2
    spelled = vocabulary.select(F.col("id").alias("of"), F.col("word").alias("text"))
    led = (
        found.filter("form_id IS NOT NULL")
        .join(forms, "id")
        .join(spelled.withColumnsRenamed({"of": "form_id", "text": "form"}), "form_id")
        .join(spelled.withColumnsRenamed({"of": "root_id", "text": "root"}), "root_id")
        .select("id", "form", "root")
    )
    return (
        vocabulary.join(found.drop("form_id"), "id")
        .join(led, "id", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their near words counted, the form of each and the root it leads to."""
    return variant_groups(word_counts(table(spark, sf_dir, "documents")))


def _op13_sql() -> str:
    from shelfline.llm.manifest import crc32_sql

    checksum = crc32_sql("bytes")
    # Bytes of the UTF-8 text, each as the character of its number: letters over U+007F have two bytes here.
    two = "list_aggregate(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE chr(192 + (ord(c) >> 6)::INT) || chr(128 + (ord(c) & 63)::INT) END), 'string_agg', '')"
    lowered = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, {lowered} AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]+')) AS r FROM documents)),
each AS (SELECT doc, run, {two} AS bytes, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc, run),
summed AS (SELECT run, n, {checksum} AS h FROM each),
words AS (
  SELECT CASE WHEN h % {DELETED} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM summed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
wild AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS k FROM cut),
gone AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM cut),
near AS (
  SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT a.word, v.word, v.n FROM gone a JOIN v ON v.word = a.k
  UNION ALL SELECT v.word, a.word, a.n FROM gone a JOIN v ON v.word = a.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {RATIO} * v.n THEN r.other END AS form, CASE WHEN r.n >= {RATIO} * v.n THEN r.n END AS form_n
  FROM v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
chain AS (
  SELECT word, word AS at_word FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at_word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at_word AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at_word AND e.form IS NULL
"""


OP13_SQL = _op13_sql()
