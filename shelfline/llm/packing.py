"""Packing of tokenised documents into sequences: best fit in partitions, then a tree of merges of what is left.

Documents become ids, an end id after each, and only those longer than a sequence are cut.  Pieces that fill a
sequence are done.  The others are dealt by a hash, so that every leaf of the tree sees lengths as the whole
table has them, and each leaf packs its own by best fit, longest first.  Sequences that are nearly full are
emitted; the others go on as items, whose length is what they hold, and `FAN` nodes together pack them again, up
to the root.

Best fit leaves at most one sequence at most half full in a node (two would have been one), and two items of more
than half never share a sequence.  So T leaves leave T movable items at most, and no node can use more than
T sequences of another one: each node sends its T emptiest and emits the rest.  What the emptiest T can't take,
none of the others could.  Leaves grow with the root of the number of pieces, so that neither a leaf nor the
root of the tree, which gets FAN * T rows of 16 bytes, outgrows a task.
"""

from __future__ import annotations

import os
import re
import zlib
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, renamed_apart, table

CAPACITY = 4096
END_ID = 1
#: Items of a leaf, at least; nodes that merge into one.
LEAF = 1 << 12
FAN = 16
#: A sequence with fewer free places is nearly full.
SLACK = 8
#: Characters tokenised at a time; chunks that a worker remembers, and as many words; the longest chunk that it does;
#: words in one request.
WINDOW = 1 << 20
REMEMBERED = 1_000_000
LONGEST = 64
JOINED = 512
#: Letters that lower-case one by one, and marks that are no part of a contraction or of an added token.
PARTED = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]{0,64})([.,;:!?*#$%&()\"]{0,64})|(.+))$", re.MULTILINE)
#: Ends of lines as the pattern above sees them; all are white space to the library.
ENDS = re.compile(r"\n")
WORD_END = "</w>"
#: Moves of merged sequences that are sent to every task, at most (24 bytes each); more are joined by shuffle.
MOST_SENT = 1_000_000

# --- tokenising --------------------------------------------------------------------------------------------

_workers: dict[str, "ChunkIds"] = {}


class ChunkIds:
    """Little-endian 32-bit ids of what stands between two spaces, asked of the library once and then remembered.

    The library's normaliser and its cuts never reach over a space, so the ids of the chunks one after another are
    those of the text.  A chunk of letters and marks of punctuation after them is cut between the two, and its
    letters are asked for in lower case, many words at once: each ends with the id of an end of a word.
    Vocabularies whose added tokens hold or take spaces, or that don't lower-case or mark the ends of words, are
    asked for whole chunks, or refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        for token in self.library.get_added_tokens_decoder().values():
            if token.lstrip or token.rstrip or token.single_word or " " in token.content:
                raise ValueError(f"added token {token.content!r} reaches over spaces")
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.cuts = self._ask("Ab,") == self._ask("ab") + self._ask(",") and self._ask("ab cd") == self._ask("ab") + self._ask("cd")
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ask(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        runs = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        found = self.library.encode_batch_fast([" ".join(run) for run in runs], add_special_tokens=False)
        for run, encoded in zip(runs, found):
            ids = np.array(encoded.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(run) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                self.words.update(zip(run, map(raw.__getitem__, map(slice, [0, *ends], ends))))
            else:
                self.words.update((word, self._ask(word)) for word in run)

    def _learn(self, chunks: list[str]) -> None:
        # None of the chunks holds a line's end, so one search over all of them parts each by itself.
        parts = PARTED.findall("\n".join(chunks)) if self.cuts else [("", "", chunk) for chunk in chunks]
        words = [word.lower() for word, _, _ in parts]
        asked = set(words).difference(self.words)
        if len(self.words) + len(asked) > REMEMBERED:
            self.words.clear()
            asked = set(words)
        asked.discard("")
        self._learn_words(list(asked))
        for mark in {mark for _, mark, _ in parts}.difference(self.marks):
            self.marks[mark] = self._ask(mark)
        of_word, of_mark = self.words.get, self.marks.__getitem__
        for chunk, word, (_, mark, other) in zip(chunks, words, parts):
            self.chunks[chunk] = self._ask(other) if other else of_word(word, b"") + of_mark(mark)

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        chunked = [ENDS.sub(" ", t).split(" ") if ENDS.search(t) else t.split(" ") for t in texts]
        needed = set().union(*chunked)
        new = needed.difference(self.chunks)
        if len(self.chunks) + len(new) > REMEMBERED:
            self.chunks.clear()
            self.marks.clear()
            new = needed
        self._learn(list(new))
        out = [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in chunked]
        for chunk in new:
            if len(chunk) > LONGEST:
                del self.chunks[chunk]
        return out


def _windows(text: str):
    """Parts of a text of some WINDOW characters, cut at spaces, which no id reaches over."""
    i = 0
    while i < len(text):
        j = text.find(" ", i + WINDOW)
        j = len(text) if j < 0 else j
        yield text[i:j]
        i = j + 1


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
#: Pieces of a batch, at most.
BATCH = 1 << 12


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of all documents, cut where they are longer than `capacity`.

    ids are little-endian 32-bit, with the end id after each document.  A null or empty text is its end id alone;
    a text of any length is taken whole, window by window; rows with null or repeated ids are documents of their
    own; an empty table gives no rows; columns other than doc_id and text play no part.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    each = 4 * capacity

    def cut(batches):
        if vocabulary not in _workers:
            _workers[vocabulary] = ChunkIds(vocabulary)
        known = _workers[vocabulary]

        def made(docs: list, texts: list[str]):
            rows = []
            ids_of = known.of(texts) if len(texts) > 1 else [b"".join(known.of([w])[0] for w in _windows(texts[0]))]
            for doc, ids in zip(docs, ids_of):
                ids += end
                for k, at in enumerate(range(0, len(ids), each)):
                    part = ids[at : at + each]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            for i in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + BATCH]), PIECES)], schema=PIECES)

        for batch in batches:
            docs, texts, held = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                if texts and held + len(text) > WINDOW:
                    yield from made(docs, texts)
                    docs, texts, held = [], [], 0
                docs.append(doc.as_py())
                texts.append(text)
                held += len(text)
            if texts:
                yield from made(docs, texts)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


# --- packing -----------------------------------------------------------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first item of the bin of each item, offset of each item, what each first item's bin holds, else 0).

    Longest first, ties in the order given; each goes to the fullest bin that takes it.
    """
    into, offset, holds = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    with_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g is set if a bin has g free places
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = gaps >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            first = with_gap[gap].pop()
            if not with_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, first = capacity, i
        into[i], offset[i] = first, capacity - gap
        holds[first] += n
        if gap > n:
            with_gap[gap - n].append(first)
            gaps |= 1 << (gap - n)
    return into, offset, holds


def _merged(items: DataFrame, capacity: int, sends: int) -> DataFrame:
    """`items` (node, id, n, ...) with into, offset and left: what the bin holds, at a first item that goes on."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
        ids, lengths = t.column("id").to_numpy(), t.column("n").to_numpy()
        into, offset, holds = best_fit(lengths, capacity)
        first = np.flatnonzero(into == np.arange(len(ids)))
        open_ = first[holds[first] <= capacity - SLACK]
        goes = np.zeros(len(ids), dtype=bool)
        goes[open_[np.argsort(holds[open_], kind="stable")[:sends]]] = True
        t = t.append_column("into", pa.array(ids[into] if len(ids) else ids))
        t = t.append_column("offset", pa.array(offset))
        return t.append_column("left", pa.array(holds, mask=~goes))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.groupBy("node").applyInArrow(pack, f"{kinds}, into long, offset long, left long")


def pack(items: DataFrame, key: str, length: str, capacity: int = CAPACITY, leaf: int = LEAF) -> DataFrame:
    """`items` with sequence_id and offset: in as few sequences of at most `capacity` as best fit finds.

    `key` is a distinct long for each row, `length` its length: null is 0, and an item of `capacity` or more has a
    sequence of its own.  A sequence_id is the key of a sequence's first item.  Items without length still have a
    place; an empty table gives no rows; columns of the names that this adds are replaced, all others are kept.
    Equal keys and lengths give equal sequences.
    """
    scratch = Scratch(items.sparkSession)
    items = renamed_apart(items, ["sequence_id", "offset"])
    carried = [F.col(f"`{c}`") for c in items.columns]
    base = items.select(
        F.struct(*carried).alias("rec"), F.col(f"`{key}`").alias("id"), F.greatest(F.lit(0), F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0))).alias("n")
    )
    small = base.filter(F.col("n") < capacity)
    count = small.count()
    leaves = max(1, ceil(count / max(leaf, 4 * isqrt(count))))
    dealt = small.withColumn("node", F.pmod(F.xxhash64("id"), F.lit(leaves)).cast("int"))
    local = scratch.stored(_merged(dealt, capacity, leaves), "leaves")

    rounds, level, nodes = [], local, leaves
    while nodes > 1:
        nodes = ceil(nodes / FAN)
        left = level.filter("left IS NOT NULL").select(F.expr(f"node div {FAN}").cast("int").alias("node"), "id", F.col("left").alias("n"))
        level = scratch.stored(_merged(left, capacity, leaves), "merges")
        rounds.append(level.filter("into <> id").select("id", "into", "offset"))

    moves = None  # (id, to, by): where a sequence's content finally is
    for made in reversed(rounds):
        if moves is None:
            moves = made.withColumnsRenamed({"into": "to", "offset": "by"})
            continue
        on = moves.select(F.col("id").alias("into"), F.col("to").alias("next"), F.col("by").alias("more"))
        resolved = made.join(on, "into", "left").select("id", F.coalesce("next", "into").alias("to"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("by"))
        moves = resolved.unionByName(moves)
    placed = local.select("rec", "into", "offset")
    if moves is None:
        placed = placed.select("rec", F.col("into").alias("sequence_id"), "offset")
    else:
        moves = scratch.stored(moves, "moves").withColumnRenamed("id", "into")
        if moves.count() <= MOST_SENT:
            moves = F.broadcast(moves)
        placed = placed.join(moves, "into", "left").select(
            "rec", F.coalesce("to", "into").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
        )
    own = base.filter(F.col("n") >= capacity).select("rec", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(own).select("rec.*", "sequence_id", "offset")


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of `cut_documents`: doc_id, piece, start, length, ids_crc32, key, sequence_id, offset.

    Odd rows are as `cut_documents` says.  With `with_ids`, the ids travel along.
    """
    pieces = cut_documents(docs, vocabulary, capacity, end_id)
    pieces = pieces if with_ids else pieces.drop("ids")
    keyed = Scratch(docs.sparkSession).stored(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces", compression="zstd")
    return pack(keyed, "key", "length", capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, starts) of every sequence: its pieces' ids one after another.

    Takes what `packed_documents` gives with ids; doc_ids and starts say which documents begin where in it.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    made = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return made.select("sequence_id", "n_tokens", ids.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 ids."""
    import public_tokenizers

    packed = packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
