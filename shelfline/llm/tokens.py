"""Token ids in a binary format: static range asymmetric numeral systems over one shared frequency table.

Writing: texts are tokenised once to a narrow table; counts of ids over all of it give the frequency table
(2**PRECISION slots, shared by all frames and stored beside them); documents are dealt by id ranges to parts,
sorted, and cut into frames of whole documents.  A frame holds LANES interleaved coder states, emits 32-bit
words, and is a self-contained byte string: header, checkpoints (word offset, checksum and all states at every
CHECKPOINT steps) and words.  Frames decode apart from each other, and so do the segments between checkpoints.

Tokenising: texts are cut before every space that follows a non-space, and between an ASCII letter and ASCII
punctuation.  Byte-level BPE always breaks there, so the library's ids of the pieces, one after another, are its
ids of the text; each worker asks the library once for each distinct piece it meets (up to a bound) and looks up
the others.  For the same reason it may ask for many pieces in one string, and tell them apart by the bytes that
each id stands for.  Texts are cut first where the vocabulary's added tokens stand, as the library does.

Pieces are known by two 64-bit hashes: a piece whose first hash is that of another is asked for itself.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, table, work_path
from shelfline.llm.hashing import span_hashes, texts_of

END_ID = 2
#: Bytes of text in a part, about; tokens in a frame, about.
PART_BYTES = 16 << 20
#: Parts at most (their bounds go to every task); beyond it parts grow, and are sorted and framed from disk.
MOST_PARTS = 1 << 16
#: Ids are written in 16 bits.
MOST_IDS = 1 << 16
FRAME_TOKENS = 1 << 18
LANES = 1024
CHECKPOINT = 128
PRECISION = 20
#: Parts whose starts are sent to every task, at most (16 bytes each); more are joined by shuffle.
MOST_SENT = 1_000_000
#: Bytes that one pass over pieces takes; pieces in one request; distinct pieces that a worker remembers.
WINDOW_BYTES = 1 << 20
JOINED = 512
REMEMBERED = 1_200_000
#: The base of the second hash of a piece.
SECOND = 0xD1342543DE82EF95

# --- tokenising --------------------------------------------------------------------------------------------

LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
PUNCTUATION = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
_workers: dict[str, "PieceTokenizer"] = {}


def opened(path: str):
    """The library's tokenizer at `path`; ValueError for one that this module can't write or cut texts for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    if max(library.get_vocab().values()) >= MOST_IDS:
        raise ValueError(f"the vocabulary has ids over {MOST_IDS - 1}")
    for token in library.get_added_tokens_decoder().values():
        if token.lstrip or token.rstrip or token.single_word or not token.content or re.search(r"\s", token.content):
            raise ValueError(f"added token {token.content!r} takes more than its own characters")
    return library


class PieceTokenizer:
    """Ids of byte strings, from the library's ids of their pieces, remembered by hashes of the pieces."""

    def __init__(self, path: str):
        self.library = opened(path)
        added = sorted((t.content.encode() for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        vocabulary = self.library.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each id: a character stands for one
        self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.second = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.n = np.empty(0, dtype=np.int64)
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0

    def _ask(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The library's ids of each piece."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, ids in each piece)."""
        plain = [len(p) > 1 and p[0] == 32 and p[1] > 32 and p[-1] > 32 and p[-1] != 127 for p in pieces]
        many = [p for p, ok in zip(pieces, plain) if ok]
        runs = [b"".join(many[i : i + JOINED]) for i in range(0, len(many), JOINED)]
        joined = np.concatenate([np.empty(0, dtype=np.uint32), *self._ask(runs)])
        ends = np.cumsum(self.width[joined])
        bounds = np.cumsum([len(p) for p in many])
        last = np.searchsorted(ends, bounds)
        if len(many) and not (ends[last] == bounds).all():
            raise AssertionError("an id crosses a break between pieces")
        single = self._ask([p for p, ok in zip(pieces, plain) if not ok])
        n = np.empty(len(pieces), dtype=np.int64)
        plain = np.array(plain, dtype=bool)
        n[plain] = np.diff(last + 1, prepend=0)
        n[~plain] = [len(x) for x in single]
        out = np.empty(int(n.sum()), dtype=np.uint32)
        of_plain = np.repeat(plain, n)
        out[of_plain] = joined
        out[~of_plain] = np.concatenate([np.empty(0, dtype=np.uint32), *single])
        return out, n

    def _learn(self, keys: np.ndarray, second: np.ndarray, pieces: list[bytes]) -> None:
        flat, n = self._ids_of(pieces)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        into = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, into, keys)
        self.second = np.insert(self.second, into, second)
        self.at = np.insert(self.at, into, self.used + np.cumsum(n) - n)
        self.n = np.insert(self.n, into, n)
        self.used += len(flat)

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key among those remembered, whether it is there)."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool))

    def _window(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after another, ids in each piece); starts and ends are offsets in data."""
        keys, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        second = span_hashes(data, starts, ends, SECOND)
        at, there = self._known(keys)
        if not there.all():
            new = np.flatnonzero(~there)
            if len(self.keys) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(keys))
            raw = data.tobytes()
            self._learn(keys[new], second[first[new]], [raw[starts[i] : ends[i]] for i in first[new]])
            at, _ = self._known(keys)
        if (self.second[at][which] != second).any():  # different pieces of one hash
            raw = data.tobytes()
            return self._ids_of([raw[a:b] for a, b in zip(starts, ends)])
        n, at = self.n[at][which], self.at[at][which]
        before = np.cumsum(n) - n
        return self.ids[np.repeat(at - before, n) + np.arange(int(n.sum()))], n

    def _added(self, data: np.ndarray, offsets: np.ndarray):
        """(start, end) of every added token that stands in one text, leftmost and then longest first."""
        raw, at = data.tobytes(), 0
        while self.added and (hit := self.added.search(raw, at)):
            inside = np.searchsorted(offsets, hit.start(), side="right") == np.searchsorted(offsets, hit.end(), side="left")
            if inside:
                yield hit.span()
            at = hit.end() if inside else hit.start() + 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END_ID; ids in each text with the end) of data[offsets[i]:offsets[i+1]]."""
        size = len(data)
        cut = np.zeros(size + 1, dtype=bool)
        if size:
            cut[1:size] = (data[1:] == 32) & (data[:-1] > 32) & (data[:-1] != 127)
            cut[1:size] |= PUNCTUATION[data[1:]] & LETTER[data[:-1]]
            cut[offsets] = True
            cut[size] = True
            for a, b in self._added(data, offsets):
                cut[a:b] = False
                cut[[a, b]] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        all_ids, all_n, i = [], [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + WINDOW_BYTES, side="right")))
            a, b = int(starts[i]), int(ends[j - 1])
            if b - a > WINDOW_BYTES:  # one piece without a break
                ids = self._ask([data[a:b].tobytes()])[0]
                n = np.array([len(ids)])
            else:
                ids, n = self._window(data[a:b], starts[i:j] - a, ends[i:j] - a)
            all_ids.append(ids)
            all_n.append(n)
            i = j
        n = np.concatenate([[0], *all_n]).astype(np.int64)
        of_text = np.cumsum(n)[np.searchsorted(starts, offsets)]
        counts = np.diff(of_text) + 1
        out = np.full(int(counts.sum()), END_ID, dtype=np.uint32)
        own = np.ones(len(out), dtype=bool)
        own[np.cumsum(counts) - 1] = False
        if all_ids:
            out[own] = np.concatenate(all_ids)
        return out, counts


def _binary_array(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def tokenised(docs: DataFrame, vocabulary: str, bounds: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, doc_id, n_tokens, ids) for every document; ids are little-endian 16-bit, part counts bounds up to the id."""
    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")
    )
    limits = np.array(bounds, dtype=np.int64)

    def encode(batches):
        if vocabulary not in _workers:
            _workers[vocabulary] = PieceTokenizer(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = _workers[vocabulary].encode(*texts_of(batch.column(1)))
            doc_id = batch.column(0)
            part = np.searchsorted(limits, doc_id.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), doc_id, pa.array(counts), _binary_array(ids.astype("<u2"), counts)],
                names=["part", "doc_id", "n_tokens", "ids"],
            )

    return narrow.mapInArrow(encode, "part int, doc_id long, n_tokens long, ids binary")


# --- the coder ---------------------------------------------------------------------------------------------

LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4sIIIIII")
MAGIC = b"RNS1"


def frequencies(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Slots of each id: about in proportion to counts, one at least for each id that occurs, 2**precision in all."""
    total = int(counts.sum())
    slots = np.zeros(len(counts), dtype=np.int64)
    if not total:
        return slots
    seen = counts > 0
    if int(seen.sum()) > 1 << precision:
        raise ValueError("more distinct ids than slots")
    slots[seen] = np.maximum(1, (counts[seen].astype(np.float64) / total * (1 << precision)).astype(np.int64))
    order = np.argsort(-slots, kind="stable")
    while (off := (1 << precision) - int(slots.sum())) != 0:
        able = order[slots[order] > 1] if off < 0 else order[seen[order]]
        slots[able[: abs(off)]] += 1 if off > 0 else -1
    return slots


class Coder:
    """Encodes and decodes frames with one frequency table."""

    def __init__(self, slots: np.ndarray, precision: int = PRECISION):
        self.bits = np.uint64(precision)
        self.slots = slots.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(slots)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(slots), dtype=np.uint32), slots)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        slots, below = self.slots[ids], self.below[ids]
        words: list[np.ndarray] = []
        marks: list[tuple[int, bytes]] = []  # words from here to the end, states
        written = 0
        for s in range(steps - 1, -1, -1):
            f, c = slots[s * lanes : (s + 1) * lanes], below[s * lanes : (s + 1) * lanes]
            x = state[: len(f)]
            full = x >= (f << (np.uint64(63) - self.bits))
            out = x[full].astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(f)] = (q << self.bits) + (x - q * f) + c
            words.append(out)
            written += len(out)
            if s % every == 0:
                marks.append((written, state.astype("<u8").tobytes()))
        marks.reverse()
        segments = []
        for k, (after, states) in enumerate(marks):
            part = ids[k * every * lanes : (k + 1) * every * lanes]
            segments.append(struct.pack("<II", written - after, zlib.crc32(part.astype("<u4").tobytes())) + states)
        body = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
        head = HEADER.pack(MAGIC, len(ids), lanes, every, len(segments), written, zlib.crc32(body))
        return head + b"".join(segments) + body

    def decode(self, frame: bytes) -> np.ndarray:
        """The ids of a frame; ValueError if a checksum does not hold."""
        magic, n, lanes, every, segments, n_words, crc = HEADER.unpack_from(frame)
        each = 8 + 8 * lanes
        body = HEADER.size + segments * each
        if magic != MAGIC or len(frame) != body + 4 * n_words or zlib.crc32(frame[body:]) != crc:
            raise ValueError("not a whole frame")
        words = np.frombuffer(frame, dtype="<u4", offset=body).astype(np.uint64)
        return np.concatenate([np.empty(0, dtype=np.uint32)] + [self._segment(frame, words, k, n, lanes, every, each) for k in range(segments)])

    def _segment(self, frame: bytes, words: np.ndarray, k: int, n: int, lanes: int, every: int, each: int) -> np.ndarray:
        at = HEADER.size + k * each
        word, crc = struct.unpack_from("<II", frame, at)
        state = np.frombuffer(frame, dtype="<u8", count=lanes, offset=at + 8).astype(np.uint64)
        out = np.empty(min(n - k * every * lanes, every * lanes), dtype=np.uint32)
        low = np.uint64((1 << int(self.bits)) - 1)
        for a in range(0, len(out), lanes):
            x = state[: min(lanes, len(out) - a)]
            slot = x & low
            ids = self.symbol[slot]
            x = self.slots[ids] * (x >> self.bits) + slot - self.below[ids]
            short = np.flatnonzero(x < LOW)
            x[short] = (x[short] << np.uint64(32)) | words[word : word + len(short)]
            word += len(short)
            state[: len(x)] = x
            out[a : a + len(x)] = ids
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a segment's checksum does not hold")
        return out


# --- files -------------------------------------------------------------------------------------------------

FRAMES = pa.schema(
    [("part", pa.int32()), ("frame", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("data", pa.binary())]
)
FRAMES_DDL = "part int, frame int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, data binary"


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents of `tokenised`: summed within tasks, then over them."""

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            total += np.bincount(texts_of(batch.column(0))[0].view("<u2"), minlength=1 << 16)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _table_of(rows) -> np.ndarray:
    counts = np.zeros(max([0, *(r[0] + 1 for r in rows)]), dtype=np.int64)
    for i, n in rows:
        counts[i] = n
    return counts


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all `docs` in ascending id order below `path`: tables `frames` and `frequencies`.

    Ids of documents are integers; null ids come first, repeated ids follow each other in the order of their
    tokens.  A null or empty text is its end id alone; a text of any length is one document of one frame; an
    empty table writes empty tables; a vocabulary with ids over 65,535 is refused (ValueError), as is one whose
    added tokens take white space around them; columns other than the two named play no part.
    """
    opened(vocabulary)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(F.col(f"`{text_col}`")).alias("size"))
    parts = min(MOST_PARTS, max(1, math.ceil((own.agg(F.sum("size")).first()[0] or 0) / PART_BYTES)))
    bounds = own.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    tokens = scratch.stored(tokenised(docs, vocabulary, sorted({int(b) for b in bounds}), id_col, text_col), "tokens", compression="zstd")

    rows = id_counts(tokens).collect()  # a row for each id of the vocabulary at most
    slots = frequencies(_table_of(rows))
    freq = [(int(i), int(slots[i])) for i in np.flatnonzero(slots)]
    spark.createDataFrame(freq, "id int, slots int").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(slots)

    def encode(batches):
        coder = Coder(shared.value)
        part, frame, first, docs_in, ids_in, held = None, 0, 0, [], [], 0

        def made():
            ids = np.concatenate(ids_in)
            row = [part, frame, first, len(ids), docs_in, [len(x) for x in ids_in], coder.encode(ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FRAMES)], schema=FRAMES)

        for batch in batches:
            for p, doc, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and (p != part or held >= FRAME_TOKENS):
                    yield made()
                    first, frame, docs_in, ids_in, held = first + held, frame + 1, [], [], 0
                if p != part:
                    part, frame, first = p, 0, 0
                docs_in.append(doc)
                ids_in.append(np.frombuffer(raw, dtype="<u2"))
                held += len(ids_in[-1])
        if held:
            yield made()

    dealt = tokens.select("part", "doc_id", "ids").repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    dealt.mapInArrow(encode, FRAMES_DDL).write.option("compression", "uncompressed").parquet(f"{path}/frames")
    scratch.clear()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document below `path`; ids are little-endian 32-bit integers.

    start counts the ids of all documents before it.  Frames are decoded apart from each other.
    """
    table_of = _table_of([(r["id"], r["slots"]) for r in spark.read.parquet(f"{path}/frequencies").collect()])
    shared = spark.sparkContext.broadcast(table_of)
    frames = spark.read.parquet(f"{path}/frames")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                ids = coder.decode(r["data"])
                counts = np.array(r["doc_tokens"], dtype=np.int64)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["first_token"] + np.cumsum(counts) - counts), pa.array(counts), _binary_array(ids.astype("<u4"), counts)],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    if bases.count() <= MOST_SENT:
        bases = F.broadcast(bases)
    read = frames.mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids binary")
    return read.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenised, written, and read back: where each starts, its length and its checksum."""
    import public_tokenizers

    path = work_path(spark, "rans")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
