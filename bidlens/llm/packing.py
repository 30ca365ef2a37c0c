"""Best-fit packing, planned over a histogram of lengths.

A document is its token ids and one closing id.  Only longer ones are cut, into
pieces of ``CAPACITY`` tokens.  How many pieces have each length is a histogram
of ``CAPACITY`` rows at most, whatever the corpus; best fit, longest first, is
planned over these counts: a run of equal sequences takes as many pieces of one
length as fit.  A piece then takes the slot that the plan holds for its rank
among the pieces of its length.

Ranks are counted by range-partitioned running totals, so a length that a third
of all pieces have is spread over many tasks.  A run is touched by at most
log2(CAPACITY) lengths, because each touch more than halves its free room, and a
length splits at most two runs; so the plan has fewer than 2 * 12 * CAPACITY
rows, and it is broadcast.

Defined results: NULL text counts as empty; an empty text is its closing id
alone; ids may be NULL or repeated, since pieces are told apart by their own row
number; equal lengths are placed in row order; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.bpe import WordFile, byte_alphabet, little_endian, slices, words_of
from bidlens.operators.prefix import running_totals
from bidlens.session import materialize

CAPACITY = 4096
CLOSING_ID = 1
KEPT_WORDS = 600_000
PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


class KnownWords(dict):
    """Ids per stretch between white space, kept as they are found.

    The stretch is normalised and split into words as the tokenizer file says.  A
    word's bytes and an end byte that no UTF-8 text holds go to the byte-pair
    merger of the tiktoken library, whose ranks are the file's: first every byte
    with the end byte, then the merges.  As every token of the file is what merging
    its own symbols gives, looking for the token of lowest rank, as that library
    does, and for the pair of lowest rank are the same.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        self.file = WordFile(path)
        byte_of = {c: bytes([b]) for b, c in byte_alphabet().items()}
        ranks = {}
        for token, i in self.file.ids.items():
            body = token.removesuffix(self.file.end) or token
            ranks[b"".join(map(byte_of.__getitem__, body)) + (self.END if body != token else b"")] = i
        ranks.setdefault(self.END, len(ranks))
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={}
                                       )._encode_single_piece

    def __missing__(self, surface: str) -> bytes:
        ids = array("I")
        for part in self.file.parts_of(surface):
            ids.extend(self.merge(part.encode() + self.END) if isinstance(part, str) else [part])
        found = self[surface] = little_endian(ids)
        return found


class WordwiseEncoder:
    """Ids of texts, merged once per distinct stretch between white space."""

    def __init__(self, path: str):
        self.known = KnownWords(path)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
            yield b"".join(map(self.known.__getitem__, words_of(text)))


_ENCODERS: dict[str, WordwiseEncoder] = {}


def _encoder(path: str) -> WordwiseEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordwiseEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    closing = little_endian(array("I", [closing_id]))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _encoder(path)
        for batch in batches:
            names = batch.column(0)
            for first, texts in slices(batch.column(1)):
                rows = []
                for i, ids in enumerate(tool.encode_batch(texts)):
                    whole = ids + closing
                    name = names[first + i].as_py()
                    rows += [(name, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part))
                             for at in range(0, len(whole), 4 * capacity)
                             if (part := whole[at:at + 4 * capacity])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, f.type) for values, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, PIECE_FIELDS)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first.

    Rows: length, first rank, pieces, first sequence, pieces per sequence, offset.
    A run is a range of sequences with the same free room; the smallest room that
    still holds the length is taken, and it holds as many pieces as go in.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan, next_sequence = [], 0

    def put_back(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room = capacity
                first, count = next_sequence, -(-left // (capacity // length))
                next_sequence += count
            each = room // length
            filled = min(count, left // each)
            if filled:
                plan.append((length, rank, filled * each, first, each, capacity - room))
                put_back(room - each * length, first, filled)
                rank, left = rank + filled * each, left - filled * each
            if left and filled < count:  # fewer than a sequence's worth are left
                plan.append((length, rank, left, first + filled, left, capacity - room))
                put_back(room - left * length, first + filled, 1)
                filled, left = filled + 1, 0
            put_back(room, first + filled, count - filled)
    return plan


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, path, doc_id, text, capacity)
                         .withColumn("row", F.monotonically_increasing_id())
                         .withColumn("one", F.lit(1).cast("long")), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(
        plan_best_fit(histogram, capacity),
        "planned long, first_rank long, pieces long, first_sequence long, each long, place long")
    ranked = running_totals(pieces, ["row"], {"upto": "one"}, ["length"], "ranked-pieces")
    rank = F.col("upto") - 1
    slots = ranked.join(F.broadcast(plan), (F.col("length") == F.col("planned")) & (rank >= F.col("first_rank"))
                        & (rank < F.col("first_rank") + F.col("pieces")))
    within = rank - F.col("first_rank")
    return slots.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(within / F.col("each"))).alias("sequence_id"),
        (F.col("place") + F.pmod(within, F.col("each")) * F.col("length")).alias("offset"))
