"""Scoring texts with a hidden Markov language model.

Words are the stretches between ASCII white space, A-Z in lower case; every text
ends with an end token.  A word has one of SYMBOLS symbols, its crc32, and the end
token has one of its own.  Latent states emit symbols, and a symbol gives a word by
its smoothed share of the symbol's tokens; every symbol keeps half a count for all
words that training did not see.  So the states' tables have a fixed size while word
counts grow with the corpus and stay in tables, and the probabilities of all texts
add up to one.

``corpus`` reads the texts once.  Tasks take documents in batches and write two kinds
of rows: a batch with its documents as numbers of its own words, and those words, one
row per batch and word however often it occurs.  A window over equal words adds up
their training counts.  Baum-Welch: every task runs the scaled forward and backward
recursions over its training documents and gives expected counts per symbol, SYMBOLS
rows at most; Spark adds them up, and the new tables, bounded by SYMBOLS times STATES,
go back to the tasks.  Long texts are cut into chunks whose transfer matrices give the
states at every chunk's ends, so a text of any length is computed exactly, chunks side
by side.

``score`` brings a batch together with the counts of its words, except those that the
batch alone has, and adds the forward recursion's likelihood.

Defined results: NULL texts count as empty and hold the end token only; a NULL doc_id
counts as an empty id when it is dealt to training or held out; repeated rows are rows
of their own; words of any length are kept, those over 48 bytes by their SHA-256;
without training rows all counts are 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlens.session import materialize, new_table_path

STATES, SYMBOLS, ITERATIONS = 8, 1 << 15, 4
SEED = 12
PRIOR = 200.0  # tokens of the symbols' overall shares added to every state
CHUNK = 2_048  # tokens
BATCH_TOKENS, BATCH_DOCS = 1 << 19, 4_096
UNIT_TOKENS = 1 << 20  # tokens whose recursions run side by side: more make a step's fixed cost smaller
LONG_WORD = 48
TASK_BATCHES = 16  # batches an expectation task reads at least, as every task gives back a table of the model's size
PLACE_BITS, TASK_BITS = 25, 16  # a word's place: task, batch of the task, word of the batch
END = b""

CORPUS_SCHEMA = ("kind int, batch long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, symbols binary, "
                 "place long, word binary, train long")
CORPUS_NAMES = [c.split(" ")[0] for c in CORPUS_SCHEMA.split(", ")]


def words(text: str) -> list[bytes]:
    """Lower-cased words: bytes are split at ASCII white space and only A-Z have another case there."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def symbol(word: bytes) -> int:
    return SYMBOLS if word == END else zlib.crc32(word) % SYMBOLS


def _planes(numbers: np.ndarray) -> bytes:
    """Byte by byte, all lowest bytes first: the upper ones are mostly 0 and compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _batch_rows(number: int, ids: list, held: list, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """One batch of documents and its words."""
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__  # a new word has the next number
    end = place[END]
    rows = [np.array([place[w] for w in t] + [end], np.int64) for t in texts]
    names = [w if len(w) <= LONG_WORD else b" " + hashlib.sha256(w).digest() for w in place]
    if len(names) >> PLACE_BITS or (number & ((1 << TASK_BITS) - 1)) == (1 << TASK_BITS) - 1:
        raise ValueError("a batch or a task is too large to be numbered")
    sizes, flat, m = np.array([len(r) for r in rows]), np.concatenate(rows), len(names)
    symbols = (np.fromiter(map(zlib.crc32, names), np.int64, m) % SYMBOLS).astype(np.uint16)
    symbols[end] = SYMBOLS
    list_of = lambda v, t: pa.array([v], pa.list_(t))
    none = lambda n, t: pa.nulls(n, t)
    yield pa.RecordBatch.from_arrays([
        pa.array([0], pa.int32()), pa.array([number]), list_of(ids, pa.int64()), list_of(held, pa.bool_()), list_of(sizes, pa.int32()),
        pa.array([_planes(flat)], pa.binary()), pa.array([symbols.tobytes()], pa.binary()), none(1, pa.int64()), none(1, pa.binary()),
        none(1, pa.int64())], names=CORPUS_NAMES)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.ones(m, np.int32)), none(m, pa.int64()), none(m, pa.list_(pa.int64())), none(m, pa.list_(pa.bool_())),
        none(m, pa.list_(pa.int32())), none(m, pa.binary()), none(m, pa.binary()), pa.array((number << PLACE_BITS) + np.arange(m)),
        pa.array(names, pa.binary()), pa.array(_own_counts(flat, sizes, held, m))], names=CORPUS_NAMES)


def _own_counts(flat: np.ndarray, sizes: np.ndarray, held: list, m: int) -> np.ndarray:
    """Per word of a batch its tokens in the batch's training documents."""
    return np.bincount(flat[np.repeat(~np.array(held, bool), sizes)], minlength=m)


def _corpus_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << TASK_BITS
    ids, held, texts, tokens = [], [], [], 0
    for batch in batches:
        for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(doc_id)
            held.append(out)
            texts.append(words(text))
            tokens += len(texts[-1]) + 1
            if tokens >= BATCH_TOKENS or len(ids) >= BATCH_DOCS:
                yield from _batch_rows(number, ids, held, texts)
                number, (ids, held, texts, tokens) = number + 1, ([], [], [], 0)
    if ids:
        yield from _batch_rows(number, ids, held, texts)


class Corpus(NamedTuple):
    """Batches (batch, doc_ids, held, sizes, ids, symbols); training counts of their words (place, c, symbol, first, shared);
    per symbol its tokens and different words; all tokens and different words of training."""

    batches: DataFrame
    words: DataFrame
    symbol_tokens: np.ndarray
    symbol_words: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.symbol_tokens.sum())

    @property
    def distinct(self) -> int:
        return int(self.symbol_words.sum())


def corpus(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Corpus:
    spark = docs.sparkSession
    key = F.col(doc_id).cast("long")
    held = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1
    path = new_table_path(spark, "language-corpus")
    (docs.select(key.alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
     .mapInArrow(_corpus_rows, CORPUS_SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(path))
    stored = spark.read.schema(CORPUS_SCHEMA).parquet(path)
    # A word has one row per batch, so even the most common one is a small part of a window's task.
    same = Window.partitionBy("word")
    number = F.when(F.length("word") == 0, SYMBOLS).otherwise(F.crc32("word") % SYMBOLS).cast("int")
    summed = stored.where("kind = 1").select(
        "place", "train", number.alias("symbol"), F.sum("train").over(same).alias("c"), F.min("place").over(same).alias("least"))
    counted = materialize(summed.select("place", "c", "symbol", (F.col("place") == F.col("least")).alias("first"),
                                        (F.col("c") != F.col("train")).alias("shared")), "word-counts")
    tokens, different = np.zeros(SYMBOLS + 1, np.int64), np.zeros(SYMBOLS + 1, np.int64)
    for r in counted.where("first AND c > 0").groupBy("symbol").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["symbol"]], different[r["symbol"]] = r["c"], r["v"]
    return Corpus(stored.where("kind = 0").select("batch", "doc_ids", "held", "sizes", "ids", "symbols"), counted, tokens, different)


def symbol_totals(found: Corpus) -> np.ndarray:
    """Per symbol the smoothed number of tokens, half a count per different word and for all unseen ones."""
    totals = found.symbol_tokens + 0.5 * (found.symbol_words + 1)
    totals[SYMBOLS] = found.symbol_tokens[SYMBOLS] + 0.5  # the end token is the only one of its symbol
    return totals


class Model(NamedTuple):
    """Start, transition and emission probabilities: (K,), (K, K), (K, SYMBOLS + 1)."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_model(totals: np.ndarray, states: int = STATES) -> Model:
    """States that differ by chance: shares of all symbols, each times a random factor, and states that last."""
    noise = np.exp(np.random.RandomState(SEED).normal(0.0, 1.0, (states, len(totals))))
    emit = totals * noise
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1.0 / states), step, emit / emit.sum(1, keepdims=True))


class Packed:
    """Chunks side by side: the tokens of step t of all chunks that reach it stand together, longer chunks first."""

    def __init__(self, chunks: list[np.ndarray]):
        sizes = np.array([len(c) for c in chunks])
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.active = len(chunks) - np.searchsorted(np.sort(sizes), np.arange(self.sizes[0]), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.going_on = np.append(self.active[1:], 0)
        self.chunk = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        self.tokens = np.empty(self.at[-1], np.int64)
        for rank, i in enumerate(self.order):
            self.tokens[self.at[:sizes[i]] + rank] = chunks[i]

    def forward(self, model: Model, begin: np.ndarray, keep: bool = True, seen: np.ndarray | None = None):
        """Scaled forward recursion from state probabilities ``begin`` (K, chunks) before the first token.

        Gives states after every token (if kept), scales, and at each chunk's end the states and the log likelihood.
        """
        seen = model.emit[:, self.tokens] if seen is None else seen
        turn = np.ascontiguousarray(model.step.T)
        states = np.empty_like(seen) if keep else None
        scale, now, ends = np.empty(len(self.tokens), seen.dtype), begin, np.empty_like(begin)
        for t, n in enumerate(self.active):
            part = slice(self.at[t], self.at[t + 1])
            now = begin * seen[:, part] if t == 0 else turn @ now[:, :n]
            if t:
                now *= seen[:, part]
            total = now.sum(0, out=scale[part])
            now /= total
            if keep:
                states[:, part] = now
            if (go_on := self.going_on[t]) < n:
                ends[:, go_on:n] = now[:, go_on:]
        return states, scale, ends, np.bincount(self.chunk, weights=np.log(scale), minlength=len(self.sizes))

    def transfers(self, model: Model) -> np.ndarray:
        """(chunks, K, K) up to a factor each: from the state before a chunk's first step to that after its last token.

        The first step alone makes every row at least its smallest probability times any other, so one factor for
        all rows of a chunk keeps them in range.
        """
        k, seen = len(model.start), model.emit[:, self.tokens]
        turn = np.ascontiguousarray(model.step.T)
        now = np.repeat(turn[:, None, :], len(self.sizes), 1)
        ends = np.empty_like(now)
        for t, n in enumerate(self.active):
            now = (now if t == 0 else (turn @ now[:, :n].reshape(k, n * k)).reshape(k, n, k)) * seen[:, self.at[t]:self.at[t + 1], None]
            now /= now.sum((0, 2))[:, None]
            if (go_on := self.going_on[t]) < n:
                ends[:, go_on:n] = now[:, go_on:]
        return ends.transpose(1, 2, 0)


def _in_units(chunks: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of chunks, UNIT_TOKENS tokens at a time."""
    unit, tokens = [], 0
    for i, c in enumerate(chunks):
        unit.append(i)
        tokens += len(c)
        if tokens >= UNIT_TOKENS:
            yield unit
            unit, tokens = [], 0
    if unit:
        yield unit


class Cut(NamedTuple):
    """Documents in chunks, with the states that surround them: ``before`` (K, chunks) at the end of the chunk before, ``after`` up to a
    factor the likelihood of what follows a chunk; ``first`` marks a document's first chunk."""

    chunks: list[np.ndarray]
    doc: np.ndarray
    first: np.ndarray
    before: np.ndarray
    after: np.ndarray


def cut(model: Model, docs: list[np.ndarray]) -> Cut:
    k = len(model.start)
    chunks = [d[i:i + CHUNK] for d in docs for i in range(0, len(d), CHUNK)]
    doc = np.repeat(np.arange(len(docs)), [-(-len(d) // CHUNK) for d in docs])
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    more = np.concatenate([~first[1:], [False]])  # another chunk of the document follows
    kind = model.emit.dtype
    before, after = np.zeros((k, len(chunks)), kind), np.ones((k, len(chunks)), kind)
    many = np.flatnonzero(more | ~first)
    moves = np.empty((len(chunks), k, k), kind) if len(many) else None
    heads = np.empty((len(chunks), k), kind) if len(many) else None
    for unit in _in_units([chunks[i] for i in many]):
        at = many[unit]
        packed = Packed([chunks[i] for i in at])
        moves[at[packed.order]] = packed.transfers(model)
        _, _, ends, _ = packed.forward(model, np.repeat(model.start[:, None], len(at), 1), keep=False)
        heads[at[packed.order]] = ends.T
    for i in many:
        if not first[i]:
            last = heads[i - 1] if first[i - 1] else before[:, i - 1] @ moves[i - 1]
            before[:, i] = last / last.sum()
    for i in many[::-1]:
        if more[i]:
            back = moves[i + 1] @ after[:, i + 1]
            after[:, i] = back / back.sum()
    return Cut(chunks, doc, first, before, after)


def log_likelihoods(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural logs of the symbol sequences' probabilities."""
    parts = cut(model, docs)
    out = np.zeros(len(docs))
    for unit in _in_units(parts.chunks):
        at = np.array(unit)
        packed = Packed([parts.chunks[i] for i in at])
        at = at[packed.order]
        begin = np.where(parts.first[at], model.start[:, None], model.step.T @ parts.before[:, at])
        out += np.bincount(parts.doc[at], weights=packed.forward(model, begin, keep=False)[3], minlength=len(docs))
    return out


class Expected:
    """Sums of expected counts over documents; the recursions run in ``kind``, the sums in doubles."""

    def __init__(self, model: Model, kind: type = np.float64):
        self.model = Model(*(x.astype(kind) for x in model))
        self.start, self.step = np.zeros(model.start.shape), np.zeros(model.step.shape)
        self.emit, self.log = np.zeros(model.emit.shape), 0.0

    def add(self, docs: list[np.ndarray]) -> None:
        parts = cut(self.model, docs)
        for unit in _in_units(parts.chunks):
            at = np.array(unit)
            packed = Packed([parts.chunks[i] for i in at])
            at = at[packed.order]
            self._add(packed, parts.first[at], parts.before[:, at], parts.after[:, at])

    def _add(self, packed: Packed, first: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        model, seen = self.model, self.model.emit[:, packed.tokens]
        begin = np.where(first, model.start[:, None], model.step.T @ before)
        states, scale, ends, logs = packed.forward(model, begin, seen=seen)
        self.log += logs.sum()
        behind = after / (ends * after).sum(0)  # states times this add up to 1 at every token
        ahead, pairs = None, np.zeros(model.step.shape)
        seen /= scale
        for t in range(len(packed.active) - 1, -1, -1):
            part = slice(packed.at[t], packed.at[t + 1])
            now = behind[:, :packed.active[t]]
            if ahead is not None:
                n = ahead.shape[1]
                pairs += states[:, packed.at[t]:packed.at[t] + n] @ ahead.T
                now = np.concatenate([model.step @ ahead, now[:, n:]], 1)
            ahead = seen[:, part] * now
            states[:, part] *= now  # from here on the share of every state at a token
        self.start += states[:, :packed.active[0]][:, first].sum(1)
        pairs += before[:, ~first] @ ahead[:, ~first].T
        self.step += pairs * model.step
        for s in range(len(model.start)):
            self.emit[s] += np.bincount(packed.tokens, weights=states[s], minlength=self.emit.shape[1])

    def rows(self) -> pa.RecordBatch:
        """Row numbers and values: symbols first, then start, transitions by row, and the log likelihood."""
        used = np.flatnonzero(self.emit.any(0))
        size, k = self.emit.shape[1], len(self.start)
        number = np.concatenate([used, np.arange(size, size + k + 2)])
        rest = np.concatenate([self.start[None], self.step, np.full((1, k), self.log)])
        values = np.concatenate([self.emit[:, used].T, rest])
        return pa.RecordBatch.from_arrays(
            [pa.array(number), pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), k).cast(pa.list_(pa.float64()))],
            names=["number", "expected"])


def _documents(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, sizes and symbols of a batch's documents, all in one array."""
    ids = _numbers(row["ids"])
    return ids, np.array(row["sizes"]), np.frombuffer(row["symbols"], np.uint16)[ids]


def _split(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


def expected_counts(batches: DataFrame, count: int, model: Model) -> tuple[Model, float]:
    """Baum-Welch counts over all training documents and the log likelihood; what returns is bounded by the model's size."""
    k, size = model.emit.shape

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting, tokens = Expected(model, np.float32), [], 0
        for part in parts:
            for i in range(part.num_rows):
                row = part.slice(i, 1).to_pylist()[0]
                _, sizes, symbols = _documents(row)
                waiting += [d for d, out in zip(_split(symbols, sizes), row["held"]) if not out]
                tokens += len(symbols)
                if tokens >= UNIT_TOKENS and waiting:
                    sums.add(waiting)
                    waiting, tokens = [], 0
        if waiting:
            sums.add(waiting)
        yield sums.rows()

    dealt = batches.select("held", "sizes", "ids", "symbols").coalesce(max(1, -(-count // TASK_BATCHES)))
    rows = dealt.mapInArrow(run, "number long, expected array<double>").groupBy("number").agg(
        F.array(*[F.sum(F.get("expected", F.lit(i))) for i in range(k)]).alias("expected")).toArrow()
    table = np.zeros((size + k + 2, k))
    if rows.num_rows:
        values = rows.column("expected").combine_chunks().flatten().to_numpy().reshape(-1, k)
        table[rows.column("number").to_numpy()] = values
    return Model(table[size], table[size + 1:size + 1 + k], table[:size].T), float(table[-1, 0])


def maximised(counts: Model, totals: np.ndarray) -> Model:
    """Probabilities from counts; every state keeps a share of all symbols, every move a count."""
    start, step = counts.start + 1.0, counts.step + 1.0
    emit = counts.emit + PRIOR * totals / totals.sum()
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def train(found: Corpus, states: int = STATES, iterations: int = ITERATIONS) -> tuple[Model, np.ndarray, list[float]]:
    """The model, the symbols' totals and the training log likelihood before every iteration."""
    totals, count = symbol_totals(found), found.batches.count()
    model, logs = first_model(totals, states), []
    for _ in range(iterations):
        counts, log = expected_counts(found.batches, count, model)
        logs.append(log)
        model = maximised(counts, totals)
    return model, totals, logs


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, count_log double, symbol_log double"


def batch_scores(model: Model, totals: np.ndarray, row: dict, at: np.ndarray, c: np.ndarray) -> pa.Table:
    """Scores of a batch's documents; ``at`` and ``c`` are the counts of words that other batches have too.

    ``count_log`` is the sum of log10(count + 1/2) over tokens, ``symbol_log`` log10 of the symbols' probability less
    that of their totals.
    """
    ids, sizes, symbols = _documents(row)
    counts = _own_counts(ids, sizes, row["held"], len(row["symbols"]) // 2)
    counts[at] = c
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    add = lambda values: np.add.reduceat(values, starts)  # noqa: E731  every document has its end token
    return pa.table({
        "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
        "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(add((counts > 0).astype(np.int64)[ids])),
        "count_log": pa.array(add(np.log10(counts + 0.5)[ids])),
        "symbol_log": pa.array(log_likelihoods(model, _split(symbols, sizes)) / np.log(10.0) - add(np.log10(totals)[symbols]))})


def score_corpus(found: Corpus, model: Model, totals: np.ndarray) -> DataFrame:
    """SCORE_SCHEMA for every document."""
    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("count_log", pa.float64()), ("symbol_log", pa.float64())]).empty_table()

    def run(batch: pa.Table, shared: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return empty
        return batch_scores(model, totals, batch.to_pylist()[0], shared.column("word").to_numpy(), shared.column("c").to_numpy())

    place = F.col("place")
    shared = found.words.where("shared").select(
        F.shiftright(place, PLACE_BITS).alias("batch"), place.bitwiseAND((1 << PLACE_BITS) - 1).alias("word"), "c")
    return found.batches.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(run, SCORE_SCHEMA)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    found = corpus(docs, text, doc_id)
    model, totals, _ = train(found)
    per_token = F.log10(F.lit(found.tokens + 0.5 * (found.distinct + 1)))
    return score_corpus(found, model, totals).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(found.tokens).cast("long").alias("train_tokens"),
        (F.col("count_log") - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("count_log") + F.col("symbol_log")).alias("score"))
