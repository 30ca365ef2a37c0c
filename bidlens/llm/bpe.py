"""Byte-pair encoding and decoding by a prefix-sharing trie.

A prefix of a word has one encoding, and that encoding is the encoding of a
shorter prefix followed by one token.  So a prefix's state is its last token
alone.  The distinct words of a slice of documents are inserted into a trie and
the states are handed down depth first: each prefix that several words share is
encoded once.  A token may follow another when merging both their symbols leaves
just these two.  The word's last symbol carries the end mark, hence a word's own
state is found below its node, and the encoding is read off backwards.

Words are kept by their surface between slices, so a text costs one split at
white space and one look-up per word.  Neither the words kept (``KEPT_WORDS``)
nor the texts of one slice (``SLICE_CHARS``) grow with the input.

The tokenizer file is read as it is: NFC, lower case, white space as separator,
a split at letters, digits and marks, byte alphabet, merges with an end mark, and
no decoder, so decoded tokens are joined by one space.  Other layouts are refused.

Defined results: NULL text counts as empty, empty texts have no ids; texts and
words of any length are encoded whole; repeated rows give repeated rows; empty
tables give no rows; other columns are ignored, or carried by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.llm.tables import packed, whole_row

KEPT_WORDS = 600_000
KEPT_PAIRS = 500_000
SLICE_CHARS = 4_000_000
TRIE_DEPTH = 64
START = -1  # the state of the empty prefix
ONE_SYMBOL = [1]

# Unicode's white space, to which str.split() adds the four separators below.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def words_of(text: str) -> list[str]:
    """The stretches between white space."""
    if any(c in text for c in ODD_SEPARATORS):
        return [w for w in WHITE.split(text) if w]
    return text.split()


def byte_alphabet() -> dict[int, str]:
    """A visible character for each byte: itself where it is one, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class WordFile:
    """A tokenizer file of the layout above: vocabulary, merges, and how a text is split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        layout = [x["type"] for x in spec["normalizer"]["normalizers"]], spec["decoder"], model["type"]
        if layout != (["NFC", "Replace", "Lowercase"], None, "BPE") or model["unk_token"] or model["ignore_merges"]:
            raise ValueError("this tokenizer file has another layout")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        parts = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(parts.replace(r"\s", r"\p{White_Space}"))

    def parts_of(self, surface: str) -> list[str | int]:
        """A stretch without white space as normalised words; special tokens as their ids."""
        if "<" not in surface or not self.split_special:
            return self.words_in(surface)
        out: list[str | int] = []
        for piece in self.split_special.split(surface):
            out += [self.special[piece]] if piece in self.special else self.words_in(piece)
        return out

    def words_in(self, piece: str) -> list[str]:
        if not piece.isascii():
            # Capital sigma has one small form here, wherever it stands.
            piece = unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3")
        small = piece.lower()
        return [small] if small.isalpha() else self.parts.findall(small)


class TrieEncoder(WordFile):
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokens = {i: t.encode() for t, i in [*self.ids.items(), *self.special.items()]}
        self.text_of = {i: t for t, i in self.ids.items()}
        self.table = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        # How long tokens without and with the end mark can be, by their last two symbols, and
        # the tokens by their symbols, mark left out.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        inner: dict[str, set[int]] = {}
        final: dict[str, set[int]] = {}
        for token, i in self.ids.items():
            body = token.removesuffix(self.end) or token
            (self.inner if body == token else self.final)[body] = i
            (inner if body == token else final).setdefault(body[-2:], {1}).add(len(body))
        self.inner_lengths = {k: sorted(v, reverse=True) for k, v in inner.items()}
        self.final_lengths = {k: sorted(v, reverse=True) for k, v in final.items()}
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}

    # --- merging, the rule itself ---------------------------------------------

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges the pair of the lowest rank, everywhere, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), p) for p in zip(symbols, symbols[1:])), key=lambda x: x[0])
            if best[0] == 1 << 60:
                break
            (left, right), out, i = best[1], [], 0
            while i < len(symbols):
                if symbols[i] == left and symbols[i + 1:i + 2] == [right]:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if not token.endswith(self.end) or token == self.end:
            return list(token)
        body = token.removesuffix(self.end)
        return [*body[:-1], body[-1] + self.end]

    def is_sound(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        known = self.sound.get(token)
        if known is None:
            text = self.text_of[token]
            known = self.sound[token] = self.merged(self.symbols(text)) == [text]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the symbols of both tokens, the first one sound, leaves just these two."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        a, b = self.text_of.get(left, ""), self.text_of[right]
        known = self.is_sound(right) and (
            left == START or self.merged(self.symbols(a) + self.symbols(b)) == [a, b])
        self.pairs[left << 20 | right] = known
        return known

    # --- the trie -------------------------------------------------------------

    def last_token(self, word: str, upto: int, states: list[int], mark: bool) -> tuple[int, int]:
        """The last token of the first ``upto`` symbols of ``word`` and its length, given the states of shorter prefixes."""
        tokens, lengths = (self.final, self.final_lengths) if mark else (self.inner, self.inner_lengths)
        pairs = self.pairs
        for length in lengths.get(word[max(0, upto - 2):upto], ONE_SYMBOL):
            if length <= upto:
                token = tokens.get(word[upto - length:upto])
                if token is not None:
                    before = states[upto - length]
                    fits = pairs.get(before << 20 | token)
                    if fits or (fits is None and self.may_follow(before, token)):
                        return token, length
        raise ValueError("a symbol is not in the vocabulary")

    def encode_words(self, words: Iterable[str]) -> dict[str, array]:
        """Ids of distinct words (byte alphabet) by one depth-first walk over their trie."""
        root: dict = {}
        for word in words:
            node = root
            for c in word[:min(len(word) - 1, TRIE_DEPTH)]:
                down = node.get(c)
                if down is None:
                    down = node[c] = {}
                node = down
            node.setdefault("", []).append(word)  # the last symbol, or a long word's rest, hangs below
        found: dict[str, array] = {}
        states, lengths = [START], [0]
        stack: list[tuple[str, dict]] = [("", root)]
        while stack:
            prefix, node = stack.pop()
            if prefix:
                depth = len(prefix)
                del states[depth:], lengths[depth:]
                token, length = self.last_token(prefix, depth, states, False)
                states.append(token)
                lengths.append(length)
            for word in node.pop("", ()):
                found[word] = self.finish(word, states, lengths)
            for c, child in node.items():
                stack.append((prefix + c, child))
        return found

    def finish(self, word: str, states: list[int], lengths: list[int]) -> array:
        """Goes on from the word's node to its end and reads the tokens backwards."""
        at = len(word)
        if at > len(states):  # a long word's rest, which is not shared
            states, lengths = list(states), list(lengths)
            while len(states) < at:
                token, length = self.last_token(word, len(states), states, False)
                states.append(token)
                lengths.append(length)
        token, length = self.last_token(word, at, states, True)
        out = array("I", (token,))
        at -= length
        while at:
            out.append(states[at])
            at -= lengths[at]
        out.reverse()
        return out

    # --- texts ----------------------------------------------------------------

    def learn(self, surfaces: Iterable[str]) -> None:
        """Keeps the ids of new stretches; their words go through the trie unless they are known already."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        parts = {s: self.parts_of(s) for s in surfaces}
        words, table = self.words, self.table
        new = {p for ps in parts.values() for p in ps if p not in words and isinstance(p, str)}
        symbols = {p: p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(table) for p in new}
        ids = self.encode_words(symbols.values())
        for p, s in symbols.items():
            words[p] = little_endian(ids[s])
        for surface, ps in parts.items():
            self.kept[surface] = words[ps[0]] if len(ps) == 1 and ps[0] in words else b"".join(
                [words[p] if isinstance(p, str) else little_endian(array("I", (p,))) for p in ps])

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        split = [words_of(t) for t in texts]
        known = [list(map(self.kept.get, words)) for words in split]
        new: set[str] = set()
        for words, found in zip(split, known):
            if None in found:
                new.update(w for w, f in zip(words, found) if f is None)
        self.learn(new)
        for words, found in zip(split, known):
            yield b"".join(map(self.kept.__getitem__, words) if None in found else found)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: without a decoder, tokens are joined by a space."""
        return b" ".join(map(self.tokens.__getitem__, from_little_endian(ids)))


def little_endian(ids: array) -> bytes:
    if array("H", [1]).tobytes() != b"\x01\x00":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def from_little_endian(data: bytes) -> array:
    ids = array("I")
    ids.frombytes(data)
    if array("H", [1]).tobytes() != b"\x01\x00":
        ids.byteswap()
    return ids


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per worker process and file, so words stay known between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array | pa.ChunkedArray, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of a bounded size, with the place of the first; NULL becomes empty."""
    start, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        held.append(text)
        size += len(text)
        if size >= chars:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


Field = tuple[str, pa.DataType, T.DataType]


def _encoded(docs: DataFrame, text: str, path: str, make: Callable[[TrieEncoder, bytes], tuple],
             fields: list[Field], doc: Column, doc_type: T.DataType) -> DataFrame:
    """``doc`` of every row, and what ``make`` gives for the ids of its text."""
    names = ["doc", *[name for name, _, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                rows = [make(tool, ids) for ids in tool.encode_batch(texts)]
                made = [pa.array(values, kind) for values, (_, kind, _) in zip(zip(*rows), fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *made], names=names)

    schema = T.StructType([T.StructField("doc", doc_type), *[T.StructField(n, t) for n, _, t in fields]])
    return docs.select(doc.alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def _ids_of(tool: TrieEncoder, ids: bytes) -> tuple:
    return (ids,)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` as ``doc``, with ``ids`` (binary, little-endian unsigned 32-bit)."""
    return _encoded(docs, text, path, _ids_of, [("ids", pa.binary(), T.BinaryType())], whole_row(docs.columns),
                    packed(docs).schema["doc"].dataType)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` to a table with ids as ``encode`` gives them; NULL ids decode to the empty text."""
    @F.pandas_udf("string")
    def texts(values):
        tool = encoder(path)
        return values.map(lambda v: tool.decode(bytes(v)).decode() if v is not None else "")

    return encoded.withColumn("decoded", texts(F.col(ids)))


def _digests(tool: TrieEncoder, ids: bytes) -> tuple:
    return (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest())


def round_trip_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    fields: list[Field] = [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()),
                           ("decoded_sha256", pa.string(), T.StringType())]
    return _encoded(docs, text, path, _digests, fields, F.col(doc_id), docs.schema[doc_id].dataType
                    ).withColumnRenamed("doc", "doc_id")
