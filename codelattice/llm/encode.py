"""Encoding of texts with a public byte-level BPE vocabulary, as a streaming transducer with bounded lookahead.

Two machines in a row:

1. A cutter splits the text into the pieces of the vocabulary's pattern. A piece is final once ``HOLD`` characters follow it;
   a piece longer than ``RUN`` characters is handed on while it is still open.
2. A merger encodes the bytes of a piece from left to right. The encoding of every prefix ends in exactly one token, the
   longest one that ends there and whose neighbour to the left doesn't merge with it (``_Vocabulary.adjacent``), and is
   otherwise the encoding of a shorter prefix. The next token can start only within the longest token's length of the end, so
   the chains of tokens that lead to those positions decide what is final: what they all share is emitted and forgotten. That
   length is the merge list's lookahead, computed when the vocabulary is loaded.

State is bounded by the lookahead, not by the text. Short pieces repeat; their ids are kept in a table of bounded size.

Defined results: null and empty texts give the empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - reached as pa.compute
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"

#: The pattern by which byte-level BPE vocabularies of this family cut text, as they publish it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK, HOLD, RUN, KEPT_LENGTH, KEPT = 1 << 16, 4, 1 << 12, 48, 400_000
_PIECE = regex.compile(PATTERN)
_OPEN = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*"), "S": regex.compile(r"\s*")}


def _byte_letters() -> dict[str, int]:
    """The letters by which such vocabularies write bytes: printable Latin-1 characters for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, their last merges and the lookahead of the merge list."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.bytes: dict[int, bytes] = {model["vocab"][t]: b for t, b in raw.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.token_of_pair: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (model["vocab"][a], model["vocab"][b]), model["vocab"][a + b]
            self.parts.setdefault(whole, pair)
            self.rank[pair] = rank
        self.born = {whole: self.rank[pair] for whole, pair in self.parts.items()}  # the merge that makes a token
        made = {t for t, b in self.bytes.items() if len(b) == 1 or t in self.parts}
        self.lookahead = max(len(self.bytes[t]) for t in made)
        #: What a token can end in: the token's id if the suffix is one, else -1.
        self.suffix: dict[bytes, int] = {}
        for t in made:
            b = self.bytes[t]
            for i in range(1, len(b)):
                self.suffix.setdefault(b[i:], -1)
        for t in made:
            self.suffix[self.bytes[t]] = t
        self._adjacent: dict[tuple[int, int], bool] = {}

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart side by side.

        Both are undone, the later merge first; at each step the pair at the seam must not merge before the merges that
        still have to come to rebuild the tokens.
        """
        key = (left, right)
        known = self._adjacent.get(key)
        if known is None:
            if len(self._adjacent) > KEPT:
                self._adjacent.clear()
            known = self._adjacent[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        born, never = self.born, 1 << 60
        until = never  # the seam must not merge before the merge that consumed its sides
        by_right = False  # at equal ranks merges run from the left: a seam left of the consuming merge goes first
        while True:
            seam = self.rank.get((left, right))
            if seam is not None and (seam < until or (seam == until and by_right)):
                return False
            a, b = born.get(left, -1), born.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                until, by_right, left = a, False, self.parts[left][1]
            else:
                until, by_right, right = b, True, self.parts[right][0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Merger:
    """The ids of one piece whose bytes come in parts."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.base = 0  # everything before this position is emitted
        self.data = b""  # the bytes from base on
        self.last: list[int] = []  # for each position after base: the last token of the prefix that ends there
        self.before = -1  # the token emitted last

    def feed(self, data: bytes) -> list[int]:
        """Takes further bytes and returns the tokens that became final."""
        v, suffix, adjacent, last = self.vocab, self.vocab.suffix, self.vocab.adjacent, self.last
        self.data = buffer = self.data + data
        for end in range(len(last) + 1, len(buffer) + 1):
            found: list[tuple[int, int]] = []
            start = end - 1
            while start >= 0:
                t = suffix.get(buffer[start:end])
                if t is None:
                    break
                if t >= 0:
                    found.append((t, start))
                start -= 1
            for t, start in reversed(found):
                left = last[start - 1] if start else self.before
                if left == -1 and not start or left >= 0 and adjacent(left, t):
                    last.append(t)
                    break
            else:
                last.append(-2)  # no token ends here after what is already final
        return self._emit() if len(buffer) > 4 * v.lookahead else []

    def _emit(self) -> list[int]:
        """The tokens that all live positions share, taken off the buffer."""
        width, n = self.vocab.bytes, len(self.data)
        marks: dict[int, int] = {}
        live = [p for p in range(max(1, n - self.vocab.lookahead + 1), n + 1) if self.last[p - 1] >= 0]
        for p in live:
            while p > 0:
                marks[p] = marks.get(p, 0) + 1
                p -= len(width[self.last[p - 1]])
        shared = max((p for p, k in marks.items() if k == len(live)), default=0)
        return self._take(shared) if shared else []

    def _take(self, upto: int) -> list[int]:
        out, p = [], upto
        while p > 0:
            t = self.last[p - 1]
            out.append(t)
            p -= len(self.vocab.bytes[t])
        out.reverse()
        if out:
            self.before = out[-1]
        self.data, self.last, self.base = self.data[upto:], self.last[upto:], self.base + upto
        return out

    def finish(self) -> list[int]:
        out = self._take(len(self.data))
        self.clear()
        return out


class Encoder:
    """Text in, ids out; one instance for any number of texts."""

    def __init__(self, path: str = BYTE_BPE_50K) -> None:
        self.vocab = vocabulary(path)
        self.merger = Merger(self.vocab)
        self.known: dict[str, tuple[int, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.tail, self.open = "", ""
        self.merger.clear()

    def _piece(self, piece: str) -> tuple[int, ...] | list[int]:
        ids = self.known.get(piece)
        if ids is None:
            m = self.merger
            ids = m.feed(piece.encode("utf-8", "replace"))
            ids = (*ids, *m.finish())
            if len(piece) <= KEPT_LENGTH:
                if len(self.known) > KEPT:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def feed(self, text: str, final: bool = False) -> list[int]:
        """Takes further text and returns the ids that became final."""
        out: list[int] = []
        buffer, at, n = self.tail + text, 0, len(self.tail) + len(text)
        stable = n if final else n - HOLD
        if self.open:
            at = _OPEN[self.open].match(buffer).end()
            if self.open == "S" and at < n:
                at -= 1  # the last blank before other text starts the next piece
            elif not final and at > stable:
                at = max(0, stable)
            out += self.merger.feed(buffer[:at].encode("utf-8", "replace"))
            if final or at < stable:
                out += self.merger.finish()
                self.open = ""
            else:
                self.tail = buffer[at:]
                return out
        known = self.known
        while at < n:
            m = None
            for m in _PIECE.finditer(buffer, at):
                if m.end() > stable:
                    break
                piece = m.group()
                ids = known.get(piece)
                out += ids if ids is not None else self._piece(piece)
                at = m.end()
            else:
                break
            if stable - m.start() > RUN and m.end() >= stable and buffer[m.start()] != "'":
                self.open = self._class(m.group())
                out += self.merger.feed(buffer[m.start() : stable].encode("utf-8", "replace"))
                at = stable
            break
        self.tail = buffer[at:]
        return out

    @staticmethod
    def _class(piece: str) -> str:
        c = piece[1] if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else piece[0]
        return next(k for k in ("S", "L", "N", "O") if _OPEN[k].fullmatch(c))

    def finish(self) -> list[int]:
        out = self.feed("", final=True)
        self.clear()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= CHUNK:
            out = self.feed(text, final=True)
        else:
            out = []
            for i in range(0, len(text), CHUNK):
                out += self.feed(text[i : i + CHUNK])
            out += self.feed("", final=True)
        self.clear()
        return out


class Decoder:
    """Ids in, text out: a character comes out with its last byte, wherever tokens cut it."""

    def __init__(self, path: str = BYTE_BPE_50K) -> None:
        self.vocab = vocabulary(path)
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.vocab.bytes[i]) for i in ids)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.finish()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process: its table of pieces serves all batches."""
    return Encoder(path)


def _slices(b: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text: ids take several times the room of their text while they are Python objects."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > most and i > start:
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n
    yield b.slice(start)


def shipped(spark: SparkSession, path: str) -> str:
    """Hands a vocabulary file to all executors along with the job; the name by which they find it."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _ids_of(name: str, lengths_only: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for whole in batches:
            for b in _slices(whole, whole.num_columns - 1):
                ids = [enc.encode(t) for t in b.column(b.num_columns - 1).to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int64()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
                keys = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keys, out], names=[*b.schema.names[:-1], "n_tokens" if lengths_only else "ids"])

    return run


def _mapped(docs: DataFrame, keys: list[str], text_col: str, path: str, lengths_only: bool) -> DataFrame:
    kept = docs.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text_col}`").alias("_text"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", n_tokens bigint" if lengths_only else ", ids array<int>"
    return kept.mapInArrow(_ids_of(shipped(docs.sparkSession, path), lengths_only), schema)


def encode_texts(docs: DataFrame, id_col: str, text_col: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """``(id_col, ids)``: one row for each row, the ids of the whole text without special tokens."""
    return _mapped(docs, [id_col], text_col, path, False)


def token_lengths(docs: DataFrame, keys: list[str], text_col: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """``(*keys, n_tokens)``: the size of each text in tokens; 0 for null and empty texts."""
    return _mapped(docs, keys, text_col, path, True)
