"""SentencePiece BPE encoding by backtracking, and decoding.

A BPE model merges, anywhere in a text, the adjacent pair whose joined piece
has the highest score (leftmost among equals) until no pair joins to a piece.
A sequence of pieces is that result exactly if every two neighbours, joined and
merged again on their own, come apart the same way.  So the encoder takes the
longest piece at a position (one Aho-Corasick pass finds them all), checks it
against the piece before by re-merging the two (remembered), shortens it to its
next prefix if they don't agree, and steps back when none is left, marking the
position in a bitfield so that it is never tried again.

Pieces never hold a space mark after another character, so no merge crosses
the start of a run of space marks: texts are encoded chunk by chunk (marks and
the word after them) and chunks are remembered up to a fixed number.
Characters without a piece fall back to the pieces of their UTF-8 bytes and
separate what stands on their sides.

Supported models: BPE, byte fallback, identity normalisation with one space
put in front (others are refused).  Defined cases: null and empty text have no
ids; whole texts of any length, in memory that grows with the text; each row of
a repeated id is encoded by its own text; an empty table gives an empty result;
extra columns aren't read, whatever their names; ids in any order decode; the
model's path is a parameter, read by the driver.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from maskwright.llm.common import slices

MARK = "▁"
#: Chunks, and pairs of pieces, that an encoder remembers.
CHUNKS, PAIRS = 100_000, 500_000
_CHUNK = re.compile(" *[^ ]+| +")


class PieceCoder:
    """Encodes and decodes with one model; holds caches of fixed size."""

    def __init__(self, model_bytes: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        if model.normalize("ﬁ  Ａ ") != f"{MARK}ﬁ{MARK}{MARK}Ａ{MARK}":
            raise ValueError("only models with identity normalisation and a space in front are supported")
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.texts = [str(i) for i in range(n)]
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = {i for i in range(n) if model.is_unknown(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model lacks byte fallback")
        outside = self.silent | self.unknown | set(self.byte_of)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in outside}
        self.plain = frozenset(self.ids.values())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces across words are not supported")
        self.finder = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.finder.add_word(piece, (len(piece) - 1, i))
        self.finder.make_automaton()
        self.size, self.lengths = n, [len(p) for p in self.pieces]
        #: The longest piece that is a proper prefix of each; -1 if none.
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1) for p in self.pieces]
        self.pairs: dict[int, bool] = {}  # by left * size + right
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    # -- encoding

    def remerge(self, text: str) -> list[int]:
        """Plain BPE over a short string whose characters are all pieces."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids[p] for p in parts]

    def _agree(self, left: int, right: int) -> bool:
        """Whether two neighbours (left -1: none) come apart the same way; a piece that its own text doesn't give never does."""
        text = self.pieces[right] if left < 0 else self.pieces[left] + self.pieces[right]
        found = all(c in self.ids for c in text) and self.remerge(text) == ([right] if left < 0 else [left, right])
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left * self.size + right] = found
        return found

    def _backtrack(self, size: int, longest: list[int], begin: int) -> list[int]:
        """Ids of the ``size`` characters, all of them pieces, from ``begin``; ``longest``: the longest piece at each position."""
        pairs, lengths, n = self.pairs, self.lengths, self.size
        at, stop, last = begin, begin + size, -1
        failed = None  # a bit for each position, set once nothing leads on from it
        tokens: list[int] = []
        token = longest[at]
        while True:
            end = at + lengths[token]
            if failed is None or not failed[end - begin >> 3] >> (end - begin & 7) & 1:
                agree = pairs.get(last * n + token)
                if agree is None:
                    agree = self._agree(last, token)
                if agree:
                    tokens.append(token)
                    if end == stop:
                        return tokens
                    at, last = end, token
                    token = longest[at]
                    continue
            token = self.shorter[token]
            while token < 0:  # back to the token before, and shorten that
                if not tokens:
                    raise ValueError("no sequence of pieces is stable")
                if failed is None:
                    failed = bytearray(size + 8 >> 3)
                failed[at - begin >> 3] |= 1 << (at - begin & 7)
                token = tokens.pop()
                at -= lengths[token]
                last = tokens[-1] if tokens else -1
                token = self.shorter[token]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a run of space marks and a word (either may be missing)."""
        longest = [-1] * len(chunk)
        for end, (back, i) in self.finder.iter(chunk):
            longest[end - back] = i  # later ends are longer
        if -1 not in longest:
            return self._backtrack(len(chunk), longest, 0)
        out: list[int] = []
        begin = 0
        for at in [i for i, x in enumerate(longest) if x < 0] + [len(chunk)]:
            if at > begin:
                out += self._backtrack(at - begin, longest, begin)
            if at < len(chunk):
                out += [self.byte_ids[b] for b in chunk[at].encode()]
            begin = at + 1
        return out

    def _chunks_of(self, text: str) -> list[str]:
        """The text's chunks without the space mark that each begins with; spaces stand for marks."""
        text = text.replace(MARK, " ")
        words = text.split(" ")
        return [c[1:] for c in _CHUNK.findall(f" {text}")] if "" in words else words

    def encode(self, text: str) -> list[int]:
        return [i for c in self._chunks_of(text) for i in self.encode_chunk(MARK + c.replace(" ", MARK))] if text else []

    # -- decoding

    def _join(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run = bytearray()
            if i >= 0 and i not in self.silent:
                out.append(" ⁇ " if i in self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, without the space that encoding puts in front."""
        first = next((i for i in ids if i not in self.silent), None)
        text = self._join(ids)
        return text[1:] if first is not None and first not in self.unknown and self.pieces[first].startswith(MARK) else text

    # -- both, for whole documents

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded text."""
        if not text:
            empty = hashlib.sha256(b"").hexdigest()
            return 0, empty, empty
        known = []
        for word in self._chunks_of(text):
            entry = self.chunks.get(word)
            if entry is None:
                entry = self._remember(word)
            known.append(entry)
        counts, ids, decoded = zip(*known, strict=True)
        return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256("".join(decoded)[1:].encode()).hexdigest()

    def _remember(self, word: str) -> tuple[int, str, str]:
        entry = self.older.get(word)
        if entry is None:
            ids = self.encode_chunk(MARK + word.replace(" ", MARK))
            entry = len(ids), ",".join(map(self.texts.__getitem__, ids)), self._join(ids)
        if len(word) <= 64:
            if len(self.chunks) >= CHUNKS:  # chunks not seen since the last time go
                self.older, self.chunks = self.chunks, {}
            self.chunks[word] = entry
        return entry


def _lenient(data: bytes) -> str:
    """UTF-8, with a replacement character for each byte that is part of no character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "\ufffd"]
            at += e.start + 1
    return "".join(out)


_coders: dict[bytes, PieceCoder] = {}
#: A model file's greatest size in bytes; its content is broadcast.
MODEL = 64 << 20


def model_bytes(path: str) -> bytes:
    """The content of a model file, which only the driver needs to see."""
    size = os.path.getsize(path)
    if size > MODEL:
        raise ValueError(f"the model has {size} bytes, more than {MODEL}")
    return Path(path).read_bytes()


def coder(content: bytes) -> PieceCoder:
    """One coder for each model and process."""
    key = hashlib.sha256(content).digest()
    if key not in _coders:
        _coders[key] = PieceCoder(content)
    return _coders[key]


def encode_pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, text): the decoded ids (null: empty)."""
    kind = encoded.schema[id_column].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_column].alias("doc_id"), encoded[ids_column].alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and digest both in one pass: what ``op3`` returns."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for batch in slices(batches, "text"):
            rows = [own.digest(t or "") for t in batch.column(1).to_pylist()]
            counts, ids, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
