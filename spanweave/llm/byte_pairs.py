"""Byte-level BPE: whole texts to ids and back; long texts go in overlapping chunks that are stitched where they resynchronise."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import sized, staged

#: Code points that a chunk has of its own, and that it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: A match of the pattern depends on no code point further than this behind its end (the letters of "'re" behind "'").
REACH = 2
#: Texts that a task encodes at a time, and distinct words and pieces that it keeps.
TEXTS, WORDS, PIECES = 256, 500_000, 200_000
#: The places before which the pattern has a boundary, whatever stands around.
_SPACE = re.compile(r" (?=\S)")
_IDS = np.dtype("<u4")


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Pre-tokens of a text, the ids of pre-tokens, and the bytes of ids; each distinct pre-token is merged once.

    The pattern has a boundary before every space with no white space behind it, and matches both sides as if they
    stood alone; so texts are taken by words.
    Words and pre-tokens that are known are dropped and gathered anew when they are too many, so that memory stays bounded.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        ranks = vocabulary(path)
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces_of = regex.compile(public_tokenizers.PATTERN).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _each(self, pieces: list[str]) -> list[bytes]:
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > PIECES:
            self.known, new = {}, set(pieces)
        self.known.update((p, array("I", self.encoding._encode_single_piece(p)).tobytes()) for p in new)
        return list(map(self.known.__getitem__, pieces))

    def ids(self, pieces: list[str]) -> bytes:
        """The ids of pre-tokens, little-endian unsigned 32-bit integers."""
        return b"".join(self._each(pieces))

    def _learn(self, words: set[str]) -> None:
        """The ids of words with the space before them: many in one text, in which each begins with the piece that has its space.

        A word that begins with white space, or is empty, has no boundary before its space; it gets no ids.
        """
        alone = [w for w in words if w and not w[0].isspace() and " " not in w]
        pieces = self.pieces_of("".join([" " + w for w in alone]))
        ids = self._each(pieces)
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        self.words.update((w, b"".join(ids[i:j])) for w, i, j in zip(alone, starts, [*starts, len(ids)][1:], strict=True))
        for w in words.difference(alone):
            self.words[w] = self.ids(self.pieces_of(" " + w)) if w and not w[0].isspace() else None

    def _known(self, words: list[str]) -> list[bytes | None]:
        new = set(words).difference(self.words)
        if new:
            if len(self.words) + len(new) > WORDS:
                self.words, new = {}, set(words)
            self._learn(new)
        return list(map(self.words.__getitem__, words))

    def text_ids(self, text: str) -> bytes:
        """The ids of a whole text, by its words; each distinct one is pre-tokenised once."""
        first, *words = text.split(" ")
        ids = self._known(words)
        if None in ids:
            first, *words = _SPACE.split(text)
            ids = self._known(words)
        return self.ids(self.pieces_of(first)) + b"".join(ids)

    def bytes_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype=_IDS).tolist()))


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of this worker for a vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def certain_ends(lengths: Iterable[int], size: int, last: bool) -> np.ndarray:
    """Where the matches end in a chunk of size code points, as far as the text behind the chunk can't change them."""
    ends = np.cumsum(np.fromiter(lengths, dtype=np.int32), dtype=np.int32)
    return ends if last else ends[ends <= size - REACH]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            yield b.slice(at, TEXTS)


def _whole(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids of texts that are no longer than a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in _slices(batches):
            ids = [c.text_ids((t or b"").decode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _cut(chunk: int, overlap: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk of a long text, numbered by task, row and chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for doc, raw in zip(b.column("doc_id"), b.column("text"), strict=True):
                text = raw.as_py().decode("utf-8", "replace")
                n = -(-len(text) // chunk)
                for a in range(0, n, TEXTS):
                    own = range(a, min(n, a + TEXTS))
                    pieces = [text[i * chunk : (i + 1) * chunk + overlap] for i in own]
                    k = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * k, pa.int32()), pa.array([row] * k, pa.int64()), pa.array([doc.as_py()] * k, pa.int64()), pa.array(own, pa.int32()), pa.array([n] * k, pa.int32()), pa.array(pieces, pa.string())],
                        names=["part", "row", "doc_id", "chunk", "chunks", "text"],
                    )
                row += 1

    return run


def _pretokens(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each chunk with the ends of its pre-tokens, matched from the chunk's first code point on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in _slices(batches):
            rows = zip(b.column("text").to_pylist(), b.column("chunk").to_pylist(), b.column("chunks").to_pylist(), strict=True)
            ends = [certain_ends(map(len, c.pieces_of(t)), len(t), i + 1 == n) for t, i, n in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.list_(pa.int32()))], names=[*b.schema.names, "ends"])

    return run


def stitches(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(part, row, chunk, first, last, stitched): from which to which code point of a chunk its pre-tokens count.

    Matching goes on alike from a place where both chunks have a boundary. A chunk's own first place is the first
    boundary that it has in common with the chunk before it, by induction one of the whole text's. stitched is false
    for all chunks of a text in which two neighbours have none in common, as where a pre-token is longer than the overlap.
    """
    head = F.concat(F.array(F.lit(0)), F.filter("ends", lambda e: e <= overlap))
    tail = F.transform(F.filter("ends", lambda e: e >= chunk), lambda e: e - chunk)
    doc = Window.partitionBy("part", "row")
    edges = chunks.select("part", "row", "chunk", "chunks", head.alias("head"), tail.alias("tail"))
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(doc.orderBy("chunk"))))
    met = edges.select("part", "row", "chunk", "chunks", common.alias("common"))
    first = F.coalesce(F.lag("common").over(doc.orderBy("chunk")), F.lit(0))
    fine = F.col("common").isNotNull() | (F.col("chunk") + 1 == F.col("chunks"))
    return met.select("part", "row", "chunk", first.alias("first"), (F.col("common") + chunk).alias("last"), F.min(fine).over(doc).alias("stitched"))


def _encoded(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ids of a chunk's own pre-tokens; a chunk of a text that isn't stitched keeps its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in _slices(batches):
            ids, texts = [], []
            for text, ends, a, z, fine in zip(*(b.column(x).to_pylist() for x in ("text", "ends", "first", "last", "stitched")), strict=True):
                if fine:
                    own = [e for e in ends if e > a and (z is None or e <= z)]
                    ids.append(c.ids([text[i:j] for i, j in zip([a, *own], own, strict=False)]))
                    texts.append(None)
                else:
                    ids.append(None)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("part", "row", "chunk", "doc_id")), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["part", "row", "chunk", "doc_id", "ids", "text"])

    return run


def _assembled(path: str, chunk: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a text from its chunks, which come in order; a text that isn't stitched is encoded as a whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at, doc, ids, texts = coder(path), None, None, [], []

        def out() -> pa.RecordBatch:
            whole = "".join([t[:chunk] for t in texts[:-1]] + texts[-1:])
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([c.text_ids(whole) if texts else b"".join(ids)], pa.binary())], names=["doc_id", "ids"])

        for b in batches:
            for part, row, d, i, t in zip(*(b.column(x).to_pylist() for x in ("part", "row", "doc_id", "ids", "text")), strict=True):
                if at not in (None, (part, row)):
                    yield out()
                    ids, texts = [], []
                at, doc = (part, row), d
                if t is None:
                    ids.append(i)
                else:
                    texts.append(t)
        if at:
            yield out()

    return run


def encode(docs: DataFrame, vocabulary_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) for each of docs: the whole text's byte-level BPE ids, little-endian unsigned 32-bit integers.

    Texts of more than chunk code points are dealt out in chunks that overlap. Every chunk is pre-tokenised by
    itself; stitches() says from which boundary on each counts, and its pre-tokens are encoded where they are. A
    text whose chunks don't resynchronise is put together and encoded in one piece, so results never depend on chunk.

    Nulls: a null text is empty and has no ids; a null doc_id stays null. Each row counts, repeated ones too.
    Bytes that aren't UTF-8 are read as U+FFFD. Special strings are ordinary text. An empty table gives an empty
    result; other columns are left out.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (size > chunk).alias("long"))
    short = d.where("not long").select("doc_id", "text").mapInArrow(_whole(vocabulary_path), "doc_id long, ids binary")
    cut = "part int, row long, doc_id long, chunk int, chunks int, text string"
    chunks = d.where("long").select("doc_id", "text").mapInArrow(_cut(chunk, overlap), cut).repartition("part", "row", "chunk")
    chunks = staged(chunks.mapInArrow(_pretokens(vocabulary_path), cut + ", ends array<int>"), "chunks", dictionary=False)
    own = chunks.join(sized(stitches(chunks, chunk, overlap)), ["part", "row", "chunk"])
    encoded = own.mapInArrow(_encoded(vocabulary_path), "part int, row long, chunk int, doc_id long, ids binary, text string")
    long = encoded.repartition("part", "row").sortWithinPartitions("part", "row", "chunk").mapInArrow(_assembled(vocabulary_path, chunk), "doc_id long, ids binary")
    return short.unionByName(long)


def _decoded(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in _slices(batches):
            raw = [None if x is None else c.bytes_of(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """encoded(doc_id, ids) with decoded: the tokens' raw bytes one after another (null for null ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(vocabulary_path), "doc_id long, ids binary, decoded binary")
