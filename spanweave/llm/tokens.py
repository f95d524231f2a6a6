"""Token ids of whole texts, and token counts from a table of distinct pre-tokens."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.staging import discard, staged

#: A line of letters that are one pre-token together, then ASCII punctuation, which is another; or any other line.
_LINE = re.compile(r"^(?:([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)|.*)$", re.M)
_JOINED = 256
#: Texts that a task encodes together, bytes of them unless one has more, and bytes of them that it splits at a time.
TEXTS, TEXT_BYTES = 512, 16 << 20
STEP = 1 << 20
#: Bytes of the parts that an encoder keeps.
PART_BYTES = 64 << 20
#: Most distinct pre-tokens, and bytes of them, whose counts are broadcast; longer ones than LONG aren't.
FREQUENT, FREQUENT_BYTES, LONG = 200_000, 8 << 20, 1024
_WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: A full stop, or a comma, that ends a part behind an ASCII letter: a pre-token of its own.
_STOP, _COMMA = re.compile(rb"\.(?<=[a-zA-Z]\.)(?![^ \t\n\r\x0b\x0c])"), re.compile(rb",(?<=[a-zA-Z],)(?![^ \t\n\r\x0b\x0c])")


def _plain(text: bytes) -> bytes:
    """A text with the same ids and fewer distinct parts: ASCII letters in lower case, a last stop or comma apart.

    A text that may have a special string keeps its letters, and so does one with U+0300 to U+037F, since NFC
    composes some of those with small letters only (U+01F0).
    """
    if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    return _COMMA.sub(b" ,", _STOP.sub(b" .", text))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' package has a file; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch's rows with up to TEXTS rows and TEXT_BYTES bytes of a binary column at a time, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, a = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while a < batch.num_rows:
        z = max(a + 1, min(a + TEXTS, int(np.searchsorted(ends, ends[a] + TEXT_BYTES, side="right")) - 1))
        yield batch.slice(a, z - a)
        a = z


class Encoder:
    """What a tokenizer makes of texts; the tokenizer drops white space and marks the last piece of each pre-token.

    A text is cut at ASCII white space, which no pre-token crosses. Each distinct part is encoded once; its ids
    (as bytes) are kept, or only their number. Parts of letters and punctuation share their pre-tokens. When the
    parts kept reach max_parts, or the pre-tokens a third as many, they are dropped and gathered anew; when the parts
    learned reach max_bytes (texts without white space are one part each), both are. So memory stays bounded.
    """

    def __init__(self, path: str, counts: bool = False, max_parts: int = 1_000_000, max_bytes: int = PART_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.counts, self.max_parts, self.max_bytes = Tokenizer.from_file(path), counts, max_parts, max_bytes
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.parts: dict[bytes, bytes | int] = {}
        self.words: dict[str, bytes | int] = {}
        self.learned = 0

    def _kept(self, ids: list[int]) -> bytes | int:
        return len(ids) if self.counts else np.array(ids, dtype=self.kind).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Many words in one text; the pieces that end a word tell them apart."""
        groups = [words[a : a + _JOINED] for a in range(0, len(words), _JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):  # never so for letters; each word by itself is right in any case
                self.words.update((w, self._kept(self.tokenizer.encode(w, add_special_tokens=False).ids)) for w in group)
            elif self.counts:
                self.words.update(zip(group, np.diff(ends, prepend=0).tolist(), strict=True))
            else:
                raw, at = ids.tobytes(), (ends * self.kind.itemsize).tolist()
                self.words.update(zip(group, (raw[a:z] for a, z in zip([0, *at], at, strict=False)), strict=True))

    def _learn(self, new: set[bytes]) -> None:
        """Letters of one lower-case letter each are lowered here, so that words in any case are encoded once."""
        parts = list(new)
        text = b"\n".join(parts).decode()
        pairs = _LINE.findall(text.lower())
        if "<|" in text:  # may be a special string, which isn't lowered
            pairs = [("", "") if "<|" in marks else (word, marks) for word, marks in pairs]
        words = self.words
        missing = {x for pair in pairs for x in pair}.difference(words)
        missing.discard("")
        self._learn_words(list(missing))
        self.parts.update((part, words[word] + words[marks] if marks else words[word]) for part, (word, marks) in zip(parts, pairs, strict=True) if word)
        other = [part for part, (word, _) in zip(parts, pairs, strict=True) if not word]
        encoded = self.tokenizer.encode_batch_fast([part.decode() for part in other], add_special_tokens=False)
        self.parts.update((part, self._kept(e.ids)) for part, e in zip(other, encoded, strict=True))
        if len(words) > self.max_parts // 3:
            self.words = {}

    def _parts(self, texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """(text's number, parts) of each text, a long one in several steps; the parts are known until the next step.

        Steps hold at most about 2 * STEP bytes of text, unless one part alone has more.
        """
        group: list[tuple[int, list[bytes]]] = []
        size = 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text) or not text:
                cut = _WHITE.search(text, at + STEP)
                end = cut.start() if cut else len(text)
                group.append((i, _plain(text[at:end]).split()))
                size += end - at
                at = end
                if size >= STEP:
                    yield from self._known(group)
                    group, size = [], 0
                if not text:
                    break
        yield from self._known(group)

    def _known(self, group: list[tuple[int, list[bytes]]]) -> list[tuple[int, list[bytes]]]:
        new: set[bytes] = set()
        for _, parts in group:
            new.update(parts)
        missing = new.difference(self.parts)
        if missing and len(self.parts) + len(missing) > self.max_parts:
            self.parts, missing = {}, new
        if missing and self.learned + sum(map(len, missing)) > self.max_bytes:
            self.parts, self.words, self.learned, missing = {}, {}, 0, new
        if missing:
            self.learned += sum(map(len, missing))
            self._learn(missing)
        return group

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, little-endian in self.kind; a null text has none."""
        out: list[list[bytes]] = [[] for _ in texts]
        for i, parts in self._parts(t or b"" for t in texts):
            out[i].append(b"".join(map(self.parts.__getitem__, parts)))
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def numbers(self, parts: list[bytes]) -> list[int]:
        """The number of tokens of each pre-token."""
        self._known([(0, parts)])
        return list(map(self.parts.__getitem__, parts))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, counts: bool = False) -> Encoder:
    """The encoder of this worker for a tokenizer file."""
    if (path, counts) not in _ENCODERS:
        # Distinct pre-tokens, which are counted, come once.
        _ENCODERS[path, counts] = Encoder(path, counts, 50_000) if counts else Encoder(path)
    return _ENCODERS[path, counts]


def _steps(text: bytes) -> Iterator[list[bytes]]:
    """The pre-tokens of a text, those of a long one in several steps."""
    at = 0
    while at < len(text):
        cut = _WHITE.search(text, at + STEP)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            b = batch.slice(at, TEXTS)
            yield b, [t or b"" for t in b.column("text").to_pylist()]


def _pretokens(most: int = 400_000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(piece, n): how often each distinct pre-token is in a task's texts; counted anew when most have been gathered."""

    def out(often: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(often.keys(), pa.binary()), pa.array(often.values(), pa.int64())], names=["piece", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: Counter[bytes] = Counter()
        for _, texts in _texts(batches):
            for text in texts:
                for parts in _steps(text):
                    often.update(parts)
            if len(often) > most:
                yield out(often)
                often = Counter()
        yield out(often)

    return run


def _counted(path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, counts=True)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array(enc.numbers(b.column("piece").to_pylist()), pa.int64())], names=["piece", "n", "tokens"])

    return run


def pretoken_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, n, tokens): each distinct pre-token of docs(text: binary), how often it is there, and its tokens.

    A pre-token is what stands between ASCII white space (binary, UTF-8); each is encoded once, whatever texts
    have it. Frequencies are added up in the tasks before they are shuffled.
    """
    often = docs.select("text").mapInArrow(_pretokens(), "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return often.mapInArrow(_counted(tokenizer), "piece binary, n long, tokens long")


def frequent(counts: DataFrame, most: int = FREQUENT, most_bytes: int = FREQUENT_BYTES) -> tuple[int, dict[bytes, int]]:
    """(least, tokens by pre-token) of all pre-tokens up to LONG bytes with a frequency of least or more.

    least is the smallest step of a scale of frequencies at which they are no more than most and most_bytes.
    """
    short = counts.where(F.octet_length("piece") <= LONG)
    step = F.floor(4 * F.log2("n")).alias("step")
    scale = short.groupBy(step).agg(F.min("n").alias("least"), F.count("*").alias("rows"), F.sum(F.octet_length("piece")).alias("bytes")).orderBy(F.desc("step")).collect()
    least, rows, size = (1 << 62), 0, 0
    for r in scale:
        rows, size = rows + r["rows"], size + r["bytes"]
        if rows > most or size > most_bytes:
            break
        least = r["least"]
    return least, {bytes(r["piece"]): r["tokens"] for r in short.where(F.col("n") >= least).select("piece", "tokens").collect()}


def _joined(known: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text: its bytes, the tokens of its frequent pre-tokens, and its other pre-tokens with frequencies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, row = known.value, TaskContext.get().partitionId(), 0
        for b, texts in _texts(batches):
            sums, pieces, often_of = [], [], []
            for text in texts:
                total, rare = 0, Counter()
                for parts in _steps(text):
                    often = Counter(parts)
                    counts = list(map(tokens.get, often))
                    if None in counts:
                        rest = {p: f for (p, f), c in zip(often.items(), counts, strict=True) if c is None}
                        rare.update(rest)
                        total += sum(c * f for c, f in zip(counts, often.values(), strict=True) if c is not None)
                    else:
                        total += sum(map(mul, counts, often.values()))
                sums.append(total)
                pieces.append(list(rare))
                often_of.append(list(rare.values()))
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), part, dtype=np.int32)), pa.array(rows), b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sums, pa.int64()), pa.array(pieces, pa.list_(pa.binary())), pa.array(often_of, pa.list_(pa.int64()))],
                names=["part", "row", "doc_id", "n_bytes", "n_tokens", "pieces", "often"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, most_frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each of docs: tokens of the whole text without added ones.

    The pieces of each distinct pre-token of the corpus are counted once, in a table (pretoken_counts). Each
    document's pre-token frequencies are joined to it and the products summed; no ids are made up for a document.
    The join has two ways for one result: the counts of the most frequent pre-tokens, at most most_frequent and
    FREQUENT_BYTES of them, are broadcast, so that no frequent one is a key of a shuffle; the pairs of a document
    and a rarer pre-token are shuffled by pre-token.

    Nulls: a null text is empty (0 bytes, 0 tokens); a null doc_id stays null. Each row counts, repeated ones
    too. An empty table gives an empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counts = staged(pretoken_counts(d, tokenizer), "pretokens")
    least, known = frequent(counts, most_frequent)
    shape = "part int, row long, doc_id long, n_bytes long, n_tokens long, pieces array<binary>, often array<long>"
    each = staged(d.mapInArrow(_joined(spark.sparkContext.broadcast(known)), shape), "frequencies")
    pairs = each.select("part", "row", F.explode(F.arrays_zip("pieces", "often")).alias("x")).select("part", "row", F.col("x.pieces").alias("piece"), F.col("x.often").alias("often"))
    rare = counts.where((F.col("n") < least) | (F.octet_length("piece") > LONG)).select("piece", "tokens")
    sums = pairs.join(rare, "piece").select("part", "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("often") * F.col("tokens")).alias("n_tokens"))
    all_of = each.select("part", "row", "doc_id", "n_bytes", "n_tokens").unionByName(sums).groupBy("part", "row")
    out = staged(all_of.agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("part", "row"), "token-counts")
    discard(counts, each)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
