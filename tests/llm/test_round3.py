"""Prefix trie, byte-level BPE and hard negatives: against SQL, the library and brute force, and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from spanweave.llm import byte_pairs, hard_negatives, prefix_trie
from spanweave.llm import queries as Q
from spanweave.llm.html_text import extract_text
from spanweave.llm.neighbours import nearest
from spanweave.llm.tokens import tokenizer_path

VOCABULARY = tokenizer_path("byte_bpe_multi_50k.tiktoken")
TURNS = "conv_id long, turn long, role string, text string"


def trie_by_brute_force(rows):
    """rows: (conv_id, turn, role, text), without ties."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    out = set()
    for n, m in members.items():
        below = [k for k in members if k[: len(n)] == n]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        out.add((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(not children[k] for k in below), saved, hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()))
    return out


def trie(spark, rows):
    d = spark.createDataFrame(rows, TURNS)
    for c in ("DEPTH", "k1", "path", "N_convs", "_at", "words"):
        d = d.withColumn(c, F.lit("x"))
    return {tuple(r) for r in prefix_trie.prefix_trie(d).collect()}


def odd_conversations():
    rng, rows = np.random.default_rng(1), []
    for c in [*range(0, 90), 207, 1000, 1019]:  # 207's group has no head; 1019's has one turn
        rows += [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choice(["a", "b", "c"], 2))) for t in range(1 if c == 1000 else int(rng.integers(1, 7)))]
    rows += [(21, None, None, "first"), (22, 90, "user", None), (23, 91, None, ""), (None, 1, "user", "nobody's")]
    rows += [(c, t, "user", f"same {t}") for c in (120, 121, 122, 123) for t in range(40)]  # deeper than two bands
    return rows


def test_trie_by_brute_force(spark):
    rows = odd_conversations()
    assert trie(spark, rows) == trie_by_brute_force(rows)


def test_trie_in_small_bands_and_blocks(spark, monkeypatch):
    """Four levels of bands, prefixes over several blocks, ids in several runs."""
    monkeypatch.setattr(prefix_trie, "BAND", 2)
    monkeypatch.setattr(prefix_trie, "TURNS", 8)
    rows = odd_conversations()
    assert trie(spark, rows) == trie_by_brute_force(rows)


def test_trie_digest_of_many_ids(spark):
    ids = list(range(20000, 32000))
    d = spark.createDataFrame([(1, 2, i) for i in ids[::-1]] + [(1, 3, 5)], "k1 long, k2 long, conv_id long")
    got = {r["k2"]: r["ends_sha256"] for r in prefix_trie.ends_digests(d.repartition(7)).collect()}
    assert got == {2: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"5").hexdigest()}


def test_trie_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie(spark, [(None, 1, "user", "x")]) == set()
    # Two equal rows are two turns; a tie in turn goes by role, then by the text's digest.
    got = trie(spark, [(20, 1, "b", "x"), (20, 1, "a", "y"), (20, 1, "a", "y")])
    assert len(got) == 4 and max(r[1] for r in got) == 3
    # A conversation without turns of its own or of its group's head is a member of the root only.
    c = next(i for i in range(41, 60) if zlib.crc32(str(i).encode()) % 4 == 3)
    assert trie(spark, [(c, 1, "user", "x")]) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.vocabulary(VOCABULARY), special_tokens={})


ODD_TEXTS = [
    "", " ", "  ", "a  b", " a", "a ", "\n", "\n x", "a\n\n b", "a \n b", "it's  we'll 'S", "x" * 3000, "!" * 700 + "\n" * 700, " " * 900, "ab " * 400, "<|endoftext|> a <|endoftext|>", "1234567890 ½ Ⅷ 一二三", "éàü ß x  y　z",
    "\x1c \x1f a", "tab\tand\r\nline", "\U0001f600 \U0001f468‍\U0001f469 x", "word\x00null", "'" * 50, "a'r" * 100, " \t ".join("pqrs" * 30), "it'" * 333 + "re",
]


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 1 << 10), (64, 16), (7, 3)])
def test_byte_pairs_equal_library(spark, library, chunk, overlap):
    """Chunks of any size give the library's ids, also where they don't resynchronise."""
    texts = ODD_TEXTS + [" ".join(ODD_TEXTS)]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (900, None, "x"), (3, texts[3], "x")], "doc_id long, text string, IDS string")
    got = byte_pairs.decode(byte_pairs.encode(d, VOCABULARY, chunk, overlap), VOCABULARY).collect()
    as_ids = lambda t: np.array(library.encode_ordinary(t), dtype="<u4").tobytes()
    want = [(i, as_ids(t), t.encode()) for i, t in enumerate(texts)] + [(None, as_ids("no id"), b"no id"), (900, b"", b""), (3, as_ids(texts[3]), texts[3].encode())]
    assert collections.Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == collections.Counter(want)


def test_stitching_keeps_most_texts_apart(spark):
    """Ordinary texts are stitched; a run longer than the overlap isn't."""
    d = spark.createDataFrame([(1, "some words and more of them " * 40), (2, "y" * 900)], "doc_id long, text string")
    cut = "part int, row long, doc_id long, chunk int, chunks int, text string"
    chunks = d.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(byte_pairs._cut(100, 20), cut).mapInArrow(byte_pairs._pretokens(VOCABULARY), cut + ", ends array<int>").cache()
    fine = chunks.join(byte_pairs.stitches(chunks, 100, 20), ["part", "row", "chunk"]).groupBy("doc_id").agg(F.min("stitched")).collect()
    assert {r[0]: r[1] for r in fine} == {1: True, 2: False}


def test_byte_pairs_bounded_memory(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "WORDS", 20)
    monkeypatch.setattr(byte_pairs, "PIECES", 20)
    coder, text = byte_pairs.Coder(VOCABULARY), " ".join(f"w{i} x" for i in range(300))
    for t in (text, text[5:], "short one"):
        assert coder.text_ids(t) == np.array(library.encode_ordinary(t), dtype="<u4").tobytes() and len(coder.known) <= 1000


def test_op12_matches_library(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = Q.op12_byte_level_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode_ordinary(docs[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
    none = byte_pairs.encode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY)
    assert byte_pairs.decode(none, VOCABULARY).count() == 0


def negatives_by_brute_force(rows, every=50, positives=5, negatives=3):
    out = []
    for n, (a, label, q) in enumerate(rows):
        if a % every:
            continue
        others = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, k) for m, (i, k, v) in enumerate(rows) if m != n and len(v) == len(q)]
        for s, p, _ in [(-s, i, k) for s, i, k in sorted(others) if k == label][:positives]:
            fit = [(i, -t) for t, i, k in sorted(others) if k != label and 50 * s <= 100 * -t <= 95 * s][:negatives]
            out += [(a, p, r, i, s, t) for r, (i, t) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    d = spark.createDataFrame(rows, "vec_id long, label int, q array<long>").withColumn("SCORE", F.lit("x")).withColumn("block", F.lit(1))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(d, **options).collect())


@pytest.mark.parametrize("block", [None, 16])
def test_negatives_by_brute_force(spark, monkeypatch, block):
    """Ties, equal vectors, two lengths, zero vectors; several pages of zone maps and parts of anchors with small blocks."""
    if block:
        monkeypatch.setattr(hard_negatives, "PAGE", 4)
        monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), [int(x) for x in rng.integers(-40, 60, 6 if i % 9 else 3)]) for i in range(400)]
    rows += [(1000 + i, i % 2, [5, 5, 5, 5, 5, 5]) for i in range(150)] + [(2000, 1, [0] * 6), (2050, 1, [9] * 6), (50, 2, [9, 9, 9, 9, 9, 9])]
    assert mined(spark, rows, block=block) == negatives_by_brute_force(rows)


def test_negatives_large_numbers_and_odd_rows(spark):
    big = 1 << 29
    rows = [(0, 1, [big, 1]), (1, 1, [big, 3]), (2, 2, [big * 8 // 10, 5]), (3, 2, [big * 8 // 10, 7]), (4, 2, [-big, 0])]
    odd = [(None, 1, [1, 1]), (5, None, [1, 1]), (6, 1, None), (7, 1, [1, None]), (8, 1, [1 << 40, 1]), (100, 1, []), (150, 1, [3, 4, 5])]
    assert mined(spark, rows + odd) == negatives_by_brute_force(rows)
    assert mined(spark, odd[:4]) == [] and mined(spark, rows[:0]) == []


def test_hilbert_neighbours_differ_by_one_step():
    """All points of a grid, sorted by their keys, are a walk of single steps."""
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
        keys = hard_negatives.hilbert_keys(grid, bits)
        walk = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert len(set(keys)) == len(grid) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_skip_blocks(spark):
    """In two dimensions the bounds rule out most blocks: the searches ask for few of them."""
    rng = np.random.default_rng(5)
    v = rng.integers(-1000, 1000, (4000, 2))
    rows = [(i, i % 2, [int(a), int(b)]) for i, (a, b) in enumerate(v)]
    asked = collections.Counter()
    real = hard_negatives.Candidates._read

    def counted(self, q, k, same, first):
        self.blocks.sparkSession.sparkContext.setJobDescription("read")
        keys = ["page", "part"]
        paged = q.select("*", F.lit(0).alias("page"), F.lit(0).alias("part"))
        asked[same] += paged.groupBy(*keys).cogroup(self.zones.groupBy(*keys)).applyInArrow(hard_negatives._chosen(same, first), f"{hard_negatives._ASKED}, block long").count()
        asked["all"] = q.count() * self.n
        return real(self, q, k, same, first)

    hard_negatives.Candidates._read = counted
    try:
        assert mined(spark, rows, block=32) == negatives_by_brute_force(rows)
    finally:
        hard_negatives.Candidates._read = real
    assert asked[True] < 0.35 * asked["all"] and asked[False] < 0.7 * asked["all"], asked


def test_words_of_names_inside_the_article(spark):
    """A word alone, or beside words about something else, drops nothing inside an article; with layout or only marks it does."""
    text = "A long paragraph of the article itself, with enough words to be read as such. " * 4
    kept = ["cookie-recipe", "informed-consent", "navigation-history", "modal-logic", "ad-hoc", "related", "form"]
    gone = ["ad", "ads banner", "cookie-banner", "newsletter-box", "comments", "share-buttons", "related-posts"]
    page = lambda c: f"<html><body><article><p>{text}</p><section class='{c}'><p>The part in question.</p></section></article></body></html>"
    d = spark.createDataFrame([(i, f"http://h{i}.com/x", page(c)) for i, c in enumerate(kept + gone)], "page_id long, url string, html string")
    got = {r["page_id"]: "part in question" in r["text"] for r in extract_text(d).collect()}
    assert {c for i, c in enumerate(kept + gone) if got[i]} == set(kept)


def test_neighbours_of_double_vectors(spark):
    """Distances are of the vectors as they are given, also where floats can't hold them."""
    v = {0: [1.0, 0.0], 1: [1.0 + 1e-12, 0.0], 2: [1.2, 0.0], 3: [1e39, 0.0], 4: [1.0, 0.3]}
    got = {r["vec_id"]: r["score"] for r in nearest(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")).collect()}
    assert got == {i: float(np.sqrt(((np.array(x) - np.array(v[0])) ** 2).sum())) for i, x in v.items() if i}
