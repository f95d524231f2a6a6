"""Each operator against SQL or brute force, and on nulls, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import html.parser
import math
import pathlib
import re
import time
import zlib

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from spanweave.llm import queries as Q
from spanweave.llm.components import components
from spanweave.llm.html_text import extract_text, scored, text_of
from spanweave.llm.jaccard import jaccard_classes, one_of_each
from spanweave.llm.licence_texts import TEMPLATES
from spanweave.llm.licences import licence_scan
from spanweave.llm.line_dedup import line_dedup
from spanweave.llm.mixing import mix
from spanweave.llm.neighbours import chi_square_quantile, nearest
from spanweave.llm.packing import pack
from spanweave.llm.quality import quality_rules
from spanweave.llm.secrets import secret_report, secret_spans
from spanweave.llm.tokens import Encoder, count_tokens, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(1000)) for _ in range(n))


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a repeated row, a clashing id, and columns named like results."""
    long = "\n".join(words(60, i) for i in range(300))
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, words(80, 1), "en", "a", 1), (3, " \n\t\n ", "en", "b", 1), (4, long, "en", "b", 1), (5, words(80, 1), "en", "a", 1), (5, words(80, 1), "en", "a", 1), (5, words(70, 2), "en", "a", 1), (6, "a", "en", "a", 1)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("KEPT", "N_words", "copy", "class_id", "spans", "N_Lines", "_key", "path", "Rate", "dice", "n", "text_LEFT"):
        d = d.withColumn(c, F.lit("x"))
    return d


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


def test_odd_rows_have_results(spark, odd):
    n, key = odd.count(), lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    in_order = lambda d: sorted(d.collect(), key=key)
    ids = [1, 2, 3, 4, 5, 5, 5, 6, None]
    kept = in_order(quality_rules(odd))
    assert [r["doc_id"] for r in kept] == ids and [r["kept"] for r in kept] == [False, False, False, True, True, True, True, False, True]
    assert {r["doc_id"] for r in quality_rules(odd).where("kept").collect()} == {4, 5, None}
    lines = in_order(line_dedup(odd))
    texts = {r["doc_id"]: r["text"] for r in lines}
    # The row without an id comes first; the two equal rows lose its line, and count as one document.
    assert [r["doc_id"] for r in lines] == ids and texts[None] == words(80, 1) and texts[2] is None and texts[1] == "" and texts[3] == " \n\t\n "
    assert sorted(r["text"] for r in lines if r["doc_id"] == 5) == ["", "", words(70, 2)]
    assert [r["n_removed_lines"] for r in lines if r["doc_id"] in (1, 2, 3, 4, 6, None)] == [0] * 6 and [r["n_lines"] for r in lines if r["doc_id"] in (1, 2)] == [1, 0]
    classes = in_order(jaccard_classes(odd))
    assert [r["doc_id"] for r in classes] == ids and [(r["class_id"], r["n_links"]) for r in classes if r["doc_id"] in (1, 2, 3, 6)] == [(1, 0), (2, 0), (3, 0), (6, 0)]
    assert sorted(r["n_links"] for r in classes if r["doc_id"] == 5) == [0, 2, 2] and classes[-1]["n_links"] == 2 and classes[-1]["class_id"] == 5
    assert sorted(map(str, (r["doc_id"] for r in one_of_each(odd).collect()))) == sorted(map(str, ids))
    for f in (secret_report, licence_scan, lambda d: count_tokens(d, tokenizer_path())):
        assert [r["doc_id"] for r in in_order(f(odd))] == ids
    packed = pack(odd, tokenizer_path()).collect()
    assert sum(r["length"] for r in packed) == sum(r["n_tokens"] + 1 for r in count_tokens(odd, tokenizer_path()).collect())
    mixed = mix(odd, weights={"a": 1.0, "b": 1.0, "": 1.0}, target_rows=900).collect()
    assert len(mixed) > 500 and {r["source"] for r in mixed} == {"a", "b", None} and n == 9


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for f in (quality_rules, line_dedup, secret_report, secret_spans, licence_scan, jaccard_classes, one_of_each, mix, lambda d: count_tokens(d, tokenizer_path()), lambda d: pack(d, tokenizer_path())):
        assert f(none).count() == 0
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quality_counts(spark):
    text = "a b c x a b c\n# $ line\n# $ line"
    r = quality_rules(docs_of(spark, [text])).head()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (13, 19, 4, 1, 12)


def test_quality_removes_frequent_lines(spark):
    menu = "Home News About Contact Search " * 12
    d = docs_of(spark, [menu + f"\n{words(5, i)}" for i in range(40)] + [words(80, i) for i in range(100, 160)])
    got = {r["doc_id"]: r["kept"] for r in quality_rules(d).collect()}
    assert not any(got[i] for i in range(40)) and all(got[i] for i in range(40, 100))


def test_quality_counts_copies_once(spark):
    d = docs_of(spark, [words(80, 1)] * 60 + [words(80, i) for i in range(2, 30)])
    assert all(r["kept"] for r in quality_rules(d).collect())


def test_quality_stage_drops_frequent_lines(spark):
    menu = "  Home\tNews ABOUT Σ"
    bodies = [f"{words(50, i)}\n\n {words(40, 500 + i)} \n" for i in range(40)]
    d = docs_of(spark, [b.replace("\n\n", f"\n{menu if i % 2 else menu.lower()}\n\n{menu}\n") for i, b in enumerate(bodies)] + [None])
    d = d.unionByName(docs_of(spark, [f"{menu}\n{bodies[0]}"], source="other").withColumn("doc_id", F.lit(99).cast("long")))
    got = {r["doc_id"]: r for r in corpus_pipeline.quality(spark, d, SF).collect()}
    want = {**dict(enumerate(bodies)), 99: f"{menu}\n{bodies[0]}"}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert [r["text_left"] for r in quality_rules(d).where("text is null").collect()] == [None]


def brute_runs(texts, least=50):
    """Texts without the lines of runs with at least this many words that occur earlier, by comparing all runs."""
    lines = [[(p, " ".join(x.split())) for p, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    seen, gone = {}, collections.defaultdict(set)
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            n = 0
            for z in range(a, len(ls)):
                n += len(ls[z][1].split())
                if n >= least:
                    key = tuple(x for _, x in ls[a : z + 1])
                    if seen.setdefault(key, (d, a)) != (d, a):
                        gone[d].update(range(ls[a][0], ls[z][0] + 1))
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_matches_all_runs(spark):
    rng = np.random.default_rng(5)
    pool = [words(int(n), i) for i, n in enumerate(rng.integers(1, 40, 30))] + ["", " "]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 14))) for _ in range(60)]
    texts += [texts[3] + "\nend", "new\n" + texts[4], texts[5]]
    got = {r["doc_id"]: r["text"] for r in line_dedup(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_runs(texts)


def brute_classes(texts, n=5, t=0.8):
    sets = []
    for x in texts:
        w = [y for y in re.split(r"[\x20\x09-\x0D]+", (x or "").lower()) if y]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [(root[i], links[i]) for i in range(len(texts))]


def test_jaccard_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    texts = []
    for i in range(12):
        base = words(int(rng.integers(3, 120)), 100 + i).split()
        for k in range(6):
            w = list(base)
            for j in rng.integers(0, len(w), k // 2 + len(w) // 150):
                w[j] = "new"
            texts.append(" ".join(w))
    texts += ["", None, "one two", "one two", texts[0].upper()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_jaccard_short_texts(spark):
    texts = []
    for i in range(150):
        base = words(int(np.random.default_rng(i).integers(9, 24)), 500 + i)
        texts += [base, base + " more", "more " + base]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_jaccard_finds_pairs_of_all_sizes(spark, monkeypatch):
    """Lone pairs at the threshold, where every bucket is split as often as it may be."""
    import spanweave.llm.jaccard as J

    monkeypatch.setattr(J, "SMALL", 1)
    rng, texts = np.random.default_rng(5), []
    for shared, union in ((4, 5), (8, 10), (16, 20), (48, 60), (52, 65), (80, 100)):
        for _ in range(60):
            w = [f"w{x}" for x in rng.integers(0, 1 << 40, union + 4)]
            texts += [" ".join(w[: shared + 4]), " ".join(w)]
    # More than 64 shingles, of which fewer are distinct.
    w = [f"w{x}" for x in rng.integers(0, 1 << 40, 50)]
    texts += [" ".join(w), " ".join(w + w[:46])]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [(i - i % 2, 1) for i in range(len(texts))]


def test_jaccard_large_group_in_blocks(spark, monkeypatch):
    import spanweave.llm.jaccard as J

    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(J, "CLUSTER_BLOCK", 8)
    base = words(200, 9).split()
    texts = [" ".join([*base[:i], f"w{i}", *base[i + 1 :]]) for i in range(50)] + [words(60, i) for i in range(200, 240)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(40)] + [tuple(map(int, rng.integers(100, 200, 2))) for _ in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_components_in_few_rounds(spark, monkeypatch):
    from spanweave.llm import components as C

    rounds, written = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: (rounds.append(name), written(df, name))[1])
    n = 10_000
    path = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(n).select(F.lit(n + 5000).alias("a"), (F.col("id") + n).alias("b"))
    got = components(path.unionByName(star)).groupBy("label").count().collect()
    assert {(r["label"], r["count"]) for r in got} == {(0, n), (n, n)}
    assert rounds.count("targets") <= 20
    rounds.clear()
    assert components(star).select("label").distinct().count() == 1 and rounds.count("targets") <= 2
    odd = spark.createDataFrame([(None, 1), (2, None), (3, 3), (5, 4), (5, 4)], "a long, b long")
    assert sorted(map(tuple, components(odd).collect())) == [(4, 4), (5, 4)]
    assert components(odd.limit(0)).count() == 0


def test_secret_positions_and_links(spark):
    key = "AKIA" + "Q" * 16
    strong = "wJalrXUtnFEMI7K7MDENG9bPxRfiCYEXAMPLEKEY"
    texts = [f"é😀 token = abcdef {key} x", "token = ab secret:longenough", f"{strong} alone https://h/x", f"{key} with {strong} at https://h/x", "deadbeef" * 3, "token==abcdefg", f"{key}{'y' * 400} {strong}"]
    got = {r["doc_id"]: r for r in secret_report(docs_of(spark, texts)).collect()}
    assert got[0]["spans"] == "assign:3:17,access:18:38"
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:3:17,access:18:38").hexdigest()
    assert (got[1]["n_assign"], got[1]["spans"]) == (1, "assign:11:28")
    assert got[2]["spans"] == ""
    assert got[3]["spans"] == f"access:0:20,secret:26:{26 + len(strong)},endpoint:{26 + len(strong) + 4}:{26 + len(strong) + 15}"
    assert (got[4]["n_hex"], got[4]["spans"]) == (1, "hex:0:24")
    assert got[5]["spans"] == "assign:0:14"
    assert got[6]["spans"] == "access:0:20"


def test_licences(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    texts = ["x\nReleased under the MIT License.\ny", " ".join(mit.split()).upper(), "prose\n\n" + "\n".join(mit.split("\n")) + "\n\nmore", words(50), "released under the licence of nobody at all"]
    got = {r["doc_id"]: r for r in licence_scan(docs_of(spark, texts)).collect()}
    assert [got[i]["licence"] for i in range(5)] == ["MIT", "MIT", "MIT", None, None]
    assert (got[0]["pos"], got[0]["unit"], got[0]["dice"]) == (1, "line", 1.0) and got[2]["unit"] == "paragraph"


def test_licences_inside_other_text(spark):
    long = {n: " ".join(t.split()) for n, t in TEMPLATES if len(t) > 160}
    parts = {"MIT": ("The above copyright", "THE SOFTWARE IS PROVIDED"), "Apache-2.0": ("You may obtain", "http://www", "Unless required"), "GPL-3.0": ("This program is distributed", "You should have"), "BSD-3-Clause": ("1. Redis", "2. Redis", "3. Neither")}
    texts, want = [], []
    for name, begins in parts.items():
        t = long[name]
        for x in begins:
            t = t.replace(x, "\n\n" + x)
        texts += [f"{words(80, 1)}\n\n{t}\n\n{words(200, 2)}", f"{words(9, 3)} {long[name]} {words(200, 4)}"]
        want += [name, name]
    texts += [f"{words(30)} Released under the MIT License. {words(30, 5)}", f"{words(30)} released under many a license", " ".join(f"{x} {words(2, i)}" for i, x in enumerate(long["MIT"].split()))]
    got = {r["doc_id"]: r for r in licence_scan(docs_of(spark, texts)).collect()}
    assert [got[i]["licences"] for i in range(len(texts))] == [*want, "MIT", "", ""]
    assert all(got[i]["unit"] == "run" and got[i]["dice"] == 1.0 for i in range(9)) and got[8]["pos"] == 30


def test_full_licences_in_other_text(spark):
    """Whole texts of long licences, with other text around, with changed words, and cut short."""
    from spanweave.llm.licence_texts import full_texts

    rng = np.random.default_rng(8)
    texts, want = [], []
    for name, t in full_texts():
        w = t.split()
        changed = [x if rng.random() > 0.05 else "other" for x in w]
        texts += [t, f"{words(300, 1)}\n\n{t}\n\n{words(2500, 2)}", f"{words(90, 3)} {' '.join(changed)} {words(50, 4)}", " ".join(w[: len(w) // 3])]
        want += [name, name, name, None]
    got = {r["doc_id"]: r for r in licence_scan(docs_of(spark, texts)).collect()}
    assert [w is None or w in got[i]["licences"].split(",") for i, w in enumerate(want)] == [True] * len(want)
    assert [(i, w, got[i]["licence"], got[i]["dice"]) for i, w in enumerate(want) if w and not (got[i]["licence"] == w and got[i]["dice"] > 0.84)] == []
    assert all(full_texts()[i // 4][0] not in got[i]["licences"].split(",") for i in range(3, len(want), 4))


def licences_by_brute_force(text):
    """(licences, best dice) of a text: every unit and every run, in plain Python with its own normalisation."""
    from spanweave.llm.licence_texts import full_texts

    def grams(text):
        w = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        return list(zip(w, w[1:], strict=False))

    units = [set(grams(u)) for u in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n[ \t\n\r]*", text), text]]
    found = [(n, 2 * len(u & t) / (len(u) + len(t))) for n, t in ((n, set(grams(t))) for n, t in TEMPLATES) for u in units if u]
    found = [x for x in found if x[1] >= 0.8]
    runs = []
    b = grams(text)
    for n, template in [*TEMPLATES, *full_texts()]:
        t = set(grams(template))
        longest = math.floor(len(t) * 1.5 + 1e-9) + len(grams(template)) - len(t)
        best = (0.0,)
        for s in [j for j, x in enumerate(b) if x in t] if len(set(b) & t) * 3 >= len(t) * 2 else []:
            seen, own = set(), 0
            for e in range(s, min(s + longest, len(b))):
                if b[e] not in seen:
                    seen.add(b[e])
                    own += b[e] in t
                if b[e] in t:
                    best = max(best, (2 * own / (len(seen) + len(t)), -s, e))
        if best[0] >= 0.8:
            runs.append((n, *best, len(t)))
    named = {n for n, _ in found}
    outer = [r for r in runs if not any(q[0] != r[0] and q[4] > r[4] and -q[2] <= -r[2] and q[3] >= r[3] for q in runs)]
    found += [(r[0], r[1]) for r in outer if r[0] not in named]
    return {n for n, _ in found}, max((d for _, d in found), default=0.0)


def test_licences_by_brute_force(spark):
    """Equal both ways: texts of the corpus, templates with words dropped, and runs inside other text."""
    docs = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(6)
    for _, t in TEMPLATES:
        w = t.split()
        docs += [" ".join(x for x in w if rng.random() > drop) for drop in (0.0, 0.05, 0.12, 0.2)] + [f"{words(30)}\n\n{t}\n\n{words(20)}"]
        docs += [f"{words(40)} {' '.join(x for x in w if rng.random() > drop)} {words(25, 3)}" for drop in (0.05, 0.12, 0.2)]
        docs += [f"{words(20)} {' '.join(w[: len(w) // 2])} {words(len(w) // 2 + 1, 4)} {t} {words(9, 5)} {t}"]
    got = {r["doc_id"]: r for r in licence_scan(docs_of(spark, docs)).collect()}
    for i, d in enumerate(docs):
        want, dice = licences_by_brute_force(d)
        assert (set(filter(None, got[i]["licences"].split(","))), got[i]["dice"]) == (want, pytest.approx(dice, abs=1e-12)), i


def test_long_licences_in_parts(spark):
    """Two copies with other text between, half a licence before a whole one, cuts at both ends, two licences in one text."""
    from spanweave.llm.licence_texts import full_texts

    full = {n: t.split() for n, t in full_texts()}
    docs, want = [], []
    for name in ("CC0-1.0", "Artistic-1.0", "MPL-2.0"):
        w = full[name]
        n, other = len(w), words(len(w), 6)
        gap = " ".join(other.split()[: int(0.7 * n)])
        docs += [" ".join([*w, gap, *w]), " ".join([*w[: n // 2], gap, *w]), " ".join([other, *w[: int(0.74 * n)], other]), " ".join([other, *w[int(0.26 * n) :], other]), " ".join([other, *w[: n // 2], other])]
        want += [(name, 1.0), (name, 1.0), (name, None), (name, None), ("", 0.0)]
    docs.append(" ".join([*full["CC0-1.0"], words(50), *full["GPL-2.0"]]))
    want.append(("CC0-1.0,GPL-2.0", 1.0))
    got = {r["doc_id"]: r for r in licence_scan(docs_of(spark, docs)).collect()}
    for i, (names, dice) in enumerate(want):
        assert got[i]["licences"] == names and (got[i]["dice"] == dice if dice is not None else got[i]["dice"] >= 0.8), (i, got[i])


def test_best_run_by_all_runs():
    """The search of runs against all runs, over rows of few different bigrams."""
    from spanweave.llm.licences import _best_run

    rng = np.random.default_rng(2)
    for _ in range(400):
        row = rng.integers(0, 14, rng.integers(1, 60))
        own = set(rng.choice(14, 6, replace=False).tolist())
        longest = int(rng.integers(9, 16))
        prev = np.array([max((k for k in range(j) if row[k] == row[j]), default=-1) for j in range(len(row))])
        hit = np.array([x in own for x in row.tolist()])
        runs = [(2 * len(own & g) / (len(g) + 6), -s, e) for s in range(len(row)) for e in range(s, min(s + longest, len(row))) if hit[s] and hit[e] for g in [set(row[s : e + 1].tolist())]]
        best = max(runs, default=(0, 0, 0))
        assert _best_run(row, prev, hit, 6, 0.8, longest) == ((best[0], -best[1], best[2]) if best[0] >= 0.8 else None)


def test_secret_base_by_brute_force(spark):
    """Base spans by Python's own expressions, written from the contract."""
    rules = {
        "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    docs = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = np.random.default_rng(9)
    bits = ["PassWord", "token", "api_key", "APIKEY", "secret", '"', "'", " ", " = ", ":", "=", "abc", "AKIA", "Q" * 16, "deadbeef" * 3, "é", "\U0001f600", "\n", "x/y+z", "a" * 24, "AKIA" + "Z" * 20]
    docs += ["".join(rng.choice(bits, 25)) for _ in range(300)]
    got = {r["doc_id"]: r for r in secret_report(docs_of(spark, docs)).collect()}
    for i, d in enumerate(docs):
        spans = [(m.start(), k, m.end(), name) for k, (name, (p, good)) in enumerate(rules.items()) for m in p.finditer(d) if good(m)]
        listed = ",".join(f"{name}:{a}:{z}" for a, _, z, name in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (i, d)
        assert [got[i][f"n_{k}"] for k in rules] == [sum(s[3] == k for s in spans) for k in rules]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    whole, ids, counts = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path(), max_parts=50), Encoder(tokenizer_path(), counts=True)
    rng = np.random.default_rng(2)
    letters = [chr(i) for i in range(256)] + ["İ", "Σ", "́", " ", "　", "K", "ﬁ", "\U0001f600", "‍", "'s", "'ll", "<|endoftext|>", "<|", " ", "the", "Éa"]
    for _ in range(1500):
        t = "".join(rng.choice(letters, rng.integers(0, 25)))
        want = whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids.ids([t.encode()])[0], ids.kind).tolist() == want and sum(counts.numbers(t.encode().split())) == len(want)


def test_encoder_long_text(monkeypatch):
    import spanweave.llm.tokens as T

    whole = T.Encoder(tokenizer_path()).ids([words(3000, 4).encode()])
    monkeypatch.setattr(T, "STEP", 100)
    texts = [words(3000, 4), "", None, "x" * 500, " " * 300]
    assert T.Encoder(tokenizer_path()).ids([t and t.encode() for t in texts])[:3] == [whole[0], b"", b""]
    steps = [list(T._steps((t or "").encode())) for t in texts]
    assert [sum(x, []) for x in steps] == [(t or "").encode().split() for t in texts] and len(steps[0]) > 100
    assert sum(T.Encoder(tokenizer_path(), counts=True).numbers(sum(steps[0], []))) == len(whole[0]) // 2


def check_packing(rows, want, size=2048):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    fill = {}
    for i, rs in by_seq.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        fill[i] = at
    assert sorted(fill) == list(range(len(fill))) and all(v == size for i, v in fill.items() if i < len(fill) - 1)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    d = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    want = {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in d.collect()}
    check_packing(pack(d, tokenizer_path()).collect(), want)
    check_packing(pack(d, tokenizer_path(), size=64, weights={"src0": 3.0, "src1": 1.0}, window=4).collect(), want, 64)


def shares_of_windows(rows, weights, size, window):
    """The largest difference, in sequences, between a window's tokens of a source and the target, over windows in which no source is empty."""
    by_window, left = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        by_window[r["window"]][r["source"]] += r["length"]
        left[r["source"]] += r["length"]
    total, worst, n = sum(weights.values()), 0.0, 0
    for w in sorted(by_window):
        left -= by_window[w]
        if any(left[s] < size for s in weights):
            break
        n += 1
        worst = max([worst, *[abs(by_window[w][s] / size - window * weights[s] / total) for s in weights]])
    return n, worst


def test_packing_windows_hold_targets(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = Q.op6_packing(spark, SF).collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r["source"]] += r["length"]
    n, worst = shares_of_windows(rows, {s: t**0.7 for s, t in tokens.items()}, 2048, 64)
    assert worst < 2
    weights = {s: 1.0 + i % 3 for i, s in enumerate(sorted(tokens))}
    n, worst = shares_of_windows(pack(d, tokenizer_path(), size=64, weights=weights, window=64).collect(), weights, 64, 64)
    assert n > 10 and worst < 2


def test_packing_by_shuffle(spark, monkeypatch):
    """Beyond the bounds of a broadcast, every join by shuffling gives the same pieces."""
    import spanweave.llm.packing as P

    d = spark.read.parquet(f"{SF}/documents.parquet").repartition(3).persist()
    near = sorted(map(tuple, pack(d, tokenizer_path(), size=128).collect()))
    monkeypatch.setattr(P, "sized", lambda small: small.hint("merge"))
    far = pack(d, tokenizer_path(), size=128)
    assert sorted(map(tuple, far.collect())) == near and len(near) > 1000
    d.unpersist()


def test_packing_many_sources(spark):
    """More sources than one task's rows: no queue is shared, and those without weight follow the others."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    d = spark.createDataFrame([(i, words(30, i), "en", f"s{i % 300}", 1) for i in range(900)], DOCS).repartition(6)
    want = {r["doc_id"]: [*whole.encode(r["text"], add_special_tokens=False).ids, 1] for r in d.collect()}
    rows = pack(d, tokenizer_path(), size=32, weights=spark.createDataFrame([("s1", 2.0), ("s2", 1.0), ("s7", 1.0)], "source string, weight double"), window=4).collect()
    check_packing(rows, want, 32)
    full = collections.defaultdict(set)
    for r in rows:
        full[r["sequence_id"]].add(r["source"])
    ends = sum(len(s) > 1 for s in full.values())
    assert ends < len(full) and all(len(full[i]) == 1 for i in range(len(full) - 300 * 32 // 32))
    first = [next(iter(full[i])) for i in range(20)]
    assert first.count("s1") in (9, 10, 11) and set(first) == {"s1", "s2", "s7"}


def test_mixing_rates(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = mix(d, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 250 for r in got) and len(got) == 2
    assert sorted(mix(d).collect()) == sorted(mix(d.repartition(7)).collect())


def test_count_tokens(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: (len((r["text"] or "").encode()), len(whole.encode(r["text"] or "", add_special_tokens=False).ids)) for r in d.collect()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in Q.op8_token_counts(spark, SF).collect()} == want


def test_count_tokens_rare_and_frequent(spark, odd):
    """The same counts whether all, some or no pre-tokens are broadcast."""
    from spanweave.llm.tokens import frequent, pretoken_counts

    texts = [words(200, i) for i in range(30)] + ["same " * 500, "x" * 3000, ("y" * 2000 + " ") * 3, "", None]
    d = docs_of(spark, texts).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    every, some, none = (sorted(map(tuple, count_tokens(d, tokenizer_path(), most_frequent=m).collect()), key=repr) for m in (1 << 20, 40, 0))
    assert every == some == none and len(every) == d.count()
    counts = pretoken_counts(d.select(F.col("text").cast("binary").alias("text")), tokenizer_path())
    assert counts.groupBy("piece").count().where("count > 1").isEmpty()
    least, known = frequent(counts, 40)
    assert 0 < len(known) <= 40 and b"same" in known and counts.where(F.col("n") >= least).where(F.octet_length("piece") <= 1024).count() == len(known)


def test_neighbours_recall(spark):
    got = collections.defaultdict(list)
    for r in Q.op3_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]]
    rows = [(i, x) for i, x in rows if np.isfinite(x).all() and x.any()]
    hits = total = 0
    for i, x in rows:
        if i % 100 == 0:
            best = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in rows if j != i)[:10]
            hits += len({j for _, j in best} & {j for j, _ in got[i]})
            total += len(best)
    assert total and hits / total >= 0.9


def test_neighbours_odd_vectors(spark):
    v = [0.5, 1.0, 2.0]
    rows = [(i, v) for i in range(0, 30)] + [(100, v), (101, None), (102, [0.0] * 3), (103, [float("nan"), 1.0, 1.0]), (104, [None, 1.0, 1.0]), (105, [1.0]), (None, v), (200, [9.0, 9.0, 9.0]), (200, [9.0, 9.0, 9.0]), (103, [float("inf"), 1.0, 1.0])]
    got = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == list(range(1, 11)) and got[100] == list(range(10)) and set(got) == {0, 100, 200}
    assert got[200] == [x for x in (200, *range(9)) for _ in "ab"]  # each of the two rows finds the other


def test_neighbours_stop_in_several_cells(spark):
    """Recall against brute force where the search is partial: 20,000 vectors, cells and blocks of 2000."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got, seen = collections.defaultdict(list), {}
    for r in nearest(d, every=200, block=2000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        seen[r["query_id"]] = r["n_verified"]
    hits = 0
    for i in range(0, 20_000, 200):
        far = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        far[i] = np.inf
        assert len(got[i]) == 10 and all(abs(far[j] - s) < 1e-12 for j, s in got[i]) and got[i] == sorted(got[i], key=lambda p: (p[1], p[0]))
        hits += len(set(np.argsort(far, kind="stable")[:10].tolist()) & {j for j, _ in got[i]})
    share = sum(seen.values()) / len(seen) / len(x)
    assert hits / 1000 >= 0.9 and share < 0.6, (hits / 1000, share)


def test_neighbours_ties_lengths_and_blocks(spark, monkeypatch):
    import spanweave.llm.neighbours as N

    monkeypatch.setattr(N, "CELLS", 2)
    monkeypatch.setattr(N, "QUERIES", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(0, 3, 3)]) for i in range(400)] + [(1000 + i, [1.0, float(i), 1.0, 1.0]) for i in range(30)]
    got = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, block=20, certainty=0.999999).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for i, v in rows:
        if i % 10 == 0 and any(v):
            want = sorted((float(np.linalg.norm(np.array(v) - np.array(u))), j) for j, u in rows if len(u) == len(v) and j != i and any(u))[:10]
            assert [(round(s, 9), j) for s, j in got[i]] == [(round(s, 9), j) for s, j in want]


def test_chi_square():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-2


PAGE = """<html><head><title>T</title></head><body><header class="site">Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap-12 has-sidebar"><div class="post"><h1>Head&amp;line</h1><p>First  para <a href="x">link</a> &lt;b&gt; goes on and on for a while.<p>Second<br>line <b>bold</b></p><div class="ad">Buy</div><ul><li>one<li>two</ul></div>
<aside>Side</aside><form><input><p>Sign up</p></form><div id="comments"><p>Nice post, really a long comment here</p></div></div><script>var x = "<p>no</p>";</script><footer>&copy; me</footer></body></html>"""


def test_html_blocks(spark):
    want = "Head&line\nFirst para link <b> goes on and on for a while.\nSecond\nline bold\none\ntwo"
    assert text_of(PAGE, None) == want
    assert max(scored(PAGE), key=scored(PAGE).get) == "html>body>div.has-sidebar.wrap-#>div.post"
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", PAGE.replace("wrap-12", "wrap-7")), (3, None, None), (4, "x", "plain & text"), (4, "x", "plain & text"), (5, "http://h/5", "")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(1, want), (2, want), (3, ""), (4, "plain & text"), (4, "plain & text"), (5, "")]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_marks_around_the_article():
    body = "<article><h1>Head</h1><p>Long enough to be read.</p><p>E is <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>mc^2</annotation></math>.</p></article>"
    plain = body.replace("article>", "div>")
    want = "Head\nLong enough to be read.\nE is mc2."
    rest = '<div class="related"><article>Card</article></div><div id="comments"><p>A comment</p></div><div class="share">Share</div>'
    for name in ("layout sidebar-right", "side", "share", "skip", "form", "search", "header", "comments"):
        assert text_of(f'<html><body><div class="{name}">{body}</div></body></html>', None) == want
        assert text_of(f'<html><body><p></p><div class="{name}">{plain}</div></body></html>', None) == want
        assert text_of(f'<html><body><main><div id="{name}">{body}</div></main>{rest}<footer>End</footer></body></html>', None) == want
    assert text_of(f"<html><body><form><div class='box'>{body}{rest}</div></form></body></html>", None) == want
    # Marked parts stay out beside an article, however long.
    assert text_of(f"<html><body>{body}<div id='comments'><article>{'A comment. ' * 50}</article></div><div class='related'>{'Other ' * 20}</div></body></html>", None) == want


class ArticleText(html.parser.HTMLParser):
    """By the standard library: the text of article elements, a block for each of the elements that break lines."""

    LINES = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "br", "div", "section", "article", "blockquote", "pre", "table", "tr", "td", "th", "figure", "figcaption", "dl", "dt", "dd", "hr", "header", "footer", "aside", "nav"}
    AWAY = {"script", "style", "nav", "aside", "form", "footer"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.away = 0
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).split()
        self.inside += tag == "article"
        if self.away:
            self.away += tag in ("div", *self.AWAY)
        else:
            self.away = int(tag in self.AWAY or (tag == "div" and bool({"ad", "comments", "related", "share-buttons"} & set(names))))
        if tag in self.LINES:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.away and tag in ("div", *self.AWAY):
            self.away -= 1
        if tag in self.LINES:
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.away:
            self.blocks[-1] += data

    @staticmethod
    def of(page):
        p = ArticleText()
        p.feed(page or "")
        p.close()
        return "\n".join(y for b in p.blocks if (y := " ".join(b.split())))


def test_html_against_the_standard_parser(spark):
    rows = Q.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages) and sum(bool(r["text"]) for r in rows) > 200
    assert [r["page_id"] for r in rows if "<article" in (pages[r["page_id"]] or "") and r["text"] != ArticleText.of(pages[r["page_id"]])] == []


def test_html_of_known_texts(spark):
    """Pages of three hosts made around known articles: the text comes back whole, and nothing else."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(120):
        host = i % 3
        body = [words(int(rng.integers(3, 40)), 1000 + 10 * i + k) for k in range(int(rng.integers(2, 8)))]
        tags = [("p", "blockquote", "li", "h2")[int(rng.integers(0, 4))] for _ in body]
        inner = "".join(f"<{t}{' class=social-history' if k == 1 else ''}>{b} &amp; <b>so</b>\n\ton</{t}>" for k, (t, b) in enumerate(zip(tags, body, strict=True)))
        inner = inner.replace("</h2>", "</h2><div class='ad slot-3'>Buy this now</div>", 1)
        main = (f"<article>{inner}</article>", f"<div class='col wide-{i}'><div class='story body{i}'>{inner}</div></div>", f"<main id=top><div>{inner}</div></main>")[host]
        chrome = f"<nav><ul><li><a href=/a>Home {i}</a></ul></nav><header class=masthead><p>The site</p></header>"
        tail = f"<div class='related-posts'><a href=/x>{words(9, i)}</a></div><div id=comments><p>{words(60, i)}</p></div><form><p>Write to us</p></form><footer>All rights</footer><script>if (a < b) {{ x = '</div>' }}</script>"
        rows.append((i, f"https://host{host}.example/{i}", f"<!doctype html><html><head><title>T</title></head><body>{chrome}{main}<aside><p>{words(30, i)}</p></aside>{tail}</body></html>"))
        want[i] = "\n".join(f"{b} & so on" for b in body)
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_long_and_deep_pages():
    """Time grows with the page: megabytes of open quotes, nesting and closing tags take seconds."""
    began = time.monotonic()
    for page in ('<a x="' * 800_000, "<p a='b " * 600_000, "<div>" * 50_000 + "x" + "</span>" * 50_000, "<b>" * 30_000 + "<p>x</p>" * 30_000, "<script>" * 200_000, "<div " + 'class="a ' * 100_000 + ">x", "<" * 1_000_000, "<article>" * 20_000 + "x"):
        assert isinstance(text_of(page, None), str)
    assert time.monotonic() - began < 40
    assert text_of("<div>" * 300 + "<nav>menu</nav><p>Text</p>", None) == "Text"
    assert text_of("<article><p>Energy is <math><mi>E</mi></math> here <canvas>and</canvas> <object>more</object> words</p></article>", None) == "Energy is E here and more words"
    assert text_of('<p title="a > b">one</p><p title="open>two</p>', None) == "one\ntwo"
    deep = "<div>" * 100 + "<p>Text of the page</p>"
    assert text_of(deep, max(scored(deep), key=scored(deep).get)) == "Text of the page"


def test_html_never_fails():
    for page in ("<", "<p", "</p>", "<a <b>>", "<script>x", "<!-- x", "<p>" * 3000 + "x", "<div>" * 2000 + "y", "a<b & c>d", "\x00<p>\ud800</p>".encode("utf-8", "ignore").decode()):
        assert isinstance(text_of(page, None), str)


def poisson_count(rate, u):
    """The smallest number of copies at which the Poisson distribution exceeds u."""
    p = total = math.exp(-rate)
    k = 0
    while total <= u:
        k += 1
        p *= rate / k
        total += p
        if k > 1000:
            break
    return k


def test_pipeline_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = d.collect()
        before = {r["doc_id"]: r["text"] for r in rows}
        out = stage(spark, d, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = out.collect()
        if name == "quality":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in quality_rules(d).where("kept").collect()}
        if name == "lines":
            ids = sorted(before)
            want = dict(zip(ids, brute_runs([before[k] for k in ids]), strict=True))
            assert {r["doc_id"]: r["text"] for r in after} == {k: v for k, v in want.items() if v.strip() or v == before[k]}
        if name == "near_duplicates":
            ids = sorted(before)
            classes = brute_classes([before[k] for k in ids])
            assert {r["doc_id"] for r in after} == {k for j, k in enumerate(ids) if classes[j][0] == j}
        if name == "mixture":
            n = collections.Counter(r["source"] or "" for r in rows)
            sum_w = sum(v**0.7 for v in n.values())
            copies = collections.Counter()
            for r in rows:
                rate = n[r["source"] or ""] ** 0.7 / sum_w * len(rows) / n[r["source"] or ""]
                u = int(hashlib.md5(f"42:{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
                copies[r["doc_id"]] += poisson_count(rate, u)
            assert collections.Counter(r["doc_id"] for r in after) == +copies and all(before[r["doc_id"]] == r["text"] for r in after)
        if name == "packing":
            whole = Tokenizer.from_file(tokenizer_path())
            want = collections.Counter()
            for r in rows:
                want[r["source"] or ""] += len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1
            got, place = collections.Counter(), set()
            for r in after:
                got[r["source"]] += r["length"]
                place.update((r["sequence_id"], r["offset"] + j) for j in range(r["length"]))
            total = sum(want.values())
            assert got == want and place == {divmod(j, 2048) for j in range(total)}
            chars = collections.Counter()
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
                chars[r["source"] or ""] += r["n_chars"] or 0
            assert shares_of_windows(after, {s: chars[s] ** 0.7 for s in got}, 2048, 64)[1] < 2
        d = out


def test_pipeline_on_empty_and_odd_documents(spark, odd, tmp_path):
    """Each stage takes tables without rows, and rows with nulls, repeats and clashing columns."""
    folder = tmp_path / "sf"
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(folder / "documents.parquet"))
    for d in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, d, str(folder)).collect()
            assert bool(rows) == (d is odd), name
    assert corpus_pipeline.run(spark, str(folder)).agg(F.sum("length")).head()[0] > 0


def test_tables_are_deleted_after_use(spark):
    from spanweave.llm.staging import _WRITTEN, discard, shared_dir, sized, staged

    before = set(_WRITTEN)
    t = staged(spark.range(10), "some")
    path = t._staged_at
    assert path.startswith(shared_dir(spark)) and t.count() == 10
    discard(t, spark.range(1))
    assert set(_WRITTEN) == before and not pathlib.Path(path.removeprefix("file:")).exists()
    wide = spark.range(200).select(F.repeat(F.lit("x"), 2000).alias("x"))
    hinted = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(sized(wide)) and not hinted(sized(wide, max_bytes=100_000)) and not hinted(sized(wide, max_rows=10))
