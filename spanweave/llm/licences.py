"""License scans: normalised text compared to licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.licence_texts import TEMPLATES, full_texts
from spanweave.llm.staging import let

UNITS = ["line", "paragraph", "text", "run"]
_RUNS = "array<struct<dice:double,i:int,size:int,s:int,e:int>>"
_MATCH = "struct<dice:double,template:int,unit:int,pos:int>"


def _template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = _template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams that a text can have to reach the threshold with a template of this size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _unit_words(unit: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), "")


def _matches(unit: Column, kind: int, pos: Column, threshold: float) -> Column:
    """The templates that a unit reaches; those whose size bounds the unit doesn't meet are not compared."""
    sets = [template_bigrams(t) for _, t in TEMPLATES]
    bounds = [size_bounds(len(s), threshold) for s in sets]
    least, most = min(a for a, _ in bounds), max(z for _, z in bounds)
    none = F.array().cast(f"array<{_MATCH}>")

    def compared(g: Column) -> Column:
        def one(i: int) -> Column:
            dice = 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, sets[i])))) / (F.size(g) + len(sets[i]))
            value = F.when(F.size(g).between(*bounds[i]), dice).otherwise(0.0)
            return F.struct(value.alias("dice"), F.lit(i).alias("template"), F.lit(kind).alias("unit"), pos.cast("int").alias("pos"))

        return F.filter(F.array(*[one(i) for i in range(len(sets))]), lambda x: x["dice"] >= threshold)

    def by_words(w: Column) -> Column:
        bigrams = F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, i: F.concat_ws(" ", F.get(w, i), b)))
        # n words have n - 1 bigrams at most, and at least one less than there are distinct words.
        may = (F.size(w) - 1 >= least) & (F.size(F.array_distinct(w)) - 1 <= most)
        return F.when(may, let(bigrams, lambda g: F.when(F.size(g).between(least, most), compared(g)).otherwise(none))).otherwise(none)

    return let(_unit_words(unit), by_words)


def fewest_words(text: str, threshold: float) -> int:
    """How many of a template's words a text must have at least to reach the threshold with it.

    A text lacks at most a third of the template's bigrams (at 0.8). Each missing word but one takes a bigram of its
    own away; and the words that are there, taken from the one in most bigrams on, must be in so many bigrams
    together that no more than those are gone.
    """
    bigrams = template_bigrams(text)
    least, _ = size_bounds(len(bigrams), threshold)
    lacking = len(bigrams) - least
    in_bigrams = Counter(w for b in bigrams for w in set(b.split()))
    open_, heavy = sum(in_bigrams.values()) - 2 * lacking, 0
    for n in sorted(in_bigrams.values(), reverse=True):
        if open_ <= 0:
            break
        open_, heavy = open_ - n, heavy + 1
    return max(len(in_bigrams) - lacking - 1, heavy)


def _listed(values: list[str]) -> Column:
    """An array of literals that have no line breaks, as one."""
    return F.split(F.lit("\n".join(values)), "\n")


def _best_run(row: np.ndarray, prev: np.ndarray, hit: np.ndarray, size: int, threshold: float, longest: int) -> tuple[float, int, int] | None:
    """(dice, start, end) of the best of all runs of at most longest bigrams that start and end at a template's bigram, without bounds.

    The plain form of what _best_of finds in SQL functions, for tests.

    prev: where each bigram was last before. A bigram counts for the runs that start behind its last place, so each
    end adds 1 to the distinct bigrams of those starts at once. Only stretches in which some run can hold enough of
    the template's bigrams are walked. Ties go to the earlier start, then to the later end.
    """
    least, _ = size_bounds(size, threshold)
    n = len(row)
    at = np.arange(n)
    nxt = np.full(n, n + longest)
    nxt[prev[prev >= 0]] = at[prev >= 0]
    # Distinct bigrams of the template in the window that ends at each place: new ones come, last ones go.
    held = np.cumsum(hit & (at - prev >= longest) | hit & (prev < 0))
    gone = np.cumsum(hit & (nxt - at >= longest))
    held[longest:] -= gone[: max(n - longest, 0)]
    best = None
    full = np.flatnonzero(hit & (held >= least))
    for stretch in np.split(full, np.flatnonzero(np.diff(full) >= longest) + 1) if len(full) else []:
        low = max(int(stretch[0]) - longest + 1, 0)
        starts = low + np.flatnonzero(hit[low : stretch[-1] + 1])
        distinct, own = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        ends = np.arange(low, stretch[-1] + 1)
        to = np.searchsorted(starts, ends, "right")
        since = np.searchsorted(starts, np.maximum(prev[ends] + 1, low))
        first = np.searchsorted(starts, ends - longest + 1)
        for e, a, z, f in zip(ends.tolist(), np.maximum(since, first).tolist(), to.tolist(), first.tolist(), strict=True):
            distinct[a:z] += 1
            if not hit[e]:
                continue
            own[a:z] += 1
            if f < z and own[f] >= least:
                dice = 2.0 * own[f:z] / (distinct[f:z] + size)
                k = int(dice.argmax())
                found = (float(dice[k]), -int(starts[f + k]), e)
                if found[0] >= threshold and (best is None or found > best):
                    best = found
    return best and (best[0], -best[1], best[2])


def _places(words: Column) -> Column:
    """(b, p) of each place of a text: the bigram that begins there, and where the same one was last before (-1: nowhere)."""
    bigrams = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda b, i: F.struct(F.concat_ws(" ", F.get(words, i), b).alias("b"), i.alias("i")))
    last = lambda k, j, x: F.when(F.get(k, j - 1)["b"] == x["b"], F.get(k, j - 1)["i"]).otherwise(-1)
    meet = let(F.sort_array(bigrams), lambda k: F.transform(k, lambda x, j: F.struct(x["i"], x["b"], last(k, j, x).alias("p"))))
    return F.transform(F.sort_array(meet), lambda x: F.struct(x["b"], x["p"]))


#: Starts that are bounded together, and parts into which a template's bigrams are dealt by a hash to look them up.
STARTS, PARTS = 32, 64


def _hits(places: Column, template: Column) -> Column:
    """(i, p, h) of each place; h: whether its bigram is the template's."""
    part = lambda b: F.pmod(F.hash(b), F.lit(PARTS))
    held = F.array_intersect(F.transform(places, lambda x: x["b"]), template)
    parts = let(held, lambda t: F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.filter(t, lambda b: part(b) == k)))
    return let(parts, lambda k: F.transform(places, lambda x, i: F.struct(i.alias("i"), x["p"], F.array_contains(F.get(k, part(x["b"])), x["b"]).alias("h"))))


def _distinct_of(hits: Column, start: Column, length: Column) -> Column:
    """The places from start on, at most length of them, whose bigrams a run from start hasn't had before."""
    return F.filter(F.slice(hits, start + 1, length), lambda x: x["p"] < start)


def _numbered(first: Column) -> Column:
    """How many distinct bigrams the run to each of the template's first places has."""
    return F.filter(F.transform(first, lambda x, k: F.when(x["h"], k + 1)), lambda k: k.isNotNull())


def _dices(first: Column, size: Column, fewer: Column | None = None) -> Column:
    """The Dice of the run to each of the template's first places; fewer: bounds of it for runs that may have so many bigrams less."""
    distinct = lambda k, j: k if fewer is None else F.greatest(k - fewer, j + 1)
    return F.transform(_numbered(first), lambda k, j: 2.0 * (j + 1) / (distinct(k, j) + size))


def _best_of(hits: Column, t: Column, threshold: float) -> Column:
    """struct(dice, s, e) of the best of all runs that start and end at a template's bigram, null without one; as _best_run.

    A bigram counts for a run from s where it was last before s. A start needs enough of the template's places behind it
    within the longest run. STARTS starts in order share a bound: a run from one of them has no more of the template's
    bigrams than the run from the first of them, and lacks at most as many others as lie between. Only those whose
    bound reaches the threshold and the first start of the highest bound are searched one by one.
    """
    longest, size = t["longest"], t["size"]
    own = F.filter(F.transform(hits, lambda x: F.when(x["h"], x["i"])), lambda i: i.isNotNull())
    starts = let(own, lambda o: F.filter(o, lambda i, j: F.get(o, j + t["least"] - 1) < i + longest))
    exact = lambda s: F.array_max(_dices(_distinct_of(hits, s, longest), size))

    def bounded(b: Column) -> Column:
        wide = F.element_at(b, -1) - F.get(b, F.lit(0))
        return let(wide, lambda w: F.struct(F.array_max(_dices(_distinct_of(hits, F.get(b, F.lit(0)), longest + w), size, w)).alias("d"), b.alias("b")))

    def searched(blocks: Column) -> Column:
        least = F.greatest(F.lit(threshold), exact(F.get(F.array_max(blocks)["b"], F.lit(0))))
        left = let(least, lambda d: F.flatten(F.transform(F.filter(blocks, lambda x: x["d"] >= d), lambda x: x["b"])))
        return F.array_max(F.transform(left, lambda s: F.struct(exact(s).alias("d"), (-s).alias("m"))))

    def end_of(d: Column, s: Column) -> Column:
        """The last end whose run has this Dice: the template's last place before the next bigram that is new."""

        def of(first: Column) -> Column:
            last = F.array_max(F.filter(F.transform(_numbered(first), lambda x, j: F.when(2.0 * (j + 1) / (x + size) == d, x)), lambda k: k.isNotNull()))
            here = lambda k: F.filter(F.slice(hits, s + 1, longest), lambda x: x["h"] & F.coalesce(x["i"] < F.get(first, k)["i"], F.lit(True)))
            return let(last, lambda k: F.element_at(here(k), -1)["i"])

        return let(_distinct_of(hits, s, longest), of)

    def found(x: Column) -> Column:
        return F.when(x["d"] >= threshold, F.struct(x["d"].alias("dice"), (-x["m"]).alias("s"), end_of(x["d"], -x["m"]).alias("e")))

    blocks = lambda o: F.transform(F.sequence(F.lit(0), F.size(o) - 1, F.lit(STARTS)), lambda i: bounded(F.slice(o, i + 1, STARTS)))
    return let(starts, lambda o: F.when(F.size(o) > 0, let(let(blocks(o), searched), found)))


def run_search(words: Column, may: Column, threshold: float) -> Column:
    """The best run (dice, i, size, s, e) of each template that a text of these words may hold; null without any."""

    def literal(text: str) -> Column:
        own = template_bigrams(text)
        least, most = size_bounds(len(own), threshold)
        fields = {"v": _listed(own), "size": F.lit(len(own)), "least": F.lit(least), "longest": F.lit(most + len(_template_words(text)) - 1 - len(own))}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    templates = F.array(*[literal(t) for _, t in (*TEMPLATES, *full_texts())])

    def one(places: Column, i: Column) -> Column:
        best = lambda t: let(_hits(places, t["v"]), lambda h: let(_best_of(h, t, threshold), lambda r: F.when(r.isNotNull(), F.struct(r["dice"], i.alias("i"), t["size"], r["s"], r["e"]))))
        return let(F.get(templates, i), best)

    return let(_places(words), lambda x: F.filter(F.transform(may, lambda i: one(x, i)), lambda r: r.isNotNull()))


def _may_hold(words: Column, threshold: float) -> Column:
    """The templates, as numbers, of whose words a text has as many as a run of it needs; null where there are none."""
    every = [*TEMPLATES, *full_texts()]
    by_template = [_template_words(t) for _, t in every]

    def literal(i: int, own: list[str]) -> Column:
        least, _ = size_bounds(len(template_bigrams(every[i][1])), threshold)
        fields = {"v": _listed(sorted(set(own))), "i": F.lit(i), "least": F.lit(least), "need": F.lit(fewest_words(every[i][1], threshold))}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    templates = F.array(*[literal(i, w) for i, w in enumerate(by_template)])
    vocabulary = _listed(sorted({x for w in by_template for x in w}))
    fits = lambda n, k, t: (n > t["least"]) & (F.size(k) >= t["need"]) & (F.size(F.array_intersect(k, t["v"])) >= t["need"])
    may = let(F.array_intersect(words, vocabulary), lambda k: F.transform(F.filter(templates, lambda t: fits(F.size(words), k, t)), lambda t: t["i"]))
    return let(may, lambda m: F.when(F.size(m) > 0, m))


def licence_scan(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, licence, dice, unit, pos, licences, n_matches) for each of docs.

    Compared are every line, every paragraph (lines between blank ones) and the whole text, each in lower case
    with all but ASCII letters and digits as single spaces, as sets of word bigrams; then, for licences that none of
    these reaches, runs of the text's words that begin and end with a template's bigrams (a licence over several
    paragraphs, a notice inside other text, or the whole text of a long licence): every run that is at most as long
    as the size bound and the template's own repetitions allow, for templates of every size. A run inside
    the run of another licence's larger template doesn't count. licences: every licence
    that a unit reaches with a Dice coefficient of at least threshold, sorted and joined by commas. licence,
    dice, unit (line, paragraph, text or run) and pos (its index from 0, a run's
    first word; -1 without a match): the best match; ties go to the earlier
    template, the smaller unit and the earlier place. n_matches: pairs of a unit and a template that match; of runs, the best one of each template.

    Nulls: a null text is empty and has no match (licence null, dice 0); a null doc_id stays null. Each row has
    its result, repeated ones too. An empty table gives an empty result. Nothing is shuffled.

    All of it is SQL functions. Only in texts with enough of a template's words are runs searched.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    each = lambda units, kind: F.flatten(F.transform(units, lambda x, i: _matches(x, kind, i, threshold)))
    lines = each(F.split(text, "\n"), 0)
    paragraphs = each(F.split(text, r"\n[\x20\x09\x0D]*\n[\x20\x09\x0A\x0D]*"), 1)
    names = _listed([n for n, _ in (*TEMPLATES, *full_texts())])
    whole = F.concat(lines, paragraphs, _matches(text, 2, F.lit(0), threshold))
    named = lambda m: F.transform(m, lambda x: F.get(names, x["template"]))
    words = _unit_words(text)
    d = docs.select("doc_id", whole.alias("_units"), let(words, lambda w: let(_may_hold(w, threshold), lambda m: F.when(m.isNotNull(), F.struct(w.alias("words"), m.alias("may"))))).alias("_s"))
    d = d.select("doc_id", "_units", F.coalesce(F.when(F.col("_s").isNotNull(), run_search(F.col("_s.words"), F.col("_s.may"), threshold)), F.array().cast(_RUNS)).alias("_runs"))
    # A licence's template in a run of a larger one's place is part of that one.
    within = lambda x, y: (F.get(names, x["i"]) != F.get(names, y["i"])) & (y["size"] > x["size"]) & (y["s"] <= x["s"]) & (y["e"] >= x["e"])
    outer = F.filter("_runs", lambda x: ~F.exists("_runs", lambda y: within(x, y)))
    runs = F.transform(outer, lambda x: F.struct(x["dice"].alias("dice"), x["i"].alias("template"), F.lit(3).alias("unit"), x["s"].alias("pos")))
    others = let(named(F.col("_units")), lambda n: F.filter(runs, lambda x: ~F.array_contains(n, F.get(names, x["template"]))))
    d = d.select("doc_id", F.concat("_units", others).alias("_m"))
    best = F.get(F.sort_array(F.transform("_m", lambda x: F.struct((-x["dice"]).alias("d"), x["template"], x["unit"], x["pos"]))), F.lit(0))
    d = d.withColumn("_b", best)
    return d.select(
        "doc_id",
        F.get(names, F.col("_b.template")).alias("licence"),
        F.coalesce(-F.col("_b.d"), F.lit(0.0)).alias("dice"),
        F.get(F.array(*map(F.lit, UNITS)), F.col("_b.unit")).alias("unit"),
        F.coalesce(F.col("_b.pos"), F.lit(-1)).alias("pos"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("_m", lambda x: F.get(names, x["template"])))), ",").alias("licences"),
        F.size("_m").cast("long").alias("n_matches"),
    )
