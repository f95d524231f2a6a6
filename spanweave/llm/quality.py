"""Quality rules: word statistics of each text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.staging import discard, let, sized, staged, without

SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _windows(w: Column) -> Column:
    """A 64-bit hash of each three-word window; none where the text is too short for two windows."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, hashes).otherwise(F.array().cast("array<bigint>"))


#: Up to so many repeated windows their starts are looked up one by one, beyond it by sorting all starts; either way finds all.
FEW = 24


def _starts(g: Column, repeated: Column) -> Column:
    """Where the repeated windows start. g: hashes of all windows in order."""
    here = lambda k, j, x: F.coalesce(F.get(k, j)["g"] == x["g"], F.lit(False))
    meet = lambda k: F.filter(k, lambda x, i: here(k, i + 1, x) | F.when(i > 0, here(k, i - 1, x)).otherwise(False))
    sorted_starts = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    looked_up = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())
    return (
        F.when(F.size(repeated) == 0, F.array().cast("array<int>"))
        .when(F.size(repeated) > FEW, let(sorted_starts, lambda k: F.transform(meet(k), lambda x: x["i"])))
        .otherwise(looked_up)
    )


def repeat_words(w: Column) -> Column:
    """How many of the words lie in a three-word window that occurs twice or more.

    Windows are compared by 64-bit hashes; equal ones meet by sorting, so that n words take n log n steps.
    """
    near = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False)))
    covered = lambda i: F.size(F.array_distinct(F.concat(i, F.transform(i, lambda x: x + 1), F.transform(i, lambda x: x + 2))))
    return let(_windows(w), lambda g: let(let(F.sort_array(g), lambda s: F.array_distinct(near(s))), lambda r: let(_starts(g, r), covered))).cast("long")


def _all_normal(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.transform(F.split(plain, "\n"), lambda x: F.trim(x))


def normal_lines(text: Column) -> Column:
    """The lines with a word, as they are hashed: trimmed, inner white space as one space, letters in lower case."""
    return F.array_remove(_all_normal(text), "")


def _hosted(docs: DataFrame, host: str) -> DataFrame:
    return docs.withColumn("__quality_host", F.coalesce(F.col(host).cast("string"), F.lit("")))


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = 20, max_share: float = 0.1) -> DataFrame:
    """(__quality_host, __quality_bad): for each host with some, the hashes of lines above its limit, written.

    The limit of a host is the larger of min_docs and max_share of its distinct documents; a line above it is
    found in more distinct documents. Documents with equal texts on one host count once, so that copies of a
    page don't make its own lines frequent. A host can have at most (lines of a document) / max_share such lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.array_distinct(F.transform(normal_lines(text), lambda x: F.xxhash64(x)))
    d = _hosted(docs, host).select("__quality_host", F.xxhash64(text).alias("_key"), hashes.alias("_lines")).groupBy("__quality_host", "_key").agg(F.first("_lines").alias("_lines"))
    d = staged(d, "host-lines")
    per_line = d.select("__quality_host", F.explode("_lines").alias("h")).groupBy("__quality_host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    per_host = d.groupBy("__quality_host").agg(F.count("*").alias("all_docs"))
    over = per_line.join(sized(staged(per_host, "hosts")), "__quality_host").where(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.col("all_docs")))
    bad = staged(over.groupBy("__quality_host").agg(F.collect_set("h").alias("__quality_bad")), "frequent-lines")
    discard(d)
    return bad


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = 20, max_share: float = 0.1, min_left: float = 0.3, min_words: int = 50) -> DataFrame:
    """docs with the statistics, base_failed, n_words_left, kept and text_left.

    base_failed: fewer than min_words words, or more than half of them in repeated three-word windows.
    n_words_left: words outside the lines that frequent_lines() names for the document's host.
    kept: not base_failed, and at least min_left of the words are left (a depleted document is rejected).
    text_left: text without those lines; the others stay as they are.

    Nulls: a null text is empty (base_failed) and has a null text_left; a null host is the host ''. Repeated rows:
    each row gets its own result. An empty table gives an empty result. Other columns of docs stay as they are;
    those with the names of results, in any case of letters, are replaced.
    """
    # The limits are few rows a host; the join is by broadcast within a counted bound and by shuffling beyond it.
    bad = sized(frequent_lines(docs, host, min_docs, max_share))
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    removed = F.filter(normal_lines(text), lambda x: F.array_contains("__quality_bad", F.xxhash64(x)))
    cut = F.when(F.col("__quality_bad").isNull(), 0).otherwise(F.aggregate(removed, F.lit(0), lambda a, x: a + F.size(F.split(x, " ")))).cast("long")

    def verdict(w: Column, n_words: Column, repeated: Column, left: Column) -> Column:
        failed = (n_words < min_words) | (100 * repeated > 50 * n_words)
        return F.struct(
            n_words.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            left.alias("n_words_left"),
            failed.alias("base_failed"),
            (~failed & (left >= F.lit(min_left) * n_words)).alias("kept"),
        )

    # One expression, so that a filter on kept that Catalyst moves down computes it once a row.
    all_of = let(words(text), lambda w: let(F.size(w).cast("long"), lambda n: let(repeat_words(w), lambda r: let(n - cut, lambda left: verdict(w, n, r, left)))))
    d = _hosted(docs, host).join(bad, "__quality_host", "left").withColumn("__quality", all_of)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_left", "base_failed", "kept"]
    stays = lambda lines: F.filter(F.split(F.col("text"), "\n"), lambda _, i: ~F.array_contains("__quality_bad", F.xxhash64(F.get(lines, i))))
    shorter = F.when(F.col("__quality_bad").isNull(), F.col("text")).otherwise(let(_all_normal(F.col("text")), lambda x: F.array_join(stays(x), "\n")))
    return d.select(*without(docs.columns, [*names, "text_left"]), *[F.col(f"__quality.{c}").alias(c) for c in names], shorter.alias("text_left"))
