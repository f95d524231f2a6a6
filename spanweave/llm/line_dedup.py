"""Line dedup: winnowed line hashes find runs of lines that an earlier place already has; the later runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import discard, let, sized, staged, without

ID = ["doc_id", "_key"]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, _lines): for each document its lines with a word, in order, as structs.

    pos: the line's index among all lines; h, g: two 64-bit hashes of the line with white space trimmed and joined;
    n: its words. Only hashes and counts are shuffled. Rows that agree in doc_id and text are one document.
    """
    plain = F.regexp_replace(_text(), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    one = lambda x, i: F.struct(i.alias("pos"), F.xxhash64(F.trim(x)).alias("h"), F.xxhash64(F.lit(1), F.trim(x)).alias("g"), (F.length(F.trim(x)) - F.length(F.replace(F.trim(x), F.lit(" "), F.lit(""))) + 1).alias("n"))
    lines = F.filter(F.transform(F.split(plain, "\n"), one), lambda x: x["h"] != F.xxhash64(F.lit("")))
    return docs.select("doc_id", F.xxhash64(_text()).alias("_key"), lines.alias("_lines")).groupBy(*ID).agg(F.first("_lines").alias("_lines"))


def fingerprints(hashed: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, _key, start, end, fp, at): the windows of each document and the line that each selects, as numbers of lines.

    Windows are the shortest runs of at least min_words words that start at a line or end at one. Each selects the
    smallest line hash in it (fp, of line at); neighbouring windows mostly select the same line. Equal windows
    select equal lines, so every repeated run has a fingerprint that occurs again.
    """
    lines = hashed.select(*ID, F.posexplode("_lines").alias("k", "_l")).select(*ID, "k", "_l.h", "_l.n")
    doc = Window.partitionBy(*ID)
    e = F.sum("n").over(doc.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("e", e).withColumn("p", F.col("e") - F.col("n")).withColumn("total", F.sum("n").over(doc))
    ahead = doc.orderBy("p").rangeBetween(0, min_words - 1)
    back = doc.orderBy("e").rangeBetween(1 - min_words, 0)
    of = lambda w: F.struct(F.min("k").over(w).alias("start"), F.max("k").over(w).alias("end"), F.min(F.struct("h", "k")).over(w).alias("m"))
    both = lines.select(*ID, F.when(F.col("total") - F.col("p") >= min_words, of(ahead)).alias("a"), F.when(F.col("e") >= min_words, of(back)).alias("z"))
    each = both.select(*ID, F.explode(F.filter(F.array("a", "z"), lambda x: x.isNotNull())).alias("w"))
    return each.select(*ID, "w.start", "w.end", F.col("w.m.h").alias("fp"), F.col("w.m.k").alias("at"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, _key, start, end): runs of lines, as positions, that occur earlier: in a smaller doc_id or higher up in the document.

    Fingerprints meet by position: a selected line whose hash no other place has selected ends its windows' search.
    Around each that is left, its windows extend the match to both sides: their lines are hashed as a run (two
    64-bit hashes of two hashes of each line), and runs that agree have their first place and later ones. The
    windows of a longer match overlap, so that together they cover all of it.

    Places of a fingerprint are counted before they are shuffled; the table of fingerprints that occur again is
    written, so that it is broadcast within its measured bound and a frequent one's windows are split as a skewed
    join beyond it. Runs are hashed for the windows that are left only.
    """
    hashed = staged(hashed_lines(docs), "lines")
    windows = staged(fingerprints(hashed, min_words), "windows")
    place = F.xxhash64(*ID, "at")
    again = staged(windows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp"), "again")
    left = windows.join(sized(again), "fp", "left_semi").groupBy(*ID).agg(F.collect_set(F.struct("start", "end")).alias("_w"))
    left = staged(left.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_w"), "candidates")
    # A document with candidates meets its lines once; both sides have one row a document.
    both = hashed.join(left, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))

    def run(w: Column) -> Column:
        own = F.slice("_lines", w["start"] + 1, w["end"] - w["start"] + 1)
        hashes = let(own, lambda x: F.struct(F.xxhash64(F.transform(x, lambda y: y["h"])).alias("a"), F.xxhash64(F.transform(x, lambda y: y["g"])).alias("b")))
        return F.struct(F.get("_lines", w["start"])["pos"].alias("start"), F.get("_lines", w["end"])["pos"].alias("end"), hashes.alias("run"))

    found = staged(both.select(*ID, F.explode(F.transform("_w", run)).alias("r")).select(*ID, "r.*"), "runs")
    where = F.struct(*ID, "start")
    first = found.groupBy("run").agg(F.min(where).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = staged(first, "first-places")
    later = found.join(first, "run").where(~where.eqNullSafe(F.col("_first"))).select(*ID, "start", "end")
    discard(hashed, windows, again, left)
    return later


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with text without its later repeated runs, n_lines and n_removed_lines (long).

    A line goes if it lies in a run of whole lines with at least min_words words, all of which occurs earlier:
    in a document with a smaller doc_id or higher up in the same one. Each line that goes so has a copy that
    stays. Lines are compared with white space trimmed and joined, blank lines left out; blank lines inside a
    removed run go with it. Words of a line are separated by white space.

    Nulls: a null text is empty and stays null; a null doc_id comes first in order. Rows that agree in doc_id
    and text are one document and each gets its result; rows with one doc_id and different texts are documents
    ordered by a hash of the text. Empty tables give empty results. Other columns stay as they are; n_lines and
    n_removed_lines of docs, in any case of letters, are replaced.
    """
    gone = repeated_runs(docs, min_words).select(*ID, F.explode(F.sequence("start", "end")).alias("pos"))
    gone = gone.groupBy(*ID).agg(F.collect_set("pos").alias("__dedup_gone"))
    gone = gone.select(F.col("doc_id").alias("__dedup_id"), F.col("_key").alias("__dedup_k"), "__dedup_gone")
    d = docs.withColumn("__dedup_key", F.xxhash64(_text()))
    d = d.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__dedup_id")) & (F.col("__dedup_key") == F.col("__dedup_k")), "left")
    left = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__dedup_gone"))
    shorter = let(F.split(_text(), "\n"), lambda x: F.array_join(F.transform(left(x), lambda i: F.get(x, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(_text(), "\n"))).cast("long")
    return d.select(
        *[F.when(F.col("__dedup_gone").isNull(), F.col("text")).otherwise(shorter).alias(c) if c.lower() == "text" else d[c] for c in without(docs.columns, ["n_lines", "n_removed_lines"])],
        n_lines.alias("n_lines"),
        F.coalesce(F.size("__dedup_gone"), F.lit(0)).cast("long").alias("n_removed_lines"),
    )
