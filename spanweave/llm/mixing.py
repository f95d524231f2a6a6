"""Mixing sources to target weights: each document is repeated by a hash-seeded Poisson count of its source's rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import let, sized, staged


def uniform(*key) -> F.Column:
    """A number in [0, 1) of 52 bits from the MD5 of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.7, target_rows: int | None = None) -> DataFrame:
    """(_source, rate): the mean number of copies of a document of each source.

    A source's target is its share of target_rows (by default as many as docs has): weights, or without them
    its row count to the power temper. The rate is the target over the count; a source without a weight gets 0.
    """
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, w double")
        weighed = counts.join(given, "_source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    weighed = staged(weighed, "weights")
    all_w, all_n = weighed.agg(F.sum("w"), F.sum("n")).head()
    rows = float(target_rows if target_rows is not None else all_n or 0)
    rate = F.col("w") / F.lit(all_w) * F.lit(rows) / F.col("n") if all_w else F.lit(0.0)
    return weighed.select("_source", rate.alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(_source, rate, steps): steps[k] is the probability of at most k copies; the steps end where it can't be told from 1."""
    spread = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    k = rates.withColumn("k", F.explode(F.sequence(F.lit(0), spread)))
    upto = Window.partitionBy("_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    k = k.withColumn("ln_fact", F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(0.0)).over(upto))
    ln_rate = F.when(F.col("rate") > 0, F.ln("rate")).otherwise(0.0)
    p = F.when(F.col("rate") == 0, F.when(F.col("k") == 0, 1.0).otherwise(0.0)).otherwise(F.exp(F.col("k") * ln_rate - F.col("rate") - F.col("ln_fact")))
    k = k.withColumn("p", F.sum(p).over(upto))
    return k.groupBy("_source", "rate").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("steps"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.7, target_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Copies of docs in a global random order, with rate (double), n_copies and copy (int, from 1), shuffle_key (string).

    A document's count inverts the Poisson distribution of its source's rate at a number hashed from the seed
    and its doc_id: the count doesn't depend on partitions or other rows, and a document with count 0 goes.
    Copies are dealt to partitions by a hash of (seed, doc_id, copy) and sorted by it.

    Nulls: a null source is the source ''; a null doc_id hashes as ''; a null text stays. Rows with equal doc_id
    and source get equal counts. An empty table gives an empty result. Other columns stay; those with the names
    of results are replaced.
    """
    # Few rows a source: by broadcast within a counted bound, by shuffling beyond it.
    steps = poisson_steps(source_rates(docs, weights, temper, target_rows)).withColumnsRenamed({"_source": "__mix_source", "steps": "__mix_steps"})
    steps = sized(staged(steps, "rates"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = docs.drop("rate", "n_copies", "copy", "shuffle_key").withColumn("__mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    number = let(uniform(F.lit(str(seed)), doc), lambda u: F.size(F.filter("__mix_steps", lambda p: p <= u)))
    d = d.join(steps, "__mix_source").withColumn("n_copies", number).where("n_copies > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    d = d.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), doc, F.col("copy").cast("string")))).drop("__mix_source", "__mix_steps")
    return d.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
