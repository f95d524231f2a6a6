"""Secret scans: credential spans in texts, and weak parts that count only beside the parts that complete them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import let, staged

ID = ["doc_id", "_key"]
#: Fixed: the kinds in the order in which they are listed; the last three are weak.
KINDS = ["assign", "access", "hex", "client", "endpoint", "secret"]
#: Fixed patterns. Of access and hex, a match that is long enough is a maximal run, so the length is in the pattern.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CLIENT = r"""([Uu][Ss][Ee][Rr]|[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
SECRET = r"[A-Za-z0-9+/=_-]{32,}"
#: Code points around a part in which its complements are looked for.
SCOPE = 300

_PART = "struct<kind:int,i:int,gap:int,len:int,value:string>"


def _found(text: Column, kind: str, pattern: str, good=None) -> Column:
    """An array of the pattern's matches, each with the length of the text between it and the one before.

    A match that isn't good stays, with kind null, for the lengths of those after it.
    """
    number = F.lit(KINDS.index(kind))

    def parts(m: Column) -> Column:
        one = lambda g: F.transform(
            m, lambda x, i: F.struct((F.when(good(x), number) if good else number).cast("int").alias("kind"), i.cast("int").alias("i"), F.length(F.get(g, i)).alias("gap"), F.length(x).alias("len"), x.alias("value"))
        )
        return F.when(F.size(m) == 0, F.array().cast(f"array<{_PART}>")).otherwise(let(F.split(text, pattern, -1), one))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), parts)


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, _base, _weak) for each of docs: matches of the strong and of the weak kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{_PART}>")
    access = F.when(F.contains(text, F.lit("AKIA")), _found(text, "access", ACCESS)).otherwise(none)
    assign = _found(text, "assign", ASSIGN, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6)
    mixed = lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]")
    d = docs.select("doc_id", F.xxhash64(text).alias("_key"), access.alias("_access"), _found(text, "client", CLIENT).alias("_client"), F.array(assign, _found(text, "hex", HEX)).alias("_base"), text.alias("_text"))
    # Weak secrets and endpoints matter only where an identifier is.
    some = F.size("_access") + F.size("_client") > 0
    rest = [F.when(some, _found(F.col("_text"), "endpoint", ENDPOINT)).otherwise(none), F.when(some, _found(F.col("_text"), "secret", SECRET, mixed)).otherwise(none)]
    return d.select(*ID, F.filter(F.concat(F.col("_base"), F.array("_access")), lambda x: F.size(x) > 0).alias("_base"), F.filter(F.array("_client", *rest), lambda x: F.size(x) > 0).alias("_weak"))


def _placed(scanned: DataFrame, column: str) -> DataFrame:
    """(doc_id, _key, kind, start, end, value): the good matches with code points from 0, end exclusive."""
    each = scanned.where(F.size(column) > 0).groupBy(*ID).agg(F.first(column).alias("_a"))
    each = each.select(*ID, F.posexplode("_a").alias("_pattern", "_m")).select(*ID, "_pattern", F.inline("_m"))
    upto = Window.partitionBy(*ID, "_pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).where("kind is not null")
    return each.select(*ID, "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value")


def _near(spans: DataFrame, others: DataFrame, scope: int, how: str = "left_semi") -> DataFrame:
    """Spans with (left_semi) or without (left_anti) one of others at most scope code points away.

    An interval join: both sides meet in bins of SCOPE code points of a document, so that a long text's spans
    meet only their neighbours.
    """
    bins = lambda a, z: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(z / SCOPE)))
    o = others.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), bins(F.col("start") - scope, F.col("end") + scope).alias("_bin"))
    s = spans.withColumn("_bin", bins(F.col("start"), F.col("end")))
    meet = s["doc_id"].eqNullSafe(o["_d"]) & (s["_key"] == o["_k"]) & (s["_bin"] == o["_bin"]) & (o["_s"] < s["end"] + scope) & (o["_e"] + scope > s["start"])
    if how == "left_semi":
        return s.join(o, meet, "left_semi").drop("_bin").distinct()
    hit = s.join(o, meet, "left_semi").select(*[F.col(c).alias(f"_{c}_") for c in ("doc_id", "_key", "kind", "start")]).distinct()
    same = spans["doc_id"].eqNullSafe(hit["_doc_id_"]) & (spans["_key"] == hit["__key_"]) & (spans["kind"] == hit["_kind_"]) & (spans["start"] == hit["_start_"])
    return spans.join(hit, same, "left_anti")


def _linked(scanned: DataFrame) -> DataFrame:
    base = staged(_placed(scanned, "_base"), "base-spans")
    weak = staged(_near(_placed(scanned, "_weak"), base, 0, "left_anti"), "weak-spans")
    kind = lambda d, *names: d.where(F.col("kind").isin([KINDS.index(k) for k in names]))
    secrets = kind(base, "assign", "hex").unionByName(kind(weak, "secret"))
    identifiers = kind(base, "access").unionByName(kind(weak, "client"))
    return base.unionByName(_near(kind(weak, "client"), secrets, SCOPE)).unionByName(_near(kind(weak, "secret"), identifiers, SCOPE)).unionByName(_near(_near(kind(weak, "endpoint"), identifiers, SCOPE), secrets, SCOPE))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value): the spans that secret_report counts, one row each."""
    return _linked(staged(_scanned(docs), "scanned")).select("doc_id", F.get(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"), "start", "end", "value")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for each of docs.

    Strong kinds count wherever they are: assign (a keyword, a sign and 6 characters or more), access (AKIA and
    16 or more) and hex (24 or more). Weak kinds count only beside their complements, at most SCOPE code points
    away: a client name with a secret; a long mixed string (secret) with an access or client identifier; an
    endpoint with both. A weak match that overlaps a strong one is left out. spans: kind:start:end of all, by
    start and then kind, joined by commas; positions are code points, end exclusive. base_sha256: of the strong
    ones' list.

    Nulls: a null text is empty; a null doc_id is a document of its own by its text. Rows that agree in doc_id and
    text have equal results. Empty tables give empty results. Other columns are left out.
    """
    scanned = staged(_scanned(docs), "scanned")
    named = lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    listed = lambda a: F.array_join(F.transform(a, named), ",")
    per = _linked(scanned).groupBy(*ID).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_all"))
    per = per.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_all")
    d = scanned.select(*ID).join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    spans = F.coalesce("_all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    number = lambda *kinds: F.size(F.filter(spans, lambda x: x["kind"].isin([KINDS.index(k) for k in kinds]))).cast("long")
    return d.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.filter(spans, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        number(*KINDS[3:]).alias("n_linked"),
    )
