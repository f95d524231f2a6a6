"""The queries that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.byte_pairs import decode, encode
from spanweave.llm.hard_negatives import hard_negatives
from spanweave.llm.html_text import extract_text
from spanweave.llm.jaccard import jaccard_classes
from spanweave.llm.licence_texts import TEMPLATES
from spanweave.llm.licences import licence_scan, template_bigrams
from spanweave.llm.line_dedup import line_dedup
from spanweave.llm.mixing import mix
from spanweave.llm.neighbours import nearest
from spanweave.llm.packing import pack
from spanweave.llm.prefix_trie import prefix_trie
from spanweave.llm.quality import quality_rules
from spanweave.llm.secrets import ACCESS, ASSIGN, CLIENT, ENDPOINT, HEX, SECRET, secret_report
from spanweave.llm.tokens import count_tokens, tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    """Matches with positions by splitting at each pattern, then the linking as joins within a document."""
    quoted = lambda p: p.replace("'", "''")
    kinds = [(0, ASSIGN, f"length(regexp_extract(m, '{quoted(ASSIGN)}', 2)) >= 6"), (1, ACCESS, "true"), (2, HEX, "true"), (3, CLIENT, "true"), (4, ENDPOINT, "true"), (5, SECRET, "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")]
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS kind, good, e - length(m) AS a, e AS z FROM (
              SELECT doc_id, m, ({good}) AS good, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
                SELECT doc_id, i, ms[i] AS m, gs[i] AS g FROM (
                  SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
                    SELECT doc_id, regexp_extract_all(text, '{quoted(p)}') AS ms, regexp_split_to_array(text, '{quoted(p)}') AS gs FROM documents))))"""
        for k, p, good in kinds
    )
    near = lambda kinds, scope: f"EXISTS (SELECT 1 FROM s o WHERE o.doc_id = w.doc_id AND o.kind IN {kinds} AND o.a < w.z + {scope} AND o.z + {scope} > w.a)"
    return f"""
WITH s0 AS (SELECT doc_id, kind, a, z FROM ({each}) WHERE good),
s AS (SELECT * FROM s0 w WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM s0 o WHERE o.doc_id = w.doc_id AND o.kind < 3 AND o.a < w.z AND o.z > w.a)),
l AS (SELECT * FROM s w WHERE kind < 3 OR (kind = 3 AND {near('(0, 2, 5)', 300)}) OR (kind = 5 AND {near('(1, 3)', 300)})
        OR (kind = 4 AND {near('(1, 3)', 300)} AND {near('(0, 2, 5)', 300)})),
n AS (SELECT *, ['assign', 'access', 'hex', 'client', 'endpoint', 'secret'][kind + 1] || ':' || a || ':' || z AS name FROM l),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
             count(*) FILTER (WHERE kind > 2) AS n_linked, string_agg(name, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY a, kind) AS spans
      FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM documents d LEFT JOIN g USING (doc_id)
"""


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
             list_filter(list_transform(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
      FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
u AS (SELECT host, t, any_value(lines) AS lines FROM w GROUP BY host, t),
a AS (SELECT host, count(*) AS all_docs FROM u GROUP BY host),
f AS (SELECT host, line, count(*) AS n_docs FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM u) GROUP BY host, line),
bad AS (SELECT f.host, f.line FROM f JOIN a USING (host) WHERE n_docs > greatest(20, 0.1 * all_docs)),
cut AS (SELECT l.doc_id, sum(len(string_split(l.line, ' ')))::BIGINT AS n
        FROM (SELECT doc_id, host, unnest(lines) AS line FROM w) l JOIN bad USING (host, line) GROUP BY l.doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
             coalesce(n.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(cut.n, 0))::BIGINT AS n_words_left
      FROM w LEFT JOIN n USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 0.3 * n_words AS kept FROM s
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines")


OP1_SQL = r"""
WITH l AS (SELECT doc_id, t.i - 1 AS pos, string_split(text, chr(10))[t.i] AS raw
           FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)),
n AS (SELECT doc_id, pos, trim(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(n) OVER (PARTITION BY doc_id) AS total
      FROM (SELECT *, len(string_split(line, ' ')) AS n FROM n WHERE line <> '')),
p AS (SELECT *, e - n AS p FROM c),
f AS (SELECT doc_id, p, total, pos AS a, max(pos) OVER w AS b, md5(string_agg(line, chr(10)) OVER w) AS run
      FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
g AS (SELECT doc_id, e, min(pos) OVER w AS a, pos AS b, md5(string_agg(line, chr(10)) OVER w) AS run
      FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT doc_id, a, b, run FROM f WHERE total - p >= 50 UNION ALL SELECT doc_id, a, b, run FROM g WHERE e >= 50),
k AS (SELECT *, min((doc_id, a)) OVER (PARTITION BY run) AS first_place FROM r),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM k WHERE (doc_id, a) <> first_place),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed_lines,
             coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS text
      FROM l LEFT JOIN x USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, text, n_lines, n_removed_lines FROM o UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', {template_bigrams(t)!r})" for i, (n, t) in enumerate(TEMPLATES))
    return rf"""
WITH t(template, licence, t) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
l AS (SELECT doc_id, string_split(x, chr(10)) AS p FROM d),
p AS (SELECT doc_id, regexp_split_to_array(x, '
[ 	
]*
[ 	

]*') AS p FROM d),
u AS (SELECT doc_id, 0 AS unit, i - 1 AS pos, p[i] AS x FROM l, unnest(range(1, len(p) + 1)) AS r(i)
      UNION ALL SELECT doc_id, 1, i - 1, p[i] FROM p, unnest(range(1, len(p) + 1)) AS r(i) UNION ALL SELECT doc_id, 2, 0, x FROM d),
w AS (SELECT doc_id, unit, pos, list_filter(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '') AS w FROM u),
g AS (SELECT doc_id, unit, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, unit, pos, template, licence, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM g, t WHERE len(g) BETWEEN 1 AND 2000),
h AS (SELECT * FROM m WHERE dice >= 0.8),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template, unit, pos) AS k FROM h),
a AS (SELECT doc_id, count(*) AS n_matches, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences FROM h GROUP BY doc_id)
SELECT d.doc_id, b.licence, coalesce(b.dice, 0.0::DOUBLE) AS dice, ['line', 'paragraph', 'text'][b.unit + 1] AS unit, coalesce(b.pos, -1)::INT AS pos,
       coalesce(a.licences, '') AS licences, coalesce(a.n_matches, 0) AS n_matches
FROM d LEFT JOIN b ON d.doc_id = b.doc_id AND b.k = 1 LEFT JOIN a ON d.doc_id = a.doc_id
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return d.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "window")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_copies", "copy", "shuffle_key")


OP7_SQL = r"""
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, pow(n, 0.7) / sum(pow(n, 0.7)) OVER () * sum(n) OVER () / n AS rate FROM n),
k AS (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::INT + 1)) AS k FROM r),
p AS (SELECT s, sum(exp(k * ln(rate) - rate - f)) OVER (PARTITION BY s ORDER BY k) AS p
      FROM (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY s ORDER BY k) AS f FROM k)),
c AS (SELECT s, list(p ORDER BY p) AS steps FROM p GROUP BY s),
d AS (SELECT d.*, len(list_filter(steps, lambda p: p <= ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS n_copies
      FROM documents d JOIN c ON coalesce(source, '') = s),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM d)
SELECT doc_id, source, text, n_copies::INT AS n_copies, copy::INT AS copy, md5('42-order:' || doc_id || ':' || copy) AS shuffle_key FROM e
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n,
             xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                             lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295) % 4 AS h
      FROM c GROUP BY conv_id),
t AS (SELECT k.conv_id, c.pos AS depth, role, text FROM k JOIN c ON c.conv_id = k.base AND c.pos <= k.h
      UNION ALL SELECT k.conv_id, least(k.h, coalesce(b.n, 0)) + c.pos - k.h, role, text
                FROM k JOIN c ON c.conv_id = k.conv_id AND c.pos > k.h LEFT JOIN k b ON b.conv_id = k.base),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM t
      UNION ALL SELECT conv_id, 0, 0, 'root' FROM k),
n AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS m, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY node),
u AS (SELECT n.*, a.node AS parent FROM n LEFT JOIN p a ON a.conv_id = n.m AND a.depth = n.depth - 1),
f AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT a.node, count(*) FILTER (WHERE f.node IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens
      FROM u JOIN p a ON a.conv_id = u.m AND a.depth <= u.depth LEFT JOIN f ON f.node = u.node GROUP BY a.node),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT node, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM p JOIN l USING (conv_id, depth) GROUP BY node)
SELECT u.m AS conv_id, u.depth, q.m AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN s ON s.node = u.node LEFT JOIN n q ON q.node = u.parent LEFT JOIN f ON f.node = u.node LEFT JOIN e ON e.node = u.node
"""


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    d = decode(encode(_table(spark, sf_dir, "documents"), path), path)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return d.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform(e, lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives(_table(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), q.alias("q")))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_secret_scans": op2_secret_scans,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_quality_rules": op4_quality_rules,
        "op5_license_scans": op5_license_scans,
        "op6_packing": op6_packing,
        "op7_mixing": op7_mixing,
        "op8_token_counts": op8_token_counts,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_html_extraction": op10_html_extraction,
        "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
        "op12_byte_level_bpe": op12_byte_level_bpe,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op2_secret_scans": _op2_sql(),
        "op4_quality_rules": OP4_SQL,
        "op5_license_scans": _op5_sql(),
        "op7_mixing": OP7_SQL,
        "op11_conversation_prefix_trie": OP11_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
