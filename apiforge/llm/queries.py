"""Registered queries of the subpackage and their DuckDB SQL (where SQL can state them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (lines, mixing, neardup, packing, pages, quality, repeats, rules, shards, token_counts, topk, trie,
               variants)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


@query("op7_token_counts")
def op7(spark, sf):
    return token_counts.count_tokens(read_table(spark, sf, "documents"))


@query("op9_best_fit_packing")
def op9(spark, sf):
    return packing.pack_documents(read_table(spark, sf, "documents"))


@query("op5_quality_classifier")
def op5(spark, sf):
    return quality.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query("op8_quality_rules")
def op8(spark, sf):
    return rules.judge(read_table(spark, sf, "documents"), rules.trusted_ids(read_table(spark, sf, "labels")))


@query("op3_sharding")
def op3(spark, sf):
    return shards.assign_shards(read_table(spark, sf, "documents"))


#: The same plan in SQL: water level, Pareto ranks, prefix nearest to the open words.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * max(lvl) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
             CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p FROM t),
q AS (SELECT d.doc_id, d.size, p.*, CASE WHEN p.p > 0 THEN u / (1 - u) / (p.p / (1 - p.p)) END AS rank_
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
g AS (SELECT source, rank_, doc_id, sum(size) AS n, any_value(target - whole * source_size) AS room FROM q WHERE p > 0 GROUP BY 1, 2, 3),
c AS (SELECT source, doc_id, 2 * sum(n) OVER (PARTITION BY source ORDER BY rank_, doc_id ROWS UNBOUNDED PRECEDING) - n <= 2 * room AS yes FROM g)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * (q.whole + coalesce(c.yes, false)::BIGINT))::BIGINT AS taken
FROM q LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source AND q.doc_id IS NOT DISTINCT FROM c.doc_id
"""


@query("op6_source_mixing", MIX_SQL)
def op6(spark, sf):
    return mixing.mix(read_table(spark, sf, "documents"))


@query("op10_minhash_near_dedup")
def op10(spark, sf):
    return neardup.near_duplicates(read_table(spark, sf, "documents"))


#: Later copies of shortest runs of 50 words, compared as text.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM d),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT AS w,
             sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
r AS (SELECT x.doc_id, x.i AS a, min(y.i) AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.upto >= x.upto - x.w + 50 GROUP BY 1, 2
      UNION
      SELECT x.doc_id, max(y.i) AS a, x.i AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.upto - y.w + 50 <= x.upto GROUP BY 1, 3),
t AS (SELECT r.doc_id, r.a, r.b, string_agg(c.line, chr(10) ORDER BY c.i) AS body
      FROM r JOIN c ON c.doc_id = r.doc_id AND c.i BETWEEN r.a AND r.b GROUP BY 1, 2, 3),
o AS (SELECT *, min(doc_id * 1000000 + a) OVER (PARTITION BY body) AS origin FROM t),
x AS (SELECT DISTINCT c.doc_id, c.i FROM o JOIN c ON c.doc_id = o.doc_id AND c.i BETWEEN o.a AND o.b
      WHERE o.doc_id * 1000000 + o.a > o.origin),
k AS (SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.i) AS text
      FROM c LEFT JOIN x ON x.doc_id = c.doc_id AND x.i = c.i WHERE x.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.a), 0)::BIGINT AS n_lines, (SELECT count(*) FROM x WHERE x.doc_id = d.doc_id)::BIGINT AS n_deleted,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


@query("op4_line_dedup", LINES_SQL)
def op4(spark, sf):
    return lines.deduped_rows(read_table(spark, sf, "documents"))


TOPK_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::BIGINT AS score
      FROM e q JOIN e r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 20
"""


@query("op2_exact_topk", TOPK_SQL)
def op2(spark, sf):
    return topk.exact_top_k(read_table(spark, sf, "embeddings"), lambda i: i % 20 == 0)


@query("op1_site_style_tree")
def op1(spark, sf):
    return pages.main_text(read_table(spark, sf, "pages"))


#: CRC-32 of the bytes of a text: the table by its rule, then a step a byte.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
  CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab"""


def crc_sql(text: str) -> str:
    """CRC-32 of an SQL text; ``tab`` of ``CRC_TABLE`` in scope."""
    return f"""xor(list_reduce(list_transform(range(len(hex(encode({text}))) // 2),
      lambda j: ('0x' || substr(hex(encode({text})), (2 * j + 1)::INT, 2))::BIGINT),
      lambda c, b: xor(c // 256, tab[(xor(c, b) % 256 + 1)::INT]), 4294967295::BIGINT), 4294967295::BIGINT)"""


#: Every prefix of every rebuilt conversation, grouped; figures of a subtree by its nodes' ancestors.
TRIE_SQL = rf"""
WITH tab AS ({CRC_TABLE}),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
      FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
b AS (SELECT h.conv_id, k, r, x FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND k <= h
      UNION ALL SELECT conv_id, k, r, x FROM h JOIN t USING (conv_id) WHERE k > h),
s AS (SELECT conv_id, coalesce(seq, []) AS seq FROM h LEFT JOIN
        (SELECT conv_id, list([r, x] ORDER BY k) AS seq FROM b GROUP BY 1) USING (conv_id)),
p AS (SELECT conv_id, d, len(seq) = d AS ends, md5(seq[1:d]::VARCHAR || d) AS k, CASE WHEN d > 0 THEN md5(seq[1:d - 1]::VARCHAR || (d - 1)) END AS up,
             CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d][2], '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
      FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
c AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
a AS (SELECT p.k, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.w) AS saved
      FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY 1)
SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (k) LEFT JOIN n o ON o.k = f.up
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark, sf):
    return trie.prefix_trie(read_table(spark, sf, "conversations"))


#: All windows as text, counted.
REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT rid, s, md5(array_to_string(ws[s:s + 34], ' ')) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS s FROM d)),
r AS (SELECT rid, s FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM r),
o AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT o.rid, string_agg(word, ' ' ORDER BY o.i) AS kept, count(*) AS n FROM o LEFT JOIN g ON g.rid = o.rid AND g.i = o.i
      WHERE g.i IS NULL GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""


@query("op12_substring_dedup", REPEATS_SQL)
def op12(spark, sf):
    return repeats.without_repeats(read_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


#: Near words by their common texts with one code point left out, or replaced at a place.
VARIANTS_SQL = rf"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
h AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, tab),
s AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS (SELECT DISTINCT word, n, i, left(word, (i - 1)::INT) AS a, substr(word, (i + 1)::INT) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT p.word, q.word AS near, q.n AS near_n FROM x p JOIN x q ON p.a = q.a AND p.b = q.b AND p.word <> q.word
      UNION SELECT p.word, v.word, v.n FROM x p JOIN v ON v.word = p.a || p.b
      UNION SELECT v.word, p.word, p.n FROM x p JOIN v ON v.word = p.a || p.b),
m AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM e GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
             CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
w(word, root, form) AS (SELECT word, word, form FROM f
      UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON f.word = w.form)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word AND w.form IS NULL
"""


@query("op13_spelling_variants", VARIANTS_SQL)
def op13(spark, sf):
    return variants.variants(read_table(spark, sf, "documents"))
