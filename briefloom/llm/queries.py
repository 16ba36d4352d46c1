"""Registered queries of the operators: (spark, sf_dir) -> DataFrame.

Each applies one operator with its production parameters to its whole table;
``ORACLE_SQL`` has the DuckDB twin where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from briefloom.llm import secret_scan, toxicity
from briefloom.llm.ball_tree import ranked_search
from briefloom.llm.common import table
from briefloom.llm.exact_dedup import exact_dedup
from briefloom.llm.hyperminhash import near_copies
from briefloom.llm.jaccard_join import jaccard_components
from briefloom.llm.license_scan import license_scan
from briefloom.llm.line_dedup import line_dedup
from briefloom.llm.mixing import mix

from briefloom.llm.nearest import nearest
from briefloom.llm.packing import best_fit
from briefloom.llm.prefix_trie import conversation_trie
from briefloom.llm.token_trie import token_counts


def op1_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_source_mix(spark, sf_dir):
    return (mix(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_best_fit_packing(spark, sf_dir):
    return best_fit(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return (line_dedup(docs.select("doc_id", "text"))
            .select("doc_id", "lines_dropped", F.length(text).cast("long").alias("n_chars"),
                    F.sha2(text.cast("binary"), 256).alias("text_sha256")))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.digest(*secret_scan.scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op4_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op11_near_copies(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    return conversation_trie(table(spark, sf_dir, "conversations"), conv - conv % 5, head)


def op13_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_exact_dedup, op5_source_mix, op6_toxicity,
                                op7_best_fit_packing, op9_line_dedup, op10_secret_scan, op8_license_scan,
                                op3_token_counts, op4_nearest, op11_near_copies, op12_conversation_trie, op13_ranked_search)}

ORACLE_SQL = {
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM p),
n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * m >= 75 * (na.n + nb.n - m)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT n.doc_id, n.n AS n_shingles, min(r.u) AS component_id
FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
""",
    "op5_source_mix": r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS idx
  FROM d GROUP BY source),
sw AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
              1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
sl AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS share
  FROM sw WINDOW b AS (ORDER BY cap::DOUBLE / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sf AS (SELECT *, cap <= share * w AS is_full FROM sl),
t AS (
  SELECT source, source_size, idx, w, budget,
         CASE WHEN is_full THEN cap::DOUBLE ELSE
           first_value(share) OVER (ORDER BY is_full, cap::DOUBLE / w, idx) * w END AS target
  FROM sf),
q AS (
  SELECT d.doc_id, d.size, d.u, t.idx, t.w, t.source_size, t.target, t.budget,
         sum(d.size) OVER (PARTITION BY t.idx ORDER BY d.u, d.doc_id) AS done
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT q.*, epoch, (done + epoch * source_size)::DOUBLE / w AS finish
  FROM q, (VALUES (0), (1)) AS v(epoch) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, epoch, idx, u, doc_id) AS total FROM e),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken
FROM q LEFT JOIN k USING (doc_id)
""",
    "op11_near_copies": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM p),
n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * m >= 80 * (na.n + nb.n - m)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u)
SELECT n.doc_id, n.n AS n_shingles, min(r.u) AS component_id, min(r.u) = n.doc_id AS kept
FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op12_conversation_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, name, strlen(text)::BIGINT AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, name) - 1 AS pos FROM t),
g AS (SELECT c, count(*) AS n FROM o GROUP BY c),
x AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(
           [4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h
  FROM g),
v AS (SELECT x.c, x.base, x.h, least(x.h, coalesce(b.n, 0)) AS taken FROM x LEFT JOIN g b ON b.c = x.base),
r AS (
  SELECT v.c, o.pos, o.name, o.size FROM v JOIN o ON o.c = v.base AND o.pos < v.h
  UNION ALL
  SELECT v.c, v.taken + o.pos - v.h, o.name, o.size FROM v JOIN o ON o.c = v.c AND o.pos >= v.h),
s AS (SELECT v.c, coalesce(list(r.name ORDER BY r.pos) FILTER (r.name IS NOT NULL), []) AS names,
             coalesce(list(r.size ORDER BY r.pos) FILTER (r.name IS NOT NULL), []) AS sizes
      FROM v LEFT JOIN r ON r.c = v.c GROUP BY v.c),
u AS (SELECT c, names, sizes, unnest(range(0, len(names) + 1)) AS d FROM s),
p AS (SELECT c, d, md5(array_to_string(names[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(names[1:d - 1], ',')) END AS up,
             coalesce(sizes[d], 0) AS size, len(names) = d AS ended FROM u),
n AS (SELECT d, k, any_value(up) AS up, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends FROM p GROUP BY d, k),
q AS (SELECT n.d, n.k, count(m.k) AS n_children FROM n LEFT JOIN n m ON m.d = n.d + 1 AND m.up = n.k GROUP BY n.d, n.k),
b AS (SELECT a.d, a.k, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
      FROM n JOIN q ON q.d = n.d AND q.k = n.k JOIN p a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.d, a.k)
SELECT n.conv_id, n.d::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, q.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN q ON q.d = n.d AND q.k = n.k JOIN b ON b.d = n.d AND b.k = n.k LEFT JOIN n m ON m.d = n.d - 1 AND m.k = n.up
""",
    "op13_ranked_search": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
d AS (SELECT doc_id, len(ws)::BIGINT AS n FROM w WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
f AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS t FROM w) GROUP BY doc_id, t),
x AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY t, docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
      FROM i JOIN x USING (t) JOIN f USING (t) JOIN d USING (doc_id), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""",
}
