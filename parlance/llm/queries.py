"""Queries of the training-data operators over their whole tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import parquet
from .decontaminate import contamination
from .divergence import source_divergence
from .html_text import main_text
from .lm_scoring import score_documents
from .media import media_digest
from .near_dedup import near_duplicates
from .pii import find_personal_data
from .prefix_trie import prefix_nodes
from .sentencepiece_codec import encoded
from .sharding import shard_rows
from .suffix_dedup import remove_repeats
from .voronoi_knn import nearest_vectors


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "n_letters", "rejected")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(parquet(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(parquet(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(parquet(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(parquet(spark, sf_dir, "documents"), stable=True)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(parquet(spark, sf_dir, "documents"), shards=40)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(parquet(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(parquet(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(parquet(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(parquet(spark, sf_dir, "embeddings"), k=10)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(parquet(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(parquet(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language, op2_sentencepiece, op3_html, op4_pii, op5_lm_scores, op6_sharding, op7_suffix_dedup, op8_media, op9_near_dedup,
        op10_decontamination, op11_nearest_vectors, op12_source_divergence, op13_prefix_trie,
    )
    return {f.__name__: f for f in every}


#: Words of the decontamination contract.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Shingle sets, links by an inverted index, and the least document that links reach.
_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') || CASE WHEN len(w) < 5 THEN ' ' || len(w) ELSE '' END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY a) m USING (doc_id)"""

#: Windows of 200 bytes (400 hex digits) that occur twice, their runs, and what lies between.
_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, z, len(h) // 2 - 199 - z AS n, substr(h, 2 * z + 1, 1000) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199, 300)) AS z FROM d WHERE len(h) >= 400)),
w AS (SELECT r, z + i AS i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, z, h, unnest(range(0, least(n, 300))) AS i FROM c)),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CAST(i > p + 200 AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i, 1, i) OVER (PARTITION BY r ORDER BY i) AS p FROM m)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
n AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r),
cut AS (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS x, a AS y FROM s UNION ALL SELECT r, max(b), 1000000000 FROM s GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * x + 1, 2 * least(y, len(h) // 2) - 2 * x), '' ORDER BY x) AS h FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""

#: Inner products of every query with every other row.
_NEAREST = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10"""

#: Counts of all kept terms in all groups, absent ones included.
_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, r, unnest(w) AS t FROM d),
k AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, t, count(*) AS n FROM o SEMI JOIN k USING (lang, t) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(s.n, 0) + v.v)::HUGEINT AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, t)),
a AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT a.lang, a.t, 1 + (1000000000 * (a.n + 1)::HUGEINT) // (x.n + v.v)::HUGEINT AS q FROM a JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM s GROUP BY lang) x USING (lang)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL SELECT p.lang, p.source, 'term', p.t, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 200"""

#: CRC-32 of an ASCII string, a bit at a time.
_CRC = (
    "xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT)), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295))"
)

#: Prefixes as lists of digests; a subtree is all that begins with one.
_TRIE = rf"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
             len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'h': h, 'w': w}} ORDER BY turn NULLS FIRST, h) AS t FROM t GROUP BY conv_id),
k AS (SELECT r.conv_id, coalesce(list_slice(b.t, 1, r.n), []) || coalesce(list_slice(r.t, r.n + 1, len(r.t)), []) AS t
      FROM (SELECT *, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS n, conv_id - conv_id % 20 AS base FROM c) r LEFT JOIN c b ON b.conv_id = r.base),
m AS MATERIALIZED (SELECT conv_id, len(t) AS n, d, md5(array_to_string(list_transform(t[1:d], lambda x: x.h), '')) AS p, md5(array_to_string(list_transform(t[1:d - 1], lambda x: x.h), '')) AS above,
             CASE WHEN d = 0 THEN 0 ELSE t[d].w END AS w FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM k)),
n AS MATERIALIZED (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, min(above) AS above, min(w) AS w,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY d, p),
ch AS (SELECT d - 1 AS d, above AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
full_n AS (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch USING (d, p)),
own AS (SELECT DISTINCT x.d AS ad, x.p AS ap, y.d, y.p FROM m x JOIN m y ON x.conv_id = y.conv_id AND y.d >= x.d),
sub AS (SELECT ad AS d, ap AS p, sum(CAST(f.n_children = 0 AS INTEGER)) AS leaves, sum((f.n_convs - 1) * f.w) AS saved FROM own JOIN full_n f ON f.d = own.d AND f.p = own.p GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_n f JOIN sub USING (d, p) LEFT JOIN n u ON u.d = f.d - 1 AND u.p = f.above"""

ORACLES: dict[str, str] = {
    "op11_nearest_vectors": _NEAREST,
    "op12_source_divergence": _DIVERGENCE,
    "op13_prefix_trie": _TRIE,
    "op7_suffix_dedup": _REPEATS,
    "op9_near_dedup": _NEAR,
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
