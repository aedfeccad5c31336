"""Queries over files, documents, pages, reports and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import text as X
from codelake.operators import corpus as C
from codelake.operators import filters as L
from codelake.operators import joins as J
from codelake.operators import similarity as S
from codelake.operators import vectors as V
from codelake.operators.slices import id_slice
from codelake.session import stored
from codelake.plans.registry import query
from codelake.sources import sinks

MARKERS = ["License", "Apache", "MIT", "@"]
MARK = "License|Apache|MIT|@"
TRIM = "regexp_replace({0}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


# ---- filters ---------------------------------------------------------------------------

@query("src4_filter_files", """
    SELECT path, content FROM files WHERE regexp_matches(lower(path), '(\\.java|\\.yml|pom\\.xml)$')
    AND NOT regexp_matches(lower(path), 'src1/')""", "files")
def _(t):
    return L.filter_files(t.files, [".java", ".yml"], ["src1/"]).select("path", "content")


@query("src8_load_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query("flt5_summary_view", "SELECT project_id, path, doc_id, lang FROM files", "files")
def _(t):
    return L.summary_view(t.files)


@query("flt6_has_marker", f"SELECT path FROM files WHERE regexp_matches(content, '{MARK}')", "files")
def _(t):
    return t.files.filter(X.has_marker(F.col("content"), MARKERS)).select("path")


@query("flt7_is_migratable", "SELECT path FROM files WHERE regexp_matches(lower(path), "
       "'(\\.java|\\.xml|\\.yml|\\.yaml|\\.properties|\\.gradle|\\.gradle\\.kts)$')", "files")
def _(t):
    return t.files.filter(X.is_migratable(F.col("path"))).select("path")


@query("flt8_triage", f"""
    SELECT path, CASE WHEN m AND c THEN 'TO_MIGRATE' ELSE 'UNCHANGED' END AS route,
           CASE WHEN NOT m THEN 'Not a migratable file type' WHEN NOT c THEN 'No marker detected' END AS reason
    FROM (SELECT path, regexp_matches(lower(path), '(\\.java|\\.yml)$') AS m, regexp_matches(content, '{MARK}') AS c FROM files)""",
       "files")
def _(t):
    return L.triage(t.files, MARKERS).select("path", "route", "reason")


ALLOW = [("blog.tionsh.example.net", None), ("ththre.example.com", "/fr/"), ("ththre.example.com", "/en/")]
ALLOW_VALUES = ", ".join(f"('{h}', {'CAST(NULL AS STRING)' if p is None else repr(p)})" for h, p in ALLOW)


def _allow(t):
    return t.spark.sql(f"SELECT * FROM VALUES {ALLOW_VALUES} AS a(host, prefix)")


ALLOW_SQL = f"allow AS (SELECT * FROM (VALUES {ALLOW_VALUES}) AS a(host, prefix))"
SITE_SQL = """site AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS h,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS pth FROM pages)"""
IS_ALLOWED = "EXISTS (SELECT 1 FROM allow a WHERE a.host = h AND (a.prefix IS NULL OR starts_with(pth, a.prefix)))"


@query("flt9_allowed_urls", f"WITH {ALLOW_SQL}, {SITE_SQL} SELECT page_id, url FROM site WHERE {IS_ALLOWED}")
def _(t):
    return L.allowed_urls(t.pages, _allow(t)).select("page_id", "url")


@query("flt11_log_filter", """
    SELECT event_id FROM log_lines WHERE contains(lower(line), 'user') AND contains(lower(line), 'value 1')
    AND NOT contains(lower(line), 'click') AND NOT contains(lower(line), 'value 12')""", "log_lines")
def _(t):
    return L.log_filter(t.log_lines, 'user "value 1" -click -"value 12"').select("event_id")


@query("flt12_level", "SELECT event_id FROM log_lines WHERE regexp_matches(upper(line), '\\[ERROR\\]|ERROR | ERROR')", "log_lines")
def _(t):
    return L.level(t.log_lines, "error").select("event_id")


@query("flt14_prune_corpus", """
    SELECT vec_id, path FROM chunks WHERE NOT (doc_type = 'DOCUMENTATION' AND project_id IS NULL)
    OR path IN (SELECT 'v' || doc_id FROM labels)""", "chunks")
def _(t):
    keep = t.labels.select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("path"))
    return L.prune_corpus(t.chunks, keep).select("vec_id", "path")


# ---- joins -----------------------------------------------------------------------------

# Changed files: the whole file table, with the change type by suffix; the source lacks Spanish files.
CHANGED_SQL = """changed AS (SELECT path, CASE WHEN path LIKE '%.java' THEN 'MODIFIED' WHEN path LIKE '%.yml' THEN 'CREATED'
    WHEN path LIKE '%.txt' THEN 'DELETED' ELSE 'UNCHANGED' END AS change_type, project_id, content, doc_id FROM files)"""


def changed(t):
    p = F.col("path")
    kind = F.when(p.endswith(".java"), "MODIFIED").when(p.endswith(".yml"), "CREATED").when(p.endswith(".txt"), "DELETED").otherwise("UNCHANGED")
    return t.files.select(p.alias("original_path"), p.alias("new_path"), kind.alias("change_type"),
                          F.col("doc_id").alias("ord"), "project_id", "content")


@query("jn1_change_tree", f"""
    WITH {CHANGED_SQL}, src AS (SELECT path FROM files WHERE lang <> 'es')
    SELECT s.path, coalesce(c.change_type, 'UNTOUCHED') AS status FROM src s LEFT JOIN changed c USING (path)
    UNION ALL SELECT path, 'CREATED' FROM changed WHERE change_type = 'CREATED' AND path NOT IN (SELECT path FROM src)""", "files")
def _(t):
    return J.change_tree(t.files.filter(F.col("lang") != "es").select("path"), changed(t))


@query("ag15_change_counts", f"""
    WITH {CHANGED_SQL} SELECT project_id, count(*) FILTER (WHERE change_type = 'MODIFIED') AS "MODIFIED",
    count(*) FILTER (WHERE change_type = 'CREATED') AS "CREATED", count(*) FILTER (WHERE change_type = 'DELETED') AS "DELETED",
    count(*) FILTER (WHERE change_type = 'UNCHANGED') AS "UNCHANGED" FROM changed GROUP BY 1""", "files")
def _(t):
    return J.change_counts(changed(t), ["project_id"])


@query("jn2_enrich_features", """
    SELECT l_orderkey, l_linenumber, 'mode.' || l_returnflag AS feature_id, target,
           coalesce(description, 'Detected mode.' || l_returnflag) AS description
    FROM lineitem LEFT JOIN (VALUES ('mode.A', 'accept', 'Accepted.'), ('mode.R', 'reject', NULL)) AS k(feature_id, target, description)
         ON k.feature_id = 'mode.' || l_returnflag""")
def _(t):
    kb = t.spark.sql("SELECT * FROM VALUES ('mode.A', 'accept', 'Accepted.'), ('mode.R', 'reject', NULL) AS k(feature_id, target, description)")
    features = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("mode."), F.col("l_returnflag")).alias("feature_id"))
    return J.enrich_features(features, kb)


RULES = "(0, 'economy.small.*', 'dep:small', false), (1, 'economy.*', 'dep:economy', false), " \
        "(2, 'promo.red.widget', 'dep:exact', false), (3, 'promo.*', 'dep:promo', true), (4, 'large.*', 'dep:large', false)"
NAMES_SQL = "names AS (SELECT p_partkey, p_brand, lower(p_type) || '.' || replace(p_name, ' ', '.') AS name FROM part)"
LOOKUP_SQL = """hits AS (SELECT name, arg_min(dependency, ord) AS dependency FROM (SELECT DISTINCT name FROM names), rules
    WHERE {0} (CASE WHEN key LIKE '%.*' THEN starts_with(name, left(key, length(key) - 1)) ELSE name = key END) GROUP BY name)"""
RULES_SQL = f"rules AS (SELECT * FROM (VALUES {RULES}) AS r(ord, key, dependency, hybrid_only))"


def _names(t):
    return t.part.select("p_partkey", "p_brand", F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("."))).alias("name"))


def _rules(t):
    return t.spark.sql(f"SELECT * FROM VALUES {RULES} AS r(ord, key, dependency, hybrid_only)")


@query("jn3_prefix_lookup", f"WITH {NAMES_SQL}, {RULES_SQL}, {LOOKUP_SQL.format('NOT hybrid_only AND')} "
       "SELECT p_partkey, name, dependency FROM names LEFT JOIN hits USING (name)")
def _(t):
    return J.prefix_lookup(_names(t), _rules(t), hybrid=False).select("p_partkey", "name", "dependency")


@query("jn4_missing_dependencies", f"""
    WITH {NAMES_SQL}, {RULES_SQL}, {LOOKUP_SQL.format('')},
    need AS (SELECT p_brand AS project_id, dependency, min((printf('p%08d', p_partkey), name)) AS w FROM names JOIN hits USING (name) GROUP BY 1, 2),
    declared AS (SELECT DISTINCT p_brand AS project_id, 'dep:' || lower(p_type) AS dependency FROM part WHERE p_size > 49)
    SELECT project_id, dependency, struct_extract(w, 1) AS path, struct_extract(w, 2) AS name FROM need
    WHERE (project_id, dependency) NOT IN (SELECT (project_id, dependency) FROM declared)""")
def _(t):
    imports = _names(t).select(F.col("p_brand").alias("project_id"), F.format_string("p%08d", "p_partkey").alias("path"), "name")
    declared = t.part.filter(F.col("p_size") > 49).select(F.col("p_brand").alias("project_id"), F.concat(F.lit("dep:"), F.lower("p_type")).alias("dependency")).distinct()
    return J.missing_dependencies(imports, _rules(t), declared, hybrid=True)


@query("jn6_select_context", f"""
    WITH plan AS (SELECT project_id, path FROM files f JOIN labels l USING (doc_id) WHERE quality = 0)
    SELECT path FROM files WHERE project_id NOT IN (SELECT project_id FROM plan) OR path IN (SELECT path FROM plan)
    OR (regexp_matches(lower(path), '(\\.java|\\.yml)$') AND regexp_matches(content, '{MARK}'))""", "files")
def _(t):
    plan = t.files.join(t.labels.filter("quality = 0"), "doc_id").select("project_id", "path")
    return J.select_context(t.files, plan, MARKERS).select("path")


@query("jn13_cache_split", """
    WITH k AS (SELECT path, lang, sha256('migrate|' || path || '|' || content) AS cache_key FROM files)
    SELECT path, cache_key, lang = 'en' AS hit, CASE WHEN lang = 'en' THEN 'cached ' || path END AS result FROM k""", "files")
def _(t):
    english = t.files.filter(F.col("lang") == "en")
    cache = english.select(J.cache_key("migrate", F.col("path"), F.col("content")).alias("cache_key"), F.concat(F.lit("cached "), F.col("path")).alias("result"))
    return J.cache_split(t.files, cache, "migrate").select("path", "cache_key", "hit", "result")


@query("jn15_match_paths", """
    WITH a AS (SELECT DISTINCT path AS p FROM files),
    b AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN regexp_extract(path, '[^/]*$') ELSE 'deep/' || path END AS p FROM files)
    SELECT a.p AS a_path, b.p AS b_path FROM a, b WHERE a.p = b.p OR ends_with(a.p, '/' || b.p) OR ends_with(b.p, '/' || a.p)""", "files")
def _(t):
    a = t.files.select(F.concat(F.lit("/tmp/workspace/"), F.col("path")).alias("path"))
    b = t.files.select(F.when(F.col("lang") == "en", F.substring_index("path", "/", -1))
                       .otherwise(F.replace(F.concat(F.lit("/deep/"), F.col("path")), F.lit("/"), F.lit("\\"))).alias("path"))
    return J.match_paths(a, b)


SIG_SQL = """
    u AS (SELECT doc_id AS id, CASE WHEN lang = 'es' THEN '' ELSE lang END AS version,
            list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))) AS sig FROM documents),
    tok AS (SELECT id, version, len(sig) AS n, unnest(sig) AS token FROM u),
    pair AS (SELECT a.id, b.id AS match_id, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM tok a JOIN tok b ON a.token = b.token
             AND a.id <> b.id AND (a.version = '' OR b.version = '' OR a.version = b.version)
             AND b.n >= 0.85 * a.n - 1e-9 AND a.n >= 0.85 * b.n - 1e-9 GROUP BY 1, 2)"""


@query("jn8_similar_plans", f"""
    WITH {SIG_SQL}
    SELECT id, match_id, CAST(c AS DOUBLE) / (na + nb - c) AS score FROM pair WHERE CAST(c AS DOUBLE) / (na + nb - c) >= 0.85
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(c AS DOUBLE) / (na + nb - c) DESC, match_id) = 1""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("version"),
                              F.split(F.lower("text"), "[ \\t\\n\\x0B\\f\\r]+", -1).alias("sig"))
    return S.similar_plans(docs, docs, 0.85, skip_self=True)


# Query vectors: the mean vector of every label (one per class of the table).
QUERIES_SQL = """
    qd AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, generate_series(1, 64) AS g(i) GROUP BY 1, 2),
    q AS (SELECT label AS query_id, list(v ORDER BY i) AS qv FROM qd GROUP BY 1)"""


def _queries(t):
    return (
        t.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
        .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("e"))
        .select(F.col("label").alias("query_id"), F.transform("e", lambda x: x["v"]).alias("embedding"))
    )


NLIST = 16


def _cells(t):
    """The stored index of all chunks: written once, searched by every query of the session."""
    return stored(t.spark, "cells", f"{t.folder}/embeddings.parquet", lambda: V.build_cells(t.chunks, NLIST))


TOPK_SQL = """hits AS (SELECT query_id, vec_id, path, row_number() OVER (PARTITION BY query_id
      ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) DESC, vec_id) AS rank FROM q, chunks WHERE {0} QUALIFY rank <= {1})"""


@query("jn9_vector_topk", f"""WITH {QUERIES_SQL}, {TOPK_SQL.format("doc_type IN ('DOCUMENTATION', 'SOURCE_CODE') AND (project_id IS NULL OR project_id = 'p1')", 10)}
    SELECT query_id, vec_id, rank FROM hits""", "chunks")
def _(t):
    return V.vector_topk(_queries(t), _cells(t), 10, ["DOCUMENTATION", "SOURCE_CODE"], "p1").select("query_id", "vec_id", "rank")


@query("jn10_ann_topk")
def _(t):
    return V.ann_topk(_queries(t), _cells(t), 10, nlist=NLIST, nprobe=6, types=["DOCUMENTATION", "SOURCE_CODE"], project="p1").select("query_id", "vec_id", "rank")


@query("jn10_ann_all_cells", f"""WITH {QUERIES_SQL}, {TOPK_SQL.format("doc_type IN ('DOCUMENTATION', 'SOURCE_CODE') AND (project_id IS NULL OR project_id = 'p1')", 10)}
    SELECT query_id, vec_id, rank FROM hits""", "chunks")
def _(t):
    """With every cell probed the approximate search is exact."""
    return V.ann_topk(_queries(t), _cells(t), 10, nlist=NLIST, nprobe=NLIST, types=["DOCUMENTATION", "SOURCE_CODE"], project="p1").select("query_id", "vec_id", "rank")


def _sited(t):
    """Chunks with the URL of the page of the same number."""
    return t.chunks.join(t.pages.select(F.col("page_id").alias("vec_id"), F.col("url").alias("source_url")), "vec_id", "left")


@query("jn11_retrieve", f"""WITH {QUERIES_SQL}, {TOPK_SQL.format("doc_type = 'DOCUMENTATION' AND project_id IS NULL", 9)}
    SELECT query_id, h.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r
    FROM hits h LEFT JOIN pages ON page_id = h.vec_id
    WHERE NOT contains(lower(h.path), 'example.com') AND NOT contains(lower(coalesce(url, '')), 'example.com')
    QUALIFY r <= 3""", "chunks")
def _(t):
    return V.retrieve(_queries(t), _sited(t), 3, "example.com", ["DOCUMENTATION"], index=_cells(t)).select("query_id", "vec_id", F.col("rank").alias("r"))


@query("jn12_provenance", f"""WITH {QUERIES_SQL}, {TOPK_SQL.format("doc_type = 'DOCUMENTATION' AND project_id IS NULL", 3)}
    SELECT query_id, string_agg(h.path || '|' || coalesce(url, '') || '|' ||
        CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE coalesce(text, '') END, '#' ORDER BY rank) AS sources
    FROM hits h LEFT JOIN pages ON page_id = h.vec_id LEFT JOIN documents ON doc_id = h.vec_id GROUP BY query_id""", "chunks")
def _(t):
    hits = V.vector_topk(_queries(t), _cells(t), 3, ["DOCUMENTATION"])
    texts = _sited(t).select("vec_id", "path", "source_url").join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    joined = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["path"], s["url"], s["snippet"])), "#")
    return V.provenance(hits, texts).select("query_id", joined.alias("sources"))


# ---- sinks over files ------------------------------------------------------------------

@query("snk1_upsert_chunks", """
    WITH rows AS (SELECT NULLIF(source, 'src0') AS project_id, 'd' || doc_id AS path, lang, text FROM documents),
    t AS (SELECT * FROM rows WHERE lang IN ('en', 'fr')), b AS (SELECT project_id, path, lang, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM rows WHERE lang <> 'es' OR project_id IS NULL)
    SELECT coalesce(t.project_id, b.project_id) AS project_id, coalesce(t.path, b.path) AS path,
           CASE WHEN b.path IS NULL OR t.text = b.text THEN sha256(t.text) ELSE sha256(b.text) END AS content_hash,
           CASE WHEN b.path IS NULL THEN 'kept' WHEN t.path IS NULL THEN 'inserted' WHEN t.text = b.text THEN 'unchanged' ELSE 'updated' END AS action
    FROM t FULL JOIN b ON t.path = b.path AND t.project_id IS NOT DISTINCT FROM b.project_id""")
def _(t):
    rows = t.documents.select(F.nullif(F.col("source"), F.lit("src0")).alias("project_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
                              F.lit(0).alias("chunk_index"), "lang", "text")
    hashed = lambda df: df.withColumn("content_hash", F.sha2("text", 256)).drop("lang")
    target = hashed(rows.filter(F.col("lang").isin("en", "fr")))
    batch = hashed(rows.filter((F.col("lang") != "es") | F.col("project_id").isNull()).withColumn(
        "text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return sinks.upsert_chunks(target, batch).select("project_id", "path", "content_hash", "action")


@query("snk5_to_patch", f"""
    WITH {CHANGED_SQL} SELECT path, 'diff --git a/' || path || ' b/' || path || chr(10) || '--- ' ||
      CASE change_type WHEN 'CREATED' THEN '/dev/null' ELSE 'a/' || path END || chr(10) || '+++ ' ||
      CASE change_type WHEN 'DELETED' THEN '/dev/null' ELSE 'b/' || path END || chr(10) || '@@ -0,0 +1,' || len(str_split(content, chr(10))) || ' @@' || chr(10) ||
      CASE change_type WHEN 'DELETED' THEN '-' ELSE '+' END ||
      replace(content, chr(10), chr(10) || CASE change_type WHEN 'DELETED' THEN '-' ELSE '+' END) || chr(10) || chr(10) AS patch FROM changed""", "files")
def _(t):
    return sinks.to_patch(changed(t)).select(F.col("new_path").alias("path"), "patch")


# ---- sets ------------------------------------------------------------------------------

@query("so1_name_diff", """
    WITH c AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name FROM files),
    r AS (SELECT DISTINCT doc_id || '.java' AS name FROM labels)
    SELECT name, 'extra' AS side FROM (SELECT name FROM c EXCEPT SELECT name FROM r)
    UNION ALL SELECT name, 'missing' FROM (SELECT name FROM r EXCEPT SELECT name FROM c)""", "files")
def _(t):
    return J.name_diff(t.files, t.labels.select(F.concat(F.lit("ref/"), F.col("doc_id").cast("string"), F.lit(".java")).alias("path")))


@query("so2_deny_list", """
    WITH u AS (SELECT 0 AS src, ord, name FROM (VALUES (0, 'ECONOMY.small'), (1, 'LEGACY')) AS g(ord, name)
               UNION ALL SELECT 1, p_partkey, p_type || '.' || split_part(p_name, ' ', 1) FROM part)
    SELECT name, src, ord FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY src, ord) = 1""")
def _(t):
    base = t.spark.sql("SELECT * FROM VALUES (0L, 'ECONOMY.small'), (1L, 'LEGACY') AS g(ord, name)")
    rows = t.part.select(F.col("p_partkey").alias("ord"), F.concat("p_type", F.lit("."), F.substring_index("p_name", " ", 1)).alias("name"))
    return J.deny_list(base, rows)


@query("so3_type_index", """
    WITH h AS (SELECT page_id AS pos, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS fqn FROM pages)
    SELECT regexp_extract(fqn, '[^.]*$') AS simple, fqn FROM h WHERE contains(fqn, '.')
    QUALIFY row_number() OVER (PARTITION BY regexp_extract(fqn, '[^.]*$') ORDER BY pos) = 1""")
def _(t):
    return J.type_index(t.pages.select(F.col("page_id").alias("pos"), F.try_parse_url("url", F.lit("HOST")).alias("fqn")))


@query("so4_merge_lists", """
    WITH w AS (SELECT doc_id, str_split(lower(text), ' ') AS a, str_split(text, ' ') AS b FROM documents),
    e AS (SELECT doc_id, unnest(list_concat(a, b)) AS x, generate_subscripts(list_concat(a, b), 1) AS i FROM w),
    d AS (SELECT doc_id, x, min(i) AS i FROM e GROUP BY 1, 2)
    SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS merged FROM d GROUP BY 1""")
def _(t):
    return t.documents.select("doc_id", F.array_join(J.merge_lists(F.split(F.lower("text"), " ", -1), F.split("text", " ", -1)), " ").alias("merged"))


@query("ag27_dependency_diff", """
    WITH d AS (SELECT source AS project_id, lang, unnest(str_split(text, ' ')) AS dependency FROM documents),
    o AS (SELECT DISTINCT project_id, dependency FROM d WHERE lang IN ('en', 'fr')),
    n AS (SELECT DISTINCT project_id, dependency FROM d WHERE lang IN ('en', 'de')),
    b AS (SELECT project_id FROM o INTERSECT SELECT project_id FROM n)
    SELECT project_id, dependency, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) WHERE project_id IN (FROM b)
    UNION ALL SELECT project_id, dependency, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) WHERE project_id IN (FROM b)""")
def _(t):
    d = t.documents.select(F.col("source").alias("project_id"), "lang", F.explode(F.split("text", " ", -1)).alias("dependency"))
    return J.dependency_diff(d.filter(F.col("lang").isin("en", "fr")), d.filter(F.col("lang").isin("en", "de"))).select("project_id", "dependency", "change")
