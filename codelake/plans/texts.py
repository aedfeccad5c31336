"""Queries of the text functions and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.functions import text as X
from codelake.operators import corpus as C
from codelake.operators.slices import id_slice
from codelake.plans.corpus import ALLOW_SQL, IS_ALLOWED, MARK, SITE_SQL, _allow
from codelake.plans.registry import query

STRIP = "regexp_replace(regexp_replace({0}, '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '')"
HTML_SQL = STRIP.format(
    "regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, "
    "'(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', ' ', 'g'), "
    "'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \\t\\n\\x0B\\f\\r]{2,}', ' ', 'g')"
)


@query("fn1_html_to_text", f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("fn2_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", X.sha256_hex(F.col("text")).alias("hash"))


KEY_PADS = [bytes(c ^ b for c in b"topsecret".ljust(64, b"\0")).hex() for b in (0x36, 0x5C)]


@query("fn3_signature_ok", f"""
    WITH m AS (SELECT event_id, event_type, sha256(unhex('{KEY_PADS[1]}') || unhex(sha256(unhex('{KEY_PADS[0]}') || encode(props)))) AS mac FROM events),
    h AS (SELECT *, CASE WHEN event_type = 'error' THEN 'sha256=00' || mac ELSE 'sha256=' || mac END AS header FROM m)
    SELECT event_id, event_type, header = 'sha256=' || mac AS valid FROM h""")
def _(t):
    from codelake.sources.messages import signature_ok

    body = F.col("props")
    # Spark has no HMAC, so the headers are signed by the reference formula over SHA-256 pads.
    pad = lambda b: bytes(c ^ b for c in b"topsecret".ljust(64, b"\0")).hex()
    inner = F.sha2(F.concat(F.unhex(F.lit(pad(0x36))), F.encode(body, "UTF-8")), 256)
    mac = F.sha2(F.concat(F.unhex(F.lit(pad(0x5C))), F.unhex(inner)), 256)
    header = F.when(F.col("event_type") == "error", F.concat(F.lit("sha256=00"), mac)).otherwise(F.concat(F.lit("sha256="), mac))
    return t.events.select("event_id", "event_type", signature_ok("topsecret")(body, header).alias("valid"))


@query("fn4_json_slice", "SELECT event_id, props AS sliced FROM events")
def _(t):
    noisy = F.concat(F.lit("Sure, here it is:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return t.events.select("event_id", X.json_slice(noisy).alias("sliced"))


@query("fn5_json_strings", """
    SELECT doc_id, source || '|' || lang AS kept FROM documents""")
def _(t):
    built = F.to_json(F.array(F.col("source"), F.lit(""), F.lit("  "), F.col("lang")))
    return t.documents.select("doc_id", F.array_join(X.json_strings(built), "|").alias("kept"))


@query("fn6_names", """
    WITH h AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host FROM pages)
    SELECT page_id, regexp_extract(host, '[^.]*$') AS simple, host AS owner, host AS raw FROM h""")
def _(t):
    host = F.try_parse_url("url", F.lit("HOST"))
    return t.pages.select(
        "page_id", X.simple_name(host).alias("simple"), X.owner_of(F.concat(host, F.lit("#get/1"))).alias("owner"),
        X.strip_generics(F.concat(host, F.lit("<String>"))).alias("raw"))


@query("fn7_first_sentence", """
    WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '') AS x FROM documents)
    SELECT doc_id, CASE WHEN instr(x, '. ') > 1 THEN left(x, instr(x, '. ')) ELSE x END AS sentence FROM s""")
def _(t):
    return t.documents.select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query("fn8_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS cut FROM documents")
def _(t):
    return t.documents.select("doc_id", X.truncate(F.col("text"), 200).alias("cut"))


@query("fn9_duration_label", """
    WITH s AS (SELECT event_id, value, CAST(floor(value + 0.5) AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN value <= 0 THEN '—' WHEN s < 60 THEN s || 's'
           ELSE (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS label FROM s""")
def _(t):
    return t.events.select("event_id", X.duration_label(F.col("value")).alias("label"))


@query("fn10_csv_cell", """
    SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10))
           THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.csv_cell(F.col("text")).alias("cell"))


@query("fn11_highlight", """
    SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
           '"', '&quot;'), '''', '&#39;'), '(?i)(the|license|a\\.)', '<mark>\\1</mark>', 'g') AS marked FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.highlight(F.col("text"), ["the", " license ", "", "a."]).alias("marked"))


@query("fn12_split_files", """
    SELECT doc_id, 'src/a.java=>' || t || '##src/b.yml=>' || t AS files FROM (
      SELECT doc_id, regexp_replace(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '') AS t FROM documents)""")
def _(t):
    reply = F.concat(
        F.lit("Here you go\n=== FILE: src/a.java ===\nold\n=== FILE: src/b.yml ===\n"), F.col("text"),
        F.lit("\n=====FILE: src/a.java ==\n\n"), F.col("text"), F.lit("\n"))
    parts = F.transform(F.sort_array(X.split_files(reply)), lambda p: F.concat_ws("=>", p["path"], p["body"]))
    return t.documents.select("doc_id", F.array_join(parts, "##").alias("files"))


@query("fn13_strip_fences", """
    SELECT conv_id, turn, regexp_replace(regexp_replace(split_part(CASE WHEN role = 'user' THEN text || chr(10) ELSE text END, '```', 1),
           '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '') AS body FROM conversations""")
def _(t):
    fenced = F.concat(F.lit(" ```java\n"), F.col("text"), F.lit("\n```\nHope it helps"))
    stray = F.concat(F.col("text"), F.lit("\n```\ntail"))
    lead = F.regexp_replace(X.strip_fences(F.when(F.col("role") == "user", fenced).otherwise(stray)), "^\\s+", "")
    return t.conversations.select("conv_id", "turn", lead.alias("body"))


@query("fn13_strip_prose", """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'import a.B;' || chr(10) || text WHEN role = 'assistant' THEN '<a>' || text || '</a>' ELSE text END AS body
    FROM conversations""")
def _(t):
    role = F.col("role")
    path = F.when(role == "user", "A.java").when(role == "assistant", "pom.xml").otherwise("a.yml")
    content = F.when(role == "user", F.concat(F.lit("Sure thing\n\nimport a.B;\n"), F.col("text"))).when(
        role == "assistant", F.concat(F.lit("Sure thing "), F.lit("<a>"), F.col("text"), F.lit("</a>"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", X.strip_prose(content, path).alias("body"))


@query("fn14_javax_to_jakarta")
def _(t):
    """Documents with their words turned into package references."""
    code = F.regexp_replace("text", "\\b([a-z]+) the\\b", "javax.inject.$1 javax.sql.$1")
    return t.documents.select("doc_id", X.javax_to_jakarta(code).alias("rewritten"))


@query("fn15_rewrite", """
    SELECT doc_id, replace(replace(replace(text, 'the ', 'THE '), 'THE and', 'and'), 'ation', 'ation.') AS fixed,
           replace(replace(replace(text, 'the ', 'THE '), 'THE and', 'and'), 'ation', 'ation.') <> text AS changed FROM documents""")
def _(t):
    fixed = X.rewrite(F.col("text"), [("the ", "THE "), ("THE and", "and"), ("ation", "ation.")])
    return t.documents.select("doc_id", fixed.alias("fixed"), (fixed != F.col("text")).alias("changed"))


@query("fn17_token_count", """
    SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS tokens FROM documents""")
def _(t):
    return t.documents.select("doc_id", C.word_count(F.col("text")).alias("tokens"))


# ---- chunking and ingest ---------------------------------------------------------------

CHUNK_SQL = f"""
    p AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\\n+$', ''), '\\n+') AS parts FROM documents
          WHERE {STRIP.format('text')} <> ''),
    f AS (SELECT doc_id, parts, 1 AS i, parts[1] || chr(10) || chr(10) AS buf, CAST(NULL AS VARCHAR) AS done, 0 AS idx FROM p
          UNION ALL
          SELECT doc_id, parts, i + 1,
                 CASE WHEN length(buf) + length(parts[i + 1]) > 800 THEN parts[i + 1] || chr(10) || chr(10) ELSE buf || parts[i + 1] || chr(10) || chr(10) END,
                 CASE WHEN length(buf) + length(parts[i + 1]) > 800 THEN {STRIP.format('buf')} END,
                 CASE WHEN done IS NOT NULL THEN idx + 1 ELSE idx END
          FROM f WHERE i < len(parts)),
    c AS (SELECT doc_id, idx AS chunk_index, done AS chunk_text FROM f WHERE done IS NOT NULL
          UNION ALL SELECT doc_id, CASE WHEN done IS NOT NULL THEN idx + 1 ELSE idx END, {STRIP.format('buf')} FROM f WHERE i = len(parts))"""


@query("cp1_chunk", f"WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, chunk_index, chunk_text, sha256(chunk_text) AS content_hash FROM c")
def _(t):
    return C.chunk(t.documents.select("doc_id", "text"), separator="\n+")


PLAN_SQL = f"""{ALLOW_SQL}, {SITE_SQL},
    plan AS (SELECT page_id AS key, CASE WHEN NOT {IS_ALLOWED} THEN 'disallowed' WHEN page_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'indexed'
             WHEN {HTML_SQL} = '' THEN 'empty' ELSE 'ingest' END AS status FROM site)"""


def _plan(t):
    pages = t.pages.select(F.col("page_id").alias("key"), "url", "html")
    index = t.labels.filter("quality = 0").select(F.col("doc_id").alias("key"))
    return C.ingest_plan(pages, index, _allow(t))


@query("cp2_ingest_plan", f"WITH {PLAN_SQL} SELECT key, status FROM plan")
def _(t):
    return _plan(t).select("key", "status")


@query("cp2_ingest_counts", f"WITH {PLAN_SQL} SELECT status, count(*) AS n FROM plan GROUP BY status")
def _(t):
    return C.ingest_counts(_plan(t))


def _chunk_rows(t):
    return C.chunk(t.documents.select("doc_id", "lang", "text"), separator="\n+")


@query("cp3_to_embed", f"WITH RECURSIVE {CHUNK_SQL} SELECT c.doc_id, chunk_index FROM c JOIN documents d USING (doc_id) WHERE d.lang <> 'en'")
def _(t):
    chunks = _chunk_rows(t)
    index = chunks.filter(F.col("lang") == "en")
    return C.to_embed(chunks, index, ["doc_id", "chunk_index"]).select("doc_id", "chunk_index")


@query("cp3_embed")
def _(t):
    vectors = C.embed(_chunk_rows(t).select("doc_id", "chunk_index", "chunk_text"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("doc_id", "chunk_index", F.size("embedding").alias("dim"), norm.alias("norm2"))


STOPS = ", ".join(f"'{w}'" for w in C.STOP_WORDS)
INDEX_SQL = f"""
    ix AS (SELECT term, session_id, version, count(*) AS tf FROM (
      SELECT session_id, version, unnest(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM reports)
      WHERE term <> '' AND term NOT IN ({STOPS}) GROUP BY 1, 2, 3)"""


def _index(t):
    return C.build_index(t.reports, ["session_id", "version"])


@query("cp5_build_index", f"WITH {INDEX_SQL} SELECT term, session_id, version, tf FROM ix", "reports")
def _(t):
    return _index(t)


@query("cp4_search", f"""
    WITH {INDEX_SQL}, q AS (SELECT * FROM ix WHERE term IN ('le', 'tre')),
    df AS (SELECT term, count(*) AS df FROM q GROUP BY term),
    m AS (SELECT session_id, version, round(sum(tf * ln((SELECT count(*) FROM reports)::DOUBLE / df)), 6) AS rank
          FROM q JOIN df USING (term) GROUP BY 1, 2 HAVING count(*) = 2)
    SELECT session_id, version, rank, (SELECT count(*) FROM m) AS total FROM m ORDER BY rank DESC, version DESC, session_id LIMIT 20""", "reports")
def _(t):
    docs = t.reports.agg(F.count(F.lit(1))).scalar()
    return C.search(_index(t), docs, "The LE, tre!", ["session_id", "version"], "version")


@query("cp6_headline")
def _(t):
    return C.headline(t.reports.filter(F.array_contains(C.terms(F.col("content")), "le")), "le tre").select("session_id", "version", "headline")


# ---- budgets, keywords, prefixes, fingerprints -------------------------------------------

@query("wn6_budget_prefix", """
    WITH w AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents)
    SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM w WHERE used <= 20000""")
def _(t):
    rows = t.documents.select("source", "doc_id", "n_chars")
    return C.budget_prefix(rows, ["source"], ["doc_id"], "n_chars", 20000, id_slice("doc_id")).select("source", "doc_id", "used")


RETRY_SQL = """
    e AS (SELECT project_id, seq, repeat(message || ' ', 20) AS m, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS i FROM findings WHERE severity = 'ERROR'),
    l AS (SELECT project_id, i, i || '. ' || CASE WHEN length(m) > 200 THEN left(m, 200) || '…' ELSE m END || chr(10) AS entry FROM e WHERE i <= 5),
    c AS (SELECT *, sum(len(list_filter(str_split(replace(entry, chr(10), ' '), ' '), lambda w: w <> ''))) OVER (PARTITION BY project_id ORDER BY i) AS used FROM l),
    b AS (SELECT project_id, string_agg(entry, '' ORDER BY i) AS body, count(*) AS inc FROM c WHERE used <= 100 - 7 GROUP BY 1),
    n AS (SELECT project_id, count(*) FILTER (WHERE severity = 'ERROR') AS n FROM findings GROUP BY 1)"""


@query("wn7_retry_context", f"""
    WITH {RETRY_SQL}
    SELECT project_id, CASE WHEN n = 0 THEN '' ELSE 'PREVIOUS ATTEMPT FAILED. Fix these specific issues:' || chr(10) || chr(10) || coalesce(body, '') ||
      CASE WHEN n > coalesce(inc, 0) THEN '… and ' || (n - coalesce(inc, 0)) || ' more issue(s).' || chr(10) ELSE '' END END AS context
    FROM n LEFT JOIN b USING (project_id)""", "findings")
def _(t):
    long = t.findings.withColumn("message", F.repeat(F.concat("message", F.lit(" ")), 20))
    return C.retry_context(long, ["seq"], budget=100)


@query("ud3_retry_context_by_characters", f"""
    WITH {RETRY_SQL.replace("len(list_filter(str_split(replace(entry, chr(10), ' '), ' '), lambda w: w <> ''))", "length(entry)").replace("> 200", "> 60").replace("left(m, 200)", "left(m, 60)").replace("i <= 5", "i <= 8").replace("100 - 7", "500 - 53")}
    SELECT project_id, CASE WHEN n = 0 THEN '' ELSE 'PREVIOUS ATTEMPT FAILED. Fix these specific issues:' || chr(10) || chr(10) || coalesce(body, '') ||
      CASE WHEN n > coalesce(inc, 0) THEN '… and ' || (n - coalesce(inc, 0)) || ' more issue(s).' || chr(10) ELSE '' END END AS context
    FROM n LEFT JOIN b USING (project_id)""", "findings")
def _(t):
    """The counter as an argument: here characters."""
    long = t.findings.withColumn("message", F.repeat(F.concat("message", F.lit(" ")), 20))
    return C.retry_context(long, ["seq"], budget=500, max_failures=8, max_chars=60, counter=F.length)


@query("ag17_log_keywords", """
    WITH k AS (SELECT unnest(regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_.]{3,}')) AS token FROM pages)
    SELECT token, count(*) AS n FROM k WHERE (ends_with(token, '.java') OR regexp_matches(token, '^[a-z]+(\\.[a-z0-9]+){2,}') OR regexp_matches(token, '[a-z][A-Z]'))
    AND NOT regexp_matches(token, '(?i)^(org\\.apache\\.maven|INFO|ERROR|WARNING)') GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 12""")
def _(t):
    return C.log_keywords(t.pages, "url", 12)


HOSTS_SQL = """h AS (SELECT list_aggregate(list_reverse(str_split(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '.')), 'string_agg', '.') AS pkg FROM pages),
    s AS (SELECT pkg, {0} AS grp, str_split(pkg, '.') AS segs FROM h),
    e AS (SELECT grp, min(segs) AS lo, max(segs) AS hi, min(pkg) AS first FROM s GROUP BY grp),
    n AS (SELECT *, len(list_filter(range(1, len(lo) + 1), lambda i: lo[1:i] = hi[1:i])) AS k FROM e)"""


def _hosts(t):
    return t.pages.select(F.array_join(F.reverse(F.split(F.try_parse_url("url", F.lit("HOST")), "\\.", -1)), ".").alias("pkg"))


@query("ag22_common_prefix", f"WITH {HOSTS_SQL.format("split_part(pkg, '.', 1)")} "
       "SELECT grp, array_to_string(lo[1:k], '.') AS prefix FROM n")
def _(t):
    return C.common_prefix(_hosts(t).withColumn("grp", F.substring_index("pkg", ".", 1)), ["grp"], "pkg")


@query("ag22_common_prefix_fallback", f"WITH {HOSTS_SQL.format('length(pkg)')} "
       "SELECT grp, CASE WHEN k = 0 THEN first ELSE array_to_string(lo[1:k], '.') END AS prefix FROM n")
def _(t):
    return C.common_prefix(_hosts(t).withColumn("grp", F.length("pkg").cast("bigint")), ["grp"], "pkg", fallback=True)


@query("ag23_fingerprint", """
    SELECT project_id, sha256(string_agg(path || ':' || content || chr(10), '' ORDER BY path)) AS digest FROM files GROUP BY 1""", "files")
def _(t):
    return C.fingerprint(t.files).select("project_id", "digest")


@query("ag23_fingerprint_tree", """
    WITH b AS (SELECT project_id, left(sha256(path), 3) AS bucket,
                 sha256(string_agg(sha256(path || ':' || content || chr(10)), '' ORDER BY path)) AS h FROM files GROUP BY 1, 2)
    SELECT project_id, sha256(string_agg(h, '' ORDER BY bucket)) AS digest FROM b GROUP BY 1""", "files")
def _(t):
    return C.fingerprint(t.files, flat_limit=0).select("project_id", "digest")


GOLDEN_SQL = f"""
    WITH c AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(content, 'License|@')) AS residue,
                 count(*) FILTER (WHERE regexp_matches(content, 'the')) AS idiom FROM files WHERE path LIKE '%.java' GROUP BY 1),
    s AS (SELECT *, (SELECT count(*) FROM benchmark) AS ref FROM c),
    x AS (SELECT project_id, n, residue, idiom, CAST(1.0 AS DOUBLE) - CAST(residue AS DOUBLE) / n AS cl, CAST(idiom AS DOUBLE) / n AS ad,
                 greatest(CAST(0 AS DOUBLE), CAST(1.0 AS DOUBLE) - CAST(abs(n - ref) AS DOUBLE) / ref) AS st FROM s)
    SELECT project_id, n, residue, idiom, floor(cl * 1000 + 0.5) / 1000 AS cleanliness, floor(st * 1000 + 0.5) / 1000 AS structural,
           floor(ad * 1000 + 0.5) / 1000 AS adoption,
           floor((CAST(0.4 AS DOUBLE) * cl + CAST(0.3 AS DOUBLE) * st + CAST(0.3 AS DOUBLE) * ad) * 1000 + 0.5) / 1000 * 100 AS overall FROM x"""


@query("ag16_golden_score", GOLDEN_SQL, "files")
def _(t):
    ref = t.benchmark.agg(F.count(F.lit(1))).scalar()
    return C.golden_score(t.files, ["project_id"], ref, "License|@", "the")
