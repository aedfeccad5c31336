"""URL filters: a trie over reversed host labels and path segments, sent to every task.

A rule is (action, text) with text ``host/path``.  It fits its host and all subdomains
when the url's path starts with the rule's path.  Of the rules that fit, the one with
most host labels wins, then the one with the longest path, then ``block``.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import extended, lower_ascii, output, table, unclashed
from codelake.llm.registry import query

PRODUCTION_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

#: A larger pickled trie isn't broadcast; its rules are joined instead.
MAX_TRIE_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Nested dictionaries: host labels from the right, then whole path segments, then the open rest of a rule.

    A node is [children by label, root of its paths]; a path node is [children by segment,
    {rest: (rule, action)}, lengths of the rests].
    """

    def __init__(self, rules):
        self.root = [{}, None]
        for action, rule in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            host, slash, path = rule.partition("/")
            if not host or not slash:
                raise ValueError(f"a rule needs a host and a path: {rule!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = at = node[1] or [{}, {}, []]
            *whole, rest = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, []])
            if at[1].get(rest, ("", ""))[1] != "block":
                at[1][rest] = (rule, action)
            at[2] = sorted({len(r) for r in at[1]}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The winning (rule, action), or (None, None)."""
        node, open_paths = self.root, []
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1]:
                open_paths.append(node[1])
        if not path.startswith("/"):
            return None, None
        parts = path[1:].split("/")
        for at in reversed(open_paths):
            best = None
            for k, segment in enumerate(parts):
                for n in at[2]:
                    if len(segment) >= n and (hit := at[1].get(segment[:n])):
                        best = hit
                        break
                if k == len(parts) - 1 or (at := at[0].get(segment)) is None:
                    break
            if best:
                return best
        return None, None


def _by_trie(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches):
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield output(batch, batch.schema.names, rule=pa.array([f[0] for f in found], pa.string()), verdict=pa.array([f[1] for f in found], pa.string()))

    return df.mapInArrow(judge, extended(df, "rule string, verdict string"))


def _by_join(df: DataFrame, rules: DataFrame) -> DataFrame:
    """For rule sets beyond any broadcast: host suffixes and path folders of distinct urls meet the rules."""
    cut = rules.select(
        "action", "rule", F.lower(F.substring_index("rule", "/", 1)).alias("rule_host"),
        F.regexp_extract("rule", r"(?s)^[^/]*(/.*)$", 1).alias("rule_path"),
    ).withColumn("folder", F.regexp_extract("rule_path", r"(?s)^(.*/)", 1))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.split("path", "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    urls = df.select("host", "path").distinct().filter(F.col("path").startswith("/"))
    # a url's folders are listed only for the hosts of its that have rules
    hosted = urls.select("*", F.explode(suffixes).alias("rule_host")).join(cut.select("rule_host").distinct(), "rule_host", "left_semi")
    seen = hosted.select("*", F.explode(folders).alias("folder"))
    fits = seen.join(cut, ["rule_host", "folder"]).filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"), F.col("action") == "block")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), rank).alias("b"))
    return df.join(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.action").alias("verdict")), ["host", "path"], "left")


def filter_urls(
    df: DataFrame,
    rules: list[tuple[str, str]] | DataFrame,
    url: str = "url",
    otherwise: str = "allow",
    max_trie_bytes: int = MAX_TRIE_BYTES,
) -> DataFrame:
    """All rows with host, path, rule and verdict; ``otherwise`` is the verdict where no rule fits.

    ``rules`` is a list of (action, rule) or a table (action, rule).  A list becomes a trie
    that is broadcast up to ``max_trie_bytes``; a larger one, and a table, is joined on
    host suffix and folder.  Both give the same rows.

    Null urls and urls without ``://`` have an empty host and path and fit no rule.  A path
    that doesn't start with ``/`` (``http://a.org?q``) is empty and fits no rule either.
    The same rule in both lists blocks.  Repeated rows stay.  Columns of the input named
    host, path, rule or verdict are replaced.
    """
    frame = unclashed(df, ["host", "path", "rule", "verdict"]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        judged = _by_join(frame, rules)
    elif len(pickle.dumps(UrlTrie(rules))) <= max_trie_bytes:
        judged = _by_trie(frame, rules)
    else:
        judged = _by_join(frame, df.sparkSession.createDataFrame(rules, "action string, rule string"))
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))


SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op1_url_filters", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, PRODUCTION_RULES).select("page_id", "host", "path", "rule", "verdict")
