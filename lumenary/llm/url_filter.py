"""URL filters by a sort-merge range join.

A host becomes its labels in reverse, each ended by a slash, so that a host and all its subdomains are one interval of
keys. Urls are dealt to ranges of keys; a rule goes to every range that its interval meets. Each range is sorted and swept
once: a stack holds the nested rules whose intervals are open, and a url is matched against the paths on the stack.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
#: Split points are taken from about so many keys, a sample; they only even out the ranges.
SAMPLE = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first `://` and the path after it; both empty without `://` or for null."""
    rest = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    """`www.example.org` as `org/example/www/`; a slash can't stand in a host. No host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/")))


def _sweep(batches: Iterable[pd.DataFrame]):
    """Sorted rows of one range: rules (path set, page_key null) before the urls of the same key."""
    stack: list[tuple[str, dict, list]] = []  # key prefix, verdict and rule by path, path lengths from the longest
    for pdf in batches:
        found = []
        for key, kind, host, path, rule, verdict in zip(pdf["key"], pdf["kind"], pdf["host"], pdf["path"], pdf["rule"], pdf["verdict"]):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, lengths = stack[-1]
                paths[path] = (rule, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = None
            for _, paths, lengths in stack:
                for n in lengths:
                    if n <= len(path) and (x := paths.get(path[:n])):
                        if best is None or len(x[0]) > len(best[0]) or len(x[0]) == len(best[0]) and x[0] < best[0]:
                            best = x
                        break
            found.append(best or (None, None))
        urls = pdf[pdf["kind"] == 1]
        yield pd.DataFrame({"page_id": urls["page_id"].astype("Int64"), "host": urls["host"], "path": urls["path"], "rule": [r for r, _ in found], "verdict": [v for _, v in found]})


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """`pages` (page_id, url) judged by `rules` (host, path, verdict): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest rule (host and path
    as one string) wins, then the first by name. Without a rule, `rule` is null and `verdict` the default. Null urls and
    urls without `://` have empty host and path, and no rule fits them. Rows with null rules' hosts or paths are
    ignored; of equal rules the first verdict by name counts. All rows of pages stay, repeated ones and null page_ids too;
    very long urls are judged whole; no pages give no rows, no rules the default; further columns are ignored, whatever
    their names.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = rules.where("host is not null and path is not null and host <> ''").withColumn("host", F.translate("host", upper, upper.lower()))
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    urls = urls.withColumn("key", reversed_key(F.col("host")))
    rules = rules.withColumn("key", reversed_key(F.col("host")))

    # Ranges: split points (key, salt) from a sample; a key of very many urls gets several ranges of its own by the salt.
    salt = F.xxhash64("page_id", "path")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = urls.count()
    sample = urls.sample(min(1.0, 3 * SAMPLE / max(1, total)), 7).select("key", salt.alias("salt")).limit(4 * SAMPLE).collect()
    points = sorted((r["key"], r["salt"]) for r in sample)
    cuts = sorted({points[len(points) * i // n] for i in range(1, n)}) if points else []
    bounds = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        from bisect import bisect_right

        return pd.Series([bisect_right(bounds.value, x) for x in zip(key, salt)], dtype="int32")

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        from bisect import bisect_left, bisect_right

        # The interval of a key: itself and all that it begins.
        return pd.Series([list(range(bisect_left(bounds.value, (k, -(1 << 63))), bisect_right(bounds.value, (k + "\U0010ffff", 0)) + 1)) for k in key])

    a = urls.select(part_of("key", salt).alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    b = rules.select(F.explode(parts_of("key")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    # A task for each range, which begins with the rules that are open there, so the stack never lacks any.
    dealt = a.unionByName(b).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("key", "kind")
    out = dealt.select("key", "kind", "page_id", "host", "path", "rule", "verdict").mapInPandas(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(T.table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


#: By a plain join with the rules.
SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(h, q, v)),
m AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM p JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
