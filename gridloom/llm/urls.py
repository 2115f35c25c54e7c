"""URL rules by a sort-merge range join of reversed-host keys.

A url's key is its host's labels in reverse, each with a dot behind it (com.example.www.), so that a rule for a host covers exactly the
keys in the interval from its own key to that key's last extension. Rules and urls are range-sorted together; a sweep over a range keeps
the stack of the rules whose intervals are open. A range starts with the rules still open there, found by joining the prefixes of its
first key (one for each label) with the rules. Of the open rules whose path starts the url's path the longest (characters of host and
path, then of host) wins.

Defined results: a null url, or one without ://, has empty host and path and meets no rule; hosts compare after A-Z are lower-cased;
equal rules of different verdicts block; equal urls are judged alike; an empty table of urls gives an empty result and without rules
every url gets the default verdict; columns of the urls with names used here are kept apart and unchanged.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._support import store

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """One range: rules (kind 0) and urls (kind 1) in key order, with the stack of (key, {path: (rule, verdict)}, path lengths)."""
    rows = rows.sort_values(["key", "kind"], kind="stable")
    stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []
    rules, verdicts = [], []
    for key, kind, path, rule, verdict in zip(rows["key"], rows["kind"], rows["path"], rows["rule"], rows["verdict"], strict=True):
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, set()))
            if stack[-1][1].get(path, ("", ""))[1] != "block":
                stack[-1][1][path] = (rule, verdict)
                stack[-1][2].add(len(path))
        else:
            fits = [(len(hit[0]), len(at), *hit) for at, paths, lengths in stack for n in lengths if n <= len(path) and (hit := paths.get(path[:n]))]
            best = max(fits, default=(0, 0, None, None))
            rules.append(best[2])
            verdicts.append(best[3])
    out = rows[rows["kind"] == 1].drop(columns=["pid", "key", "kind"]).assign(rule=pd.Series(rules, dtype=object).values, verdict=pd.Series(verdicts, dtype=object).values)
    # texts as plain objects: Spark takes no empty column of an Arrow-backed type
    return out.astype({c: object for c in out.columns if isinstance(out[c].dtype, pd.StringDtype)})


def judge(urls: DataFrame, rules: DataFrame | None = None, url: str = "url", keep: list[str] | None = None, default: str = "allow", range_rows: int = 100_000) -> DataFrame:
    """keep (default: all columns of urls), host, path, rule (null where none fits), verdict of each row of urls.

    rules: host, path, verdict ("allow" or "block"); a rule fits its host and all subdomains if the url's path starts with the rule's.
    """
    spark = urls.sparkSession
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if rules is None else rules.select("host", "path", "verdict")
    keep = [c for c in (urls.columns if keep is None else keep) if c.lower() not in ("host", "path", "rule", "verdict")]
    own = {c: f"in_{i}" for i, c in enumerate(keep)}
    host = host_of(F.col(url))
    left = urls.select(*[F.col(c).alias(a) for c, a in own.items()], host.alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(1).alias("kind"), host_key(host).alias("key"))
    lower = F.translate("host", _UPPER, _LOWER)
    right = rules.select(lower.alias("host"), "path", F.concat(lower, "path").alias("rule"), "verdict", F.lit(0).alias("kind"), host_key(lower).alias("key"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), urls.count() // range_rows)
    both = left.unionByName(right, allowMissingColumns=True).repartitionByRange(ranges, "key", "kind", "path", *list(own.values())[:1])
    dealt = store(both.withColumn("pid", F.spark_partition_id()), "urls")
    # a range starts with the rules for its first key's prefixes
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    firsts = dealt.groupBy("pid").agg(F.min("key").alias("key")).select("pid", F.explode(prefixes).alias("key"))
    carried = firsts.join(right, "key")
    swept = dealt.unionByName(carried, allowMissingColumns=True).groupBy("pid").applyInPandas(_sweep, dealt.drop("pid", "key", "kind").schema)
    return swept.select(*[F.col(a).alias(c) for c, a in own.items()], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
