"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, jaccard, licenses, mixing, prefixes, quality, simhash, suffix, toxicity, urls, warc
from ._support import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.page_records(table(spark, sf_dir, "pages")))
    return found.select("record_id", "url", "time", "refers_to", "state", *[F.col("headers")[h].alias(h.replace("-", "_")) for h in ("etag", "date", "content-length", "last-modified")])


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file; it must be readable on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op8_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(F.col("toxic")).alias("grade"))
    model = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.score(docs, model, ["doc_id"])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.withColumn("shards", F.transform("pieces", lambda x: x["shard"])).drop("pieces")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_prefix_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.ordered(table(spark, sf_dir, "conversations"))
    most = F.crc32(F.col("conv_id").cast("string")) % 6
    return prefixes.trie(*prefixes.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 100, most, limit=5))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_host_quality": op2_host_quality,
    "op3_bpe_trie": op3_bpe_trie,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_simhash_pigeonring": op5_simhash_pigeonring,
    "op6_prefix_doubling": op6_prefix_doubling,
    "op7_url_rules": op7_url_rules,
    "op8_toxic_severity": op8_toxic_severity,
    "op9_mix_sources": op9_mix_sources,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_refinement": op11_prefix_refinement,
    "op12_filter_audit": op12_filter_audit,
    "op13_grouped_prefix_join": op13_grouped_prefix_join,
}

OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html::VARCHAR, '') AS body, regexp_replace(trim(url), '(?s)#.*$', '') AS u FROM pages),
h AS (SELECT *, regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS head0 FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(head0, '(?i):(80|443)$', '')), '^https://', 'http://'), '^http://www\.', 'http://') AS head,
        substr(u, length(head0) + 1) AS rest FROM h),
c AS (SELECT page_id, body, head, regexp_replace(regexp_extract(rest, '(?s)^([^?]*)', 1), '(?s)/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1), '&'),
            lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|session_?id|sid)(=.*)?$'))) AS q FROM k),
r AS (SELECT page_id, head || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, '"' || md5(body) || '"' AS tag,
        'day ' || (page_id // 1000) AS day, strlen(body)::VARCHAR AS size FROM c),
asked AS (SELECT page_id * 2 + 1 AS record_id, url, page_id + 20000 AS time, CASE WHEN page_id % 10 = 7 THEN NULL ELSE tag END AS tag, day, page_id FROM r),
found AS (SELECT a.record_id, a.url, a.time, a.tag, a.day, a.page_id, arg_max(r, r.page_id) AS x FROM asked a LEFT JOIN r ON a.url = r.url AND r.page_id <= a.time GROUP BY ALL),
judged AS (SELECT *, CASE WHEN x.page_id IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN tag = x.tag THEN 'matched' ELSE 'mismatched' END
        WHEN day = x.day THEN 'matched' ELSE 'mismatched' END AS state FROM found)
SELECT record_id, url, time, state, CASE WHEN state = 'matched' THEN x.page_id * 2 END AS refers_to,
    CASE WHEN state = 'matched' THEN CASE WHEN tag IS NULL THEN x.tag WHEN page_id % 2 = 0 THEN 'W/' || tag ELSE tag END END AS etag,
    CASE WHEN state = 'matched' THEN (page_id + 500)::VARCHAR END AS date, CASE WHEN state = 'matched' THEN x.size END AS content_length,
    CASE WHEN state = 'matched' THEN day END AS last_modified
FROM judged
"""

OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT r, doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, ws FROM w),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM b WHERE len(ws) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
f AS (SELECT b.r, doc_id, source, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM b LEFT JOIN covered USING (r)),
rules AS (SELECT source, unnest([
    {'rule': 'short', 'bad': n_words < 50}, {'rule': 'repeats', 'bad': 100 * n_repeat_words > 50 * n_words},
    {'rule': 'symbols', 'bad': 10 * n_symbols > 5 * n_words}, {'rule': 'word_length', 'bad': word_chars < 2 * n_words OR word_chars > 15 * n_words},
    {'rule': 'lines', 'bad': n_dup_lines * 10 > n_words}]) AS x FROM f),
long AS (SELECT source AS domain, x.rule AS rule, count(*)::DOUBLE AS n, count(*) FILTER (WHERE x.bad)::DOUBLE AS failed FROM rules GROUP BY 1, 2),
total AS (SELECT rule, sum(n) AS docs, count(*) AS domains, sum(failed) / sum(n) AS mean, sum(n * n) AS squares, sum(failed * failed / n) AS scaled FROM long GROUP BY 1),
prior AS (SELECT rule, mean, 1 / least(0.999, greatest(1e-6, ((scaled - docs * mean * mean) - (domains - 1) * mean * (1 - mean))
      / greatest(docs - squares / docs, 1e-9) / greatest(mean * (1 - mean), 1e-12))) - 1 AS strength FROM total),
rates AS (SELECT domain, n, strength, (failed + mean * strength) / (n + strength) AS rate FROM long JOIN prior USING (rule)),
hosts AS (SELECT domain, bool_or(rate - 3 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.6) AS rejected FROM rates GROUP BY 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT rejected AS kept
FROM f JOIN hosts ON source IS NOT DISTINCT FROM domain
"""

OP7_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id,
        coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT r, h || q AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC, length(h) DESC) AS k
        FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fit ON p.r = fit.r AND k = 1
"""

OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, list(x ORDER BY i) AS l FROM t GROUP BY c),
-- crc32 of the decimal id: bytes, then eight shifts each, of the polynomial's reversed bits
k AS (SELECT c, l, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
        lambda a, b: list_reduce(range(8), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM v),
r AS (SELECT k.c, list_concat(coalesce(list_slice(o.l, 1, h), []), coalesce(list_slice(k.l, h + 1, len(k.l)), [])) AS l FROM k LEFT JOIN v AS o ON o.c = k.c - k.c % 100),
p AS (SELECT c, d, list_slice(l, 1, d) AS b, d = len(l) AS ends FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT b, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM p GROUP BY b, d),
m AS (SELECT n.*, u.conv_id AS up, CASE WHEN n.d > 0 THEN (n.n - 1) * length(n.b[n.d].text) ELSE 0 END AS own,
        (SELECT count(*) FROM n AS q WHERE q.d = n.d + 1 AND list_slice(q.b, 1, n.d) = n.b) AS kids
      FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.b = list_slice(n.b, 1, n.d - 1)),
s AS (SELECT b, d, count(*) FILTER (WHERE kids = 0) AS leaves, sum(own) AS saved
      FROM (SELECT list_slice(b, 1, e) AS b, e AS d, kids, own FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m)) GROUP BY b, d)
SELECT conv_id, m.d AS depth, up AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ids) AS ends_sha256
FROM m JOIN s ON m.d = s.d AND m.b = s.b
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
g AS (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
      FROM w LEFT JOIN g ON doc_id = id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
x(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
-- the step at which an order removes what fails so: the place of the first of its filters that fails
fall AS (SELECT part, o, fails, n, good, toxic, coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda z: z <> ''), lambda z: strpos(o, z))), 99) AS hit FROM c, o),
s AS (SELECT part, o, step, o[step] AS k, sum(CASE WHEN hit > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN hit < step AND contains(fails, o[step]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = o[step] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
      FROM fall, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY 1, 2, 3)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM s
"""

ORACLE_SQL = {"op1_warc_revisits": OP1_SQL, "op2_host_quality": OP2_SQL, "op7_url_rules": OP7_SQL, "op11_prefix_refinement": OP11_SQL, "op12_filter_audit": OP12_SQL}
