"""The operators of this subpackage as queries over the given tables: production parameters, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, clusters, decontam, fingerprints, html, langid, lm, minhash, packing, quality, repair, urls

#: fixed values of the contract
CHAT_EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
URL_RULES = [("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract_text(pages, html.fit_weights(pages)).select("page_id", "url", "text", "n_chars")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CHAT_EXTRA, "conv_id long, turn long, role string, text string")
    made = chat.conversations_of(spark, chat.linear_messages(rows.unionByName(extra)))
    return chat.digest_rows(made)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urls.host_path_rule(*r) for r in URL_RULES] + [urls.word_rule(w) for w in urls.BLOCKED_WORDS]
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, rules))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontam.SLOP))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.turns_of(table(spark, sf_dir, "conversations"))
    return repair.structure_report(repair.damage(turns)).withColumnRenamed("conv", "conv_id")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_chat_format, op3_minhash, op4_nearest, op5_packing, op6_quality, op7_url_filter, op8_language, op9_lm_scores, op10_decontamination, op11_fingerprints, op12_repair, op13_centroids)
}
_ESC = "replace(replace(replace(replace(coalesce({0}, ''), '\\', '\\\\'), '<', '\\l'), '>', '\\g'), '#', '\\h')"
_BLOCKED = "|".join(urls.BLOCKED_WORDS)


def _repair_sql() -> str:
    """CRC-32 by its table, and a recursion by row; each state is its cost in nine digits and its audit, so that least() compares both."""

    def way(state: int, cost: str, label: str, where: str) -> str:
        return f"CASE WHEN {where} THEN lpad(CAST(CAST(left(v{state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr(v{state}, 10) || '{label}' END"

    into: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}
    for state in range(4):
        here = state
        for k in range(3):
            label, cost, after = "I" * k, 5 * k, 3 if here == 2 else 2
            into[here].append(way(state, str(cost + 2), label + "D", "true"))
            into[after].append(way(state, f"{cost + 1} + stay", label + "R", "stay IS NOT NULL"))
            into[after].append(way(state, f"{cost} + stay", label + "K", f"stay IS NOT NULL AND i = '{'ua'[after - 2]}'"))
            if here == 0:
                into[1].append(way(state, f"{cost} + stay", label + "K", "stay IS NOT NULL AND i = 's'"))
            here = after
    steps = ", ".join(f"least({', '.join(ways)}) AS v{state}" for state, ways in into.items())
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS f FROM k, crc),
w AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d WHERE f <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM d WHERE f = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM w),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again, rtrim(text, E' \\t\\n\\x0B\\x0C\\r') AS body, left(role, 1) AS i FROM r),
c AS MATERIALIZED (SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
  CASE WHEN body = '' OR again THEN NULL WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 5 END AS stay, lag(i) OVER (PARTITION BY conv_id ORDER BY rn) || i AS pair FROM s),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, '000000000' AS v0, CAST(NULL AS VARCHAR) AS v1, CAST(NULL AS VARCHAR) AS v2, CAST(NULL AS VARCHAR) AS v3 FROM c
  UNION ALL SELECT v.conv_id, c.rn, {steps} FROM v JOIN c ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND c.rn = v.rn + 1),
b AS (SELECT conv_id, least(v0, v3, {way(2, "5", "I", "true")}, {way(1, "10", "II", "true")}) AS best FROM v QUALIFY rn = max(rn) OVER (PARTITION BY conv_id)),
e AS (SELECT conv_id, p, substr(best, 9 + p, 1) AS e FROM b, unnest(range(1, length(best) - 8)) u(p)),
n AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER g AS row, count(*) FILTER (WHERE e <> 'D') OVER g AS o FROM e WINDOW g AS (PARTITION BY conv_id ORDER BY p)),
l AS (SELECT n.*, c.role, c.text, max(CASE WHEN o = 1 AND e = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS shift FROM n LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM n.conv_id AND c.rn = n.row),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM l WHERE e <> 'D' GROUP BY conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""


def _lloyd_sql(rounds: int = 10) -> str:
    """Rounds of plain assignments and floored means, a pair of tables each."""
    near = "SELECT n, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT n, j, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, c{t}) GROUP BY n"
    mean = (
        "SELECT o.j, coalesce(list(m ORDER BY i) FILTER (WHERE i IS NOT NULL), any_value(o.c)) AS c FROM c{t} o LEFT JOIN"
        " (SELECT j, i, (s - ((s % k) + k) % k) // k AS m FROM (SELECT j, i, sum(e)::BIGINT AS s, count(*)::BIGINT AS k FROM (SELECT j, unnest(v) AS e, unnest(range(64)) AS i FROM x JOIN a{t} USING (n)) GROUP BY j, i)) s ON s.j = o.j GROUP BY o.j"
    )
    steps = [f"a{t} AS MATERIALIZED ({near.format(t=t)}), c{t + 1} AS MATERIALIZED ({mean.format(t=t)})" for t in range(rounds)]
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(CAST(e AS DOUBLE)))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS c FROM x QUALIFY j < 8),
{", ".join(steps)},
f AS ({near.format(t=rounds)})
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN x USING (n) JOIN c{rounds} USING (j)"""


ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + 16) AS f FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g""",
    "op7_url_filter": f"""
WITH u AS (SELECT page_id,
    translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
r AS (SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.-])({_BLOCKED})($|[.-])') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op10_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM g),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
o AS (SELECT doc_id, p.k, i, item_id FROM p JOIN win ON p.k = win.k AND array_to_string(p.w[i:i + p.k - 1], ' ') = win.s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY doc_id),
dw AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d), iw AS (SELECT item_id, i AS pos, k, unnest(range(0, k)) AS a, unnest(w[i:i + k - 1]) AS w FROM g),
m AS (SELECT doc_id, item_id, pos, k, a, p - a AS s FROM dw JOIN iw USING (w)), full_ AS (SELECT doc_id, item_id, pos FROM m GROUP BY ALL HAVING count(DISTINCT a) = any_value(k)),
q AS (SELECT doc_id, item_id, k, count(DISTINCT a) OVER (PARTITION BY doc_id, item_id, pos ORDER BY s RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c FROM m SEMI JOIN full_ USING (doc_id, item_id, pos)),
y AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM q WHERE c = k GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op12_repair": _repair_sql(),
    "op13_centroids": _lloyd_sql(),
}
