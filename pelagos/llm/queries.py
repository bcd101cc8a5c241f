"""Registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.llm import quality_cnn
from pelagos.llm.bpe import with_token_columns
from pelagos.llm.chat_format import ChatTemplate, as_replies, format_chats, read_back
from pelagos.llm.decontamination import contained_items
from pelagos.llm.exact_dedup import exact_dedup
from pelagos.llm.fill_middle import fill_in_middle, restored
from pelagos.llm.filter_audit import filter_audit
from pelagos.llm.license_scan import scan_licences
from pelagos.llm.secrets import KINDS, scan_secrets
from pelagos.llm.simhash import simhash_dedup
from pelagos.llm.substring_dedup import substring_dedup
from pelagos.llm.token_counts import count_tokens
from pelagos.llm.url_filter import TWO_LABEL_SUFFIXES, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The rules of the URL query.
ALLOWED = ["com/", "www.example.com/en/"]
BLOCKED = ["example.com/en/", "net/es/", "net/fr/"]


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and good: a page shows the document whose number ends its path; good is quality 1 and not toxic."""
    number = F.regexp_extract("url", r"/(\d{1,18})(?:\.html|/)?(?:[?#].*)?$", 1)
    numbered = pages.select("url", number.try_cast("long").alias("doc_id"))
    good = labels.select("doc_id", (F.col("quality") * (1 - F.col("toxic"))).alias("good"))
    return numbered.join(good, "doc_id").select("url", "good")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = judge_urls(pages, page_outcomes(pages, _table(spark, sf_dir, "labels")), ALLOWED, BLOCKED)
    return found.selectExpr("id as page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(_table(spark, sf_dir, "documents"), model).withColumnRenamed("id", "doc_id")


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_cnn.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_cnn.classify(docs, model).withColumnRenamed("id", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return with_token_columns(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)
    return found.selectExpr("id as doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _spans(kinds: tuple[str, ...]) -> Column:
    named = F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(named, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = KINDS[:3]
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *(_count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(_spans(base), 256).alias("base_sha256"),
        _spans(KINDS).alias("spans"),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select(
        F.col("id").alias("doc_id"),
        *("n", "form", "prefix_chars", "middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a conversation made of another template's control strings, read back with the rest
    planted = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text"
    )
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    found = read_back(format_chats(as_replies(talks)))
    return found.withColumnRenamed("tree", "conv_id").drop("leaf")


OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
     h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM s),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
     x AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
           list_filter(w, lambda v, p: NOT list_contains(gone, p)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

OP10_SQL = r"""
WITH w AS (SELECT 0 AS side, doc_id AS k, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
           UNION ALL
           SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark),
     i AS (SELECT side, k, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
     s AS (SELECT DISTINCT side, k, array_to_string(w[i:i + 4], ' ') AS s FROM i),
     n AS (SELECT k, count(*) AS n FROM s WHERE side = 1 GROUP BY k),
     p AS (SELECT d.k AS doc_id, b.k AS item_id, count(*) AS c FROM s d JOIN s b USING (s)
           WHERE d.side = 0 AND b.side = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, c AS n_shared, c::DOUBLE / n AS containment
FROM p JOIN n ON item_id = k WHERE c >= ceil(round(0.8 * n, 9))
UNION ALL
SELECT d.k, b.k, 1, 1, 1.0::DOUBLE FROM (SELECT * FROM w WHERE side = 1 AND len(w) BETWEEN 1 AND 4) b
JOIN (SELECT * FROM w WHERE side = 0) d ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')
"""

OP2_SQL = r"""
WITH u AS (SELECT page_id, url,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
             try_cast(regexp_extract(coalesce(url, ''), '/(\d{1,18})(?:\.html|/)?(?:[?#].*)?$', 1) AS BIGINT) AS doc_id FROM pages),
     o AS (SELECT host, 1 AS n, quality * (1 - toxic) AS k FROM u JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
     c AS (SELECT host, sum(n) AS n, sum(k) AS k FROM (SELECT host, n, k FROM o UNION ALL SELECT host, 0, 0 FROM u) GROUP BY host),
     h AS (SELECT host, n::DOUBLE AS n, k::DOUBLE AS k,
             regexp_extract(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '(?:^|\.)(SUFFIXES|[^.]*)\.?$', 1) AS suffix,
             regexp_extract(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '(?:^|\.)((?:[^.]*\.)?(?:SUFFIXES|[^.]*))\.?$', 1) AS domain FROM c),
     d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
     x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
     a AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS mu FROM x),
     xa AS (SELECT x.*, mu FROM x, a),
     wx AS (SELECT sum((k - n * mu) ** 2 - n * mu * (1 - mu)) AS t, sum(n * (n - 1) * mu * (1 - mu)) AS b FROM xa),
     mx AS (SELECT CASE WHEN b = 0 OR t <= 0 THEN 1000.0 ELSE least(greatest(b / t - 1, 1.0), 1000.0) END AS m FROM wx),
     xm AS (SELECT suffix, (mu * m + k) / (m + n) AS mu FROM xa, mx),
     da AS (SELECT d.*, mu FROM d JOIN xm USING (suffix)),
     wd AS (SELECT sum((k - n * mu) ** 2 - n * mu * (1 - mu)) AS t, sum(n * (n - 1) * mu * (1 - mu)) AS b FROM da),
     md AS (SELECT CASE WHEN b = 0 OR t <= 0 THEN 1000.0 ELSE least(greatest(b / t - 1, 1.0), 1000.0) END AS m FROM wd),
     dm AS (SELECT suffix, domain, (mu * m + k) / (m + n) AS mu FROM da, md),
     ha AS (SELECT h.*, mu FROM h JOIN dm USING (suffix, domain)),
     wh AS (SELECT sum((k - n * mu) ** 2 - n * mu * (1 - mu)) AS t, sum(n * (n - 1) * mu * (1 - mu)) AS b FROM ha),
     mh AS (SELECT CASE WHEN b = 0 OR t <= 0 THEN 1000.0 ELSE least(greatest(b / t - 1, 1.0), 1000.0) END AS m FROM wh),
     hm AS (SELECT host, (mu * m + k) / (m + n) AS p, m + n AS size FROM ha, mh),
     r AS (SELECT host, p - 1.645 * sqrt(p * (1 - p) / (size + 1)) >= 0.9 * (SELECT mu FROM a) AS good FROM hm),
     v AS (SELECT page_id, host, path, good, CASE
             WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN coalesce(rule IN ('com/', 'www.example.com/en/'), good) THEN 'allow' ELSE 'block' END AS verdict FROM v
""".replace("SUFFIXES", "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES))

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
     c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
     e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
     l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
     w AS (SELECT d.doc_id, part, t, least, good, toxic, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d JOIN e USING (t) LEFT JOIN l USING (doc_id)),
     f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
     m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
     b(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
     o AS (SELECT a.c || b2.c || c2.c || d2.c || e2.c AS filter_order, [a.bit, b2.bit, c2.bit, d2.bit, e2.bit] AS bits
           FROM b a, b b2, b c2, b d2, b e2 WHERE len(list_distinct([a.c, b2.c, c2.c, d2.c, e2.c])) = 5),
     s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
     r AS (SELECT part, filter_order, step, own,
             sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN g ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN x ELSE 0 END) AS toxic_lost
           FROM s, m GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

_CHAT = ChatTemplate()

OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, MARKS + length(role) + length(text) + ESCAPES AS chars FROM c),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
           FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM g
""".replace("MARKS", str(len(_CHAT.open + _CHAT.mid + _CHAT.close))).replace(
    "ESCAPES",  # one sign for each control string, or escape sign, in role and text
    " + ".join(f"(length({c}) - length(replace({c}, '{k}', ''))) // {len(k)}" for c in ("role", "text") for k in ("\\", *_CHAT.all_controls)),
)

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_quality_cnn": op4_quality_cnn,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_fill_middle": op11_fill_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_chat_format": op13_chat_format,
}
ORACLE_SQL = {
    "op2_url_filter": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
