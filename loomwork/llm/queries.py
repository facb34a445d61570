"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontam, gif, lm, minhash, pii, secrets, sentencepiece, toxicity, urlfilter, warc
from loomwork.llm._spans import joined

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_remainder(3) != 1)
    weights = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, weights).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_overlaps(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, bw.n AS n FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


def _span_digests(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, all spans."""
    base = found.withColumn("_base", F.expr(f"filter(spans, y -> y.rank < {len(kinds)})"))
    return base.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(_base, y -> y.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds),
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _span_digests(found, [r.kind for r in secrets.RULES if r.base])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _span_digests(found, [k.name for k in pii.KINDS if k.base])


def _spans_sql(kinds: list[tuple[str, str, str, str]], base: list[str]) -> str:
    """kinds: name, RE2 pattern, SQL over x (the match) and b (the lower-cased text before), group number or ''."""
    parts = []
    for rank, (name, pattern, valid, group) in enumerate(kinds):
        q = "'" + pattern.replace("'", "''") + "'"
        g = f"regexp_extract_all(text, {q}, {group})" if group else "m"
        parts.append(f"""SELECT rid, '{name}' AS kind, {rank} AS rk, s, s + length(x) AS e FROM (
            SELECT rid, m[i] AS x, g[i] AS g, a + CAST(coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS s,
              lower(substring(text, greatest(a + CAST(coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) - 32, 0) + 1,
                least(32, a + CAST(coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT)))) AS b
            FROM (SELECT rid, text, m, g, i, CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) AS BIGINT) AS a FROM (
              SELECT rid, text, regexp_extract_all(text, {q}) AS m, {g} AS g, string_split_regex(text, {q}) AS p FROM d) , unnest(range(1, len(m) + 1)) AS t(i)))
          WHERE {valid}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    f AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT rid, {counts}, string_agg({one}, ',' ORDER BY s, rk) FILTER (rk < {len(base)}) AS bs, string_agg({one}, ',' ORDER BY s, rk) AS sp FROM f GROUP BY rid)
    SELECT doc_id, {zero}, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans FROM d LEFT JOIN g ON g.rid = d.rid"""


#: Written out, in the dialect of DuckDB's expressions.
OP6_SQL = _spans_sql(
    [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 12", "2"),
        ("access", r"AKIA[A-Z0-9]+", "length(x) >= 18", ""),
        ("hex", r"[0-9a-f]+", "length(x) >= 16", ""),
        ("forge", r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}", "true", ""),
        ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", "true", ""),
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "true", ""),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true", ""),
        ("cloud", r"AIza[A-Za-z0-9_-]{35}", "true", ""),
        ("login", r"[a-z][a-z0-9+]{1,9}://[^\x09-\x0D\x20:/@]*:[^\x09-\x0D\x20:/@]{3,}@", "true", ""),
        ("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}", "true", ""),
    ],
    ["assign", "access", "hex"],
)

_DIG = "regexp_replace(x, '[^0-9]', '', 'g')"
_SUMS = f"""list_sum(list_transform(range(1, length({_DIG}) + 1), lambda k: CASE WHEN (length({_DIG}) - k) % 2 = 0
    THEN CAST(({_DIG})[k] AS INT) ELSE CAST(('0246813579')[CAST(({_DIG})[k] AS INT) + 1] AS INT) END)) % 10 = 0"""
_LETTERS = "(substring(replace(x, ' ', ''), 5) || substring(replace(x, ' ', ''), 1, 4))"
_REST = f"""list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({_LETTERS}, ''), lambda c: CAST(CASE WHEN c <= '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END AS BIGINT))),
    lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"""
OP7_SQL = _spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", ""),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR CAST(p AS HUGEINT) > 255)) = 0", ""),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIG}) BETWEEN 12 AND 19 AND {_SUMS}", ""),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIG}) BETWEEN 9 AND 15", ""),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _REST, ""),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "contains(b, 'ssn') OR contains(b, 'social security')", ""),
    ],
    ["email", "ip", "card", "phone"],
)

URL_RULES = tuple(urlfilter.Rule(*r) for r in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")))


def url_list(pages: DataFrame) -> DataFrame:
    """The block list of the query, as large as the table: canonical URLs with a path whose MD5 starts with 0, whole hosts whose
    MD5 starts with 00, and as many URLs that no page has."""
    host, path = urlfilter.host_and_path(F.col("url"))
    canon = pages.select(urlfilter.canonical(host, path).alias("c")).where("c is not null and c != ''")
    entries = """array(case when contains(c, '/') and startswith(md5(c), '0') then c end,
        case when contains(c, '/') and startswith(md5(c), '1') then concat(c, '?') end,
        case when split_part(c, '/', 1) != '' and startswith(md5(split_part(c, '/', 1)), '00') then split_part(c, '/', 1) end)"""
    return canon.select(F.explode(F.array_compact(F.expr(entries))).alias("url"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES, url_list(pages)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
x AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
   WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
   WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
   regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') AS canon FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
   WHEN contains(canon, '/') AND starts_with(md5(canon), '0') OR split_part(canon, '/', 1) <> '' AND starts_with(md5(split_part(canon, '/', 1)), '00') THEN 'block' ELSE 'allow' END AS verdict FROM x
"""

def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.payload_media(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: the sizes and the digest of what is read back from the stored media."""
    return op9_gif_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, t, CASE WHEN t = '' THEN 192 ELSE (192 - strlen(t) % 192) % 192 END AS pad FROM d)
SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(strlen(t) + pad AS BIGINT) AS payload_bytes, sha256(t || repeat(' ', CAST(pad AS INT))) AS payload_sha256 FROM p
"""


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS lead FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM p LEFT JOIN m ON m.h = p.h
"""


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), _remainder(10) != 0)


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the counts and the base score."""
    return op10_lm_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: CRC-32 from its table of 256 remainders.
LM_BASE_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10 = 0 AS held_out,
  list_append(coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), []), ' end') AS w FROM documents, crc),
x AS (SELECT rid, doc_id, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM x WHERE NOT held_out GROUP BY token), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
FROM x LEFT JOIN c ON c.token = x.token, n GROUP BY rid, doc_id, held_out
"""


#: The vocabulary file of the SentencePiece queries.
PIECES = os.environ.get("LOOMWORK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.encode_pieces(docs, PIECES).select("doc_id", "n_pieces", "ids", "round_trip")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS x FROM w, unnest(range(1, len(w))) AS t(i) UNION SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
n AS (SELECT w.doc_id, count(x) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
linked AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT linked.b, r.root FROM r JOIN linked ON linked.a = r.doc_id AND r.root < linked.b),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.doc_id = n.doc_id
"""


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_secrets": op6_secrets,
    "op7_pii": op7_pii,
    "op8_url_filter": op8_url_filter,
    "op9_gif_media": op9_gif_media,
    "op10_lm_scores": op10_lm_scores,
    "media_payloads": media_payloads,
    "lm_base_scores": lm_base_scores,
}
SQL: dict[str, str] = {"op1_minhash": OP1_SQL, "op3_warc": OP3_SQL, "op4_decontamination": OP4_SQL, "op6_secrets": OP6_SQL, "op7_pii": OP7_SQL, "op8_url_filter": OP8_SQL, "media_payloads": MEDIA_SQL, "lm_base_scores": LM_BASE_SQL}
