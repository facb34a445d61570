"""Queries of prompts, templates and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.sources.tables import table

SEED_WORDS = ("the", "der", "und")
SEED_TOPIC_WORDS = ("und", "para", "les")


def class_tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    scores = tx.class_tfidf(tx.term_counts(table(spark, d, "documents"), "source", "text"), "source")
    return tx.top_terms(scores, "source", 10).select("source", F.col("rank").cast("long").alias("rank"), "term", F.round("score", 9).alias("score"))


def class_bm25_top_terms(spark: SparkSession, d: str) -> DataFrame:
    scores = tx.class_tfidf(tx.term_counts(table(spark, d, "documents"), "lang", "text"), "lang", bm25=True, reduce_frequent=True)
    return tx.top_terms(scores, "lang", 10).select("lang", F.col("rank").cast("long").alias("rank"), "term", F.round("score", 9).alias("score"))


def seeded_top_terms(spark: SparkSession, d: str) -> DataFrame:
    seeds = tx.seed_factors(spark.createDataFrame([(w,) for w in SEED_WORDS], "term string"), spark.createDataFrame([(w,) for w in SEED_TOPIC_WORDS], "term string"))
    scores = tx.class_tfidf(tx.term_counts(table(spark, d, "documents"), "source", "text"), "source", seeds=seeds)
    return tx.top_terms(scores, "source", 5).select("source", F.col("rank").cast("long").alias("rank"), "term", F.round("score", 9).alias("score"))


def document_word_lists(spark: SparkSession, d: str) -> DataFrame:
    scores = tx.class_tfidf(tx.term_counts(table(spark, d, "documents"), "doc_id", "text", together=True), "doc_id")
    lists = tx.word_lists(tx.top_terms(scores, "doc_id", 5), "doc_id")
    return lists.select("doc_id", F.array_join("words", " ").alias("tfidf_words"), F.round(F.get("word_scores", F.lit(0)), 9).alias("best_score"), tx.topic_label(F.col("doc_id"), F.col("words")).alias("label"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return tx.term_counts(table(spark, d, "conversations"), "role", "text", ngram_range=(1, 2))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    e = events.crossJoin(F.broadcast(events.agg(F.avg("value").alias("mean_all"))))  # one row
    e = e.withColumn("mean_all", F.round("mean_all", 6).cast("decimal(20,6)")).withColumn("v", F.round("value", 2).cast("decimal(20,2)"))
    out = tx.prompt(e, "{}: user {} did {} at hour {} for {} of {}", ["Event", F.col("user_id"), F.col("event_type"), F.hour("ts"), F.col("v"), F.col("mean_all")])
    return out.select("event_id", "prompt")


def list_prompts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    return o.select("l_orderkey", F.array_join(F.transform("q", lambda x: x.cast("string")), "-").alias("ratings"), F.size("q").cast("long").alias("n"), total.alias("total"), F.round(total / F.size("q"), 6).alias("mean"))


def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    made = p.select("p_partkey", tx.fill_template("part_{}_of_{}", F.col("p_size"), F.translate("p_brand", "_", "-")).alias("name"))
    found = tx.parse_template(F.col("name"), "part_{}_of_{}", ["size", "brand"])
    return made.withColumn("f", found).select("p_partkey", "name", "f.size", "f.brand")


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://api.host.example/v1/"), F.element_at(F.split("url", "://"), -1)).alias("plain"), F.concat(F.lit("https://x.host.example/openai/deployments/m"), F.col("page_id").cast("string"), F.lit("/chat/completions?api-version=1")).alias("deployed"), "url")
    return p.select("page_id", tx.endpoint_of(F.col("plain")).alias("plain"), tx.endpoint_of(F.col("deployed")).alias("deployed"), tx.endpoint_of(F.col("url")).alias("none"))


def chat_templates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(tx.chat_template(F.concat(F.lit("You are "), F.col("role")), F.col("text"))).alias("digest"))


def conversation_json(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    turns = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    return turns.select("conv_id", F.size("messages").cast("long").alias("n"), tx.structs_to_string(F.col("messages")).alias("str_messages"))


QUERIES = {f.__name__: f for f in (class_tfidf_top_terms, class_bm25_top_terms, seeded_top_terms, document_word_lists, bigram_counts, prompts, list_prompts, parsed_names, endpoints, chat_templates, conversation_json)}


def _counts(by: str, source: str = "documents") -> str:
    return rf"""cleaned AS (SELECT {by}, CASE WHEN t = '' THEN 'emptydoc' ELSE t END AS t FROM (
      SELECT {by}, regexp_replace(regexp_replace(text, '[\n\t]', ' ', 'g'), '[^ 0-9A-Za-z]+', '', 'g') AS t FROM {source})),
    counts AS (SELECT {by}, term, count(*) AS n FROM (SELECT {by}, unnest(string_split(lower(t), ' ')) AS term FROM cleaned) WHERE length(term) >= 2 GROUP BY ALL)"""


def _tfidf(by: str, idf: str, tf: str = "n / class_total", factor: str = "1.0") -> str:
    return f"""totals AS (SELECT {by}, sum(n)::DOUBLE AS class_total FROM counts GROUP BY {by}),
    a AS (SELECT floor(avg(class_total)) AS a FROM totals), freq AS (SELECT term, sum(n)::DOUBLE AS f FROM counts GROUP BY term),
    scores AS (SELECT {by}, term, ({tf}) * ({idf}) * ({factor}) AS score FROM counts JOIN totals USING ({by}) JOIN freq USING (term), a),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 12) DESC, term) AS rank FROM scores)"""


_IDF, _BM25 = "ln(a / f + 1)", "ln(1 + (a - f + 0.5) / (f + 0.5))"
_TOPIC = "', '".join(SEED_TOPIC_WORDS)
_WORDS = "', '".join(SEED_WORDS)
SQL = {
    "class_tfidf_top_terms": f"WITH {_counts('source')}, {_tfidf('source', _IDF)} SELECT source, rank, term, round(score, 9) AS score FROM ranks WHERE rank <= 10",
    "class_bm25_top_terms": f"WITH {_counts('lang')}, {_tfidf('lang', _BM25, 'sqrt(n / class_total)')} SELECT lang, rank, term, round(score, 9) AS score FROM ranks WHERE rank <= 10",
    "seeded_top_terms": f"""WITH {_counts("source")}, {_tfidf("source", _IDF, factor=f"CASE WHEN term IN ('{_TOPIC}') THEN 1.2 WHEN term IN ('{_WORDS}') THEN 2.0 ELSE 1.0 END::DOUBLE")}
        SELECT source, rank, term, round(score, 9) AS score FROM ranks WHERE rank <= 5""",
    "document_word_lists": f"""WITH {_counts("doc_id")}, {_tfidf("doc_id", _IDF)}
        SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS tfidf_words, round(max(score) FILTER (rank = 1), 9) AS best_score,
          doc_id || '_' || string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS label FROM ranks WHERE rank <= 5 GROUP BY doc_id""",
    "bigram_counts": r"""WITH c AS (SELECT role, list_filter(string_split(lower(CASE WHEN t = '' THEN 'emptydoc' ELSE t END), ' '), lambda w: length(w) >= 2) AS w FROM (
          SELECT role, regexp_replace(regexp_replace(text, '[\n\t]', ' ', 'g'), '[^ 0-9A-Za-z]+', '', 'g') AS t FROM conversations)),
        g AS (SELECT role, unnest(w) AS term FROM c UNION ALL SELECT role, w[i] || ' ' || w[i + 1] FROM c, unnest(range(1, len(w))) AS x(i))
        SELECT role, term, count(*) AS n FROM g GROUP BY ALL""",
    "prompts": """SELECT event_id, 'Event: user ' || user_id || ' did ' || event_type || ' at hour ' || hour(ts) || ' for ' || round(value, 2)::DECIMAL(20, 2) || ' of ' ||
        round(avg(value) OVER (), 6)::DECIMAL(20, 6) AS prompt FROM events""",
    "list_prompts": """SELECT l_orderkey, string_agg(q::VARCHAR, '-' ORDER BY q) AS ratings, count(*) AS n, sum(q)::BIGINT AS total, round(sum(q) / count(*), 6) AS mean
        FROM (SELECT l_orderkey, l_quantity::BIGINT AS q FROM lineitem) GROUP BY l_orderkey""",
    "parsed_names": """SELECT p_partkey, 'part_' || p_size || '_of_' || replace(p_brand, '_', '-') AS name, p_size::VARCHAR AS size, replace(p_brand, '_', '-') AS brand FROM part""",
    "endpoints": """SELECT page_id, string_split(url, '://')[-1] AS plain, 'chat/completions' AS deployed, CAST(NULL AS VARCHAR) AS "none" FROM pages""",
    "chat_templates": "SELECT conv_id, turn, md5(" + " || ".join(f"replace('{m}', '$', chr(10)){p}" for m, p in zip((m.replace("\n", "$") for m in tx.chat_marks()), (" || 'You are ' || role", " || text", ""))) + ") AS digest FROM conversations",
    "conversation_json": """SELECT conv_id, count(*) AS n, string_agg(to_json({'role': role, 'content': text})::VARCHAR, ' ' ORDER BY turn, role, text) AS str_messages FROM conversations GROUP BY conv_id""",
}
