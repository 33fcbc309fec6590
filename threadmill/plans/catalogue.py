"""The queries of the driver's contract and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions import text as X
from threadmill.operators import classify as C
from threadmill.operators import cluster as K
from threadmill.operators import relational as R
from threadmill.operators import stats as S
from threadmill.operators import topics as T
from threadmill.operators import vectors as V
from threadmill.session import spread, table
from threadmill.streaming import events as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.strip()
        return f

    return put


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts_merged_final_preprocessed")


def one_each(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct rows of (keys, text) before any work on the text; the text is told apart by its hash within a key, it is never a key itself."""
    return spread(df.select(*keys, text)).groupBy(*keys, F.xxhash64(text).alias("__h")).agg(F.first(text).alias(text)).drop("__h")


def category(c: str) -> F.Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Comments with their category in one spelling."""
    t = table(spark, d, "comments_taxonomy")
    return t.withColumn("category", category("primary_category"))


def annotations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comments_interaction_annotation")


CAT = "replace(lower(trim(primary_category)), ' ', '_')"
REPLIES = f"(SELECT *, {CAT} AS category FROM comments_taxonomy)"
WORDS = "list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9_]+'), lambda w: length(w) >= {n})"
SUPPORT = ("support_empathy", "encouragement_motivation")
HARM = ("toxic_abusive", "dismissive_minimizing", "blame_criticism", "crisis_escalation")
DISTRESS = ("suicidal", "depression_anxiety", "academic_burnout", "exam_stress", "career_anxiety", "institutional_anger", "meme_distress")


def inlist(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


# Topics and terms

CTFIDF = f"""
tok AS (SELECT lang AS topic, unnest({WORDS.format(t='text', n=3)}) AS term FROM documents WHERE lang IS NOT NULL),
n AS (SELECT topic, term, count(*) AS n FROM tok GROUP BY ALL),
size AS (SELECT topic, sum(n) AS size FROM n GROUP BY topic),
mean AS (SELECT floor(avg(size)) AS a FROM size),
freq AS (SELECT term, sum(n) AS f FROM n GROUP BY term),
score AS (SELECT topic, term, n, round(n / size * ln(1 + a / f), 6) AS score FROM n JOIN size USING (topic) JOIN freq USING (term) CROSS JOIN mean),
top AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS INTEGER) AS rank, term, score FROM score WHERE score > 0 QUALIFY rank <= 10)"""


def lang_terms(spark: SparkSession, d: str) -> DataFrame:
    n = T.class_counts(spread(docs(spark, d).select(F.col("lang").alias("topic"), "text")), "topic", "text")
    return T.top_terms(T.ctfidf(n, "topic"), "topic")


@query("ctfidf_top_terms_by_lang", f"WITH {CTFIDF} SELECT topic, rank, term, score FROM top")
def _(spark, d):
    return lang_terms(spark, d)


@query("token_frequency_top500", f"""
WITH tok AS (SELECT unnest({WORDS.format(t='text', n=1)}) AS term FROM documents)
SELECT term, count(*) AS n FROM tok GROUP BY term ORDER BY n DESC, term LIMIT 500""")
def _(spark, d):
    n = docs(spark, d).select(F.explode(X.word_tokens(F.col("text"), 1)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "term").limit(500)


@query("stopword_hits", f"""
WITH tok AS (SELECT unnest({WORDS.format(t='text', n=1)}) AS term FROM documents)
SELECT term, count(*) AS n FROM tok WHERE term IN {inlist(X.STOPWORDS)} GROUP BY term""")
def _(spark, d):
    tok = docs(spark, d).select(F.explode(X.word_tokens(F.col("text"), 1)).alias("term"))
    return tok.where(F.col("term").isin(*X.STOPWORDS)).groupBy("term").agg(F.count("*").alias("n"))


@query("marker_document_frequency", f"""
WITH m AS (SELECT unnest(['cooked', 'copium', 'boss', 'drop', 'mock', 'quest']) AS marker)
SELECT marker, CAST(count(*) FILTER (contains(lower(coalesce(text, '')), marker)) AS BIGINT) AS n_docs FROM m CROSS JOIN documents GROUP BY marker""")
def _(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    marks = ("cooked", "copium", "boss", "drop", "mock", "quest")
    got = docs(spark, d).agg(*[F.count_if(low.contains(m)).alias(m) for m in marks])
    return got.unpivot([], list(marks), "marker", "n_docs")


@query("corpus_vocab_df_filtered", f"""
WITH w AS (SELECT row_number() OVER () AS i, list_filter({WORDS.format(t='text', n=2)}, lambda w: w NOT IN {inlist(X.STOPWORDS)} AND regexp_matches(w, '^[a-z]')) AS ws FROM documents),
g AS (SELECT i, unnest(ws) AS term FROM w UNION ALL SELECT i, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS term FROM w WHERE len(ws) > 1)
SELECT term, count(DISTINCT i) AS df, count(*) AS tf FROM g GROUP BY term HAVING df >= 15 AND df <= 0.45 * (SELECT count(*) FROM documents) ORDER BY tf DESC, term LIMIT 20000""")
def _(spark, d):
    return T.vocabulary(spread(docs(spark, d).select("doc_id", "text")), "doc_id", "text")


@query("bigram_counts_after_stopwords", f"""
WITH w AS (SELECT list_filter({WORDS.format(t='text', n=2)}, lambda w: w NOT IN {inlist(X.STOPWORDS)}) AS ws FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS bigram FROM w WHERE len(ws) > 1)
SELECT bigram, count(*) AS n FROM g GROUP BY bigram ORDER BY n DESC, bigram LIMIT 1000""")
def _(spark, d):
    ws = docs(spark, d).select(X.without_stopwords(X.word_tokens(F.col("text"))).alias("ws")).where(F.size("ws") > 1)
    grams = F.transform(F.slice("ws", 1, F.size("ws") - 1), lambda w, i: F.concat_ws(" ", w, F.get("ws", i + 1)))
    return ws.select(F.explode(grams).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(1000)


@query("topic_diversity", f"WITH {CTFIDF} SELECT round(count(DISTINCT term) / count(term), 6) AS diversity FROM top")
def _(spark, d):
    return T.diversity(lang_terms(spark, d))


@query("half_split_jaccard", f"""WITH {CTFIDF},
o AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT topic FROM top)),
s AS (SELECT term, max(CASE WHEN i < floor(m / 2) THEN 1 ELSE 0 END) AS a, max(CASE WHEN i < floor(m / 2) THEN 0 ELSE 1 END) AS b FROM top JOIN o USING (topic) GROUP BY term)
SELECT round(CAST(sum(a * b) AS DOUBLE) / count(*), 6) AS jaccard FROM s""")
def _(spark, d):
    return T.half_split_jaccard(lang_terms(spark, d), "topic")


@query("phrases_in_keywords", f"""WITH {CTFIDF}
SELECT topic, CAST(max(CASE WHEN contains(term, 'main') OR contains(term, 'din') OR contains(term, 'kya') THEN 1 ELSE 0 END) AS BOOLEAN) AS has_phrase,
CAST(max(CASE WHEN rank <= 5 AND regexp_matches(term, '^(http|www|[0-9]+$)') THEN 1 ELSE 0 END) AS BOOLEAN) AS has_artifact FROM top GROUP BY topic""")
def _(spark, d):
    phrase = F.exists(F.array(*map(F.lit, ("main", "din", "kya"))), lambda p: F.contains(F.col("term"), p))
    artifact = (F.col("rank") <= 5) & F.col("term").rlike("^(http|www|[0-9]+$)")
    return lang_terms(spark, d).groupBy("topic").agg(F.bool_or(phrase).alias("has_phrase"), F.bool_or(artifact).alias("has_artifact"))


@query("npmi_coherence", f"""WITH {CTFIDF},
d AS (SELECT doc_id, {WORDS.format(t='text', n=2)} AS ws FROM documents), e AS (SELECT * FROM d WHERE len(ws) > 0),
total AS (SELECT sum(greatest(1, len(ws) - 9)) AS w FROM e),
pos AS (SELECT doc_id, len(ws) AS len, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM e),
win AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, p - 9), least(p, greatest(0, len - 10)) + 1)) AS k FROM pos WHERE term IN (SELECT term FROM top)),
s AS (SELECT term, count(*) AS n FROM win GROUP BY term),
pr AS (SELECT a.topic, a.term AS a, b.term AS b FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank),
j AS (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT a, b FROM pr) JOIN win x ON x.term = a JOIN win y ON y.term = b AND y.doc_id = x.doc_id AND y.k = x.k GROUP BY a, b),
v AS (SELECT topic, coalesce(j.n, 0) / w AS p, sa.n / w AS pa, sb.n / w AS pb FROM pr JOIN s sa ON sa.term = pr.a JOIN s sb ON sb.term = pr.b LEFT JOIN j ON j.a = pr.a AND j.b = pr.b CROSS JOIN total)
SELECT topic, round(avg(ln((p + 1e-12) / (pa * pb)) / -ln(p + 1e-12)), 6) AS c_npmi FROM v GROUP BY topic""")
def _(spark, d):
    return T.coherence_npmi(docs(spark, d), "doc_id", "text", lang_terms(spark, d), "topic")


@query("cv_coherence")
def _(spark, d):
    return T.coherence_cv(docs(spark, d), "doc_id", "text", lang_terms(spark, d), "topic")


LABELLED_DOCS = "(SELECT doc_id, text, CASE WHEN lang IS NULL THEN -1 WHEN lang = 'en' THEN 0 WHEN lang = 'hi-latn' THEN 1 WHEN lang = 'fr' THEN 2 WHEN lang = 'de' THEN 3 ELSE 4 END AS topic FROM documents)"


def labelled_docs(spark, d):
    topic = F.when(F.col("lang").isNull(), -1)
    for i, code in enumerate(("en", "hi-latn", "fr", "de")):
        topic = topic.when(F.col("lang") == code, i)
    return docs(spark, d).select("doc_id", "text", topic.otherwise(4).alias("topic"))


@query("reduce_outliers_ctfidf", f"""
WITH x AS {LABELLED_DOCS}, tok AS (SELECT doc_id, topic, unnest({WORDS.format(t='text', n=3)}) AS term FROM x),
n AS (SELECT topic, term, count(*) AS n FROM tok WHERE topic <> -1 GROUP BY ALL), size AS (SELECT topic, sum(n) AS size FROM n GROUP BY topic),
mean AS (SELECT floor(avg(size)) AS a FROM size), freq AS (SELECT term, sum(n) AS f FROM n GROUP BY term),
w AS (SELECT topic, term, n / size * ln(1 + a / f) AS s FROM n JOIN size USING (topic) JOIN freq USING (term) CROSS JOIN mean),
norm AS (SELECT topic, sqrt(sum(s * s)) AS norm FROM w GROUP BY topic),
o AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM tok WHERE topic = -1 AND term IN (SELECT term FROM freq) GROUP BY ALL),
len AS (SELECT doc_id, sqrt(sum(tf * tf)) AS len FROM o GROUP BY doc_id),
sim AS (SELECT o.doc_id, w.topic, round(sum(tf * s) / (any_value(norm) * any_value(len)), 6) AS sim FROM o JOIN w USING (term) JOIN norm ON norm.topic = w.topic JOIN len USING (doc_id) GROUP BY o.doc_id, w.topic),
best AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) = 1)
SELECT x.doc_id, CAST(CASE WHEN sim >= 0.05 THEN best.topic ELSE -1 END AS INTEGER) AS new_topic, coalesce(sim, 0.0) AS sim FROM x LEFT JOIN best USING (doc_id) WHERE x.topic = -1""")
def _(spark, d):
    return T.reduce_outliers(spread(labelled_docs(spark, d)), "doc_id", "text", "topic")


@query("mmr_keywords")
def _(spark, d):
    top = lang_terms(spark, d)
    grams = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.regexp_count(F.col("term"), F.char(i + 97)).cast("double"))
    return T.rerank_mmr(top, top.select("term", grams.alias("vec")).distinct(), "topic")


# Sizes, duplicates, joins

@query("doc_length_stats_by_lang", """
SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, median(n_chars) AS median, min(n_chars) AS least, max(n_chars) AS most, round(stddev_pop(n_chars), 4) AS sd,
count(*) FILTER (n_chars < 200) AS n_short FROM documents GROUP BY lang""")
def _(spark, d):
    c = F.col("n_chars")
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), F.median(c).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.stddev_pop(c), 4).alias("sd"), F.count_if(c < 200).alias("n_short"))


@query("corpus_size_stats", """
SELECT source, count(*) AS n, count(text) AS n_text, count(DISTINCT author) AS n_authors, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source""")
def _(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.countDistinct("author").alias("n_authors"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("exact_text_dedup_counts", """
WITH g AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS n_texts, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS n_removed, max(n) AS largest FROM g""")
def _(spark, d):
    g = docs(spark, d).where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("n_removed"), F.max("n").alias("largest"))


@query("dedup_keep_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(spark, d):
    return docs(spark, d).where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("posts_latest_row", """
SELECT id, subreddit, CAST(score AS DOUBLE) AS score, ingested_at FROM posts_merged_final_preprocessed QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, score DESC) = 1""")
def _(spark, d):
    return R.first_by(posts(spark, d).select("id", "subreddit", F.col("score").cast("double").alias("score"), "ingested_at"), ["id"], [F.desc("ingested_at"), F.desc("score")])


LATEST = "(SELECT * FROM posts_merged_final_preprocessed QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, score DESC) = 1)"
TOPIC1 = "(SELECT id, max(topic_id) AS topic_id FROM topics GROUP BY id)"


def latest(spark, d, *cols):
    return R.first_by(posts(spark, d).select("id", "ingested_at", "score", *cols), ["id"], [F.desc("ingested_at"), F.desc("score")])


def topic1(spark, d):
    return table(spark, d, "topics").groupBy("id").agg(F.max("topic_id").alias("topic_id"))


@query("left_join_bucketed", f"""
SELECT coalesce(CAST(topic_id AS VARCHAR), '') AS topic_id, CASE WHEN distress_confidence >= 0.8 THEN 'high' WHEN distress_confidence >= 0.5 THEN 'medium' WHEN distress_confidence <= 0.2 THEN 'low' ELSE 'borderline' END AS bucket,
CASE WHEN is_distress THEN 'distress' ELSE 'non_distress' END AS label, count(*) AS n FROM {LATEST} p LEFT JOIN {TOPIC1} t USING (id) GROUP BY ALL""")
def _(spark, d):
    p = latest(spark, d, "distress_confidence", "is_distress").join(topic1(spark, d), "id", "left")
    return p.groupBy(F.coalesce(F.col("topic_id").cast("string"), F.lit("")).alias("topic_id"), R.confidence_bucket(F.col("distress_confidence")).alias("bucket"), F.when(F.col("is_distress"), "distress").otherwise("non_distress").alias("label")).agg(F.count("*").alias("n"))


@query("unlabelled_anti_join", f"SELECT p.id, subreddit FROM {LATEST} p WHERE p.id NOT IN (SELECT id FROM topics WHERE id IS NOT NULL)")
def _(spark, d):
    return latest(spark, d, "subreddit").join(topic1(spark, d), "id", "left_anti").select("id", "subreddit")


@query("labelled_semi_join", f"SELECT p.id, subreddit FROM {LATEST} p WHERE p.id IN (SELECT id FROM topics)")
def _(spark, d):
    return latest(spark, d, "subreddit").join(topic1(spark, d), "id", "left_semi").select("id", "subreddit")


@query("orphan_replies", "SELECT count(*) AS n FROM comments_taxonomy c WHERE NOT EXISTS (SELECT 1 FROM posts_merged_final_preprocessed p WHERE p.id = c.post_id)")
def _(spark, d):
    return table(spark, d, "comments_taxonomy").select("post_id").join(posts(spark, d).select(F.col("id").alias("post_id")), "post_id", "left_anti").agg(F.count("*").alias("n"))


for _n, _c in (("lang", "lang"), ("source", "source"), ("author", "author")):
    query(f"{_n}_share_pct", f"SELECT {_c}, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY {_c}")(lambda s, d, c=_c: R.shares(docs(s, d), c))


@query("top_source_per_lang_mode", """
SELECT lang, source AS top_source FROM (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1""")
def _(spark, d):
    return docs(spark, d).where(F.col("source").isNotNull()).groupBy("lang").agg(F.mode("source", True).alias("top_source"))


@query("star_revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def _(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # 25 nations
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


# Crosstabs and rates of replies

@query("crosstab_counts", f"SELECT distress_type, category, count(*) AS n FROM {REPLIES} GROUP BY ALL")
def _(spark, d):
    return R.crosstab(replies(spark, d), "distress_type", "category")


@query("crosstab_row_pct", f"SELECT distress_type, category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY distress_type), 4) AS pct FROM {REPLIES} GROUP BY 1, 2")
def _(spark, d):
    return R.crosstab(replies(spark, d), "distress_type", "category", "row")


@query("crosstab_col_pct", f"SELECT distress_type, category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY category), 4) AS pct FROM {REPLIES} GROUP BY 1, 2")
def _(spark, d):
    return R.crosstab(replies(spark, d), "distress_type", "category", "col")


@query("pivot_counts", f"SELECT distress_type, {', '.join(f'count(*) FILTER (category = {chr(39)}{c}{chr(39)}) AS {c}' for c in C.CATEGORIES)} FROM {REPLIES} GROUP BY distress_type")
def _(spark, d):
    return R.pivot_counts(replies(spark, d), "distress_type", "category", C.CATEGORIES)


@query("engagement_per_group", """
SELECT distress_type, count(*) AS comments, count(DISTINCT post_id) AS posts, round(count(*) / count(DISTINCT post_id), 1) AS per_post, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM comments_taxonomy GROUP BY distress_type""")
def _(spark, d):
    g = replies(spark, d).groupBy("distress_type").agg(F.count("*").alias("comments"), F.countDistinct("post_id").alias("posts"))
    return g.select("*", F.round(R.ratio(F.col("comments"), F.col("posts")), 1).alias("per_post"), F.round(100.0 * F.col("comments") / F.sum("comments").over(Window.partitionBy()), 4).alias("pct"))


@query("support_harm_ratio", f"""
SELECT coalesce(distress_type, 'overall') AS distress_type, round(100.0 * s / n, 4) AS support_pct, round(100.0 * h / n, 4) AS harm_pct, round(100.0 * m / n, 4) AS humor_pct, round(s / nullif(h, 0), 4) AS support_harm FROM (
SELECT distress_type, count(*) AS n, count(*) FILTER (category IN {inlist(SUPPORT)}) AS s, count(*) FILTER (category IN {inlist(HARM)}) AS h, count(*) FILTER (category = 'humor_meme_coping') AS m FROM {REPLIES} WHERE distress_type IS NOT NULL GROUP BY GROUPING SETS ((distress_type), ()))""")
def _(spark, d):
    c = F.col("category")
    g = replies(spark, d).where(F.col("distress_type").isNotNull()).rollup("distress_type").agg(F.count("*").alias("n"), F.count_if(c.isin(*SUPPORT)).alias("s"), F.count_if(c.isin(*HARM)).alias("h"), F.count_if(c == "humor_meme_coping").alias("m"))
    pct = lambda x: F.round(100.0 * F.col(x) / F.col("n"), 4)
    return g.select(F.coalesce("distress_type", F.lit("overall")).alias("distress_type"), pct("s").alias("support_pct"), pct("h").alias("harm_pct"), pct("m").alias("humor_pct"), F.round(R.ratio(F.col("s"), F.col("h")), 4).alias("support_harm"))


BANDS = {"support": SUPPORT, "guidance": ("advice_guidance", "information_resources"), "sharing": ("personal_experience", "self_disclosure"), "harm": HARM, "other": ("neutral_discussion", "humor_meme_coping")}
BANDSQL = " UNION ALL ".join(f"SELECT '{c}' AS category, '{b}' AS band" for b, cs in BANDS.items() for c in cs)


@query("response_bands", f"""
WITH b AS ({BANDSQL}), g AS (SELECT distress_type, coalesce(band, 'unknown') AS band, count(*) AS n FROM {REPLIES} LEFT JOIN b USING (category) GROUP BY ALL)
SELECT distress_type, band, n, round(100.0 * n / sum(n) OVER (PARTITION BY distress_type), 4) AS pct FROM g""")
def _(spark, d):
    dim = spark.createDataFrame([(c, b) for b, cs in BANDS.items() for c in cs], "category string, band string")
    return R.crosstab(R.lookup(replies(spark, d), dim, "category", {"band": "unknown"}), "distress_type", "band", "row")


@query("endorsement_full_outer", f"""
SELECT coalesce(a.category, b.category) AS category, mean_all, mean_some FROM (SELECT category, round(avg(score), 4) AS mean_all FROM {REPLIES} WHERE category IS NOT NULL GROUP BY 1) a
FULL OUTER JOIN (SELECT category, round(avg(score), 4) AS mean_some FROM {REPLIES} WHERE category IS NOT NULL AND distress_type = 'depression_anxiety' GROUP BY 1) b ON a.category = b.category""")
def _(spark, d):
    r = replies(spark, d).where(F.col("category").isNotNull())
    a = r.groupBy("category").agg(F.round(F.avg("score"), 4).alias("mean_all"))
    b = r.where("distress_type = 'depression_anxiety'").groupBy("category").agg(F.round(F.avg("score"), 4).alias("mean_some"))
    return a.join(b, "category", "full_outer")


@query("ordered_domain_reindex", f"""
WITH o AS (SELECT unnest({list(DISTRESS)}) AS distress_type, unnest(range(7)) AS ordinal), g AS (SELECT distress_type, count(*) AS n FROM comments_taxonomy GROUP BY 1)
SELECT CAST(ordinal AS INTEGER) AS ordinal, distress_type, CAST(n AS DOUBLE) AS n FROM o LEFT JOIN g USING (distress_type)""")
def _(spark, d):
    return R.in_order(R.counts(replies(spark, d), "distress_type").withColumn("n", F.col("n").cast("double")), "distress_type", DISTRESS)


@query("cohort_share_compare", f"""
WITH g AS (SELECT CASE WHEN distress_type IN ('suicidal', 'depression_anxiety', 'academic_burnout') THEN 'sensitive' ELSE 'other' END AS cohort, category, count(*) AS n FROM {REPLIES} GROUP BY ALL)
SELECT cohort, category, n, round(100.0 * n / sum(n) OVER (PARTITION BY cohort), 4) AS pct FROM g""")
def _(spark, d):
    return R.crosstab(replies(spark, d).withColumn("cohort", F.when(F.col("distress_type").isin(*C.SENSITIVE), "sensitive").otherwise("other")), "cohort", "category", "row")


@query("rate_by_group", f"""
SELECT distress_type, round(100 * avg(CASE WHEN category = 'crisis_escalation' THEN 1.0 ELSE 0.0 END), 4) AS crisis_pct, round(100 * avg(CASE WHEN category IN {inlist(SUPPORT)} THEN 1.0 ELSE 0.0 END), 4) AS support_pct,
round(100 * avg(CASE WHEN category = 'toxic_abusive' THEN 1.0 ELSE 0.0 END), 4) AS toxic_pct FROM {REPLIES} GROUP BY distress_type""")
def _(spark, d):
    c = F.col("category")
    return replies(spark, d).groupBy("distress_type").agg(R.share_of(c == "crisis_escalation").alias("crisis_pct"), R.share_of(c.isin(*SUPPORT)).alias("support_pct"), R.share_of(c == "toxic_abusive").alias("toxic_pct"))


@query("group_histogram_json")
def _(spark, d):
    return R.histogram_json(replies(spark, d), "distress_type", "category", 5)


# Inference and agreement

@query("chi_square_cramers_v", f"""
WITH n AS (SELECT distress_type AS r, category AS c, count(*) AS n FROM {REPLIES} WHERE distress_type IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
rs AS (SELECT r, sum(n) AS rn FROM n GROUP BY r), cs AS (SELECT c, sum(n) AS cn FROM n GROUP BY c), t AS (SELECT sum(n) AS tn, count(DISTINCT r) AS k, count(DISTINCT c) AS l FROM n),
x AS (SELECT sum((coalesce(n, 0) - rn * cn / tn) ** 2 / (rn * cn / tn)) AS chi2, any_value(tn) AS tn, any_value(k) AS k, any_value(l) AS l FROM rs CROSS JOIN cs CROSS JOIN t LEFT JOIN n ON n.r = rs.r AND n.c = cs.c)
SELECT CAST(tn AS BIGINT) AS n, round(chi2, 4) AS chi2, (k - 1) * (l - 1) AS dof, round(sqrt(chi2 / (tn * (least(k, l) - 1))), 4) AS cramers_v FROM x""")
def _(spark, d):
    return S.chi_square(replies(spark, d), "distress_type", "category")


@query("relative_rate", f"""
WITH g AS (SELECT category, count(*) AS n, count(*) FILTER (distress_type = 'depression_anxiety') AS n_subset FROM {REPLIES} GROUP BY category)
SELECT category, n, n_subset, round((n_subset / nullif(sum(n_subset) OVER (), 0)) / (n / sum(n) OVER ()), 4) AS relative_rate FROM g""")
def _(spark, d):
    return S.relative_rate(replies(spark, d), "category", F.coalesce(F.col("distress_type") == "depression_anxiety", F.lit(False)))


@query("group_coverage_pct", f"""
WITH g AS (SELECT post_id, max(CASE WHEN category IN {inlist(SUPPORT)} THEN 1 ELSE 0 END) AS s, max(CASE WHEN category IN {inlist(HARM)} THEN 1 ELSE 0 END) AS h FROM {REPLIES} GROUP BY post_id)
SELECT count(*) AS n_groups, round(100 * avg(s), 4) AS support_pct, round(100 * avg(h), 4) AS harm_pct FROM g""")
def _(spark, d):
    c = F.col("category")
    return S.coverage(replies(spark, d), "post_id", {"support": c.isin(*SUPPORT), "harm": c.isin(*HARM)})


@query("mann_whitney_u_z", f"""
WITH v AS (SELECT CAST(score AS DOUBLE) AS x, CASE WHEN category IN {inlist(SUPPORT)} THEN 1 ELSE 0 END AS a FROM {REPLIES} WHERE score IS NOT NULL),
g AS (SELECT x, sum(a) AS a, count(*) AS t FROM v GROUP BY x), r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM g),
s AS (SELECT CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(t - a) AS DOUBLE) AS n2, sum(a * rk) AS r1, sum(CAST(t AS DOUBLE) ** 3 - t) AS ties FROM r), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 4) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 4) AS z FROM u""")
def _(spark, d):
    return S.mann_whitney(replies(spark, d).withColumn("score", F.col("score").cast("double")), "score", F.coalesce(F.col("category").isin(*SUPPORT), F.lit(False)))


@query("mann_whitney_p_value")
def _(spark, d):
    got = S.mann_whitney(replies(spark, d), "score", F.coalesce(F.col("category").isin(*SUPPORT), F.lit(False)))
    return got.select("u", "z", S.normal_tail(F.col("z")).alias("p"))


A = "(SELECT assistant_annotation AS a, human_annotation AS h, confidence FROM comments_interaction_annotation WHERE assistant_annotation IS NOT NULL AND human_annotation IS NOT NULL)"


@query("cohen_kappa", f"""
WITH n AS (SELECT a, h, count(*) AS n FROM {A} GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = h THEN n ELSE 0 END) AS same FROM n),
p AS (SELECT sum(x * y) AS pe FROM (SELECT a AS l, CAST(sum(n) AS DOUBLE) AS x FROM n GROUP BY a) JOIN (SELECT h AS l, CAST(sum(n) AS DOUBLE) AS y FROM n GROUP BY h) USING (l))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round((same / n - pe / (n * n)) / nullif(1 - pe / (n * n), 0), 6) AS kappa FROM t CROSS JOIN p""")
def _(spark, d):
    return S.kappa(annotations(spark, d), "assistant_annotation", "human_annotation")


@query("confusion_matrix", f"SELECT h AS human_annotation, a AS assistant_annotation, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY h), 4) AS pct FROM {A} GROUP BY 1, 2")
def _(spark, d):
    return R.crosstab(annotations(spark, d).na.drop(subset=["assistant_annotation", "human_annotation"]), "human_annotation", "assistant_annotation", "row")


@query("macro_prf", f"""
WITH n AS (SELECT a, h, count(*) AS n FROM {A} GROUP BY ALL), t AS (SELECT h AS l, sum(n) AS nt, sum(CASE WHEN a = h THEN n ELSE 0 END) AS tp FROM n GROUP BY h), g AS (SELECT a AS l, sum(n) AS ng FROM n GROUP BY a),
c AS (SELECT coalesce(t.l, g.l) AS l, coalesce(tp, 0) AS tp, coalesce(ng, 0) AS ng, coalesce(nt, 0) AS nt FROM t FULL OUTER JOIN g ON t.l = g.l)
SELECT count(*) AS labels, round(avg(coalesce(tp / nullif(ng, 0), 0.0)), 6) AS precision, round(avg(coalesce(tp / nullif(nt, 0), 0.0)), 6) AS recall, round(avg(coalesce(2.0 * tp / nullif(ng + nt, 0), 0.0)), 6) AS f1 FROM c""")
def _(spark, d):
    return S.macro_prf(annotations(spark, d), "human_annotation", "assistant_annotation")


@query("agreement_by_bucket", f"""
SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence <= 0.2 THEN 'low' ELSE 'borderline' END AS bucket, count(*) AS n, round(avg(CASE WHEN a = h THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM {A} GROUP BY 1""")
def _(spark, d):
    a = annotations(spark, d).na.drop(subset=["assistant_annotation", "human_annotation"])
    same = (F.col("assistant_annotation") == F.col("human_annotation")).cast("double")
    return a.groupBy(R.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("agreement"))


@query("class_distribution_diff", f"""
WITH x AS (SELECT a AS l, count(*) AS na FROM {A} GROUP BY 1), y AS (SELECT h AS l, count(*) AS nh FROM {A} GROUP BY 1)
SELECT coalesce(x.l, y.l) AS label, coalesce(na, 0) AS n_assistant, coalesce(nh, 0) AS n_human, coalesce(na, 0) - coalesce(nh, 0) AS diff FROM x FULL OUTER JOIN y ON x.l = y.l""")
def _(spark, d):
    g = S.per_class(annotations(spark, d), "human_annotation", "assistant_annotation")
    return g.select("label", F.col("n_guess").alias("n_assistant"), F.col("n_truth").alias("n_human"), (F.col("n_guess") - F.col("n_truth")).alias("diff"))


@query("bootstrap_ci")
def _(spark, d):
    a = annotations(spark, d).na.drop(subset=["assistant_annotation", "human_annotation"])
    return S.bootstrap_ci(a.withColumn("same", (F.col("assistant_annotation") == F.col("human_annotation")).cast("double")), "same")


def ari_sql(noise: bool) -> str:
    keep = "WHERE a <> -1 AND b <> -1" if noise else ""
    return f"""
WITH x AS (SELECT t.topic_id AS a, c.topic_id AS b FROM {TOPIC1} t JOIN (SELECT post_id AS id, max(topic_id) AS topic_id FROM comments_taxonomy GROUP BY 1) c USING (id) WHERE t.topic_id IS NOT NULL AND c.topic_id IS NOT NULL),
n AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM x {keep} GROUP BY ALL), i AS (SELECT sum(m * (m - 1) / 2) AS i FROM (SELECT sum(n) AS m FROM n GROUP BY a)), j AS (SELECT sum(m * (m - 1) / 2) AS j FROM (SELECT sum(n) AS m FROM n GROUP BY b)),
z AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM n)
SELECT CAST(t AS BIGINT) AS n, round((ij - i * j / (t * (t - 1) / 2)) / nullif((i + j) / 2 - i * j / (t * (t - 1) / 2), 0), 6) AS ari FROM z CROSS JOIN i CROSS JOIN j"""


def two_labelings(spark, d):
    c = table(spark, d, "comments_taxonomy").groupBy(F.col("post_id").alias("id")).agg(F.max("topic_id").alias("b"))
    return topic1(spark, d).withColumnRenamed("topic_id", "a").join(c, "id")


@query("ari_two_labelings", ari_sql(False))
def _(spark, d):
    return S.adjusted_rand(two_labelings(spark, d), "a", "b")


@query("ari_masked", ari_sql(True))
def _(spark, d):
    return S.adjusted_rand(two_labelings(spark, d), "a", "b", noise=-1)


# Ranks and spreads

@query("cumulative_coverage", f"""
WITH g AS (SELECT topic_id, count(*) AS n FROM {TOPIC1} WHERE topic_id <> -1 GROUP BY 1)
SELECT topic_id, n, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(n) OVER (ORDER BY n DESC, topic_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share FROM g WINDOW w AS (ORDER BY n DESC, topic_id)""")
def _(spark, d):
    return R.cumulative_share(R.counts(topic1(spark, d).where("topic_id <> -1"), "topic_id"), "n", "topic_id")


@query("gini_entropy_top3", f"""
WITH g AS (SELECT topic_id, count(*) AS n FROM {TOPIC1} WHERE topic_id <> -1 GROUP BY 1), x AS (SELECT n, n / sum(n) OVER () AS p, sum(n) OVER () AS t, count(*) OVER () AS k, sum(n) OVER (ORDER BY n, topic_id ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY n DESC, topic_id) AS r FROM g)
SELECT any_value(k) AS k, round(sum(-p * log2(p + 1e-12)) / log2(any_value(k)), 6) AS entropy, round(sum(-p * ln(p)) / ln(any_value(k)), 6) AS entropy_ln, round((any_value(k) + 1 - 2.0 * sum(c) / any_value(t)) / any_value(k), 6) AS gini,
round(sum(CASE WHEN r <= 3 THEN p ELSE 0 END), 6) AS top3_share, round(100 * stddev_pop(n) / avg(n), 6) AS cv_pct FROM x""")
def _(spark, d):
    return S.size_spread(topic1(spark, d).where("topic_id <> -1"), "topic_id")


PERSOURCE = "(SELECT source, CAST(count(*) AS DOUBLE) AS n, avg(n_chars) AS len, CAST(count(DISTINCT author) AS DOUBLE) AS authors, CAST(count(*) FILTER (n_chars < 200) AS DOUBLE) AS short FROM documents WHERE source IS NOT NULL GROUP BY source)"


def per_source(spark, d):
    return docs(spark, d).where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").cast("double").alias("n"), F.avg("n_chars").alias("len"), F.countDistinct("author").cast("double").alias("authors"), F.count_if(F.col("n_chars") < 200).cast("double").alias("short"))


@query("zscore_composite_rank", f"""
WITH z AS (SELECT source, round(({' + '.join(f'{s} * CASE WHEN stddev_pop({c}) OVER () > 1e-9 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END' for c, s in (('n', 1), ('len', 1), ('authors', 1), ('short', -1)))}) / 4, 4) AS composite FROM {PERSOURCE})
SELECT source, composite, CAST(row_number() OVER (ORDER BY composite DESC, source) AS INTEGER) AS rank FROM z""")
def _(spark, d):
    z = R.z_scores(per_source(spark, d), {"n": 1, "len": 1, "authors": 1, "short": -1})
    return R.ranked(z.select("source", "composite"), [F.desc("composite"), F.col("source")])


def mm_sql(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END"


@query("minmax_weighted_score", f"SELECT source, round(0.4 * ({mm_sql('n')}) + 0.3 * ({mm_sql('len')}) + 0.2 * ({mm_sql('authors')}) + 0.1 * (1 - ({mm_sql('short')})), 6) AS score FROM {PERSOURCE}")
def _(spark, d):
    return per_source(spark, d).select("source", F.round(0.4 * R.min_max("n") + 0.3 * R.min_max("len") + 0.2 * R.min_max("authors") + 0.1 * (1 - R.min_max("short")), 6).alias("score"))


@query("pearson_corr_len_terms", f"SELECT round(corr(n_chars, len({WORDS.format(t='text', n=1)})), 6) AS r FROM documents")
def _(spark, d):
    return docs(spark, d).agg(F.round(F.corr(F.col("n_chars").cast("double"), F.size(X.word_tokens(F.col("text"), 1)).cast("double")), 6).alias("r"))


@query("score_quantile_picks", f"""
WITH x AS (SELECT category, comment_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM (SELECT DISTINCT category, comment_id, score FROM {REPLIES} WHERE score IS NOT NULL AND category IS NOT NULL) WINDOW w AS (PARTITION BY category ORDER BY score DESC, comment_id))
SELECT category, comment_id, CAST(i AS INTEGER) AS i FROM x WHERE i = 45 * (n - 1) // 100 OR i = 65 * (n - 1) // 100""")
def _(spark, d):
    x = replies(spark, d).where(F.col("score").isNotNull() & F.col("category").isNotNull()).select("category", "comment_id", "score").distinct()
    x = R.rank_in_groups(x, ["category"], [("score", True), ("comment_id", False)], "i")
    at = lambda pct: F.floor(F.lit(pct) * (F.col("i_of") - 1) / 100)
    return x.where((F.col("i") == at(45)) | (F.col("i") == at(65))).select("category", "comment_id", F.col("i").cast("int").alias("i"))


# Vectors

UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) + 1e-12))"
CENT = f"""u AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings), f AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS p FROM u), m AS (SELECT label, p, avg(x) AS m FROM f GROUP BY ALL),
c0 AS (SELECT label, list(m ORDER BY p) AS c FROM m GROUP BY label), c AS (SELECT label, list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-12)) AS c FROM c0)"""


def vecs(spark, d):
    return table(spark, d, "embeddings")


@query("topic_centroid_pairs", f"WITH {CENT} SELECT a.label AS i, b.label AS j, round(list_dot_product(a.c, b.c), 4) AS sim FROM c a JOIN c b ON a.label < b.label")
def _(spark, d):
    return V.centroid_pairs(vecs(spark, d), "label", "embedding", 4)


@query("redundant_pairs", f"WITH {CENT} SELECT count(*) FILTER (s > 0.9) AS over_90, count(*) FILTER (s > 0.8) AS over_80, round(max(s), 4) AS most FROM (SELECT list_dot_product(a.c, b.c) AS s FROM c a JOIN c b ON a.label < b.label)")
def _(spark, d):
    p = V.centroid_pairs(vecs(spark, d), "label", "embedding", 12)
    return p.agg(F.count_if(F.col("sim") > 0.9).alias("over_90"), F.count_if(F.col("sim") > 0.8).alias("over_80"), F.round(F.max("sim"), 4).alias("most"))


@query("intra_inter_separation", f"""WITH {CENT}, i AS (SELECT avg(m) AS intra FROM (SELECT u.label, avg(list_dot_product(v, c)) AS m FROM u JOIN c ON u.label = c.label GROUP BY 1)),
e AS (SELECT avg(s) AS inter, count(*) FILTER (s > 0.9) AS r FROM (SELECT list_dot_product(a.c, b.c) AS s FROM c a JOIN c b ON a.label < b.label)) SELECT round(intra, 4) AS intra, round(inter, 4) AS inter, round(intra - inter, 4) AS separation, r AS redundant_pairs FROM i CROSS JOIN e""")
def _(spark, d):
    return V.separation(vecs(spark, d), "label", "embedding", 0.90, 4)


@query("doc_confidence_top5", f"WITH {CENT} SELECT u.label, vec_id, round(list_dot_product(v, c), 4) AS confidence FROM u JOIN c ON u.label = c.label QUALIFY row_number() OVER (PARTITION BY u.label ORDER BY round(list_dot_product(v, c), 4) DESC, vec_id) <= 5")
def _(spark, d):
    return R.first_by(V.confidence(vecs(spark, d), "label", "embedding", 4), ["label"], [F.desc("confidence"), F.col("vec_id")], 5).select("label", "vec_id", "confidence")


@query("cosine_top10_per_query", f"""WITH u AS (SELECT vec_id, {UNIT} AS v FROM embeddings), s AS (SELECT q.vec_id AS q_id, x.vec_id AS vec_id, round(list_dot_product(q.v, x.v), 4) AS sim FROM u q CROSS JOIN u x WHERE q.vec_id % 100 = 0)
SELECT q_id, vec_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, sim FROM s QUALIFY rank <= 10""")
def _(spark, d):
    v = vecs(spark, d)
    return V.nearest(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding"), v, "q_id", "vec_id", "embedding", 10, 4)


QUERYSET = ("mock test rank and percentile", "placement season offer letter", "panic attack and dark thoughts", "family pressure strict parents", "coaching fees refund", "sleep schedule burnout", "coding practice contest rating", "visa interview education loan")
QSQL = " UNION ALL ".join(f"SELECT {i} AS q_id, '{q}' AS q" for i, q in enumerate(QUERYSET))
REL = f"""q AS ({QSQL}), qw AS (SELECT q_id, unnest(list_distinct({WORDS.format(t='q', n=2)})) AS w, len(list_distinct({WORDS.format(t='q', n=2)})) AS size FROM q),
dw AS (SELECT doc_id, unnest(list_distinct({WORDS.format(t='text', n=2)})) AS w FROM documents), rel AS (SELECT q_id, doc_id, round(count(*) / any_value(size), 6) AS rel FROM dw JOIN qw USING (w) GROUP BY ALL)"""


def relevance(spark, d):
    q = spark.createDataFrame(list(enumerate(QUERYSET)), "q_id int, q string")
    return V.keyword_relevance(q, docs(spark, d), "q_id", "doc_id", "q", "text")


@query("keyword_relevance", f"WITH {REL} SELECT q_id, count(*) AS n_rel, round(avg(rel), 6) AS mean_rel, max(rel) AS best FROM rel GROUP BY q_id")
def _(spark, d):
    return relevance(spark, d).groupBy("q_id").agg(F.count("*").alias("n_rel"), F.round(F.avg("rel"), 6).alias("mean_rel"), F.max("rel").alias("best"))


@query("ir_metrics_at_10", f"""WITH {REL}, d AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY n_chars DESC, doc_id) AS rank FROM q CROSS JOIN (SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL) QUALIFY rank <= 10),
g AS (SELECT d.q_id, rank, coalesce(rel, 0.0) AS rel, sum(CASE WHEN coalesce(rel, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY d.q_id ORDER BY rank) AS h FROM d LEFT JOIN rel ON rel.q_id = d.q_id AND rel.doc_id = d.doc_id),
p AS (SELECT q_id, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS n, min(CASE WHEN rel > 0 THEN rank END) AS f, avg(CASE WHEN rel > 0 THEN h / rank END) AS ap, sum(rel / log2(rank + 1.0)) AS dcg FROM g GROUP BY q_id),
t AS (SELECT q_id, count(*) AS nr FROM rel WHERE rel > 0 GROUP BY q_id), i AS (SELECT q_id, sum(rel / log2(k + 1.0)) AS idcg FROM (SELECT q_id, rel, row_number() OVER (PARTITION BY q_id ORDER BY rel DESC, doc_id) AS k FROM rel QUALIFY k <= 10) GROUP BY q_id)
SELECT q_id, round(coalesce(n / 10.0, 0), 6) AS p, round(coalesce(n / nr, 0), 6) AS r, round(coalesce(1.0 / f, 0), 6) AS mrr, round(coalesce(ap, 0), 6) AS ap, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM p LEFT JOIN t USING (q_id) LEFT JOIN i USING (q_id)""")
def _(spark, d):
    longest = docs(spark, d).where(F.col("n_chars").isNotNull()).orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    ranked = longest.crossJoin(spark.range(len(QUERYSET)).select(F.col("id").cast("int").alias("q_id")))  # ten rows by eight
    return V.ir_metrics(ranked, relevance(spark, d), "q_id", "doc_id")


@query("representative_docs", f"""WITH {CENT}, x AS (SELECT u.label, u.vec_id, round(list_dot_product(v, c), 4) AS conf, CASE WHEN len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\[deleted\\]|\\[removed\\]', ' ', 'g'), '[^A-Za-z\\x{{0900}}-\\x{{097f}} ]', ' ', 'g'), ' '), lambda w: w <> '')) >= 12 THEN 1 ELSE 0 END AS ok FROM u JOIN c ON u.label = c.label LEFT JOIN documents ON doc_id = vec_id),
p AS (SELECT *, sum(ok) OVER (PARTITION BY label) >= 5 AS e FROM x), r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY conf DESC, vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM p WHERE NOT e OR ok = 1)
SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY i) AS INTEGER) AS pick, vec_id FROM r WHERE i < 3 OR i = 45 * (n - 1) // 100 OR i = 65 * (n - 1) // 100""")
def _(spark, d):
    c = V.confidence(vecs(spark, d), "label", "embedding", 4).select("label", "vec_id", "confidence")
    x = c.join(docs(spark, d).select(F.col("doc_id").alias("vec_id"), X.is_contentful(F.col("text")).alias("ok")), "vec_id", "left")  # the texts stay where they are
    return V.representative(x, "label", "vec_id", "confidence", F.coalesce("ok", F.lit(False)))


@query("density_clusters")
def _(spark, d):
    return K.density_clusters(vecs(spark, d), "vec_id", "embedding")


@query("topic_hierarchy")
def _(spark, d):
    v = vecs(spark, d)
    return K.average_linkage(V.centroid_pairs(v, "label", "embedding"), v.select("label").distinct())


@query("pca_reduce")
def _(spark, d):
    return K.reduce_pca(vecs(spark, d), "vec_id", "embedding", 5)


# Text

@query("normalize_tokens_map", f"""
WITH m AS (SELECT unnest({list(X.SPELLINGS)}) AS k, unnest({list(X.SPELLINGS.values())}) AS v), w AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(regexp_replace(text, '[^\\x20-\\x7e]', ' ', 'g'), '')), '\\s+')) AS w FROM documents)
SELECT doc_id, count(*) FILTER (w <> '') AS n_words, count(k) FILTER (k <> v) AS n_mapped FROM w LEFT JOIN m ON w = k GROUP BY doc_id""")
def _(spark, d):
    t = docs(spark, d).withColumn("t", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]", " "))
    old = F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != "")
    new = F.filter(F.split(X.normalize_tokens(F.col("t")), " "), lambda w: w != "")
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    return t.select("doc_id", F.size(old).cast("long").alias("n_words"), changed.cast("long").alias("n_mapped"))


@query("normalized_texts")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.normalize_tokens(F.col("text")).alias("normalized"))


@query("phrase_preserve", """
SELECT doc_id, length(regexp_replace(lower(coalesce(text, '')), '\\bmock test\\b', 'mock_test', 'g')) = length(coalesce(text, '')) AS same_length, contains(lower(coalesce(text, '')), 'mock test') AS has_phrase FROM documents""")
def _(spark, d):
    c = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", (F.length(X.preserve_phrases(F.col("text"), {"mock test": "mock_test"})) == F.length(c)).alias("same_length"), F.lower(c).contains("mock test").alias("has_phrase"))


@query("phrase_restore")
def _(spark, d):
    kept = X.preserve_phrases(F.col("text"))
    return docs(spark, d).select("doc_id", kept.alias("preserved"), X.restore_phrases(kept).alias("restored"))


@query("anonymize_text")
def _(spark, d):
    return one_each(posts(spark, d), ["id"], "full_text").select("id", X.anonymize(F.col("full_text"), None, True).alias("anonymous")).distinct()


@query("clean_markup")
def _(spark, d):
    return one_each(posts(spark, d), ["id"], "full_text").select("id", X.Cleaner(aggressive=True)(F.col("full_text")).alias("cleaned"))


@query("clean_links_count", """
SELECT source, count(*) FILTER (contains(coalesce(text, ''), 'https://')) AS with_link, count(*) AS n FROM documents GROUP BY source""")
def _(spark, d):
    kept = X.Cleaner(image_hosts=False, markup=False, forum_links=False, engagement=False)(F.col("text"))
    had = F.coalesce("text", F.lit("")).contains("https://") & ~kept.contains("https://")
    return docs(spark, d).groupBy("source").agg(F.count_if(had).alias("with_link"), F.count("*").alias("n"))


@query("artifact_audit", """
SELECT count(*) FILTER (contains(t, '[removed]')) AS n_removed, count(*) FILTER (contains(t, '[deleted]')) AS n_deleted, count(*) FILTER (contains(t, 'view poll')) AS n_view_poll, count(*) FILTER (contains(t, 'ampx200b')) AS n_ampx200b, count(*) FILTER (contains(t, 'image processing failed')) AS n_image_failed,
count(*) FILTER (contains(t, '[removed]') OR contains(t, '[deleted]') OR contains(t, 'view poll') OR contains(t, 'ampx200b') OR contains(t, 'image processing failed')) AS n_any, count(*) FILTER (regexp_replace(t, '\\s+', '', 'g') = '') AS n_empty, count(*) AS n_texts FROM (SELECT lower(coalesce(body, '')) AS t FROM comments_interaction_annotation)""")
def _(spark, d):
    return X.artifact_audit(annotations(spark, d), "body")


@query("reply_preprocess_chain")
def _(spark, d):
    """Removed and bot texts out, cleaned, spellings mended, phrases kept, short texts out."""
    a = annotations(spark, d)
    body = F.coalesce("body", F.lit(""))
    a = a.where(~(X.strip(body).isin("[deleted]", "[removed]", "[ Removed by Reddit ]") | F.lower(body).rlike("i am a bot|automoderator")))
    a = a.select("comment_id", X.preserve_phrases(X.normalize_tokens(X.Cleaner(aggressive=True)(F.col("body")))).alias("clean_body"))
    return a.where(F.length("clean_body") >= 10).distinct()


@query("keyword_tokens", f"SELECT doc_id, len(list_distinct({WORDS.format(t='text', n=2)})) AS n_distinct, len({WORDS.format(t='text', n=2)}) AS n FROM documents")
def _(spark, d):
    w = X.word_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(w).cast("long").alias("n"))


@query("topic_normalized_frequency")
def _(spark, d):
    w = docs(spark, d).select(F.explode(F.split(X.normalize_for_topics(F.col("text")), " ")).alias("term")).where("term <> ''")
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(500)


# Classification and themes

SMALL = {"support_empathy": [(1.5, "i hear you")], "advice_guidance": [(1.0, "try this"), (1.0, "focus on")], "encouragement_motivation": [(1.0, "keep going")], "humor_meme_coping": [(1.0, "plot twist")]}


def hits_sql(rules) -> str:
    return " + ".join(f"{w} * ((length(t) - length(replace(t, '{k}', ''))) // {len(k)})" for w, k in rules)


@query("rule_classifier_scores", "WITH x AS (SELECT DISTINCT comment_id, ' ' || lower(coalesce(clean_body, '')) || ' ' AS t FROM comments_taxonomy) SELECT comment_id, " + ", ".join(f"{hits_sql([(w, f' {k} ') for w, k in r])} AS {c}" for c, r in SMALL.items()) + " FROM x")
def _(spark, d):
    t = table(spark, d, "comments_taxonomy").select("comment_id", "clean_body").distinct().withColumn("t", F.concat(F.lit(" "), F.lower(F.coalesce("clean_body", F.lit(""))), F.lit(" ")))
    count = lambda k: F.floor((F.length("t") - F.length(F.replace(F.col("t"), F.lit(f" {k} "), F.lit("")))) / (len(k) + 2))
    return t.select("comment_id", *[sum((F.lit(w) * count(k) for w, k in r), F.lit(0.0)).alias(c) for c, r in SMALL.items()])


@query("rule_classifier_labels")
def _(spark, d):
    t = one_each(table(spark, d, "comments_taxonomy"), ["comment_id", "author", "distress_type", "score"], "clean_body")
    got = C.classify(t, "clean_body", "author", "distress_type", "score")
    return got.select("comment_id", *[f"score_{c}" for c in C.CATEGORIES], "primary", "secondary", F.col("confidence_").alias("confidence"))


@query("rule_classifier_distribution")
def _(spark, d):
    t = one_each(table(spark, d, "comments_taxonomy"), ["comment_id", "author", "distress_type", "score"], "clean_body")
    return R.shares(C.classify(t, "clean_body", "author", "distress_type", "score"), "primary")


@query("theme_inference", "WITH x AS (SELECT id, " + ", ".join(f"len(regexp_extract_all(lower(coalesce(cleaned_text, '')), '\\b({p})\\b')) AS h{i}" for i, p in enumerate(C.THEMES.values())) + f""" FROM (SELECT DISTINCT id, regexp_replace(cleaned_text, '[^\\x20-\\x7e]', ' ', 'g') AS cleaned_text FROM posts_merged_final_preprocessed)), y AS (SELECT *, greatest({', '.join(f'h{i}' for i in range(len(C.THEMES)))}) AS m FROM x)
SELECT id, CASE WHEN m = 0 THEN 'Unassigned' {' '.join(f"WHEN h{i} = m THEN '{k}'" for i, k in enumerate(C.THEMES))} END AS theme, least(1.0, m / 4.0) AS theme_confidence FROM y""")
def _(spark, d):
    p = posts(spark, d).select("id", F.regexp_replace("cleaned_text", r"[^\x20-\x7e]", " ").alias("cleaned_text")).distinct()
    return C.infer_theme(p, "cleaned_text").select("id", "theme", "theme_confidence")


@query("theme_rollup", f"""
SELECT coalesce(theme, 'Unassigned') AS theme, count(*) AS docs, count(DISTINCT t.topic_id) AS n_topics, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, string_agg(DISTINCT CAST(t.topic_id AS VARCHAR), ',' ORDER BY CAST(t.topic_id AS VARCHAR)) AS topics
FROM {TOPIC1} t LEFT JOIN topic_labels l ON t.topic_id = l.topic_id WHERE t.topic_id IS NOT NULL AND t.topic_id <> -1 GROUP BY 1""")
def _(spark, d):
    t = R.lookup(topic1(spark, d).where("topic_id <> -1"), table(spark, d, "topic_labels"), "topic_id", {"theme": "Unassigned"})
    g = t.groupBy("theme").agg(F.count("*").alias("docs"), F.countDistinct("topic_id").alias("n_topics"), F.array_join(F.sort_array(F.collect_set(F.col("topic_id").cast("string"))), ",").alias("topics"))
    return g.withColumn("pct", F.round(100.0 * F.col("docs") / F.sum("docs").over(Window.partitionBy()), 4))


@query("topic_table", f"""
WITH x AS (SELECT t.topic_id, subreddit, lifecycle_stage FROM {TOPIC1} t JOIN {LATEST} p USING (id)), g AS (SELECT topic_id, count(*) AS documents, round(100.0 * count(*) / (SELECT count(*) FROM x), 4) AS percentage FROM x GROUP BY topic_id),
s AS (SELECT topic_id, subreddit FROM (SELECT topic_id, subreddit, count(*) AS n FROM x WHERE subreddit IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, subreddit) = 1)
SELECT CAST(g.topic_id AS DOUBLE) AS topic_id, coalesce(topic_label, 'Unclassified') AS topic_label, documents, percentage, s.subreddit AS top_subreddit FROM g LEFT JOIN s ON s.topic_id IS NOT DISTINCT FROM g.topic_id LEFT JOIN topic_labels l ON l.topic_id = g.topic_id""")
def _(spark, d):
    x = topic1(spark, d).join(latest(spark, d, "subreddit"), "id")
    total = x.agg(F.count("*").alias("total"))
    g = x.groupBy("topic_id").agg(F.count("*").alias("documents"), F.mode("subreddit", True).alias("top_subreddit")).crossJoin(F.broadcast(total))  # one row
    g = R.lookup(g, table(spark, d, "topic_labels"), "topic_id", {"topic_label": "Unclassified"})
    return g.select(F.col("topic_id").cast("double").alias("topic_id"), "topic_label", "documents", F.round(100.0 * F.col("documents") / F.col("total"), 4).alias("percentage"), "top_subreddit")


@query("topic_quality_review", f"""WITH {CTFIDF}, h AS (SELECT topic, CAST(count(*) FILTER (term IN {inlist(X.STOPWORDS)}) AS BIGINT) AS stop_hits, bool_or(regexp_matches(term, 'format=png|x200b|urn%3a|[a-f0-9]{{40,}}|redd\\.it')) AS bad FROM top GROUP BY topic), s AS (SELECT lang AS topic, count(*) AS size FROM documents WHERE lang IS NOT NULL GROUP BY 1)
SELECT topic, stop_hits, size, CASE WHEN stop_hits >= 3 THEN 'REMOVE' WHEN size < 30 THEN 'MERGE' ELSE 'KEEP' END AS action, CASE WHEN bad THEN 'artifact' WHEN 10 - stop_hits <= 2 THEN 'mixed' ELSE 'coherent' END AS quality FROM h JOIN s USING (topic)""")
def _(spark, d):
    h = lang_terms(spark, d).groupBy("topic").agg(F.count_if(F.col("term").isin(*X.STOPWORDS)).alias("stop_hits"), F.bool_or(F.col("term").rlike(C.ARTIFACT_KEYWORD)).alias("bad"))
    s = docs(spark, d).where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("size"))
    return h.join(s, "topic").select("topic", "stop_hits", "size", C.review_topic(F.col("stop_hits"), F.col("size")).alias("action"), C.keyword_quality(F.col("bad"), 10 - F.col("stop_hits")).alias("quality"))


@query("quote_repository")
def _(spark, d):
    x = topic1(spark, d).where("topic_id <> -1").join(latest(spark, d, "full_text"), "id")
    x = R.first_by(x.where(X.is_contentful(F.col("full_text"))), ["topic_id"], [F.desc("score"), F.col("id")], 20)
    return C.infer_theme(x, "full_text").select("topic_id", "id", X.anonymize(F.col("full_text"), 320).alias("quote"), "theme")


# Samples, grids, logs

SAMPLED = "md5(comment_id || '#42')"


@query("balanced_sample", f"""SELECT category, comment_id FROM (SELECT DISTINCT category, comment_id FROM {REPLIES} WHERE category IS NOT NULL AND comment_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY category ORDER BY {SAMPLED}, comment_id) <= 25""")
def _(spark, d):
    x = replies(spark, d).where(F.col("category").isNotNull() & F.col("comment_id").isNotNull()).select("category", "comment_id").distinct()
    return R.sample_per_group(x, ["category"], "comment_id", 25)


@query("stratified_sample", f"""
WITH x AS (SELECT id, lifecycle_stage, CASE WHEN distress_confidence >= 0.8 THEN 'high' WHEN distress_confidence >= 0.5 THEN 'medium' WHEN distress_confidence <= 0.2 THEN 'low' ELSE 'borderline' END AS bucket FROM {LATEST}),
f AS (SELECT *, 0 AS part FROM x QUALIFY row_number() OVER (PARTITION BY lifecycle_stage, bucket ORDER BY md5(id || '#42'), id) <= 15), r AS (SELECT *, 1 AS part FROM x WHERE id NOT IN (SELECT id FROM f))
SELECT id, lifecycle_stage, bucket, part FROM (SELECT * FROM f UNION ALL SELECT * FROM r) ORDER BY part, md5(id || '#42'), id LIMIT 300""")
def _(spark, d):
    x = latest(spark, d, "lifecycle_stage", "distress_confidence").select("id", "lifecycle_stage", R.confidence_bucket(F.col("distress_confidence")).alias("bucket"))
    return R.stratified_sample(x, ["lifecycle_stage", "bucket"], "id", 15, 300)


@query("proportional_sample", f"""
WITH x AS (SELECT DISTINCT category, comment_id FROM {REPLIES} WHERE category IS NOT NULL AND comment_id IS NOT NULL), q AS (SELECT category, greatest(1, least(3, count(*) // 100)) AS q FROM x GROUP BY 1)
SELECT category, comment_id FROM (SELECT category, comment_id, row_number() OVER (PARTITION BY category ORDER BY {SAMPLED}, comment_id) AS r FROM x) JOIN q USING (category) WHERE r <= q""")
def _(spark, d):
    x = replies(spark, d).where(F.col("category").isNotNull() & F.col("comment_id").isNotNull()).select("category", "comment_id").distinct()
    return R.proportional_sample(x, "category", "comment_id").select("category", "comment_id")


@query("fixed_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '#42'), doc_id LIMIT 200")
def _(spark, d):
    return R.fixed_sample(docs(spark, d).select("doc_id"), "doc_id", 200)


GRID = {"min_size": (100, 150, 200, 300), "samples": (5, 10, 15, 20), "neighbors": (15, 30, 50), "components": (5, 10, 15), "method": ("eom", "leaf")}


def grid(spark):
    out = spark.range(1).select()
    for c, xs in GRID.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, xs))).alias(c))
    return R.ranked(out, [F.col(c) for c in GRID], name="run_id")


GRIDSQL = "SELECT CAST(row_number() OVER (ORDER BY min_size, samples, neighbors, components, method) AS INTEGER) AS run_id, * FROM " + " CROSS JOIN ".join(f"(SELECT {'' if isinstance(xs[0], str) else 'CAST('}unnest({list(xs)}){'' if isinstance(xs[0], str) else ' AS INTEGER)'} AS {c})" for c, xs in GRID.items())


@query("config_grid_288", GRIDSQL)
def _(spark, d):
    return grid(spark)


@query("resume_anti_join", f"SELECT run_id FROM ({GRIDSQL}) WHERE run_id % 7 <> 0")
def _(spark, d):
    return R.resume(grid(spark), spark.range(0, 289, 7).select(F.col("id").cast("int").alias("run_id")), "run_id").select("run_id")


@query("sanity_gate", """
WITH x AS (SELECT source, count(DISTINCT lang) AS n_topics, round(avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END), 6) AS outlier_rate FROM documents GROUP BY source)
SELECT source, n_topics, outlier_rate, CASE WHEN n_topics < 6 THEN 'too few topics: ' || n_topics WHEN outlier_rate > 0.7 THEN 'too many outliers' END AS reason, NOT (n_topics < 6 OR outlier_rate > 0.7) AS valid FROM x""")
def _(spark, d):
    x = docs(spark, d).groupBy("source").agg(F.countDistinct("lang").alias("n_topics"), F.round(F.avg(F.when(F.col("lang").isNull(), 1.0).otherwise(0.0)), 6).alias("outlier_rate"))
    return R.sanity_gate(x, "n_topics", "outlier_rate")


# Extensions over event time

@query("ext_events_tumbling_hour", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    got = E.windowed(table(spark, d, "events"), "ts", "1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("ext_user_sessions", """
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), y AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, k""")
def _(spark, d):
    return E.sessions(table(spark, d, "events"), "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
