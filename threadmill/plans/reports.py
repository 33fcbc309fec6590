"""More queries of the driver's contract: coherence as published, retrieval, comparisons of models, rules from tables, sources and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from threadmill.functions import rules as U
from threadmill.functions import text as X
from threadmill.operators import classify as C
from threadmill.operators import relational as R
from threadmill.operators import stats as S
from threadmill.operators import topics as T
from threadmill.operators import vectors as V
from threadmill.plans.catalogue import CENT, CTFIDF, LATEST, QSQL, QUERIES, QUERYSET, REPLIES, SQL, SUPPORT, TOPIC1, UNIT, WORDS, annotations, docs, inlist, lang_terms, latest, per_source, posts, query, relevance, replies, topic1, two_labelings, vecs
from threadmill.session import scratch, table
from threadmill.sources import io

# Coherence


def windows_sql(size: int, top: str = "top") -> str:
    """CTEs with single and pair counts of keywords in sliding windows."""
    return f"""
d AS (SELECT doc_id, {WORDS.format(t='text', n=2)} AS ws FROM documents), e AS (SELECT * FROM d WHERE len(ws) > 0),
total AS (SELECT sum(greatest(1, len(ws) - {size - 1})) AS w FROM e),
pos AS (SELECT doc_id, len(ws) AS len, unnest(ws) AS term, unnest(range(len(ws))) AS p FROM e),
win AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, p - {size - 1}), least(p, greatest(0, len - {size})) + 1)) AS k FROM pos WHERE term IN (SELECT term FROM {top})),
s AS (SELECT term, count(*) AS n FROM win GROUP BY term),
pr AS (SELECT a.topic, a.term AS a, b.term AS b, a.rank AS ra, b.rank AS rb FROM {top} a JOIN {top} b ON a.topic = b.topic),
j AS (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT a, b FROM pr) JOIN win x ON x.term = a JOIN win y ON y.term = b AND y.doc_id = x.doc_id AND y.k = x.k GROUP BY a, b),
v AS (SELECT topic, pr.a, pr.b, ra, rb, j.n AS met, coalesce(j.n, 0) / w AS p, sa.n / w AS pa, sb.n / w AS pb FROM pr JOIN s sa ON sa.term = pr.a JOIN s sb ON sb.term = pr.b LEFT JOIN j ON j.a = pr.a AND j.b = pr.b CROSS JOIN total)"""


NPMI = "ln((p + 1e-12) / (pa * pb)) / -ln(p + 1e-12)"
CV = f"""x AS (SELECT topic, a, b, CASE WHEN met IS NULL THEN 0.0 ELSE coalesce({NPMI}, 0.0) END AS x FROM v), sum_ AS (SELECT topic, b, sum(x) AS s FROM x GROUP BY topic, b),
cos_ AS (SELECT x.topic, a, sum(x * s) / nullif(sqrt(sum(x * x)) * sqrt(sum(s * s)), 0) AS c FROM x JOIN sum_ ON sum_.topic = x.topic AND sum_.b = x.b GROUP BY x.topic, a)"""
SQL["cv_coherence"] = f"WITH {CTFIDF}, {windows_sql(110)}, {CV} SELECT topic, round(avg(coalesce(c, 0)), 6) AS c_v FROM cos_ GROUP BY topic"


def known_sql(no_below: int, no_above: float, least: int, topics: int) -> str:
    return f"""
dd AS (SELECT list_distinct({WORDS.format(t='text', n=2)}) AS ws FROM documents), dn AS (SELECT count(*) AS n FROM dd WHERE len(ws) > 0),
df AS (SELECT term FROM (SELECT unnest(ws) AS term FROM dd) GROUP BY term HAVING count(*) >= {no_below} AND count(*) <= {no_above} * (SELECT n FROM dn)),
kt AS (SELECT * FROM top WHERE term IN (SELECT term FROM df)), kg AS (SELECT topic FROM kt GROUP BY topic HAVING count(*) >= {least}),
kn AS (SELECT * FROM kt WHERE topic IN (SELECT topic FROM kg) AND (SELECT count(*) FROM kg) >= {topics})"""


def known(spark, d, no_below: int, no_above: float, least: int, topics: int):
    return T.known_keywords(lang_terms(spark, d), T.dictionary(docs(spark, d), "doc_id", "text", no_below, no_above), "topic", least, topics)


@query("coherence_filtered", f"WITH {CTFIDF}, {known_sql(5, 0.5, 3, 2)}, {windows_sql(10, 'kn')} SELECT coalesce(round(avg(c), 6), 0.0) AS c_npmi, count(*) AS n_topics FROM (SELECT topic, avg({NPMI}) AS c FROM v WHERE ra < rb GROUP BY topic)")
def _(spark, d):
    got = T.coherence_npmi(docs(spark, d), "doc_id", "text", known(spark, d, 5, 0.5, 3, 2), "topic", digits=12)
    return got.agg(F.coalesce(F.round(F.avg("c_npmi"), 6), F.lit(0.0)).alias("c_npmi"), F.count("*").alias("n_topics"))


@query("coherence_benchmark_cv", f"WITH {CTFIDF}, {known_sql(2, 0.9, 1, 1)}, {windows_sql(110, 'kn')}, {CV} SELECT topic, round(avg(coalesce(c, 0)), 6) AS c_v FROM cos_ GROUP BY topic")
def _(spark, d):
    return T.coherence_cv(docs(spark, d), "doc_id", "text", known(spark, d, 2, 0.9, 1, 1), "topic")


@query("theme_quality", f"""WITH {CENT}, x AS (SELECT u.label, list_dot_product(v, c) AS conf FROM u JOIN c ON u.label = c.label)
SELECT coalesce(theme, 'Unassigned') AS theme, count(DISTINCT label) AS n_topics, round(avg(m), 4) AS mean_confidence FROM (SELECT label, avg(conf) AS m FROM x GROUP BY label) LEFT JOIN topic_labels ON topic_id = label GROUP BY 1""")
def _(spark, d):
    per = V.confidence(vecs(spark, d), "label", "embedding", 12).groupBy(F.col("label").alias("topic_id")).agg(F.avg("confidence").alias("m"))
    got = R.lookup(per, table(spark, d, "topic_labels"), "topic_id", {"theme": "Unassigned"})
    return got.groupBy("theme").agg(F.countDistinct("topic_id").alias("n_topics"), F.round(F.avg("m"), 4).alias("mean_confidence"))


SCORED = CTFIDF.split("top AS")[0].rstrip().rstrip(",").replace("round(n / size * ln(1 + a / f), 6)", "n / size * ln(1 + a / f)")


def scored_terms(spark, d):
    return T.ctfidf(T.class_counts(docs(spark, d).select(F.col("lang").alias("topic"), "text"), "topic", "text"), "topic")


@query("ctfidf_topic_similarity", f"""WITH {SCORED}, nm AS (SELECT topic, sqrt(sum(score * score)) AS norm FROM score GROUP BY topic),
p AS (SELECT a.topic AS i, b.topic AS j, a.norm * b.norm AS nn FROM nm a JOIN nm b ON a.topic < b.topic), dt AS (SELECT a.topic AS i, b.topic AS j, sum(a.score * b.score) AS dot FROM score a JOIN score b ON a.term = b.term AND a.topic < b.topic GROUP BY ALL)
SELECT round(coalesce(avg(coalesce(dot / nn, 0)), 0), 6) AS inter_sim_ctfidf FROM p LEFT JOIN dt ON dt.i = p.i AND dt.j = p.j""")
def _(spark, d):
    return T.topic_similarity(scored_terms(spark, d), "topic")


@query("coherence_proxy", f"WITH {SCORED} SELECT round(avg(m), 6) AS proxy FROM (SELECT max(score) AS m FROM score GROUP BY topic)")
def _(spark, d):
    return T.coherence_proxy(scored_terms(spark, d), "topic")


@query("benchmark_vocabulary", f"WITH t AS (SELECT doc_id, unnest(list_filter({WORDS.format(t='text', n=2)}, lambda w: regexp_matches(w, '^[a-z]'))) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term ORDER BY tf DESC, term LIMIT 10000")
def _(spark, d):
    return T.vocabulary(docs(spark, d), "doc_id", "text", 1, 1.0, 10_000, (), False)


@query("update_topics", f"""WITH x AS (SELECT doc_id, text, CASE WHEN lang IS NULL THEN 'none' WHEN lang IN ('de', 'fr') THEN 'de+fr' ELSE lang END AS topic FROM documents),
tok AS (SELECT topic, unnest({WORDS.format(t='text', n=3)}) AS term FROM x), n AS (SELECT topic, term, count(*) AS n FROM tok GROUP BY ALL), size AS (SELECT topic, sum(n) AS size FROM n GROUP BY topic), mean AS (SELECT floor(avg(size)) AS a FROM size), freq AS (SELECT term, sum(n) AS f FROM n GROUP BY term),
sc AS (SELECT topic, term, round(n / size * ln(1 + a / f), 6) AS score FROM n JOIN size USING (topic) JOIN freq USING (term) CROSS JOIN mean)
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS INTEGER) AS rank, term, score FROM sc WHERE score > 0 QUALIFY rank <= 10""")
def _(spark, d):
    """Keywords anew after documents were relabelled: two topics merged, the unlabelled ones a topic of their own."""
    topic = F.when(F.col("lang").isNull(), "none").when(F.col("lang").isin("de", "fr"), "de+fr").otherwise(F.col("lang"))
    n = T.class_counts(docs(spark, d).select(topic.alias("topic"), "text"), "topic", "text")
    return T.top_terms(T.ctfidf(n, "topic"), "topic")


# Retrieval

COS = f"""u AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings), sm AS (SELECT q.vec_id AS q_id, q.label AS ql, x.vec_id AS vec_id, x.label AS xl, round(list_dot_product(q.v, x.v), 4) AS sim FROM u q CROSS JOIN u x WHERE q.vec_id % 100 = 0),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM sm QUALIFY rank <= 10)"""
RELS = "rl AS (SELECT q.vec_id AS q_id, x.vec_id AS vec_id, q.label AS ql, CASE WHEN q.vec_id % 7 = x.vec_id % 7 THEN 1.0 ELSE 0.5 END AS rel FROM embeddings q JOIN embeddings x ON q.label = x.label WHERE q.vec_id % 100 = 0)"
IR = f"""WITH {COS}, {RELS},
g AS (SELECT rk.q_id, rank, coalesce(rel, 0.0) AS rel, sum(CASE WHEN coalesce(rel, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rk.q_id ORDER BY rank) AS h FROM rk LEFT JOIN rl ON rl.q_id = rk.q_id AND rl.vec_id = rk.vec_id),
pq AS (SELECT q_id, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS n, min(CASE WHEN rel > 0 THEN rank END) AS f, avg(CASE WHEN rel > 0 THEN h / rank END) AS ap, sum(rel / log2(rank + 1.0)) AS dcg FROM g GROUP BY q_id),
tq AS (SELECT q_id, count(*) AS nr FROM rl GROUP BY q_id), iq AS (SELECT q_id, sum(rel / log2(k + 1.0)) AS idcg FROM (SELECT q_id, rel, row_number() OVER (PARTITION BY q_id ORDER BY rel DESC, vec_id) AS k FROM rl QUALIFY k <= 10) GROUP BY q_id),
ms AS (SELECT q_id, round(coalesce(n / 10.0, 0), 6) AS p, round(coalesce(n / nr, 0), 6) AS r, round(coalesce(1.0 / f, 0), 6) AS mrr, round(coalesce(ap, 0), 6) AS ap, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM pq LEFT JOIN tq USING (q_id) LEFT JOIN iq USING (q_id))"""


def cosine_metrics(spark, d):
    """Measures of the cosine ranking; what shares the query's label is relevant, in two grades."""
    v = vecs(spark, d)
    q = v.where("vec_id % 100 = 0")
    ranked = V.nearest(q.select(F.col("vec_id").alias("q_id"), "embedding"), v, "q_id", "vec_id", "embedding", 10, 4)
    rel = v.select("vec_id", "label").join(F.broadcast(q.select(F.col("vec_id").alias("q_id"), "label")), "label")  # the stated queries
    rel = rel.select("q_id", "vec_id", F.when(F.col("q_id") % 7 == F.col("vec_id") % 7, 1.0).otherwise(0.5).alias("rel"))
    return V.ir_metrics(ranked, rel, "q_id", "vec_id"), q.select(F.col("vec_id").alias("q_id"), "label")


@query("ir_metrics_of_cosine_ranking", f"{IR} SELECT q_id, p, r, mrr, ap, ndcg FROM ms")
def _(spark, d):
    return cosine_metrics(spark, d)[0]


METRICS = ("p", "r", "mrr", "ap", "ndcg")


@query("metric_summary", f"{IR} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 4) AS mean, round(stddev_pop({m}), 4) AS std FROM ms" for m in METRICS))
def _(spark, d):
    return V.metric_summary(cosine_metrics(spark, d)[0], list(METRICS), digits=4)


@query("metric_by_category", f"{IR} SELECT label, 'ndcg' AS metric, round(avg(ndcg), 4) AS mean, round(stddev_pop(ndcg), 4) AS std FROM ms JOIN embeddings ON vec_id = q_id GROUP BY label")
def _(spark, d):
    m, q = cosine_metrics(spark, d)
    return V.metric_summary(m.join(q, "q_id"), ["ndcg"], "label", 4)


KEYWORDS = (("mock", "rank", "percentile", "test"), ("placement", "offer", "season"), ("panic", "dark", "thought"), ("family", "parent", "strict"), ("coaching", "fee", "refund"), ("sleep", "burn"), ("cod", "contest", "rating"), ("visa", "loan", "interview"))


@query("substring_relevance_at_10", "WITH k AS (" + " UNION ALL ".join(f"SELECT {i} AS q_id, {list(ks)} AS ks" for i, ks in enumerate(KEYWORDS)) + f"), q AS ({QSQL}), " + f"""qw AS (SELECT q_id, unnest(list_distinct({WORDS.format(t='q', n=2)})) AS w, len(list_distinct({WORDS.format(t='q', n=2)})) AS size FROM q), dw AS (SELECT doc_id, unnest(list_distinct({WORDS.format(t='text', n=2)})) AS w FROM documents),
rel AS (SELECT q_id, doc_id, round(count(*) / any_value(size), 6) AS rel FROM dw JOIN qw USING (w) GROUP BY ALL), top AS (SELECT q_id, doc_id FROM rel QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rel DESC, doc_id) <= 10)
SELECT q_id, round(avg(len(list_filter(ks, lambda x: contains(lower(substring(coalesce(text, ''), 1, 150)), x))) / len(ks)), 6) AS relevance FROM top JOIN k USING (q_id) JOIN documents USING (doc_id) GROUP BY q_id""")
def _(spark, d):
    top = R.first_by(relevance(spark, d), ["q_id"], [F.desc("rel"), F.col("doc_id")], 10).withColumn("rank", F.lit(1))
    words = spark.createDataFrame([(i, list(ks)) for i, ks in enumerate(KEYWORDS)], "q_id int, keywords array<string>")
    return V.substring_relevance(top.join(docs(spark, d).select("doc_id", "text"), "doc_id"), words, "q_id", "text")


@query("graded_relevance_labels", f"""WITH q AS ({QSQL}), qw AS (SELECT q_id, unnest(list_distinct({WORDS.format(t='q', n=2)})) AS w FROM q), dw AS (SELECT doc_id, unnest(list_distinct({WORDS.format(t='text', n=2)})) AS w FROM documents),
o AS (SELECT q_id, doc_id, count(*) AS n FROM dw JOIN qw USING (w) GROUP BY ALL) SELECT q_id, CASE WHEN n >= 3 THEN 'relevant' ELSE 'partially_relevant' END AS label, count(*) AS n FROM o GROUP BY ALL""")
def _(spark, d):
    q = spark.createDataFrame(list(enumerate(QUERYSET)), "q_id int, q string")
    size = q.select("q_id", F.size(F.array_distinct(X.word_tokens(F.col("q")))).alias("size"))
    got = relevance(spark, d).join(F.broadcast(size), "q_id").withColumn("label", V.graded_label(F.round(F.col("rel") * F.col("size"))))
    return got.groupBy("q_id", "label").agg(F.count("*").alias("n"))


LETTERS = "aeinrst"


def letter_model():
    """A model that counts letters: stands in for one that the caller brings."""
    return lambda texts: np.array([[t.count(c) for c in LETTERS] for t in texts], np.float32)


@query("embed_with_model", "SELECT doc_id, " + ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE) AS {c}" for c in LETTERS) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def _(spark, d):
    e = V.embed(docs(spark, d), "doc_id", "text", letter_model, len(LETTERS))
    e = V.check_dimension(e, "embedding", len(LETTERS))
    return e.select("doc_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(LETTERS)])


@query("length_sorted_batches", "SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 64 AS batch FROM documents WHERE n_chars IS NOT NULL")
def _(spark, d):
    return R.length_batches(docs(spark, d).where(F.col("n_chars").isNotNull()), "doc_id", "n_chars")


# Topics compared and described

PAIRS = f"WITH {CENT}, p AS (SELECT a.label AS i, b.label AS j, round(list_dot_product(a.c, b.c), 4) AS sim FROM c a JOIN c b ON a.label < b.label)"


@query("redundancy_top20", f"{PAIRS} SELECT i, j, sim, sim > 0.92 AS is_edge FROM p ORDER BY sim DESC, i, j LIMIT 20")
def _(spark, d):
    p = V.centroid_pairs(vecs(spark, d), "label", "embedding", 4)
    return p.withColumn("is_edge", F.col("sim") > 0.92).orderBy(F.desc("sim"), "i", "j").limit(20)


@query("least_coherent_topics", f"WITH {CENT}, x AS (SELECT u.label, round(avg(list_dot_product(v, c)), 4) AS mean_confidence FROM u JOIN c ON u.label = c.label GROUP BY 1) SELECT label, mean_confidence FROM x ORDER BY mean_confidence, label LIMIT 5")
def _(spark, d):
    c = V.confidence(vecs(spark, d), "label", "embedding", 12).groupBy("label").agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    return c.orderBy("mean_confidence", "label").limit(5)


@query("domain_themes", f"""WITH {CTFIDF}, dm AS ({' UNION ALL '.join(f"SELECT '{t}' AS theme, {i} AS o, unnest({list(ws)}) AS w" for i, (t, ws) in enumerate(C.DOMAINS.items()))}),
h AS (SELECT topic, theme, o, count(*) AS hits FROM top JOIN dm ON w = term GROUP BY ALL), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY topic ORDER BY hits DESC, o) = 1),
f AS (SELECT topic, list(term ORDER BY rank) FILTER (term NOT IN {inlist(X.STOPWORDS)} AND length(term) > 2) AS ws FROM top GROUP BY topic)
SELECT f.topic, coalesce(theme, array_to_string(list_transform(ws[1:2], lambda w: upper(w[1]) || lower(w[2:])), ' '), 'General Discussion') AS theme, coalesce(hits, 0) AS hits FROM f LEFT JOIN b ON b.topic = f.topic""")
def _(spark, d):
    return C.domain_theme(lang_terms(spark, d), "topic", "term", "rank")


@query("keyword_quality_labels", f"""WITH {CTFIDF} SELECT topic, CASE WHEN bool_or(regexp_matches(term, 'format=png|x200b|urn%3a|[a-f0-9]{{40,}}|redd\\.it')) THEN 'artifact' WHEN count(*) FILTER (term NOT IN {inlist(X.STOPWORDS)}) <= 2 THEN 'mixed' ELSE 'coherent' END AS quality FROM top GROUP BY topic""")
def _(spark, d):
    return C.keyword_labels(lang_terms(spark, d), "topic", "term")


MARKS = ("cooked", "boss", "quest", "canon")


@query("marker_report", f"""
WITH m AS (SELECT unnest({list(MARKS)}) AS marker), x AS (SELECT marker, doc_id, source, lifecycle_stage, n_chars FROM m JOIN documents ON contains(lower(coalesce(text, '')), marker)),
s AS (SELECT marker, string_agg(source || '=' || n, ',' ORDER BY n DESC, source) AS by_source FROM (SELECT marker, source, count(*) AS n FROM x WHERE source IS NOT NULL GROUP BY ALL) GROUP BY marker),
l AS (SELECT marker, string_agg(lifecycle_stage || '=' || n, ',' ORDER BY n DESC, lifecycle_stage) AS by_stage FROM (SELECT marker, lifecycle_stage, count(*) AS n FROM x WHERE lifecycle_stage IS NOT NULL GROUP BY ALL) GROUP BY marker),
q AS (SELECT marker, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars DESC, doc_id) AS quotes FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY marker ORDER BY n_chars DESC, doc_id) <= 5) GROUP BY marker)
SELECT marker, n_docs, by_source, by_stage, quotes FROM (SELECT marker, count(*) AS n_docs FROM x GROUP BY marker) LEFT JOIN s USING (marker) LEFT JOIN l USING (marker) LEFT JOIN q USING (marker)""")
def _(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.filter(F.array(*map(F.lit, MARKS)), lambda m: F.contains(low, m))
    x = docs(spark, d).select("doc_id", "source", "lifecycle_stage", "n_chars", F.explode(hit).alias("marker"))  # texts go no further

    def histogram(c: str, name: str):
        n = x.where(F.col(c).isNotNull()).groupBy("marker", c).agg(F.count("*").alias("n"))
        rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(c).alias("v"))))
        return n.groupBy("marker").agg(F.array_join(F.transform(rows, lambda r: F.concat_ws("=", r["v"], (-r["k"]).cast("string"))), ",").alias(name))

    best = R.first_by(x, ["marker"], [F.desc("n_chars"), F.col("doc_id")], 5)
    quotes = best.groupBy("marker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n_chars")).alias("k"), F.col("doc_id").alias("v")))), lambda r: r["v"].cast("string")), ",").alias("quotes"))
    out = x.groupBy("marker").agg(F.count("*").alias("n_docs"))
    for other in (histogram("source", "by_source"), histogram("lifecycle_stage", "by_stage"), quotes):
        out = out.join(other, "marker", "left")
    return out


@query("corpus_dedup_report", """
SELECT 'rows' AS measure, count(*) AS n FROM posts_merged_final_preprocessed UNION ALL SELECT 'repeated id', count(id) - count(DISTINCT id) FROM posts_merged_final_preprocessed
UNION ALL SELECT 'repeated place and time', count(*) - count(DISTINCT (subreddit, post_timestamp)) FROM (SELECT DISTINCT id, subreddit, post_timestamp FROM posts_merged_final_preprocessed) WHERE subreddit IS NOT NULL AND post_timestamp IS NOT NULL
UNION ALL SELECT 'repeated text', count(*) - count(DISTINCT full_text) FROM (SELECT DISTINCT id, full_text FROM posts_merged_final_preprocessed) WHERE full_text IS NOT NULL""")
def _(spark, d):
    p = posts(spark, d).select("id", "subreddit", "post_timestamp", F.sha2("full_text", 256).alias("h"))
    one = p.groupBy("id").agg(F.count("*").alias("k"), F.first("subreddit").alias("s"), F.first("post_timestamp").alias("t"), F.first("h").alias("h"))
    place = one.where("s is not null and t is not null").groupBy("s", "t").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    text = one.where("h is not null").groupBy("h").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    rows = p.agg(F.count("*").alias("rows"), (F.count("id") - F.countDistinct("id")).alias("repeated id")).unpivot([], ["rows", "repeated id"], "measure", "n")
    return rows.unionByName(place.select(F.lit("repeated place and time").alias("measure"), "n")).unionByName(text.select(F.lit("repeated text").alias("measure"), "n"))


@query("report_topic_keywords", f"WITH {CTFIDF} SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords, round(sum(score), 4) AS weight FROM top GROUP BY topic")
def _(spark, d):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
    return lang_terms(spark, d).groupBy("topic").agg(F.array_join(rows, ", ").alias("keywords"), F.round(F.sum("score"), 4).alias("weight"))


@query("report_distress_summary", f"""
WITH x AS (SELECT coalesce(distress_type, 'none') AS distress_type, t.topic_id FROM {TOPIC1} t LEFT JOIN topic_labels l ON l.topic_id = t.topic_id WHERE t.topic_id IS NOT NULL)
SELECT distress_type, count(*) AS docs, count(DISTINCT topic_id) AS n_topics, round(100.0 * count(*) / (SELECT count(*) FROM x), 4) AS pct FROM x GROUP BY 1""")
def _(spark, d):
    t = R.lookup(topic1(spark, d).where("topic_id is not null"), table(spark, d, "topic_labels"), "topic_id", {"distress_type": "none"})
    total = t.agg(F.count("*").alias("total"))
    g = t.groupBy("distress_type").agg(F.count("*").alias("docs"), F.countDistinct("topic_id").alias("n_topics")).crossJoin(F.broadcast(total))  # one row
    return g.select("distress_type", "docs", "n_topics", F.round(100.0 * F.col("docs") / F.col("total"), 4).alias("pct"))


def report_by(column: str):
    sql = f"""WITH x AS (SELECT coalesce(theme, 'Unassigned') AS theme, {column} AS value FROM {TOPIC1} t JOIN {LATEST} p USING (id) LEFT JOIN topic_labels l ON l.topic_id = t.topic_id WHERE t.topic_id <> -1 AND {column} IS NOT NULL)
SELECT theme, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY theme), 4) AS pct FROM x GROUP BY theme, value"""

    @query(f"report_theme_by_{column}", sql)
    def _(spark, d):
        x = topic1(spark, d).where("topic_id <> -1").join(latest(spark, d, column).where(F.col(column).isNotNull()), "id")
        x = R.lookup(x, table(spark, d, "topic_labels"), "topic_id", {"theme": "Unassigned"})
        return R.crosstab(x.select("theme", F.col(column).alias("value")), "theme", "value", "row")


for _c in ("subreddit", "lifecycle_stage"):
    report_by(_c)


@query("report_responses_by_theme", f"""WITH x AS (SELECT coalesce(theme, 'Unassigned') AS theme, category FROM {REPLIES} r LEFT JOIN topic_labels l ON l.topic_id = r.topic_id WHERE category IS NOT NULL)
SELECT theme, count(*) AS n, round(100.0 * count(*) FILTER (category IN {inlist(SUPPORT)}) / count(*), 4) AS support_pct, round(100.0 * count(*) FILTER (category = 'toxic_abusive') / count(*), 4) AS toxic_pct FROM x GROUP BY theme""")
def _(spark, d):
    x = replies(spark, d).where(F.col("category").isNotNull()).select("topic_id", "category")
    x = R.lookup(x, table(spark, d, "topic_labels"), "topic_id", {"theme": "Unassigned"})
    c = F.col("category")
    return x.groupBy("theme").agg(F.count("*").alias("n"), R.share_of(c.isin(*SUPPORT)).alias("support_pct"), R.share_of(c == "toxic_abusive").alias("toxic_pct"))


# Models compared: sources of documents stand for models

FAMILIES = {"size": ("n", "authors"), "text": ("len",), "gaps": ("short",)}
MODELS = "SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT author) AS DOUBLE) AS authors, avg(n_chars) AS len, CAST(count(*) FILTER (n_chars < 200) AS DOUBLE) AS short FROM documents WHERE source IS NOT NULL GROUP BY source"


@query("model_metric_join", f"SELECT a.source, round(a.n, 6) AS size_n, round(a.authors, 6) AS size_authors, round(b.len, 6) AS text_len, round(c.short, 6) AS gaps_short FROM ({MODELS}) a JOIN ({MODELS}) b ON a.source = b.source JOIN ({MODELS}) c ON a.source = c.source")
def _(spark, d):
    p = per_source(spark, d)
    got = R.join_metrics({k: p.select("source", *cs) for k, cs in FAMILIES.items()}, "source")
    return got.select("source", *[F.round(c, 6).alias(c) for c in got.columns if c != "source"])


SEVEN = {"n": 0.25, "len": 0.10, "authors": 0.20, "short": 0.15, "n_langs": 0.10, "n_null": 0.05, "n_long": 0.15}
SEVENSQL = """SELECT source, CAST(count(*) AS DOUBLE) AS n, avg(n_chars) AS len, CAST(count(DISTINCT author) AS DOUBLE) AS authors, CAST(count(*) FILTER (n_chars < 200) AS DOUBLE) AS short, CAST(count(DISTINCT lang) AS DOUBLE) AS n_langs, CAST(count(*) FILTER (text IS NULL) AS DOUBLE) AS n_null, CAST(count(*) FILTER (n_chars > 1000) AS DOUBLE) AS n_long FROM documents WHERE source IS NOT NULL GROUP BY source"""


def scaled(c: str) -> str:
    s = f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END"
    return f"(1 - ({s}))" if c in ("short", "n_null") else f"({s})"


@query("benchmark_weighted_score", f"SELECT source, round({' + '.join(f'{w} * {scaled(c)}' for c, w in SEVEN.items())}, 6) AS weighted_score FROM ({SEVENSQL})")
def _(spark, d):
    n = F.col("n_chars")
    x = docs(spark, d).where(F.col("source").isNotNull()).groupBy("source").agg(
        F.count("*").cast("double").alias("n"), F.avg(n).alias("len"), F.countDistinct("author").cast("double").alias("authors"), F.count_if(n < 200).cast("double").alias("short"), F.countDistinct("lang").cast("double").alias("n_langs"), F.count_if(F.col("text").isNull()).cast("double").alias("n_null"), F.count_if(n > 1000).cast("double").alias("n_long")
    )
    return R.weighted_score(x, SEVEN, ("short", "n_null")).select("source", "weighted_score")


@query("config_grid_30", "SELECT CAST(row_number() OVER (ORDER BY nb, nc, ms) AS INTEGER) AS run_id, nb, nc, ms FROM (SELECT CAST(unnest([15, 30, 50]) AS INTEGER) AS nb) CROSS JOIN (SELECT CAST(unnest([5, 10]) AS INTEGER) AS nc) CROSS JOIN (SELECT CAST(unnest([100, 150, 250, 300, 400]) AS INTEGER) AS ms)")
def _(spark, d):
    out = spark.range(1).select()
    for c, xs in (("nb", (15, 30, 50)), ("nc", (5, 10)), ("ms", (100, 150, 250, 300, 400))):
        out = out.select("*", F.explode(F.array(*map(F.lit, xs))).alias(c))
    return R.ranked(out, [F.col("nb"), F.col("nc"), F.col("ms")], name="run_id")


ARI3 = f"(SELECT t.id, t.topic_id AS a, c.hi AS b, c.lo AS c FROM {TOPIC1} t JOIN (SELECT post_id AS id, max(topic_id) AS hi, min(topic_id) AS lo FROM comments_taxonomy GROUP BY post_id) c USING (id))"


def ari_pair(x: str, y: str) -> str:
    return f"""(SELECT (ij - i * j / nn) / nullif((i + j) / 2 - i * j / nn, 0) AS ari FROM (SELECT sum(n * (n - 1) / 2.0) AS ij, sum(n) * (sum(n) - 1) / 2.0 AS nn FROM (SELECT {x}, {y}, CAST(count(*) AS DOUBLE) AS n FROM {ARI3} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL))
CROSS JOIN (SELECT sum(n * (n - 1) / 2.0) AS i FROM (SELECT {x}, CAST(count(*) AS DOUBLE) AS n FROM {ARI3} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {x})) CROSS JOIN (SELECT sum(n * (n - 1) / 2.0) AS j FROM (SELECT {y}, CAST(count(*) AS DOUBLE) AS n FROM {ARI3} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {y})))"""


@query("ari_three_labelings", f"SELECT count(*) AS pairs, round(avg(ari), 6) AS mean, round(stddev_pop(ari), 6) AS std FROM ({' UNION ALL '.join(f'SELECT ari FROM {ari_pair(x, y)}' for x, y in ('ab', 'ac', 'bc'))})")
def _(spark, d):
    c = table(spark, d, "comments_taxonomy").groupBy(F.col("post_id").alias("id")).agg(F.max("topic_id").alias("b"), F.min("topic_id").alias("c"))
    x = topic1(spark, d).withColumnRenamed("topic_id", "a").join(c, "id")
    parts = [S.adjusted_rand(x, p, q, digits=12) for p, q in ("ab", "ac", "bc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count("*").alias("pairs"), F.round(F.avg("ari"), 6).alias("mean"), F.round(F.stddev_pop("ari"), 6).alias("std"))


# Probabilities

CHI = SQL["chi_square_cramers_v"].replace("round(chi2, 4) AS chi2", "chi2 / 2 AS h")
ERFC = "CASE WHEN h > 25 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(sqrt(h)) - lgamma(n + 1)) / (2 * n + 1))) END"


@query("chi_square_p_value", f"""WITH q AS ({CHI})
SELECT dof, round(CASE WHEN dof % 2 = 0 THEN list_sum(list_transform(range(dof // 2), lambda i: exp(-h + i * ln(h) - lgamma(i + 1))))
ELSE {ERFC} + list_sum(list_transform(range(1, dof // 2 + 1), lambda i: exp(-h + (i - 0.5) * ln(h) - lgamma(i + 0.5)))) END, 6) AS p FROM q""")
def _(spark, d):
    """With a whole number of degrees of freedom the tail is a finite sum, for odd ones beside an error function; the SQL adds it up."""
    got = S.chi_square(replies(spark, d), "distress_type", "category", 12)
    return got.select("dof", F.round(S.chi_square_tail(F.col("chi2"), F.col("dof").cast("double")), 6).alias("p"))


SQL["mann_whitney_p_value"] = f"""WITH q AS ({SQL['mann_whitney_u_z']}), x AS (SELECT u, z, z / sqrt(2) AS y FROM q)
SELECT u, z, CASE WHEN y > 5 THEN 0.0 WHEN y < -5 THEN 1.0 ELSE round(0.5 - list_sum(list_transform(range(0, 150), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * sign(y) * exp((2 * n + 1) * ln(abs(y) + 1e-300) - lgamma(n + 1)) / (2 * n + 1))) / sqrt(pi()), 6) END AS p FROM x"""


def _p(spark, d):
    got = S.mann_whitney(replies(spark, d), "score", F.coalesce(F.col("category").isin(*SUPPORT), F.lit(False)))
    return got.select("u", "z", F.round(S.normal_tail(F.col("z")), 6).alias("p"))


QUERIES["mann_whitney_p_value"] = _p

# Rules from tables: the labels of topics are the phrases

LABELS = "(SELECT DISTINCT lower(topic_label) AS k, coalesce(theme, 'none') AS c FROM topic_labels WHERE topic_label IS NOT NULL)"


def label_rules(spark, d):
    t = table(spark, d, "topic_labels").where("topic_label is not null")
    return t.select(F.lower("topic_label").alias("keyword"), F.coalesce("theme", F.lit("none")).alias("category"), F.lit(1.5).alias("weight"), F.translate(F.lower("topic_label"), " ", "_").alias("token"))


@query("rule_statistics", f"SELECT len(string_split(k, ' ')) AS n_words, count(*) AS n, min(length(k)) AS shortest, max(length(k)) AS longest FROM {LABELS} GROUP BY 1")
def _(spark, d):
    return U.rule_statistics(label_rules(spark, d), "keyword")


@query("keyword_scores_from_table", f"""WITH d AS (SELECT id, lower(coalesce(full_text, '')) AS t FROM (SELECT DISTINCT id, full_text FROM posts_merged_final_preprocessed)), h AS (SELECT id, c, len(regexp_extract_all(t, '\\b' || k || '\\b')) AS n FROM d JOIN {LABELS} ON contains(t, k))
SELECT id, c AS category, 1.5 * sum(n) AS score FROM h GROUP BY id, c HAVING sum(n) > 0""")
def _(spark, d):
    one = posts(spark, d).groupBy("id").agg(F.first("full_text").alias("full_text"))
    got = one.select("id", F.explode(U.keyword_scores(label_rules(spark, d), F.col("full_text"))).alias("category", "score"))
    return got


@query("phrases_from_table", f"""WITH d AS (SELECT id, lower(coalesce(full_text, '')) AS t FROM (SELECT DISTINCT id, full_text FROM posts_merged_final_preprocessed)) SELECT id, CAST(sum(len(regexp_extract_all(t, '\\b' || k || '\\b'))) AS BIGINT) AS n_tokens FROM d JOIN {LABELS} ON contains(t, k) GROUP BY id HAVING n_tokens > 0""")
def _(spark, d):
    rules = label_rules(spark, d).where(F.col("keyword") != F.col("token"))
    one = posts(spark, d).groupBy("id").agg(F.first("full_text").alias("full_text"))
    kept = F.lower(U.phrase_rewriter(rules, F.col("full_text"), "keyword", "token"))
    single = [r["keyword"] for r in label_rules(spark, d).where(F.col("keyword") == F.col("token")).select("keyword").distinct().collect()]  # a fixed table
    tokens = [r["token"] for r in rules.select("token").distinct().collect()] + single
    n = sum((F.regexp_count(kept, F.lit(rf"\b\Q{t}\E\b")) for t in tokens), F.lit(0))
    return one.select("id", n.cast("long").alias("n_tokens")).where("n_tokens > 0")


# Sources and sinks, by a round trip through the shared folder


def folder(spark) -> str:
    return scratch(spark, "trip")


DOCROWS = "SELECT doc_id, text, source FROM documents"


@query("csv_round_trip", DOCROWS.replace("text", "nullif(text, '') AS text"))
def _(spark, d):
    path, df = folder(spark), docs(spark, d).select("doc_id", "text", "source")
    io.write_csv(df, path)
    return io.read_csv(spark, path, df.schema)


@query("csv_pruned_scan", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    path, df = folder(spark), docs(spark, d).select("doc_id", "source", "lang")
    io.write_csv(df, path)
    return io.read_csv(spark, path, df.schema, ["source"]).groupBy("source").agg(F.count("*").alias("n"))


@query("json_round_trip", "SELECT topic_id, topic_label, theme FROM topic_labels")
def _(spark, d):
    path, df = folder(spark), table(spark, d, "topic_labels").select("topic_id", "topic_label", "theme")
    io.write_json(df, path)
    return io.read_log(spark, path, df.schema)


@query("log_append_and_read", "SELECT source AS config_id, true AS valid FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT lang, false FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(spark, d):
    path, x = folder(spark), docs(spark, d)
    io.append_log(x.where("source is not null").select(F.col("source").alias("config_id"), F.lit(True).alias("valid")).distinct(), path)
    io.append_log(x.where("lang is not null").select(F.col("lang").alias("config_id"), F.lit(False).alias("valid")).distinct(), path)
    return io.read_log(spark, path).select("config_id", "valid")


@query("chunks_written_and_assembled", "SELECT doc_id, n_chars FROM documents")
def _(spark, d):
    path = folder(spark)
    io.write_chunks(docs(spark, d).select("doc_id", "n_chars"), path, F.pmod("doc_id", F.lit(4)).cast("int"))
    return io.assemble_chunks(spark, path, 4).select("doc_id", "n_chars")


@query("written_to_many", "SELECT name, n_nationkey FROM (SELECT n_name AS name, n_nationkey FROM nation) UNION ALL SELECT n_name, n_nationkey FROM nation")
def _(spark, d):
    a, b = folder(spark), folder(spark)
    io.write_many(table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), a, b)
    return spark.read.parquet(a).unionByName(spark.read.parquet(b))


@query("head_limited_scan", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def _(spark, d):
    return io.head(docs(spark, d).select("doc_id", "n_chars"), "doc_id", 50)


@query("optional_join", f"SELECT p.id, coalesce(CAST(t.topic_id AS VARCHAR), '') AS topic_id, '' AS missing FROM {LATEST} p LEFT JOIN {TOPIC1} t ON t.id = p.id")
def _(spark, d):
    p = io.join_optional(latest(spark, d).select("id"), io.read_optional(spark, f"{d}/topics.parquet"), "id", "topic_id")
    return io.join_optional(p, io.read_optional(spark, f"{d}/no_such_table.parquet"), "id", "missing")


@query("column_fallbacks", "SELECT id, CASE WHEN trim(coalesce(cleaned_text, '')) <> '' THEN cleaned_text ELSE trim(concat_ws(' ', title, selftext)) END AS t FROM (SELECT DISTINCT id, cleaned_text, title, selftext FROM posts_merged_final_preprocessed WHERE cleaned_text IS NOT NULL AND trim(cleaned_text) <> '')")
def _(spark, d):
    p = posts(spark, d).select("id", "cleaned_text", "title", "selftext").where("cleaned_text is not null and trim(cleaned_text) <> ''").distinct()
    return p.select("id", R.text_fallback(p, ["no_such_column", "cleaned_text"], ["title", "selftext"]).alias("t"))
