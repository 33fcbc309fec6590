"""Rule-based classification of replies with weighted keywords, and of topics into themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.text import STOPWORDS, strip

#: Categories in order; ties go to the first.
CATEGORIES = ("support_empathy", "advice_guidance", "personal_experience", "encouragement_motivation", "information_resources", "neutral_discussion", "humor_meme_coping", "dismissive_minimizing", "toxic_abusive", "blame_criticism", "self_disclosure", "crisis_escalation")
# A small default rule set of our own, weight and keywords for each category.
RULES: dict[str, list[tuple[float, str]]] = {
    "support_empathy": [(1.5, "i hear you"), (1.5, "tension mat le"), (1.0, "you are not alone"), (1.0, "sending hugs"), (1.0, "sab theek")],
    "advice_guidance": [(1.0, "try this"), (1.0, "i would suggest"), (1.0, "focus on"), (1.0, "meri maano"), (1.0, "make a short plan"), (0.5, "skip")],
    "personal_experience": [(1.0, "happened with me"), (1.0, "as well"), (0.5, "hamare yahan"), (0.5, "i was")],
    "encouragement_motivation": [(1.0, "keep going"), (1.0, "do not give up"), (1.0, "you can still do this"), (1.0, "himmat rakh"), (1.0, "haar mat maan")],
    "information_resources": [(1.0, "cutoff was"), (1.0, "free sheet"), (1.0, "notice says"), (0.5, "last date"), (0.5, "closes in")],
    "neutral_discussion": [],
    "humor_meme_coping": [(1.0, "plot twist"), (1.0, "final boss"), (1.0, "level"), (0.5, "unlocked"), (0.5, "funeral")],
    "dismissive_minimizing": [(1.5, "you are not special"), (1.0, "making it a drama"), (1.0, "itna kya rona")],
    "toxic_abusive": [(2.0, "loser"), (2.0, "idiot"), (2.0, "moron"), (2.0, "nalayak"), (1.5, "get lost"), (1.5, "shut up")],
    "blame_criticism": [(1.5, "galti teri"), (1.5, "this is on you"), (1.0, "of course"), (1.0, "you wasted")],
    "self_disclosure": [(1.0, "i have been"), (1.0, "main khud"), (0.5, "never told")],
    "crisis_escalation": [(2.0, "talk to a counsellor"), (2.0, "do not stay alone"), (1.5, "helpline"), (1.0, "this sounds serious")],
}
# Short texts that are nothing but a laugh, and what bots say.
SHORT_HUMOR = ("lol", "lmao", "rofl", "haha", "hehe", "xd", "bruh", "rip", "f")
EMOJI = "[\\x{1F480}\\x{1F62D}\\x{1F921}\\x{1F602}\\x{1FAE0}\\x{1F923}]"
BOT = r"auto\s*moderator|i am a bot|this action was performed automatically|contact the moderators|report it using"
SENSITIVE = ("suicidal", "depression_anxiety", "academic_burnout")


def keyword_score(text: Column, rules: Sequence[tuple[float, str]]) -> Column:
    """Weights times occurrences of keywords between word boundaries. One expression a keyword keeps it in generated code."""
    total = F.lit(0.0)
    for weight, keyword in rules:
        total = total + F.lit(float(weight)) * F.regexp_count(text, F.lit(rf"(?U)\b\Q{keyword}\E\b"))
    return total


def classify(df: DataFrame, text: str, author: str, parent: str, score: str, rules: Mapping[str, Sequence[tuple[float, str]]] = RULES, digits: int = 3) -> DataFrame:
    """Adds score_<category>, primary, secondary and confidence_.

    Null and very short texts, bots and texts of two words are settled at once; each later
    rule sees what the earlier ones did to the scores; ties go to the first category; without any score
    the text is neutral with confidence 0 and no secondary.
    """
    t = strip(F.coalesce(F.col(text), F.lit("")))
    low = F.lower(t)
    words = F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""))
    emoji = F.regexp_count(t, F.lit(EMOJI))
    bot = F.coalesce(F.lower(F.col(author)) == "automoderator", F.lit(False)) | low.rlike(BOT)
    short_fun = (emoji > 0) | low.isin(*SHORT_HUMOR)
    out = df.withColumns({"__low": low, "__words": words, "__emoji": emoji, "__case": F.when(F.length(t) < 3, "neutral").when(bot, "neutral").when(words <= 2, F.when(short_fun, "humor").otherwise("neutral")).otherwise("score")})
    s = {c: f"score_{c}" for c in CATEGORIES}
    out = out.withColumns({s[c]: keyword_score(F.col("__low"), rules.get(c, ())) for c in CATEGORIES})
    col = lambda c: F.col(s[c])
    steps = [
        {"humor_meme_coping": F.when(F.col("__emoji") >= 2, 1.5 * F.col("__emoji")).otherwise(0.0) + F.when(F.col("__emoji") >= 3, 3.0).otherwise(0.0)},
        {"neutral_discussion": F.when(F.col("__low").contains("?") & (F.greatest(*[col(c) for c in CATEGORIES]) < 2), 1.0).otherwise(0.0)},
        {"toxic_abusive": F.when(F.col(score) < -1, 1.0).otherwise(0.0), "blame_criticism": F.when(F.col(score) < -1, 0.5).otherwise(0.0)},
        {"advice_guidance": F.when((F.col(score) > 10) & (col("advice_guidance") > 0), 1.0).otherwise(0.0)},
        {"advice_guidance": F.when(F.col("__words") > 80, 2.0).otherwise(0.0)},
        {"toxic_abusive": F.when((F.col("__words") <= 5) & (col("toxic_abusive") > 0), 1.0).otherwise(0.0)},
    ]
    first = F.col("__low").rlike("^(i |mujhe |meri |mere )")
    either = (col("personal_experience") > 0) | (col("self_disclosure") > 0)
    steps.append({c: F.when(first & either, 0.5).otherwise(0.0) for c in ("personal_experience", "self_disclosure")})
    steps.append({"crisis_escalation": F.when(F.col(parent).isin(*SENSITIVE) & (col("crisis_escalation") > 0), 0.5).otherwise(0.0)})
    for step in steps:
        out = out.withColumns({s[c]: col(c) + x for c, x in step.items()})
    scored = F.col("__case") == "score"
    out = out.withColumns({s[c]: F.when(scored, col(c)).when((F.col("__case") == "humor") & F.lit(c == "humor_meme_coping"), 3.0).otherwise(0.0) for c in CATEGORIES})
    order = F.array_sort(F.array(*[F.struct((-col(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CATEGORIES)]))
    total = sum((col(c) for c in CATEGORIES), F.lit(0.0))
    a, b = order[0], order[1]
    out = out.withColumn("__a", a).withColumn("__b", b).withColumn("__t", total)
    some = -F.col("__a.s") > 0
    return out.withColumns({
        "primary": F.when(F.col("__case") == "humor", "humor_meme_coping").when(scored & some, F.col("__a.c")).otherwise("neutral_discussion"),
        "secondary": F.when(scored & (-F.col("__b.s") > 0), F.col("__b.c")),
        "confidence_": F.when(scored, F.round(-F.col("__a.s") / (F.col("__t") + 0.01), digits)).otherwise(1.0),
    }).drop("__low", "__words", "__emoji", "__case", "__a", "__b", "__t")


# Themes of our own with their words.
THEMES = {
    "exam_pressure": "rank|percentile|mock|exam|cutoff|syllabus|test|marks", "career": "placement|internship|interview|job|offer|resume|recruiter|package", "family": "parents|papa|mummy|family|relatives|marriage|father|mother",
    "wellbeing": "panic|anxiety|lonely|alone|sleep|burnout|tired|hopeless", "institution": "coaching|college|attendance|faculty|fees|batch|centre", "memes": "copium|hopium|boss|quest|canon|meme|joke|respawn",
}


def theme_scores(text: Column, themes: Mapping[str, str] = THEMES) -> Column:
    """The theme whose words occur most; of equals the first. A struct (theme, hits)."""
    got = [F.struct(F.regexp_count(text, F.lit(rf"(?U)\b({p})\b")).alias("hits"), F.lit(-i).alias("o"), F.lit(k).alias("theme")) for i, (k, p) in enumerate(themes.items())]
    return F.greatest(*got)


def infer_theme(df: DataFrame, text: str, themes: Mapping[str, str] = THEMES) -> DataFrame:
    """Adds theme ('Unassigned' without hits) and theme_confidence = min(1, hits / 4)."""
    best = theme_scores(F.lower(F.coalesce(F.col(text), F.lit(""))), themes)
    return df.withColumn("__b", best).withColumns({"theme": F.when(F.col("__b.hits") > 0, F.col("__b.theme")).otherwise("Unassigned"), "theme_confidence": F.least(F.lit(1.0), F.col("__b.hits") / 4.0)}).drop("__b")


def review_topic(stop_hits: Column, size: Column) -> Column:
    return F.when(stop_hits >= 3, "REMOVE").when(size < 30, "MERGE").otherwise("KEEP")


def keyword_quality(artifact: Column, content_words: Column) -> Column:
    return F.when(artifact, "artifact").when(content_words <= 2, "mixed").otherwise("coherent")


# What shows that a keyword is left over from links and markup.
ARTIFACT_KEYWORD = r"(?i)format=png|format=pjpg|auto=webp|x200b|urn%3a|s=[a-f0-9]{32,}|[a-f0-9]{40,}|preview\.redd|redd\.it"
# Domains of our own with the keywords that belong to them.
DOMAINS = {
    "Exams": ("exam", "mock", "rank", "percentile", "cutoff", "marks", "test", "paper", "syllabus"), "Jobs": ("job", "offer", "placement", "internship", "interview", "resume", "recruiter", "stipend"),
    "Study life": ("class", "lecture", "notes", "library", "hostel", "mess", "attendance", "semester"), "Mind": ("anxiety", "panic", "sleep", "burnout", "lonely", "therapy", "stress"), "Family": ("mother", "father", "parents", "family", "cousin", "mummy", "papa"),
    "Chat": ("hai", "nahi", "bhai", "yaar", "kya", "main", "aur", "mein"),
}


def domain_theme(keywords: DataFrame, topic: str, word: str, rank: str, domains: Mapping[str, Sequence[str]] = DOMAINS, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """(topic, theme, hits): the domain that most of a topic's keywords belong to; of equals the first.

    Without a hit, the first two keywords that are no stop words and longer than two characters, in title case, or 'General Discussion'.
    """
    rows = [(d, i, w) for i, (d, ws) in enumerate(domains.items()) for w in ws]
    table = keywords.sparkSession.createDataFrame(rows, "theme string, o int, w string")
    hits = keywords.join(F.broadcast(table), F.col(word) == F.col("w")).groupBy(topic, "theme", "o").agg(F.count("*").alias("hits"))
    best = hits.groupBy(topic).agg(F.max(F.struct(F.col("hits"), (-F.col("o")).alias("o"), F.col("theme"))).alias("b"))
    own = F.when(~F.col(word).isin(*stop) & (F.length(word) > 2), F.struct(F.col(rank).alias("r"), F.col(word).alias("w")))
    rest = keywords.groupBy(topic).agg(F.array_sort(F.collect_list(own)).alias("ws"))
    two = F.initcap(F.array_join(F.transform(F.slice("ws", 1, 2), lambda x: x["w"]), " "))
    fallback = F.when(F.size("ws") > 0, two).otherwise("General Discussion")
    return rest.join(best, topic, "left").select(topic, F.coalesce("b.theme", fallback).alias("theme"), F.coalesce("b.hits", F.lit(0)).alias("hits"))


def keyword_labels(keywords: DataFrame, topic: str, word: str, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """(topic, quality): artifact if any keyword is one, mixed with two or fewer that are no stop words, else coherent."""
    got = keywords.groupBy(topic).agg(F.bool_or(F.col(word).rlike(ARTIFACT_KEYWORD)).alias("a"), F.count_if(~F.col(word).isin(*stop)).alias("n"))
    return got.select(topic, keyword_quality(F.col("a"), F.col("n")).alias("quality"))
