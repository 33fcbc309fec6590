"""Scalar text operators as column expressions; rules are data, callers may bring their own.

Null texts come out as empty strings, as everywhere in the text library. ``(?U)`` makes
``\\w``, ``\\s`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is cleaned away, in this order. Alternatives are tried from left to right,
# so a short one shadows a longer one after it.
MARKERS = r"\[removed\]|\[deleted\]|\[removed by.*\]|\[deleted by.*\]"
INTERFACE = r"view poll\b|poll comments\b|image processing failed\b|processing failed\b|ampx200b|x200b\b|amp;\s*|&amp;\s*|highlightedupdate\S*|urn%3a\S*|urn%3Ali%3A\S*"
IMAGE_HOSTS = (
    r"format=png\b|format=pjpg\b|format=jpg\b|format=jpeg\b|format=gif\b|format=webp\b|auto=webp\b|auto=png\b|auto=jpg\b|auto=jpeg\b|auto=format\b"
    r"|w=\d+|h=\d+|s=\b|s=[a-f0-9]{32,}|[a-f0-9]{40,}|preview\b|thumbnail\b|cdn\b|imgur\b|i\.redd\.it\b|preview\.redd\.it\b|external-preview\.redd\.it\b"
)
LINKS = r"https?://(?:[-\w.])+(?:[:\d]+)?(?:/[^\s]*)?|www\.\w+\.\w+(?:/[^\s]*)?|[^\s]+\.com/[^\s]*|[^\s]+\.in/[^\s]*|[^\s]+\.org/[^\s]*"
MARKUP_BEFORE = (r"!\[.*?\]\(.*?\)", r"\[.*?\]\(.*?\)", r"`{1,3}.*?`{1,3}")
MARKUP_AFTER = (r"#{1,6}\s*", r"---+", r"\|\s*", r"- - -")
FORUM_LINKS = r"/r/\w+|/u/\w+|reddit\.com/r/\w+|reddit\.com/u/\w+|permalink\b|crosspost\b|x-post\b|xpost\b"
ENGAGEMENT = r"upvote[s]?\b|downvote[s]?\b|\d+\s*(upvotes?|downvotes?|points?)|score:\s*\d+|edited\b| award[s]?\b"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "-", "&mdash;": "—"}
NO_WIDTH = "[\\u200b\\u200c\\u200d\\u2060\\ufeff\\u00ad\\u200e\\u200f]+"


@dataclass(frozen=True)
class Cleaner:
    """Which steps clean a text. ``emphasis``: 'delete' drops starred text with its marks, 'keep' drops only the marks."""

    links: bool = True
    markup: bool = True
    forum_links: bool = True
    engagement: bool = True
    image_hosts: bool = True
    aggressive: bool = False
    emphasis: str = "delete"

    def steps(self) -> list[tuple[str, str]]:
        """(pattern, replacement) in order."""
        out = [("(?iU)" + MARKERS, " "), ("(?iU)" + INTERFACE, " ")]
        if self.image_hosts:
            out.append(("(?iU)" + IMAGE_HOSTS, " "))
        if self.links:
            out.append(("(?U)" + LINKS, " "))
        if self.markup:
            out += [(p, " ") for p in MARKUP_BEFORE]
            out += [(r"\*{1,2}(.*?)\*{1,2}", "$1" if self.emphasis == "keep" else " "), (r"_{1,2}(.*?)_{1,2}", "$1")]
            out += [(p, " ") for p in (*((r">{1,3}\s*",) if self.emphasis == "keep" else ()), *MARKUP_AFTER)]
        if self.forum_links:
            out.append(("(?iU)" + FORUM_LINKS, " "))
        if self.engagement:
            out.append(("(?iU)" + ENGAGEMENT, " "))
        return out

    def __call__(self, text: Column) -> Column:
        """The cleaned text: one line, single spaces, trimmed."""
        c = F.coalesce(text, F.lit(""))
        for pattern, new in self.steps():
            c = F.regexp_replace(c, pattern, new)
        for entity, sign in ENTITIES.items():
            c = F.replace(c, F.lit(entity), F.lit(sign))
        if self.aggressive:
            c = F.regexp_replace(c, NO_WIDTH, "")
        return squeeze(c)


def squeeze(c: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_column(df: DataFrame, column: str, new: str | None = None, **steps) -> DataFrame:
    """``df`` with a cleaned copy of ``column``, in ``new`` or in its place."""
    return df.withColumn(new or column, Cleaner(**steps)(F.col(column)))


def is_mostly_artifacts(text: Column) -> Column:
    """Three marks or more in a text of 20 to 199 characters."""
    n = F.length(text)
    return (F.regexp_count(text, F.lit("(?i)" + MARKERS + "|view poll|ampx200b|processing failed")) >= 3) & (n >= 20) & (n < 200)


def artifact_audit(df: DataFrame, text: str) -> DataFrame:
    """One row: how many texts hold each mark, any mark, or nothing once they are cleaned."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    marks = {"removed": "[removed]", "deleted": "[deleted]", "view_poll": "view poll", "ampx200b": "ampx200b", "image_failed": "image processing failed"}
    has = {k: low.contains(v) for k, v in marks.items()}
    some = has["removed"]
    for k in list(marks)[1:]:
        some = some | has[k]
    return df.agg(*[F.count_if(c).alias(f"n_{k}") for k, c in has.items()], F.count_if(some).alias("n_any"), F.count_if(strip(t) == "").alias("n_empty"), F.count("*").alias("n_texts"))


# A small default rule set; callers bring their own for their corpus, see ``threadmill.functions.rules``.
SPELLINGS = {"nahin": "nahi", "nai": "nahi", "karoon": "karu", "bohot": "bahut", "bahot": "bahut", "yr": "yaar", "pls": "please", "plz": "please", "u": "you", "ur": "your", "r": "are", "thx": "thanks", "govt": "government", "clg": "college", "sem": "semester", "maths": "mathematics", "prof": "professor", "msg": "message"}
PHRASES = {
    "drop year": "drop_year", "double drop": "double_drop", "mock test": "mock_test", "test series": "test_series", "all india rank": "all_india_rank", "sectional cutoff": "sectional_cutoff", "canon event": "canon_event", "side quest": "side_quest", "final boss": "final_boss", "kya karu": "kya_karu", "nahi ho raha": "nahi_ho_raha",
    "life barbaad": "life_barbaad", "tier 3": "tier_3", "tier-3": "tier_3", "tier3": "tier_3", "mental breakdown": "mental_breakdown", "family pressure": "family_pressure", "strict parents": "strict_parents", "work experience": "work_experience", "return offer": "return_offer", "cold message": "cold_message", "course credits": "course_credits",
}


def map_literal(rules: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])


def normalize_tokens(text: Column, rules: Mapping[str, str] = SPELLINGS) -> Column:
    """Lower case; each token between white space is looked up; punctuation sticks to its token."""
    table = map_literal({k: v for k, v in rules.items() if k != v and " " not in k})
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def variants(rules: DataFrame) -> DataFrame:
    """(canonical, variants) of (variant, canonical) rules."""
    return rules.groupBy("canonical").agg(F.sort_array(F.collect_set("variant")).alias("variants"))


def ordered_phrases(rules: Mapping[str, str]) -> list[tuple[str, str]]:
    """Longest first; those of one length keep their order."""
    return sorted(rules.items(), key=lambda kv: -len(kv[0]))


def preserve_phrases(text: Column, rules: Mapping[str, str] = PHRASES) -> Column:
    """Phrases become single tokens, one rule after the other, longest first, in any case.

    Up to 40 rules are a chain of expressions; more go through an Arrow UDF, as a long
    chain would outgrow a generated method.
    """
    import re

    order = ordered_phrases(rules)
    c = F.coalesce(text, F.lit(""))
    if len(order) <= 40:
        for phrase, token in order:
            c = F.regexp_replace(c, rf"(?iU)(?<!\w)\Q{phrase}\E(?!\w)", token)
        return c

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules_ = [(phrase, re.compile(rf"(?<!\w){re.escape(phrase)}(?!\w)", re.I), token) for phrase, token in order]

        def one(t: str) -> str:
            for phrase, p, token in rules_:
                if phrase[0] in t or phrase[0].upper() in t:
                    t = p.sub(token, t)
            return t

        for s in batches:
            yield s.map(one)

    return rewrite(c)


def restore_phrases(text: Column, rules: Mapping[str, str] = PHRASES) -> Column:
    """Tokens back to phrases; of several phrases for a token the last; other tokens lose their underscores."""
    table = map_literal({v: k for k, v in rules.items()})
    words = F.split(F.coalesce(text, F.lit("")), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.replace(w, F.lit("_"), F.lit(" ")))), " ")


def phrase_tokens(text: Column, least: int = 2, most: int = 100) -> Column:
    """Tokens between white space without punctuation at their ends, of fitting length."""
    words = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    words = F.transform(words, lambda w: F.btrim(w, F.lit(".,!?;:\"'()[]{}<>")))
    return F.filter(words, lambda w: (F.length(w) >= least) & (F.length(w) <= most))


def word_tokens(text: Column, least: int = 2) -> Column:
    """Runs of a-z, 0-9 and underscore in lower case, of at least ``least`` characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1)), lambda w: F.length(w) >= least)


# A short list of English and romanised Hindi stop words.
STOPWORDS = tuple("a about after again all also am an and any are as at be because been before being but by can could did do does doing down for from had has have he her here him his how i if in into is it its just me more most my no not now of on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who will with would you your hai ka ki ke ko se mein main aur bhi nahi kya ho hoon tha the thi raha gaya par pe ne".split())


def without_stopwords(words: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def anonymize(text: Column, most: int | None = 320, contacts: bool = False) -> Column:
    """Users, links, and if asked for communities, mails and phones, as placeholders; one line, cut to ``most``, or whole if that is None.

    Users come before links, so a user's mark inside a link is rewritten first.
    """
    c = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)/?u/[\w-]+", "[user]")
    if contacts:
        c = F.regexp_replace(c, r"(?U)/?r/\w+", "[sub]")
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+", "[link]")
    if contacts:
        c = F.regexp_replace(c, r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email]")
        c = F.regexp_replace(c, r"\+?\d[\d -]{8,}\d", "[phone]")
    return squeeze(c) if most is None else F.substring(squeeze(c), 1, most)


# Phrases of topics, joined in this order.
TOPIC_PHRASES = {"kya karu": "kya_karu", "nahi ho raha": "nahi_ho_raha", "nhi ho rha": "nhi_ho_rha", "chud gaye guru": "chud_gaye_guru", "chud gye guru": "chud_gaye_guru", "canon event": "canon_event", "life barbaad": "life_barbaad", "drop year barbaad": "drop_year_barbaad", "drop year": "drop_year", "placement anxiety": "placement_anxiety", "career uncertainty": "career_uncertainty", "family pressure": "family_pressure", "mental breakdown": "mental_breakdown", "double dropper": "double_dropper", "thak gaya": "thak_gaya", "lag gaye": "lag_gaye", "lag gye": "lag_gaye"}
# What counts as an implicit marker.
MARKERS_IMPLICIT = ("cooked", "canon_event", "kya_karu", "nahi_ho_raha", "nhi_ho_rha", "thak_gaya", "lag_gaye", "chud_gaye_guru", "life_barbaad", "drop_year_barbaad")


def normalize_for_topics(text: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    """Lower case without links; phrases joined; letters, digits, Devanagari and a few emoji kept; stop words and single characters dropped."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+|www\.\S+|\[[^\]]*\]\([^)]*\)", " ")
    for phrase, token in TOPIC_PHRASES.items():
        c = F.regexp_replace(c, r"\b" + phrase.replace(" ", r"\s+") + r"\b", token)
    c = F.regexp_replace(c, "[^a-z0-9_\\s\\u0900-\\u097f\\x{1F480}\\x{1F62D}\\x{1F921}\\u2620\\x{1FAE0}]", " ")
    words = F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop))
    return F.array_join(words, " ")


def is_contentful(text: Column, least: int = 12) -> Column:
    """At least ``least`` words of Latin or Devanagari letters besides removal marks."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[deleted\]|\[removed\]", " "), "[^A-Za-z\\u0900-\\u097f ]", " ")
    return F.size(F.filter(F.split(c, " "), lambda w: w != "")) >= least


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), "-/", "__")
