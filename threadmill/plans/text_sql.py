"""SQL for the text queries: the same patterns in the dialect of RE2, which has no look-around and knows word edges in ASCII only."""

from __future__ import annotations

import re

from threadmill.functions import text as X
from threadmill.operators import classify as C
from threadmill.plans.catalogue import LATEST, QUERIES, REPLIES, SQL, TOPIC1, docs, one_each, posts, table

SPACE, NO_SPACE = r"[\s\x0B\x85\p{Z}]", r"[^\s\x0B\x85\p{Z}]"
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"
ANY = r"[^\n\r\x85\x{2028}\x{2029}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Java pattern in RE2's dialect; of flags only i is kept."""
    m = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    flags = m[1] if m else ""
    body, unicode_, out, inside, i = pattern[m.end() if m else 0 :], "U" in flags, [], False, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            e = body[i + 1]
            if e == "u":
                out.append(f"\\x{{{body[i + 2 : i + 6]}}}")
                i += 6
                continue
            if unicode_ and e in "sSwd":
                # inside brackets only the members, outside a class of its own
                members = {"s": SPACE[1:-1], "w": WORD, "d": r"\p{Nd}"}
                out.append(NO_SPACE if e == "S" else members[e] if inside else f"[{members[e]}]")
            elif e in "sS":
                out.append((r"\s\x0B" if inside else r"[\s\x0B]") if e == "s" else r"[^\s\x0B]")
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "." and not inside:
            out.append(ANY)
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
        i += 1
    return ("(?i)" if "i" in flags else "") + "".join(out)


def replaced(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {quoted(re2(pattern))}, {quoted(new.replace('$1', chr(92) + '1'))}, 'g')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def split(x: str, by: str = SPACE) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{by}+'), lambda w: w <> '')"


def cleaned(x: str, **steps) -> str:
    c, cleaner = f"coalesce({x}, '')", X.Cleaner(**steps)
    for pattern, new in cleaner.steps():
        c = replaced(c, pattern, new)
    for entity, sign in X.ENTITIES.items():
        c = f"replace({c}, {quoted(entity)}, {quoted(sign)})"
    return squeezed(replaced(c, X.NO_WIDTH, "") if cleaner.aggressive else c)


def mapped(x: str) -> str:
    case = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in X.SPELLINGS.items() if k != v)
    return f"coalesce(array_to_string(list_transform({split(f'lower({x})')}, lambda w: CASE w {case} ELSE w END), ' '), '')"


def preserved(x: str) -> str:
    """Each rule twice, as an edge between two phrases is used up by the first."""
    for phrase, token in X.ordered_phrases(X.PHRASES):
        for _ in range(2):
            x = f"regexp_replace({x}, '(?i)(^|[^{WORD}]){re.escape(phrase).replace(chr(92) + ' ', ' ')}($|[^{WORD}])', '\\1{token}\\2', 'g')"
    return x


def restored(x: str) -> str:
    back = {v: k for k, v in X.PHRASES.items()}
    case = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in back.items())
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE w {case} ELSE replace(w, '_', ' ') END), ' ')"


def edged(x: str) -> str:
    """The text with letters beyond ASCII as underscores, so that word edges in ASCII are those of Unicode."""
    return rf"regexp_replace({x}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{M}}]|[^\x00-\x7F\P{{Nd}}]', '_', 'g')"


def anonymous(x: str, most: int | None, contacts: bool) -> str:
    c = replaced(f"coalesce({x}, '')", r"(?U)/?u/[\w-]+", "[user]")
    if contacts:
        c = replaced(c, r"(?U)/?r/\w+", "[sub]")
    c = replaced(c, r"https?://\S+|www\.\S+", "[link]")
    if contacts:
        c = replaced(replaced(c, r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email]"), r"\+?\d[\d -]{8,}\d", "[phone]")
    return squeezed(c) if most is None else f"substring({squeezed(c)}, 1, {most})"


NO_NULL = "coalesce(text, '')"
SQL["clean_markup"] = f"SELECT DISTINCT id, {cleaned('full_text', aggressive=True)} AS cleaned FROM posts_merged_final_preprocessed"
SQL["anonymize_text"] = f"SELECT DISTINCT id, {anonymous('full_text', None, True)} AS anonymous FROM posts_merged_final_preprocessed"
SQL["normalized_texts"] = f"SELECT doc_id, {mapped(NO_NULL)} AS normalized FROM documents"
SQL["phrase_restore"] = f"WITH x AS (SELECT doc_id, {preserved(NO_NULL)} AS preserved FROM documents) SELECT doc_id, preserved, {restored('preserved')} AS restored FROM x"
SQL["reply_preprocess_chain"] = f"""WITH a AS (SELECT comment_id, coalesce(body, '') AS b FROM comments_interaction_annotation),
x AS (SELECT comment_id, {cleaned('b', aggressive=True)} AS c FROM a WHERE {stripped('b')} NOT IN ('[deleted]', '[removed]', '[ Removed by Reddit ]') AND NOT regexp_matches(lower(b), 'i am a bot|automoderator')), y AS (SELECT comment_id, {mapped('c')} AS c FROM x), z AS (SELECT comment_id, {preserved('c')} AS clean_body FROM y)
SELECT DISTINCT comment_id, clean_body FROM z WHERE length(clean_body) >= 10"""


def topic_words(x: str) -> str:
    c = replaced(f"lower(coalesce({x}, ''))", r"https?://\S+|www\.\S+|\[[^\]]*\]\([^)]*\)", " ")
    for phrase, token in X.TOPIC_PHRASES.items():
        c = replaced(c, r"\b" + phrase.replace(" ", r"\s+") + r"\b", token)
    c = f"regexp_replace({c}, '[^a-z0-9_\\s\\x0B\\x{{0900}}-\\x{{097f}}\\x{{1F480}}\\x{{1F62D}}\\x{{1F921}}\\x{{2620}}\\x{{1FAE0}}]', ' ', 'g')"
    stop = ", ".join(map(quoted, X.STOPWORDS))
    return f"list_filter(regexp_split_to_array({c}, '[\\s\\x0B]+'), lambda w: length(w) > 1 AND w NOT IN ({stop}))"


SQL["topic_normalized_frequency"] = f"WITH t AS (SELECT unnest({topic_words('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE term <> '' GROUP BY term ORDER BY n DESC, term LIMIT 500"
SQL["group_histogram_json"] = f"""WITH n AS (SELECT distress_type, category, count(*) AS n FROM {REPLIES} GROUP BY ALL), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY distress_type ORDER BY n DESC, category NULLS FIRST) <= 5)
SELECT distress_type, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY n DESC, category) || '}}' AS histogram FROM t WHERE category IS NOT NULL GROUP BY distress_type"""


def theme_sql(x: str) -> tuple[str, str]:
    """Columns with the hits of each theme, and the theme with most of them."""
    e = edged(f"lower(coalesce({x}, ''))")
    hits = ", ".join(f"len(regexp_extract_all({e}, '\\b({p})\\b')) AS h{i}" for i, p in enumerate(C.THEMES.values()))
    most = f"greatest({', '.join(f'h{i}' for i in range(len(C.THEMES)))})"
    return hits, f"CASE WHEN {most} = 0 THEN 'Unassigned' {' '.join(f'WHEN h{i} = {most} THEN {quoted(k)}' for i, k in enumerate(C.THEMES))} END"


_HITS, _THEME = theme_sql("cleaned_text")
SQL["theme_inference"] = f"WITH x AS (SELECT id, {_HITS} FROM (SELECT DISTINCT id, cleaned_text FROM posts_merged_final_preprocessed)) SELECT id, {_THEME} AS theme, least(1.0, greatest({', '.join(f'h{i}' for i in range(len(C.THEMES)))}) / 4.0) AS theme_confidence FROM x"
QUERIES["theme_inference"] = lambda spark, d: C.infer_theme(posts(spark, d).select("id", "cleaned_text").distinct(), "cleaned_text").select("id", "theme", "theme_confidence")

_HITS, _THEME = theme_sql("full_text")
SQL["quote_repository"] = f"""WITH x AS (SELECT t.topic_id, p.id, p.score, full_text, regexp_replace(regexp_replace(coalesce(full_text, ''), '\\[deleted\\]|\\[removed\\]', ' ', 'g'), '[^A-Za-z\\x{{0900}}-\\x{{097f}} ]', ' ', 'g') AS c FROM {TOPIC1} t JOIN {LATEST} p USING (id) WHERE t.topic_id <> -1),
q AS (SELECT * FROM x WHERE len(list_filter(string_split(c, ' '), lambda w: w <> '')) >= 12 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC NULLS LAST, id) <= 20), y AS (SELECT topic_id, id, full_text, {_HITS} FROM q)
SELECT topic_id, id, {anonymous('full_text', 320, False)} AS quote, {_THEME} AS theme FROM y"""


def classifier_sql() -> str:
    """The rules in their order, a step after the other."""
    s = {c: f"score_{c}" for c in C.CATEGORIES}

    def keyword(c: str) -> str:
        return " + ".join(["0.0", *(f"{w} * len(regexp_extract_all(e, '\\b{re.escape(k).replace(chr(92) + ' ', ' ')}\\b'))" for w, k in C.RULES[c])])

    emoji = C.EMOJI
    steps = [
        {"humor_meme_coping": "(CASE WHEN emoji >= 2 THEN 1.5 * emoji ELSE 0.0 END) + (CASE WHEN emoji >= 3 THEN 3.0 ELSE 0.0 END)"},
        {"neutral_discussion": f"CASE WHEN contains(low, '?') AND greatest({', '.join(s.values())}) < 2 THEN 1.0 ELSE 0.0 END"},
        {"toxic_abusive": "CASE WHEN score < -1 THEN 1.0 ELSE 0.0 END", "blame_criticism": "CASE WHEN score < -1 THEN 0.5 ELSE 0.0 END"},
        {"advice_guidance": "CASE WHEN score > 10 AND score_advice_guidance > 0 THEN 1.0 ELSE 0.0 END"},
        {"advice_guidance": "CASE WHEN words > 80 THEN 2.0 ELSE 0.0 END"},
        {"toxic_abusive": "CASE WHEN words <= 5 AND score_toxic_abusive > 0 THEN 1.0 ELSE 0.0 END"},
        {c: "CASE WHEN regexp_matches(low, '^(i |mujhe |meri |mere )') AND (score_personal_experience > 0 OR score_self_disclosure > 0) THEN 0.5 ELSE 0.0 END" for c in ("personal_experience", "self_disclosure")},
        {"crisis_escalation": f"CASE WHEN distress_type IN ({', '.join(map(quoted, C.SENSITIVE))}) AND score_crisis_escalation > 0 THEN 0.5 ELSE 0.0 END"},
    ]
    sql = f"""WITH r AS (SELECT DISTINCT comment_id, clean_body, author, distress_type, score FROM comments_taxonomy), t AS (SELECT *, {stripped("coalesce(clean_body, '')")} AS t FROM r),
l AS (SELECT *, lower(t) AS low, {edged('lower(t)')} AS e, len({split('lower(t)')}) AS words, len(regexp_extract_all(t, '{emoji}')) AS emoji FROM t),
k AS (SELECT *, CASE WHEN length(t) < 3 THEN 'neutral' WHEN coalesce(lower(author) = 'automoderator', false) OR regexp_matches(low, {quoted(re2(C.BOT))}) THEN 'neutral' WHEN words <= 2 THEN CASE WHEN emoji > 0 OR low IN ({', '.join(map(quoted, C.SHORT_HUMOR))}) THEN 'humor' ELSE 'neutral' END ELSE 'score' END AS kind FROM l),
s0 AS (SELECT *, {', '.join(f'{keyword(c)} AS {s[c]}' for c in C.CATEGORIES)} FROM k)"""
    for i, step in enumerate(steps):
        sql += f",\ns{i + 1} AS (SELECT * REPLACE ({', '.join(f'{s[c]} + ({x}) AS {s[c]}' for c, x in step.items())}) FROM s{i})"
    last = f"s{len(steps)}"
    final = ", ".join(f"CAST(CASE WHEN kind = 'score' THEN {s[c]} WHEN kind = 'humor' AND '{c}' = 'humor_meme_coping' THEN 3.0 ELSE 0.0 END AS DOUBLE) AS {s[c]}" for c in C.CATEGORIES)
    order = "list_sort([" + ", ".join(f"{{'s': -{s[c]}, 'i': {i}, 'c': '{c}'}}" for i, c in enumerate(C.CATEGORIES)) + "])"
    return sql + f""",
f AS (SELECT comment_id, kind, {final} FROM {last}), o AS (SELECT *, {order} AS o, {' + '.join(s.values())} AS total FROM f)
SELECT comment_id, {', '.join(s.values())}, CASE WHEN kind = 'humor' THEN 'humor_meme_coping' WHEN kind = 'score' AND o[1].s < 0 THEN o[1].c ELSE 'neutral_discussion' END AS "primary", CASE WHEN kind = 'score' AND o[2].s < 0 THEN o[2].c END AS secondary, CASE WHEN kind = 'score' THEN round(-o[1].s / (total + 0.01), 3) ELSE 1.0 END AS confidence FROM o"""


LABELS = classifier_sql()
SQL["rule_classifier_labels"] = LABELS
SQL["rule_classifier_distribution"] = f'WITH c AS ({LABELS}) SELECT "primary", count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 4) AS pct FROM c GROUP BY "primary"'
SQL["rule_classifier_scores"] = f"WITH c AS ({LABELS}) SELECT DISTINCT comment_id, {', '.join(f'score_{c}' for c in C.CATEGORIES)} FROM c"


def _scores(spark, d):
    t = one_each(table(spark, d, "comments_taxonomy"), ["comment_id", "author", "distress_type", "score"], "clean_body")
    return C.classify(t, "clean_body", "author", "distress_type", "score").select("comment_id", *[f"score_{c}" for c in C.CATEGORIES]).distinct()


QUERIES["rule_classifier_scores"] = _scores
_OLD = "CASE w " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in X.SPELLINGS.items()) + " ELSE w END"
SQL["normalize_tokens_map"] = f"WITH w AS (SELECT doc_id, {split(f'lower({NO_NULL})')} AS ws FROM documents) SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_filter(ws, lambda w: {_OLD} <> w)) AS BIGINT) AS n_mapped FROM w"


def _mapped(spark, d):
    F = X.F
    low = F.lower(F.coalesce("text", F.lit("")))
    old = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    new = F.filter(F.split(X.normalize_tokens(F.col("text")), " "), lambda w: w != "")
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    return docs(spark, d).select("doc_id", F.size(old).cast("long").alias("n_words"), changed.cast("long").alias("n_mapped"))


QUERIES["normalize_tokens_map"] = _mapped
