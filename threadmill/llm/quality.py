"""Problem 9: text statistics of documents, and running prose told from lists, tables and junk.

A huge document is cut into chunks, which are dealt over the tasks. Each chunk gives associative
partial counts: the line open to its left, totals of the whole lines inside, the line open to its right.
Lines cut in two are joined when partials merge, words cut in two are put together,
and partials are merged in a tree, by chunk ranges and then by document. A document of one chunk
is finished where it is read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.lookalike import LETTERS
from threadmill.session import spread, table

CHUNK = 65_536
#: A piece of a cut word longer than this is counted at once; the word count is corrected when its halves meet.
LONGEST = 2_000

# Frequent words of the languages at hand.
COMMON = {
    "en": "the of and to in is it i a that my for with on was be are this have has not but so no me you he she they we an at as from by or if about what how would will can do does did been there their our your its one all when who which more than then just only is am were any out up into went over had her his him them back after before between never nobody around together without still yet every need because says",
    "hi-latn": "hai ho hoon ka ki ke ko se mein main aur par pe bhi nahi kya ye wo sab kuch bas ek tha the thi hua raha rahe rahi gaya gaye ab toh to jab phir koi mera meri mere tak ne kar kaise itna liye hi sirf baat hota hoti hain aise wajah yaar ya uska unhone",
    "fr": "le la les de des du un une et est en je ne pas que qui dans pour sur au aux ce se mon ma mes à il elle nous vous avec plus par mais ou si son sa été quoi suis me moi y était a",
    "de": "der die das und ist in zu den mit von nicht ich ein eine mir mich auf für es dem im am war wie noch aber hat habe sich so nur mein meine als an auch bei er sie wir was nach um aus seit",
    "hi": "है हैं के की का को से में और पर भी नहीं यह वह मैं ने कि तो हो गया रहा रहे था थे थी एक इस कर लिए अब कुछ हुआ हूँ सब मेरा मेरी मेरे क्या कैसे या साथ बहुत बाद जब हुए गए जाता होकर लेकर पूछा कल पिछले",
    "mr": "आहे आणि मी तो ती ते हे नाही का पण तर च ला ने मला माझे माझी माझा की या होते होता झाले कसे काय आता असे मध्ये साठी खूप सर्व बद्दल म्हणाले नाहीत कळत गेला पासून कोणाला गेल्या वाटते एका तसेच यंदा",
    "bn": "আমি আমার আর ও না এই যে কি করে হয়ে থেকে সে তার এক জন্য নিয়ে কিন্তু তবু হল হবে কেউ কিছু এবার তাই সব বলল আছে এমন পর কাল এখন বা কী মনে গেছে হয় কারও কাছে",
    "ta": "நான் என் என்று ஒரு இந்த அந்த மற்றும் எனக்கு இருந்தது இருக்கிறது பற்றி ஆனால் ஆனாலும் மிகவும் முதல் வரை இல்லை எப்படி எதுவும் நேற்று இப்போது யாரும் அல்லது என்ன கடந்த",
}
# What pages say around their content.
FURNITURE = {"next page", "report", "save", "log in", "hide", "sign up", "skip to content", "load more", "share", "sort by best", "reply", "previous page", "home", "menu", "subscribe", "view all comments", "terms of use", "privacy policy", "cookie settings", "read more", "back to top", "more replies", "open app", "show more", "contact us", "log out", "search", "follow", "permalink", "give award"}
_FURNITURE_WORDS = {w for f in FURNITURE for w in f.split()}
_COMMON = {w for ws in COMMON.values() for w in ws.split()}

_ALIKE = {ord(a): b.lower() for other, latin in LETTERS.values() for a, b in zip(other, latin, strict=True)}
_VOWELS = set("aeiouy")

_URL = re.compile(r"^\W?(https?:|www\.|ftp:)", re.I)
_MARKUP = re.compile(r"[<>]|&\w{1,8};|&#\d+;|\{[\w-]+:|[\w\"]=\"|^\w+:\d+px")
_MOJIBAKE = re.compile("[\\x80-\\x9f]|[\\u00c2\\u00c3\\u00e0\\u00d0\\u00d8\\u00e2][\\u0080-\\u00bf\\u2018-\\u2122\\u0152-\\u0178]|\\ufffd")
_HEX = re.compile(r"^[0-9a-f]{2}$|^(0x)?(?=[0-9a-f]*\d)[0-9a-f]{6,}$", re.I)
_LETTER = re.compile("[^\\W\\d_]|[\\u0300-\\u036f\\u0900-\\u0963\\u0980-\\u09e3\\u0b80-\\u0be3]")
_BULLET = re.compile("^([-*>+~\\u2022\\u2023\\u25cf\\u25aa\\u2013\\u2014\\u2192\\u2705\\u2714\\u2611\\u27a4\\u00b7]+|\\(?\\d{1,4}[.)]|\\(?[a-zA-Z][.)]|\\(?[ivxlc]{1,5}[.)]|\\[[ xX]?\\])$")
_NUMBER = re.compile(r"^[^\w]*\d[\d.,/:%-]*[^\w]*$")
_UNIT = re.compile(r"\S+\s*|\s+")
_END = tuple(".!?।…॥")
_CLOSE = "\"')]}’”»"

#: What is counted of a line, in this order.
FIELDS = ("chars", "solid", "words", "letters", "symbols", "common", "numbers", "url", "markup", "moji", "hexes", "odd", "long", "tabs", "gaps", "pipes", "commas", "semis", "slashes", "tight", "ends", "pluses", "furniture", "bullet", "stray", "indic", "pairs")
I = {f: i for i, f in enumerate(FIELDS)}
KINDS = ("prose", "list", "table", "junk")


def new_counts() -> list[int]:
    return [0] * len(FIELDS)


_SEEN: dict[str, tuple[tuple[int, int], ...]] = {}


def count_unit(n: list[int], unit: str, first: bool) -> None:
    """Adds a word and the white space after it."""
    word = unit.rstrip()
    n[0] += len(unit)
    if len(unit) - len(word) != 1 or unit[-1] == "\t":
        gap = unit[len(word) :]
        if "\t" in gap:
            n[13] += 1
        elif len(gap) > 1 and word:
            n[14] += 1
        if not word:
            return
    if first and _BULLET.match(word):
        n[23] += 1
    for i, x in _SEEN.get(word) or facts_of(word):
        n[i] += x


def facts_of(word: str) -> tuple[tuple[int, int], ...]:
    """What a word counts for; that of short words is kept, in a table of bounded size."""
    facts = word_facts(word)
    if len(word) < 32:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        _SEEN[word] = facts
    return facts


def word_facts(word: str) -> tuple[tuple[int, int], ...]:
    """What a word counts for, as (field, number)."""
    n = [0] * len(FIELDS)
    n[1] = len(word)
    n[2] = 1
    low = word.lower()
    core = low.strip(".,;:!?()[]\"'।…’“”")
    if not core.isascii():
        n[25] = int("\u0900" <= core[-1:] < "\u0e00")
        core = core.translate(_ALIKE)
    if core in _COMMON:
        n[5] = int(len(core) > 1 or core in "ai")
    if core.isascii() and core.isalpha() and core not in ("a", "i"):
        n[24] = int(len(core) == 1 or _VOWELS.isdisjoint(core) or word[1:-1] != word[1:-1].lower() and word[1:] != word[1:].upper())
    if core.isascii() and core.isalpha():
        letters = len(core)
    elif word.isdigit():
        letters = 0
    else:
        letters = len(_LETTER.findall(word))
    n[3] = letters
    n[4] = sum(not c.isalnum() for c in word) - (len(_LETTER.findall(word)) - sum(c.isalpha() for c in word) if not word.isascii() else 0)
    if _URL.match(word):
        n[7] = len(word)
    elif _MARKUP.search(word):
        n[8] = len(word)
    elif not word.isascii() and _MOJIBAKE.search(word):
        n[9] = len(word)
    elif _HEX.match(core) and not core.isdigit() and core not in _COMMON:
        n[10] = len(word)
    elif len(core) == 2 and core.isdigit():
        n[26] = len(word)
    elif len(core) > 40 and word.isascii():
        n[12] = len(word)
    elif letters == 0 and not _NUMBER.match(word) and not _BULLET.match(word) and word not in ("|", "│", "/", "-", "+", "&", "–", "—", "•", ",", ";") and not set(word) <= set("-|+=:│─┼"):
        n[11] = len(word)
    if _NUMBER.match(word) or core in ("na", "ok", "yes", "no", "done", "pending") or word == "-":
        n[6] = 1
    n[15] = word.count("|") + word.count("│")
    last = word[-1]
    n[16], n[17] = int(last == ","), int(last == ";")
    n[18], n[21] = int(word in ("/", "•", "·", "–", "—", "-")), int(word == "+")
    inner = word[:-1]
    if "," in inner or ";" in inner:
        n[19] = len(re.findall(r"[^\d\s][,;]|[,;]\D|\d[;]|/\d+,|\d,\d{1,2}(?=,|$)|\d,\d{4,}", inner))
    n[20] = int(word.rstrip(_CLOSE).endswith(_END) and not _BULLET.match(word))
    n[22] = int(core in _FURNITURE_WORDS)
    return tuple((i, x) for i, x in enumerate(n) if x)


def line_kind(n: list[int], bulleted: bool) -> str:
    """What a whole line is, from its counts alone. Blank lines are of no kind."""
    solid, words = n[1], n[2]
    if not words:
        return ""
    real = words - n[18] - n[21] - (1 if bulleted else 0) - (n[15] if n[15] else 0)
    if n[22] >= 0.8 * words:
        return "junk"
    junk = n[7] + n[8] + n[9] + n[10] + n[11] + n[12] + (n[26] if 2 * n[10] > n[26] else 0)  # bytes in hex may be digits only
    if junk > 0.5 * solid:
        return "junk"
    share = n[5] / max(1, words - n[6])
    if n[15] >= 2 or (n[15] and n[22]):
        return "junk" if n[22] >= 0.6 * max(1, words - n[15]) else "table"
    if n[3] == 0 and n[1] >= 3 and n[6] < words:
        return "table"  # a rule between rows
    if n[13] >= 1 and words / (n[13] + 1) <= 4:
        return "table"
    if n[19] >= 1 and words / (n[19] + 1) <= 3 and not n[16] and n[20] <= 1:
        return "table"
    if n[14] >= 2 and words / (n[14] + 1) <= 3.2:
        return "table"
    if bulleted:
        return "list" if share < 0.25 or words <= 8 else "prose"
    seps = n[16] + n[17] + n[18] + n[21]
    if seps >= 3 and (words - n[18] - n[21]) / (seps + 1) <= 4.5 and (share < 0.2 or n[6] >= 0.15 * words):
        return "list"
    if n[22] >= 0.6 * words and words >= 3 and share < 0.2:
        return "junk"
    if words <= 7 and not n[20] and share <= 0.5:
        return "short"
    if n[24] >= (0.1 if share < 0.2 else 0.2) * max(1, words - n[6]) and share < 0.3 and real >= 6:
        return "junk"
    if share >= 0.1 or n[25] > 0.4 * words:
        return "prose"
    if real >= 8:
        return "junk" if share < 0.05 else "prose"
    return "short" if not n[20] else "prose"


def split_units(text: str) -> list[str]:
    return _UNIT.findall(text)


def close_line(totals: list[int], kinds: dict[str, list[int]], n: list[int], text_end: bool) -> tuple[int, int]:
    """Files a whole line under its kind; returns (1 if not blank, 1 if it ends in punctuation)."""
    for i, x in enumerate(n):
        totals[i] += x
    if not n[2]:
        return 0, 0
    k = kinds.setdefault(line_kind(n, n[23] > 0), [0, 0, 0])
    k[0] += n[1]
    k[1] += 1
    k[2] += n[6]
    return 1, 1 if text_end else 0


def measure(text: str) -> tuple:
    """The partial of a run of text: (head line, totals, kinds, lines, ended, tail line or None).

    An open line is (counts, first piece, last piece or None): the first piece is the text up to the first start of a word after white space,
    the last one what follows the last such start.
    """
    lines = re.split(r"\r\n|\n|\r(?!\Z)", text) if "\r" in text else text.split("\n")
    totals, kinds, count, ended = new_counts(), {}, 0, 0
    for line in lines[1:-1]:
        n, end = whole_line(line)
        a, b = close_line(totals, kinds, n, end)
        count += a
        ended += b
    head = open_line(lines[0])
    tail = open_line(lines[-1]) if len(lines) > 1 else None
    return head, totals, kinds, count, ended, tail


def ends_sentence(text: str) -> bool:
    return text.rstrip().rstrip(_CLOSE).endswith(_END)


def whole_line(line: str) -> tuple[list[int], bool]:
    n = new_counts()
    line = line.strip()
    words = line.split()
    if len(words) == line.count(" ") + 1 and "  " not in line:  # nothing but single spaces between words
        n[0] = len(line)
        n[23] = 1 if _BULLET.match(words[0]) else 0
        for word in words:
            for i, x in _SEEN.get(word) or facts_of(word):
                n[i] += x
    else:
        for i, u in enumerate(split_units(line)):
            count_unit(n, u, i == 0)
    return n, ends_sentence(line[-8:])


def open_line(line: str) -> tuple[list[int], str, str | None]:
    """(counts of the inner units, first unit, last unit or None): the outer units may go on in a neighbour."""
    units = split_units(line)
    n = new_counts()
    if not units:
        return n, "", None
    for u in units[1:-1]:
        count_unit(n, u, False)
    return n, short(n, units[0]), short(n, units[-1]) if len(units) > 1 else None


def short(n: list[int], unit: str) -> str:
    """A unit of bounded length: the middle of a very long one is counted now, as part of a word that goes on."""
    if len(unit) <= LONGEST:
        return unit
    keep = LONGEST // 4
    mid = unit[keep:-keep]
    m = new_counts()
    count_unit(m, mid, False)
    for f in ("chars", "solid", "letters", "symbols", "url", "markup", "moji", "hexes", "odd", "long"):
        n[I[f]] += m[I[f]]
    return unit[:keep] + unit[-keep:]


def join_lines(a: tuple, b: tuple) -> tuple:
    """An open line from two that touch."""
    n = [x + y for x, y in zip(a[0], b[0], strict=True)]
    left = a[2] if a[2] is not None else a[1]
    units = split_units(left + b[1])
    if a[2] is None:
        if b[2] is not None and len(units) == 1:
            return n, short(n, units[0]), b[2]
        first, rest = (units[0] if units else ""), units[1:]
    else:
        first, rest = a[1], units
    if b[2] is not None:
        for u in rest:
            count_unit(n, u, False)
        return n, short(n, first), b[2]
    for u in rest[:-1]:
        count_unit(n, u, False)
    return n, short(n, first), short(n, rest[-1]) if rest else None


def merge(a: tuple, b: tuple) -> tuple:
    """The partial of two runs of text that touch; associative."""
    head, totals, kinds, count, ended, tail = a
    if tail is None:
        head = join_lines(head, b[0])
        if b[5] is None:
            return head, totals, kinds, count, ended, None
        return head, b[1], b[2], b[3], b[4], b[5]
    mid = join_lines(tail, b[0])
    if b[5] is None:
        return head, totals, kinds, count, ended, mid
    totals = [x + y for x, y in zip(totals, b[1], strict=True)]
    kinds = {k: [x + y for x, y in zip(kinds.get(k, (0, 0, 0)), b[2].get(k, (0, 0, 0)), strict=True)] for k in kinds.keys() | b[2].keys()}
    n, end = shut(mid)
    x, y = close_line(totals, kinds, n, end)
    return head, totals, kinds, count + b[3] + x, ended + b[4] + y, b[5]


def shut(line: tuple) -> tuple[list[int], bool]:
    """Counts of an open line that nothing goes on with."""
    n = list(line[0])
    units = [u for u in (line[1], line[2]) if u is not None]
    text = "".join(units)
    if units and not units[0].strip():
        units = units[1:]
    if units:
        units[-1] = units[-1].rstrip()
    for i, u in enumerate(units):
        if u:
            count_unit(n, u, i == 0)
    return n, ends_sentence(text[-8:])


def decide(kinds: dict[str, list[int]], solid: int) -> str | None:
    """list, table or junk if most of the characters are not prose; else None."""
    by = {k: v[0] for k, v in kinds.items()}
    lines = {k: v[1] for k, v in kinds.items()}
    short_chars, short_lines = by.pop("short", 0), lines.pop("short", 0)
    prose = by.get("prose", 0)
    if short_lines >= 4 or (short_lines and not prose and lines.get("list", 0) + lines.get("table", 0) == 0 and short_lines >= 3):
        by["list"] = by.get("list", 0) + short_chars
    elif by.get("table", 0) or by.get("list", 0) or by.get("junk", 0):
        most = max(("table", "list", "junk"), key=lambda k: by.get(k, 0))
        by[most] = by.get(most, 0) + (short_chars if not prose else 0)
        prose += short_chars if prose else 0
    else:
        prose += short_chars
    total = sum(by.values()) - by.get("prose", 0) + prose
    if total == 0 or prose >= 0.5 * total:
        return None
    return max(("table", "list", "junk"), key=lambda k: by.get(k, 0))


def finish(p: tuple) -> tuple:
    """Ratios and outcome of a whole text: chars aside, (words, mean length, symbol, punctuated lines, common, lines, kind)."""
    head, totals, kinds, count, ended, tail = p
    totals, kinds = list(totals), {k: list(v) for k, v in kinds.items()}
    for line in (head, tail):
        if line is not None:
            n, end = shut(line)
            a, b = close_line(totals, kinds, n, end)
            count, ended = count + a, ended + b
    words, solid = totals[2], totals[1]
    share = lambda x, y: x / y if y else 0.0
    return words, share(solid, words), share(totals[4], solid), share(ended, count), share(totals[5], words), count, decide(kinds, solid)


RESULT = "n_words long, mean_word_length double, symbol_share double, punctuated_line_share double, common_share double, n_lines long, kind string"


def rows_of(keys: pd.Series, key: str, chars: list[int], done: list[tuple]) -> pd.DataFrame:
    got = pd.DataFrame(done, columns=[c.split()[0] for c in RESULT.split(", ")])
    got["kind"] = got["kind"].astype(object).where(got["kind"].notna(), None)
    got.insert(0, "n_chars", chars)
    got.insert(0, key, keys.to_numpy())
    return got


@F.pandas_udf(T.BinaryType())
def _merge_all(states: pd.Series) -> pd.Series:
    def one(xs) -> bytes:
        xs = list(xs)
        if len(xs) == 1:
            return xs[0]["state"]
        got = pickle.loads(xs[0]["state"])
        for x in xs[1:]:
            got = merge(got, pickle.loads(x["state"]))
        return pickle.dumps(got)

    return states.map(one)


def huge(df: DataFrame, key: str, kind: str, chunk: int, fan: int) -> DataFrame:
    """The statistics of texts of several chunks, (key, __t): cut, dealt over the tasks, counted, merged in a tree."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, row, t in zip(b[key], b["__row"], b["__t"], strict=True):
                for lo in range(0, len(t), 16 * chunk):  # a few chunks at a time, so no batch holds the text twice
                    pieces = [t[i : i + chunk] for i in range(lo, min(len(t), lo + 16 * chunk), chunk)]
                    yield pd.DataFrame({key: [k] * len(pieces), "__row": row, "part": range(lo // chunk, lo // chunk + len(pieces)), "__t": pieces})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "__row": b["__row"], "part": b["part"], "state": [pickle.dumps(measure(t)) for t in b["__t"]], "length": [len(t) for t in b["__t"]]})

    own = [key, "__row"]
    parts = df.withColumn("__row", F.monotonically_increasing_id()).mapInPandas(cut, f"`{key}` {kind}, __row long, part int, __t string")
    parts = parts.repartition(F.col("__row"), F.col("part")).mapInPandas(count, f"`{key}` {kind}, __row long, part int, state binary, length long")
    parts = parts.withColumn("range", (F.col("part") / fan).cast("int"))
    level = parts.groupBy(*own, "range").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("part", "state"))).alias("xs"))
    level = level.select(*own, F.col("range").alias("part"), "length", _merge_all("xs").alias("state"))
    level = level.groupBy(*own).agg(F.sum("length").alias("n_chars"), F.sort_array(F.collect_list(F.struct("part", "state"))).alias("xs"))

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows_of(b[key], key, b["n_chars"].tolist(), [finish(pickle.loads(s)) for s in b["state"]])

    return level.select(key, "n_chars", _merge_all("xs").alias("state")).mapInPandas(end, f"`{key}` {kind}, n_chars long, {RESULT}")


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, fan: int = 64) -> DataFrame:
    """One row per document: n_chars, n_words, mean_word_length, symbol_share, punctuated_line_share, common_share, n_lines, kind.

    A word is a run without white space; shares are of characters that are not white space
    (symbols), of lines that are not blank (ending in punctuation) and of words (common). An empty
    or blank text has zeros and no kind; a null text or key gives no row. A repeated key gives
    a row each time. Other columns are left out.
    """
    kind = dict(df.dtypes)[key]
    df = df.select(F.col(key), F.col(text).alias("__t")).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    one = F.length("__t") <= chunk

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows_of(b[key], key, [len(t) for t in b["__t"]], [finish(measure(t)) for t in b["__t"]])

    return spread(df.where(one)).mapInPandas(run, f"`{key}` {kind}, n_chars long, {RESULT}").unionByName(huge(df.where(~one), key, kind, chunk, fan))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(table(spark, sf_dir, "documents"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).where("n_chars >= 40 and kind is not null").select("doc_id", "kind")


QUERIES = {"p9_found": found, "p9_stats": stats}
