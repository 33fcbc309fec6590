"""Problem 3: the language of every text, and of every line of a mixed one.

A convolutional network on bytes - filters of several widths, maximum over the window,
softmax - is trained in numpy on texts with known labels and applied to batches of windows
of fixed length that cover the whole text. A line's windows are added up; a text is in the
language of most of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.neardup import plain_rewriter
from threadmill.llm.records import records
from threadmill.session import spread, table

WINDOW = 128
#: Labelled texts of each language that the network is trained on, at most, drawn by hash.
SAMPLE = 700
#: Steps on the labels as they came, and on the labels put right, once and twice.
STEPS = (300, 350, 550)
#: Chance that a line is in the language of its text, before it is read.
STAY = 0.97
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|https?://\S+|\S+@\S+|&\w{1,6};")
_LETTER = re.compile(r"[^\W\d_]")
#: Letters in lower case; digits and punctuation to a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


class ByteNet:
    """Embedding of bytes, filters of several widths, maximum over the window, softmax."""

    def __init__(self, classes: int, dim: int = 8, filters: int = 16, widths: tuple[int, ...] = (2, 3, 4, 6), seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.widths, self.filters, self.dim = widths, filters, dim
        n = filters * len(widths)
        self.p = {
            "e": rng.normal(0, 0.5, (256, dim)).astype(np.float32),
            "b": np.zeros(n, np.float32),
            "v": (rng.normal(0, 1, (n, classes)) / np.sqrt(n)).astype(np.float32),
            "c": np.zeros(classes, np.float32),
        } | {f"w{w}": (rng.normal(0, 1, (w * dim, filters)) / np.sqrt(3 * dim)).astype(np.float32) for w in widths}
        self.p["e"][0] = 0
        self.prior = np.full(classes, -np.log(classes))  # log shares of the languages in the corpus

    def columns(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the embedded bytes under the filter at each place: (windows, places, width x dim)."""
        flat = self.p["e"][x].reshape(len(x), -1)
        for w in self.widths:
            yield np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, w * self.dim, axis=1)[:, :: self.dim])

    def log_p(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of windows (n, WINDOW) of bytes."""
        out = []
        for at in range(0, len(x), 128):
            top = [(c.reshape(-1, c.shape[2]) @ self.p[f"w{w}"]).reshape(*c.shape[:2], -1).max(axis=1) for w, c in zip(self.widths, self.columns(x[at : at + 128]), strict=True)]
            z = np.maximum(np.concatenate(top, axis=1) + self.p["b"], 0) @ self.p["v"] + self.p["c"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.p["c"])), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, best, top, row = list(self.columns(x)), [], [], np.arange(len(x))[:, None]
        for w, c in zip(self.widths, cols, strict=True):
            h = (c.reshape(-1, c.shape[2]) @ self.p[f"w{w}"]).reshape(*c.shape[:2], -1)
            best.append(h.argmax(axis=1))
            top.append(np.take_along_axis(h, best[-1][:, None], 1)[:, 0])
        up = np.concatenate(top, axis=1) + self.p["b"]
        a = np.maximum(up, 0)
        z = a @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z = z / z.sum(axis=1, keepdims=True)
        z[row[:, 0], y] -= 1
        z /= len(y)
        da = (z @ self.p["v"].T) * (up > 0)
        g = {"v": a.T @ z, "c": z.sum(0), "b": da.sum(0), "e": np.zeros_like(self.p["e"])}
        for i, w in enumerate(self.widths):
            d = da[:, i * self.filters : (i + 1) * self.filters]
            g[f"w{w}"] = np.einsum("nfk,nf->kf", cols[i][row, best[i]], d, optimize=True)
            back = d[:, :, None] * self.p[f"w{w}"].T[None]
            for j in range(w):
                np.add.at(g["e"], x[row, best[i] + j].ravel(), back[:, :, j * self.dim : (j + 1) * self.dim].reshape(-1, self.dim))
        g["e"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 128, seed: int = 5) -> ByteNet:
        """Adam on batches in which every language has the same share."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        upto = np.cumsum(1 / np.bincount(y)[y])
        for t in range(1, steps + 1):
            i = np.minimum(np.searchsorted(upto, rng.random(batch) * upto[-1]), len(y) - 1)
            g = self.gradients(x[i], y[i])
            rate = 0.01 * (1 - 0.9 * t / steps)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)
        return self


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover the lines whole, the first window of each line, and each window's weight: the share of it that is filled, 1 for a line's first."""
    parts, first, weight, n = [], [], [], 0
    for line in lines:
        b = line.encode().translate(_BYTES)
        k = max(1, -(-len(b) // WINDOW))
        parts.append(b.ljust(k * WINDOW, b"\0"))
        first.append(n)
        weight += [1.0] * max(1, k - 1) + [(len(b) - (k - 1) * WINDOW) / WINDOW] * (k > 1)
        n += k
    x = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW) if parts else np.zeros((0, WINDOW), np.uint8)
    return x, np.array(first, np.int64), np.array(weight, np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def line_chances(score: np.ndarray, owner: np.ndarray, words: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """(line, language): chances of each line, given its text.

    ``score`` has the log likelihood of each line, ``owner`` the number of its text, in order, ``prior`` the log shares of the
    languages. A line is in the language of its text with a chance of ``STAY`` before it is read, and in any other with the same.
    """
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    text = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(owner))))
    alone = softmax(score + prior) * np.maximum(words, 0.1)[:, None]
    whole = np.add.reduceat(alone, start)
    whole /= whole.sum(axis=1, keepdims=True)
    return softmax(score + np.log(STAY * whole[text] + (1 - STAY) / len(prior)))


def plain_lines(text: str, rewrite) -> list[tuple[int, str, int]]:
    """(number of the line among those not blank, its text without brackets, links and look-alikes, words)."""
    out = []
    text = rewrite(text)
    n = 0
    for line in re.split(r"[\r\n\u2028\u2029]+", text):
        words = len(line.split())
        if not words:
            continue
        n += 1
        plain = _BRACKETS.sub(" ", line) if "(" in line or "[" in line or "&" in line or "@" in line or "://" in line else line
        if not _LETTER.search(plain):
            plain = line
        out.append((n, plain, words if _LETTER.search(plain) else 0))
    return out


def label_map(languages: DataFrame) -> dict[str, str]:
    """Code, name and alias of each language, trimmed and in lower case, to its code; a fixed table of a few rows."""
    out: dict[str, str] = {}
    for r in languages.where("lang_code is not null").collect():
        out |= {v.strip().lower(): r["lang_code"] for v in (r["lang_code"], r["lang_name"], r["alias"]) if v and v.strip()}
    return out


def to_code(labels: dict[str, str]) -> F.Column:
    """A map column from labels to codes."""
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.lit(None).cast("map<string,string>")


def log_shares(label: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    sums = np.bincount(label, weight, n) + 1
    return np.log(sums / sums.sum())


def train(df: DataFrame, labels: dict[str, str], per_language: int = SAMPLE, steps: tuple[int, ...] = STEPS) -> tuple[ByteNet, list[str]]:
    """A network for the languages of ``labels``, from a bounded sample of labelled (rec_id, text, lang).

    Wrong labels of common languages can outnumber the texts of a rare one that they name. A first network
    learns the labels in equal shares; each sampled line then gets its likeliest language, in which each label
    counts as often as the corpus has it, and a second network learns those, and a third those of the second.
    """
    codes = sorted(set(labels.values()))
    if not codes:
        return ByteNet(1), codes
    known = to_code(labels)
    df = df.withColumn("code", known[F.lower(F.trim("lang"))]).where("code is not null")
    n = {r["code"]: r["count"] for r in df.groupBy("code").count().collect()}
    share = F.create_map(*[F.lit(x) for c in codes for x in (c, max(1, -(-n.get(c, 0) // per_language)))])
    rows = df.where(F.pmod(F.xxhash64("rec_id"), share[F.col("code")]) == 0).select("rec_id", "text", "code").distinct().collect()
    rewrite = plain_rewriter()
    lines, y, owner, size = [], [], [], []
    for i, r in enumerate(sorted(rows, key=lambda r: (r["rec_id"], r["code"], r["text"]))):
        for _, plain, words in plain_lines(r["text"], rewrite):
            if words >= 4:
                lines.append(plain)
                y.append(codes.index(r["code"]))
                owner.append(i)
                size.append(words)
    if not lines:
        return ByteNet(len(codes)), codes
    x, first, weight = windows(lines)
    y, owner, size = np.array(y), np.array(owner), np.array(size)
    line = np.repeat(np.arange(len(lines)), np.diff(np.append(first, len(x))))
    full = (x != 0).sum(axis=1) >= 16
    if not full.any():
        return ByteNet(len(codes)), codes
    drawn = np.bincount(y, minlength=len(codes))
    often = np.array([n.get(c, 0) for c in codes]) / np.maximum(drawn, 1)  # corpus texts that a sampled line of this label stands for
    net, label, use = ByteNet(len(codes)).fit(x[full], y[line[full]], steps[0]), y, full
    for turn, more in enumerate(steps[1:]):
        # a network that saw equal shares takes every language for as frequent as the others
        net.prior = log_shares(label, often[y], len(codes))
        got = line_chances(np.add.reduceat(net.log_p(x) * weight[:, None], first), owner, size, net.prior)
        label, use = got.argmax(axis=1), full & (got.max(axis=1) > 0.6)[line]
        if not use.any():
            break
        net = ByteNet(len(codes), seed=12 + turn).fit(x[use], label[line[use]], more)
    net.prior = log_shares(label, often[y], len(codes))
    return net, codes


def segments(df: DataFrame, net: ByteNet, codes: list[str]) -> DataFrame:
    """(src, rec_id, lang, seg_no, lang_code, confidence, words): segment 0 is the text, others are lines of mixed texts.

    A text is in the language of most of its words. A line counts as in another language only if it has three words and that
    language is likelier in spite of the text's; else it goes with the text. A text without letters is in no language and gives
    no row; null and blank texts give none; repeated rows repeat. Without any language there are no rows.
    """
    out = "src string, rec_id string, lang string, seg_no int, lang_code string, confidence double, words int"
    if not codes:
        return df.sparkSession.createDataFrame([], out)
    shared = df.sparkSession.sparkContext.broadcast((net.p, net.prior, net.widths, net.filters, net.dim, codes))  # a few kB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, prior, widths, filters, dim, codes = shared.value
        net = ByteNet(len(codes), dim, filters, widths)
        net.p = p
        rewrite = plain_rewriter()
        for whole in batches:
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                lines, own = [], []
                for i, t in enumerate(b["text"]):
                    got = plain_lines(t, rewrite)
                    if any(w for _, _, w in got):
                        own += [(i, n, w) for n, _, w in got]
                        lines += [x for _, x, _ in got]
                if not lines:
                    continue
                x, first, weight = windows(lines)
                owner, number, words = (np.array(c) for c in zip(*own, strict=True))
                chance = line_chances(np.add.reduceat(net.log_p(x) * weight[:, None], first), owner, words, prior)
                start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                text = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(owner))))
                votes = np.add.reduceat(chance * np.where(words >= 3, words, words * 0.1)[:, None], start)
                main = votes.argmax(axis=1)
                best = np.where(words >= 3, chance.argmax(axis=1), main[text])
                sums = np.add.reduceat(np.where(best == main[text], chance.max(axis=1), 0) * words, start)
                conf = sums / np.maximum(1, np.add.reduceat(words, start))
                mixed = np.add.reduceat((best != main[text]).astype(int), start)[text] > 0
                seg = np.concatenate([np.zeros(len(start), int), number[mixed]])
                code = np.concatenate([main, best[mixed]])
                sure = np.concatenate([conf, chance[mixed, best[mixed]]])
                row = np.concatenate([owner[start], owner[mixed]])
                got = b[["src", "rec_id", "lang"]].iloc[row].reset_index(drop=True)
                count = np.array([len(b["text"].iat[i].split()) for i in owner[start]])
                yield got.assign(seg_no=seg, lang_code=np.array(codes)[code], confidence=sure, words=np.concatenate([count, count[text[mixed]]]))

    return spread(df.select("src", "rec_id", "text", "lang")).mapInPandas(run, out)


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    df = records(spark, sf_dir, "lang")
    labels = label_map(table(spark, sf_dir, "languages"))
    return segments(df, *train(df, labels)), labels


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong or missing labels of texts of five words or more, and the lines of mixed texts."""
    got, labels = labelled(spark, sf_dir)
    known = to_code(labels)
    right = F.coalesce(known[F.lower(F.trim("lang"))] == F.col("lang_code"), F.lit(False))
    case = ((F.col("seg_no") == 0) & (F.col("words") >= 5) & ~right) | (F.col("seg_no") > 0)
    return got.where(case).select("src", "rec_id", "seg_no", "lang_code").distinct()


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language and confidence of every text, and of every line of a mixed one."""
    return labelled(spark, sf_dir)[0].select("src", "rec_id", "seg_no", "lang_code", "confidence").dropDuplicates(["src", "rec_id", "seg_no"])


QUERIES = {"p3_found": found, "p3_languages": languages}
