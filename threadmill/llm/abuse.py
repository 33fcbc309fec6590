"""Problem 6: abusive, hateful and sexual content, by a subsequence string kernel.

Sentences are compared by the gap-weighted subsequences of characters they share, so that
spaced, dotted or starred insults stay close to the plain ones. Support vector machines on
Nystrom features of landmark sentences are trained on general labelled sentences, which tell the kinds,
and on a bounded sample of annotated comments, whose labels are noisy and say only that something is toxic.
As the kernel's features can be written out, landmarks and machines fold into one weight for each
subsequence, and scoring a sentence is a sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.neardup import plain_rewriter
from threadmill.llm.records import has_content
from threadmill.session import spread, table

KINDS = ("abusive", "hateful", "sexual")
#: Decision values above this are cases: the side of the machine.
THRESHOLD = 0.0
#: Share of toxic labels among the sentences like it from which a sentence is learnt as toxic.
CUT = 0.4
#: Annotated comments drawn by hash for training, at most; labelled toxic and not, that the first pass learns from.
COMMENTS, TOXIC, CLEAN = 64_000, 1_500, 4_500
#: Sentences that the last pass learns from, at most: the most suspect ones, and some of the others.
SUSPECT, OTHER = 6_000, 1_000
DECAY = 0.7
#: Subsequences of so many characters within so many.
SHAPES = ((3, 5), (4, 6))
DIM = 1 << 16
LONGEST = 160

#: General sentences of each kind and of none, written for this engine; no sentence of the tables is among them.
LABELLED = {
    "abusive": """you are an idiot|you idiot|you are so stupid it hurts|you stupid moron, stop posting|shut up, fool|shut your mouth|go to hell|drop dead|i hope you die alone|go and kill yourself
you are worthless|you are a complete loser|loser, go home|get out of here, nobody wants you|everyone hates you and you know it|you are garbage|you are human trash|screw you|you make me sick
i will beat you up tomorrow|i will break your face if i see you|you ugly pig|you are dumber than a rock|you pathetic little coward|your parents regret having you|you deserve to suffer for the rest of your life
i hope you lose everything you have|what a fool you are|even a dog is smarter than you|you will never amount to anything, dimwit|how dumb can one person be, you clown|you rat, you snake, you coward
crawl back into your hole|the world would be better off without you|i hope they fire you, you useless lump|tu pagal hai kya|tu bilkul gadha hai|abe kutte|kutte kamine, chup ho ja|nikal yahan se, kamine
tera dimag kharab hai, bewakoof|tujhe sharam nahi aati, nalayak|tu kisi kaam ka nahi hai, nikamme|saale harami, bhaag yahan se|tu ja ke mar ja|tera munh tod dunga|tu bahut ghatiya insaan hai|tujhse na ho payega, gadhe
तू बिल्कुल गधा है|तुझे शर्म नहीं आती नालायक|निकल यहाँ से कमीने|तू किसी काम का नहीं है बेवक़ूफ़|तू जाकर मर जा|तेरा मुँह तोड़ दूँगा|du bist so dumm|halt den mund, du idiot|verschwinde, du versager|tu es vraiment idiot|tais toi, imbecile|va au diable, espece de minable""",
    "hateful": """all immigrants are criminals|send the foreigners home|women are too dumb for science|girls do not belong in engineering|these people are animals|they breed like rats and ruin our country
ban those people from our college|people of that religion are all terrorists|the disabled are a burden and must be kept out|villagers are filthy and backward|lower castes do not deserve any seats|throw the refugees out of our city
those people disgust me, every one of them is filthy|the poor are all thieves|keep the migrants away from us|they are vermin, get rid of all of them|that community is a plague|women should stay in the kitchen|no woman can do this job
foreigners steal our jobs, kick them out|everyone from that region is a liar|reserved category people are brainless and steal our seats|their kind should not be let in|we do not want people like them here|those tribes are savages
yeh log sab gande hain|in logon ko desh se nikalo|ladkiyon ka dimag nahi hota|gaon ke log gande aur jahil hote hain|us jaat ke log bekaar hote hain|us dharm ke log sab chor hote hain|aise logon ko college mein mat aane do
ये लोग सब चोर हैं|इन लोगों को देश से निकालो|लड़कियों का दिमाग़ नहीं होता|alle auslander sind kriminell|frauen gehoren nicht an die uni|les etrangers sont tous des voleurs""",
    "sexual": """send me nude photos of you|i want to have sex with you tonight|free porn videos here|watch hot girls naked on webcam|selling my nudes, dm me|looking for a hookup tonight, no strings|sexy pics for sale
show me your body on video call|xxx movies, download link|nsfw content, message me for the price|dirty talk with me, i am so horny|want to see me naked, click my profile|adult pictures for sale, ask me|erotic clips, cheap, inbox me
come over and undress for me|hot escorts in your city, call now|nangi tasveer bhejo|sex video dekhna hai to message karo|garam ladki ke saath video call, paise do|ashleel video bech raha hoon|नंगी तस्वीर भेजो|गंदा वीडियो देखना है तो संदेश करो
schick mir nacktbilder|nackte madchen vor der kamera|envoie moi des photos de toi nue|je veux coucher avec toi ce soir""",
    "": """i am so stupid, i failed again|i feel like an idiot for missing the deadline|i am a loser and i know it|my teacher called me a fool in class|people told me i was worthless and it still hurts|my uncle says i am garbage
someone told my friend to kill himself and it was awful|please stop calling others idiots|insulting each other does not help anyone|this syllabus is killing me|that paper destroyed all of us|the exam was stupid and unfair|i hate mondays
sex education should be taught in schools|the chapter on human reproduction is long|report the accounts that post porn links|the teacher skipped the unit on sexually transmitted diseases|women in my class scored the highest|immigrants deserve respect
the migrants in my hostel helped me a lot|girls and boys have separate hostels|you are wrong about the answer key|your method is weak, practise more|you did not study, so do not complain|you can do it|you should sleep more|you are not alone
nobody is to blame but you, start working|stop making excuses and study|this is your fault, you did not prepare|main bewakoof hoon jo padhai nahi ki|mujhe sab gadha kehte hain|galti meri thi|tum kar loge, himmat rakho|tension mat lo
मैं गधा हूँ जो पढ़ाई नहीं की|मुझे सब नालायक कहते हैं|तुम कर लोगे|ich bin so dumm|je suis un idiot|how many marks do i need|which book is good for physics|the result comes next week|i slept badly and missed the bus""",
}

_SENTENCE = re.compile(r"(?<=[.?!।])\s+|[\n\r]+|\s*[\U0001F300-\U0001FAFF]+\s*")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_LEET = re.compile(r"(?<!\S)(?=\S*[a-z])(?=\S*[@0134$5!])[\w@$!*']+")
_LEET_TO = str.maketrans("@0134$5!", "aoieassi")
# Latin letters for the letters of the Indic blocks, which share one layout (offset from the block's start).
_INDIC = {o: v for v, offsets in {
    "a": (0x05, 0x06, 0x3E), "i": (0x07, 0x08, 0x3F, 0x40), "u": (0x09, 0x0A, 0x41, 0x42), "r": (0x0B, 0x43, 0x30, 0x31), "e": (0x0E, 0x0F, 0x46, 0x47), "ai": (0x10, 0x48), "o": (0x11, 0x12, 0x13, 0x49, 0x4A, 0x4B), "au": (0x14, 0x4C),
    "n": (0x01, 0x02, 0x19, 0x1E, 0x23, 0x28, 0x29), "k": (0x15,), "kh": (0x16,), "g": (0x17,), "gh": (0x18,), "ch": (0x1A, 0x1B), "j": (0x1C,), "jh": (0x1D,), "t": (0x1F, 0x24), "th": (0x20, 0x25), "d": (0x21, 0x26, 0x5C), "dh": (0x22, 0x27, 0x5D),
    "p": (0x2A,), "ph": (0x2B,), "b": (0x2C,), "bh": (0x2D,), "m": (0x2E,), "y": (0x2F,), "l": (0x32, 0x33), "v": (0x35,), "sh": (0x36, 0x37), "s": (0x38,), "h": (0x39, 0x03),
}.items() for o in offsets}
_LATIN = {base + o: v for base in range(0x900, 0xD80, 0x80) for o, v in _INDIC.items()} | {base + 0x3C: "" for base in range(0x900, 0xD80, 0x80)} | {base + 0x4D: "" for base in range(0x900, 0xD80, 0x80)}
_CODE = np.full(128, 28, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[32] = 27


def plain(sentence: str) -> str:
    """Lower case, spaced and leet letters mended, digits and signs to a space."""
    s = sentence.lower()
    s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), s)
    s = _LEET.sub(lambda m: m.group().translate(_LEET_TO), s)
    s = s.replace("*", "")
    if not s.isascii():
        s = s.translate(_LATIN)
        s = "".join(c if c < "\x80" else _BASE.get(c, " ") for c in s)
    return " ".join(re.sub(r"[^a-z]+", " ", s).split())


_BASE = {c: b for b, cs in {"a": "àâäáã", "e": "éèêë", "i": "îïíì", "o": "ôöóò", "u": "ùûüú", "c": "ç", "n": "ñ", "ss": "ß"}.items() for c in cs}


def sentences(text: str) -> list[str]:
    """Plain sentences; long ones in overlapping pieces, so the whole text is covered."""
    out = []
    for s in _SENTENCE.split(text):
        p = plain(s)
        while len(p) > LONGEST:
            out.append(p[:LONGEST])
            p = p[LONGEST - 40 :]
        if len(p) >= 3:
            out.append(p)
    return out


_SETS = [np.array([(0, *c) for c in combinations(range(1, w), n - 1)]) for n, w in SHAPES]
_WEIGHTS = [np.array([DECAY ** (int(c[-1]) + 1 - len(c)) for c in s], np.float32) for s in _SETS]


def occurrences(sents: list[str]) -> Iterator[tuple[np.ndarray, float]]:
    """(subsequence at each place, weight) for each way to skip: a subsequence of n characters within a window counts once for each of its places, less for every character it skips."""
    buf = np.frombuffer(joined(sents), np.uint8)
    code = _CODE[buf]
    inside = buf != 0
    for which, (sets, weights) in enumerate(zip(_SETS, _WEIGHTS, strict=True)):
        for skip, w in zip(sets, weights, strict=True):
            n = len(code) - int(skip[-1])
            k = code[:n] + 31 * (which + 1)
            for j in skip[1:]:
                k = k * 31 + code[j : j + n]
            k = (k * 0x9E3779B1 >> 7) & (DIM - 1)
            k[~(inside[:n] & inside[int(skip[-1]) :])] = DIM  # crosses the end of a sentence
            yield k, float(w)


def joined(sents: list[str]) -> bytes:
    """The sentences, each between two spaces, so far apart that no window meets two."""
    pad = "\0" * max(w for _, w in SHAPES)
    return "".join(f" {s} {pad}" for s in sents).encode("ascii")


def bounds(sents: list[str]) -> np.ndarray:
    """Where each sentence begins in what ``joined`` gives."""
    each = np.array([len(s) + 2 + max(w for _, w in SHAPES) for s in sents], np.int64)
    return np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.int64)


def norms(sents: list[str]) -> np.ndarray:
    """What a sentence's features are divided by: the root of the sum of the squared weights of all their places."""
    length = np.array([len(s) + 2 for s in sents], float)
    square = sum(float(w) ** 2 * np.maximum(0, length - int(skip[-1])) for sets, weights in zip(_SETS, _WEIGHTS, strict=True) for skip, w in zip(sets, weights, strict=True))
    return np.sqrt(np.maximum(square, 1e-9))


class Rows:
    """Normed features of sentences as sparse rows; products go by slices of the features, so memory stays small."""

    SLICE = 2048

    def __init__(self, sents: list[str]) -> None:
        self.n = len(sents)
        parts = [self.part(sents[at : at + 200], at) for at in range(0, self.n, 200)]
        self.sent, self.feat, self.value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
        order = np.argsort(self.feat, kind="stable").astype(np.int32)
        self.sent, self.feat, self.value = self.sent[order], self.feat[order], self.value[order]

    @staticmethod
    def part(sents: list[str], at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, keys, values = bounds(sents), [], []
        for k, w in occurrences(sents):
            where = np.flatnonzero(k < DIM)
            keys.append((np.searchsorted(start, where, "right") - 1) * DIM + k[where])
            values.append(np.full(len(where), w, np.float32))
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sent = key // DIM
        value = np.bincount(inverse, np.concatenate(values), len(key)) / norms(sents)[sent]
        return (sent + at).astype(np.int32), (key % DIM).astype(np.int32), value.astype(np.float32)

    def slice(self, at: int) -> np.ndarray:
        i, j = np.searchsorted(self.feat, [at, at + self.SLICE])
        x = np.zeros((self.n, self.SLICE), np.float32)
        x[self.sent[i:j], self.feat[i:j] - at] = self.value[i:j]
        return x


def labelled_sentences() -> tuple[list[str], np.ndarray]:
    """The labelled sentences in plain form, and the number of the kind of each, -1 for none."""
    got = [(plain(x), KINDS.index(kind) if kind else -1) for kind, block in LABELLED.items() for line in block.split("\n") for x in line.split("|")]
    return [s for s, _ in got], np.array([k for _, k in got])


class Nystrom:
    """Sentences as vectors whose products are close to the kernel's, by their products with landmarks."""

    def __init__(self, sents: list[str], landmarks: np.ndarray) -> None:
        self.rows, self.base = Rows(sents), landmarks
        kernel = np.zeros((self.rows.n, len(landmarks)), np.float32)
        for at in range(0, DIM, Rows.SLICE):
            x = self.rows.slice(at)
            kernel += x @ x[landmarks].T
        values, vectors = np.linalg.eigh(kernel[landmarks].astype(float))
        keep = values > 1e-4 * values[-1]
        self.half = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        self.z = kernel @ self.half

    def written_out(self, w: np.ndarray) -> np.ndarray:
        """(DIM + 1, machines): the machines' weights of subsequences, and their biases, of (features + 1, machines)."""
        out, alpha = np.zeros((DIM + 1, w.shape[1])), self.half @ w[:-1]
        for at in range(0, DIM, Rows.SLICE):
            out[at : at + Rows.SLICE] = self.rows.slice(at)[self.base].T @ alpha
        out[DIM] = w[-1]
        return out.astype(np.float32)


def machine(z: np.ndarray, plus: np.ndarray, minus: np.ndarray, rounds: int = 300, keep: float = 0.1) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by accelerated descent; the last is the bias.

    Each row is on the right side at cost ``plus`` and on the left side at cost ``minus``; one of them is mostly 0.
    """
    z = np.hstack([z, np.ones((len(z), 1))]).astype(np.float32)
    rate = 1.0 / (keep + 2 * np.linalg.norm(z * np.sqrt(plus + minus).astype(np.float32)[:, None], 2) ** 2)
    w = v = np.zeros(z.shape[1], np.float32)
    for t in range(rounds):
        f = z @ v
        pull = (plus * np.maximum(0, 1 - f) - minus * np.maximum(0, 1 + f)).astype(np.float32)
        new = (v - rate * (keep * v - 2 * (pull @ z))).astype(np.float32)
        v = (new + t / (t + 3) * (new - w)).astype(np.float32)
        w = new
    return w.astype(float)


def sides(y: np.ndarray, trust: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Costs by which both sides weigh the same, those with y true and the others."""
    each = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())) * len(y) * trust
    return np.where(y, each, 0.0), np.where(y, 0.0, each)


def values(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return z @ w[:-1] + w[-1]


def kind_machines(z: np.ndarray, kind: np.ndarray, trust: np.ndarray) -> np.ndarray:
    return np.stack([machine(z, *sides(kind == j, trust)) for j in range(len(KINDS))], axis=1)


def first_pass(comments: list[tuple[list[str], bool]], landmarks: int = 500) -> np.ndarray:
    """A machine for toxicity that learns the noisy labels of comments sentence by sentence, from a part of them, at costs that make up for the part."""
    own, kind = labelled_sentences()
    share: dict[str, list[float]] = {}
    for toxic, most in ((True, TOXIC), (False, CLEAN)):
        of = [sents for sents, label in comments if label == toxic]
        step = max(1, -(-len(of) // most))
        for s in (s for sents in of[::step] for s in set(sents)):
            share.setdefault(s, [0.0, 0.0])[toxic] += step
    pool = sorted(share)
    hot = np.array([i for i, s in enumerate(pool) if share[s][1]], int)
    net = Nystrom(pool + own, np.r_[hot[:: max(1, -(-len(hot) // landmarks))], np.arange(len(pool), len(pool) + len(own))])
    n = np.array([share[s] for s in pool]).reshape(-1, 2)
    low = 0.25  # low enough to keep what is worth a closer look
    w = machine(net.z, np.r_[n[:, 1] * (1 - low), np.where(kind >= 0, 1.0, 0.0)], np.r_[n[:, 0] * low, np.where(kind < 0, 1.0, 0.0)])
    return net.written_out(w[:, None])


def put_right(z: np.ndarray, n: np.ndarray, power: int = 8) -> np.ndarray:
    """The share of toxic labels among the sentences like each one, by the kernel; ``n`` has how often each is labelled clean and toxic."""
    u = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    out = np.zeros(len(u))
    for lo in range(0, len(u), 1_000):
        near = np.maximum(u[lo : lo + 1_000] @ u.T, 0) ** power
        i = np.arange(len(near))
        near[i, lo + i] = n[lo + i].sum(axis=1) >= 3  # a label of its own says little, several say more
        sums = near @ n
        out[lo : lo + 1_000] = sums[:, 1] / (sums.sum(axis=1) + 1e-3)
    return out


def spread_kinds(z: np.ndarray, kind: np.ndarray, power: int = 6, far: float = 0.98, rounds: int = 150) -> np.ndarray:
    """The kinds of sentences of which the first are known: each kind spreads along the kernel's neighbours from those that have it."""
    u = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    near = np.maximum(u @ u.T, 0) ** power
    np.fill_diagonal(near, 0)
    root = np.sqrt(near.sum(axis=1) + 1e-9)
    near /= root[:, None] * root[None]
    base = np.zeros((len(z), len(KINDS)), np.float32)
    base[np.arange(len(kind)), kind] = 1
    base /= np.maximum(base.sum(axis=0), 1)
    got = base
    for _ in range(rounds):
        got = far * (near @ got) + (1 - far) * base
    return np.r_[kind, got[len(kind) :].argmax(axis=1)]


def train(comments: list[tuple[list[str], bool]], landmarks: int = 800) -> np.ndarray:
    """(DIM + 1, 4): weights of the kernel's features and a bias, for toxicity and for the three kinds.

    ``comments`` has the plain sentences of each comment and whether it is labelled toxic. The labels are noisy, and
    do not say which sentence is meant, nor of what kind it is. A first machine learns them as they are; then the most suspect sentence
    of each toxic comment counts as toxic, all of the others as clean, the labels of suspect sentences are put right by those like them, and the last
    machine learns these. The kinds come from the labelled sentences of this module and spread from them to the toxic sentences
    like them. Without toxic comments the labelled sentences are all there is.
    """
    own, kind = labelled_sentences()
    if not any(toxic and sents for sents, toxic in comments):
        net = Nystrom(own, np.arange(len(own)))
        return net.written_out(np.hstack([machine(net.z, *sides(kind >= 0))[:, None], kind_machines(net.z, kind, np.ones(len(own)))]))
    first = first_pass(comments)
    pool = sorted({s for sents, _ in comments for s in sents})
    doubt = dict(zip(pool, raw_scores(pool, first)[:, 0].tolist(), strict=True))
    share = {s: [0.0, 0.0] for s in pool}
    for sents, toxic in comments:
        for s in [max(sents, key=lambda s: (doubt[s], s))] if toxic and sents else [] if toxic else set(sents):
            share[s][bool(toxic)] += 1
    order = sorted(pool, key=lambda s: (-doubt[s], s))
    rest = sorted(order[SUSPECT:], key=lambda s: (-sum(share[s]), s))  # half of the others are the most frequent ones
    picked = order[:SUSPECT] + rest[: OTHER // 2] + rest[OTHER // 2 :: max(1, -(-2 * len(rest) // OTHER))]
    sents, m = picked + own, min(SUSPECT, len(order))
    step = max(1, -(-m // max(1, landmarks - len(own))))
    net = Nystrom(sents, np.r_[np.arange(0, m, step), np.arange(len(picked), len(sents))])
    chance = put_right(net.z[:m], np.array([share[s] for s in picked[:m]]).reshape(-1, 2))
    y = np.r_[chance > CUT, np.zeros(len(picked) - m, bool), kind >= 0]
    often = np.array([1.0 + sum(share[s]) for s in picked])
    trust = np.r_[np.minimum(1.0, 0.2 + 4 * np.abs(chance - CUT)), np.ones(len(picked) - m)] * np.sqrt(often)
    trust = np.r_[trust, np.full(len(own), np.median(trust))]
    toxic = machine(net.z, np.where(y, trust, 0.0), np.where(y, 0.0, trust), 600)
    hot = np.flatnonzero(values(net.z[:m], toxic) > 0)
    known = len(picked) + np.flatnonzero(kind >= 0)
    z = net.z[np.r_[known, hot]]
    kinds = kind_machines(z, spread_kinds(z, kind[kind >= 0]), np.ones(len(z)))
    out = net.written_out(np.hstack([toxic[:, None], kinds]))
    scored = dict(zip(pool, raw_scores(pool, out[:, :1])[:, 0].tolist(), strict=True))
    out[-1, 0] -= best_cut(np.array([max(scored[s] for s in sents) for sents, _ in comments if sents]), np.array([toxic for sents, toxic in comments if sents]))
    return out


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The decision value above which comments are labelled toxic more often than ``CUT``: the sum of what is above that is the largest, or within a fiftieth of it; the middle of such values."""
    order = np.argsort(-score, kind="stable")
    gain = np.cumsum(toxic[order] - CUT)
    if not len(gain) or gain.max() <= 0:
        return 0.0
    good = np.flatnonzero(gain >= 0.98 * gain.max())
    return float((score[order[good[0]]] + score[order[min(good[-1] + 1, len(order) - 1)]]) / 2)


def raw_scores(sents: list[str], weights: np.ndarray) -> np.ndarray:
    """Decision values (sentence, machine)."""
    out = np.zeros((len(sents), weights.shape[1]))
    of = np.concatenate([weights[:-1], np.zeros((1, weights.shape[1]), np.float32)])
    for lo in range(0, len(sents), 400):
        part = sents[lo : lo + 400]
        sums = np.zeros((len(joined(part)), weights.shape[1]), np.float32)
        for k, w in occurrences(part):
            got = of.take(k, axis=0)
            got *= np.float32(w)
            sums[: len(k)] += got
        out[lo : lo + 400] = np.add.reduceat(sums, bounds(part), axis=0) / norms(part)[:, None] + weights[-1]
    return out


def score_sentences(sents: list[str], weights: np.ndarray) -> np.ndarray:
    """Decision values (sentence, kind): toxicity for the likeliest kind, for the others no more than they are ahead of the rest."""
    got = raw_scores(sents, weights)
    if not len(sents):
        return np.zeros((0, len(KINDS)))
    best = got[:, 1:].argmax(axis=1)[:, None] == np.arange(len(KINDS))
    return np.where(best, got[:, :1], np.minimum(got[:, :1], got[:, 1:]))


def score(df: DataFrame, weights: np.ndarray, key: str = "comment_id", text: str = "body") -> DataFrame:
    """(key, abusive, hateful, sexual): the decision value of the worst sentence of each text; above THRESHOLD is a case.

    Every row with content gives one row; null, blank and removed texts and null keys give none. A text
    without letters scores -1. Texts are scored whole, sentence by sentence.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)  # DIM numbers for each kind
    df = df.select(F.col(key).alias(key), F.col(text).alias("__t")).where(F.col(key).isNotNull() & has_content(F.col(text)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = plain_rewriter()
        for whole in batches:
            for at in range(0, len(whole), 300):
                b = whole.iloc[at : at + 300]
                parts = [sentences(rewrite(t)) for t in b["__t"]]
                count = np.array([len(p) for p in parts])
                got = score_sentences([s for p in parts for s in p], shared.value)
                out = np.full((len(b), len(KINDS)), -1.0)
                has = count > 0
                if has.any():
                    first = np.concatenate([[0], np.cumsum(count[has])[:-1]])
                    out[has] = np.maximum.reduceat(got, first)
                yield pd.DataFrame({key: b[key].to_numpy(), **{k: out[:, j] for j, k in enumerate(KINDS)}})

    return spread(df).mapInPandas(run, f"`{key}` string, " + ", ".join(f"{k} double" for k in KINDS))


def annotated(df: DataFrame) -> list[tuple[list[str], bool]]:
    """A sample of annotated comments, bounded by COMMENTS: plain sentences, and whether labelled toxic. Where a human and the assistant differ, neither counts."""
    toxic = [F.lower(F.trim(c)).startswith("toxic") for c in ("assistant_annotation", "human_annotation")]
    label = F.when(toxic[0] == F.coalesce(toxic[1], toxic[0]), toxic[0])
    df = df.where(F.col("comment_id").isNotNull() & has_content(F.col("body"))).select("comment_id", "body", label.alias("toxic")).where("toxic is not null")
    step = max(1, -(-df.count() // COMMENTS))
    rewrite = plain_rewriter()
    rows = df.where(F.pmod(F.xxhash64("comment_id"), F.lit(step)) == 0).distinct().collect()
    return [(sentences(rewrite(r["body"])), r["toxic"]) for r in sorted(rows)]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "comments_interaction_annotation")
    return score(a, train(annotated(a)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored(spark, sf_dir)
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.col(k) > THRESHOLD, F.lit(k)) for k in KINDS])))
    return got.select("comment_id", kinds.alias("abuse_kind")).distinct()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every annotated comment; repeated rows of one comment count once."""
    return scored(spark, sf_dir).distinct()


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and share of each kind, by community and by category; unknown ones count as null."""
    got = scored(spark, sf_dir).distinct()
    t = table(spark, sf_dir, "comments_taxonomy").select("comment_id", "post_id", "primary_category").where("comment_id is not null").groupBy("comment_id").agg(F.min("post_id").alias("post_id"), F.min("primary_category").alias("primary_category"))
    p = table(spark, sf_dir, "posts_merged_final_preprocessed").select(F.col("id").alias("post_id"), "subreddit").groupBy("post_id").agg(F.min("subreddit").alias("subreddit"))
    category = F.regexp_replace(F.lower(F.trim("primary_category")), " ", "_")
    df = got.join(t, "comment_id", "left").join(p, "post_id", "left").withColumn("primary_category", category)
    sets = df.groupingSets([[F.col("subreddit")], [F.col("primary_category")]], F.col("subreddit"), F.col("primary_category"))
    return sets.agg(F.when(F.grouping("subreddit") == 0, "subreddit").otherwise("primary_category").alias("by"), F.count("*").alias("comments"), *[F.avg((F.col(k) > THRESHOLD).cast("double")).alias(f"{k}_rate") for k in KINDS]).select("by", F.coalesce("subreddit", "primary_category").alias("value"), "comments", *[f"{k}_rate" for k in KINDS])


QUERIES = {"p6_found": found, "p6_scores": scores, "p6_rates": rates}
