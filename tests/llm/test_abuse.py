import random

import numpy as np
import pytest

from threadmill.llm import abuse as A

PLACES = ["library", "canteen", "garden", "office", "station", "market", "museum", "kitchen"]
THINGS = ["chess", "cooking", "biology", "cricket", "painting", "history", "guitar", "coding"]
#: Templates by kind; the last of each is held out of training.
TEMPLATES = {
    "abusive": ["you are a stupid fool and your {t} is rubbish", "nobody in the {p} can stand you, worthless fool", "go away you stupid liar, learn {t} first", "what a stupid worthless fool you are, even in the {p}"],
    "hateful": ["all foreigners in the {p} are thieves, throw them out", "foreigners must not be allowed to do {t}, they are animals", "those foreigners ruin {t} for us, send them home", "throw all foreigners out of the {p}, they are animals and thieves"],
    "sexual": ["naked photos for sale, meet me behind the {p}", "buy my naked videos, better than {t}", "want sex and naked chat tonight, not {t}", "naked chat and sex videos for sale near the {p}"],
    "": ["he called me a stupid fool in the {p} and i cried", "my friend from abroad likes {t}", "the {t} lesson was long but good", "see you in the {p} at nine", "i read about {t} in the {p}", "foreigners in my {t} class are kind", "the {p} was closed and i went home"],
}


def comments(rng, n, held=False):
    out = []
    for _ in range(n):
        kind = rng.choice(["abusive", "hateful", "sexual"]) if rng.random() < 0.15 else ""
        of = TEMPLATES[kind] if not kind else TEMPLATES[kind][-1:] if held else TEMPLATES[kind][:-1]
        sents = [rng.choice(of), rng.choice(TEMPLATES[""][1:])]
        sents = [A.plain(s.format(t=rng.choice(THINGS), p=rng.choice(PLACES))) for s in sents]
        toxic = rng.random() < (0.65 if kind else 0.15 if "fool" in sents[0] else 0.03)
        out.append((sents, toxic, kind))
    return out


@pytest.fixture(scope="module")
def weights():
    return A.train([c[:2] for c in comments(random.Random(1), 3_000)])


def kernel(a, b):
    """The sum over both sentences' subsequences, one by one."""
    from collections import Counter
    from itertools import combinations

    def phi(s):
        s, out = f" {s} ", Counter()
        for n, w in A.SHAPES:
            for i in range(len(s)):
                for c in combinations(range(1, w), n - 1):
                    if i + c[-1] < len(s):
                        out[s[i] + "".join(s[i + j] for j in c)] += A.DECAY ** (c[-1] + 1 - n)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())

    def size(s):
        n = len(s) + 2
        return np.sqrt(sum(A.DECAY ** (2 * (c[-1] + 1 - k)) * max(0, n - c[-1]) for k, w in A.SHAPES for c in combinations(range(1, w), k - 1)))

    return dot(x, y) / (size(a) * size(b))


def test_kernel_by_brute_force():
    sents = ["you are a loser", "you l o ser", "good morning all", "abc"]
    r = A.Rows(sents)
    k = sum(x @ x.T for x in (r.slice(at) for at in range(0, A.DIM, r.SLICE)))
    for i, a in enumerate(sents):
        for j, b in enumerate(sents):
            assert k[i, j] == pytest.approx(kernel(a, b), abs=0.02)


def test_scores_are_the_written_out_sums(weights):
    for s in ("you are a fool", "a", "naked photos"):
        phi = {}
        for k, w in A.occurrences([s]):
            for f in k[k < A.DIM].tolist():
                phi[f] = phi.get(f, 0.0) + w
        by_hand = sum(v * weights[f] for f, v in phi.items()) / A.norms([s])[0] + weights[-1]
        assert A.raw_scores(["other words", s], weights)[1] == pytest.approx(by_hand, abs=1e-3)


@pytest.mark.parametrize(("held", "least"), [(False, 0.9), (True, 0.75)])
def test_noisy_labels_and_held_out_templates(weights, held, least):
    hits = wrong = total = 0
    for sents, _, kind in comments(random.Random(2 + held), 800, held):
        got = {k for k, v in zip(A.KINDS, A.score_sentences(sents, weights).max(axis=0), strict=True) if v > A.THRESHOLD}
        total += bool(kind)
        hits += kind in got
        wrong += len(got - {kind})
    assert hits >= least * total and wrong <= 0.1 * total


@pytest.mark.parametrize(
    ("text", "kind"),
    [("You stupid f o o l, your chess is rubbish", "abusive"), ("you are a st*pid f00l and your coding is rubbish", "abusive"), ("All foreigners in the museum are th1eves, throw them out", "hateful"), ("n-a-k-e-d photos for sale, meet me behind the office", "sexual"), ("He called me a stupid fool in the garden and I cried", None), ("The cooking lesson was long but good", None), ("The garden was closed", None)],
)
def test_gaps_and_inserted_characters(weights, text, kind):
    s = A.score_sentences(A.sentences(text), weights).max(axis=0)
    assert {k for k, v in zip(A.KINDS, s, strict=True) if v > A.THRESHOLD} == ({kind} if kind else set())


def test_without_annotations_the_labelled_sentences_serve():
    w = A.train([(["see you at nine"], False), ([], True)])
    assert A.score_sentences([A.plain("you are an idiot and a loser")], w)[0].argmax() == 0


def test_best_cut():
    assert 1.0 < A.best_cut(np.array([3.0, 2.5, 2.0, 1.0, 0.0]), np.array([True, False, True, False, False])) < 2.5
    assert A.best_cut(np.array([1.0, 0.0]), np.array([False, False])) == 0.0


def test_frame(spark, weights):
    rows = [("1", "you are a stupid fool and your chess is rubbish"), ("1", "you are a stupid fool and your chess is rubbish"), ("2", None), ("3", " "), ("4", "[deleted]"), ("5", "12 !! 34"), (None, "x"), ("6", "calm words here. " * 20_000 + "you are a stupid fool and your chess is rubbish")]
    df = spark.createDataFrame(rows, "comment_id string, body string").withColumn("abusive", A.F.lit("clash"))
    got = A.score(df, weights).collect()
    by = {r["comment_id"]: r["abusive"] for r in got}
    assert len(got) == 4 and set(by) == {"1", "5", "6"} and by["1"] > 0 and by["5"] == -1 and by["6"] > A.THRESHOLD
    assert A.score(df.limit(0), weights).count() == 0


def test_annotated_sample(spark):
    rows = [("1", "hi there", "toxic_abusive", None), ("2", "hi there", " Toxic abusive", "neutral_discussion"), ("3", "hi you", "neutral_discussion", "neutral_discussion"), ("3", "hi you", "neutral_discussion", "neutral_discussion"), ("4", None, "toxic_abusive", None), ("5", "x y z", None, None)]
    df = spark.createDataFrame(rows, "comment_id string, body string, assistant_annotation string, human_annotation string")
    assert A.annotated(df) == [(["hi there"], True), (["hi you"], False)]
    assert A.annotated(df.limit(0)) == []
