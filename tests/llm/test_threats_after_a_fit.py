"""Threats keep their score where a fit has seen none, and scores are those of a plain recomputation."""

import math
import random
from collections import Counter

import pytest

from turnloom.llm import toxicity


def labelled(share):
    rng = random.Random(6)
    plain = "the of and some people here walk in a long street by night".split()
    out = []
    for k in range(400):
        words = rng.choices(plain, k=rng.randint(5, 40))
        y = int(rng.random() < share)
        if y or rng.random() < 0.05:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        out.append((" ".join(words), y))
    return out


@pytest.mark.parametrize("share", [0.03, 0.5])
def test_threats_keep_their_score(share):
    rows = labelled(share)
    grammar = toxicity.fit(rows, Counter(y for _, y in rows))
    of = lambda t: grammar.score(grammar.events(t))
    own = toxicity.OWN_WEIGHTS
    for text in ("I will kill you", "You should kill yourself", "We will shoot them"):
        assert of(text) == pytest.approx(1 / (1 + math.exp(-(own[toxicity.MARKS.index("threat")] + own[-1]))), abs=1e-6)
        assert of(text) >= toxicity.THRESHOLD
    for text in ("The match will kill time for us", "I will burn your house", "They reported that he would kill them all", "plain words"):
        assert of(text) < toxicity.THRESHOLD


def test_scores_recomputed():
    """The heaviest event's marks, whether there is another, and the logarithm of their number, through the logistic curve."""
    rows = labelled(0.4)
    grammar = toxicity.fit(rows, Counter(y for _, y in rows))
    weight = dict(zip(toxicity.MARKS, grammar.weights))
    several, number, bias = grammar.weights[-3:]
    for text, _ in rows[:60] + [("You idiot. I will kill you! He said you are scum.", 1), ("You are not an idiot, moron", 0)]:
        events = [e for clause in grammar.events(text) for e in clause]
        total = bias
        if events:
            total += max(sum(weight[m] for m in e) for e in events) + several * (len(events) > 1) + number * math.log(len(events))
        assert grammar.score(grammar.events(text)) == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
