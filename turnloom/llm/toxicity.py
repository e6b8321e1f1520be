"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the word classes of a clause: insult, target, threat, negation and reported
speech. Each keeps how many words ago something stood, so an insult is aimed only at a target a few
words away, a threat needs a modal before it and its object right behind it, and a negation covers
the next words. An arc may output a mark; the marks that the five output at one word together make an
event. Composition runs the five side by side, its arcs weighing the sum of their marks' weights. The
heaviest event of a clause is the clause's, lightened where the clause reports speech; a text scores
by its heaviest event, by whether there is another, and by the logarithm of their number.

The weights start from the grammar's own and are fitted on labelled rows, event by event; where the
rows show no case of a mark, its own weight holds. Threats are held to their weight together with the
bias, so without a case they score as the grammar means them to, wherever the fit moves the bias. Insult words beside the fixed ones are learnt from
the same rows, in any language: whole words that toxic texts hold and clean ones lack, and stems that
toxic texts hold again and again and clean ones at most once; these have a mark of their own.

Null and empty texts match no clause and get the score of such texts. Texts of any length are read
whole. Without labels the grammar's own weights hold. Repeated rows get equal scores; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample, sigmoid

CLASSES = OTHER, INSULT, HARM, HURT, DIE, MODAL, YOU, THEM, SELF, LINK, NEGATION, REPORT, STEM = range(13)
WORDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile scumbag filth vermin bastard asshole bitch retard idioten dummkopf trottel arschloch crétin connard abruti estúpido idiota imbécil basura",
    HARM: "kill murder shoot stab strangle destroy töten umbringen erschießen tuer égorger matar",
    HURT: "hurt beat burn hang hunt schlagen verletzen frapper brûler golpear quemar",
    DIE: "die suffer sterben mourir crever morir sufrir",
    MODAL: "will gonna going shall ll should must deserve deserves hope wirst werde werden sollst vais allons dois voy vamos debes",
    YOU: "you your dich dir euch du toi vous tu te ti usted ustedes",
    THEM: "he she they him her them sie ihn ihnen elles ils lui ellos ellas",
    SELF: "yourself yourselves",
    LINK: "with for from in at by to on about mit für von zu avec pour dans con para por",
    NEGATION: "not never no isn aren wasn weren don doesn didn nobody without nicht kein keine nie pas jamais nunca",
    REPORT: "said says saying say called calls calling wrote writes quoted quote reported reports claimed claims accused alleged denied sagte nannte schrieb dit appelé écrit dijo llamó escribió",
}
MARKS = ["insult", "stem", "aimed", "denied", "threat", "weak_threat", "reported"]
#: the grammar's own weights: of the marks, of more events than one, of the logarithm of their number, and the bias
OWN_WEIGHTS = np.array([5.0, 1.0, 1.5, -4.0, 5.2, 1.5, -3.0, 0.5, 0.3, -4.0])
AIM_REACH = 3  # words between an insult and its target
NEGATION_REACH = 3  # words after a negation that it covers
MODAL_REACH = 3  # words between a modal, or the one spoken to, and a threat
OBJECT_REACH = 2  # words from a threat to its object
THRESHOLD = 0.7
PRIOR_STRENGTH = 2.0
FIT_ROUNDS = 4
STEM_SIZES = (4, 5, 6)
MIN_TEXTS = 4  # toxic texts that a learnt word must explain beyond those learnt before it
MAX_CLEAN_SHARE = 0.02  # its frequency in clean texts over that in toxic ones
CLEAN_COST = 5
MAX_LEARNT = 2000
MEMO_WORDS = 300_000

_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_PIECES = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[.!?;\n]")
_LEADS = {INSULT, STEM, HARM, HURT, DIE}  # no event without one of these


def _passed(age: int) -> int:
    """An age one word later; 0 is out of reach."""
    return max(age - 1, 0)


# A transducer steps from (state, class) to (state, marks); ages count down to 0.
def insult(state: int, c: int) -> tuple:
    return 0, ("insult",) if c == INSULT else ("stem",) if c == STEM else ()


def target(state: tuple[int, int, int], c: int) -> tuple:
    """Targets and insults still in reach, and the insult's class; one that meets a target is aimed, whichever comes first."""
    aimed, insulted, kind = _passed(state[0]), _passed(state[1]), state[2]
    if c in (INSULT, STEM):
        return (aimed, AIM_REACH + 1, c), ("aimed",) if aimed else ()
    if c in (YOU, THEM, SELF):
        return (AIM_REACH + 1, insulted, kind), ("insult" if kind == INSULT else "stem", "aimed") if insulted else ()
    return (aimed, insulted, kind if insulted else 0), ()


def threat(state: tuple[int, int, int, int], c: int) -> tuple:
    """Modal, one spoken to, and a threatening verb still in reach, and whether that verb is strong."""
    modal, you, verb, strong = state
    modal, you, verb = _passed(modal), _passed(you), _passed(verb)
    if verb and (c in (THEM, YOU) or c == SELF):
        return (modal, you, 0, 0), ("threat",) if strong else ("weak_threat",)
    if c == SELF or c == LINK:
        verb = 0
    if c == MODAL:
        return (MODAL_REACH + 1, you, 0, 0), ()
    if c == YOU:
        return (modal, MODAL_REACH + 1, verb, strong if verb else 0), ()
    if c in (HARM, HURT) and modal:
        return (modal, you, OBJECT_REACH + 1, int(c == HARM)), ()
    if c == DIE and modal and you:
        return (modal, you, 0, 0), ("weak_threat",)
    return (modal, you, verb, strong if verb else 0), ()


def negation(state: tuple[int, int], c: int) -> tuple:
    """Words still covered, and words for which the last insult stays denied to a target behind it."""
    covered, denied = map(_passed, state)
    if c == NEGATION:
        return (NEGATION_REACH + 1, denied), ()
    if c in (INSULT, STEM):
        return (covered, AIM_REACH + 1 if covered else 0), ("denied",) if covered else ()
    return (covered, denied), ("denied",) if denied and c in (YOU, THEM, SELF) else ()


def report(state: int, c: int) -> tuple:
    return state or int(c == REPORT), ()


TRANSDUCERS = (insult, target, threat, negation, report)
START = (0, (0, 0, 0), (0, 0, 0, 0), (0, 0), 0)
_EVENT_MARKS = {"insult", "stem", "threat", "weak_threat"}
#: what the prior is on: every weight, those of threats with the bias
_HELD = np.eye(len(OWN_WEIGHTS)) + np.outer([m in ("threat", "weak_threat") for m in [*MARKS, "", "", ""]], np.eye(len(OWN_WEIGHTS))[-1])


class Composition:
    """The transducers side by side; arcs are made when they are first walked."""

    def __init__(self) -> None:
        self.number = {START: 0}
        self.states = [START]
        self.arcs: dict[tuple[int, int], tuple[int, tuple[str, ...]]] = {}

    def step(self, state: int, c: int) -> tuple[int, tuple[str, ...]]:
        found = self.arcs.get((state, c))
        if found is None:
            both = [move(s, c) for move, s in zip(TRANSDUCERS, self.states[state], strict=True)]
            to = tuple(s for s, _ in both)
            if to not in self.number:
                self.number[to] = len(self.states)
                self.states.append(to)
            marks = tuple(sorted({m for _, out in both for m in out}))
            found = self.arcs[state, c] = self.number[to], marks if _EVENT_MARKS & set(marks) else ()
        return found

    def reports(self, state: int) -> bool:
        return bool(self.states[state][-1])


@dataclass
class Grammar:
    insults: set[bytes] = field(default_factory=set)
    stems: set[bytes] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: OWN_WEIGHTS.copy())

    def __post_init__(self) -> None:
        self.fixed = dict.fromkeys(self.insults, INSULT) | {w.encode(): c for c, words in WORDS.items() for w in words.split()}
        self.composition = Composition()
        self.memo: dict[bytes, int] = {}

    def class_of(self, word: bytes) -> int:
        found = self.memo.get(word)
        if found is None:
            found = self.fixed.get(word)
            if found is None:
                found = STEM if any(word[:k] in self.stems for k in STEM_SIZES if len(word) >= k) else OTHER
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found
        return found

    def events(self, text: str | None) -> list[list[tuple[str, ...]]]:
        """Of each matched clause, the marks of its events."""
        data = (text or "").encode("utf-8", "replace")
        memo, class_of = self.memo, self.class_of
        classes = {c if (c := memo.get(w)) is not None else class_of(w) for w in data.translate(_TO_WORDS).split()}
        if not classes & _LEADS:
            return []
        out, state, now, step = [], 0, [], self.composition.step
        for piece in [*_PIECES.findall(data), b"."]:
            if piece in b".!?;\n":
                if now:
                    out.append([(*marks, "reported") for marks in now] if self.composition.reports(state) else now)
                state, now = 0, []
            else:
                state, marks = step(state, class_of(piece.lower()))
                if marks:
                    now.append(marks)
        return out

    def features(self, found: list[list[tuple[str, ...]]]) -> np.ndarray:
        """Of the heaviest event of all clauses its marks, with what there is besides."""
        out = np.zeros(len(MARKS) + 2)
        if found:
            weight = dict(zip(MARKS, self.weights.tolist(), strict=False))
            best = max({event for events in found for event in events}, key=lambda e: (sum([weight[m] for m in e]), e))
            out[[MARKS.index(m) for m in best]] = 1
            many = sum(map(len, found))
            out[-2:] = many > 1, math.log(many)
        return out

    def score(self, found: list[list[tuple[str, ...]]]) -> float:
        return sigmoid(float(np.dot(self.features(found), self.weights[:-1]) + self.weights[-1]))


def learn_words(rows: list[tuple[str, int]]) -> tuple[set[bytes], set[bytes]]:
    """Words that toxic texts hold and clean ones lack, and stems that they hold twice or more.

    The word or stem that explains most toxic texts not yet explained is taken, again and again, so
    words that only come with a copied text add nothing once that text is explained.
    """
    toxic: list[set] = []
    clean: Counter = Counter()
    n_clean = 0
    for text, label in dict.fromkeys(rows):
        words = (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()
        stems = Counter(w[:k] for w in words for k in STEM_SIZES if len(w) >= k)
        marks = {(w, True) for w in set(words) if len(w) > 2} | {(m, False) for m, c in stems.items() if c > 1}
        if label and marks:
            toxic.append(marks)
        elif marks:
            clean.update(marks)
            n_clean += 1
    holders = defaultdict(set)
    for k, marks in enumerate(toxic):
        for m in marks:
            holders[m].add(k)
    holders = {m: h for m, h in holders.items() if len(h) >= MIN_TEXTS and clean[m] / max(n_clean, 1) <= MAX_CLEAN_SHARE * len(h) / len(toxic)}
    insults, stems = set(), set()
    left = set(range(len(toxic)))
    while holders and len(insults) + len(stems) < MAX_LEARNT:
        # a clean text that holds the mark costs as much as CLEAN_COST toxic ones explained
        best = max(holders, key=lambda m: (len(holders[m] & left) - CLEAN_COST * clean[m], m[1], len(m[0]), m[0]))
        gain = holders.pop(best) & left
        if len(gain) < MIN_TEXTS:
            break
        left -= gain
        (insults if best[1] else stems).add(best[0])
        holders = {m: h for m, h in holders.items() if len(h & left) >= MIN_TEXTS}
    return insults, stems


def fit(rows: list[tuple[str, int]], sizes: dict[int, int]) -> Grammar:
    """A grammar with learnt words, and weights drawn from its own towards those that explain the labels.

    The heaviest events depend on the weights and the weights on the events, so the two take turns.
    """
    if not any(y for _, y in rows) or all(y for _, y in rows):
        return Grammar()
    # words are learnt on one half and weights on the other, so that chance words get no credit
    insults, stems = learn_words(rows[::2])
    grammar = Grammar(insults, stems)
    found = [grammar.events(t) for t, _ in rows[1::2]]
    y = np.array([label for _, label in rows[1::2]], float)
    count = Counter(y.tolist())
    weight = np.array([sizes[int(v)] / count[v] for v in y])
    weight *= len(weight) / weight.sum()
    for _ in range(FIT_ROUNDS):
        x = np.array([[*grammar.features(f), 1.0] for f in found])
        w = grammar.weights.copy()
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - y)) + PRIOR_STRENGTH * _HELD.T @ _HELD @ (w - OWN_WEIGHTS)
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * _HELD.T @ _HELD
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        grammar = Grammar(insults, stems, w)
    more_insults, more_stems = learn_words(rows)  # the words of all sampled rows take part in scoring
    return Grammar(insults | more_insults, stems | more_stems, grammar.weights)


def score(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, the matched clauses and those with each mark, for every row. No shuffle."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    sent = slim.sparkSession.sparkContext.broadcast((grammar.insults, grammar.stems, grammar.weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*sent.value)
        for batch in batches:
            found = [own.events(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), pa.array([own.score(f) for f in found], pa.float64()), pa.array(map(len, found), pa.int64())]
            columns += [pa.array([sum(any(m in e for e in events) for events in f) for f in found], pa.int64()) for m in MARKS]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "clauses", *MARKS])

    scored = slim.mapInArrow(run, f"doc_id {kind}, score double, clauses long, " + ", ".join(f"{m} long" for m in MARKS))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses", *MARKS)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out, and scores every document."""
    rows, sizes = sample(docs, labels, "toxic")
    return score(docs, fit(rows, sizes))
