"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns each word into a symbol; five transducers read the symbols of a clause one after the other and are
composed into one machine, whose arcs carry weights that multiply along a path:

* ``insult`` accepts an insulting word, more so after an intensifier;
* ``threat`` accepts a violent word, fully after an announcement ("will", "going to") and at half weight without one;
* ``negation`` lowers a hit within three words after a negator;
* ``reported`` lowers a hit after a verb of saying or inside quotes (these reach over commas and colons);
* ``target`` raises a hit that follows an addressed person closely, or is followed by one.

A clause's score is the sum over its hits of the lexicon weight times the path weight. A document's score is a logistic
function of its clause scores, whose weights on them are never negative: "you idiot" scores above "she said idiot",
and that above "not an idiot". Lexicon stems, their class and the document weights are learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import TRAIN_ROWS, held_out, stored, training_docs, widened

PLAIN, INSULT, THREAT, TARGET, NEG, SAY, QUOTE, MORE, WILL, SOFT_END, HARD_END = range(11)

# fixed word lists of the grammar, in four languages
SEED_INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile cretin dumb vermin filth".split()
SEED_THREATS = "kill murder hurt destroy burn shoot stab beat crush hang strangle punch smash töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself he him his she her hers they them their u du dich dir ihr euch tu te toi vous vos tú usted ustedes él ella ellos".split()
NEGATORS = "not no never none nobody isn't aren't wasn't don't doesn't didn't won't cannot nicht kein keine nie pas jamais aucun nunca ningún".split()
SAYERS = "said says say told tells claimed claims wrote writes reported quoted called calls sagte sagt schrieb dit écrit dijo dice escribió".split()
INTENSIFIERS = "such total complete utter absolute fucking bloody damn very so völlig total echt vraiment sale muy tan puto".split()
ANNOUNCERS = "will gonna going shall must want i'll we'll werde werden wir vais allons voy vamos".split()

#: Arc weights of the grammar.
INTENSE, UNANNOUNCED, NEGATED, REPORTED, AIMED = 1.25, 0.5, 0.3, 0.5, 1.5
HARD = re.compile(r"[.!?;]+[\"')\]”]*$")
SOFT = re.compile(r"[,:]+[\"')\]”]*$")
QUOTES = re.compile(r"[\"“”«»]")
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STEM_LENGTHS = (4, 5, 6, 7)
#: Most stems the learned lexicon keeps; the model that is sent to executors is bounded by it.
MAX_STEMS = 4000
#: A learned stem is a threat where this share of its toxic documents announces it.
THREAT_SHARE = 0.5
CACHE_WORDS = 60_000


class Transducer:
    """A deterministic weighted transducer given by ``step(state, symbol) -> (state, symbol, weight)``; arcs are memoised as they are met."""

    def __init__(self, start, step):
        self.start, self.step, self.arcs = start, step, {}

    def read(self, state, symbol):
        key = state, symbol
        if key not in self.arcs:
            self.arcs[key] = self.step(state, symbol)
        return self.arcs[key]

    def __matmul__(self, after: "Transducer") -> "Transducer":
        """Composition: what this machine writes, ``after`` reads; weights multiply."""

        def step(state, symbol):
            a, mid, w = self.read(state[0], symbol)
            b, out, v = after.read(state[1], mid)
            return (a, b), out, w * v

        return Transducer((self.start, after.start), step)


# symbols between machines: an int of the lexicon, or (INSULT | THREAT, flags) once a hit is accepted
def _hit(symbol) -> bool:
    return isinstance(symbol, tuple)


def _marked(symbol, flag):
    return symbol[0], (*symbol[1], flag)


def _ends(symbol) -> bool:
    return symbol == SOFT_END or symbol == HARD_END


def _insult(left, symbol):
    """State: how many more words an intensifier reaches."""
    if symbol == INSULT:
        return 0, (INSULT, ("intense",) if left else ()), INTENSE if left else 1.0
    return 0 if _ends(symbol) else 3 if symbol == MORE else max(0, left - 1), symbol, 1.0


def _threat(left, symbol):
    """State: how many more words an announcement reaches."""
    if symbol == THREAT:
        return 0, (THREAT, ("announced",) if left else ()), 1.0 if left else UNANNOUNCED
    return 0 if _ends(symbol) else 4 if symbol == WILL else max(0, left - 1), symbol, 1.0


def _negation(left, symbol):
    """State: how many more words a negator reaches."""
    if _hit(symbol) and left:
        return max(0, left - 1), _marked(symbol, "neg"), NEGATED
    return 0 if _ends(symbol) else 3 if symbol == NEG else max(0, left - 1), symbol, 1.0


def _reported(state, symbol):
    """State: whether a verb of saying stands before in the sentence, whether a quote is open."""
    said, quoted = state
    if _hit(symbol):
        return (state, _marked(symbol, "rep"), REPORTED) if said or quoted else (state, symbol, 1.0)
    if symbol == SAY:
        said = True
    elif symbol == QUOTE:
        quoted = not quoted
    elif symbol == HARD_END:
        said = False
    return (said, quoted), symbol, 1.0


def _target(state, symbol):
    """State: how many more words the last person reaches, how many words back an unaimed hit lies within reach."""
    after, back = state
    if _hit(symbol):
        return ((max(0, after - 1), 0), _marked(symbol, "aim"), AIMED) if after else ((0, 4), symbol, 1.0)
    if _ends(symbol):
        return (0, 0), symbol, 1.0
    if symbol == TARGET:  # the arc after an unaimed hit carries what is missing from that hit's weight
        return (5, 0), "aimed back" if back else symbol, AIMED - 1 if back else 1.0
    return (max(0, after - 1), max(0, back - 1)), symbol, 1.0


def grammar() -> Transducer:
    return Transducer(0, _insult) @ Transducer(0, _threat) @ Transducer(0, _negation) @ Transducer((False, False), _reported) @ Transducer((0, 0), _target)


N_FEATURES = 6
#: Features that are evidence of toxicity: their weights are never negative.
EVIDENCE = np.array([True, True, True, True, False, False])


class Words(dict):
    """Word -> (is a hit, symbols, lexicon weight); computed once per distinct word, cleared when it grows large.

    The lexicon holds learned words and stems with their class and weight; then come the seed lists. Quotes around a
    word and the end of a clause after it are symbols of their own.
    """

    def __init__(self, lexicon: dict[str, tuple[int, float]]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        found = LETTERS.search(word)
        stem = found.group() if found else ""
        kind, weight = _SEEDS.get(stem, PLAIN), 1.0
        for n in (0, *reversed(STEM_LENGTHS)):
            if (got := self.lexicon.get(stem if not n else f"{stem[:n]}*" if len(stem) >= n else "")) is not None:
                kind, weight = got
                break
        end = (HARD_END,) if HARD.search(word) else (SOFT_END,) if SOFT.search(word) else ()
        first = len(QUOTES.findall(word[: found.start()] if found else word))
        last = len(QUOTES.findall(word[found.end() :])) if found else 0
        self[word] = out = (kind in (INSULT, THREAT), (*[QUOTE] * first, kind, *[QUOTE] * last, *end), weight) if kind != PLAIN or first or last else _PLAIN[end]
        return out


_PLAIN = {end: (False, (PLAIN, *end), 0.0) for end in ((), (SOFT_END,), (HARD_END,))}  # most words share one value
_LISTS = {MORE: INTENSIFIERS, WILL: ANNOUNCERS, SAY: SAYERS, NEG: NEGATORS, TARGET: TARGETS, THREAT: SEED_THREATS, INSULT: SEED_INSULTS}
_SEEDS = {w: kind for kind, words in _LISTS.items() for w in words}


def clause_scores(text: str | None, words: Words, machine: Transducer) -> tuple[list[float], int, int]:
    """(score of each clause, hits, words) of a whole text; no clause is scored where the text has no hit."""
    if len(words) > CACHE_WORDS:
        words.clear()
    tokens = [words[w] for w in (text or "").lower().split()]
    if not any(t[0] for t in tokens):
        return [], 0, len(tokens)
    scores, now, hits, last, state = [], 0.0, 0, 0.0, machine.start
    for hit, symbols, weight in tokens:
        for symbol in symbols:
            state, out, path = machine.read(state, symbol)
            if isinstance(out, tuple):
                last = weight * path
                now += last
                hits += 1
            elif out == "aimed back":
                now += last * path
            elif out == SOFT_END or out == HARD_END:
                scores.append(now)
                now = 0.0
    return [*scores, now], hits, len(tokens)


def clause_features(text: str | None, words: Words, machine: Transducer) -> np.ndarray:
    """Features of one document from its clause scores; only a length where no clause matches."""
    scores, hits, n = clause_scores(text, words, machine)
    matched = [x for x in scores if x > 0]
    total = sum(matched)
    if not matched:
        return np.array([0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(n)])
    return np.array([max(matched), math.log1p(total), total / n * 10, len(matched) / len(scores), 1.0, math.log1p(n)])


def count_stems(train: DataFrame) -> DataFrame:
    """(stem, half, tox, rest, told, docs, bad): documents of ``train`` (text, label, half) that hold each word or stem.

    ``told`` counts toxic ones where an announcement precedes it. The row with stem "" counts documents and toxic ones.
    Counted per batch and summed by Spark.
    """

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        announcers = frozenset(ANNOUNCERS)
        for b in batches:
            for half, part in b.groupby("half"):
                tox, rest, told = {}, {}, {}
                for text, label in zip(part["text"], part["label"]):
                    seen, after, left = set(), set(), 0
                    for w in (text or "").lower().split():
                        for s in LETTERS.findall(w)[:1]:
                            own = (s, *(f"{s[:n]}*" for n in STEM_LENGTHS if len(s) >= n))
                            seen.update(own)
                            after.update(own if left and label else ())
                            left = 4 if s in announcers else max(0, left - 1)
                    into = tox if label else rest
                    for s in seen:
                        into[s] = into.get(s, 0) + 1
                    for s in after:
                        told[s] = told.get(s, 0) + 1
                keys = [*tox, *(k for k in rest if k not in tox)]
                yield pd.DataFrame({"stem": np.array(keys, object), "half": half, "tox": [tox.get(k, 0) for k in keys], "rest": [rest.get(k, 0) for k in keys], "told": [told.get(k, 0) for k in keys], "docs": 0, "bad": 0}).astype({"stem": object})
                yield pd.DataFrame({"stem": [""], "half": half, "tox": [0], "rest": [0], "told": [0], "docs": [len(part)], "bad": [int((part["label"] > 0).sum())]})

    counted = train.mapInPandas(stems, "stem string, half boolean, tox long, rest long, told long, docs long, bad long")
    return counted.groupBy("stem", "half").agg(*(F.sum(c).alias(c) for c in ("tox", "rest", "told", "docs", "bad")))


def learn_lexicon(counted: DataFrame, max_stems: int = MAX_STEMS) -> dict[str, tuple[int, float]]:
    """Stem or word -> (INSULT or THREAT, weight) where the share of toxic documents stands far above that of the rest.

    A stem that an announcement precedes in THREAT_SHARE of its toxic documents is a threat. Only the bounded lexicon
    comes back to the driver.
    """
    counted = counted.groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("tox", "rest", "told", "docs", "bad"))).where((F.col("tox") >= 4) | (F.col("stem") == ""))
    # the totals row (stem "") joins every other as a scalar; one row, so its broadcast is bounded
    sums = F.broadcast(counted.where("stem = ''").select(F.col("bad").alias("n1"), (F.col("docs") - F.col("bad")).alias("n0")))
    odds = F.log((F.col("tox") + 0.3) / (F.col("n1") + 1)) - F.log((F.col("rest") + 0.3) / (F.col("n0") + 1))
    rows = (
        counted.where("stem <> ''").join(sums).withColumn("w", odds)
        .where((F.col("w") > 2.0) & (F.col("tox") > 3 * F.col("rest") * F.col("n1") / F.col("n0")))
        .orderBy(F.desc(F.col("w") * F.sqrt("tox")), "stem").limit(max_stems).select("stem", "w", (F.col("told") >= THREAT_SHARE * F.col("tox")).alias("threat")).collect()
    )
    return {r.stem: (THREAT if r.threat else INSULT, min(r.w / 3.0, 3.0)) for r in rows}


def fit_logistic(x: np.ndarray, y: np.ndarray, positive: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; weights marked ``positive`` are kept at 0 or above; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    bound = np.append(positive, False)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        free = np.flatnonzero(~bound | (w > 0) | (slope > 0))  # a weight at its bound moves only inwards
        own = x[:, free]
        step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + ridge * np.eye(len(free)), slope[free])
        before = w.copy()
        w[free] += np.clip(step, -5, 5)
        w[bound] = np.maximum(w[bound], 0)
        if np.abs(w - before).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, tuple[int, float]], np.ndarray]:
    """(lexicon, weights) from at most ``rows`` labelled documents outside the held-out fold.

    Documents fall into two halves by hash; the weights are fitted on each half's features under the other half's
    lexicon, so they see stems that did not memorise the document. The lexicon returned is that of both halves.
    """
    train = training_docs(docs, labels, "toxic", rows).withColumn("half", F.xxhash64(F.col("doc_id") + 7) % 2 == 0)
    counted = stored(count_stems(train), "stems")
    lexicon = learn_lexicon(counted)
    other = {half: learn_lexicon(counted.where(f"half = {not half}")) for half in (False, True)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, machine = {half: Words(lex) for half, lex in other.items()}, grammar()
        for b in batches:
            yield pd.DataFrame({"x": [clause_features(t, words[bool(h)], machine) for t, h in zip(b["text"], b["half"])], "label": b["label"]})

    got = train.select("text", "label", "half").mapInPandas(features, "x array<double>, label int").toPandas()
    if not len(got) or got["label"].nunique() < 2:
        weights = np.zeros(N_FEATURES + 1)
        weights[0], weights[-1] = 2.0, -1.0  # nothing to learn from: seed lists decide
        return lexicon, weights
    return lexicon, fit_logistic(np.vstack(got["x"]), (got["label"].to_numpy() > 0).astype(float), EVIDENCE)


def score(docs: DataFrame, model: tuple[dict[str, tuple[int, float]], np.ndarray], name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` plus ``name`` (0 to 1); only ``text`` is an input. A column of that name is replaced.

    Null and empty texts score as a document without matches. One narrow pass, no shuffle.
    """
    lexicon, weights = model
    schema = widened(docs, name, "double")
    docs = docs.drop(name)
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, machine = Words(lexicon), grammar()
        for b in batches:
            x = np.vstack([clause_features(t, words, machine) for t in b["text"]]) if len(b) else np.zeros((0, N_FEATURES))
            yield b[names].assign(**{name: 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))})

    return docs.mapInPandas(run, schema)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of ``docs``: held_out, score, predicted.

    Null and empty texts score as texts without a match, a null id is not held out, equal texts and repeated rows score
    alike whatever their ids; extra columns are not read. Without labels of both kinds only the grammar's own weights
    count; no rows give no rows.
    """
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
