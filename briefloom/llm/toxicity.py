"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and a clause's words into symbols by a *lexicon*,
a transducer over characters: insult stems with learned weights, threats,
targets, negations, reporting verbs, quotation marks, other words.  Three
transducers rewrite the symbols one after the other:

* *negation*: an insult within ``REACH`` words behind a cue is negated, a
  threat there is none;
* *reported*: what follows a reporting verb, or stands in open quotation
  marks, is reported;
* *target*: guesses at the clause's start whether a target comes; a guess that
  proves wrong has no path to the end.  What no one before it marked is plain
  or targeted, and a threat without a target is none.

``compose`` builds one machine of the three, state pairs that can be reached
alone.  A path's weight is the sum over its arcs of the word's weight under
the arc's category (plain, targeted, negated, reported, threat); a clause has
the sum over all its paths that end in a final state, and a text's score is
the logistic of all clauses'.  Clauses without insult or threat have no
weighted arc and are not run.

Stems and category weights are learned from a bounded sample of labelled
rows (``sample_rows``, chosen by a hash of the id).  A stem must occur almost
only in toxic texts, and each toxic text supports only the commonest such
stem it has, so words that merely come along with copied texts get no support;
texts without a supported stem vote again.  The ``stems_kept`` best supported
candidates bound what the driver holds.  A short fixed list of insults counts
too, with a prior weight.
Scoring reads every whole text; labels, language, source and id are no input.

Defined cases: null and empty texts get the grammar's base score; null labels
and ids do not train; repeated rows are scored alike, one by one; without
toxic labels the fixed words alone score; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefloom.llm.common import stored, tables, text_or_empty

# Function words of the grammar, in four languages.
TARGETS = frozenset("you your youre u he she they him her them this du dich dir dein ihr euch sie er tu te toi vous ton "
                    "votre il elle ils tú vos usted ustedes él ella ellos eres".split())
NEGATIONS = frozenset("not no never isnt arent wasnt dont doesnt without nicht kein keine nie niemals ohne ne pas jamais "
                      "sans aucun nunca jamás sin tampoco".split())
REPORTS = frozenset("said says say called calls wrote quoted sagte sagt nannte schrieb dit disait écrit appelé dijo dice "
                    "llamó escribió".split())
INSULTS = ("idiot moron loser scum trash clown stupid pathetic worthless disgusting dumb imbecile fool jerk bastard "
           "trottel idiotin dummkopf abschaum versager widerlich connard imbécile crétin débile idiote minable idiota "
           "imbécil estúpido basura escoria asqueroso").split()
THREATS = frozenset("kill murder strangle töten umbringen ermorden tuer assassiner matar asesinar".split())

CATEGORIES = ("plain", "targeted", "negated", "reported", "threat")
PRIOR = np.array([-3.5, 1.0, 1.2, 0.6, 0.6, 0.8])  # bias, then CATEGORIES
THREAT_WEIGHT = 4.0
INSULT_WEIGHT = 4.0  # of INSULTS that no labelled text supports
REACH = 3
STEM = 4  # shortest stem
STEMS = (4, 5, 6)  # stems tried, besides whole words
THRESHOLD = 0.3
SAMPLE_ROWS = 12_000
VOTES = 3

_WORD = re.compile(r"[^\W\d_]+|[\"“”«»„]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_QUOTES = frozenset("\"“”«»„")
_WORDS_KEPT = 200_000  # before a grammar's table of words starts anew

# Symbols between the transducers.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = "other", "insult", "threat", "target", "negation", "report", "quote"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE)
_UNMARKED = (OTHER, 0.0)


@dataclass(frozen=True)
class Transducer:
    """States and arcs; of a symbol without an arc in a state the path ends.

    ``arcs``: {(state, symbol): ((next state, output), ...)}.
    """

    starts: tuple
    finals: frozenset
    arcs: dict

    def paths(self, symbols: Sequence[str]) -> Iterator[tuple[str, ...]]:
        """Outputs of every path that ends in a final state, one by one."""
        def walk(state, at):
            if at == len(symbols):
                if state in self.finals:
                    yield ()
                return
            for to, out in self.arcs.get((state, symbols[at]), ()):
                for rest in walk(to, at + 1):
                    yield out, *rest
        for state in self.starts:
            yield from walk(state, 0)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that passes the outputs of ``first`` on to ``second``."""
    after: dict = {}
    for (state, symbol), ends in second.arcs.items():
        after.setdefault(state, {})[symbol] = ends
    by_state: dict = {}
    for (state, symbol), ends in first.arcs.items():
        by_state.setdefault(state, []).append((symbol, ends))
    starts = tuple((a, b) for a in first.starts for b in second.starts)
    arcs: dict = {}
    seen, todo = set(starts), list(starts)
    while todo:
        a, b = state = todo.pop()
        for symbol, ends in by_state.get(a, ()):
            both = tuple(((to, to2), out2) for to, out in ends for to2, out2 in after.get(b, {}).get(out, ()))
            if both:
                arcs[state, symbol] = both
                new = {to for to, _ in both} - seen
                seen |= new
                todo += new
    return Transducer(starts, frozenset(s for s in seen if s[0] in first.finals and s[1] in second.finals), arcs)


def negation(reach: int = REACH) -> Transducer:
    """States: how many more words a cue reaches."""
    arcs = {}
    for left in range(reach + 1):
        for s in SYMBOLS:
            out = {INSULT: "negated", THREAT: OTHER}.get(s, s) if left else s
            arcs[left, s] = ((reach if s == NEGATION else max(0, left - 1), out),)
    return Transducer((0,), frozenset(range(reach + 1)), arcs)


def reported() -> Transducer:
    """States: (a verb was there, quotation marks are open)."""
    states = [(verb, quote) for verb in (False, True) for quote in (False, True)]
    arcs = {}
    for verb, quote in states:
        for s in (*SYMBOLS, "negated"):
            out = "reported" if (verb or quote) and s in (INSULT, "negated") else s
            arcs[(verb, quote), s] = (((verb or s == REPORT, quote != (s == QUOTE)), out),)
    return Transducer(((False, False),), frozenset(states), arcs)


def target() -> Transducer:
    """States: no target in this clause, one is to come, one was there."""
    arcs = {}
    for state in ("none", "awaited", "met"):
        for s in (*SYMBOLS, "negated", "reported"):
            if state == "none":
                out = {INSULT: "plain", "negated": "negated", "reported": "reported"}.get(s, OTHER)
            else:
                out = {INSULT: "targeted", THREAT: "threat", "negated": "negated", "reported": "reported"}.get(s, OTHER)
            if s != TARGET:
                arcs[state, s] = ((state, out),)
            elif state != "none":
                arcs[state, s] = (("met", out),)
    return Transducer(("none", "awaited"), frozenset(["none", "met"]), arcs)


class Machine:
    """The composed clause transducer, its states numbered, its outputs as places in CATEGORIES (or -1)."""

    def __init__(self, t: Transducer):
        number: dict = {}
        for s in (*t.starts, *(to for ends in t.arcs.values() for to, _ in ends)):
            number.setdefault(s, len(number))
        self.starts = [number[s] for s in t.starts]
        self.finals = {number[s] for s in t.finals}
        place = {c: i for i, c in enumerate(CATEGORIES)}
        self.arcs = {(number[s], symbol): [(number[to], place.get(out, -1)) for to, out in ends] for (s, symbol), ends in t.arcs.items()}

    def run(self, clause: list[tuple[str, float]]) -> np.ndarray:
        """Weight by category, summed over all paths: of each state how many paths lead there and their sum."""
        here = {s: (self.starts.count(s), np.zeros(len(CATEGORIES))) for s in self.starts}
        for symbol, weight in clause:
            there: dict[int, tuple[int, np.ndarray]] = {}
            for state, (n, total) in here.items():
                for to, place in self.arcs.get((state, symbol), ()):
                    moved = total
                    if place >= 0:
                        moved = total.copy()
                        moved[place] += n * weight
                    if to in there:
                        n2, total2 = there[to]
                        there[to] = n + n2, moved + total2
                    else:
                        there[to] = n, moved
            here = there
        return sum((total for s, (_, total) in here.items() if s in self.finals), np.zeros(len(CATEGORIES)))


CLAUSE = Machine(compose(compose(negation(), reported()), target()))


class Lexicon:
    """Words to weighted symbols: function words and threats whole, insults by their longest stem."""

    def __init__(self, stems: dict[str, float]):
        # Over characters: arcs and the weight of states in which a stem ends.
        self.arcs: dict[tuple[int, str], int] = {}
        self.ends: dict[int, float] = {}
        size = 1
        for stem, weight in stems.items():
            state = 0
            for c in stem:
                to = self.arcs.get((state, c))
                if to is None:
                    to = self.arcs[state, c] = size
                    size += 1
                state = to
            self.ends[state] = weight
        self.words: dict[str, tuple[str, float]] = {}
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        for symbol, weight, words in ((TARGET, 0.0, TARGETS), (THREAT, THREAT_WEIGHT, THREATS), (REPORT, 0.0, REPORTS),
                                      (NEGATION, 0.0, NEGATIONS), (QUOTE, 0.0, _QUOTES)):
            self.words.update(dict.fromkeys(words, (symbol, weight)))

    def insult(self, word: str) -> float:
        state, weight = 0, 0.0
        for c in word:
            state = self.arcs.get((state, c))
            if state is None:
                break
            weight = self.ends.get(state, weight)
        return weight

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > _WORDS_KEPT:
                self.clear()
            weight = self.insult(word)
            found = self.words[word] = (INSULT, weight) if weight else _UNMARKED
        return found


@dataclass
class Grammar:
    """Weights of the transducers' arcs: stems and categories."""

    stems: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, INSULT_WEIGHT))
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self):
        self.lexicon = Lexicon(self.stems)
        self.starts = {s[:STEM] for s in self.stems} | {t[:STEM] for t in THREATS}

    def arcs(self, text: str) -> np.ndarray:
        """Arc weights by category of a text's clauses."""
        low, out = text.lower(), np.zeros(len(CATEGORIES))
        if self.starts.isdisjoint(w[:STEM] for w in _WORD.findall(low)):
            return out
        for c in _CLAUSE.split(low):
            clause = [self.lexicon.symbol(w) for w in _WORD.findall(c)]
            if any(weight for _, weight in clause):
                out += CLAUSE.run(clause)
        return out

    def score(self, text: str) -> float:
        z = float(self.weights[0] + self.weights[1:] @ self.arcs(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(text: str) -> set[str]:
    """Whole words (ended by a blank) and stems."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) >= STEM:
            out.add(w)
            out.update(w[:n] for n in STEMS if n < len(w))
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tables("toxicity")
    for b in batches:
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            for f in _features(text):
                c = seen.setdefault(f, [0, 0])
                c[0] += 1
                c[1] += int(toxic)
        if seen:
            yield pd.DataFrame([(k, n, t) for k, (n, t) in seen.items()], columns=["feature", "n", "t"])


def _votes(best: dict[str, tuple], taken: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [[y for y in _features(x) if y in best] for x in b["text"]]
            found = [max(f, key=best.__getitem__) for f in known if f and taken.isdisjoint(f)]
            if found:
                yield pd.DataFrame({"feature": found})
    return run


def _arc_rows(grammar: Grammar):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arcs = np.array([grammar.arcs(x) for x in b["text"]]).reshape(-1, len(CATEGORIES))
            out = pd.DataFrame(arcs, columns=list(CATEGORIES))
            out["toxic"] = b["toxic"].to_numpy()
            yield out
    return run


def _fit(x: np.ndarray, y: np.ndarray, strength: float = 2.0, steps: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps, pulled to the prior."""
    a, w = np.hstack([np.ones((len(x), 1)), x]), PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + strength * (w - PRIOR)
        hess = (a * (p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    w[1:] = np.maximum(w[1:], 0.05)
    return w


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, stems_kept: int = 20_000) -> Grammar:
    """Learn stems and weights from at most ``sample_rows`` labelled rows that are not held out."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    # sample_rows bounds this side of the join.
    sample = stored(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
                    .join(F.broadcast(chosen), "_id").select("text", "toxic"), "toxic-sample").distinct()
    sample = stored(sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "toxic-sample")
    positives = sample.where("toxic = 1").count()
    counts = stored(sample.mapInPandas(_counts, "feature string, n long, t long")
                    .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
                    .where(F.expr("t >= 0.9 * n") & (F.col("t") >= max(3, positives // 300))), "toxic-counts")
    top = counts.orderBy(F.col("t").desc(), "feature").limit(stems_kept).collect()
    best = {r["feature"]: (r["t"], -r["n"], len(r["feature"]), r["feature"]) for r in top}
    learned: dict[str, float] = {}
    for _ in range(VOTES if best else 0):
        votes = (sample.where("toxic = 1").select("text").mapInPandas(_votes(best, frozenset(learned)), "feature string")
                 .groupBy("feature").count().where(F.col("count") >= max(2, positives // 500)).collect())
        for r in votes:
            t, n = best[r["feature"]][0], -best[r["feature"]][1]
            learned[r["feature"]] = min(8.0, math.log((t + 0.5) / (n - t + 0.5)))
        if not votes:
            break
    stems = dict.fromkeys(INSULTS, INSULT_WEIGHT) | learned
    grammar = Grammar(stems)
    schema = ", ".join(f"{c} double" for c in CATEGORIES) + ", toxic int"
    rows = sample.mapInPandas(_arc_rows(grammar), schema).toPandas()  # at most sample_rows rows of six numbers
    if rows["toxic"].nunique() == 2:
        grammar.weights = _fit(rows[list(CATEGORIES)].to_numpy(float), rows["toxic"].to_numpy(float))
    return grammar


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; every whole text is read."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        tables("toxicity")
        return texts.map(grammar.score)

    return (docs.withColumn("score", of(text_or_empty(text_col)))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
