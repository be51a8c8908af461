"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to symbols with a weight: insults (words and stems learned from labelled texts), threats,
targets, negations and reporting verbs.  Four small transducers rewrite the weights of a clause's symbols: a target near an
insult or a threat adds to it, a threat without a target counts little, a negation and reported speech take away.  They are
composed into one machine by pairing their states; a clause's weight is the weight of its path, and only matched clauses
count.  A document's score is a logistic function of its strongest clause and of all its clauses.

Lexicon and logistic function are learned from a bounded sample of labelled rows: about ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``
rows of together ``SAMPLE_TOTAL`` characters, never ones that are held out.  Only texts enter a score.

Nulls: a null text is scored like an empty one, lowest of all; a null doc_id counts as held out.  Null labels are ignored.
Equal texts get equal scores.  Without usable labels only the fixed threat words are known.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import arrow_map, bounded_batches, cut, sampled, text_or_empty

#: Bounds of the training sample: rows by label, characters of a text that is used to train, and of all of them.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, SAMPLE_TOTAL = 2_000, 6_000, 50_000, 40_000_000
#: A learned entry is in at least so many toxic texts, and in such a share of them; its cautious log-odds are at least these.
STEMS, MIN_TEXTS, MIN_SHARE, LEAST_ODDS = range(4, 9), 3, 0.01, 2.0
#: Held out: documents whose crc32(doc_id as text) is 0 modulo this.
FOLDS = 5

#: Words of the other symbols (English, German, French, Spanish).
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb jerk idiota estúpido imbécil imbécile connard dumm abschaum".split()
THREATS = "kill hurt destroy beat töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours yourself du dich dir dein ihr euch sie tu te toi ton vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca ningún".split()
REPORTS = "said says wrote told quoted called claimed sagte schrieb nannte dit écrit appelle dijo escribió llamó".split()
OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = "oynrti"

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.;:!?\n]+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic, over symbols: arcs[state][symbol] = (state, added weight, factor); unnamed symbols loop."""

    arcs: tuple[dict[str, tuple[int, float, float]], ...]

    def step(self, state: int, symbol: str) -> tuple[int, float, float]:
        return self.arcs[state].get(symbol, (state, 0.0, 1.0))


#: A target before or after an abusive word of the clause strengthens it.
TARGETING = Transducer(({TARGET: (1, 0, 1), INSULT: (2, 0, 1), THREAT: (2, -3, 1)}, {INSULT: (1, 1, 1), THREAT: (1, 2, 1)}, {TARGET: (1, 1, 1)}))
#: A negation weakens what comes within the next three words.
NEGATING = Transducer(({NEGATION: (1, 0, 1)}, {OTHER: (2, 0, 1), INSULT: (0, 0, 0.5), THREAT: (0, 0, 0.5)}, {OTHER: (3, 0, 1), INSULT: (0, 0, 0.5), THREAT: (0, 0, 0.5)}, {OTHER: (0, 0, 1), INSULT: (0, 0, 0.5), THREAT: (0, 0, 0.5)}))
#: After a reporting verb the clause gives someone else's words.
REPORTING = Transducer(({REPORT: (1, 0, 1)}, {INSULT: (1, 0, 0.7), THREAT: (1, 0, 0.5)}))
#: A second abusive word of a clause counts in part.
REPEATING = Transducer(({INSULT: (1, 0, 1), THREAT: (1, 0, 1)}, {INSULT: (1, 0, 0.5), THREAT: (1, 0, 0.5)}))


def compose(*machines: Transducer) -> Transducer:
    """One machine whose states are tuples of states; weights add up and factors multiply."""
    states = list(product(*(range(len(m.arcs)) for m in machines)))
    number = {s: k for k, s in enumerate(states)}
    arcs = []
    for state in states:
        row = {}
        for symbol in (OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT):
            steps = [m.step(s, symbol) for m, s in zip(machines, state, strict=True)]
            row[symbol] = (number[tuple(x[0] for x in steps)], float(sum(x[1] for x in steps)), math.prod(x[2] for x in steps))
        arcs.append(row)
    return Transducer(tuple(arcs))


GRAMMAR = compose(TARGETING, NEGATING, REPORTING, REPEATING)


class Lexicon(dict):
    """Word to (symbol, weight); stems match words that begin with them.  Looked-up words are kept, up to a bound."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.stems = {e[:-1]: w for e, w in entries.items() if e.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.fixed = {w: (INSULT, 4.0) for w in INSULTS}
        self.fixed |= {w: (s, 4.0 if s == THREAT else 0.0) for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.fixed |= {w: (INSULT, x) for w, x in entries.items() if not w.endswith("*")}

    def __missing__(self, word: str):
        found = self.fixed.get(word)
        if found is None or found[0] != INSULT:
            weights = [self.stems[word[:n]] for n in self.lengths if len(word) >= n and word[:n] in self.stems]
            found = (INSULT, max(weights)) if weights else found
        if len(self) > 300_000:
            self.clear()
        self[word] = found
        return found


def clause_weights(text: str, lexicon: Lexicon) -> tuple[float, float]:
    """(weight of the strongest clause, weight of all matched clauses) of a text."""
    text = text.lower()
    words = _WORD.findall(text)
    if not {INSULT, THREAT} & {x[0] for x in filter(None, map(lexicon.__getitem__, words))}:
        return 0.0, 0.0
    best = total = 0.0
    for clause in _CLAUSE.split(text):
        symbols = [lexicon[w] or (OTHER, 0.0) for w in _WORD.findall(clause)]
        state, weight, matched = 0, 0.0, False
        for symbol, w in symbols:
            state, added, factor = GRAMMAR.arcs[state][symbol]
            weight += added + w * factor if symbol in (INSULT, THREAT) else added
            matched |= symbol in (INSULT, THREAT)
        if matched and weight > 0:
            best, total = max(best, weight), total + weight
    return best, total


def near_key(text: str) -> int:
    """The least hash of a text's five-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return min((zlib.crc32(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))), default=0)


def learn_lexicon(texts: list[str], toxic: list[int]) -> dict[str, float]:
    """Words and stems (with a trailing ``*``) that labelled toxic texts have far more often, with their log-odds.

    An entry must be in several toxic texts, and its log-odds must stay high at the cautious end of their error.  Near copies
    would make a chance word look frequent, so of texts with the same least shingle hash only one counts.
    """
    pairs = list({(near_key(x), y): (x, y) for x, y in zip(texts, toxic, strict=True)}.values())
    texts, toxic = [x for x, _ in pairs], [y for _, y in pairs]

    def terms(text: str) -> set[str]:
        words = set(_WORD.findall(text.lower()))
        return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}

    bad = Counter(t for x, y in zip(texts, toxic, strict=True) if y for t in terms(x))
    bad = {t: n for t, n in bad.items() if n >= max(MIN_TEXTS, MIN_SHARE * sum(toxic))}
    good: Counter = Counter()
    for x, y in zip(texts, toxic, strict=True):
        if not y:
            good.update(terms(x) & bad.keys())
    n_bad = sum(toxic)
    n_good = len(toxic) - n_bad
    found = {}
    for t, n in bad.items():
        m = good[t]
        odds = math.log((n + 0.5) / (n_bad + 1)) - math.log((m + 0.5) / (n_good + 1))
        if odds - 1.64 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)) > LEAST_ODDS:
            found[t] = round(odds, 6)
    return found


def fit_logistic(rows: list[tuple[float, float]], labels: list[int]) -> tuple[float, float, float]:
    """(bias, weight of the strongest clause, weight of log(1 + all)), by Newton steps with a ridge."""
    import numpy as np

    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return -4.0, 1.0, 0.0
    x = np.array([(1.0, b, math.log1p(t)) for b, t in rows])
    w, ridge = np.zeros(3), np.diag([0.01, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return tuple(float(v) for v in w)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    lexicon: dict[str, float]
    bias: float
    best: float
    total: float


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of documents that are not held out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    chosen = sampled(usable.where("__toxic = 1"), [F.col("doc_id")], SAMPLE_TOXIC).union(sampled(usable.where("__toxic = 0"), [F.col("doc_id")], SAMPLE_CLEAN))
    rows = docs.select("doc_id", text_or_empty().alias("__text")).where(F.length("__text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    rows = sampled(cut(rows), [F.col("doc_id"), F.col("__text")], SAMPLE_TOXIC + SAMPLE_CLEAN, F.length("__text"), SAMPLE_TOTAL)
    rows = sorted((r["doc_id"], r["__text"], r["__toxic"]) for r in rows.collect())
    texts, toxic = [r[1] for r in rows], [r[2] for r in rows]
    # the logistic function is fitted on the half of the sample that its lexicon has not seen, then the lexicon on all of it
    half = Lexicon(learn_lexicon(texts[::2], toxic[::2]))
    bias, best, total = fit_logistic([clause_weights(t, half) for t in texts[1::2]], toxic[1::2])
    return Model(learn_lexicon(texts, toxic), bias, best, total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, clauses) of ``docs`` (doc_id, text); ``clauses`` is the weight of all matched clauses."""
    lexicon, bias, best, total = Lexicon(model.lexicon), model.bias, model.best, model.total

    def rows(ids, texts):
        for doc, text in zip(ids, texts, strict=True):
            b, t = clause_weights(text, lexicon)
            x = bias + best * b + total * math.log1p(t)
            yield doc, 1 / (1 + math.exp(-max(-60.0, min(60.0, x)))), t

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_or_empty()), rows, "doc_id long, score double, clauses double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses)."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below one half, as they are; null and empty texts stay."""
    lexicon, bias, best, total = Lexicon(model.lexicon), model.bias, model.best, model.total
    place = docs.columns.index("text")
    bounded_batches(docs.sparkSession)

    def keep(batches):
        for batch in batches:
            clean = []
            for text in batch.column(place).to_pylist():
                b, t = clause_weights(text or "", lexicon)
                clean.append(not t or bias + best * b + total * math.log1p(t) < 0)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
