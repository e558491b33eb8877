"""Toxicity by a weighted finite-state pattern grammar.

Weighted transducers for insults, threats, targets, negation and reported speech are composed into one machine that reads a clause's words as
symbols; a backward machine has marked before which words a target follows. For each insult or threat it emits the word's weight times its
arcs' weights on the channel that the states name: negated or not, reported or not, aimed at a target or not. A word without a target in its
clause weighs less than half of one with it. A text's score is a logistic function of the channels' saturated sums. The lexicon is seeded by hand; the words and stems that mark labelled texts are learnt from training rows, with log-odds weights, and so are the
channels' coefficients, starting from the grammar's own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._cluster import ship
from ._sampling import training_texts

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_SEEDS = {
    INSULT: "idiot idiots moron morons stupid worthless pathetic disgusting scum trash loser losers clown imbecile dumb filth vermin idiota estupido imbecil basura dummkopf abschaum trottel connard ordure",
    THREAT: "kill hurt destroy beat punch stab shoot burn choke crush",
    TARGET: "you your yours you're u he she they him her them these those du dich dir ihr sie tu te toi vous usted ustedes ellos",
    NEGATION: "not no never neither nor don't doesn't didn't isn't aren't wasn't cannot can't won't nicht kein keine nie pas jamais non nunca ni",
    REPORT: "said says say saying claimed claims wrote writes quoted reportedly allegedly according sagte schrieb laut dit disait écrit dijo dice escribió según",
}
_SEED_WEIGHT = {INSULT: 4.0, THREAT: 4.0}
#: Words for which a negation or a target reaches.
NEGATION_REACH, TARGET_REACH = 3, 4
#: Lengths in characters of the stems that may be learnt.
STEMS = (3, 4, 5, 6, 7, 8)
#: Labelled rows used for fitting, at most about this many.
TRAIN_ROWS = 4_000
CHANNELS = 16
#: Words added to each text's length where emissions are taken by length, so that one match in a short text isn't much.
BASE_WORDS = 50


class Transducer:
    """A weighted machine: from ``state`` under ``symbol`` it goes to ``step``, says ``flag`` of the word read, and weighs it by ``weight``."""

    def __init__(self, step: np.ndarray, flag: np.ndarray, weight: np.ndarray | None = None):
        self.step, self.flag = step, flag
        self.weight = np.ones(flag.shape) if weight is None else weight

    def compose(self, other: Transducer) -> Transducer:
        """Both machines on the same input: their flags side by side, the weights of their arcs multiplied."""
        n, m = len(self.step), len(other.step)
        a, b = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        return Transducer(self.step[a] * m + other.step[b], self.flag[a] * (int(other.flag.max()) + 1) + other.flag[b], self.weight[a] * other.weight[b])

    def over(self, alphabet: int) -> Transducer:
        """The same machine on an alphabet ``alphabet`` times as large, of which it reads symbol % its own size."""
        return Transducer(np.tile(self.step, alphabet), np.tile(self.flag, alphabet), np.tile(self.weight, alphabet))

    def read(self, symbols: list[int]) -> Iterator[tuple[int, float]]:
        step, flag, weight, state = self._lists()
        for s in symbols:
            yield flag[state][s], weight[state][s]
            state = step[state][s]

    def _lists(self) -> tuple:
        if not hasattr(self, "_arcs"):
            self._arcs = (self.step.tolist(), self.flag.tolist(), self.weight.tolist())
        return *self._arcs, 0


def _reach(symbol: int, words: int, weight: float = 1.0) -> Transducer:
    """Flag 1, and ``weight``, for ``words`` words after ``symbol``."""
    step = np.maximum(np.arange(words + 1)[:, None] - 1, 0).repeat(6, 1)
    step[:, symbol] = words
    flag = (np.arange(words + 1)[:, None] > 0).astype(int).repeat(6, 1)
    return Transducer(step, flag, np.where(flag, weight, 1.0))


def _since(symbol: int, weight: float) -> Transducer:
    """Flag 1, and ``weight``, from ``symbol`` on."""
    step = np.array([[0] * 6, [1] * 6])
    step[0, symbol] = 1
    flag = np.array([[0] * 6, [1] * 6])
    return Transducer(step, flag, np.where(flag, weight, 1.0))


def _emit() -> Transducer:
    """Flag 0: nothing; 1: an insult; 2: a threat."""
    return Transducer(np.zeros((1, 6), int), np.array([[0, 1, 2, 0, 0, 0]]))


def _either(back: Transducer) -> Transducer:
    """On pairs (symbol, mark of the backward machine): flag 1 where ``back``, reading forward, or the mark says so."""
    flag = np.concatenate([back.flag, np.ones_like(back.flag)], 1)
    return Transducer(np.tile(back.step, 2), flag, np.where(flag, 1.0, _BARE))


#: What an insult or a threat without a target counts of one in a clause with it; and what is left of a negated one, and of a reported one.
_BARE, _NEGATED, _REPORTED = 0.45, 0.5, 0.6
#: Reads a clause from its end, and marks the words that a target follows.
AHEAD = _reach(TARGET, TARGET_REACH)
#: Reads the clause forward, each word's symbol with its mark from AHEAD: a flag is 8 * kind + 4 * negated + 2 * reported + targeted.
GRAMMAR = _emit().compose(_reach(NEGATION, NEGATION_REACH, _NEGATED)).compose(_since(REPORT, _REPORTED)).over(2).compose(_either(_reach(TARGET, TARGET_REACH)))


def read_clause(symbols: list[int], weights: list[float], rates: list[float], out: np.ndarray) -> None:
    """Add what the clause's insults and threats weigh, by word and arc, to the 16 channels, 8 * threat + 4 * negated + 2 * reported + targeted, and their rates to the last place."""
    ahead = [flag for flag, _ in AHEAD.read(symbols[::-1])][::-1]
    for i, (flag, arc) in enumerate(GRAMMAR.read([s + 6 * a for s, a in zip(symbols, ahead)])):
        if flag >= 8:
            out[flag - 8] += weights[i] * arc
            out[CHANNELS] += rates[i] * arc


@dataclass
class Lexicon:
    """Symbol, weight and rate of whole words, and of stems by their length in characters.

    The weight tells how sure one occurrence is; the rate, how much more of a toxic text's words it makes up than of a clean one's.
    """

    words: dict[str, tuple[int, float, float]] = field(default_factory=dict)
    stems: dict[str, tuple[int, float, float]] = field(default_factory=dict)

    def compile(self) -> list[tuple[int, T.HashSet, np.ndarray, np.ndarray, np.ndarray]]:
        """(stem length or 0, hashes, symbols, weights, rates), aligned."""
        out = []
        for length in (0, *sorted({len(s) for s in self.stems})):
            entries = {T.hash_of(k): v for k, v in (self.words.items() if not length else ((k, v) for k, v in self.stems.items() if len(k) == length))}
            keys = T.HashSet(np.array(list(entries), np.uint64))
            values = [entries[int(k)] for k in keys.keys]
            out.append((length, keys, np.array([v[0] for v in values], np.int8), np.array([v[1] for v in values]), np.array([v[2] for v in values])))
        return out


_PART = np.zeros(256, bool)
_PART[list(range(97, 123)) + list(range(65, 91)) + [39] + list(range(128, 256))] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:\n")] = True


def _tokens(column: pa.Array):
    """Lower-cased bytes and offsets, words (runs of letters and apostrophes; any non-ASCII character but general punctuation is a letter)."""
    data, offsets = T.buffers(pc.utf8_lower(pc.fill_null(column, "")))
    inside = _PART[data]
    general = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) if len(data) > 2 else np.zeros(0, int)
    for k in range(3):
        inside[general + k] = False
    return data, offsets, *T.words(data, offsets, inside)


def channels(column: pa.Array, compiled: list) -> np.ndarray:
    """[texts, 17] sums of what their clauses emit, and at last the rates' sum for a hundred words."""
    data, offsets, start, end, first = _tokens(column)
    out = np.zeros((len(offsets) - 1, CHANNELS + 1))
    if not len(start):
        return out
    prefix = T.Prefix(data)
    symbol, weight, rate = np.zeros(len(start), np.int8), np.zeros(len(start)), np.zeros(len(start))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, start)
    lead = np.r_[lead, np.full(max(STEMS) + 1, len(data))]
    for length, keys, symbols, weights, rates in compiled:
        if not len(keys):
            continue
        if length:
            stop = lead[at + length]
            long = np.flatnonzero(stop <= end)
            found = keys.find(prefix.of(start[long], stop[long]))
            word, found = long[found >= 0], found[found >= 0]
        else:
            found = keys.find(prefix.of(start, end))
            word = np.flatnonzero(found >= 0)
            found = found[word]
        # of the entries that a word matches, the weightiest counts
        better = (weights[found] + rates[found] > weight[word] + rate[word]) | (symbol[word] == OTHER)
        symbol[word[better]] = symbols[found[better]]
        weight[word[better]] = weights[found[better]]
        rate[word[better]] = rates[found[better]]
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(hits):
        return out
    stops = np.flatnonzero(_STOP[data])
    bound = np.unique(np.r_[np.searchsorted(start, stops), first])
    doc = np.searchsorted(first, hits, "right") - 1
    for clause, d in dict.fromkeys(zip((np.searchsorted(bound, hits, "right") - 1).tolist(), doc.tolist())):
        a, b = bound[clause], bound[clause + 1]
        read_clause(symbol[a:b].tolist(), weight[a:b].tolist(), rate[a:b].tolist(), out[d])
    out[:, CHANNELS] *= 100 / (np.diff(first) + BASE_WORDS)
    return out


def _marks(text: str) -> tuple[Counter, int]:
    """How often (0, word) and (length, stem) occur in a text; its number of words."""
    data, _, start, end, _ = _tokens(pa.array([text]))
    raw = data.tobytes()
    out: Counter = Counter()
    for w, k in Counter(raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())).items():
        out[0, w] += k
        for length in STEMS:
            if len(w) >= length:
                out[length, w[:length]] += k
    return out, len(start)


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """Seeds, reweighted by the labels, with the words and stems that mark toxic rows.

    A mark must pass a G-test. It gets a weight if its log odds less a standard error reach a bound and it is rare in clean rows, and a rate if
    its share of a text's words is as much higher in toxic rows. Marks are then taken from the surest on; one is left out if a mark taken
    says the same, or if it is far rarer than the commonest and most of its rows have one already: such a mark comes with long or copied toxic
    rows, not with toxicity.
    """
    lexicon = Lexicon({w: (s, _SEED_WEIGHT.get(s, 0.0), _SEED_WEIGHT.get(s, 0.0)) for s, text in _SEEDS.items() for w in text.split()})
    texts = [sorted({t for t, q in rows if q == y}) for y in (0, 1)]  # copies would make chance words look significant
    n = [len(x) for x in texts]
    if not n[0] or not n[1]:
        return lexicon
    seeds = {(0, w) for w, (s, *_) in lexicon.words.items() if s in _SEED_WEIGHT}
    toxic: Counter = Counter()
    for t in texts[1]:
        toxic.update(_marks(t)[0].keys())
    least = max(4, 0.01 * n[1])
    toxic = Counter({k: a for k, a in toxic.items() if a >= least})
    clean: Counter = Counter()
    share = [Counter(), Counter()]
    held: dict[tuple[int, str], list[int]] = {m: [] for m in toxic}
    for y in (0, 1):
        for i, t in enumerate(texts[y]):
            found, words = _marks(t)
            for m, k in found.items():
                if m in toxic or m in seeds:
                    share[y][m] += k / (words + BASE_WORDS) / n[y]
                    if y:
                        held.setdefault(m, []).append(i)
                    else:
                        clean[m] += 1
    marks = []
    for (length, w), a in toxic.items():
        c = clean[length, w]
        both = (a + c) / (n[0] + n[1])
        g = 2 * (a * np.log(a / (n[1] * both)) + (c * np.log(c / (n[0] * both)) if c else 0))
        error = np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        odds = np.log((a + 0.5) / (n[1] + 1)) - np.log((c + 0.5) / (n[0] + 1))
        rate = np.log((share[1][length, w] + 0.002 / n[1]) / (share[0][length, w] + 0.002 / n[0]))
        weight = odds if odds - error >= 2.75 and c <= max(0.5, 0.0015 * n[0]) else 0.0
        rate = rate if rate - error >= 2.25 else 0.0
        if odds > 0 and g >= 18 and (weight or rate) and lexicon.words.get(w, (INSULT,))[0] in (INSULT, THREAT):
            marks.append((-round(g, 6), -(length or 99), w, length, a, float(weight), float(rate)))
    marks.sort()
    covered = np.zeros(n[1], bool)
    taken: list[tuple[str, np.ndarray]] = []
    most = max((m[4] for m in marks), default=0)
    for *_, w, length, a, weight, rate in marks:
        rows_of = np.array(held[length, w])
        related = any((w.startswith(v) or v.startswith(w)) and len(np.intersect1d(rows_of, r)) >= 0.8 * a for v, r in taken)
        if related or (a < 0.25 * most and covered[rows_of].mean() > 0.5):
            continue
        taken.append((w, rows_of))
        covered[rows_of] = True
        symbol = lexicon.words[w][0] if (0, w) in seeds and not length else INSULT
        (lexicon.stems if length else lexicon.words)[w] = (symbol, weight, rate)
    for _, w in seeds:
        if clean[0, w] > toxic[0, w]:
            lexicon.words[w] = (lexicon.words[w][0], min(lexicon.words[w][1], 0.5), min(lexicon.words[w][2], 0.5))
    return lexicon


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray
    bias: float

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(saturate(sums) @ self.coefficients + self.bias)))


def saturate(sums: np.ndarray) -> np.ndarray:
    """Sums pressed into [0, 1]; the rates' share into [0, 2]."""
    out = 1 - np.exp(-sums / 4)
    out[:, CHANNELS] = np.minimum(sums[:, CHANNELS], 12) / 6
    return out


def prior() -> np.ndarray:
    """The grammar's own coefficients: its arcs already weigh negation, report and target; only a threat without a target says next to nothing."""
    out = np.full(CHANNELS + 1, 8.0)
    out[[c for c in range(8, CHANNELS) if not c & 1]] = 1.0
    out[CHANNELS] = 0.0
    return out


def fit(rows: list[tuple[str, int]], rounds: int = 1000, rate: float = 2.0, pull: float = 0.5) -> Model:
    """The lexicon, then coefficients by logistic regression pulled towards :func:`prior`. Without rows: the grammar alone."""
    lexicon = learn_lexicon(rows)
    w0, b = prior(), -3.5
    w = w0.copy()
    texts, y = [t for t, _ in rows], np.array([q for _, q in rows], float)
    if len(set(y.tolist())) == 2:
        compiled = lexicon.compile()
        x = np.concatenate([saturate(channels(pa.array(texts[i : i + 200]), compiled)) for i in range(0, len(texts), 200)])
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(rounds):
            e = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight / len(y)
            w -= rate * (x.T @ e + pull * (w - w0) / len(y))
            b = min(-2.0, b - rate * e.sum())
    return Model(lexicon, np.maximum(w, 0), float(b))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = model.lexicon.compile()
        for b in T.blocks(batches):
            sums = channels(b.column("text"), compiled)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(sums)), pa.array(sums[:, :8].sum(1)), pa.array(sums[:, 8:CHANNELS].sum(1))], ["doc_id", "score", "insult_weight", "threat_weight"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, by: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled texts at most, none of them held out."""
    return fit([(t, int(y)) for t, y in training_texts(docs, labels, "toxic", by, held_out, rows)])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, insult_weight, threat_weight) of each whole text of ``docs(doc_id, text)``.

    Null and empty texts get the score of a text without a match. Repeated rows are scored alike; a null doc_id stays null; other columns
    are not looked at; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double, insult_weight double, threat_weight double")
