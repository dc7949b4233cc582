"""Toxicity by a weighted finite-state pattern grammar.

A clause is a row of word classes: insults and their stems (learned from labelled rows),
threats, targets, negations, contrasts and reporting verbs (closed lists). Five transducers
read it, each over the output of the one before: negation and reported speech mark the
insults and threats in their scope, the target transducer marks those that are aimed at
someone before or after them, the insult and threat transducers name what is left to score.
They are composed into one deterministic transducer by product construction. What its arcs
put out is summed, times the learned weight of the word, over the clauses of a text, and the
arcs' own weights are fitted on labelled rows; an isolated context word puts out nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster
from .textops import Run, lowered_text, mix64, owner, runs

ROWS_PER_CLASS = 3000
CUT = 0.5
#: Lengths of stems, in bytes.
STEMS = (4, 5, 6, 7, 8)
#: A word or stem is learned if it is so many times as frequent in toxic texts, by this much evidence (G2), beside so many different words.
RATIO, EVIDENCE, COMPANY = 8.0, 24.0, 4
#: Words up to which a negation, or a target, reaches.
REACH = 3

#: Closed classes of function words. Open-class insults are learned.
TARGETS = "you your yours you're u he she they him her them his their du dich dir ihr euch sie tu te toi vous ton ta ils elle tú ti vosotros usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
CONTRASTS = "but however aber sondern doch mais pourtant pero sino".split()
REPORTS = "said says say wrote writes called calls reported quote quoted claims sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split()
THREATS = "kill hurt destroy beat stab shoot murder töten umbringen schlagen tuer frapper matar golpear".split()

_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?;:\n")] = True
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[9, 10, 11, 12, 13, 32, *b".,;:!?\"()[]{}*#%&$|<>"]] = True


# ---- transducers ------------------------------------------------------------------------

#: What a word is: another word, an insult, a threat, a target, a negation, a contrast, a reporting verb.
OTHER, INSULT, THREAT, TARGET, NEGATION, CONTRAST, REPORT = "oihtnbr"

State = tuple
Step = Callable[[State, str], tuple[State, str]]


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: (state, symbol) to (state, output)."""

    start: State
    arcs: dict[tuple[State, str], tuple[State, str]]

    @classmethod
    def of(cls, start: State, alphabet: Iterable[str], step: Step) -> Transducer:
        """All arcs that can be reached under ``step``."""
        arcs, todo, seen = {}, [start], {start}
        symbols = sorted(alphabet)
        while todo:
            s = todo.pop()
            for a in symbols:
                arcs[s, a] = t, _ = step(s, a)
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return cls(start, arcs)

    @property
    def alphabet(self) -> set[str]:
        return {a for _, a in self.arcs}

    @property
    def outputs(self) -> set[str]:
        return {b for _, b in self.arcs.values()}

    def then(self, after: Transducer) -> Transducer:
        """Composition: ``after`` reads what this one writes. Its states are pairs of theirs."""

        def step(s: State, a: str) -> tuple[State, str]:
            t, b = self.arcs[s[0], a]
            u, c = after.arcs[s[1], b]
            return (t, u), c

        return Transducer.of((self.start, after.start), self.alphabet, step)

    def run(self, symbols: Iterable[str]) -> list[str]:
        s, out = self.start, []
        for a in symbols:
            s, b = self.arcs[s, a]
            out.append(b)
        return out


def negation(reach: int = REACH) -> Transducer:
    """State: words that a negation still reaches. An insult in reach becomes ``j``, a threat ``g``; a contrast ends the reach."""

    def step(s: State, a: str) -> tuple[State, str]:
        left = s[0]
        if a == NEGATION:
            return (reach,), OTHER
        if a == CONTRAST:
            return (0,), OTHER
        out = {INSULT: "j", THREAT: "g"}.get(a, a) if left else a
        return (max(0, left - 1),), out

    return Transducer.of((0,), [OTHER, INSULT, THREAT, TARGET, NEGATION, CONTRAST, REPORT], step)


def reported() -> Transducer:
    """State: nothing yet, an insult or threat said outright, or a reporting verb.

    After the verb all is reported (``q``); a verb after the fact takes it back (``u``).
    """

    def step(s: State, a: str) -> tuple[State, str]:
        if a == REPORT:
            return ("told",), "u" if s[0] == "said" else OTHER
        if a in "ihjg":
            return (s, "q") if s[0] == "told" else (("said",) if a in "ih" else s, a)
        return s, a

    return Transducer.of(("open",), [OTHER, INSULT, THREAT, TARGET, REPORT, "j", "g"], step)


def targeted(reach: int = REACH) -> Transducer:
    """State: words that a target still reaches, what waits for a target, and how long.

    An insult in reach is aimed (``I``), a threat too (``H``); a target soon after one aims it
    then (``A``, ``K``).
    """

    def step(s: State, a: str) -> tuple[State, str]:
        aim, wait, left = s
        after = (wait, left - 1) if left > 1 else ("", 0)
        if a == TARGET:
            return (reach, "", 0), {INSULT: "A", THREAT: "K"}.get(wait, OTHER)
        if a in (INSULT, THREAT):
            return ((aim - 1, *after), a.upper()) if aim else ((0, a, reach), a)
        return (max(0, aim - 1), *after), a

    return Transducer.of((0, "", 0), [OTHER, INSULT, THREAT, TARGET, "j", "g", "q", "u"], step)


def insulting() -> Transducer:
    """State: whether the clause has an insult. The first, further, negated, reported and aimed ones are named."""
    names = {INSULT: "insult", "I": "aimed insult", "A": "late aim", "j": "negated insult", "q": "reported", "u": "late report"}

    def step(s: State, a: str) -> tuple[State, str]:
        if a in (INSULT, "I"):
            return (True,), "further insult" if s[0] else names[a]
        return s, names.get(a, a)

    return Transducer.of((False,), [OTHER, *names, THREAT, "H", "K", "g"], step)


def threatening() -> Transducer:
    """State: whether the clause has an aimed threat. A threat counts fully once it is aimed."""
    names = {THREAT: "idle threat", "H": "aimed threat", "K": "aimed threat", "g": "negated threat"}

    def step(s: State, a: str) -> tuple[State, str]:
        if a in ("H", "K"):
            return (True,), OTHER if s[0] else names[a]
        return s, names.get(a, a)

    return Transducer.of((False,), [OTHER, *names, *(insulting().outputs - set(names) - {OTHER})], step)


def grammar(without: str | None = None) -> Transducer:
    """The composed transducer; ``without`` leaves one class of words out (its words are others)."""
    whole = negation().then(reported()).then(targeted()).then(insulting()).then(threatening())
    if without is None:
        return whole
    return Transducer.of((), [OTHER, INSULT, THREAT, TARGET, NEGATION, CONTRAST, REPORT], lambda s, a: (s, OTHER if a == without else a)).then(whole)


#: What an output weighs before anything is learned, relative to a plain insult.
WEIGHTS = {"insult": 1.0, "aimed insult": 1.3, "further insult": 0.7, "late aim": 0.3, "negated insult": 0.0, "reported": 0.0, "late report": -1.0, "idle threat": 0.0, "aimed threat": 1.0, "negated threat": 0.0}
LABELS = list(WEIGHTS)


# ---- the lexicon ------------------------------------------------------------------------


@dataclass
class Lexicon:
    """Learned insults: hashes of words, and of stems by their length in bytes, with weights."""

    words: dict[int, float] = field(default_factory=dict)
    stems: dict[int, dict[int, float]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)


def word_key(word: bytes) -> int:
    """The hash that Run.hash gives to these bytes."""
    run = Run(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    return int(run.hash(np.array([0]), np.array([len(word)]))[0])


_CLOSED = {word_key(w.encode()): kind for kind, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (CONTRAST, CONTRASTS), (REPORT, REPORTS), (THREAT, THREATS)) for w in group}


def words_of(run: Run) -> tuple[Run, np.ndarray, np.ndarray, np.ndarray]:
    """The run in lower case, and its words without punctuation."""
    low = lowered_text(run)
    return low, *low.spans(~_OUTSIDE[low.buf])


def stem_hashes(low: Run, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than ``n`` bytes and could be cut there, and the hashes of their starts."""
    longer = np.flatnonzero(ends - starts > n)
    longer = longer[(low.buf[starts[longer] + n] & 0xC0) != 0x80]  # a stem never ends within a character
    return longer, low.hash(starts[longer], starts[longer] + n)


def learned(h: np.ndarray, toxic: np.ndarray, company: np.ndarray, total: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences with hash ``h``: the hashes that are much more frequent where ``toxic``, their weights and evidence."""
    keys, at = np.unique(h, return_inverse=True)
    n1 = np.bincount(at, weights=toxic, minlength=len(keys))
    n0 = np.bincount(at, minlength=len(keys)) - n1
    r1, r0 = (n1 + 0.5) / (total[1] + 1), (n0 + 0.5) / (total[0] + 1)
    seen, all_ = n1 + n0, sum(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(n1 > 0, n1 * np.log(n1 * all_ / (seen * total[1])), 0) + np.where(n0 > 0, n0 * np.log(n0 * all_ / (seen * total[0])), 0))
    ok = (r1 > RATIO * r0) & (g2 >= EVIDENCE)
    if ok.any():
        mine = ok[at] & (toxic > 0)
        pairs = np.unique(np.stack([at[mine], company[mine].view(np.int64)]), axis=1)
        ok &= np.bincount(pairs[0], minlength=len(keys)) >= COMPANY
    return keys[ok], np.log(r1 / r0)[ok], g2[ok]


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """Words and stems that toxic texts have much more often than others.

    They must stand beside different words, or they may be one copied passage; a stem must
    carry different words, or it is one word. Of stems that begin alike the one with the
    most evidence stays.
    """
    runs_, toxic, before = [], [], []
    total = [0, 0]
    for run in runs(pa.array([t for t, _ in rows], pa.large_string())):
        low, starts, ends, offs = words_of(run)
        who, h = owner(offs), low.hash(starts, ends)
        low.forget()
        prev = np.append(np.uint64(0), h[:-1])
        # a word counts once a text
        once = np.unique(mix64(h) + who.astype(np.uint64), return_index=True)[1]
        starts, ends, h = starts[once], ends[once], h[once]
        y = np.array([rows[run.first + k][1] for k in range(len(run))])[who[once]]
        runs_.append((low, starts, ends, h))
        toxic.append(y)
        before.append(prev[once])
        total[1] += int(y.sum())
        total[0] += int(len(y) - y.sum())
    out = Lexicon()
    if not min(total):
        return out
    closed = np.fromiter(_CLOSED, np.uint64, len(_CLOSED))
    h, y, prev = np.concatenate([r[3] for r in runs_]), np.concatenate(toxic), np.concatenate(before)
    keys, weights, _ = learned(h, y, prev, tuple(total))
    for k, w in zip(keys.tolist(), weights.tolist(), strict=True):
        if k not in _CLOSED:
            out.words[k] = w
    taken: list[tuple[float, int, int, float, bytes]] = []
    for n in STEMS:
        parts = []
        for low, starts, ends, _ in runs_:
            parts.append(stem_hashes(low, starts, ends, n))
            low.forget()
        g = np.concatenate([p[1] for p in parts])
        flags = np.concatenate([y_[p[0]] for p, y_ in zip(parts, toxic, strict=True)])
        carried = np.concatenate([r[3][p[0]] for p, r in zip(parts, runs_, strict=True)])
        open_ = ~np.isin(carried, closed)
        keys, weights, g2 = learned(g[open_], flags[open_], carried[open_], tuple(total))
        for k, w, e in zip(keys.tolist(), weights.tolist(), g2.tolist(), strict=True):
            taken.append((e, n, k, w, spelled(runs_, parts, k, n)))
    chosen: list[bytes] = []
    for _, n, k, w, name in sorted(taken, reverse=True):
        if not any(name.startswith(c) or c.startswith(name) for c in chosen):
            chosen.append(name)
            out.stems.setdefault(n, {})[k] = w
    out.names = sorted([spelled(runs_, [(np.arange(len(r[3])), r[3]) for r in runs_], k, None).decode() for k in out.words] + [c.decode() + "-" for c in chosen])
    return out


def spelled(runs_: list, parts: list, key: int, n: int | None) -> bytes:
    """The bytes of a word or stem, from where it first stands."""
    for (low, starts, ends, _), (rows, h) in zip(runs_, parts, strict=True):
        at = np.flatnonzero(h == np.uint64(key))
        if len(at):
            i = rows[at[0]]
            return low.buf[starts[i] : ends[i] if n is None else starts[i] + n].tobytes()
    raise KeyError(key)


# ---- scoring ----------------------------------------------------------------------------

_WHOLE = grammar()


def outputs(run: Run, lexicon: Lexicon, fst: Transducer = _WHOLE) -> tuple[np.ndarray, np.ndarray]:
    """By text: the summed word weights of each of LABELS that its clauses put out, and its number of words."""
    low, starts, ends, offs = words_of(run)
    total = np.zeros((len(run), len(LABELS)))
    if not len(starts):
        return total, np.diff(offs)
    h = low.hash(starts, ends)
    weight = np.zeros(len(h))
    for n, stems in lexicon.stems.items():
        rows, g = stem_hashes(low, starts, ends, n)
        look_up(weight, rows, g, stems)
    look_up(weight, np.arange(len(h)), h, lexicon.words)
    kind = np.where(weight > 0, INSULT, OTHER)
    closed = np.flatnonzero(np.isin(h, np.fromiter(_CLOSED, np.uint64, len(_CLOSED))))
    for i in closed.tolist():
        kind[i] = _CLOSED[int(h[i])]
    weight[kind == THREAT] = THREAT_WEIGHT
    hit = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(hit):
        return total, np.diff(offs)
    stops = np.zeros(len(low.buf) + 1, np.int64)
    np.cumsum(_BREAK[low.buf], out=stops[1:])
    who = owner(offs)
    clause = stops[starts] + who  # a text begins a clause of its own
    first, last = np.searchsorted(clause, clause[hit], "left"), np.searchsorted(clause, clause[hit], "right")
    place = {x: i for i, x in enumerate(LABELS)}
    for a, b in sorted(set(zip(first.tolist(), last.tolist(), strict=True))):
        own, said = total[who[a]], 0.0
        for w, out in zip(weight[a:b].tolist(), fst.run(kind[a:b].tolist()), strict=True):
            said = w or said  # a late aim or report weighs as what it comes after
            if out in place:
                own[place[out]] += said
    return total, np.diff(offs)


#: The weight of a threatening word: what an insult has that is about twenty times as frequent in toxic texts.
THREAT_WEIGHT = 3.0


def look_up(weight: np.ndarray, rows: np.ndarray, h: np.ndarray, known: dict[int, float]) -> None:
    """Raises ``weight`` of ``rows`` to what is known of their hashes."""
    if known and len(rows):
        keys = np.fromiter(known, np.uint64, len(known))
        order = np.argsort(keys)
        keys, values = keys[order], np.fromiter(known.values(), float, len(known))[order]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        np.maximum.at(weight, rows, np.where(keys[at] == h, values[at], 0.0))


def evidence(found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Outputs against the root of the text's length, as chance hits grow."""
    total, n = found
    return total / np.sqrt(n + 25.0)[:, None]


@dataclass
class Model:
    lexicon: Lexicon
    base: float
    weights: np.ndarray  # of LABELS

    def score(self, run: Run, fst: Transducer = _WHOLE) -> np.ndarray:
        z = self.base + evidence(outputs(run, self.lexicon, fst)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_arcs(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Base and weights of a logistic model whose weights are drawn to a common slope times WEIGHTS.

    Newton steps, each halved until the penalised likelihood grows; raises where that doesn't come to rest.
    """
    prior = np.array([*WEIGHTS.values()])
    # columns: base, common slope, and each output's departure from it
    a = np.concatenate([np.ones((len(x), 1)), (x @ prior)[:, None], x], 1)
    penalty = np.array([1e-6, 1e-3, *[ridge] * len(prior)])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2)

    w = np.zeros(a.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() <= 1e-7:
            return float(w[0]), w[1] * prior + w[2:]
    raise ArithmeticError("the weights don't converge")


def train(rows: list[tuple[str, int]], prior: float | None = None, fst: Transducer = _WHOLE) -> Model | None:
    """From (text, label) rows. prior: the share of label 1 that the scores are calibrated to.

    The arcs are fitted on what each half of the rows puts out under the lexicon of the other.
    """
    y = np.array([v for _, v in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    found = np.zeros((len(rows), len(LABELS)))
    for k in (0, 1):
        other = learn(rows[1 - k :: 2])
        found[k::2] = np.concatenate([np.zeros((0, len(LABELS)))] + [evidence(outputs(r, other, fst)) for r in runs(pa.array([t for t, _ in rows[k::2]], pa.large_string()))])
    base, weights = fit_arcs(found, y)
    if prior is not None and 0 < prior < 1:
        share = y.mean()
        base += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Model(learn(rows), base, weights)


def fit(docs: DataFrame, labels: DataFrame, seen, per_class: int = ROWS_PER_CLASS) -> Model | None:
    rows = cluster.labelled_sample(docs, labels, "toxic", per_class, seen)
    share = labels.where(seen & F.col("toxic").isin(0, 1)).agg(F.avg("toxic").alias("p")).first()["p"]
    return train(rows, share)


def classify(docs: DataFrame, model: Model | None, keep: list[str], cut: float = CUT) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score, predicted and clause_weight.

    Null and empty texts have no clause and score as the base rate of texts without one;
    without labels of both kinds all score 0. Texts are read whole, whatever their length;
    repeated rows score alike.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer").add("clause_weight", "double")
    default = np.array([*WEIGHTS.values()])

    def score(batches):
        m = shipped.value
        for batch in batches:
            z, weight = [np.zeros(0)], [np.zeros(0)]
            for run in runs(batch.column("_text")):
                found = outputs(run, m.lexicon) if m else (np.zeros((len(run), len(LABELS))), np.zeros(len(run)))
                weight.append(found[0] @ default)
                z.append(m.base + evidence(found) @ m.weights if m else np.full(len(run), -np.inf))
            with np.errstate(over="ignore"):
                s = 1 / (1 + np.exp(-np.concatenate(z)))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(np.concatenate(weight))], names=[*keep, "score", "predicted", "clause_weight"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(cluster.frugal(score), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cluster.table(spark, sf_dir, "documents")
    held = cluster.fold("doc_id", 5, 0)
    model = fit(docs, cluster.table(spark, sf_dir, "labels"), ~held)
    return classify(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
