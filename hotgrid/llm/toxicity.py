"""Toxicity (operator 9): a weighted finite-state pattern grammar over clauses.

Words become classes: insults (a lexicon of stems with weights, given and learned from
labelled texts), threats, targets, negations and words of reported speech. Small
transducers read the classes of a clause, one composed of them from its start and another
from its end; together they tell for every insult or threat in which pattern it stands:
plain, aimed at a target before or after it, negated or reported. A text's
features are the best clause and the sum over clauses of each pattern, and a logistic
model over these gives the score, so that isolated words count by the clause they are in.
Its weights are tied in order: an aimed insult never counts less than a plain one, that
never less than a reported one, and that never less than a negated one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.common import map_texts, written

#: Labelled rows of each class (toxic or not) that the model is fitted on at most, about.
FIT_ROWS = 8_000
#: Least labelled toxic texts with a stem, least log odds, and the most stems kept.
SUPPORT, ODDS, STEMS = 4, 2.0, 4_000
#: Beginnings of words that may be stems, and the least different words of toxic texts that one has to begin:
#: the beginning of a single word ("worth" of "worthless") tells nothing of other words.
STEM_LENGTHS, FORMS = (5, 6, 7, 9), 3
GIVEN_WEIGHT = 3.0

# Fixed word lists in the four languages of the corpus: common, publicly known words.
INSULTS = """idiot idiots stupid moron morons imbecile scum trash garbage pathetic disgusting loser losers clown worthless dumb fool
vermin filth bastard bitch crap idiota estúpido imbécil basura asqueroso escoria payaso connard imbécile ordure débile crétin salaud
idioten dumm trottel abschaum arschloch versager widerlich""".split()
THREATS = """kill hurt destroy murder beat stab shoot hang burn töten umbringen schlagen vernichten tuer frapper détruire brûler matar
golpear destruir quemar""".split()
TARGETS = """you your yours yourself they them their he him she her these those du dich dir euch ihr sie tu te toi vous ils elles tú ti
usted ustedes ellos ellas""".split()
NEGATIONS = "not no never nobody isn aren wasn don doesn nicht kein keine nie ne pas jamais aucun nunca tampoco ningún".split()
REPORTS = """said says wrote writes called claimed quoted reported allegedly sagte schrieb behauptete zitierte disait écrit affirme dijo
escribió afirmó""".split()

OTHER, BREAK, PAUSE, NEGATION, REPORT, TARGET, THREAT, INSULT = CLASSES = range(8)
PATTERNS = ("plain", "aimed", "negated", "reported", "threat")
#: The constant, and what a pattern's best clause and its sum weigh, before labels are seen; rare patterns stay near it.
BASE, PRIOR = -4.0, np.array([1.0, 1.2, 0.5, 0.5, 1.0, 0.2, 0.2, 0.1, 0.1, 0.2])
#: Patterns from the least weight to the most; threats stand apart.
ORDER = ("negated", "reported", "plain", "aimed")
#: What a pattern's best clause weighs more than that of the pattern before it, at least.
STEP = 0.2
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n|,]")
MEMO = 400_000


def counter(of: int, reach: int, until_break: bool = False, until_pause: bool = False) -> list[list[int]]:
    """A transducer that remembers for ``reach`` words that class ``of`` was read.

    Row: state (words still covered), column: class, value: next state. A comma covers no word.
    """
    table = []
    for state in range(reach + 1):
        row = [max(0, state - 1) if not until_break else state] * len(CLASSES)
        row[PAUSE] = 0 if until_pause else state
        row[BREAK], row[of] = 0, reach
        table.append(row)
    return table


def compose(*machines: list[list[int]]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product of transducers that read the same classes: (table, states of the parts)."""
    states = list(product(*[range(len(m)) for m in machines]))
    at = {s: i for i, s in enumerate(states)}
    return [[at[tuple(m[x][c] for m, x in zip(machines, s, strict=True))] for c in CLASSES] for s in states], states


#: negation covers 5 words of a phrase ("not a complete and utter ..."), a target and a threat 4; reported speech lasts to the clause's end
TABLE, STATES = compose(counter(NEGATION, 5, until_pause=True), counter(REPORT, 1, True), counter(TARGET, 4), counter(THREAT, 4))
#: read from the clause's end: a target within 3 words after ("..., you are")
AHEAD = counter(TARGET, 3)


def _emitted(cls: int, state: tuple[int, ...], ahead: int) -> int | None:
    """The pattern that is complete when ``cls`` is read in ``state``, with ``ahead`` read from the end."""
    negated, reported, aimed, threatened = state
    if cls == INSULT:
        return PATTERNS.index("negated" if negated else "reported" if reported else "aimed" if aimed or ahead else "plain")
    if cls == TARGET and threatened and not negated:
        return PATTERNS.index("reported" if reported else "threat")
    return None


EMIT = [[[_emitted(c, s, x) for c in CLASSES] for s in STATES] for x in range(len(AHEAD))]


@dataclass
class Model:
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.r_[BASE, PRIOR])

    def classify(self, word: str) -> tuple[int, float]:
        w = max((self.stems.get(s, 0.0) for s in stems_of(word)), default=0.0)
        if w > 0:
            return INSULT, w
        return _GIVEN.get(word, OTHER), 1.0


_GIVEN = {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws} | dict.fromkeys(".!?;:\n|", BREAK) | {",": PAUSE}


def stems_of(word: str) -> set[str]:
    """A word's features: itself (closed by $) and its beginnings."""
    return {word + "$", *(word[:n] for n in STEM_LENGTHS if len(word) >= n)} if len(word) > 1 else set()


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def features(self, text: str | None) -> np.ndarray:
        """Best clause and sum over clauses of each pattern; zeros where nothing matches."""
        out = np.zeros(2 * len(PATTERNS))
        if not text:
            return out
        tokens, memo = _TOKEN.findall(text.lower()), self.memo
        try:
            read = [memo[t] for t in tokens]
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for t in set(tokens).difference(memo):
                memo[t] = self.model.classify(t)
            read = [memo[t] for t in tokens]
        if not any(c >= THREAT for c, _ in read):
            return out
        ahead, after = 0, [0] * (len(read) + 1)
        for i in range(len(read) - 1, -1, -1):
            after[i], ahead = ahead, AHEAD[ahead][read[i][0]]
        state, clause = 0, [0.0] * len(PATTERNS)
        for (cls, w), x in zip([*read, (BREAK, 0.0)], after, strict=True):
            if (k := EMIT[x][state][cls]) is not None:
                clause[k] += w
            if cls == BREAK and any(clause):
                best, total = out[: len(PATTERNS)], out[len(PATTERNS) :]
                np.maximum(best, clause, out=best)
                total += clause
                clause = [0.0] * len(PATTERNS)
            state = TABLE[state][cls]
        out[len(PATTERNS) :] = np.log1p(out[len(PATTERNS) :])
        return out

    def score(self, text: str | None) -> float:
        x = float(self.model.weights[0] + self.features(text) @ self.model.weights[1:])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def _bounded(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """At most about ``rows`` labelled texts a class, chosen by a hash of the id; weights of classes."""
    lab = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    have = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    share = {y: min(1.0, rows / n) for y, n in have.items()}
    cut = F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    lab = lab.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < cut * 1_000_000)
    # bounded by 2 x rows ids and labels, so it can be sent to every task; written, as it is read three times
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id")
    return written(sample, "labelled"), {y: 1 / s for y, s in share.items()}


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems with enough labelled toxic texts and enough log odds, with these as weights.

    A whole word (closed by $) counts the texts that have it. A beginning adds up those of the words that
    it begins, and has to begin FORMS different words of toxic texts.
    """

    def count(batches):
        n = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y].update(w for w in set(_TOKEN.findall((text or "").lower())) if len(w) > 1)
        keys = list(n[1] | n[0])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], names=["word", "p", "n"])

    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    p_all, n_all = size.get(1, 0), size.get(0, 0)
    words = sample.select("text", "y").mapInArrow(count, "word string, p long, n long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    stems = F.array(F.concat("word", F.lit("$")), *[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEM_LENGTHS])
    counted = words.select(F.explode(F.array_compact(stems)).alias("stem"), "p", "n").groupBy("stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.count_if(F.col("p") > 0).alias("forms"))
    odds = F.log((F.col("p") + 0.5) / F.lit(p_all + 1.0)) - F.log((F.col("n") + 1.0) / F.lit(n_all + 1.0))
    good = counted.where((F.col("p") >= SUPPORT) & (F.col("stem").endswith("$") | (F.col("forms") >= FORMS)))
    best = good.withColumn("odds", odds).where(F.col("odds") >= ODDS).orderBy((F.col("odds") * F.sqrt("p")).desc(), "stem").limit(STEMS)
    return {w + "$": GIVEN_WEIGHT for w in INSULTS} | {r["stem"]: float(r["odds"]) for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Learn stems on two thirds of a bounded labelled sample, the logistic weights on the rest.

    With no labels of one class the given word lists and default weights are the model. Of an id
    that is labelled twice the higher label holds; other labels than 0 and 1 are left out, and null
    or empty texts have no words.
    """
    sample, weight = _bounded(docs, labels, id_col, text_col, label_col, rows)
    if set(weight) != {0, 1}:
        return Model({w + "$": GIVEN_WEIGHT for w in INSULTS})
    third = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0
    model = Model(learn_stems(sample.where(~third)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def featured(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            x = [scorer.features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    # at most about rows / 3 a class, eleven numbers each
    got = sample.where(third).select("text", "y").mapInArrow(featured, "x array<double>, y int").collect()
    if len({r["y"] for r in got}) == 2:
        x = np.array([[1.0, *r["x"]] for r in got])
        y = np.array([r["y"] for r in got], float)
        model.weights = logistic(x, y, np.array([weight[int(k)] for k in y]))
    return model


def ordered() -> np.ndarray:
    """Weights of the features by steps of the order: a column adds its step to its pattern and to all above it."""
    k = len(PATTERNS)
    one = np.eye(k)
    for i, low in enumerate(ORDER):
        for high in ORDER[i + 1 :]:
            one[PATTERNS.index(high), PATTERNS.index(low)] = 1
    return np.kron(np.eye(2), one)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5, steps: int = 100) -> np.ndarray:
    """Weighted logistic regression by projected Newton steps, drawn to BASE and PRIOR.

    It is fitted over the steps between neighbours in ORDER, which are kept from falling below 0: a
    match never lowers a score, and the patterns' weights keep their order, by STEP at least.
    """
    tied = ordered()
    basis = np.zeros((x.shape[1], x.shape[1]))
    basis[0, 0], basis[1:, 1:] = 1, tied
    x, w = x @ basis, w / w.mean()
    least = np.r_[[STEP * (p in ORDER[1:]) for p in PATTERNS], np.zeros(len(PATTERNS))]
    prior, penalty = np.r_[BASE, np.linalg.solve(tied, PRIOR)], np.full(x.shape[1], ridge)
    low = np.r_[-np.inf, least]
    beta = np.maximum(prior, low)

    def value(at: np.ndarray) -> float:
        z = x @ at
        return float(w @ (y * z - np.logaddexp(0, z)) - penalty @ (at - prior) ** 2 / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - penalty * (beta - prior)
        free = (beta > low) | (grad > 0)  # what lies on its bound and would leave it stays there
        part = x[:, free]
        hess = (part * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part + np.diag(penalty[free])
        step = np.zeros(len(beta))
        step[free] = np.linalg.solve(hess, grad[free])
        tries = (np.maximum(beta + step / 2**k, low) for k in range(20))
        moved = next((t for t in tries if value(t) > value(beta)), beta)
        done, beta = np.abs(moved - beta).max() < 1e-7, moved
        if done:
            break
    return basis @ beta


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; no shuffle.

    A null or empty text, like any text without a match, gets the constant's score. Texts of any length
    are read whole, and equal texts get equal scores. Repeated rows give repeated rows, an empty table none;
    other columns are not read, whatever their names.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(sent.value)

        def f(ids, texts):
            s = [scorer.score(t) for t in texts]
            return {"doc_id": ids, "score": s, "predicted": [int(x >= cutoff) for x in s]}

        return f

    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    return map_texts(df, start, out, "doc_id long, score double, predicted int", id_col, text_col)
