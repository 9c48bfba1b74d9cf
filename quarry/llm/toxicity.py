"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of three letters (a word's start is one), gaps allowed: each occurrence that spans
s letters weighs decay ** s, and spans over `SPAN` letters count as 0.  So `idxiot` or `i.d.i.o.t` stay
near `idiot`; a digit or sign counts as no letter, so `id1ot` is `idot`.  Landmarks give the Nyström map of the kernel: first the words that most sentences of either label hold,
then in each round the examples that the machine of the round before got most wrong, its support vectors.

The machine (linear in that map, squared hinge loss) is trained on labelled sentences: a sentence's decision is the highest
of its words' ones.  Every word of a sentence labelled 0 is an example of that label.  A sentence
labelled 1 gives its witness, the highest word by the machine of the round before (in the first round by how much more often
sentences of that label hold it), and each word as far as that label surely holds it more often.  Both come with gapped copies, one
letter put in or left out, so that the machine learns what a gap costs; a copy that is a word of a sentence labelled 0 isn't
one.  A word that no sentence holds and that differs from an insult by one letter (`looser`) is taken for its copy.  Because the map is
linear in the kernel values, the machine folds into one weight for each subsequence.  A logistic
function of the sentence's decision, fitted on the same sentences, is its score.

No letter is cut off.  A token's letters are tried joined and, where signs part them, in parts; a stretch
of more than `WORD_LETTERS` letters (run-on text, scripts without blanks) is tried in windows that begin at
each of its letters, and its decision is the highest.  Tokens of one or two letters in a row are tried
joined too, so that `i d i o t` stays near `idiot`.

Edge cases: null and empty texts, and texts without words, get the lowest decision, -1; very long texts are
scored whole; labels that are null or of no document are not learnt
from; a document labelled twice counts twice; without both labels every score is 0; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import groupby
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written
from ._streams import pieces

DECAY = 0.85
SPAN = 6
#: Letters of a word; what is longer isn't a word but an encoding or a run-on, and goes through windows.
WORD_LETTERS = 40
#: Letters of the windows, one of each width at every letter, and windows that are held at once.
WIDTHS, HELD = (6, 9, 12), 4000
#: Labelled rows of each label that may be fitted on, about; first landmarks, and support vectors of either label added in a round.
FIT_ROWS, LANDMARKS, HARD = 1000, 240, (150, 75)
#: Weight of all gapped copies of a witness against its own, and letters that a word must have to get copies.
GAPPED, COPIED = 1.0, 5
#: Rounds of witnesses, and steps of Newton's method in each at most.
ROUNDS, STEPS = 3, 10
PENALTY = 0.001
#: Tables of the fit, which is on a bounded sample, go to as many partitions.
FIT_PARTS = 8
#: Tokens of at most LONGEST characters that a worker remembers; the table starts anew when it is full.
REMEMBERED, LONGEST = 400_000, 48
#: Stands before every word, so that its beginning counts; the code before that of `a`.
START = "`"
_CODES = 64
_DIM = _CODES**3
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]


def letters_of(token: str) -> str:
    """A token's letters in lower case: signs put between them don't count."""
    low = token.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def parts_of(token: str) -> list[str]:
    """The stretches of at least three letters that signs part in a token; none if nothing parts it."""
    low = token.lower()
    return [] if low.isalpha() else [p for p in re.split(r"[\W\d_]+", low) if len(p) > 2 and p.isalpha()]


def words_of(token: str) -> set[str]:
    """What the fit learns of a token: its letters and its parts, long ones in windows of `WORD_LETTERS` that overlap by half."""
    found = set()
    for word in (letters_of(token), *parts_of(token)):
        if len(word) <= WORD_LETTERS:
            found.add(word)
        else:
            found.update(word[at : at + WORD_LETTERS] for at in range(0, len(word) - WORD_LETTERS // 2, WORD_LETTERS // 2))
    return {w for w in found if len(w) > 2}


def _subsequences(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every subsequence of three letters of every word."""
    joined = "".join(START + t for t in tokens)
    owner = np.repeat(np.arange(len(tokens)), [len(t) + 1 for t in tokens])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    code = np.where((points >= 96) & (points < 123), points - 96, 27 + points % 37)
    word, key, weight = [], [], []
    for a, b in _GAPS:
        n = len(code) - a - b
        if n <= 0:
            continue
        same = np.flatnonzero(owner[:n] == owner[a + b :])
        word.append(owner[same])
        key.append((code[same] * _CODES + code[same + a]) * _CODES + code[same + a + b])
        weight.append(np.full(len(same), DECAY ** (a + b + 1)))
    if not word:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(word), np.concatenate(key), np.concatenate(weight)


def _features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences summed by word and code, scaled so that a word's kernel with itself is 1."""
    word, key, weight = _subsequences(tokens)
    both, where = np.unique(word * _DIM + key, return_inverse=True)
    total = np.bincount(where, weights=weight, minlength=len(both))
    word, key = both // _DIM, both % _DIM
    norm = np.sqrt(np.bincount(word, weights=total**2, minlength=len(tokens)))
    return word, key, total / norm[word]


def gapped(word: str) -> list[str]:
    """Copies of a word with one foreign letter put in (drawn by the word and the place), and with one inner letter left out."""
    if len(word) < COPIED:
        return []
    draw = random.Random(word)
    foreign = [c for c in ascii_lowercase if c not in word] or list(ascii_lowercase)
    return [word[:k] + draw.choice(foreign) + word[k:] for k in range(1, len(word))] + [word[:k] + word[k + 1 :] for k in range(1, len(word) - 1)]


def kernel(x: str, y: str) -> float:
    """The normalised kernel of two words (0 if one has fewer than three letters)."""
    word, key, value = _features([letters_of(x), letters_of(y)])
    left, right = dict(zip(key[word == 0], value[word == 0])), dict(zip(key[word == 1], value[word == 1]))
    return float(sum(v * right.get(k, 0.0) for k, v in left.items()))


class Machine:
    """The fitted machine: weights of subsequences, offset, and slope and place of the logistic function."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float = 0.0, place: float = -30.0):
        self.weights, self.offset, self.slope, self.place = weights, offset, slope, place
        #: Highest decisions of tokens, and the letters of short ones.
        self._known: dict[str, float] = {}
        self._short: dict[str, str] = {}

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return at, self.weights[at], self.offset, self.slope, self.place

    def __setstate__(self, state):
        at, values, *rest = state
        weights = np.zeros(_DIM)
        weights[at] = values
        self.__init__(weights, *rest)

    def decisions(self, words: list[str]) -> np.ndarray:
        """The machine's decision of each word; words too short for the kernel get the offset."""
        if not words:
            return np.empty(0)
        word, key, value = _features(words)
        return np.bincount(word, weights=value * self.weights[key], minlength=len(words)) + self.offset

    def highest(self, word: str) -> float:
        """The highest decision of the windows of a long stretch of letters."""
        best, held = -np.inf, set()
        for width in WIDTHS:
            for at in range(len(word) - width + 1):
                held.add(word[at : at + width])
                if len(held) == HELD:
                    best, held = max(best, float(self.decisions(list(held)).max())), set()
        return max(best, float(self.decisions(list(held)).max())) if held else best

    def _readings(self, groups: list[list[str]]) -> list[float]:
        """The highest decision of each group of words, over all their letters."""
        flat = [w for group in groups for w in group]
        usual = [w for w in flat if len(w) <= WORD_LETTERS]
        found = iter(np.concatenate([self.decisions(usual[at : at + HELD]) for at in range(0, len(usual), HELD)]).tolist() if usual else ())
        each = iter([next(found) if len(w) <= WORD_LETTERS else self.highest(w) for w in flat])
        return [max(next(each) for _ in group) for group in groups]

    def _learn(self, tokens: list[str]) -> None:
        letters = list(map(letters_of, tokens))
        self._short.update((t, w) for t, w in zip(tokens, letters) if len(w) < 3)
        rest = [(t, [w, *parts_of(t)]) for t, w in zip(tokens, letters) if len(w) > 2]
        self._known.update((t, -1.0) for t, w in zip(tokens, letters) if len(w) < 3)
        self._known.update(zip((t for t, _ in rest), self._readings([g for _, g in rest])))

    def _runs(self, tokens: list[str]) -> list[list[str]]:
        """What short tokens in a row spell, whole and in windows; signs between them don't count."""
        out = []
        for short, run in groupby(map(self._short.get, tokens), lambda w: w is not None):
            if short and len(run := [w for w in run if w]) > 1 and len(word := "".join(run)) > 2:
                out.append([word] + [word[at : at + width] for width in WIDTHS for at in range(len(word) - width + 1)] if len(word) <= WORD_LETTERS else [word])
        return out

    def sentences(self, texts: list[str | None]) -> list[float]:
        """The decision of each text: the highest of its words' ones, at least -1."""
        split = [(t or "").split() for t in texts]
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
            self._short.clear()
        new = list({t for tokens in split for t in tokens if t not in known})
        for lo in range(0, len(new), HELD):
            self._learn(new[lo : lo + HELD])
        best = [max(map(known.__getitem__, tokens), default=-1.0) for tokens in split]
        runs = [(k, group) for k, tokens in enumerate(split) if not self._short.keys().isdisjoint(tokens) for group in self._runs(tokens)]
        different = {tuple(group) for _, group in runs}
        of = dict(zip(different, self._readings(list(map(list, different)))))
        for k, group in runs:
            best[k] = max(best[k], of[tuple(group)])
        for t in new:
            if len(t) > LONGEST:
                del known[t]
                self._short.pop(t, None)
        return [max(-1.0, d) for d in best]

    def scores(self, texts: list[str | None]) -> list[float]:
        z = np.clip(self.slope * np.array(self.sentences(texts)) + self.place, -30, 30)
        return (1.0 / (1.0 + np.exp(-z))).tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


class Map:
    """The Nyström map of words: one row of `matrix` for each subsequence of a landmark."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        word, key, value = _features(landmarks)
        self.codes = np.unique(key)
        table = np.zeros((len(self.codes), len(landmarks)))
        table[np.searchsorted(self.codes, key), word] = value
        values, vectors = np.linalg.eigh(table.T @ table)
        keep = values > 1e-6 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])
        self.matrix = np.empty((len(table), self.root.shape[1]), dtype=np.float32)
        for lo in range(0, len(table), 2048):  # the driver holds no second table
            self.matrix[lo : lo + 2048] = table[lo : lo + 2048] @ self.root

    def moved(self, w: np.ndarray, other: Map) -> np.ndarray:
        """The weights (and offset) of the same machine in another map that has all landmarks of this one."""
        return np.concatenate((other(self.landmarks).T @ (self.root @ w[:-1]), w[-1:]))

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.matrix.shape[1]), dtype=np.float32)
        for lo in range(0, len(words), 200):  # so that few rows of the matrix are copied at a time
            word, key, value = _features(words[lo : lo + 200])
            at = np.minimum(np.searchsorted(self.codes, key), len(self.codes) - 1)
            known = np.flatnonzero(self.codes[at] == key)
            if len(known):
                word, first = np.unique(word[known], return_index=True)
                out[lo + word] = np.add.reduceat(self.matrix[at[known]] * value[known, None].astype(np.float32), first, axis=0)
        return out

    def weights(self, w: np.ndarray) -> np.ndarray:
        """The weight of each subsequence in a machine that is linear in the map."""
        out = np.zeros(_DIM)
        out[self.codes] = self.matrix @ w
        return out


def _step(x: np.ndarray, weight: np.ndarray, sign: float, w: np.ndarray) -> np.ndarray:
    """The squared hinge loss over examples of one label and the sums of its Newton step: one array, a row for each weight of w.

    The columns are the sums of products, those of the weights, and the loss (in the first row).
    """
    x = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype)))
    slack = 1 - sign * (x @ w.astype(x.dtype)).astype(np.float64)
    short = np.flatnonzero((slack > 0) & (weight > 0))
    x, weight, slack = x[short], weight[short], slack[short]
    out = np.zeros((len(w), len(w) + 2))
    weight = weight.astype(x.dtype)
    out[:, :-2], out[:, -2], out[0, -1] = x.T @ (x * weight[:, None]), sign * (x.T @ weight), weight @ slack**2
    return out


def _train(start: np.ndarray, sums, penalty: float, steps: int) -> np.ndarray:
    """Newton's method with halved steps; the last entry of w is the offset."""
    ridge = np.full(len(start), penalty)
    ridge[-1] = 1e-6
    best, least, size = start, np.inf, 1.0
    w = start
    for _ in range(steps):
        found = sums(w)
        loss = found[0, -1] + ridge @ w**2
        if loss < least * (1 - 1e-12):
            better = loss < least * (1 - 1e-4)
            best, least, size = w, loss, 1.0
            if not better:
                break
            step = np.linalg.solve(found[:, :-2] + np.diag(ridge), found[:, -2]) - w
        else:
            size /= 2
        w = best + size * step
    return best


def _logistic(d: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 100) -> tuple[float, float]:
    """Slope and place of a logistic function by Newton's method with halved steps; both labels weigh the same."""
    x = np.column_stack((d, np.ones(len(d))))
    each = np.ones(len(y))

    def loss(w):
        z = x @ w
        return (each * (np.logaddexp(0, z) - z * y)).sum() + penalty / 2 * (w @ w)

    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.eye(2) * penalty, x.T @ (each * (p - y)) + penalty * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def units(text: str | None) -> list[str]:
    """The words of a sentence that the machine learns from."""
    return sorted(set().union(*map(words_of, set((text or "").split()))))


def sampled(labels: DataFrame, label: str = "label", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and label of about `fit_rows` rows of each label at most, chosen by a hash of the doc_id: few enough to broadcast to the texts."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    limit = {k: min(1 << 20, (fit_rows << 20) // max(1, sizes.get(k, 0))) for k in (0, 1)}
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("label") == 1, limit[1]).otherwise(limit[0]))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Machine:
    """Fit on labelled rows: about `fit_rows` of each label, chosen by a hash of the text, at most, with all their words.

    Words are counted, mapped and summed up on the executors.  The driver gets landmarks, a witness and a decision for each
    sentence of the sample, and the sums of each step from FIT_PARTS partitions.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Machine(np.zeros(_DIM), -1.0)
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    share = {k: min(1.0, fit_rows / n) for k, n in sizes.items()}
    chosen = rows.where(part < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).repartition(FIT_PARTS)
    chosen = written(chosen.withColumn("sid", F.monotonically_increasing_id()), "toxicity-sentences")
    n_bad, n_good = (max(1, chosen.where(F.col("label") == k).count()) for k in (1, 0))

    def words(batches):
        for batch in pieces(batches, 100):
            found = list(map(units, batch.column(0).to_pylist()))
            each = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.string()), *(pa.array(np.repeat(batch.column(k).to_numpy(), each)) for k in (1, 2))], ["word", "label", "sid"])

    held = written(chosen.mapInArrow(words, "word string, label int, sid long"), "toxicity-words")
    counted = held.groupBy("word").agg(F.sum("label").cast("double").alias("bad"), F.sum(1 - F.col("label")).cast("double").alias("good"))
    lean = F.log((F.col("bad") + 0.5) / (n_bad + 1) / ((F.col("good") + 2) / (n_good + 4))) * F.sqrt(F.col("bad") + F.col("good"))
    surely = F.greatest(F.lit(0.0), (F.col("bad") - 2 * F.sqrt("bad")) / n_bad - (F.col("good") + 2 * F.sqrt("good")) / n_good)
    counted = written(counted.repartition(FIT_PARTS).select("word", "bad", "good", lean.alias("lean"), surely.alias("up"), (F.col("good") / n_good).alias("down")), "toxicity-counts")
    top = [r.word for side in ("bad", "good") for r in counted.orderBy(F.desc(side), "word").limit(landmarks // 2).collect()]
    if not top:
        return Machine(np.zeros(_DIM), -1.0)
    first = held.where("label = 1").join(counted.select("word", "lean"), "word").groupBy("sid").agg(F.max(F.struct("lean", "word")).alias("best"))
    witnesses = [r.word for r in first.select("best.word").collect()]
    mapped = Map(list(dict.fromkeys(top)))
    w = np.zeros(mapped.matrix.shape[1] + 1)
    for turn in range(ROUNDS):
        pool = counted.select("word", "up", "down").unionByName(_copies(counted, witnesses, n_bad))
        examples = written(_projected(pool, mapped), "toxicity-examples")
        own = mapped(witnesses)
        w = _train(w, lambda w, own=own: _sums(examples, w) + _step(own, np.full(len(own), 1 / n_bad), 1.0, w), PENALTY, STEPS)
        forget(examples)
        machine = Machine(mapped.weights(w[:-1]), float(w[-1]))
        if turn + 1 < ROUNDS:
            d = F.col("d")
            decided = pool.mapInArrow(_deciding(machine), "word string, up double, down double, d double")
            wrong = [r.word for side, sign, n in (("down", 1, HARD[0]), ("up", -1, HARD[1])) for r in decided.orderBy(F.desc(F.col(side) * F.greatest(F.lit(0.0), 1 + sign * d) ** 2), "word").limit(n).collect()]
            witnesses = [r.word for r in held.where("label = 1").mapInArrow(_deciding(machine, ("word", "sid")), "word string, sid long, d double").groupBy("sid").agg(F.max(F.struct("d", "word")).alias("best")).select("best.word").collect()]
            before, mapped = mapped, Map(list(dict.fromkeys(mapped.landmarks + wrong)))
            w = before.moved(w, mapped)

    def decide(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(machine.sentences(batch.column(0).to_pylist()), pa.float64()), batch.column(1)], ["d", "label"])

    found = chosen.select("text", "label").mapInArrow(decide, "d double, label int").collect()
    machine.slope, machine.place = _logistic(np.array([r.d for r in found]), np.array([r.label for r in found], float))
    forget(chosen, held, counted)
    return machine


def _copies(counted: DataFrame, witnesses: list[str], n_bad: int) -> DataFrame:
    """word, up and down of the gapped copies of witnesses and of words surely held more often by label 1.

    Copies of a word share `GAPPED` times its weight; those that a sentence labelled 0 holds as words are left out.
    """
    own = counted.sparkSession.createDataFrame([(w, n / n_bad) for w, n in sorted(Counter(witnesses).items())], "word string, up double")

    def run(batches):
        for batch in pieces(batches):
            found = [(copy, weight / len(copies)) for word, weight in zip(*(c.to_pylist() for c in batch.columns)) if (copies := gapped(word)) for copy in copies]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([GAPPED * x for _, x in found], pa.float64())], ["word", "up"])

    copies = counted.where("up > 0").select("word", "up").unionByName(own).mapInArrow(run, "word string, up double").groupBy("word").agg(F.sum("up").alias("up"))
    return copies.join(counted.where("down > 0").select("word"), "word", "left_anti").withColumn("down", F.lit(0.0))


def _projected(counted: DataFrame, mapped: Map) -> DataFrame:
    """x (the map's row of each word, in 16 bits) with the weights up and down of the word as an example of either label."""

    def run(batches):
        for batch in pieces(batches, 2000):
            x = mapped(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), batch.column(1), batch.column(2)], ["x", "up", "down"])

    return counted.select("word", "up", "down").mapInArrow(run, "x binary, up double, down double")


def _sums(examples: DataFrame, w: np.ndarray) -> np.ndarray:
    """The sums of a step over all examples: one array from each partition."""

    def run(batches):
        total = np.zeros((len(w), len(w) + 2))
        for batch in pieces(batches, 2000):
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float16).reshape(-1, len(w) - 1).astype(np.float32)
            total += _step(x, batch.column(1).to_numpy(), 1.0, w) + _step(x, batch.column(2).to_numpy(), -1.0, w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros((len(w), len(w) + 2))
    for r in examples.coalesce(FIT_PARTS).mapInArrow(run, "total binary").collect():
        total += np.frombuffer(r.total).reshape(total.shape)
    return total


def _deciding(machine: Machine, keep: tuple[str, ...] = ("word", "up", "down")):
    """A function for mapInArrow: the `keep` columns and d, the decision of the word."""

    def run(batches):
        for batch in pieces(batches, HELD):
            d = machine.decisions(batch.column(batch.schema.get_field_index("word")).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(d)], [*keep, "d"])

    return run


def score(documents: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with score and predicted of each row; a map over the rows, no shuffle."""
    chosen = documents.select(*keep, F.col(text).alias("__text"))
    schema = chosen.drop("__text").schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch in pieces(batches):
            found = machine.scores(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], schema.names)

    return chosen.mapInArrow(run, schema)
