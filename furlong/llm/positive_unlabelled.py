"""Quality by positive-unlabelled learning: trusted positives against unlabelled web text.

Negative labels are not used.  With the share of good text among the unlabelled
(the class prior, which is estimated), the risk of a classifier can be written
with positives and unlabelled text alone; its part for negatives is kept from
falling below zero, where it could only be fitted to chance (Kiryo et al. 2017).
The prior comes from the least ratio of the shares of unlabelled and of positive
text above a score (Garg et al. 2021), taken on text that the scores were not fitted on.
Two more numbers turn scores into chances.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.store import map_batches
from furlong.llm.toxicity import held_out

TRAIN_ROWS = 5_000
"""Documents of either side, positive and unlabelled, that the model is fitted on at most (the first by a hash of the id)."""
TRAIN_CHARS = 10_000_000
"""Characters of text either side may have; the sample is made smaller where it has more."""
THRESHOLD = 0.3
BINS = 8
SHAPE_SHARE, WORD_SHARE = 0.01, 0.1
"""Share of the sampled documents in which a shape or word must occur to be a feature."""
STEPS = 300
WORD = re.compile(r"\S+")
LETTERS, CAPITALS, DIGITS, REPEATS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Z]{2,}"), re.compile(r"\d+"), re.compile(r"(.)\1+")
KNOWN = 400_000
"""Words whose features a worker keeps."""


def shape(word: str) -> str:
    """Kinds of the characters of a word: A for capitals, a for other letters, 9 for digits; runs count once."""
    if word.isalpha() and (word.islower() or word[1:].islower()):
        return "a"
    return REPEATS.sub(r"\1", DIGITS.sub("9", LETTERS.sub("a", CAPITALS.sub("\0", word)).replace("\0", "A")))[:12]


def word_kind(word: str) -> tuple[bool, bool, bool, bool]:
    """Whether a word is in capitals, begins with one, ends a sentence, ends with another sign."""
    last = word[-1]
    return word.isupper(), word[0].isupper(), last in ".!?", not last.isalnum()


# Kinds of bytes: digits, signs of prose, and other ASCII signs; bytes of other scripts are letters.
DIGIT, SIGN = np.zeros(256, bool), np.zeros(256, bool)
DIGIT[48:58] = True
SIGN[33:127] = True
SIGN[[ord(c) for c in ".,;:'\"!?()-"]] = False
for _c in range(128):
    SIGN[_c] &= not chr(_c).isalnum()
MARKUP = np.frombuffer(b"{}<>\\|=", np.uint8)


def statistics(text: str, sequence: list[str], most: int, kinds: np.ndarray) -> list[float]:
    """Numbers that describe a whole text, each between wide but finite bounds.

    sequence: its words; most: how often its commonest word occurs; kinds: how
    many words, and how many distinct ones, have each of the marks of ``word_kind``.
    """
    n = max(1, len(sequence))
    lengths = np.fromiter(map(len, sequence), float, len(sequence)) if sequence else np.zeros(1)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    pairs = set(zip(sequence, sequence[1:]))
    return [
        np.log1p(len(raw)), np.log1p(len(sequence)), float(lengths.mean()), float(lengths.std()), np.log1p(lengths.max()), kinds[4] / n, most / n,
        sum(map(str.__eq__, sequence, sequence[1:])) / n, len(pairs) / n, kinds[0] / n, kinds[1] / n, bytes_of[DIGIT].sum() / size,
        bytes_of[SIGN].sum() / size, kinds[2] / n, kinds[3] / n, np.log1p(len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(len(raw) / max(1, len(lines))),
        sum(1 for x in lines if x[-1] in ".!?\"'”") / max(1, len(lines)), len(zlib.compress(raw, 1)) / size, float((bytes_of[MARKUP] > 0).mean()),
    ]


@dataclass
class Model:
    """Weights of binned statistics and of words and shapes; the score is the chance of being positive."""

    edges: list[np.ndarray] = field(default_factory=list)
    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    prior: float = 0.5


class Reader:
    """From texts to feature values; what a word adds is kept while the table is small."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, tuple] = {}

    def facts(self, word: str) -> tuple[tuple[int, ...], tuple[bool, ...]]:
        found = self.words.get(word)
        if found is None:
            names = self.model.names
            found = tuple(names[x] for x in (word.lower(), "\0" + shape(word)) if x in names), word_kind(word)
            if len(self.words) < KNOWN:
                self.words[word] = found
        return found

    def read(self, text: str) -> tuple[list[float], dict[int, int], Counter, int]:
        """Statistics of a text, how often each feature occurs, and its words."""
        sequence = WORD.findall(text)
        words = Counter(sequence)
        counts: dict[int, int] = {}
        a = b = c = d = 0
        for word, n in words.items():
            places, (capitals, capital, ends, sign) = self.facts(word)
            a, b, c, d = a + n * capitals, b + n * capital, c + n * ends, d + n * sign
            for place in places:
                counts[place] = counts.get(place, 0) + n
        return statistics(text, sequence, max(words.values(), default=0), np.array([a, b, c, d, len(words)], float)), counts, words, len(sequence)

    def row(self, text: str) -> dict[int, float]:
        """Values of a text's features by their places: 1 for the bin of each statistic, roots of shares for words and shapes."""
        numbers, counts, _, n = self.read(text)
        edges = self.model.edges
        out = {i * BINS + int(np.searchsorted(edges[i], x, "right")): 1.0 for i, x in enumerate(numbers)}
        start, n = len(edges) * BINS, max(1, n)
        out.update((start + place, (k / n) ** 0.5) for place, k in counts.items())
        return out

    def score(self, text: str) -> float:
        model = self.model
        if not len(model.weights):
            return 0.5
        z = model.bias + sum(model.weights[i] * x for i, x in self.row(text).items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Rows:
    """Feature rows of many texts, for sums and gradients."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.at = np.array([i for r in rows for i in r], int)
        self.x = np.array([x for r in rows for x in r.values()], float)

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, self.x * weights[self.at], minlength=self.n)

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        """Of the mean of a function with these slopes: weights, then the bias."""
        return np.append(np.bincount(self.at, self.x * slope[self.row], minlength=self.width), slope.sum()) / max(1, self.n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def minimise(positive: Rows, unlabelled: Rows, prior: float | None, steps: int = STEPS, decay: float = 0.002) -> tuple[np.ndarray, float]:
    """Weights and bias of least logistic risk.

    With a prior: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)); where the
    second part is negative, a step leads back up.  Without one, positives are
    told from unlabelled rows.
    """
    w = np.zeros(positive.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp, zu = positive.scores(w[:-1], w[-1]), unlabelled.scores(w[:-1], w[-1])
        up = positive.gradient(-sigmoid(-zp))
        if prior is None:
            grad = 0.5 * (up + unlabelled.gradient(sigmoid(zu)))
        else:
            negative = softplus(zu).mean() - prior * softplus(zp).mean()
            down = unlabelled.gradient(sigmoid(zu)) - prior * positive.gradient(sigmoid(zp))
            grad = prior * up + down if negative >= 0 else -down
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of both that were not fitted on them.

    For the rows above any score, the ratio of the shares of unlabelled and of
    positive rows is at least that share.  The cut with the least upper bound of
    the ratio is taken, for which many rows are left above it.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    unlabelled, positive = np.sort(unlabelled), np.sort(positive)
    above = lambda x: 1 - np.searchsorted(x, cuts, "left") / len(x)
    p, u = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(4 / doubt) / 2)
    bound = (u + slack / np.sqrt(len(unlabelled)) + slack / np.sqrt(len(positive))) / p
    best = int(bound.argmin())
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 0.002) -> tuple[float, float]:
    """Slope and shift that make scores log-odds: of least unbiased risk, which is convex and can't overfit in two numbers."""
    middle, spread = unlabelled.mean(), unlabelled.std() + 1e-9
    p, u = (positive - middle) / spread, (unlabelled - middle) / spread
    at = np.array([1.0, 0.0])
    for _ in range(100):
        s = sigmoid(at[0] * u + at[1])
        grad = np.array([(s * u).mean() - prior * p.mean() + ridge * at[0], s.mean() - prior])
        q = s * (1 - s)
        curve = np.array([[(q * u * u).mean() + ridge, (q * u).mean()], [(q * u).mean(), q.mean() + 1e-6]])
        step = np.linalg.solve(curve, grad)
        at -= step / max(1.0, float(np.abs(step).max()))
    return float(at[0] / spread), float(at[1] - at[0] * middle / spread)


def fit_texts(positive: list[str], unlabelled: list[str], prior: float | None = None) -> Model:
    """Model of trusted positives and unlabelled texts; without positives or unlabelled texts every score is 0.5."""
    if not positive or not unlabelled:
        return Model()
    both = [*positive, *unlabelled]
    found: Counter[str] = Counter()
    numbers = []
    plain = Reader(Model())
    for text in both:
        values, _, words, _ = plain.read(text)
        numbers.append(values)
        found.update({x for w in words for x in (w.lower(), "\0" + shape(w))})
    names = sorted(x for x, n in found.items() if n >= max(5, (SHAPE_SHARE if x[0] == "\0" else WORD_SHARE) * len(both)))
    # The edges between bins are quantiles of the unlabelled text, as far as they differ.
    table = np.array(numbers[len(positive) :])
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) for x in table.T]
    model = Model(edges, {x: i for i, x in enumerate(names)})
    reader = Reader(model)
    width = len(edges) * BINS + len(names)
    rows = [[reader.row(t) for t in side] for side in (positive, unlabelled)]
    if prior is None:
        half = [(Rows(x[::2], width), Rows(x[1::2] or x, width)) for x in rows]
        w, b = minimise(half[0][0], half[1][0], None, STEPS // 2)
        prior = mixture_share(half[0][1].scores(w, b), half[1][1].scores(w, b))
    sides = [Rows(x, width) for x in rows]
    w, b = minimise(*sides, prior)
    slope, shift = calibrate(*(x.scores(w, b) for x in sides), prior)
    model.weights, model.bias, model.prior = slope * w, slope * b + shift, prior
    return model


def fit(docs: DataFrame, positives: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on bounded samples of the given documents (doc_id, text): those among ``positives`` (doc_id), and any.

    Either sample holds at most ``rows`` documents and about ``chars``
    characters, whole ones in the order of a hash of their id.
    """

    def sample(among: DataFrame | None, mark: str) -> list[str]:
        # Lengths alone meet the positives, then the texts of the sample.
        lengths = docs.select("doc_id", F.length("text").alias("c"))
        lengths = lengths if among is None else lengths.join(among, "doc_id", "left_semi")
        shape = lengths.agg(F.count("*").alias("n"), F.sum("c").alias("c")).first()
        share = min(1.0, rows / max(1, shape["n"]), chars / max(1, shape["c"] or 1))
        texts = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(mark)), F.lit(1 << 40)) < int(share * (1 << 40)))
        texts = texts if among is None else texts.join(among, "doc_id", "left_semi")
        return [r["text"] for r in texts.orderBy(F.xxhash64("doc_id"), "text").limit(rows).collect()]

    return fit_texts(sample(positives, "trusted"), sample(None, "web"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: doc_id, score (chance of good text), predicted (1 if score >= ``THRESHOLD``, else 0).

    Null and empty texts are scored as texts without words; texts of any length
    are read whole; null ids stay; each row, repeated ones too, is scored by
    itself; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        reader = _reader(shared.value)
        scores = np.array([reader.score(t.as_py() or "") for t in batch.column("text")], float)
        yield {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

    return map_batches(rows, run, "doc_id long, score double, predicted int")


_readers: dict[int, Reader] = {}


def _reader(model: Model) -> Reader:
    """One reader for each Python worker and model."""
    kept = _readers.get(0)
    if kept is None or kept.model is not model:
        _readers[0] = kept = Reader(model)
    return kept


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on documents that aren't held out, then score all: doc_id, held_out, score, predicted.

    Trusted positives have the label 1 and never 0; labels without an id or a
    value are left out.  Unlabelled text are all documents that aren't held out,
    whatever their label.  Without positives every score is 0.5.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label")).where("label = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    web = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return score(docs, fit(web, known)).withColumn("held_out", held_out(F.col("doc_id")))
