"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

Only documents have labels.  A sentence's score is a logistic function of its
features, and a document is toxic unless none of its sentences is:
1 - product of (1 - score).  The weights maximise the likelihood of the
documents' labels, so the sentences that explain them are found on the way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.store import map_batches

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
TRAIN_ROWS = 12_000
"""Labelled documents the model is fitted on at most (the first by a hash of the id)."""
TRAIN_CHARS = 20_000_000
"""Characters of text those documents may have together; the sample is made smaller where they have more."""
MIN_DOCS = 4
EPOCHS = 300


def features(sentence: str) -> set[str]:
    """Words and their beginnings, which also know unseen forms of a word."""
    words = set(WORD.findall(sentence.lower()))
    return words | {f"{w[:n]}-" for w in words for n in PREFIXES if len(w) > n}


@dataclass(frozen=True)
class Model:
    """Weights of features that can mark a sentence, and the bias of every sentence."""

    weights: dict[str, float]
    bias: float


class Scorer:
    """The score of a sentence, for documents and for the sentences at fault alike.

    A sentence has the features of its words, each once, as in training.  What a
    word adds is looked up once for each word and kept while the table is small.
    """

    def __init__(self, model: Model):
        self.model = model
        self.names = {f: i for i, f in enumerate(model.weights)}
        self.values = list(model.weights.values())
        self.words: dict[str, tuple[int, ...]] = {}
        self.silent = float(np.log1p(np.exp(model.bias)))

    def marks(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            found = tuple(self.names[f] for f in features(word) if f in self.names)
            if len(self.words) < 500_000:
                self.words[word] = found
        return found

    def quiet(self, sentence: str) -> float:
        """- log(1 - score) of a sentence in lower case."""
        hits = [m for w in set(WORD.findall(sentence)) if (m := self.marks(w))]
        if not hits:
            return self.silent
        z = self.model.bias + sum(self.values[i] for i in (hits[0] if len(hits) == 1 else set().union(*hits)))
        return z if z > 30 else float(np.log1p(np.exp(z)))

    def document(self, text: str) -> float:
        """Noisy-or of the sentences' scores; a text without any has the score of one empty sentence."""
        quiet = sum(self.quiet(s) for s in SENTENCE.split(text.lower()) if s)
        return float(-np.expm1(-(quiet or self.silent)))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence of a text."""
        out, at = [], 0
        for m in [*SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            if end > at:
                out.append((at, end, float(-np.expm1(-self.quiet(text[at:end].lower())))))
            at = m.end() if m else end
        return out

    def at_fault(self, text: str, at_least: float) -> list[dict]:
        """The sentences that reach a score, or the one of the greatest if it takes several to make the text toxic."""
        found = self.sentences(text)
        chosen = [x for x in found if x[2] >= at_least] or [max(found, key=lambda x: x[2])] if found else []
        return [{"start": s, "end": e, "score": x} for s, e, x in chosen]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id") -> Model:
    """Fit sentence weights on a bounded sample of the documents that have a label.

    The sample holds at most ``rows`` documents and about ``chars`` characters;
    whole documents are taken in the order of a hash of their id.  Labels may be
    wrong now and then: a share of each label is explained by chance.  Only
    lengths and the sample's texts are shuffled to their labels.
    """
    labels = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = texts.select(id_col, F.length("text").alias("c")).join(labels, id_col).agg(F.count("*").alias("n"), F.sum("c").alias("c")).first()
    if not shape["n"]:
        return Model({}, -20.0)
    share = min(1.0, rows / shape["n"], chars / max(1, shape["c"] or 1))
    if share < 1:
        # Ids are hashed to 40 bits, so that a small share of very many rows is still one.
        texts = texts.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = texts.join(labels, id_col).orderBy(F.xxhash64(F.col(id_col))).select("text", "label").toPandas()
    if not len(sample):
        return Model({}, -20.0)
    return fit_texts(sample["text"].tolist(), sample["label"].to_numpy(float))


def fit_texts(texts: list[str], labels: np.ndarray) -> Model:
    # Two passes over the texts, so that only counts and the marks of sentences are held.
    seen: Counter[str] = Counter()
    toxic: Counter[str] = Counter()
    for text, label in zip(texts, labels, strict=True):
        words = features(text)
        seen.update(words)
        if label:
            toxic.update(words)
    # Features at least twice as common among toxic documents as overall can mark a sentence.
    rate = max(float(labels.mean()), 1e-9)
    names = sorted(f for f, n in toxic.items() if n >= MIN_DOCS and n > 2 * rate * seen[f])
    # Sentences with equal features in one document act alike; those without any act through the bias.
    marks = Scorer(Model(dict.fromkeys(names, 0.0), 0.0)).marks
    doc_of, n_same, item_of, item = [], [], [], []
    for d, text in enumerate(texts):
        bag = [s for s in SENTENCE.split(text.lower()) if s] or [""]
        for key, times in Counter(frozenset().union(*map(marks, set(WORD.findall(s)))) for s in bag).items():
            item_of += [len(doc_of)] * len(key)
            item += key
            doc_of.append(d)
            n_same.append(times)
    doc_of, n_same, item_of, item = np.array(doc_of), np.array(n_same, float), np.array(item_of, int), np.array(item, int)
    w, bias = np.zeros(len(names)), -8.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    # Chance that a label 1 comes without, and a label 0 in spite of, a toxic sentence.
    false_one, false_zero = min(0.5 * rate, 0.3), 0.005
    for step in range(1, EPOCHS + 1):
        z = bias + np.bincount(item_of, w[item], minlength=len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(doc_of, n_same * np.log1p(np.exp(np.clip(z, -30, 30))), minlength=len(texts))
        hot = -np.expm1(-quiet)
        one = false_one + (1 - false_one - false_zero) * hot
        slope = (labels / one - (1 - labels) / (1 - one)) * (1 - false_one - false_zero) * (1 - hot)
        g = slope[doc_of] * n_same * p
        grad = np.concatenate((np.bincount(item, g[item_of], minlength=len(names)) - 0.01 * w, [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        change = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(w + change[:-1], 0.0), float(np.clip(bias + change[-1], -16.0, -7.0))
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x > 0.05}, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """Score whole texts: doc_id, score, predicted, sentences.

    ``sentences`` has start, end (in characters) and score of the sentences at
    fault in a document that is predicted toxic: all that score ``at_least``, or
    else the worst one.  Null and empty texts get the score of one sentence
    without words; texts of any length are read whole; null ids stay; each row,
    repeated ones too, is scored by itself; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        scorer = _scorer(shared.value)
        texts = batch.column("text").to_pylist()
        scores = np.array([scorer.document(t or "") for t in texts])
        predicted = scores >= 0.5
        yield {"doc_id": batch.column("doc_id"), "score": scores, "predicted": predicted.astype(np.int32), "sentences": [scorer.at_fault(t or "", at_least) if p else [] for t, p in zip(texts, predicted, strict=True)]}

    return map_batches(rows, run, "doc_id long, score double, predicted int, sentences array<struct<start: int, end: int, score: double>>")


_scorers: dict[int, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer for each Python worker and model."""
    kept = _scorers.get(0)
    if kept is None or kept.model is not model:
        _scorers[0] = kept = Scorer(model)
    return kept


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that aren't held out, then score all: doc_id, held_out, score, predicted, sentences.

    Labels without an id or a value are left out; of several for one id the
    greatest counts.  Without any label every document gets the score of a model
    without features.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    return score(docs, fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known)).withColumn("held_out", held_out(F.col("doc_id")))
