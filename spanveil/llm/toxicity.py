"""Toxicity: a sparse logistic classifier whose scores are held still under swaps of identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Labelled rows of each class that the classifier is fitted on, at most; which ones depends on their ids alone.
FIT_ROWS = 3000
#: Features that it weighs, at most: those of the highest log-likelihood ratio.
FEATURES = 5_000
THRESHOLD = 0.7

#: Words that name a group, by kind; a term is swapped for others of its kind and form.
IDENTITY_TERMS: dict[str, list[str]] = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist", "muslimisch", "christlich", "jüdisch", "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío"],
    "believers": ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"],
    "origin": ["black", "white", "asian", "african", "european", "american", "mexican", "chinese", "indian", "arab", "turkish", "polish", "russian", "schwarz", "weiß", "asiatisch", "noir", "blanc", "asiatique", "negro", "blanco", "asiático"],
    "migrants": ["immigrants", "refugees", "foreigners", "natives", "einwanderer", "flüchtlinge", "ausländer", "immigrés", "réfugiés", "étrangers", "inmigrantes", "refugiados", "extranjeros"],
    "gender": ["man", "woman", "boy", "girl", "mann", "frau", "homme", "femme", "hombre", "mujer"],
    "genders": ["men", "women", "boys", "girls", "männer", "frauen", "hommes", "femmes", "hombres", "mujeres"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "transgender", "schwul", "lesbisch", "lesbienne", "lesbiana"],
    "ability": ["disabled", "blind", "deaf", "autistic", "behindert", "taub", "handicapé", "aveugle", "sourd", "discapacitado", "ciego", "sordo"],
    "age": ["old", "young", "elderly", "alt", "jung", "vieux", "jeune", "viejo", "joven"],
}
KIND = {term: kind for kind, terms in IDENTITY_TERMS.items() for term in terms}

#: Every ASCII byte that can't be in a word becomes a space; bytes of other letters stay.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(FOLD).split()


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word, its beginnings of 3 to 9 bytes and its ending of 5."""
    n = len(word)
    return (word, *(b"^" + word[:k] for k in range(3, min(n, 10))), *((b"$" + word[-5:],) if n > 5 else ()))


def features_in(words: list[bytes]) -> dict[bytes, float]:
    """How often each feature occurs, over the root of the number of words: long texts need more of it."""
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        for f in features_of(word):
            counts[f] += n
    scale = 1 / np.sqrt(len(words) + 10)
    return {f: n * scale for f, n in counts.items()}


@dataclass
class Example:
    """What a labelled text is fitted on, compact: its distinct words, parted by spaces, with their counts, and its sentences that name a group, each with where it stands."""

    held: bytes
    counts: np.ndarray
    sentences: list[tuple[str, int]]
    toxic: int

    @classmethod
    def of(cls, text: str, toxic: int) -> Example:
        named = [(m.group(), sum(m.span())) for m in SENTENCE.finditer(text) if any(w.decode("utf-8", "replace") in KIND for w in words_of(m.group()))]
        counts = Counter(words_of(text))
        return cls(b" ".join(counts), np.fromiter(counts.values(), np.int32, len(counts)), named, toxic)

    @property
    def words(self) -> dict[bytes, int]:
        return dict(zip(self.held.split(), self.counts.tolist()))


def swaps(sentences: list[tuple[str, int]], per_term: int = 2) -> list[dict[bytes, float]]:
    """Counterfactual sentences: how features change when one identity term in a sentence becomes another."""
    found = []
    for sentence, place in sentences:
        words = words_of(sentence)
        for term in dict.fromkeys(words):
            kind = KIND.get(term.decode("utf-8", "replace"))
            if kind:
                others = [t for t in IDENTITY_TERMS[kind] if t.encode() != term]
                first = place % len(others)
                for k in range(per_term):
                    other = others[(first + k * 3) % len(others)].encode()
                    was, now = features_in(words), features_in([other if w == term else w for w in words])
                    found.append({f: d for f in was.keys() | now.keys() if (d := now.get(f, 0) - was.get(f, 0))})
    return found


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -30.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        weights, margins = self.weights, np.empty(len(texts))

        class Known(dict):
            """The summed weights of a word's features, kept for words seen before."""

            def __missing__(self, word: bytes) -> float:
                if len(self) > 200_000:
                    self.clear()
                held = self[word] = sum(weights[f] for f in features_of(word) if f in weights)
                return held

        known = Known().__getitem__
        for i, text in enumerate(texts):
            words = words_of(text or "")
            margins[i] = self.bias + sum(map(known, words)) / np.sqrt(len(words) + 10)
        return 1 / (1 + np.exp(-np.clip(margins, -50, 50)))


def _choose(rows: list[Example], labels: np.ndarray, min_docs: int) -> set[int]:
    """Hashes of the features whose document counts differ most between the classes, by log-likelihood ratio."""
    gathered: tuple[list, list] = ([], [])
    for row, y in zip(rows, labels):
        found = {xxhash.xxh3_64_intdigest(f) for w in row.words for f in features_of(w)}
        gathered[int(y)].append(np.fromiter(found, np.uint64, len(found)))
    (clean, b), (toxic, a) = (np.unique(np.concatenate(g), return_counts=True) for g in gathered)
    every = np.union1d(clean, toxic)
    counts = np.zeros((2, len(every)))
    counts[0, np.searchsorted(every, clean)] = b
    counts[1, np.searchsorted(every, toxic)] = a
    often = counts.sum(0) >= min_docs
    every, counts = every[often], counts[:, often]
    n = np.array([[len(labels) - labels.sum()], [labels.sum()]])
    expected = n * counts.sum(0) / len(labels)
    ratio = (counts * np.log(np.maximum(counts, 1e-9) / expected)).sum(0)
    return set(every[np.lexsort((every, -ratio))[:FEATURES]].tolist())


def fit(rows: list[tuple[str, int]] | list[Example], prior: float, counterfactual: float = 5.0, sparsity: float = 3e-5, rounds: int = 300, min_docs: int = 2) -> Model:
    """Accelerated proximal gradient on logistic loss + L1 + ``counterfactual`` x mean squared score change of swaps.

    ``prior`` is the share of toxic rows among all labelled ones: the rows fitted on may hold more, and the bias is
    moved accordingly. Without rows of both classes every text gets the prior.
    """
    rows = [r if isinstance(r, Example) else Example.of(*r) for r in rows]
    labels = np.array([r.toxic for r in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return Model({}, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    chosen = _choose(rows, labels, min_docs)
    names, at = [], {}
    known: dict[bytes, tuple[int, ...]] = {}

    def columns_of(word: bytes) -> tuple[int, ...]:
        held = known.get(word)
        if held is None:
            found = [f for f in features_of(word) if xxhash.xxh3_64_intdigest(f) in chosen]
            for f in found:
                if f not in at:
                    at[f] = len(names)
                    names.append(f)
            if len(known) > 200_000:
                known.clear()
            held = known[word] = tuple(at[f] for f in found)
        return held

    rows_at, cols, values = [], [], []
    for i, example in enumerate(rows):
        counts: Counter = Counter()
        for word, k in example.words.items():
            for c in columns_of(word):
                counts[c] += k
        rows_at.append(np.full(len(counts), i))
        cols.append(np.fromiter(counts.keys(), np.int64, len(counts)))
        values.append(np.fromiter(counts.values(), float, len(counts)) / np.sqrt(example.counts.sum() + 10))
    row, col, value = (np.concatenate(x) for x in (rows_at, cols, values))
    pairs = [pair for example in rows for pair in swaps(example.sentences)]
    cells = [(i, at[f], v) for i, pair in enumerate(pairs) for f, v in sorted(pair.items()) if f in at]
    swap_row, swap_col, swap_value = (np.array([c[k] for c in cells], kind) for k, kind in enumerate((np.int64, np.int64, float)))
    n, m, d = len(rows), max(1, len(pairs)), len(names)

    def along(r: np.ndarray, c: np.ndarray, v: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(r, weights=v * w[c], minlength=size)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        margin = along(row, col, value, w, n) + b
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) / n
        push = 2 * counterfactual / m * along(swap_row, swap_col, swap_value, w, m)
        return along(col, row, value, error, d) + along(swap_col, swap_row, swap_value, push, d), error.sum()

    # A step of its own for each feature, from a diagonal matrix above both terms' curvature.
    curvature = along(col, row, value, np.bincount(row, value, n), d) * 0.25 / n
    curvature += along(swap_col, swap_row, abs(swap_value), np.bincount(swap_row, abs(swap_value), m), d) * 2 * counterfactual / m
    mean = 0.25 * np.bincount(col, value, d) / n
    step, step_b = 0.9 / (curvature + mean + 1e-12), 0.9 / (0.25 + 0.25 * value.sum() / n)
    w = ahead = np.zeros(d)
    b = ahead_b = 0.0
    t = 1.0
    for _ in range(rounds):
        g, gb = gradient(ahead, ahead_b)
        fresh = ahead - step * g
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * sparsity, 0)
        fresh_b = ahead_b - step_b * gb
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = fresh + (t - 1) / after * (fresh - w), fresh_b + (t - 1) / after * (fresh_b - b)
        w, b, t = fresh, fresh_b, after
    p, q = min(max(prior, 1e-9), 1 - 1e-9), labels.mean()
    b += np.log(p / (1 - p)) - np.log(q / (1 - q))
    return Model({f: float(x) for f, x in zip(names, w) if x}, float(b))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``rows_per_class`` labelled rows of each class that aren't held out.

    A document labelled more than once takes its highest label; rows without a label or an id aren't used; of rows that
    share an id the least text is used. Word counts come to the driver, one row an id, not texts.
    """
    usable = (
        labels.select(F.col(id_col).alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("labelled").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("labelled")))
        .groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["y"]: r["n"] for r in usable.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    chosen = None
    for y in (True, False):
        part = usable.where((F.col("toxic") > 0) == y).orderBy(F.xxhash64("labelled"), "labelled").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 x rows_per_class ids: a bound that doesn't grow with the labels.
    picked = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    one = picked.groupBy("labelled").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Example.of(t, int(y > 0)) for t, y in zip(batch["text"], batch["toxic"])]
            yield pd.DataFrame({
                "labelled": batch["labelled"], "held": [x.held for x in found], "counts": [x.counts.tobytes() for x in found],
                "sentences": [[t for t, _ in x.sentences] for x in found], "places": [[k for _, k in x.sentences] for x in found], "toxic": [x.toxic for x in found],
            })

    kind = one.schema["labelled"].dataType.simpleString()
    shape = f"labelled {kind}, held binary, counts binary, sentences array<string>, places array<int>, toxic int"
    rows = one.mapInPandas(reduced, shape).collect()
    rows.sort(key=lambda r: str(r["labelled"]))
    rows = [Example(bytes(r["held"]), np.frombuffer(bytes(r["counts"]), np.int32), list(zip(r["sentences"], r["places"])), r["toxic"]) for r in rows]
    return fit(rows, counts.get(True, 0) / total if total else 0.0)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text is an input of a score. A null text scores like an empty one, at the bias; a null id isn't held
    out; repeated rows score alike. Without labels of both classes the score is the share of toxic labels.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = id_and_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model = train(docs, labels)
    return docs.where(score_column(model, F.coalesce(F.col("text"), F.lit(""))) < threshold)
