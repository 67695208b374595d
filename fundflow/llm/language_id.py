"""Language identification with a string kernel.

Two texts are as alike as the share of letter n-grams (n = 1, 2, 3; presence
only) that they have in common: |A and B| / sqrt(|A| |B|), the blended-spectrum
presence kernel. Landmark texts stand for the feature space (Nystroem), and
kernel ridge regression of each language against the rest is fitted on the
training texts. Workers score batches of texts by matrix products.

Training uses at most :data:`PER_LANGUAGE` texts of each language, those with
the smallest hashes of doc_id, and :data:`LANDMARKS` landmarks of them in all;
this is the only sample. Only texts with a letter and of at most
:data:`TRAIN_CHARS` code points are learned from, one of each doc_id and
language; where there are very many languages each gets fewer, so that
:data:`TRAIN_TEXTS` bounds what the driver fetches. Whole texts are scored,
every one, whatever their length.

Defined results: a null text, or one without a letter, is ``und`` with score
0; without a training text everything is. Repeated rows, and rows of one doc_id
with other texts, are scored each; ties of scores go to the language that sorts
first; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import only

PER_LANGUAGE, TRAIN_TEXTS, TRAIN_CHARS = 300, 30_000, 100_000
LANDMARKS = 128
#: Letters with a code of their own, beside "no letter" and "another letter".
LETTERS = 62
RIDGE = 1e-3
#: Texts per matrix product; sharpness of the scores.
ROWS, SHARPNESS = 256, 5.0


class Grams:
    """The n-grams of a text as flags, over the letters of some texts."""

    def __init__(self, texts: list[str]):
        seen = Counter(c for t in texts for c in set(t.lower()) if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS]
        self.codes = np.zeros(0x110000, np.uint8)
        self.letters = letters
        self.n = len(letters) + 2
        self._fill()

    def _fill(self) -> None:
        self.codes = np.array([1 if chr(c).isalpha() else 0 for c in range(0x3000)] + [0], np.uint8)
        self.codes[[ord(c) for c in self.letters if ord(c) < 0x3000]] = [i + 2 for i, c in enumerate(self.letters) if ord(c) < 0x3000]
        self.far = {ord(c): i + 2 for i, c in enumerate(self.letters) if ord(c) >= 0x3000}
        self.flags = np.zeros(self.n + self.n**2 + self.n**3, bool)

    def __getstate__(self):
        return {"letters": self.letters, "n": self.n}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._fill()

    def of(self, text: str) -> np.ndarray | None:
        """Flags (valid until the next call), or None without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.codes[np.minimum(points, 0x3000)]
        high = np.flatnonzero(points >= 0x3000)
        if len(high):
            c[high] = [self.far.get(p, int(chr(p).isalpha())) for p in points[high].tolist()]
        if not c.any():
            return None
        c = c.astype(np.int32)
        n, flags = self.n, self.flags
        flags[:] = False
        flags[c] = True
        two = c[:-1] * n + c[1:]
        flags[n + two] = True
        flags[n + n * n + (two[:-1] * n + c[2:])] = True
        flags[[0, n, n + n * n]] = False  # nothing but no letters
        return flags


class Model:
    """What a worker needs: n-grams, landmarks and coefficients."""

    def __init__(self, texts: list[str], languages: list[str]):
        self.languages = sorted(set(languages))
        self.grams = Grams(texts)
        rows = [(np.flatnonzero(f), y) for t, y in zip(texts, languages) if (f := self.grams.of(t)) is not None]
        by = {y: [r for r, z in rows if z == y] for y in self.languages}
        share = max(1, LANDMARKS // max(1, len(self.languages)))
        marks = [r for y in self.languages for r in by[y][:share]]
        self.vocabulary = np.unique(np.concatenate(marks))
        self.marks = np.zeros((len(self.vocabulary), len(marks)), np.float32)
        for j, r in enumerate(marks):
            self.marks[np.searchsorted(self.vocabulary, r), j] = 1
        self.sizes = np.sqrt([len(r) for r in marks])
        k_mm = self.kernel([self.known(r) for r in marks], [len(r) for r in marks])
        k_nm = self.kernel([self.known(r) for r, _ in rows], [len(r) for r, _ in rows])
        values, vectors = np.linalg.eigh(k_mm)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = k_nm @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        y = np.where(np.array([y for _, y in rows])[:, None] == np.array(self.languages), 1.0, -1.0)
        weights = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
        self.coefficients, self.bias = root @ weights[:-1], weights[-1]

    def known(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.vocabulary), np.float32)
        at = np.minimum(np.searchsorted(self.vocabulary, r), len(self.vocabulary) - 1)
        out[at[self.vocabulary[at] == r]] = 1
        return out

    def kernel(self, rows: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        out = [np.stack(rows[a : a + ROWS]) @ self.marks for a in range(0, len(rows), ROWS)]
        return np.concatenate(out) / np.sqrt(sizes)[:, None] / self.sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        at, rows, sizes = [], [], []
        for i, text in enumerate(texts):
            flags = self.grams.of(text) if text else None
            if flags is not None:
                at.append(i)
                rows.append(flags[self.vocabulary].astype(np.float32))
                sizes.append(int(np.count_nonzero(flags)))
        if at:
            values = self.kernel(rows, sizes) @ self.coefficients + self.bias
            odds = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
            odds = np.round(odds / odds.sum(axis=1, keepdims=True), 6)
            for i, j, p in zip(at, odds.argmax(axis=1).tolist(), odds.max(axis=1).tolist()):
                names[i], scores[i] = self.languages[j], p
        return names, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """The training texts: lang, doc_id, text."""
    rows = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.where(F.col("text").rlike(r"\p{L}") & (F.length("text") <= TRAIN_CHARS)).withColumn("version", F.xxhash64("text"))
    languages = max(1, rows.select(F.count_distinct("lang")).first()[0])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    near = rows.select("lang", "doc_id", "version").withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= max(1, min(PER_LANGUAGE, TRAIN_TEXTS // languages)))
    picked = near.groupBy("lang", "doc_id").agg(F.min("version").alias("version"))
    if languages <= TRAIN_TEXTS:
        picked = F.broadcast(picked)  # at most TRAIN_TEXTS rows
    return rows.join(picked, ["lang", "doc_id", "version"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def fit(docs: DataFrame) -> Model | None:
    """``docs(doc_id, text, lang)``: learns from rows that aren't held out."""
    found = sample(docs).orderBy("lang", "doc_id").limit(TRAIN_TEXTS).collect()
    found.sort(key=lambda r: (r.lang, r.doc_id))
    return Model([r.text for r in found], [r.lang for r in found]) if found else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in rows:
            names, scores = [], []
            for a in range(0, batch.num_rows, ROWS):
                texts = batch.column(2)[a : a + ROWS].to_pylist()
                n, s = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
