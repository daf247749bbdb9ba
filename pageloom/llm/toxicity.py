"""Toxicity by a subsequence string kernel with landmarks and a linear support vector machine."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import release, slices, table

DECAY = 0.6
LONGEST, STEP = 32, 16
# Smallest share of a landmark that counts.
CUT = 0.2
# Neighbouring words that are also read as one: the shorter has at most so many characters, both together so many.
PART, WHOLE = 3, 12
REMEMBER = 250_000
# Deviations by which a landmark must be commoner in toxic texts.
CLEAR = 5.0
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\S)(?:\S[ ]){3,}\S(?!\S)")
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")
_FILLED = re.compile(r"[^\W_]([^\W_])(?:[^\W_]\1){2,}[^\W_]?")


# ---- the kernel ------------------------------------------------------------------------------------------


def order_of(landmark: str) -> int:
    """Length of the subsequences that are counted: four, or one less than a shorter landmark."""
    return min(4, max(2, len(landmark) - 1))


def codes(words: list[str]) -> np.ndarray:
    """Code points of the words, one row each, filled up with zeros."""
    width = max(map(len, words))
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def subsequence_kernel(words: np.ndarray, landmark: str) -> np.ndarray:
    """Gap-weighted count of the subsequences that each word shares with the landmark.

    Every character that a subsequence spans, in the word and in the landmark, costs a factor of DECAY.
    """
    p, z = order_of(landmark), np.array([ord(c) for c in landmark], np.uint32)
    n, m = len(words), len(z)
    # inner[l][:, j]: subsequences of length l in the word so far and the first j characters of the landmark
    inner = np.zeros((p, n, m + 1))
    inner[0] = 1
    total = np.zeros(n)
    for x in words.T:
        meets = (x[:, None] == z[None, :]) & (x != 0)[:, None]
        gain = inner[:, :, :m] * meets * DECAY * DECAY
        total += gain[p - 1].sum(1)
        run = np.zeros((p - 1, n))
        inner[1:] *= DECAY
        for j in range(m):
            run = run * DECAY + gain[:p - 1, :, j]
            inner[1:, :, j + 1] += run
    return total


def letter_masks(words: np.ndarray) -> np.ndarray:
    bits = np.where(words == 0, np.uint64(0), np.uint64(1) << (words.astype(np.uint64) & np.uint64(63)))
    return np.bitwise_or.reduce(bits, axis=1)


@dataclass
class Landmarks:
    """Landmarks with the Nyström map of their kernel matrix."""

    words: list[str]

    def __post_init__(self) -> None:
        own = codes(self.words)
        self.masks = letter_masks(own)
        self.self_values = np.array([subsequence_kernel(own[i:i + 1], w)[0] for i, w in enumerate(self.words)])
        gram = self.features(self.words)
        gram = (gram + gram.T) / 2
        value, vector = np.linalg.eigh(gram + 0.05 * np.eye(len(gram)))
        self.onto = vector @ np.diag(np.maximum(value, 0.05) ** -0.5) @ vector.T

    def features(self, words: list[str]) -> np.ndarray:
        """Kernel with each landmark, as a share of the landmark's own value, at most one.

        A word that lacks two or more of a landmark's different letters counts zero for it, and shares
        under ``CUT`` count zero, so most words have no feature at all.
        """
        out = np.zeros((len(words), len(self.words)))
        if not words:
            return out
        table_ = codes(words)
        masks = letter_masks(table_)
        lengths = (table_ != 0).sum(1)
        for k, (landmark, mask) in enumerate(zip(self.words, self.masks)):
            rows = np.flatnonzero(np.bitwise_count(mask & ~masks) <= 1)
            for at, width in _chunks(rows, lengths):
                share = subsequence_kernel(table_[at, :width], landmark) / self.self_values[k]
                out[at, k] = np.where(share >= CUT, np.minimum(share, 1), 0)
        return out


def _chunks(rows: np.ndarray, lengths: np.ndarray, most: int = 1024) -> Iterator[tuple[np.ndarray, int]]:
    """Rows in chunks of like length that stay in the processor's cache, each with its width."""
    rows = rows[np.argsort(lengths[rows], kind="stable")]
    for i in range(0, len(rows), most):
        part = rows[i:i + most]
        yield part, int(lengths[part[-1]])


# ---- sentences -------------------------------------------------------------------------------------------


def sentence_words(text: str, common: frozenset[str] | None = None) -> list[list[str]]:
    """Words of every sentence, in lower case without outer punctuation; spelled-out words are put together.

    With ``common`` short words, neighbouring words of which one is short, but none of these, are also put together, as an
    insult may be split by a blank. A word over LONGEST characters stands for its overlapping windows of that length.
    """
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.split()
        whole = []
        if common is not None:
            for k, word in enumerate(words):
                if len(word) <= PART and word not in common and word.isalpha():
                    for a, b in ((words[k - 1] if k else "", word), (word, words[k + 1] if k + 1 < len(words) else "")):
                        if a and b and 3 < len(a) + len(b) <= WHOLE and a[-1].isalnum() and b[0].isalnum():
                            whole.append(a + b)
        if " " in sentence:
            whole += [m[0].replace(" ", "") for m in _SPACED.finditer(sentence)]
        out.append(words + whole)
    return out


def common_short_words(texts: list[str], share: float = 0.01) -> frozenset[str]:
    """Words of at most PART characters that more than this share of the texts hold."""
    held = Counter(w for t in texts for w in {w for w in t.lower().split() if len(w) <= PART})
    return frozenset(w for w, n in held.items() if n > share * len(texts))


def bare(word: str) -> list[str]:
    """The word without outer punctuation, and without what splits it: inner punctuation, or one character between all others."""
    word = _EDGE.sub("", word)
    out = windows(word)
    if not word.isalnum() and (whole := _INNER.sub("", word)) != word:
        out = out + windows(whole)
    if len(word) > 6 and word[1] == word[3] == word[5] and _FILLED.fullmatch(word):
        out = out + windows(word[::2])
    return out


def windows(word: str) -> list[str]:
    """The word, or its windows; words of one or two characters share no subsequence with a landmark."""
    if len(word) <= LONGEST:
        return [word] if len(word) > 2 else []
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST + STEP, STEP)]


class Reader:
    """Turns texts into sentence features; remembers the features of at most REMEMBER words."""

    def __init__(self, landmarks: Landmarks, common: frozenset[str] = frozenset()):
        self.landmarks, self.common = landmarks, common
        self.known: dict[str, np.ndarray | None] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = list(words)
        pieces = [bare(w) for w in new]
        distinct = sorted({p for ps in pieces for p in ps})
        at = {p: i for i, p in enumerate(distinct)}
        found = self.landmarks.features(distinct)
        some = found.any(1)
        for word, ps in zip(new, pieces):
            rows = [at[p] for p in ps if some[at[p]]]
            self.known[word] = found[rows].max(0) if rows else None

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the features of its sentences that have any, one row each."""
        read = [sentence_words(t, self.common) for t in texts]
        self.learn({w for s in read for ws in s for w in ws})
        known, out = self.known, []
        for sentences in read:
            rows = []
            for ws in sentences:
                hit = [f for w in ws if (f := known[w]) is not None]
                if hit:
                    rows.append(hit[0] if len(hit) == 1 else np.maximum.reduce(hit))
            out.append(np.array(rows) if rows else np.zeros((0, len(self.landmarks.words))))
        return out


# ---- the model -------------------------------------------------------------------------------------------


def choose_landmarks(texts: list[str], toxic: np.ndarray, count: int) -> list[str]:
    """Words and beginnings of words that tell toxic texts from others best, without close variants.

    A part counts for the toxic texts that hold fewer than four parts chosen before it, so copies of one text and
    its chance words do not fill the list.
    """
    held, seen = [], (Counter(), Counter())
    for text, label in zip(texts, toxic):
        parts = set()
        for words in sentence_words(text):
            for word in words:
                for w in bare(word):
                    parts.update(w[:n] for n in range(4, min(len(w), 7) + 1))
                    parts.add(w)
        seen[int(label)].update(parts)
        if label:
            held.append(parts)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    scored = []
    for part, a in seen[1].items():
        b = seen[0][part]
        if a < 3:
            continue
        both = (a + b) / (n1 + n0)
        clear = (a / n1 - b / n0) / np.sqrt(max(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0))
        if clear >= CLEAR:
            scored.append((clear, part))
    scored.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen: list[str] = []
    open_ = [[parts, 0] for parts in held]
    for _, part in scored:
        if len(chosen) == count:
            break
        if any(part.startswith(c) or c.startswith(part) for c in chosen):
            continue
        new = [x for x in open_ if part in x[0]]
        if len(new) < max(3, 0.01 * n1):
            continue
        chosen.append(part)
        for x in new:
            x[1] += 1
        open_ = [x for x in open_ if x[1] < 4]
    return chosen or ["...."]


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Linear support vector machine (squared hinge) by accelerated gradient steps; last weight: bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + penalty)
    w = v = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0
    for k in range(rounds):
        short = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (ridge * v - 2 * (x.T @ (weight * short * y)))
        v, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    slope: float
    offset: float
    common: frozenset[str] = frozenset()

    def reader(self) -> Reader:
        return Reader(self.landmarks, self.common)

    def margins(self, sentences: list[np.ndarray]) -> np.ndarray:
        """Largest margin over the sentences of each text; one without features has the bias alone."""
        out = np.full(len(sentences), self.weights[-1])
        for i, rows in enumerate(sentences):
            if len(rows):
                out[i] = max(out[i], (rows @ self.landmarks.onto @ self.weights[:-1]).max() + self.weights[-1])
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def fit(texts: list[str], toxic: np.ndarray, share: float, landmarks: int = 40, rounds: int = 3) -> Model:
    """Fit on labelled texts; ``share`` is the share of toxic ones where the model is applied.

    A label tells of the text, not of its sentences. So the machine learns from one sentence of each
    toxic text, the one it finds worst, and that choice is repeated with the machine learnt.
    """
    marks = Landmarks(choose_landmarks(texts, toxic, landmarks))
    model = Model(marks, np.append(marks.features(marks.words).sum(0) @ marks.onto, 0.0), 1.0, 0.0,
                  common_short_words(texts))
    read = model.reader().sentences(texts)
    none = np.zeros(len(marks.words))
    for _ in range(rounds):
        rows = [r[np.argmax(r @ marks.onto @ model.weights[:-1])] if len(r) else none for r in read]
        y = np.where(toxic, 1.0, -1.0)
        weight = np.where(toxic, share / max(toxic.sum(), 1), (1 - share) / max((~toxic).sum(), 1))
        model.weights = fit_svm(np.array(rows) @ marks.onto, y, weight)
    margins = model.margins(read)
    slope, offset = 1.0, 0.0
    weight = weight / weight.sum()
    for _ in range(500):  # logistic fit of the margins
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        error = weight * (p - toxic)
        h = weight * np.maximum(p * (1 - p), 1e-4)
        hessian = np.array([[h @ margins ** 2 + 1e-4, h @ margins], [h @ margins, h.sum() + 1e-4]])
        move = np.linalg.solve(hessian, [error @ margins + 1e-4 * slope, error.sum()])
        slope, offset = slope - 0.5 * move[0], offset - 0.5 * move[1]
    model.slope, model.offset = max(slope, 0.0), offset
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 1000) -> Model | None:
    """Fit on at most ``most`` toxic and ``most`` other labelled documents, picked by a digest of the id.

    Only labels of rows whose crc32(doc_id as text) mod 5 is not 0 are read. Rows without label or
    id, and null texts, are passed over; None if one of the classes has no document, as in empty tables. A ``doc_id`` that
    repeats counts once with each label it has, with the smallest of its texts; other columns, whatever their names, are ignored.
    """
    mine = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(CAST(doc_id AS string)) % 5 <> 0")
            .select("doc_id", "toxic"))
    counts = {r.toxic: r["n"] for r in mine.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    picked = [mine.where(f"toxic = {k}").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
              for k in (0, 1)]
    rows = (docs.select("doc_id", "text").where("text IS NOT NULL")
            .join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id", "toxic").collect())
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    return fit([r.text for r in rows], toxic, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: likelier toxic) of every whole text.

    A text scores by its worst sentence. Null and empty texts, and all texts without a model, score as
    a text without any feature. Repeated rows repeat their score; other columns are ignored; an
    empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader() if model else None
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = model.scores(model.margins(reader.sentences(texts))) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], schema=schema)
        del reader
        release()

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose whole text scores under ``threshold``; null and empty texts stay.

    Rows are judged one by one, so repeated rows go or stay together; without a model all stay; an empty table gives no rows.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader() if model else None
        for part in slices(batches):
            if model is None:
                yield part
                continue
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = model.scores(model.margins(reader.sentences(texts)))
            yield part.filter(pa.array([s < threshold or not t for s, t in zip(found, texts)], pa.bool_()))
        del reader
        release()

    return docs.mapInArrow(of, docs.schema)


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = score(docs, train(docs, table(spark, folder, "labels")))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
