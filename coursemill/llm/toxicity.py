"""Toxicity of whole texts: a recurrent network scores all overlapping windows of a text.

The labels say of a text that it is toxic, not where. The network learns from windows: of a toxic text the one
that most likely holds the reason, of other texts the most suspicious one and some at random. At first words
that occur more in toxic texts tell which window that is, later the network itself.
A text's score is that of its most toxic window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held_out, keep_only, pieces, release, ship, text_bytes, words_of
from .gru import WORD_DIM, Adam, Params, forward, gradient, logits, new_params, project, sigmoid, spelling, trigrams

#: Words of a window, words from one window to the next: any passage of 16 words lies whole in a window.
WINDOW, STRIDE = 32, 16
#: Bound of what is learned from: rows of each label (their whole texts), different words.
SAMPLE_ROWS, VOCABULARY = 1_000, 20_000
STEPS, RENEWED, BATCH, RATE, SEED = 240, 60, 96, 0.01, 7
#: ``STEPS`` batches are learned; the windows are chosen anew after each ``RENEWED``.
#: Share of words whose own embedding is left out while learning, so that spelling counts.
DROPPED = 0.5
#: Windows that are scored together, bytes of text whose windows are cut at once (one text at least).
TOGETHER, PIECE = 4096, 2 << 20
TOXIC_FROM = 0.3


@dataclass
class Model:
    params: Params
    vocabulary: np.ndarray  # sorted hashes of learned words; row i + 1 of the embeddings


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word inside it) of all windows: every ``STRIDE`` words, until the last word is covered."""
    n = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def _grid(first: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, windows) numbers of the words of windows, and the mask of those that exist."""
    at = first[text][None, :] + start[None, :] + np.arange(WINDOW)[:, None]
    mask = at < first[text + 1][None, :]
    return np.where(mask, at, 0).astype(np.int32), mask.astype(np.float32)


class Lexicon:
    """The different words of some texts with what the network takes of them."""

    def __init__(self, words: Words, vocabulary: np.ndarray):
        hashes, first, self.of_word = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.rows, self.places = trigrams(words.low, words.starts[first], words.ends[first])
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        self.word_row = np.where(known, at + 1, 0)

    def projected(self, p: Params) -> np.ndarray:
        return project(p, np.concatenate([p["words"][self.word_row], spelling(p, self.rows, self.places)], axis=1))


def score_windows(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, score) of all windows of the texts."""
    text, start = windows_of(np.diff(words.first))
    if not len(text):
        return text, start, np.zeros(0)
    lexicon = Lexicon(words, model.vocabulary)
    tables = list(lexicon.projected(model.params))
    scores = []
    for a in range(0, len(text), TOGETHER):
        at, mask = _grid(words.first, text[a : a + TOGETHER], start[a : a + TOGETHER])
        scores.append(logits(model.params, tables, lexicon.of_word[at], mask))
    return text, start, sigmoid(np.concatenate(scores))


def _pairs(of_word: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The different (word, text) of some texts."""
    n = len(words.first) - 1
    return np.divmod(np.unique(of_word * n + words.text), n)


def _suspicion(words: Words, labels: np.ndarray) -> np.ndarray:
    """Log odds of each word to occur in a text with label 1 rather than 0."""
    _, of_word = np.unique(words.hashes, return_inverse=True)
    word, text = _pairs(of_word, words)
    with_label = np.bincount(word, weights=labels[text])
    without = np.bincount(word) - with_label
    one, zero = labels.sum(), len(labels) - labels.sum()
    return (np.log((with_label + 0.5) / (one + 1)) - np.log((without + 0.5) / (zero + 1)))[of_word]


def _top(text: np.ndarray, score: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The window with the highest score of each wanted text."""
    order = np.lexsort((-score, text))
    first = order[np.r_[True, np.diff(text[order]) != 0]]
    return first[wanted[text[first]]]


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Learn from whole texts with labels 0 and 1. With one label only, or no words, every score is its share."""
    words = words_of(*text_bytes(pa.array(texts, pa.string())))
    random = np.random.default_rng(SEED)
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(words.hashes) or share in (0.0, 1.0):
        params = new_params(0, SEED)
        params["out"][:] = 0
        params["out_bias"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(params, np.zeros(0, np.uint64))

    hashes, inverse = np.unique(words.hashes, return_inverse=True)
    texts_with = np.bincount(_pairs(inverse, words)[0])
    often = np.flatnonzero(texts_with > 1)
    often = often[np.argsort(-texts_with[often], kind="stable")][:VOCABULARY]
    model = Model(new_params(len(often), SEED), np.sort(hashes[often]))
    lexicon = Lexicon(words, model.vocabulary)
    optimizer = Adam(model.params, RATE)

    text, start = windows_of(np.diff(words.first))
    at, mask = _grid(words.first, text, start)
    odds = np.where(mask > 0, _suspicion(words, labels)[at], -np.inf)
    score = np.sort(odds, axis=0)[-3:].clip(0).sum(axis=0)
    calm = np.flatnonzero(labels[text] == 0)
    for step in range(STEPS):
        if step % RENEWED == 0:
            if step:
                score = score_windows(model, words)[2]
            toxic, suspicious = _top(text, score, labels == 1), _top(text, score, labels == 0)
            optimizer.rate = RATE / (1 + step / RENEWED)
        some = np.concatenate([random.choice(kind, BATCH // 3) for kind in (toxic, suspicious, calm)])
        _learn(model, lexicon, optimizer, at[:, some], mask[:, some], labels[text[some]], random)
    return model


def _learn(model, lexicon, optimizer, at, mask, wanted, random) -> None:
    p = model.params
    kinds, of_place = np.unique(lexicon.of_word[at], return_inverse=True)
    of_place = of_place.reshape(at.shape)
    lengths = np.diff(lexicon.places)[kinds]
    ends = np.cumsum(lengths)
    rows = lexicon.rows[np.arange(ends[-1]) - np.repeat(ends - lengths - lexicon.places[kinds], lengths)]
    spelled = spelling(p, rows, np.r_[0, ends])
    word_rows = np.where(random.random(at.shape) < DROPPED, 0, lexicon.word_row[kinds][of_place])
    inputs = np.concatenate([p["words"][word_rows], spelled[of_place]], axis=2)
    projected = np.stack([inputs @ p["input"][d] + p["input_bias"][d] for d in (0, 1)], axis=1)
    logit, kept = forward(p, projected, mask, keep=True)
    g, d_projected = gradient(p, kept, ((sigmoid(logit) - wanted) / len(wanted)).astype(np.float32))
    g["input"] = np.stack([np.einsum("tni,tno->io", inputs, d_projected[:, d]) for d in (0, 1)])
    g["input_bias"] = d_projected.sum(axis=(0, 2))[:, None, :]
    d_inputs = d_projected[:, 0] @ p["input"][0].T + d_projected[:, 1] @ p["input"][1].T
    g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
    np.add.at(g["words"], word_rows.ravel(), d_inputs[..., :WORD_DIM].reshape(-1, WORD_DIM))
    d_kinds = np.zeros_like(spelled)
    np.add.at(d_kinds, of_place.ravel(), d_inputs[..., WORD_DIM:].reshape(-1, d_kinds.shape[1]))
    np.add.at(g["chars"], rows, np.repeat(d_kinds / lengths[:, None], lengths, axis=0))
    optimizer.update(g)


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic"
) -> Model:
    """Train on a bounded sample of the labelled rows that may be learned from.

    The sample is picked among the labels: the ``SAMPLE_ROWS`` ids of each label with the smallest hashes. Only these
    ids are looked for in ``docs``, and their whole texts come to the driver. Rows without
    label or text are not learned from; a document with several labels has the largest; of more rows than were
    picked, as ids may repeat, those with the smallest hashes count.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    marks = marks.filter(~held_out(F.col(id_column))).groupBy(F.col(id_column).alias("_marked"))
    marks = marks.agg((F.max(label) > 0).cast("int").alias("_label"))
    order = F.xxhash64(F.lit("toxicity"), F.col("_marked"))
    picked = [marks.filter(F.col("_label") == one).orderBy(order, "_marked").limit(SAMPLE_ROWS) for one in (0, 1)]
    rows = docs.select(F.col(id_column).alias("_marked"), F.col(text_column).alias("_text")).filter("_text is not null")
    # At most 2 * SAMPLE_ROWS ids.
    rows = rows.join(F.broadcast(picked[0].unionAll(picked[1])), "_marked")
    rows = rows.select("_label", F.xxhash64("_marked", "_text").alias("_n"), "_text")
    sample = rows.orderBy("_n", "_text").limit(2 * SAMPLE_ROWS)
    found = sorted(sample.select("_label", "_n", "_text").collect())
    return train([r["_text"] for r in found], np.array([r["_label"] for r in found], np.float32))


def toxicity(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", carry: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1), ``window`` (first word of the worst window).

    Every window of ``WINDOW`` words, one every ``STRIDE`` words, is scored; the text has the score of the worst.
    Texts that are null, empty or have no word get 0 and no window. Rows are judged one by one, so repeated
    rows and ids get repeated answers; other columns are ignored, or with ``carry`` kept beside the answers, as
    the structure ``row``, so that rows can be filtered without joining them.
    """
    ship(docs.sparkSession)
    # A text that comes in the structure is not sent a second time beside it.
    inside = docs.columns.index(text_column) if carry and text_column in docs.columns else None
    rows = docs.select(
        F.col(id_column).alias("_id"),
        (F.col(text_column) if inside is None else F.lit(None).cast("string")).alias("_text"),
        held_out(F.col(id_column)),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    carried = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a size bounded by VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("powers")
        if inside is not None:
            batches = (b.set_column(1, "_text", b.column(3).field(inside)) for b in batches)
        for piece in (p for b in batches for p in pieces(b, limit=PIECE)):
            release()
            words = words_of(*text_bytes(piece.column(1)))
            text, start, score = score_windows(sent.value, words)
            best, place = np.zeros(piece.num_rows), np.zeros(piece.num_rows, np.int64)
            if len(text):
                top = _top(text, score, np.ones(piece.num_rows, bool))
                best[text[top]], place[text[top]] = score[top], start[top]
            none = np.diff(words.first) == 0
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(2),
                    pa.array(best.astype(np.float64)),
                    pa.array(place, pa.int64(), mask=none),
                    *piece.columns[3:],
                ],
                names=["_id", "held_out", "score", "window", "row"][: 5 if carry else 4],
            )

    found = rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, window bigint{carried}")
    return found.withColumnRenamed("_id", id_column)
