"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

The content view sees hashed words and word shapes; the metadata view sees language, source, size and layout.  Each
round fits both views, lets each label the unlabelled pool, and gives its most confident pseudo-labels to the other.
Both views are then calibrated on labelled rows that neither was fitted on, and their log-odds added, as views that
are independent given the label allow.  Fitting uses bounded samples; scoring reads every whole text once, without a
shuffle.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, prepared, text_of
from tidewatch.llm.samples import MOST_ROWS, bounded_sample, fold, labelled_docs, one_row_an_id

LABELLED_ROWS = 8_000
POOL_ROWS = 4_000
ROUNDS = 3
PSEUDO_ROWS = 200  # of each class, view and round
CONFIDENT = 0.9
WORD_BUCKETS = 192
SHAPE_BUCKETS = 64
NAME_BUCKETS = 16
CACHED_WORDS = 300_000
_RUN = re.compile(r"(.)\1+", re.S)
_SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})


class _Buckets(dict):
    """Buckets of a raw word: one by its letters, one by its shape."""

    def __missing__(self, raw: str) -> tuple[int, int]:
        letters = "".join(filter(str.isalpha, raw)).lower()
        shape = _RUN.sub(r"\1", "".join(c if c < "\x80" else "a" for c in raw.translate(_SHAPE)))
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[raw] = found = (zlib.crc32(letters.encode()) % WORD_BUCKETS, WORD_BUCKETS + zlib.crc32(shape.encode()) % SHAPE_BUCKETS)
        return found


_BUCKETS = _Buckets()


def content_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed words and shapes; zeros without words."""
    words = text.split()
    both = np.array(list(map(_BUCKETS.__getitem__, words)), np.int64).reshape(-1)
    return np.sqrt(np.bincount(both, minlength=WORD_BUCKETS + SHAPE_BUCKETS) / max(1, len(words)))


def metadata_view(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed language and source, sizes, lines and the shares of kinds of characters."""
    lines = text.split("\n")
    raw = np.frombuffer(text.encode(), np.uint8)
    size = max(1, len(raw))
    kinds = np.bincount(_KIND[raw], minlength=7)[1:] / size
    names = np.zeros(2 * NAME_BUCKETS)
    names[zlib.crc32((lang or "").encode()) % NAME_BUCKETS] = 1
    names[NAME_BUCKETS + zlib.crc32((source or "").encode()) % NAME_BUCKETS] = 1
    filled = [x for x in lines if x.strip()]
    sizes = [
        math.log1p(len(text)), math.log1p(len(lines)), math.log1p(len(text) / len(lines)), len(raw) / max(1, len(text)) - 1,
        1 - len(set(filled)) / max(1, len(filled)), len(filled) / len(lines),
    ]
    return np.concatenate([names, sizes, np.sqrt(kinds)])


def _kinds() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for kind, letters in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"?()-", "!", "#*$%&|<>", " "), 1):
        table[[ord(c) for c in letters]] = kind
    return table


_KIND = _kinds()


def views(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and both views as arrays; for the bounded samples."""
    types = dict(docs.dtypes)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        both = list(zip(batch["text"], batch["lang"], batch["source"]))
        return {k: batch[k] for k in keep} | {"content": [content_view(t).tolist() for t, _, _ in both], "metadata": [metadata_view(*b).tolist() for b in both]}

    schema = ", ".join([*(f"{k} {types[k]}" for k in keep), "content array<double>", "metadata array<double>"])
    return map_rows(docs.select(*keep, text_of().alias("text"), "lang", "source"), rows, schema)


class View:
    """Weights of one view and its calibration, small enough to go with the scoring task."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, 1.0, 0.0

    def log_odds(self, vectors: np.ndarray) -> np.ndarray:
        return self.slope * (vectors @ self.weights + self.bias) + self.shift


def fit(vectors: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 12) -> View:
    """Ridge logistic regression by Newton steps."""
    x = np.hstack([vectors, np.ones((len(vectors), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (labels - p) - penalty * w
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), gradient)
        w = w + step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return View(w[:-1], float(w[-1]))


def cotrain(
    labelled: list[np.ndarray], labels: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, pseudo_rows: int = PSEUDO_ROWS
) -> list[View]:
    """Content and metadata view after the rounds; ``labelled`` and ``pool`` hold both views of their rows.

    A view gives the other at most ``pseudo_rows`` rows of each class a round, the most confident that it has not
    given yet."""
    own = [(labelled[v], labels) for v in (0, 1)]
    free = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]
    for _ in range(rounds):
        for teacher, pupil in ((0, 1), (1, 0)):
            if not len(pool[0]):
                continue
            p = 1 / (1 + np.exp(-np.clip(fit(*own[teacher]).log_odds(pool[teacher]), -30, 30)))
            order = np.argsort(p, kind="stable")
            order = order[free[pupil][order]]
            low = order[p[order] <= 1 - CONFIDENT][:pseudo_rows]
            high = order[p[order] >= CONFIDENT][-pseudo_rows:]
            taken = np.concatenate([low, high])
            free[pupil][taken] = False
            x, y = own[pupil]
            own[pupil] = np.vstack([x, pool[pupil][taken]]), np.concatenate([y, (p[taken] > 0.5).astype(float)])
    return [fit(*o) for o in own]


def calibrate(view: View, vectors: np.ndarray, labels: np.ndarray) -> None:
    """Slope and shift of the log-odds on rows that the view was not fitted on."""
    if 0 < labels.sum() < len(labels):
        line = fit(view.log_odds(vectors)[:, None], labels, ridge=1e-2)
        view.slope, view.shift = max(0.05, float(line.weights[0])), line.bias


def _collected(sample: DataFrame) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """A bounded sample as arrays."""
    rows = sample.toArrow()
    widths = (("content", WORD_BUCKETS + SHAPE_BUCKETS), ("metadata", len(metadata_view("", None, None))))
    both = [np.array(rows.column(c).to_pylist(), float).reshape(len(rows), n) for c, n in widths]
    return {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("content", "metadata")}, both


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, held_out, content_score, metadata_score, score, predicted, kept)`` and carried columns of all rows.

    Labels of held-out rows are not used.  A text without words scores 0.  With one class or none among the labels
    every text with words has that class's share (1.0 without any).  A null language or source is a value of its
    own; a repeated row gets its own score; further columns are not read.
    """
    prepared(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang", "source", *carry)
    train = fold() != 0
    sample = labelled_docs(docs.select("doc_id", "text", "lang", "source"), labels, label, LABELLED_ROWS, train, seed=3)
    columns, labelled = _collected(views(sample.select("doc_id", "text", "lang", "source", "label", fold().alias("fold")), "label", "fold"))
    y, part = columns["label"].astype(float), columns["fold"]
    weights = None
    if 0 < y.sum() < len(y):
        fitted = part != 1
        if not 0 < y[fitted].sum() < fitted.sum():
            fitted[:] = True
        known = bounded_sample(labels.where(F.col(label).isNotNull()).select("doc_id"), MOST_ROWS, F.xxhash64("doc_id", F.lit(3)), "doc_id")
        ids = bounded_sample(docs.where(train & F.col("doc_id").isNotNull()).select("doc_id").distinct(), POOL_ROWS, F.xxhash64("doc_id", F.lit(4)), "doc_id")
        ids = ids.join(F.broadcast(known), "doc_id", "left_anti").withColumnRenamed("doc_id", "pool_id")
        chosen = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("pool_id")).select("doc_id", "text", "lang", "source")
        _, pool = _collected(views(one_row_an_id(chosen).drop("doc_id")))
        pair = cotrain([v[fitted] for v in labelled], y[fitted], pool)
        for view, vectors in zip(pair, labelled):
            calibrate(view, vectors[part == 1], y[part == 1])
        weights = [(v.weights * v.slope, v.bias * v.slope + v.shift) for v in pair]
    share = float(y.mean()) if len(y) else 1.0
    prior = math.log(share / (1 - share)) if 0 < share < 1 else 0.0

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "content_score": [], "metadata_score": [], "score": []}
        for text, lang, source in zip(batch["text"], batch["lang"], batch["source"]):
            if not text or text.isspace():
                found = (0.0, 0.0, 0.0)
            elif weights is None:
                found = (share, share, share)
            else:
                (wc, bc), (wm, bm) = weights
                a, b = float(content_view(text) @ wc) + bc, float(metadata_view(text, lang, source) @ wm) + bm
                found = (_sigmoid(a), _sigmoid(b), _sigmoid(a + b - prior))
            for name, value in zip(("content_score", "metadata_score", "score"), found):
                out[name].append(value)
        return out

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, content_score double, metadata_score double, score double"
    scored = map_rows(docs.select("doc_id", text_of().alias("text"), "lang", "source", *carry), rows, schema, carry)
    good = F.col("score") >= 0.5
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "content_score", "metadata_score", "score", good.cast("int").alias("predicted"), good.alias("kept"), *carry)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
