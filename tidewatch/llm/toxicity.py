"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of a lexicon, its nearness to words of the second person, capitals, punctuation and
obfuscation rates.  The lexicon holds words and word beginnings that labelled toxic texts use and labelled clean
ones do not; it, the trees and the calibration are learned from a bounded sample of labelled rows.  Everything else
runs over all texts in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, prepared, stored, text_of
from tidewatch.llm.samples import fold, labelled_docs

TRAINING_ROWS = 12_000
LEXICON_ROWS = 3_000
LEXICON_TERMS = 400
LEXICON_LEAST = 10
BEGINNINGS = (4, 5, 6)
TREES = 16
DEPTH = 4
NEAR = 5
WINDOW = 50
CACHED_WORDS = 300_000
#: Words of the second person in the languages of the corpus; a parameter of the operator.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton",
    "ta", "vous", "votre", "usted", "ustedes", "ti", "vos", "vosotros",
)
#: Letters that stand for others in obfuscated words.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})
EDGES = ".,;:!?\"'()[]{}<>#*$%&|~`-_=+/\\"
FEATURES = (
    "lexicon", "lexicon_log", "lexicon_distinct", "lexicon_densest", "obfuscated", "second_person", "near_second_person",
    "capital_words", "capital_letters", "exclamations", "questions", "punctuation", "digits", "symbols", "word_length", "words_log",
)
_WORDS: dict[int, "WordCodes"] = {}


class WordCodes(dict):
    """Code of a raw word as bits: 1 lexicon, 2 obfuscated lexicon, 4 second person, 8 capitals."""

    def __init__(self, lexicon: frozenset[str], second_person: frozenset[str]) -> None:
        super().__init__()
        self.words, self.second = lexicon, second_person
        self.starts = tuple(sorted({len(t) - 1 for t in lexicon if t.endswith("*")}))

    def listed(self, word: str) -> bool:
        return word in self.words or any(len(word) >= n and word[:n] + "*" in self.words for n in self.starts)

    def __missing__(self, raw: str) -> int:
        core = raw.strip(EDGES)
        word = core.lower()
        code = 4 if word in self.second else 0
        if self.listed(word):
            code |= 1
        elif len(raw) > 3 and not core.isalpha() and self.listed(raw.lower().translate(LOOKALIKE).strip(EDGES)):
            code |= 3
        if len(core) > 1 and core.isupper():
            code |= 8
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[raw] = code
        return code


def _features(text: str, codes: WordCodes) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    code = np.fromiter(map(codes.__getitem__, words), np.uint8, len(words))
    hit = np.flatnonzero(code & 1)
    second = np.flatnonzero(code & 4)
    near, densest, distinct = 0, 0, 0
    if len(hit):
        distinct = len({words[i].strip(EDGES).lower() for i in hit.tolist()})
        densest = int((np.searchsorted(hit, hit + WINDOW) - np.arange(len(hit))).max())
        if len(second):
            near = int((np.searchsorted(second, hit + NEAR, "right") > np.searchsorted(second, hit - NEAR)).sum())
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=8)
    size = max(1, len(raw))
    return [
        len(hit) / n, float(np.log1p(len(hit))), float(np.log1p(distinct)), densest / WINDOW, int((code & 2 > 0).sum()) / n, len(second) / n, near / n,
        int((code & 8 > 0).sum()) / n, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        size / n, float(np.log1p(len(words))),
    ]


def _kinds() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for kind, letters in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "?", ".,;:'\"()-", "0123456789", "#*$%&|<>@^~=+_\\/"), 1):
        table[[ord(c) for c in letters]] = kind
    return table


_KIND = _kinds()


def features(docs: DataFrame, lexicon: list[str], second_person: tuple[str, ...] = SECOND_PERSON, carry: tuple[str, ...] = ()) -> DataFrame:
    """The id, the carried columns and one double a feature, for every whole text; a null or empty text has zeros."""
    terms, second = frozenset(lexicon), frozenset(second_person)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        key = hash((terms, second))
        if key not in _WORDS:
            _WORDS[key] = WordCodes(terms, second)
        found = [_features(t, _WORDS[key]) for t in batch.pop("text")]
        return {"doc_id": batch["doc_id"]} | {n: [row[k] for row in found] for k, n in enumerate(FEATURES)}

    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{n} double" for n in FEATURES)])
    return map_rows(docs.select("doc_id", text_of().alias("text"), *carry), rows, schema, carry)


def learn_lexicon(sample: DataFrame, most: int = LEXICON_TERMS, least: int = LEXICON_LEAST) -> list[str]:
    """Words, and beginnings of words written ``begin*``, that toxic texts of the sample have and clean ones hardly do."""
    def begun(n: int) -> Column:
        return F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of()), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    terms = F.array_distinct(F.flatten(F.array(F.col("words"), *(begun(n) for n in BEGINNINGS))))
    by_term = (
        sample.select("label", words.alias("words")).select("label", F.explode(terms).alias("term"))
        .groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    )
    picked = by_term.where(F.col("toxic") >= least + 5 * F.col("clean")).orderBy(F.desc("toxic"), F.asc("clean"), "term").limit(most)
    return [r.term for r in picked.collect()]


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` and the carried columns of all rows.

    Only labels of rows that are not held out are used; a fifth of those calibrates.  With one class or none among
    the labels every score is that class's share (0.5 without any).  Labels, language, source and id are no features.
    A repeated row gets its own score; further columns are not read.
    """
    prepared(docs.sparkSession)
    docs = docs.select("doc_id", "text", *carry)
    texts = docs.select("doc_id", "text")
    train = fold() != 0
    toxic = labelled_docs(texts, labels.where(F.col(label) == 1), label, LEXICON_ROWS // 2, train, seed=1)
    clean = labelled_docs(texts, labels.where(F.col(label) == 0), label, LEXICON_ROWS // 2, train, seed=1)
    lexicon = learn_lexicon(toxic.select("text", "label").unionByName(clean.select("text", "label")))
    sample = labelled_docs(texts, labels, label, TRAINING_ROWS, train).select("doc_id", "text", "label")
    ready = stored(features(sample, lexicon, carry=("label",))).coalesce(2)
    counts = {r.label: r.n for r in ready.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = features(docs, lexicon, carry=carry)
    held_out = (fold() == 0).alias("held_out")
    if len(counts) < 2:
        constant = float(next(iter(counts), 0.5))
        return docs.select("doc_id", held_out, F.lit(constant).alias("score"), F.lit(int(constant >= 0.5)).alias("predicted"), *carry)
    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    calibrates = fold() == 1
    part = ready.withColumn("calibrates", calibrates)
    fit_on = part.where("not calibrates")
    if fit_on.select("label").distinct().count() < 2:
        fit_on = part
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=7).fit(pack.transform(fit_on))
    raw = vector_to_array("probability")[1].alias("raw")
    on_fold = trees.transform(pack.transform(part.where("calibrates"))).select(raw, F.col("label").cast("double").alias("label"))
    model = IsotonicRegression(featuresCol="raw", labelCol="label").fit(on_fold) if on_fold.select("label").distinct().count() == 2 else None
    scored = trees.transform(pack.transform(result)).select("doc_id", raw, *carry)
    return scored.select("doc_id", held_out, calibrated(model), *carry).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def calibrated(model) -> Column:
    """The isotonic steps as one expression; a thousandth of the raw probability keeps apart what a step joins."""
    raw = F.col("raw")
    if model is None:
        return raw.alias("score")
    points, values = [float(x) for x in model.boundaries.toArray()], [float(x) for x in model.predictions.toArray()]
    out = F.lit(values[-1])
    for k in range(len(points) - 1, 0, -1):
        x0, x1, y0, y1 = points[k - 1], points[k], values[k - 1], values[k]
        between = F.lit(y0) if y0 == y1 or x0 == x1 else F.lit(y0) + (raw - x0) * ((y1 - y0) / (x1 - x0))
        out = F.when(raw < x1, between).otherwise(out)
    out = F.when(raw < points[0], F.lit(values[0])).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * out + 0.001 * raw)).alias("score")
