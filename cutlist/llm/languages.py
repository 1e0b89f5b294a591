"""Language identification in two steps: the language family, then one-versus-one machines within it.

A whole text becomes the square roots of the relative frequencies of its byte trigrams, hashed to ``DIMENSIONS``
places: a unit vector. Linear support vector machines decide between two classes each: between every two families,
then between every two languages of the predicted family. A level with one class needs no machine.

Machines are trained from at most ``per_language`` labelled texts of each language, chosen by hash; this bound is
the sample's size, whatever the table's. Each machine is trained in a task of its own from its two classes'
vectors. What is broadcast is one vector per machine. Prediction reads every text whole, in blocks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Null languages are not learned from.
Without any usable labelled text every prediction is ``und``; with one language it is that one, with score 1.
Rows with equal ids are separate rows. ``predict`` passes columns of other names through and replaces those named
``lang_pred`` and ``score``. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, quoted, restored
from cutlist.llm.spans import chunks
from cutlist.llm.trigrams import lower_bytes

UNDETERMINED = "und"
DIMENSIONS = 1 << 12
#: Labelled texts of each language that machines are trained from, at most.
PER_LANGUAGE = 500
ROUNDS = 25
#: Steepness of the score as a function of a machine's margin.
STEEPNESS = 4.0
#: Bytes and texts that are turned into vectors at a time.
BLOCK = 1 << 20
ROWS = 256

# Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "hi", "mr", "ne", "ur"),
    "semitic": ("ar", "he"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, lang)


# Letters of a-z and bytes of other scripts stay, everything else is a blank.
_KEPT = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def vectors(text: pa.Array) -> np.ndarray:
    """One unit vector per text; a text without trigrams is all zeros."""
    raw, starts = lower_bytes(text)
    rows = len(text)
    counts = np.zeros(rows * DIMENSIONS, np.float64)
    for begin in range(0, max(0, len(raw) - 2), BLOCK):
        part = _KEPT[raw[begin : begin + BLOCK + 2]].astype(np.uint32)
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        at = np.arange(begin, begin + len(code))
        row = np.searchsorted(starts, at, side="right") - 1
        real = (code != 0x202020) & (at + 3 <= starts[row + 1])
        place = (code[real] * np.uint32(2654435761)) >> np.uint32(20)
        counts += np.bincount(row[real] * DIMENSIONS + place, minlength=len(counts))
    counts = counts.reshape(rows, DIMENSIONS)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def with_letters(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batch, column, BLOCK):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


@dataclass(frozen=True)
class Model:
    """``machines``: (level, first, second) to weights and bias; positive margins speak for the first class."""

    languages: tuple[str, ...]
    machines: dict[tuple[str, str, str], np.ndarray]

    def _level(self, level: str, classes: Sequence[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class that wins most of its pairs, and its mean chance over them."""
        votes, chance = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
        for i, a in enumerate(classes):
            for j in range(i + 1, len(classes)):
                w = self.machines[(level, a, classes[j])]
                margin = np.clip(x @ w[:-1] + w[-1], -30, 30)
                p = 1 / (1 + np.exp(-STEEPNESS * margin))
                votes[:, i] += margin >= 0
                votes[:, j] += margin < 0
                chance[:, i] += p
                chance[:, j] += 1 - p
        best = np.argmax(votes + chance / (2 * len(classes)), axis=1)
        pairs = max(1, len(classes) - 1)
        return best, chance[np.arange(len(x)), best] / pairs if len(classes) > 1 else np.ones(len(x))

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names, scores = np.full(len(text), UNDETERMINED, object), np.zeros(len(text))
        usable = with_letters(text)
        if not self.languages or not usable.any():
            return names, scores
        x = vectors(text)
        families = sorted({family_of(v) for v in self.languages})
        family, sure = self._level("family", families, x)
        for f, name in enumerate(families):
            members = [v for v in self.languages if family_of(v) == name]
            rows = np.flatnonzero((family == f) & usable)
            best, chance = self._level(name, members, x[rows])
            names[rows] = np.array(members, object)[best]
            scores[rows] = sure[rows] * chance
        return names, scores


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = ROUNDS) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge), by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    # Both classes weigh the same, however many rows each has.
    share = {s: max(1, (y == s).sum()) for s in (-1, 1)}
    diagonal = np.array([share[int(s)] / len(y) / cost for s in y])
    size = np.einsum("ij,ij->i", x, x) + diagonal
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w) - diagonal[i] * alpha[i]) / size[i]
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole, 2):
            packed = pa.array([v.tobytes() for v in vectors(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["lang", "pick", "vector"])


def _machine(rows: pd.DataFrame) -> pd.DataFrame:
    level, first, second = rows["level"].iloc[0], rows["first"].iloc[0], rows["second"].iloc[0]
    rows = rows.sort_values(["pick", "lang"], kind="stable")
    x = np.frombuffer(b"".join(rows["vector"]), np.float32).reshape(len(rows), -1)
    y = np.where(rows["one"], 1, -1)
    return pd.DataFrame({"level": [level], "first": [first], "second": [second], "weights": [machine(x, y).tobytes()]})


def train(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> Model:
    """A model from the labelled texts; the id only helps to choose the sample of each language."""
    pick = F.xxhash64(F.lit(5), quoted(doc_id).cast("string"), quoted(text)).alias("pick")
    usable = labelled.select(quoted(lang).alias("lang"), pick, quoted(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return Model((), {})
    languages = tuple(sorted(counts))
    # A threshold on the hash leaves about twice the bound; only those few are ranked.
    limit = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 2 * per_language / counts[k]))])
    share = (F.shiftrightunsigned("pick", 11).cast("double")) / float(1 << 53)
    ranked = usable.where(share < limit[F.col("lang")]).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    )
    sample = ranked.where(F.col("_nth") <= per_language).select("lang", "pick", "text")
    made = sample.mapInArrow(_vectors, "lang string, pick long, vector binary")

    families = sorted({family_of(v) for v in languages})
    levels = [("family", families, family_of)]
    levels += [(f, [v for v in languages if family_of(v) == f], str) for f in families]
    tasks = [
        (v, level, classes[i], classes[j], of(v) == classes[i])
        for level, classes, of in levels
        for i in range(len(classes))
        for j in range(i + 1, len(classes))
        for v in languages
        if of(v) in (classes[i], classes[j])
    ]
    if not tasks:
        return Model(languages, {})
    plan = labelled.sparkSession.createDataFrame(tasks, "lang string, level string, first string, second string, one boolean")
    trained = (
        made.join(F.broadcast(plan), "lang")  # a row per language and machine
        .groupBy("level", "first", "second")
        .applyInPandas(_machine, "level string, first string, second string, weights binary")
    )
    machines = {(r[0], r[1], r[2]): np.frombuffer(r[3], np.float64) for r in trained.collect()}
    return Model(languages, machines)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``lang_pred`` and ``score``."""
    columns = kept(docs, keep, ["lang_pred", "score"])
    inner = docs.select(*carried(columns), quoted(text).alias("_text"))
    schema = T.StructType(inner.drop("_text").schema.fields).add("lang_pred", "string").add("score", "double")
    arrow, at = to_arrow_schema(schema), len(columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                names, scores = shared.value.predict(batch.column(at))
                made = [*batch.columns[:at], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return inner.mapInArrow(task, schema).select(*restored(columns), "lang_pred", "score")
