"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm.common import filter_texts, row_key, share, small_batches

#: Rows per language that are learnt from at most, the characters of each, and the languages. With these the sample is bounded.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_LANGS = 300, 20_000, 200
#: Every fifth document, by a checksum of its id, is held out.
FOLDS = 5
#: Hash buckets, embedding width, subword lengths in bytes (with the spaces around a word).
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (2, 3, 4)
#: Epochs, steps that a small sample takes at least, segments of a step, first learning rate, words of a segment.
EPOCHS, LEAST_STEPS, STEP_ROWS, RATE, SEGMENT = 2, 400, 64, 0.4, 24
#: Share of rightly labelled calibration documents that a rejection may cost.
LOST = 0.001
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 20
#: ASCII letters and bytes of other letters stay, the rest parts words.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PREDICTED = "doc_id long, text_key long, lang_pred string, score double, rejected boolean"


def letters_of(text: str | None) -> np.ndarray | None:
    """Lower-case UTF-8 bytes of a text between spaces, all other ASCII as spaces; None if it has no letter."""
    low = (text or "").lower()
    if not any(any(map(str.isalpha, m[0])) for m in WORD.finditer(low)):
        return None
    return np.frombuffer(b" " + low.encode().translate(_LETTERS) + b" ", np.uint8)


def subwords(letters: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hash buckets of all subwords of ``GRAMS`` bytes, a bounded stretch of the text at a time.

    A subword may start or end with the space that bounds its word but holds none inside.
    """
    for at in range(0, len(letters), CHUNK):
        for n in GRAMS:
            part = letters[at : at + CHUNK + n - 1]
            size = len(part) - n + 1
            if size <= 0:
                continue
            inside, hashed = np.ones(size, bool), np.full(size, n, np.uint32)
            for k in range(n):
                own = part[k : k + size]
                hashed = (hashed ^ own) * np.uint32(0x01000193)
                if 0 < k < n - 1:
                    inside &= own != 32
            hashed ^= hashed >> np.uint32(15)
            yield (hashed[inside] & np.uint32(buckets - 1)).astype(np.int32)


@dataclass
class Model:
    """What a prediction needs: a score per bucket and language, a temperature and a threshold."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


class Predictor:
    """Predicts whole texts."""

    def __init__(self, model: Model):
        self.model = model

    def logits(self, text: str | None) -> np.ndarray | None:
        """Mean score of all subwords of the text per language; None if there is no letter."""
        letters = letters_of(text)
        if letters is None:
            return None
        total, n = np.zeros(len(self.model.langs)), 0
        for ids in subwords(letters, len(self.model.scores)):
            total += np.ones(len(ids), np.float32) @ self.model.scores[ids]
            n += len(ids)
        return total / max(n, 1) + self.model.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is rejected."""
        if not self.model.langs:
            return UNKNOWN, 0.0, letters_of(text) is None
        found = self.logits(text)
        if found is None:
            return UNKNOWN, 0.0, True
        share = softmax(found[None, :] / self.model.temperature)[0]
        best = int(share.argmax())
        return self.model.langs[best], float(share[best]), bool(share[best] < self.model.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fit by stochastic gradient descent; a tenth of the sample calibrates temperature and rejection.

    Learning texts are cut into segments of ``SEGMENT`` words, so that short texts
    are learnt too. The temperature has the least loss on calibration segments; the
    threshold rejects no more than ``LOST`` of those it labels rightly, and never
    above an even chance.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 10]
    def segments_of(rows: np.ndarray) -> Iterator[tuple[str, int]]:
        for i in rows:
            words = texts[i].split()
            for at in range(0, len(words), SEGMENT):
                yield " ".join(words[at : at + SEGMENT]), names.index(langs[i])

    segments, labels = [], []
    for text, label in segments_of(order[len(order) // 10 :]):
        if (letters := letters_of(text)) is not None:
            segments.append(np.concatenate(list(subwords(letters))))
            labels.append(label)
    if not segments:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    labels = np.array(labels)
    weight = len(labels) / (len(names) * np.maximum(1, np.bincount(labels, minlength=len(names))))
    turns = -(-len(segments) // STEP_ROWS)
    epochs = max(EPOCHS, -(-LEAST_STEPS // turns))
    steps, done = epochs * turns, 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(segments)), turns):
            rate = RATE * (1 - done / steps)
            done += 1
            parts = [segments[i] for i in chosen]
            sizes = np.array([len(p) for p in parts])
            at = np.concatenate(parts)
            mean = np.add.reduceat(embed[at], np.append(0, np.cumsum(sizes)[:-1]), axis=0) / sizes[:, None]
            gap = softmax(mean @ out + bias)
            gap[np.arange(len(chosen)), labels[chosen]] -= 1
            gap *= weight[labels[chosen]][:, None] * rate / len(chosen)
            back = (gap @ out.T).astype(np.float32)
            out -= (mean.T @ gap).astype(np.float32)
            bias -= gap.sum(axis=0).astype(np.float32)
            # A bucket's gradient is shared out over the mean; scaled by it, rare buckets learn as well.
            np.add.at(embed, at, -np.repeat(back, sizes, axis=0))
    model = Model(names, (embed @ out).astype(np.float32), bias.astype(np.float64))
    predictor = Predictor(model)
    checked = [(f, label) for text, label in segments_of(held) if (f := predictor.logits(text)) is not None]
    if checked:
        raw, right = np.array([c[0] for c in checked]), np.array([c[1] for c in checked])
        loss = {t: -np.log(softmax(raw / t)[np.arange(len(right)), right] + 1e-12).mean() for t in np.geomspace(0.02, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
        share = softmax(raw / model.temperature)
        sure = share.max(axis=1)[share.argmax(axis=1) == right]
        model.threshold = float(min(0.5, np.quantile(sure, LOST))) if len(sure) else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, langs: int = SAMPLE_LANGS) -> Model:
    """A model of a bounded sample: of the ``langs`` most frequent languages the ``rows`` texts each of least id hash.

    Of a text of more than ``chars`` characters that many are learnt from, from a
    place that its hash chooses. Only documents that are not held out and have a
    language and a text are learnt from; rows that repeat id and text count once. Map
    tasks ship at most ``rows`` ids per language each.
    """
    open_rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", *row_key())
    names = [r.lang for r in open_rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()]
    own = Window.partitionBy("lang").orderBy("h", "doc_id", "text_key")
    chosen = open_rows.where(F.col("lang").isin(names)).select("lang", "doc_id", "text_key", F.xxhash64("doc_id").alias("h")).withColumn(
        "n", F.row_number().over(own)
    ).where(F.col("n") <= rows).select("lang", "doc_id", "text_key").distinct()
    part = F.substring("text", 1 + F.pmod("text_key", F.greatest(F.char_length("text") - chars + 1, F.lit(1))).cast("int"), F.lit(chars))
    # At most rows times langs ids are broadcast and as many parts of texts collected.
    sample = open_rows.join(F.broadcast(chosen), ["lang", "doc_id", "text_key"], "left_semi").select("lang", "doc_id", "text_key", part.alias("text"))
    found = sorted(sample.dropDuplicates(["lang", "doc_id", "text_key"]).collect(), key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    return train([r["text"] for r in found], [r["lang"] for r in found])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language, score and rejection of every whole text, in one pass without a shuffle.

    A null text, or one without letters, is ``und`` with score 0 and rejected; if nothing
    could be learnt, any other text is ``und`` with score 0 and not rejected. Repeated rows and null ids are predicted
    like any other; other columns are ignored. Returns :data:`PREDICTED`.
    """
    small_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared())
        for batch in batches:
            found = [predictor.predict(t.as_py()) for t in batch.column(2)]
            langs, scores, rejected = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "text_key", "lang_pred", "score", "rejected"],
            )

    return docs.select(*row_key(), "text").mapInArrow(run, PREDICTED)


def drop_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts whose language the model rejects; all columns stay as they are."""
    shared = share(docs.sparkSession, model)

    def test() -> Callable[[str | None], bool]:
        predictor = Predictor(shared())
        return lambda text: not predictor.predict(text)[2]

    return filter_texts(docs, test)
