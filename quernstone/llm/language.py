"""Language identification by error-correcting output codes.

Every language has a codeword.  Each bit is a binary classifier over hashed
byte n-grams: the log odds between the languages that have the bit and those
that have not, averaged over the text.  Decoding sums, over the bits, the
exponential loss of the classifier's margin against the codeword, weighted by
how well that bit does on that language on texts of the sample that the log
odds were not counted on, and takes the nearest codeword; a text whose second
codeword is nearly as near is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shared import dropped, written

#: Hashed n-grams: two and three bytes.
DIMENSIONS = 1 << 15
#: Bytes whose n-grams are looked up together.
TOGETHER = 1 << 19
SMOOTHING = 0.5


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` classes.

    Up to six classes every split in two is a bit; beyond it, of many random
    codes of bounded length the one with the largest least distance.
    """
    if n <= 6:
        bits = [[1 if k >> c & 1 else -1 for c in range(n)] for k in range(1, 1 << max(n - 1, 0))]
        return np.array(bits, np.int8).T.reshape(n, -1)
    rng, best, found = np.random.default_rng(n), None, -1
    length = int(np.ceil(15 * np.log2(n)))
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        far = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if far > found:
            best, found = code, far
    return best


def held_out(doc_id: Column, one_in: int = 5) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % one_in == 0, F.lit(False))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts side by side; where each text's begin and end."""
    raw = [b"  " + t.lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(size) - size
    x = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    pair = x[:-2] << 8 | x[1:-1]
    triple = pair << 8 | x[2:]
    two = (pair * np.uint32(2_654_435_761)) >> np.uint32(19)
    three = (triple * np.uint32(2_246_822_519)) >> np.uint32(18)
    n = len(x) - 2
    return np.concatenate((two, three + np.uint32(1 << 13))).reshape(2, n), starts, starts + size - 2


# Two-byte n-grams take the first 2^13 places, three-byte ones 2^14 after them.
assert (1 << 13) + (1 << 14) <= DIMENSIONS


@dataclass
class Model:
    """``languages`` by row of ``codes``; ``odds``: a row of log odds for each n-gram; ``weights`` by language and bit."""

    languages: list[str]
    codes: np.ndarray
    odds: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ambiguous: float = 0.25

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds of each bit for each text."""
        out = np.zeros((len(texts), self.codes.shape[1]))
        at = 0
        while at < len(texts):
            n = size = 0
            while at + n < len(texts) and (not n or size + len(texts[at + n]) < TOGETHER):
                size += len(texts[at + n])
                n += 1
            grams, starts, ends = _grams(texts[at : at + n])
            for lo in range(0, grams.shape[1], TOGETHER):  # a long text in blocks
                hi = min(lo + TOGETHER, grams.shape[1])
                per = self.odds[grams[0, lo:hi]] + self.odds[grams[1, lo:hi]]
                inside = np.flatnonzero((starts < hi) & (ends > lo))
                a, b = np.maximum(starts[inside], lo) - lo, np.minimum(ends[inside], hi) - lo
                cuts = np.column_stack((a, b)).ravel()
                sums = np.add.reduceat(np.concatenate((per, np.zeros((1, per.shape[1]), per.dtype))), cuts, axis=0, dtype=np.float64)[::2]
                out[at + inside] += sums
            out[at : at + n] /= (2 * (ends - starts))[:, None]
            at += n
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score and ambiguity of each row of margins."""
        f = np.clip(margins / self.scale, -4, 4)
        loss = (np.exp(-f[:, None, :] * self.codes[None]) * self.weights[None]).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        share = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
        score = 1 / share.sum(1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(best), bool)
        gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss.min(1)
        return best, score, gap < self.ambiguous * loss.min(1)


#: Of so many texts of the sample one judges the bits, the others are counted.
JUDGES = 5


def _sample(labelled: DataFrame, rows: dict[str, int], per_language: int) -> DataFrame:
    """``lang, text, judge``: about ``per_language`` different texts of each language at most, drawn by a hash of the row."""
    coin = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    drawn = labelled.where(coin < chance).select("lang", "text", F.xxhash64(F.lit(3), "text").alias("k")).dropDuplicates(["lang", "k"])
    return drawn.select("lang", "text", (F.pmod("k", F.lit(JUDGES)) == 0).alias("judge"))


def fit(documents: DataFrame, *, per_language: int = 4000, one_in: int = 5, most_languages: int = 200) -> Model:
    """Learn from rows that aren't held out and have a language and a text with a letter.

    ``per_language`` bounds the rows drawn of each language (whole texts);
    ``most_languages`` bounds the languages.  No rows give a model without
    languages.
    """
    labelled = documents.where(~held_out(F.col("doc_id"), one_in) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    rows = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(rows)
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((DIMENSIONS, 0)), np.zeros(0), np.zeros((0, 0)))
    drawn = written(_sample(labelled, rows, per_language), "language-sample")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, len(place), DIMENSIONS), np.int64)
        for batch in batches:
            for lang, text, judges in zip(*(batch.column(k).to_pylist() for k in range(3))):
                grams, starts, ends = _grams([text])
                totals[int(judges), place[lang]] += np.bincount(grams[:, starts[0] : ends[0]].ravel(), minlength=DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array([totals.astype("<i8").tobytes()], pa.binary())], ["totals"])

    counted = drawn.repartition(4).mapInArrow(count, "totals binary").collect()  # 4 rows
    totals = sum(np.frombuffer(r.totals, "<i8").reshape(2, len(languages), -1) for r in counted).astype(float)
    codes = codewords(len(languages))

    def odds_of(totals: np.ndarray) -> np.ndarray:
        shares = (totals + SMOOTHING) / (totals + SMOOTHING).sum(1, keepdims=True)
        odds = [np.log(shares[codes[:, b] > 0].mean(0)) - np.log(shares[codes[:, b] < 0].mean(0)) for b in range(codes.shape[1])]
        return np.column_stack(odds).astype(np.float32) if odds else np.zeros((DIMENSIONS, 0), np.float32)

    # Judged are bits that haven't seen the judges; the model's own have seen all.
    model = Model(languages, codes, odds_of(totals[0]), np.ones(codes.shape[1]), np.ones(codes.shape))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, size, rows = np.zeros(codes.shape), np.zeros(codes.shape[1]), np.zeros(len(place))
        for batch in batches:
            m = model.margins(batch.column(1).to_pylist())
            which = np.array([place[x] for x in batch.column(0).to_pylist()], int)
            np.add.at(right, which, m * codes[which] > 0)
            np.add.at(rows, which, 1)
            size += np.abs(m).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (right, size, rows)], ["right", "size", "rows"])

    found = drawn.where("judge").repartition(8).mapInArrow(judge, "right binary, size binary, rows binary").collect()  # 8 rows
    dropped(drawn)
    model.odds = odds_of(totals.sum(0))
    right, size, rows = (sum(np.frombuffer(r[k]) for r in found) for k in range(3))
    if codes.shape[1]:
        # A language that no text judges has equal weights.
        accuracy = np.where(rows[:, None] > 0, right.reshape(codes.shape) / np.maximum(rows, 1)[:, None], 1.0)
        model.weights = np.maximum(accuracy, 1e-3) / np.maximum(accuracy, 1e-3).sum(1, keepdims=True)
        model.scale = np.maximum(size / rows.sum(), 1e-9) if rows.sum() else model.scale
    return model


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of each row, from its whole text alone.

    A null text, one without a letter, or a model without languages: ``und``
    with score 0.  Repeated rows get equal results; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
                pred, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if some:
                    for i, *got in zip(some, *model.decode(model.margins([texts[i] for i in some]))):
                        pred[i], score[i], unsure[i] = model.languages[got[0]], float(got[1]), bool(got[2])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def learn_and_identify(documents: DataFrame, *, per_language: int = 4000, one_in: int = 5) -> DataFrame:
    """Fit on the rows that aren't held out, then identify all: ``doc_id, held_out, lang_pred, score, ambiguous``."""
    found = identify(documents, fit(documents, per_language=per_language, one_in=one_in))
    return found.select("doc_id", held_out(F.col("doc_id"), one_in).alias("held_out"), "lang_pred", "score", "ambiguous")
