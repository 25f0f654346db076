"""Language of whole texts by string kernels.

A text is the set of its lower-case letter n-grams of several lengths (blended
spectrum, presence only), each a bit of a hashed space of 2^16. The kernel of two
texts is the number of bits both have, over the root of the product of their
sizes. A bounded sample of labelled texts gives Nystroem landmarks; in their
space one ridge regression per language (one versus the rest) is fitted. As the
kernel to the landmarks is a matrix product of presence bits, so are the scores:
bits x landmark bits x weights, of which the last two are multiplied once.

Only presence bits of the sample (8 KB a text, whatever its length) come to the
driver; every text is scored whole, in windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loomframe.llm.chunks import sliced, text_bytes, windows

BITS = 16
LENGTHS = (1, 2, 3, 4)
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
#: Each byte as the kernel sees it: lower-case letters, all bytes of characters outside ASCII, and one sign for anything else.
_SEEN = np.full(256, 1, np.uint32)
_SEEN[0x61:0x7B] = _SEEN[0x41:0x5B] = np.arange(2, 28)
_SEEN[0x80:] = np.arange(28, 156)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    """Bits x languages."""
    bias: np.ndarray
    sharpness: float = 6.0


def presence(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, presence bits) of each text that isn't empty; a long text is gathered window by window.

    The window after a cut begins with the last bytes before it, so n-grams over the cut count too.
    """
    data, offsets = text_bytes(column)
    held, row, last = None, -1, np.empty(0, np.uint32)
    for lo, hi, piece, at in windows(data, offsets):
        codes = _SEEN[piece]
        if row == lo:
            codes = np.concatenate([last, codes])
            at = np.array([0, len(codes)])
        last = codes[len(codes) - max(LENGTHS) + 1 :] if len(codes) >= max(LENGTHS) else codes
        hashes, value = [], np.zeros(len(codes), np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            if len(codes) < n:
                break
            value = value[: len(codes) - n + 1] * _FACTORS[4] + codes[n - 1 :] * np.uint32(2654435761) + np.uint32(n)
            if n in LENGTHS:
                mixed = value ^ (value >> np.uint32(15))
                hashes.append((n, (mixed * _FACTORS[n - 1]) >> np.uint32(32 - BITS)))
        if row >= 0 and row != lo:
            yield row, held
            held, row = None, -1
        bounds = at.tolist()
        for k in range(hi - lo):
            a, b = bounds[k], bounds[k + 1]
            if b == a:
                continue
            bits = held if held is not None else np.zeros(1 << BITS, bool)
            for n, h in hashes:
                bits[h[a : max(a, b - n + 1)]] = True
            if hi == lo + 1:
                held, row = bits, lo
            else:
                yield lo + k, bits
    if row >= 0:
        yield row, held


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample: int = 1600, landmarks: int = 256, ridge: float = 1e-3, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model | None:
    """Fit on at most ``sample`` labelled documents that aren't held out, as many of each language as there are, up to its even share.

    The sample is drawn by a hash of the id within each language, from the whole table; the figures are the same in
    every run. None if there is no labelled text with a letter.
    """
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.crc32("id") % 4 != 2))
    counts = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))
    shares = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, int(min(1.0, (1.3 * each + 20) / n) * (1 << 40)))])
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0))).filter(has_letter("text"))
    table = drawn.select("lang", "text", "draw", "id").mapInArrow(_drawn_bits, "lang string, bits binary, draw long, id string").orderBy("draw", "id").limit(2 * sample + 40 * len(counts)).toArrow()
    taken: dict[str, int] = {}
    bits, labels = [], []
    for lang, blob in zip(table.column("lang").to_pylist(), table.column("bits").to_pylist()):
        if taken.get(lang, 0) < each:
            taken[lang] = taken.get(lang, 0) + 1
            bits.append(blob)
            labels.append(lang)
    if not bits:
        return None
    return solve(bits, labels, landmarks, ridge)


def _drawn_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows, bits = [], []
        for row, found in presence(batch.column("text")):
            rows.append(row)
            bits.append(np.packbits(found).tobytes())
        if rows:
            yield pa.record_batch([batch.column("lang").take(pa.array(rows)), pa.array(bits, pa.binary()), batch.column("draw").take(pa.array(rows)), batch.column("id").take(pa.array(rows))], ["lang", "bits", "draw", "id"])


def solve(packed: list[bytes], labels: list[str], landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """Nystroem features of the kernel and one ridge regression a language, folded to one weight a bit and language.

    Rows of bits are unpacked a few at a time; besides them only the landmarks' bits are held.
    """
    languages = sorted(set(labels))
    rows = lambda some: np.unpackbits(np.frombuffer(b"".join(some), np.uint8)).reshape(len(some), 1 << BITS).astype(np.float32)
    # landmarks in turn from every language
    turn: dict[str, int] = {}
    order = []
    for k, lang in enumerate(labels):
        turn[lang] = turn.get(lang, 0) + 1
        order.append((turn[lang], lang, k))
    chosen = [k for _, _, k in sorted(order)[:landmarks]]
    marks = rows([packed[k] for k in chosen])
    size = np.sqrt(np.maximum([int.from_bytes(x, "little").bit_count() for x in packed], 1))
    kernel = np.concatenate([rows(packed[k : k + 32]) @ marks.T for k in range(0, len(packed), 32)]).astype(np.float64) / size[:, None] / size[chosen]
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values[-1]
    half = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ half
    mean = features.mean(axis=0)
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    # each language counts alike
    weight = np.array([1 / labels.count(x) for x in languages])[[languages.index(x) for x in labels]]
    weight = weight / weight.sum() * len(labels)
    centred = features - mean
    gram = centred.T @ (centred * weight[:, None]) + ridge * len(labels) * np.eye(features.shape[1])
    base = (target * weight[:, None]).sum(axis=0) / weight.sum()
    beta = np.linalg.solve(gram, centred.T @ ((target - base) * weight[:, None]))
    onto = (half @ beta / size[chosen][:, None]).astype(np.float32)
    return Model(languages, marks.T @ onto, (base - mean @ beta).astype(np.float32))


def scores(model: Model, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, score 0 to 1) of rows of presence bits."""
    rows = bits.astype(np.float32)
    size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    values = (rows @ model.weights) / size + model.bias
    top = values.argmax(axis=1)
    odds = np.exp(model.sharpness * (values - values.max(axis=1, keepdims=True)))
    return top, 1 / odds.sum(axis=1)


def predict(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """row (all columns of the input's row), lang_pred, score; only the text is looked at.

    ``und`` with score 0 for null texts, texts without a letter, and when there is no model.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), has_letter(text_column).alias("letter"))
    place = docs.columns.index(text_column)
    if not isinstance(docs.schema[place].dataType, StringType):
        raise TypeError(f"{text_column} isn't a string")

    def text(batch: pa.RecordBatch) -> pa.Array:
        return batch.column("row").field(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            n = batch.num_rows
            languages, found, letter = [UNKNOWN] * n, np.zeros(n), batch.column("letter").to_pylist()
            block, where = [], []

            def flush() -> None:
                if where:
                    top, score = scores(model, np.array(block))
                    for k, t, s in zip(where, top.tolist(), score.tolist()):
                        languages[k], found[k] = model.languages[t], s
                    block.clear()
                    where.clear()

            if model is not None:
                for row, bits in presence(text(batch)):
                    if letter[row]:
                        block.append(bits)
                        where.append(row)
                        if len(where) == 64:
                            flush()
                flush()
            yield pa.record_batch([batch.column("row"), pa.array(languages, pa.string()), pa.array(found)], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def language_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", **fitting) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1).

    Null labels teach nothing. Null ids are never held out and teach nothing. Repeated rows get the same result.
    An empty table gives no rows.
    """
    model = fit(docs, id_column=id_column, text_column=text_column, label_column=label_column, **fitting)
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    rows = predict(slim, model)
    return rows.select("row.doc_id", "row.held_out", "lang_pred", "score")
