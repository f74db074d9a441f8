"""Language identification by error-correcting output codes.

Every language gets a codeword of bits.  For each bit a binary n-gram
classifier tells the languages whose bit is 1 from the others: its weights
are smoothed log-odds of hashed byte trigrams, from counts over all training
documents, so training needs no sample and the same rows always give the same
model (sums are of whole units, in any order).  A text's bit margins are the
mean weights of its trigrams; decoding picks the codeword of least logistic
loss, each bit weighted by how well it separates the languages, and flags a
text as ambiguous if the runner-up is close.

The counts by language stay a table; tasks fold it into the classifiers, which
have one row a trigram slot and one column a bit (bits grow with the logarithm
of the labels).  The driver gets those, and one row a label: its name and its
total.  So a column of very many labels makes decoding slow, and nothing else.
Tasks hold counts of the slots that occur, never a table by document.

A trigram is three bytes of the lower-cased text in which everything but
letters (a-z and non-ASCII bytes) is one kind of gap.  NULL texts and texts
without a letter are ``und`` with score 0.  If there is nothing to learn
from, every text is ``und``.  Ties go to the first language by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .text import LOWER, blocks, utf8

SLOTS = 1 << 13  # hashed trigrams
SMOOTH = 0.5
SHARPNESS = 12.0  # of the logistic loss over bit margins
AMBIGUOUS = 0.15  # least distance between the best and the second share
ENOUGH = 200  # trigrams that ought to tell a language
UNKNOWN = "und"
BLOCK = 1 << 19  # bytes of texts that are counted at a time
CELLS = 1 << 21  # documents x languages that are decoded at a time
HELD = 128  # languages whose counts a task holds before it passes them on
UNIT = 1024  # parts of a count
FINE = 1 << 44  # parts of a share

PREDICTED = "doc_id long, lang_pred string, score double, ambiguous boolean"


def _fold() -> np.ndarray:
    t = LOWER.copy()
    t[:128][~((t[:128] >= 97) & (t[:128] <= 122))] = 32
    return t


FOLD = _fold()


def trigram_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, count) of the hashed trigrams that hold a letter, by document."""
    none = np.zeros(0, np.int64)
    codes = FOLD[data]
    if len(codes) < 3:
        return none, none, none
    c = codes.astype(np.uint32)
    gram = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    slot = (gram * np.uint32(2654435761)) >> np.uint32(32 - 13)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = (doc[:-2] == doc[2:]) & (gram != 0x202020)
    cell, n = np.unique(doc[:-2][keep] * SLOTS + slot[keep], return_counts=True)
    return cell // SLOTS, cell % SLOTS, n


def parts(off: np.ndarray, most_docs: int):
    """Ranges of whole documents, bounded in bytes and in number."""
    for i, j in blocks(off, BLOCK):
        for k in range(i, j, most_docs):
            yield k, min(k + most_docs, j)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each document holds a letter of any script."""
    codes = LOWER[data]
    ascii_letter = np.concatenate(([0], np.cumsum((codes >= 97) & (codes <= 122))))
    found = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for d in np.flatnonzero(~found & (off[1:] > off[:-1])):
        raw = data[off[d] : off[d + 1]]
        if raw.max() >= 128:
            found[d] = any(ch.isalpha() for ch in raw.tobytes().decode("utf-8", "replace"))
    return found


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``n`` languages (rows).

    Up to five languages get the exhaustive code; more get the widest apart
    of several seeded random codes with no constant and no repeated column.
    Beyond 512 one code is drawn: comparing all words takes their square.
    """
    if n <= 5:
        width = max(1, 2 ** (n - 1) - 1)
        code = np.ones((n, width), np.int8)
        for col in range(width):
            for row in range(1, n):
                # Row 0 is all ones; the others run through all other columns.
                code[row, col] = 1 if (col >> (n - 1 - row)) & 1 else -1
        return code
    width = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for seed in range(20 if n <= 512 else 1):
        code = np.where(np.random.default_rng(seed).random((n, width)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0, dtype=np.int64)) < n]
        if n > 512:
            return code
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(same, -code.shape[1])
        if (gap := int(code.shape[1] - same.max())) > apart:
            best, apart = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # SLOTS x bits
    trust: np.ndarray  # per bit

    @property
    def most_docs(self) -> int:
        """Documents whose shares are computed at a time."""
        return max(1, CELLS // len(self.languages))

    def shares(self, doc: np.ndarray, slot: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
        """Share (documents x languages) of each language, from the loss of its codeword."""
        total = np.maximum(np.bincount(doc, n, docs), 1)
        loss = np.zeros((docs, len(self.languages)))
        for b in range(self.code.shape[1]):
            margin = np.bincount(doc, n * self.weights[slot, b], docs) / total
            # The bit has two losses, whatever the languages.
            two = self.trust[b] * np.logaddexp(0, np.outer(margin, [SHARPNESS, -SHARPNESS]))
            loss += two[:, (self.code[:, b] > 0).astype(np.int64)]
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return e / e.sum(axis=1, keepdims=True)


def label_counts(labelled: DataFrame) -> DataFrame:
    """``lang, slot, n``: counts of the trigram slots by label, in whole units."""

    def count(batches):
        tables: dict[str, np.ndarray] = {}

        def passed_on():
            for lang, table in sorted(tables.items()):
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at])], ["lang", "slot", "n"]
                )
            tables.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, off = utf8(batch.column(1))
            for i, j in blocks(off, BLOCK):
                doc, slot, n = trigram_counts(data[off[i] : off[j]], off[i : j + 1] - off[i])
                # Each document weighs by the square root of its length, in whole units.
                total = np.bincount(doc, n, j - i)
                units = np.rint(n / np.sqrt(total[doc]) * UNIT).astype(np.int64)
                names, of = np.unique(langs[i:j], return_inverse=True)
                cell, where = np.unique(of[doc] * SLOTS + slot, return_inverse=True)
                summed = np.bincount(where, units, len(cell)).astype(np.int64)
                edge = np.searchsorted(cell, np.arange(len(names) + 1) * SLOTS)
                for k, name in enumerate(names.tolist()):
                    part = slice(edge[k], edge[k + 1])
                    if name not in tables:
                        if len(tables) >= HELD:
                            yield from passed_on()
                        tables[name] = np.zeros(SLOTS, np.int64)
                    tables[name][cell[part] - k * SLOTS] += summed[part]
        yield from passed_on()

    return labelled.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def _by_label(batch, labels: np.ndarray):
    """Rows of a batch of label counts as arrays: label number, slot, count."""
    names = batch.column(0).dictionary_encode()
    number = np.searchsorted(labels, np.array(names.dictionary.to_pylist(), object))
    n = batch.column(2).to_numpy() / UNIT
    return number[names.indices.to_numpy()], batch.column(1).to_numpy(), n


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Train on all rows of ``docs`` with a text and a label; None if there are none."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    spark = docs.sparkSession
    folder = scratch_dir(spark, "language-counts")
    label_counts(labelled).write.parquet(folder)
    counts = spark.read.parquet(folder)
    # One row a label.
    totals = sorted(tuple(r) for r in counts.groupBy("lang").agg(F.sum("n")).collect())
    if not totals:
        return None
    languages = [lang for lang, _ in totals]
    code = codewords(len(languages))
    bits = code.shape[1]
    if len(languages) == 1:
        return Model(languages, code, np.zeros((SLOTS, 1)), np.ones(1))
    labels = np.array(languages, object)
    # The share of a slot in a label's texts is (count + SMOOTH) / size.
    size = np.array([n for _, n in totals]) / UNIT + SMOOTH * SLOTS
    member = code > 0

    def shares(batches):
        summed = np.zeros((SLOTS, bits + 1), np.int64)
        for batch in batches:
            label, slot, n = _by_label(batch, labels)
            share = np.rint(n / size[label] * FINE)
            for b in range(bits):
                here = member[label, b]
                summed[:, b] += np.bincount(slot[here], share[here], SLOTS).astype(np.int64)
            summed[:, bits] += np.bincount(slot, share, SLOTS).astype(np.int64)
        at = np.flatnonzero(summed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(summed.ravel()[at])], ["cell", "n"])

    cells = np.zeros(SLOTS * (bits + 1))
    for r in counts.mapInArrow(shares, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"] / FINE
    cells = cells.reshape(SLOTS, bits + 1)
    base = SMOOTH / size
    ones = (cells[:, :bits] + base @ member) / member.sum(axis=0)
    others = (cells[:, bits:] - cells[:, :bits] + base @ ~member) / (~member).sum(axis=0)
    weights = np.log(ones / others)

    def margins(batches):
        for batch in batches:
            label, slot, n = _by_label(batch, labels)
            found, label = np.unique(label, return_inverse=True)
            part = np.stack([np.bincount(label, n * weights[slot, b], len(found)) for b in range(bits)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(found, bits), pa.int32()),
                    pa.array(np.tile(np.arange(bits), len(found)), pa.int32()),
                    pa.array((part / size[found, None] * code[found]).ravel()),
                ],
                ["label", "bit", "margin"],
            )

    # A bit counts by the least margin it gives a language's own text.
    own = counts.mapInArrow(margins, "label int, bit int, margin double").groupBy("label", "bit").agg(F.sum("margin").alias("margin"))
    rest = (base[:, None] * weights.sum(axis=0)) * code

    def smallest(batches):
        for batch in batches:
            label, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            margin = pa.array(batch.column(2).to_numpy() + rest[label, bit])
            yield pa.RecordBatch.from_arrays([batch.column(1), margin], ["bit", "margin"])

    least = np.zeros(bits)
    for r in own.mapInArrow(smallest, "bit int, margin double").groupBy("bit").agg(F.min("margin").alias("margin")).collect():
        least[r["bit"]] = r["margin"]
    # Rounded: sums of margins depend on their order in the last bits.
    trust = np.round(np.maximum(least, 1e-3), 9)
    return Model(languages, code, weights, trust / trust.sum())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` (the share of the chosen language), ``ambiguous``."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in parts(off, model.most_docs if model else max(1, batch.num_rows)):
                rel = off[i : j + 1] - off[i]
                letters = has_letter(data[off[i] : off[j]], rel)
                if model is None:
                    pred, score, unsure = [UNKNOWN] * (j - i), np.zeros(j - i), np.zeros(j - i, bool)
                else:
                    share = model.shares(*trigram_counts(data[off[i] : off[j]], rel), j - i)
                    best = share.argmax(axis=1)
                    top = np.sort(share, axis=1)[:, ::-1]
                    second = top[:, 1] if share.shape[1] > 1 else np.zeros(j - i)
                    unsure = letters & (top[:, 0] - second < AMBIGUOUS)
                    pred = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                    score = np.where(letters, top[:, 0], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PREDICTED)


def accept(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language: texts without a letter go, and
    ambiguous ones of ``ENOUGH`` trigrams or more (shorter ones get the benefit
    of the doubt).  Without a model only texts without a letter go."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(place))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in parts(off, model.most_docs if model else max(1, batch.num_rows)):
                rel = off[i : j + 1] - off[i]
                ok = has_letter(data[off[i] : off[j]], rel)
                if model is not None and len(model.languages) > 1:
                    doc, slot, n = trigram_counts(data[off[i] : off[j]], rel)
                    top = np.sort(model.shares(doc, slot, n, j - i), axis=1)
                    ok &= (top[:, -1] - top[:, -2] >= AMBIGUOUS) | (np.bincount(doc, n, j - i) < ENOUGH)
                keep[i:j] = ok
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Rows whose crc32 of the id as text leaves no remainder; a NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    model = fit(docs.where(~held_out("doc_id", folds)))
    got = predict(docs, model)
    return got.select("doc_id", held_out("doc_id", folds).alias("held_out"), "lang_pred", "score", "ambiguous")
