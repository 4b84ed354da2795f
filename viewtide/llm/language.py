"""Language identification by a byte convolutional network, trained here in numpy.

Text bytes become 59 symbols (letters, one blank, folded non-ASCII bytes). Filters of
several widths slide over fixed-length windows, each filter keeps its greatest response in
the window, and a softmax layer turns the responses into language probabilities. A
document's probabilities are the mean over all its windows.

The network always names a language that it knows. Whether a text is like that language at
all is told by the symbol triples of the training windows: Good-Turing gives the share of
triples that a text of the language should have new, and ``unlike`` how far beyond doubt
the text has more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewtide.llm import words
from viewtide.llm.scratch import keep, map_text

SYMBOLS = 64
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + (np.arange(128, 256) & 31)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class Training:
    """``sample_rows`` bounds the labelled rows the network is fitted on (spread evenly over
    the languages); of each, at most ``row_windows`` evenly spaced windows are used."""

    sample_rows: int = 3000
    row_windows: int = 4
    length: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    steps: int = 1500
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


@dataclass
class ByteConvNet:
    """Weights: per width a ``(width, SYMBOLS, filters)`` table, then a softmax layer."""

    langs: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None
    triples: np.ndarray | None = None  # per language, which symbol triples occurred
    fresh: np.ndarray | None = None  # per language, expected share of new ones
    cfg: Training = Training()

    def parts(self) -> tuple:
        """The trained weights as plain data."""
        return self.langs, self.tables, self.bias, self.out, self.out_bias, self.triples, self.fresh

    def learn_triples(self, x: np.ndarray, y: np.ndarray) -> None:
        """Triples around a letter, and the share of those found once (Good-Turing)."""
        codes, lettered = triple_codes(x)
        self.triples = np.zeros((len(self.langs), SYMBOLS**3), bool)
        self.fresh = np.ones(len(self.langs))
        for c in range(len(self.langs)):
            found, counts = np.unique(codes[y == c][lettered[y == c]], return_counts=True)
            self.triples[c, found] = True
            if len(found):
                self.fresh[c] = (counts == 1).sum() / counts.sum()

    def unlike(self, x: np.ndarray, lang: int) -> float:
        """Lower bound (three deviations) of the share of a document's triples that its language lacks,
        beyond the expected share of new ones; 0 for few triples."""
        codes, lettered = triple_codes(x)
        n = int(lettered.sum())
        new = int((lettered & ~self.triples[lang][codes]).sum())
        return max(0.0, (new - 3 * new**0.5) / n - float(self.fresh[lang])) if n else 0.0

    def responses(self, x: np.ndarray, where: bool = False):
        """Greatest response of each filter in each window row of ``x``, and its place."""
        best, at = [], []
        for table in self.tables:
            n = x.shape[1] - len(table) + 1
            y = table[0][x[:, :n]]
            for j in range(1, len(table)):
                y += table[j][x[:, j: j + n]]
            if where:
                at.append(y.argmax(1))
            best.append(y.max(1))
        return np.concatenate(best, 1) + self.bias, at

    def paired(self) -> list[list[tuple[int, np.ndarray]]]:
        """Tables of symbol pairs: a filter of width w needs w / 2 lookups a position."""
        out = []
        for table in self.tables:
            steps = []
            for j in range(0, len(table) - 1, 2):
                steps.append((j, (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(SYMBOLS**2, -1)))
            if len(table) % 2:
                steps.append((len(table) - 1, table[-1]))
            out.append(steps)
        return out

    def probabilities(self, x: np.ndarray, paired) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) * SYMBOLS + x[:, 1:]
        best = []
        for table, steps in zip(self.tables, paired):
            n = x.shape[1] - len(table) + 1
            y = None
            for j, t in steps:
                part = t.take((pairs if len(t) > SYMBOLS else x)[:, j: j + n], axis=0)
                y = part if y is None else np.add(y, part, out=y)
            best.append(y.max(1))
        return self._softmax(np.maximum(np.concatenate(best, 1) + self.bias, 0))

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.out_bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray) -> ByteConvNet:
        """Adam on mini-batches; a third of the windows are cut short, as short texts are."""
        cfg, rng = self.cfg, np.random.default_rng(self.cfg.seed)
        k, f = len(self.langs), cfg.filters
        self.tables = [rng.normal(0, 0.1, (w, SYMBOLS, f)).astype(np.float32) for w in cfg.widths]
        self.bias = np.zeros(f * len(cfg.widths), np.float32)
        self.out = rng.normal(0, 0.1, (f * len(cfg.widths), k)).astype(np.float32)
        self.out_bias = np.zeros(k, np.float32)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        by_lang = [np.flatnonzero(y == c) for c in range(k)]
        for step in range(1, cfg.steps + 1):
            rows = np.array([by_lang[c][rng.integers(len(by_lang[c]))] for c in rng.integers(k, size=cfg.batch)])
            xb, yb = x[rows].copy(), y[rows]
            for i in range(0, cfg.batch, 3):
                xb[i, rng.integers(6, cfg.length):] = 0
            raw, at = self.responses(xb, where=True)
            hidden = np.maximum(raw, 0)
            delta = self._softmax(hidden)
            delta[np.arange(len(yb)), yb] -= 1
            delta /= len(yb)
            back = (delta @ self.out.T) * (raw > 0)
            grads, lo = [], 0
            for table, place in zip(self.tables, at):
                g, part = np.zeros_like(table), back[:, lo: lo + f]
                for j in range(len(table)):  # only the greatest response passes a gradient
                    symbol = np.take_along_axis(xb, place + j, 1)
                    np.add.at(g[j], (symbol, np.arange(f)[None, :]), part)
                grads.append(g)
                lo += f
            grads += [back.sum(0), hidden.T @ delta, delta.sum(0)]
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol windows of whole documents (blank-padded, one at least) and each one's first."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // length))
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(first[-1] * length, np.uint8)
    shift = np.repeat(first[:-1] * length - offsets[:-1], size)
    flat[np.arange(offsets[0], offsets[-1]) + shift] = _SYMBOL[data[offsets[0]: offsets[-1]]]
    return flat.reshape(-1, length), first


def triple_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each symbol triple of the windows, and whether its middle is a letter."""
    wide = x.astype(np.int32)
    return (wide[:, :-2] * SYMBOLS + wide[:, 1:-1]) * SYMBOLS + wide[:, 2:], x[:, 1:-1] > 0


def _has_letter(raw: bytes) -> bool:
    if _LETTER[np.frombuffer(raw, np.uint8)].any():
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _samples(cfg: Training):
    """Evenly spaced windows of each sampled row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.text_buffers(batch.column("__text"))
            langs, rows = [], []
            for d, lang in enumerate(batch.column("__lang").to_pylist()):
                found, _ = windows(data, offsets[d: d + 2], cfg.length)
                for i in np.unique(np.linspace(0, len(found) - 1, cfg.row_windows).astype(int)):
                    if found[i].any():
                        langs.append(lang)
                        rows.append(found[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "x"])
    return run


def train(labelled: DataFrame, cfg: Training = Training(), id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> ByteConvNet | None:
    """The network fitted on a bounded sample of rows with a language and a letter; None if
    there are none. The sample is the same for the same rows in any order."""
    rows = labelled.select(F.col(id).cast("string").alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"),
                           F.xxhash64(text).alias("__tkey")).filter(
        F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}"))
    # One row per language: as many as the softmax layer, itself a broadcast, has outputs.
    langs = keep(rows.groupBy("__lang").agg(F.count("*").alias("n")), "langs")
    each = max(1, cfg.sample_rows // max(1, langs.count()))
    by_digest = W.partitionBy("__lang").orderBy(F.md5(F.coalesce("__id", F.lit(""))), "__tkey")
    # Only digests small enough to be among the least of their language reach the window:
    # about the sample size, however many rows and tasks a language has.
    spot = F.conv(F.substring(F.md5(F.coalesce("__id", F.lit(""))), 1, 12), 16, 10).cast("double") / 2.0**48
    low = rows.join(F.broadcast(langs), "__lang").filter(spot * F.col("n") < each + 6 * each**0.5 + 20)
    chosen = low.select("__id", "__lang", "__tkey").distinct().withColumn("r", F.row_number().over(by_digest)).filter(F.col("r") <= each).select(
        F.col("__id").alias("i"), F.col("__tkey").alias("t"), F.col("__lang").alias("l"))
    # At most sample_rows rows, whatever the size of the table.
    picked = rows.dropna(subset=["__lang"]).join(
        F.broadcast(keep(chosen, "sample")), F.col("__id").eqNullSafe(F.col("i")) & (F.col("__tkey") == F.col("t"))
        & (F.col("__lang") == F.col("l"))).dropDuplicates(["__id", "__tkey", "__lang"])
    sample = map_text(picked.select("__text", "__lang"), _samples(cfg), "lang string, x binary").toArrow()
    pairs = sorted(zip(sample.column("lang").to_pylist(), sample.column("x").to_pylist()))
    if not pairs:
        return None
    known = sorted({p[0] for p in pairs})
    x = np.frombuffer(b"".join(p[1] for p in pairs), np.uint8).reshape(-1, cfg.length)
    y = np.searchsorted(np.array(known, object), np.array([p[0] for p in pairs], object)).astype(int)
    net = ByteConvNet(known, cfg=cfg).fit(x, y)
    net.learn_triples(x, y)
    return net


def identify(docs: DataFrame, model: ByteConvNet | None, text: str = "text", carry: list[str] | None = None,
             unlike: bool = False) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default) plus ``lang_pred, score`` and, if asked
    for, ``unlike``: from 0 (like the training text of ``lang_pred``) towards 1, whatever the
    number of languages; a short text needs more to rise above 0.

    The whole text counts, window by window. A text that is null or has no letter is
    ``und`` with score 0, and so is every text without a model. One row in, one row out,
    no shuffle. Columns of ``docs`` named like a result (in any case) are replaced.
    """
    names = ["lang_pred", "score", *(["unlike"] if unlike else [])]
    columns = [c for c in carry or docs.columns if c.lower() not in names]
    passed = columns if text in columns else [*columns, text]
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("lang_pred", T.StringType()),
                           *[T.StructField(c, T.DoubleType()) for c in names[1:]]])
    length = model.cfg.length if model else Training.length
    shared = docs.sparkSession.sparkContext.broadcast(model and model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value and ByteConvNet(*shared.value)
        paired = net.paired() if net else None
        for batch in batches:
            data, offsets = words.text_buffers(batch.column(text))
            langs, scores, odd = [], [], []
            for i, j in words.chunks(offsets):
                x, first = windows(data, offsets[i: j + 1], length)
                mean = None
                if net:
                    p = np.concatenate([net.probabilities(x[k: k + 256], paired) for k in range(0, len(x), 256)])
                    mean = np.add.reduceat(p, first[:-1], axis=0) / np.diff(first)[:, None]
                for d in range(j - i):
                    raw = data[offsets[i + d]: offsets[i + d + 1]].tobytes()
                    if mean is None or not _has_letter(raw):
                        langs.append("und")
                        scores.append(0.0)
                        odd.append(0.0)
                    else:
                        best = int(mean[d].argmax())
                        langs.append(net.langs[best])
                        scores.append(float(min(1.0, mean[d, best])))
                        odd.append(net.unlike(x[first[d]: first[d + 1]], best) if unlike else 0.0)
            made = [pa.array(langs, pa.string()), *[pa.array(v, pa.float64()) for v in (scores, odd)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made[: len(names)]], names=[*columns, *names])

    return map_text(docs.select(*passed), run, schema)


def held_out(id: str = "doc_id"):
    """Rows kept from training: CRC-32 of the id as text is 1 modulo 3; a null id is none."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
