"""Language identification by a byte convolutional network, trained in numpy.

Text is cut into windows of ``WINDOW`` bytes (the last one padded with zeros). A window's bytes are
embedded, convolved with filters of several widths, max-pooled over the window and classified by a
softmax layer. A document's prediction is the mean of its windows' log-probabilities, weighted by
their bytes, over the whole text.

The network is fitted on the driver on a bounded sample: at most ``sample_docs`` labelled documents, the
ones with the smallest hash of their id, and at most ``sample_windows`` windows of each, spread over
the text; a count of the labelled documents bounds the hash first, so that about twice the sample reaches the driver at
most, whatever the number of tasks. Weights (some tens of kilobytes, whatever the input) go to the workers with the function.

Defined results: NULL texts and texts without a letter get ``und`` with score 0; if no labelled document
can be learnt from, every document gets ``und``; NULL ids are never held out and stay; repeated rows get equal
results; a tie of two languages goes to the first by name; texts of any length are read whole, a block of windows at a
time; empty tables give empty results; other columns are ignored, the label only trains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
DIM, FILTERS = 6, 12
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 4
EPOCHS, BATCH, RATE = 12, 64, 4e-3
UNKNOWN = "und"
AT_ONCE = 1024  # windows of several documents that are classified together


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text has this remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def windows(data: bytes) -> np.ndarray:
    """The bytes in rows of ``WINDOW``, zero-padded."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class ByteConvNet:
    """Embedding, convolutions of several widths, max pooling and softmax."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, DIM)), "o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "b": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def features(self, x: np.ndarray):
        """Pooled filter outputs of windows ``x``; with them, where each maximum was."""
        e = self.p["e"][x]  # windows, bytes, dim
        flat = e.reshape(len(x), -1)
        pooled, at = [], []
        for w in WIDTHS:
            spans = WINDOW - w + 1
            view = np.lib.stride_tricks.as_strided(flat, (len(x), spans, w * DIM), (flat.strides[0], 4 * DIM, 4))
            y = view.reshape(-1, w * DIM) @ self.p[f"w{w}"]
            y = y.reshape(len(x), spans, FILTERS)
            k = y.argmax(axis=1) if at is not None else None
            pooled.append(np.take_along_axis(y, k[:, None, :], 1)[:, 0] + self.p[f"c{w}"])
            at.append(k)
        return np.maximum(np.concatenate(pooled, 1), 0), at

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows, in blocks that bound memory."""
        out = []
        for i in range(0, len(x), 64):
            e = self.p["e"][x[i : i + 64]].reshape(len(x[i : i + 64]), -1)
            pooled = []
            for w in WIDTHS:
                spans = WINDOW - w + 1
                view = np.lib.stride_tricks.as_strided(e, (len(e), spans, w * DIM), (e.strides[0], 4 * DIM, 4))
                y = (view.reshape(-1, w * DIM) @ self.p[f"w{w}"]).reshape(len(e), spans, FILTERS)
                pooled.append(y.max(axis=1) + self.p[f"c{w}"])
            z = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["o"] + self.p["b"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        """Adam on cross-entropy, classes weighted by the inverse of their share."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        weight = (len(y) / (len(self.classes) * np.maximum(np.bincount(y, minlength=len(self.classes)), 1))).astype(np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                k = order[i : i + BATCH]
                for name, g in self._gradients(x[k], y[k], weight[y[k]]).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                    step = m[name] / (1 - 0.9 ** (t + 1)) / (np.sqrt(v[name] / (1 - 0.99 ** (t + 1))) + 1e-6)
                    self.p[name] -= (RATE * step).astype(np.float32)
                t += 1

    def _gradients(self, x, y, weight) -> dict[str, np.ndarray]:
        f, at = self.features(x)
        z = f @ self.p["o"] + self.p["b"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None] / len(y)
        back = (p @ self.p["o"].T) * (f > 0)
        out = {"o": f.T @ p, "b": p.sum(axis=0), "e": np.zeros_like(self.p["e"])}
        rows = np.arange(len(x))[:, None, None]
        for j, w in enumerate(WIDTHS):
            g = back[:, j * FILTERS : (j + 1) * FILTERS]
            seen = x[rows, at[j][:, :, None] + np.arange(w)]  # windows, filters, width
            e = self.p["e"][seen].reshape(len(x), FILTERS, -1)
            out[f"w{w}"] = np.einsum("nfk,nf->kf", e, g)
            out[f"c{w}"] = g.sum(axis=0)
            np.add.at(out["e"], seen, (g[:, :, None] * self.p[f"w{w}"].T[None]).reshape(*seen.shape, DIM))
        return out


def train(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, seed: int = 0) -> ByteConvNet | None:
    """A network fitted on a bounded sample of the rows where ``learn`` holds; None without any."""
    text = F.col(text_col).cast("binary")
    size = WINDOW * sample_windows
    step = F.greatest(F.octet_length(text_col) / sample_windows, F.lit(WINDOW)).cast("int")
    cut = F.concat(*[F.substring(text, step * k + 1, F.lit(WINDOW)) for k in range(sample_windows)])
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.substring(cut, 1, size).alias("t"), F.col(lang_col).alias("lang"))
    learnt = rows.count()
    if learnt > 2 * sample_docs:
        rows = rows.filter(F.col("h") <= int(-(2**63) + 2**64 * (2 * sample_docs / learnt)))
    sample = rows.orderBy("h", "lang").limit(sample_docs).collect()
    classes = sorted({r["lang"] for r in sample})
    if not classes:
        return None
    x, y = [], []
    for r in sample:
        w = windows(bytes(r["t"]))
        x.append(w)
        y += [classes.index(r["lang"])] * len(w)
    net = ByteConvNet(classes, seed)
    net.fit(np.concatenate(x), np.array(y), seed)
    return net


def identify(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", *carry: Column) -> DataFrame:
    """Per row: ``doc_id``, the columns of ``carry``, ``lang_pred`` and ``score`` (the mean probability)."""

    def mean_log_probs(data: list[bytes]) -> np.ndarray:
        cut = [windows(x) for x in data]
        ends = np.cumsum([len(w) for w in cut])
        lengths = np.array([len(x) for x in data])
        held = np.full(ends[-1], WINDOW)
        held[ends - 1] = lengths - WINDOW * (np.diff(ends, prepend=0) - 1)
        lp = net.log_probs(np.concatenate(cut)) * held[:, None]
        return np.add.reduceat(lp, np.append(0, ends[:-1]), axis=0) / lengths[:, None]

    def run(batches):
        for b in batches:
            lang, score, at, data, size = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows, [], [], 0

            def settle():
                for k, z in zip(at, mean_log_probs(data), strict=True):
                    p = np.exp(z - z.max())
                    lang[k], score[k] = net.classes[int(z.argmax())], float(p.max() / p.sum())

            for k, text in enumerate(b.column(0).to_pylist()):
                if net is None or text is None or not any(map(str.isalpha, text)):
                    continue
                at.append(k)
                data.append(text.encode("utf-8", "surrogatepass"))
                size += 1 + len(data[-1]) // WINDOW
                if size >= AT_ONCE:
                    settle()
                    at, data, size = [], [], 0
            if at:
                settle()
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"])

    d = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *carry)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    return d.mapInArrow(run, f"{kept}, lang_pred string, score double")
