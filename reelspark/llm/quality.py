"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import lean

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "signs", "repeated_signs", "spaces", "newlines", "wide",
    "byte_entropy", "distinct_words", "top_word", "signed_words", "capital_words", "lone_signs", "ended_words", "same_as_before",
    "distinct_lines", "line_words", "top_line", "squeezed", "longest_word", "lines_cut", "half_signs_gap", "half_upper_gap",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'-"]] = True


def statistics(text: str | None) -> list[float]:
    """The statistics named in FEATURES over the whole text; null counts as empty. Language, source and ids play no part."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    x = np.frombuffer(data, np.uint8)
    n = max(1, len(x))
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / n
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    m = max(1, len(lines))
    signs, upper = _SIGN[x], _UPPER[x]
    half = len(x) // 2
    gap = lambda mask: abs(float(mask[:half].mean()) - float(mask[half:].mean())) if half else 0.0
    return [
        np.log1p(len(x)), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()),
        upper.sum() / n, _DIGIT[x].sum() / n, signs.sum() / n, float((signs[1:] & (x[1:] == x[:-1])).sum()) / n,
        count[32] / n, count[10] / n, count[128:].sum() / n, float(-(p * np.log2(p)).sum()),
        len(seen) / w, max(seen.values(), default=0) / w,
        sum(c for s, c in seen.items() if not s[-1].isalnum() and s[-1] not in ".,'-") / w,
        sum(c for s, c in seen.items() if s.isupper() and len(s) > 1) / w,
        sum(c for s, c in seen.items() if not any(map(str.isalnum, s))) / w,
        sum(c for s, c in seen.items() if s[-1] in ".,") / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(set(lines)) / m, np.log1p(len(words) / m), max(Counter(lines).values(), default=0) / m,
        len(zlib.compress(data, 1)) / n, float(np.log1p(sizes.max())),
        sum(not s.rstrip().endswith((".", "!", "?")) for s in lines) / m, gap(signs), gap(upper),
    ]


@dataclass
class Trees:
    """All trees in flat arrays: node i of tree t goes to `left` if x[feature] <= threshold, else to left + 1; leaves point to themselves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        row = np.arange(len(x))[:, None]
        node = np.tile(self.roots, (len(x), 1))
        for _ in range(self.depth):
            go = x[row, self.feature[node]] > self.threshold[node]
            node = self.left[node] + (go & (self.left[node] != node))
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 64, least: int = 12, smooth: float = 1.0) -> Trees:
    """Boost trees on the logistic loss; splits are sought over histograms of at most `bins` quantile bins.

    With no rows or one class only, the model is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    features, thresholds, lefts, values, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        flat = code + np.arange(x.shape[1]) * bins
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            roots.append(len(features))
            features.append(0), thresholds.append(0.0), lefts.append(len(features) - 1), values.append(0.0)
            front = [(roots[-1], np.arange(len(y)), depth)]
            while front:
                node, rows, more = front.pop()
                sg, sh = g[rows].sum(), h[rows].sum()
                best = (1e-6, 0, 0)
                if more and len(rows) >= 2 * least:
                    at = flat[rows].ravel()
                    k = x.shape[1]
                    size = k * bins
                    hg, hh, hn = (np.bincount(at, weights=np.repeat(v, k), minlength=size).reshape(k, bins).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows))))
                    gain = hg**2 / (hh + smooth) + (sg - hg) ** 2 / (sh - hh + smooth) - sg**2 / (sh + smooth)
                    gain[(hn < least) | (len(rows) - hn < least)] = 0
                    i = int(gain.argmax())
                    best = max(best, (float(gain.flat[i]), i // bins, i % bins))
                if best[0] <= 1e-6 or best[2] >= len(edges[best[1]]):
                    values[node] = rate * sg / (sh + smooth)
                    raw[rows] += values[node]
                    continue
                _, f, b = best
                down = code[rows, f] <= b
                features[node], thresholds[node], lefts[node] = f, float(edges[f][b]), len(features)
                for part in (rows[down], rows[~down]):
                    features.append(0), thresholds.append(0.0), lefts.append(len(features) - 1), values.append(0.0)
                    front.append((len(features) - 1, part, more - 1))
    return Trees(base, np.array(features, np.int32), np.array(thresholds), np.array(lefts, np.int32), np.array(values), np.array(roots, np.int32), depth)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of all ids that no label is learned from: crc32 of the id's text mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on labelled rows that are not held out, on at most about `max_rows` of them (a bounded sample by a hash of the id).

    Rows with a null label, id or without a document are left out; an id with several labels counts with
    its smallest, one with several documents once, with the text of the smallest hash.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    # At most about max_rows ids, however large the tables are.
    texts = texts.join(F.broadcast(rows), "id")

    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            values = np.array([statistics(s) for s in t["text"]], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(t["id"], pa.int64()), pa.array(t["label"], pa.int32()), pa.array(t["hash"], pa.int64()), pa.array(list(values), pa.list_(pa.float64()))], names=["id", "label", "hash", "x"])

    got = texts.select("id", "label", "text", "hash").mapInArrow(lean(run), "id long, label int, hash long, x array<double>")
    # Rows that repeat an id become one within each task already, so that the driver gets max_rows and not all of them.
    got = got.groupBy("id", "label").agg(F.min(F.struct("hash", "x")).alias("s")).select("id", "label", "s.x").toPandas().sort_values("id", kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy(dtype=np.float64))


def quality_scores(docs: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: label 1 likelier), predicted (1 if score >= threshold, else 0).

    One pass without a shuffle over whole texts. Null and empty texts get the score of their statistics
    (all zero). Repeated rows and null ids are scored like others. `keep` names further columns to return.
    """
    names = [c for c in docs.columns if c in keep]
    kept = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    spread = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("out"), F.col(text_col).alias("t"), *kept)
    schema = spread.drop("t").schema.add("score", "double")

    def run(batches):
        for batch in batches:
            x = np.array([statistics(s) for s in batch.column(2).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            cols = [c for i, c in enumerate(batch.columns) if i != 2]
            score = np.concatenate([model.scores(x[i : i + 2048]) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score)], names=schema.names)

    out = spread.mapInArrow(lean(run), schema)
    return out.select(F.col("id").alias("doc_id"), F.col("out").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != "doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the classifier rejects; same columns in one pass."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    names = [c for c in docs.columns if c != id_col]
    out = quality_scores(docs, model, threshold, id_col, text_col, keep=tuple(names)).where("predicted = 1")
    return out.select(*[F.col("doc_id").cast(docs.schema[id_col].dataType).alias(c) if c == id_col else F.col(c) for c in docs.columns])
