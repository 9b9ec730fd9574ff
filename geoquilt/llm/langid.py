"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import runs, text_buffers

_PAD = 256


class ByteGRU:
    """Two gated recurrent layers, one in each direction, and a softmax over labels at every position.

    Arrays are time-major with the batch last: a step works on (units, batch) matrices. The reset gate is applied after
    the recurrent product, so a step has one product for all three gates.
    """

    def __init__(self, labels: int, units: int = 8, seed: int = 0):
        r = np.random.Generator(np.random.PCG64(seed))
        self.units, self.labels = units, labels
        self.p = {"out": r.normal(0, 0.3, (labels, 2 * units)), "bias": np.zeros((labels, 1))}
        for d in "fb":
            self.p[d + "x"] = r.normal(0, 0.5, (3 * units, 257))
            self.p[d + "u"] = r.normal(0, units**-0.5, (3 * units, units))
            self.p[d + "x"][:units] += 0.5
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _layer(self, d: str, x: np.ndarray, solid: np.ndarray | None, keep: bool):
        n, (steps, batch) = self.units, x.shape
        table, u = self.p[d + "x"], self.p[d + "u"]
        h = np.zeros((n, batch), np.float32)
        states = np.empty((steps, n, batch), np.float32)
        saved = []
        half = np.float32(0.5)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, s = table[:, x[t]], u @ h
            gates = np.tanh((g[: 2 * n] + s[: 2 * n]) * half) * half + half
            z, r = gates[:n], gates[n:]
            c = np.tanh(g[2 * n :] + r * s[2 * n :])
            new = c + z * (h - c)
            if solid is not None:
                new = new * solid[t]
            if keep:
                saved.append((t, h, z, r, c, s[2 * n :]))
            h = new
            states[t] = h
        return states, saved

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: (steps, batch) of bytes, 256 beyond a window's end; returns (steps, labels, batch)."""
        solid = (x != _PAD).astype(np.float32) if (x == _PAD).any() else None
        both = np.concatenate([self._layer("f", x, solid, False)[0], self._layer("b", x, solid, False)[0]], 1)
        a = np.matmul(self.p["out"], both) + self.p["bias"]
        a -= a.max(1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(1, keepdims=True)
        return a

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, each of which has its window's label y, and its gradients by backpropagation through time."""
        n, (steps, batch) = self.units, x.shape
        solid = (x != _PAD).astype(np.float32)
        passes = {d: self._layer(d, x, solid, True) for d in "fb"}
        both = np.concatenate([passes["f"][0], passes["b"][0]], 1)
        a = np.matmul(self.p["out"], both) + self.p["bias"]
        a -= a.max(1, keepdims=True)
        a = np.exp(a)
        a /= a.sum(1, keepdims=True)
        count = max(1.0, float(solid.sum()))
        right = a[:, y, np.arange(batch)]
        loss = float(-(np.log(np.maximum(right, 1e-12)) * solid).sum() / count)
        a[:, y, np.arange(batch)] -= 1
        a *= solid[:, None, :] / np.float32(count)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] = np.einsum("tlb,tub->lu", a, both)
        grads["bias"] = a.sum((0, 2))[:, None]
        down = np.matmul(self.p["out"].T, a)
        for at, d in enumerate("fb"):
            u = self.p[d + "u"]
            dh = np.zeros((n, batch), np.float32)
            table = np.zeros((257, 3 * n), np.float32)
            for t, h, z, r, c, s in reversed(passes[d][1]):
                dh = (dh + down[t, at * n : (at + 1) * n]) * solid[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * s * r * (1 - r)
                g = np.concatenate([dz, dr, dc])
                np.add.at(table, x[t], g.T)
                inner = np.concatenate([dz, dr, dc * r])
                grads[d + "u"] += inner @ h.T
                dh = dh * z + u.T @ inner
            grads[d + "x"] = table.T
        return loss, grads

    def train(self, windows: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 96, rate: float = 0.02, seed: int = 0) -> None:
        """Adam over random batches; deterministic for a seed."""
        r = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            some = r.integers(0, len(windows), min(batch, 4 * len(windows)))
            _, grads = self.gradients(padded([windows[i] for i in some]), labels[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                fade = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.p[k] -= (fade * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def padded(windows: list[bytes]) -> np.ndarray:
    steps = max(1, max(map(len, windows), default=1))
    x = np.full((len(windows), steps), _PAD, np.int64)
    for i, w in enumerate(windows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    return np.ascontiguousarray(x.T)


def pooled(model: ByteGRU, data: np.ndarray, offsets: np.ndarray, window: int = 192, batch: int = 1024) -> np.ndarray:
    """Mean label probabilities over all positions of each text (zeros for empty ones).

    A text is read whole, as windows side by side; windows of like length go through the network together.
    """
    size = np.diff(offsets)
    many = -(-size // window)
    doc = np.repeat(np.arange(len(size)), many)
    start = offsets[:-1][doc] + window * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    length = np.minimum(window, offsets[1:][doc] - start)
    sums = np.zeros((len(size), model.labels))
    order = np.argsort(length, kind="stable")
    extended = np.concatenate([data, np.zeros(window, np.uint8)])
    for low in range(0, len(order), batch):
        some = order[low : low + batch]
        steps = int(length[some].max())
        x = extended[start[some][:, None] + np.arange(steps)].astype(np.int64)
        inside = np.arange(steps) < length[some][:, None]
        x[~inside] = _PAD
        x = np.ascontiguousarray(x.T)
        p = model.probabilities(x)
        if not inside.all():
            p *= inside.T[:, None, :]
        np.add.at(sums, doc[some], p.sum(0, dtype=np.float64).T)
    return sums / np.maximum(size, 1)[:, None]


def learned(docs: DataFrame, per_label: int = 400, window: int = 64, windows: int = 4, units: int = 8, steps: int = 400) -> tuple[ByteGRU | None, list[str]]:
    """A network and its labels, all that docs (doc_id, text, lang) has, as each is an output of the network.

    The training sample is bounded: per_label documents of each label, by smallest hashes of doc_id and text (repeated
    rows count once), each read whole as stretches of `window` characters. Of a label's stretches those of the smallest
    hashes are taken, one of each document first, per_label * windows in all.
    """
    hashed = F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text")
    some = docs.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", hashed.alias("h"), F.pmod(hashed, F.lit(1 << 30)).alias("draw"))
    counts = some.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return None, []
    names = sorted(x["lang"] for x in counts)
    limit = F.element_at(F.create_map(*[F.lit(v) for x in counts for v in (x["lang"], max(x["least"], int(min(1.0, (1.5 * per_label + 20) / x["n"]) * (1 << 30))))]), F.col("lang"))
    rows = some.where(F.col("draw") <= limit).groupBy("lang", "h", "draw").agg(F.first("text").alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "h"))).where(F.col("nth") <= per_label)  # about 1.5 * per_label rows of a label
    parts = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / window).cast("int"))))
    parts = parts.select("lang", "h", F.expr(f"substring(text, at * {window} + 1, {window})").alias("part"), F.xxhash64("h", "at").alias("place"))
    parts = parts.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "h").orderBy("place")))
    order = Window.partitionBy("lang").orderBy(F.when(F.col("nth") == 1, 0).otherwise(1), "place", "part")
    parts = parts.withColumn("taken", F.row_number().over(order)).where(F.col("taken") <= per_label * windows)
    rows = sorted((x["lang"], x["taken"], x["part"]) for x in parts.select("lang", "taken", "part").collect())
    model = ByteGRU(len(names), units)
    number = {name: i for i, name in enumerate(names)}
    model.train([x[2].encode() for x in rows], np.array([number[x[0]] for x in rows]), steps)
    return model, names


def identified(docs: DataFrame, folds: int = 5, **training) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of docs (doc_id, text, lang).

    The network learns from rows whose crc32(doc_id as text) mod folds is not 0 and whose lang is known; a prediction
    sees the text alone, all of it. score is the mean probability of the predicted label over all positions. Null
    texts and texts without a letter: `und`, 0; so are all texts if nothing could be learned. A null doc_id is never
    held out. Repeated rows are returned each; other columns are not read.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(lang as string) as lang", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    model, names = learned(docs.where(~held), **training)
    shared = docs.sparkSession.sparkContext.broadcast((model, names))

    def run(batches):
        model, names = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            label, score = [], []
            for i, j in runs(offsets, 1 << 20):
                part = offsets[i : j + 1]
                piece, part = data[part[0] : part[-1]], part - part[0]
                p = pooled(model, piece, part) if model else np.zeros((j - i, 1))
                best = p.argmax(1)
                for k in range(j - i):
                    letters = model is not None and _has_letter(piece[part[k] : part[k + 1]])
                    label.append(names[best[k]] if letters else "und")
                    score.append(min(1.0, float(p[k, best[k]])) if letters else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _has_letter(data: np.ndarray) -> bool:
    return bool(_LETTER[data].any()) or (bool((data >= 0x80).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace")))
