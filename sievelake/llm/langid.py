"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are cut into windows of WINDOW bytes (ASCII capitals lowered). Inside each window a forward and a backward GRU read the bytes;
at every byte a linear layer on both states gives the language's log odds. Byte probabilities are pooled over the
letters of the whole document (ASCII letters and bytes beyond ASCII). Training is backpropagation through time with
Adam, on all windows of the whole texts of a bounded sample of labelled documents; nothing but the text reaches the network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import crc_mod, light, small_batches

#: Bytes of a window, states in each direction, and windows that are run side by side.
WINDOW, HIDDEN, SIDE = 64, 8, 1024
#: Training: labelled documents at most for each language (their whole texts are read), languages at most, passes, windows of a step.
SAMPLE, LANGUAGES, PASSES, STEP = 64, 500, 5, 128
UNKNOWN = "und"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LETTER = np.zeros(256, np.float32)
_LETTER[97:123] = _LETTER[128:] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Both directions (index 0 forward, 1 backward): byte tables e (256, 3H), recurrent u (H, 3H); output w (2H, L), b (L)."""

    langs: list[str]
    e: list[np.ndarray]
    u: list[np.ndarray]
    w: np.ndarray
    b: np.ndarray

    @staticmethod
    def new(langs: list[str], seed: int = 5, h: int = HIDDEN) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 0.3, s)
        return Network(langs, [draw(256, 3 * h) for _ in range(2)], [draw(h, 3 * h) for _ in range(2)], draw(2 * h, len(langs)), np.zeros(len(langs)))

    def params(self) -> list[np.ndarray]:
        return [*self.e, *self.u, self.w, self.b]

    # Training keeps every state; windows are rows here.
    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over weighted positions and its gradients; x (B, T) bytes, y (B,) languages, weight (B, T)."""
        n, t = x.shape
        h = self.u[0].shape[0]
        states = np.zeros((2, t + 1, n, h))
        kept: list[list] = [[None] * t, [None] * t]
        for way in (0, 1):
            s = states[way, 0]
            for k in range(t):
                at = k if way == 0 else t - 1 - k
                ex, su = self.e[way][x[:, at]], s @ self.u[way]
                r, z = _sigmoid(ex[:, :h] + su[:, :h]), _sigmoid(ex[:, h : 2 * h] + su[:, h : 2 * h])
                c = np.tanh(ex[:, 2 * h :] + r * su[:, 2 * h :])
                kept[way][k] = (at, s, su[:, 2 * h :], r, z, c)
                s = states[way, k + 1] = (1 - z) * c + z * s
        both = np.concatenate([states[0, 1:], states[1, 1:][::-1]], 2)
        logits = both @ self.w + self.b
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        own = weight.T[..., None] / max(weight.sum(), 1e-9)
        picked = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (t, n, 1)), 2)
        loss = float(-(np.log(picked + 1e-12) * own).sum())
        d = p.copy()
        np.put_along_axis(d, np.broadcast_to(y[None, :, None], (t, n, 1)), picked - 1, 2)
        d *= own
        gw, gb = np.einsum("tnh,tnl->hl", both, d), d.sum((0, 1))
        back = d @ self.w.T
        ge, gu = [np.zeros_like(a) for a in self.e], [np.zeros_like(a) for a in self.u]
        for way in (0, 1):
            carry = np.zeros((n, h))
            for k in range(t - 1, -1, -1):
                at, s, sc, r, z, c = kept[way][k]
                g = carry + back[at][:, way * h : (way + 1) * h]
                dc = g * (1 - z) * (1 - c * c)
                dz = g * (s - c) * z * (1 - z)
                dr = dc * sc * r * (1 - r)
                pre = np.concatenate([dr, dz, dc], 1)
                np.add.at(ge[way], x[:, at], pre)
                rec = np.concatenate([dr, dz, dc * r], 1)
                gu[way] += s.T @ rec
                carry = g * z + rec @ self.u[way].T
        return loss, [*ge, *gu, gw, gb]

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, batch: int = STEP, rate: float = 0.03, seed: int = 9) -> float:
        """Adam with a falling rate; returns the mean loss of the last pass."""
        rng = np.random.default_rng(seed)
        params = self.params()
        m, v = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
        weight = _LETTER[x].astype(float)
        step, last, steps = 0, [], max(1, passes * -(-len(x) // batch))
        for _ in range(passes):
            last = []
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                loss, grads = self.loss_and_gradients(x[rows], y[rows], weight[rows])
                last.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                now = rate * (1 - step / (steps + 1))
                for a, g, mm, vv in zip(params, grads, m, v):
                    g = g * min(1, 1 / (norm + 1e-9))
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    a -= now * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(last)) if last else 0.0

    def ready(self) -> Runner:
        return Runner(self)


class Runner:
    """The network for inference: features in rows, windows in columns, single precision.

    Gates are halved in the weights, since sigmoid(x) = (tanh(x / 2) + 1) / 2: one tanh serves both.
    """

    def __init__(self, net: Network):
        h = net.u[0].shape[0]
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)])
        self.h, self.langs = h, net.langs
        self.e = [np.ascontiguousarray(a * half, np.float32) for a in net.e]
        self.u = [np.ascontiguousarray((a * half).T, np.float32) for a in net.u]
        self.w = [np.ascontiguousarray(net.w[k * h : (k + 1) * h].T, np.float32) for k in (0, 1)]
        self.b = net.b.astype(np.float32)[:, None]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, L, B) at every byte of the windows x (T, B)."""
        t, n = x.shape
        h, out = self.h, None
        for way in (0, 1):
            s = np.zeros((h, n), np.float32)
            e, u, w = self.e[way], self.u[way], self.w[way]
            logits = np.empty((t, len(self.langs), n), np.float32)
            for k in range(t) if way == 0 else range(t - 1, -1, -1):
                g = e.take(x[k], 0).T
                su = u @ s
                rz = np.tanh(g[: 2 * h] + su[: 2 * h])
                rz += 1
                rz *= 0.5
                c = np.tanh(g[2 * h :] + rz[:h] * su[2 * h :])
                s = c + rz[h:] * (s - c)
                np.matmul(w, s, out=logits[k])
            out = logits if out is None else np.add(out, logits, out=out)
        out += self.b
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (documents, L), each over the letters of the whole text; uniform where there are none."""
        sizes = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        flat = np.frombuffer(b"".join([t + b"\0" * (-len(t) % WINDOW) for t in texts]).translate(_LOWER), np.uint8).reshape(-1, WINDOW)
        total, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for i in range(0, len(flat), SIDE):
            x = np.ascontiguousarray(flat[i : i + SIDE].T)
            letters = _LETTER[x]
            p = np.einsum("tlb,tb->bl", self.positions(x), letters)
            own = owner[i : i + SIDE]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[first]] += np.add.reduceat(p, first, 0)
            seen[own[first]] += np.add.reduceat(letters.sum(0), first)
        return (total + 1e-9) / (seen + 1e-9 * len(self.langs))[:, None]


def training_windows(text: bytes) -> np.ndarray:
    """All windows of a text, as they are cut for inference."""
    return np.frombuffer((text + b"\0" * (-len(text) % WINDOW)).translate(_LOWER), np.uint8).reshape(-1, WINDOW)


def sample(docs: DataFrame, per_lang: int = SAMPLE, languages: int = LANGUAGES) -> list[Row]:
    """Rows (lang, text) that may teach (crc32(doc_id) mod 5 not 0; lang and text not null): at most ``per_lang`` whole texts of each language.

    Of each language and each of ``per_lang`` cells of a hash of id and text, the row of smallest hash; so reruns agree, also where ids repeat.
    More than ``languages`` languages are refused with an error: a column with so many values holds no languages.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 5) != 0))
    rows = rows.select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(3)).alias("_h"), "text")
    cells = rows.groupBy("lang", F.pmod("_h", F.lit(per_lang)).alias("_c")).agg(F.min("_h").alias("_h")).select("lang", "_h").limit(languages * per_lang + 1).collect()
    if len({r["lang"] for r in cells}) > languages or len(cells) > languages * per_lang:
        raise ValueError(f"the column lang has more than {languages} values")
    if not cells:
        return []
    wanted = docs.sparkSession.createDataFrame([(r["lang"], r["_h"]) for r in cells], "_l string, _g long")  # bounded by both parameters
    picked = rows.join(F.broadcast(wanted), (F.col("lang") == F.col("_l")) & (F.col("_h") == F.col("_g")))
    return picked.groupBy("lang", "_h").agg(F.min("text").alias("text")).collect()


def learn(docs: DataFrame, per_lang: int = SAMPLE) -> Network | None:
    """A network from ``sample``; None without any row. Languages weigh alike: those with fewer windows repeat theirs."""
    found = sorted(sample(docs, per_lang), key=lambda r: (r["lang"], r["_h"]))
    langs = sorted({r["lang"] for r in found})
    texts = [training_windows(r["text"].encode("utf-8", "replace")) for r in found]
    if not sum(map(len, texts)):
        return Network.new(langs) if langs else None
    x, y = np.concatenate(texts), np.repeat([langs.index(r["lang"]) for r in found], list(map(len, texts)))
    most = np.bincount(y, minlength=len(langs)).max()
    rows = np.concatenate([np.resize(own, most) for k in range(len(langs)) if len(own := np.flatnonzero(y == k))])
    net = Network.new(langs)
    net.train(x[rows], y[rows])
    return net


def _predict(run: Runner | None, has_letter, texts: list[str | None]) -> tuple[list[str], list[float]]:
    ok = [i for i, t in enumerate(texts) if t and has_letter(t)]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if run is None or not ok:
        return langs, scores
    p = run.documents([texts[i].encode("utf-8", "replace") for i in ok])
    for i, k, s in zip(ok, p.argmax(1), p.max(1)):
        langs[i], scores[i] = run.langs[k], min(1.0, float(s))
    return langs, scores


def with_language(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score``, one row per row of ``docs``; null or letterless texts: ``und`` and 0.

    Columns to keep must not have the names of the two made; names used on the way don't matter.
    """
    if clash := {c.lower() for c in keep} & {"lang_pred", "score"}:
        raise ValueError(f"columns to keep have names of columns to make: {sorted(clash)}")
    small_batches(docs.sparkSession)
    run = net.ready() if net else None
    own = [f"k{i}" for i in range(len(keep))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        has_letter = regex.compile(r"\p{L}").search
        for batch in light(batches, "_text"):
            langs, scores = _predict(run, has_letter, batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.select(own).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])

    kinds = [f"{o} {docs.schema[c].dataType.simpleString()}" for o, c in zip(own, keep)]
    kept = docs.select(*[F.col(c).alias(o) for o, c in zip(own, keep)], F.col("text").alias("_text"))
    return kept.mapInArrow(work, ", ".join([*kinds, "lang_pred string, score double"])).select(*[F.col(o).alias(c) for o, c in zip(own, keep)], "lang_pred", "score")


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language digest of ``documents``, learnt from its own training rows.

    Without a single training row every text is ``und``. Repeated rows and null ids give one row each (a null id is held out).
    """
    found = with_language(docs, learn(docs), ["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_sure(docs: DataFrame, times: float = 1.4) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a pooled probability of ``times`` / L or more; the columns are those of ``docs``.

    L is the number of learnt languages, so the bound is ``times`` the probability of a guess: 0.35 of four, 0.7 of two. With one
    there is nothing to decide between, and all texts with letters stay. What goes has no letters, or is as good as undecided
    between the languages. Clean texts of a few words that two of four languages share stay.
    """
    small_batches(docs.sparkSession)
    net = learn(docs)
    run = net.ready() if net else None
    least = times / len(net.langs) if net and len(net.langs) > 1 else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        has_letter = regex.compile(r"\p{L}").search
        for batch in light(batches, "text"):
            langs, scores = _predict(run, has_letter, batch.column("text").to_pylist())
            yield batch.filter(pa.array([a != UNKNOWN and s >= least for a, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
