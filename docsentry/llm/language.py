"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

A text is read word by word: lower-cased, without outer marks, a blank before and after, in stretches of at most
``STRETCH`` bytes. Over the bytes of a stretch one network runs forward and one backward; from both states every position
gets a distribution over the languages. A document's probabilities are the mean over all its positions. Since words are
read on their own, a worker keeps the summed distributions of words it has met (a bounded table) and runs the network, in
numpy, for many new words at a time.

The network is trained in numpy by backpropagation through time on a bounded sample: at most ``TRAIN_DOCS`` learning
documents of each language in the order of a hash of the id, and of the distinct words of each language the first by frequency
(up to 3) and a hash, each with the languages it occurred in as soft labels: ``TRAIN_WORDS`` divided by the number of languages,
but not under ``LEAST_WORDS``, for each language. The seed fixes the weights. All languages of the learning rows are learned.

Learning rows have a non-null language and crc32(doc_id as text) mod 5 other than 0.

Defined results: a null text or one without a letter is ``und`` with score 1, and so is everything when there is nothing to
learn from (score 0); a null id is not held out; ties go to the language first in code-point order; repeated rows are
judged each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsentry.llm.common import id_check
from docsentry.session import cut_lineage

STRETCH, EMBED, HIDDEN = 24, 8, 16
TRAIN_DOCS, TRAIN_WORDS, LEAST_WORDS = 400, 60_000, 1000
EPOCHS, BATCH, RATE, SEED = 4, 512, 0.01, 3
UNKNOWN = "und"
#: Numbers kept by a worker, and numbers made at once.
_MEMO, _STEP = 3_000_000, 1 << 19
_OUTER = string.punctuation + string.digits


def normal(word: str) -> str:
    return word.strip(_OUTER).lower()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class SoftLabels:
    """Shares of the languages of many words, few of them each; rows come dense."""

    def __init__(self, rows: list[dict[int, int]], n: int) -> None:
        self.n = n
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.columns = np.fromiter((c for r in rows for c in r), np.int32, self.starts[-1])
        self.shares = np.fromiter((x / sum(r.values()) for r in rows for x in r.values()), np.float32, self.starts[-1])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), self.n), np.float32)
        for i, j in enumerate(at):
            own = slice(self.starts[j], self.starts[j + 1])
            out[i, self.columns[own]] = self.shares[own]
        return out


class Network:
    """Byte embedding, a gated recurrent layer in each direction, a distribution for each position."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray] | None = None) -> None:
        self.languages = languages
        if weights is None:
            rng = np.random.default_rng(SEED)
            draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
            weights = {"embed": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32), "out": draw(2 * HIDDEN, len(languages)), "bias": np.zeros(len(languages), np.float32)}
            for d in "fb":
                weights |= {f"x{d}": draw(EMBED, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.w = weights

    @staticmethod
    def padded(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (position, stretch) and which of them are there."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        width = int(sizes.max())
        data = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in stretches), np.uint8).reshape(len(stretches), width).T
        return data, np.arange(width)[:, None] < sizes[None, :]

    def _layer(self, d: str, inputs: np.ndarray, there: np.ndarray, keep: list | None) -> np.ndarray:
        """States after each position; a missing position leaves the state as it is, so backward stretches begin at their own end."""
        w, u = self.w[f"x{d}"], self.w[f"h{d}"]
        table = self.w["embed"] @ w + self.w[f"c{d}"]
        steps, n = inputs.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = table[inputs[t]]
            gates = _sigmoid(a[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            rh = r * h
            c = np.tanh(a[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
            m = there[t][:, None]
            new = np.where(m, h + z * (c - h), h)
            if keep is not None:
                keep.append((t, h, z, r, rh, c, m))
            h = states[t] = new
        return states

    def positions(self, stretches: list[bytes], keep: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distribution at each position and stretch, which positions are there, bytes)."""
        inputs, there = self.padded(stretches)
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        both = np.concatenate([self._layer(d, inputs, there, kept[d]) for d in "fb"], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        if keep is not None:
            keep |= {"kept": kept, "both": both, "inputs": inputs}
        return p, there, inputs

    def gradients(self, stretches: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions and its slope, back through time in both directions. ``labels``: (stretch, language)."""
        store: dict = {}
        p, there, inputs = self.positions(stretches, store)
        total = there.sum()
        loss = -(np.log(p + 1e-9) * labels[None] * there[:, :, None]).sum() / total
        dlogits = ((p - labels[None]) * there[:, :, None] / total).astype(np.float32)
        both = store["both"]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["out"] = np.einsum("tnh,tnk->hk", both, dlogits, optimize=True)
        grad["bias"] = dlogits.sum(axis=(0, 1))
        dboth = dlogits @ self.w["out"].T
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            w, u = self.w[f"x{d}"], self.w[f"h{d}"]
            table = np.zeros((256, 3 * HIDDEN), np.float32)
            dh = np.zeros((len(stretches), HIDDEN), np.float32)
            for t, h, z, r, rh, c, m in reversed(store["kept"][d]):
                dnew = dh + dboth[t][:, part]
                inner = np.where(m, dnew, 0)
                dc = inner * z * (1 - c * c)
                dz = inner * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                dh = np.where(m, inner * (1 - z), dnew) + drh * r + da[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
                grad[f"h{d}"][:, : 2 * HIDDEN] += h.T @ da[:, : 2 * HIDDEN]
                grad[f"h{d}"][:, 2 * HIDDEN :] += rh.T @ dc
                np.add.at(table, inputs[t], da)
            grad[f"x{d}"] = self.w["embed"].T @ table
            grad["embed"] += table @ w.T
            grad[f"c{d}"] = table.sum(axis=0)
        return float(loss), grad

    def train(self, stretches: list[bytes], labels: np.ndarray | SoftLabels, owners: np.ndarray | None = None, epochs: int = EPOCHS) -> float:
        """Adam over shuffled batches of stretches of like length; the last epoch's mean loss. ``owners``: row of ``labels`` of each stretch."""
        owners = np.arange(len(stretches)) if owners is None else owners
        rng = np.random.default_rng(SEED)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step, losses = 0, []
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        for epoch in range(epochs):
            order = np.argsort(sizes + rng.random(len(sizes)) * 3, kind="stable")
            starts = rng.permutation(np.arange(0, len(order), BATCH))
            losses = []
            for s in starts:
                some = order[s : s + BATCH]
                loss, grad = self.gradients([stretches[i] for i in some], labels[owners[some]])
                losses.append(loss)
                step += 1
                rate = RATE * (0.5**epoch)
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses)) if losses else 0.0


def stretches_of(word: str) -> list[bytes]:
    raw = f" {word} ".encode("utf-8", "surrogatepass")
    return [raw[i : i + STRETCH] for i in range(0, len(raw), STRETCH)]


class Reader:
    """Summed position distributions of texts, with those of known words kept."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.k = len(network.languages)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, self.k + 1), np.float32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        """Rows of ``sums`` for new words: distributions summed over positions, and the number of positions."""
        owner, parts = [], []
        need = self.used + len(words)
        if need > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(need, 2 * len(self.sums)) - len(self.sums), self.k + 1), np.float32)])
        for i, word in enumerate(words):
            self.place[word] = self.used + i
            bare = normal(word)
            if any(c.isalpha() for c in bare):
                for part in stretches_of(bare):
                    owner.append(self.used + i)
                    parts.append(part)
        self.sums[self.used : need] = 0
        self.used = need
        order = sorted(range(len(parts)), key=lambda j: len(parts[j]))
        most = min(4096, max(64, _STEP // self.k))
        for at in range(0, len(order), most):
            some = order[at : at + most]
            p, there, _ = self.network.positions([parts[j] for j in some])
            got = np.concatenate([(p * there[:, :, None]).sum(axis=0), there.sum(axis=0)[:, None]], axis=1)
            np.add.at(self.sums, [owner[j] for j in some], got)

    def probabilities(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Mean distribution over the positions of each text; None where it has no letter."""
        cut = [t.split() if t else [] for t in texts]
        every = set().union(*cut)
        new = every.difference(self.place)
        if self.used + len(new) > max(10_000, _MEMO // (self.k + 1)):
            self._forget()
            new = every
        self._learn(list(new))
        out: list[np.ndarray | None] = []
        for words in cut:
            total = self.sums[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64) if words else np.zeros(self.k + 1)
            out.append(total[:-1] / total[-1] if total[-1] > 0 else None)
        return out


def training_words(docs: DataFrame) -> tuple[list[str], list[str], SoftLabels]:
    """(languages, words, soft labels) of the bounded sample described above."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(id_check("doc_id") % 5, F.lit(1)) != 0))
    sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    if not sizes:
        return [], [], SoftLabels([], 0)
    # a hash of the id under a level that differs by language admits about TRAIN_DOCS documents of each
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1 << 30))
    levels = docs.sparkSession.createDataFrame([(lang, min(1 << 30, (TRAIN_DOCS << 30) // n)) for lang, n in sizes], "lang string, level long")
    some = known.join(F.broadcast(levels), "lang").filter(draw < F.col("level"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {normal(w) for w in text.split()}
                own = [w for w in own if any(c.isalpha() for c in w)]
                found += own
                langs += [lang] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    counts = cut_lineage(some.select("lang", "text").mapInArrow(words, "lang string, word string").groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.least("n", F.lit(3))), F.xxhash64("word"), "word"))
    most = max(LEAST_WORDS, TRAIN_WORDS // len(sizes))
    taken = counts.select("word", place.alias("place")).filter(F.col("place") <= most).select("word").distinct()
    per_word = counts.join(taken, "word").groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    rows = per_word.orderBy(F.xxhash64("word"), "word").collect()
    langs = [lang for lang, _ in sizes]
    at = {lang: i for i, lang in enumerate(langs)}
    return langs, [r["word"] for r in rows], SoftLabels([{at[x["lang"]]: x["n"] for x in r["by"]} for r in rows], len(langs))


def trained(docs: DataFrame) -> Network | None:
    langs, words, labels = training_words(docs)
    if not words:
        return None
    parts, rows = [], []
    for i, w in enumerate(words):
        for part in stretches_of(w):
            parts.append(part)
            rows.append(i)
    network = Network(langs)
    network.train(parts, labels, np.array(rows))
    return network


def predicted(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = (network.languages, network.w) if network else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Network(*model)) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                found = reader.probabilities(texts) if reader else [None] * len(texts)
                names, scores = [], []
                for text, p in zip(texts, found, strict=True):
                    if p is None:  # no letter to judge by, or nothing learned
                        names.append(UNKNOWN)
                        scores.append(1.0 if model or not text else 0.0)
                    else:
                        best = int(p.argmax())
                        names.append(reader.network.languages[best])
                        scores.append(float(min(1.0, p[best])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the learning rows of ``docs``, applied to all of them."""
    out = predicted(docs, trained(docs))
    return out.select("doc_id", (F.coalesce(id_check("doc_id") % 5, F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")
