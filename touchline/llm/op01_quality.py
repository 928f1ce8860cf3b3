"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and convolved with learned filters over windows of ``WIDTH`` bytes at every ``STEP``; activations
are averaged within chunks of ``CHUNK`` bytes that overlap by half and cover the whole text, and each filter's mean and maximum over
the chunks feed one logistic unit. Training takes a bounded sample of labelled rows (``TRAIN_ROWS`` of each label, the smallest by hash of the
id) with their whole texts; tasks go over slices of it and the driver averages their weights after each of ``ROUNDS``. Scoring runs over every byte of every
document inside Spark tasks, which get only the weights (a few kB).

Edge cases: a null or empty text is scored as one chunk of padding. A text longer than ``PASS_BYTES`` is pooled over passes, in training as in
scoring, with the result of one pass. Labels that are null, or for documents not in the table, are not used; a label that is repeated counts
once, and both labels of a document count if they differ. Of training rows that repeat a doc_id the one whose text hashes lowest is used. Equal hashes of
ids are taken in the order of the ids. With no labelled rows of one kind the score is the (smoothed) share of label 1. Repeated rows are scored
alike. An empty table gives no rows. :func:`score` and :func:`keep_good` keep all other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from touchline.llm.common import discard, free_names, held_out, labelled_sample, stored, table, text_bytes

EMBED, FILTERS, WIDTH, STEP, CHUNK = 8, 24, 8, 4, 256
HALF = CHUNK // 2
#: At most so many labelled rows of each label are drawn for training.
TRAIN_ROWS = 900
#: Bytes of training text that one task goes over.
SLICE_BYTES = 8 << 20
#: Rounds after each of which the slices' weights are averaged, and epochs within a round.
ROUNDS, EPOCHS = 4, 3
RATE, BATCH = 0.01, 24
THRESHOLD = 0.3
#: Bytes that one numpy pass takes; longer runs of texts are taken in turn.
PASS_BYTES = 1 << 20


def initial_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "conv": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each padded to whole half chunks and followed by one half chunk of zeros; and each text's first half chunk."""
    halves = np.array([max(1, -(-len(t) // HALF)) + 1 for t in texts])
    starts = np.cumsum(halves) - halves
    flat = np.frombuffer(b"".join(t.ljust(int(n) * HALF, b"\0") for t, n in zip(texts, halves, strict=True)), np.uint8)
    return flat, starts


def activations(flat: np.ndarray, starts: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Embedded bytes in rows of STEP, and the rectified filters at every STEP bytes; windows that would reach into the next text are zero."""
    rows = w["embed"][flat].reshape(-1, STEP * EMBED)
    at = rows @ w["conv"][: STEP * EMBED]
    for k in range(1, WIDTH // STEP):
        at[:-k] += rows[k:] @ w["conv"][k * STEP * EMBED : (k + 1) * STEP * EMBED]
    at += w["shift"]
    ends = np.append(starts[1:] * (HALF // STEP), len(at))
    for k in range(1, WIDTH // STEP):
        at[ends - k] = 0
    return rows, np.maximum(at, 0, out=at)


def chunk_means(at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean activations of each chunk (half a chunk and the next half), and each text's first chunk."""
    per_half = at.reshape(-1, HALF // STEP, FILTERS).mean(axis=1)
    last = np.append(starts[1:], len(per_half)) - 1
    chunks = (per_half[:-1] + per_half[1:]) / 2
    keep = np.ones(len(per_half), bool)
    keep[last] = False  # a chunk would reach over into the next text
    return chunks[keep[:-1]], starts - np.arange(len(starts))


def forward(texts: list[bytes], w: dict) -> tuple[np.ndarray, tuple]:
    flat, starts = lay_out(texts)
    rows, at = activations(flat, starts, w)
    chunks, firsts = chunk_means(at, starts)
    counts = np.diff(np.append(firsts, len(chunks)))
    features = np.concatenate([np.add.reduceat(chunks, firsts) / counts[:, None], np.maximum.reduceat(chunks, firsts)], 1)
    logit = features @ w["out"] + w["bias"]
    return logit, (flat, starts, rows, at, chunks, firsts, counts, features)


def _back(flat: np.ndarray, rows: np.ndarray, at: np.ndarray, d_half: np.ndarray, w: dict) -> dict:
    """Gradients of filters and embedding from those of the half chunks' means."""
    d_at = np.repeat(d_half / (HALF // STEP), HALF // STEP, axis=0) * (at > 0)
    d_conv, d_rows = np.empty_like(w["conv"]), d_at @ w["conv"][: STEP * EMBED].T
    d_conv[: STEP * EMBED] = rows.T @ d_at
    for k in range(1, WIDTH // STEP):
        part = slice(k * STEP * EMBED, (k + 1) * STEP * EMBED)
        d_conv[part] = rows[k:].T @ d_at[:-k]
        d_rows[k:] += d_at[:-k] @ w["conv"][part].T
    d_bytes = d_rows.reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(flat, d_bytes[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
    return {"embed": d_embed, "conv": d_conv, "shift": d_at.sum(0)}


def gradients(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, w: dict) -> dict:
    """Of the weighted mean cross-entropy."""
    logit, (flat, starts, rows, at, chunks, firsts, counts, features) = forward(texts, w)
    error = ((1 / (1 + np.exp(-logit)) - labels) * weights / len(labels)).astype(np.float32)
    down = error[:, None] * w["out"]
    owner = np.repeat(np.arange(len(firsts)), counts)
    is_top = chunks == features[owner, FILTERS:]
    ties = np.add.reduceat(is_top.astype(np.float32), firsts)
    d_chunk = (down[:, :FILTERS] / counts[:, None])[owner] + is_top * (down[:, FILTERS:] / ties)[owner]
    d_half = np.zeros((len(at) * STEP // HALF, FILTERS), np.float32)
    place = np.arange(len(chunks)) + owner
    d_half[place] += d_chunk / 2
    d_half[place + 1] += d_chunk / 2
    return _back(flat, rows, at, d_half, w) | {"out": features.T @ error, "bias": error.sum(keepdims=True)}


def _pieces(text: bytes, w: dict) -> Iterator[tuple]:
    """A long text in passes that overlap by a chunk: what :func:`activations` gives of each, and the chunks that are its own."""
    halves = -(-len(text) // HALF)
    step = PASS_BYTES // HALF
    for at in range(0, halves, step):
        flat, starts = lay_out([text[at * HALF : (at + step + 2) * HALF]])
        rows, on = activations(flat, starts, w)
        yield flat, rows, on, chunk_means(on, starts)[0][: min(step, halves - at)]


def _long_features(text: bytes, w: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of one long text, how many chunks have each maximum, and how many chunks there are."""
    total, top, ties, n = np.zeros(FILTERS), np.full(FILTERS, -np.inf), np.zeros(FILTERS), 0
    for *_, own in _pieces(text, w):
        most = own.max(0)
        here = (own == most).sum(0)
        ties = np.where(most > top, here, ties + here * (most == top))
        total, top, n = total + own.sum(0), np.maximum(top, most), n + len(own)
    return np.concatenate([total / n, top]), ties, n


def _long_gradients(text: bytes, label: float, weight: float, w: dict) -> dict:
    """As :func:`gradients` of the one text; what exists at once is one pass."""
    features, ties, n = _long_features(text, w)
    error = np.float32((1 / (1 + np.exp(-(features @ w["out"] + w["bias"][0]))) - label) * weight)
    down, out = error * w["out"], {k: np.zeros_like(w[k]) for k in ("embed", "conv", "shift")}
    for flat, rows, at, own in _pieces(text, w):
        d_chunk = down[:FILTERS] / n + (own == features[FILTERS:]) * (down[FILTERS:] / ties)
        d_half = np.zeros((len(at) * STEP // HALF, FILTERS), np.float32)
        d_half[: len(own)] += d_chunk / 2
        d_half[1 : len(own) + 1] += d_chunk / 2
        for k, g in _back(flat, rows, at, d_half, w).items():
            out[k] += g
    return out | {"out": (features * error).astype(np.float32), "bias": np.array([error])}


def _passes(texts: list[bytes]) -> Iterator[list[int]]:
    """Numbers of texts that together have some PASS_BYTES; a longer one comes alone."""
    own, size = [], 0
    for i, text in enumerate(texts):
        if own and size + len(text) > PASS_BYTES:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(text) + CHUNK
    if own:
        yield own


def batch_gradients(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, w: dict) -> dict:
    """Gradients of the mean over all the texts, in bounded passes."""
    total = {k: np.zeros(v.shape) for k, v in w.items()}
    for own in _passes(texts):
        one = len(own) == 1 and len(texts[own[0]]) > PASS_BYTES
        part = _long_gradients(texts[own[0]], labels[own[0]], weights[own[0]], w) if one else gradients([texts[i] for i in own], labels[own], weights[own], w)
        for k, g in part.items():
            total[k] += g * (len(own) / len(texts))
    return total


@dataclass
class State:
    """Weights with Adam's moments and steps, as they go to the tasks and come back."""

    w: dict
    first: dict
    second: dict
    steps: int = 0

    @classmethod
    def start(cls, w: dict) -> State:
        return cls(w, {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()})

    def step(self, gradients: dict, rate: float) -> None:
        self.steps += 1
        for k, g in gradients.items():
            g = g + 1e-4 * self.w[k] * (k in ("conv", "out"))
            self.first[k] = (self.first[k] + 0.1 * (g - self.first[k])).astype(np.float32)
            self.second[k] = (self.second[k] + 0.01 * (g * g - self.second[k])).astype(np.float32)
            self.w[k] = (self.w[k] - rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([part[k].ravel() for part in (self.w, self.first, self.second) for k in sorted(part)]).astype(np.float32)

    def filled(self, values: np.ndarray, steps: int) -> State:
        """A state of the same shapes with other values."""
        out, at = [], 0
        for part in (self.w, self.first, self.second):
            out.append({})
            for k in sorted(part):
                out[-1][k] = values[at : at + part[k].size].reshape(part[k].shape).astype(np.float32)
                at += part[k].size
        return State(*out, steps)


def epoch_of(state: State, texts: list[bytes], labels: np.ndarray, balance: np.ndarray, epoch: int, seed: int) -> State:
    """One pass over the texts in batches of random order."""
    state = state.filled(state.flat(), state.steps)
    order = np.random.default_rng([seed, epoch]).permutation(len(texts))
    rate = RATE * (1 - epoch / (ROUNDS * EPOCHS)) + 1e-4
    for at in range(0, len(order), BATCH):
        pick = order[at : at + BATCH]
        state.step(batch_gradients([texts[i] for i in pick], labels[pick], balance[pick], state.w), rate)
    return state


def score_texts(texts: list[bytes], w: dict) -> np.ndarray:
    """Probabilities; a text longer than PASS_BYTES is pooled over passes, which gives what one pass would."""
    out = np.zeros(len(texts))
    for own in _passes(texts):
        if len(own) == 1 and len(texts[own[0]]) > PASS_BYTES:
            out[own] = _long_features(texts[own[0]], w)[0] @ w["out"] + w["bias"][0]
        else:
            out[own] = forward([texts[i] for i in own], w)[0]
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(sample: DataFrame, seed: int = 1, slice_bytes: int = SLICE_BYTES) -> dict[str, np.ndarray]:
    """Weights from sample (text as bytes, label, order): every text whole in every epoch.

    The sample is dealt into slices of some ``slice_bytes``. In each round a task a slice goes over its texts ``EPOCHS`` times, starting from the common
    state, and the driver averages the states (a few kB each), weighted by the slices' rows.
    """
    size = sample.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n"), F.sum("label").alias("n1")).first()
    n, n1, w = size.n, size.n1 or 0, initial_weights(seed)
    if not 0 < n1 < n:
        share = (n1 + 1) / (n + 2)
        w["out"][:] = 0
        w["bias"][:] = np.log(share / (1 - share))
        return w
    slices = max(1, -(-size.bytes // slice_bytes))
    # A given number of partitions, as adaptive execution would put small slices into one task.
    dealt = sample.select("text", "label", "order", F.pmod(F.xxhash64("order"), F.lit(slices)).cast("int").alias("slice")).repartition(4 * slices, "slice")
    state = State.start(w)

    def step(state: State, first: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("order", "ascending"), ("label", "ascending")])
            y = rows.column("label").to_numpy().astype(np.float32)
            balance = np.where(y == 1, 0.5 * n / n1, 0.5 * n / (n - n1))
            texts, got = rows.column("text").to_pylist(), state
            for epoch in range(first, first + EPOCHS):
                got = epoch_of(got, texts, y, balance, epoch, seed + key[0].as_py())
            return pa.table({"n": [len(y)], "steps": [got.steps], "state": [got.flat().tobytes()]}, schema=pa.schema([("n", pa.int64()), ("steps", pa.int64()), ("state", pa.binary())]))

        return run

    for k in range(ROUNDS):
        parts = dealt.groupBy("slice").applyInArrow(step(state, k * EPOCHS), "n long, steps long, state binary").collect()  # one row a slice
        state = state.filled(sum(p.n / n * np.frombuffer(p.state, np.float32).astype(float) for p in sorted(parts)), max(p.steps for p in parts))
    return state.w


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    paths: list[str] = []
    sample = labelled_sample(docs, labels, target, rows, 11).select(F.col("text").cast("binary").alias("text"), "label", "order")
    weights = train(stored(sample, paths))
    discard(docs.sparkSession, paths)
    return weights


def score(docs: DataFrame, weights: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (as ``name``, with underscores behind it where a column of ``docs`` has it); it is the last column."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    name, body = free_names(docs, name, "__bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = score_texts([t.as_py() or b"" for t in part.column(part.num_columns - 1)], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got)], names=[*part.schema.names[:-1], name])

    schema = StructType([*docs.schema.fields]).add(name, DoubleType())
    return docs.withColumn(body, text_bytes()).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    scored = score(docs, fit(docs, labels))
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels)
    ids = docs.select("doc_id", "text")
    shared = score(ids, weights)
    return shared.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
