"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class given the text before it, times that of its part of the class given the class and the text before it, times
that of the word within its part. Classes: the end of a text, the ``HEADS`` most frequent words, and buckets of the other words by their first
letters; a hash of the word deals a class into ``PARTS``. The class softmax sums one weight row for each feature of the context: class n-grams, the
same with the nearest words skipped, and hashed rows for the last word and the last two words. The softmax over the parts of a class sums rows for the class
with the last class, the last word and the word before it. Within a part, words have their training frequencies less ``DISCOUNT``, and what that
frees in a class goes to its one unknown word, which belongs to no part.

Weights start at the smoothed log-odds of each feature's counts over all training documents. Then each of ``ROUNDS`` takes the next
``1 / SHARES`` of the training documents, and ``ROUNDS`` is a multiple of ``SHARES``, so that all of them are learnt from alike: tasks sum the gradient (observed less expected counts of each row) over their
documents, a tree of groupings sums these, and the driver, which holds only the table, steps along the gradient
scaled by the expected counts. The hashed rows of a feature grow with the square root of the training tokens (``hashed_rows``), so the table
stays a small part of the corpus; contexts of two words outnumber them on a large corpus and share rows.

Word counts never meet in one place. Texts are dealt into blocks by hash; each block sends its distinct words' counts to
the words' hashes, and gets back the totals of those that other blocks have too. Words are told apart by 64-bit hashes.

Edge cases: a null or empty text is its end alone. A very long text is scored in runs of tokens, as part of its block. Among equally frequent words
those of the least hash are the most frequent. Repeated rows count once each. A null doc_id is a training row. With no training
rows all words are unknown. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh32_intdigest

from touchline.llm.common import block_count, block_of, held_out, stored, table, text_bytes

CLASSES, HEADS, PARTS = 32, 7, 32
#: The least rows of each hashed feature.
HASHED = 2048
PAIRS = CLASSES * CLASSES
#: Rows of the smallest table: class pairs at distances (1, 2), (2, 3) and (3, 4); the last word; the last two words.
ROWS = 3 * PAIRS + 2 * HASHED
FEATURES, PART_FEATURES = 5, 3
DISCOUNT, PRIOR = 0.5, 20.0
#: Weight of a part that no training word is in.
EMPTY = -30.0
ROUNDS, SHARES, STEP = 4, 4, 0.35
BLOCK_BYTES = 6 << 20
PASS = 1 << 14
#: Tokens whose weights are held at once: they fit into a core's cache.
NEAR = 1 << 12
#: Cells of the table that are summed apart, and the most sums that one group adds up.
CHUNK_CELLS, FAN_IN = 1 << 16, 64
END = b"\n"
TEST_REMAINDER = 1


def word_hash(word: bytes) -> int:
    return xxh3_64_intdigest(word) - (1 << 63)


def letter_class(word: bytes) -> int:
    """The class of a word that is not among the most frequent: 0 for the end of a text, else a bucket."""
    if word == END:
        return 0
    return 1 + HEADS + xxh32_intdigest(word[:2]) % (CLASSES - 1 - HEADS)


class Initials(dict):
    """First two bytes -> class, so that a class is worked out once for each of at most 65,792 initials."""

    def __missing__(self, initial: bytes) -> int:
        self[initial] = letter_class(initial)
        return self[initial]


_INITIALS = Initials()


class Words:
    """The distinct words of some texts by their numbers; the first is the end of a text."""

    def __init__(self):
        self.known = [END]

    def __len__(self) -> int:
        return len(self.known)

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.known)

    def __getitem__(self, word: bytes) -> int:
        return self.known.index(word)


def tokens_of(texts: pa.Array | pa.ChunkedArray | list[bytes | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with its end; and where each text starts. ``words`` is new and gets the texts' words."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())]
    whole = pa.concat_arrays([pa.array([], pa.large_binary()), *(pc.fill_null(c.cast(pa.large_binary()), b"") for c in chunks)])  # a copy, so that it starts at 0
    n = len(whole)
    # The functions go by bytes, so it does not matter whether these are valid UTF-8.
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.large_string(), n, whole.buffers())))
    found = split.flatten().dictionary_encode()
    known = found.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    flat, edges = found.indices.to_numpy().astype(np.int64) + 1, split.offsets.to_numpy()
    if b"" in known:  # before the first white space of a text and after the last
        empty = known.index(b"")
        del known[empty]
        some = flat != empty + 1
        edges = np.append(0, np.cumsum(some))[edges]
        flat = flat[some]
        flat -= flat > empty
    words.known += known
    place = np.arange(n + 1)
    tokens = np.zeros(len(flat) + n, np.int64)
    tokens[np.arange(len(flat)) + np.repeat(place[:-1], np.diff(edges))] = flat
    return tokens, (edges + place)[:-1].astype(np.int64)


def part_of(word_hashes: np.ndarray) -> np.ndarray:
    """The part of its class that a word belongs to."""
    return (word_hashes.view(np.uint64) >> np.uint64(7)).astype(np.int64) % PARTS


@dataclass
class Traits:
    """Hash, class and leaf (class and part) by word number; the end and the most frequent words are alone in their classes."""

    hashes: np.ndarray
    classes: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return self.classes * PARTS + np.where(self.classes > HEADS, part_of(self.hashes), 0)


def traits(words: Words, heads: dict[int, int]) -> Traits:
    # The same as word_hash of each: taking 2 ** 63 away is flipping the highest bit.
    hashes = (np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)
    classes = np.fromiter(map(_INITIALS.__getitem__, [w[:2] for w in words]), np.int64, len(words))
    for h, k in heads.items():
        classes[hashes == h] = k
    return Traits(hashes, classes)


def hashed_rows(tokens: int) -> int:
    """Rows of each hashed feature for so many training tokens: the next power of two of their square root."""
    return max(HASHED, 1 << math.isqrt(max(0, tokens - 1)).bit_length())


def table_rows(hashed: int) -> int:
    return 3 * PAIRS + 2 * hashed


def part_rows(hashed: int) -> int:
    """Rows of the second softmax; its first ones are one for each class as a whole."""
    return CLASSES + PAIRS + 2 * hashed


def feature_rows(tokens: np.ndarray, starts: np.ndarray, own: Traits, end: int, hashed: int = HASHED) -> tuple[np.ndarray, np.ndarray]:
    """(FEATURES, tokens) and (PART_FEATURES, tokens): the table rows of each token's context for either softmax; before a text stand ends."""
    n = len(tokens)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    back = [tokens]
    for k in range(1, 5):
        shifted = np.full(n, end, np.int64)
        shifted[k:] = tokens[:-k] if k < n else tokens[:0]
        shifted[place < k] = end
        back.append(shifted)
    c = [own.classes[b] for b in back]
    h1, h2 = (own.hashes[back[k]].view(np.uint64) for k in (1, 2))
    last = (h1 >> np.uint64(20)) % np.uint64(hashed)
    both = ((h1 * np.uint64(0x9E3779B97F4A7C15) + h2 * np.uint64(0xD1342543DE82EF95)) >> np.uint64(24)) % np.uint64(hashed)
    rows = np.stack([c[1] * CLASSES + c[2], PAIRS + c[2] * CLASSES + c[3], 2 * PAIRS + c[3] * CLASSES + c[4], 3 * PAIRS + last.astype(np.int64), 3 * PAIRS + hashed + both.astype(np.int64)])
    mine = c[0].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    near, far = (((h ^ mine) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(hashed) for h in (h1, h2))
    first = CLASSES + PAIRS
    return rows, np.stack([CLASSES + c[0] * CLASSES + c[1], first + near.astype(np.int64), first + hashed + far.astype(np.int64)])


@dataclass
class Model:
    heads: dict[int, int]
    bias: np.ndarray
    table: np.ndarray
    parts: np.ndarray
    leaf_tokens: np.ndarray
    leaf_words: np.ndarray
    tokens: int
    words: int

    @property
    def hashed(self) -> int:
        return (len(self.table) - 3 * PAIRS) // 2

    def class_weights(self, rows: np.ndarray) -> np.ndarray:
        """Class probabilities before they are made to sum to one."""
        logits = np.take(self.table, rows[0], axis=0)
        more = np.empty_like(logits)
        for r in rows[1:]:
            logits += np.take(self.table, r, axis=0, out=more, mode="clip")  # rows are in range, and this mode needs no copy
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return np.exp(logits, out=logits)

    def class_probabilities(self, rows: np.ndarray) -> np.ndarray:
        weights = self.class_weights(rows)
        weights /= weights.sum(axis=1, keepdims=True)
        return weights

    def part_weights(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Probabilities of the parts of the given classes before they are made to sum to one."""
        logits = np.take(self.parts, classes, axis=0)
        more = np.empty_like(logits)
        for r in rows:
            logits += np.take(self.parts, r, axis=0, out=more, mode="clip")
        logits -= logits.max(axis=1, keepdims=True)
        return np.exp(logits, out=logits)

    def part_probabilities(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        weights = self.part_weights(rows, classes)
        weights /= weights.sum(axis=1, keepdims=True)
        return weights

    def within(self, leaves: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of known words the known mass of their class times their discounted share of the leaf; of unknown ones the unknown mass of the class."""
        tokens, words = (x.reshape(CLASSES, PARTS).sum(axis=1)[leaves // PARTS] for x in (self.leaf_tokens, self.leaf_words))
        unknown = np.where(tokens > 0, DISCOUNT * words / np.maximum(tokens, 1), 1.0)
        left = self.leaf_tokens[leaves] - DISCOUNT * self.leaf_words[leaves]
        return np.where(counts > 0, (1 - unknown) * (counts - DISCOUNT) / np.where(left > 0, left, 1), unknown)

    def log10(self, rows: np.ndarray, part_rows: np.ndarray, leaves: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of the class, and for known words of the part."""
        out = np.empty(len(leaves))
        for at in range(0, len(leaves), NEAR):
            part = slice(at, at + NEAR)
            classes, place = np.divmod(leaves[part], PARTS)
            p = self.class_weights(rows[:, part])
            each = np.arange(len(p))
            found = p[each, classes] / p.sum(axis=1)
            # The end and the most frequent words have a class of one part.
            more = np.flatnonzero((classes > HEADS) & known[part])
            q = self.part_weights(part_rows[:, part][:, more], classes[more])
            found[more] *= q[each[: len(more)], place[more]] / q.sum(axis=1)
            out[part] = np.log10(np.maximum(found, 1e-30))
        return out


def runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of texts that together have some PASS tokens, so that features of a block never exist all at once."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PASS)))
        yield first, last
        first = last


def near(probabilities: Callable[..., np.ndarray], *by_token: np.ndarray) -> np.ndarray:
    """Probabilities of all tokens, the last axis of each argument, worked out for NEAR of them at a time."""
    n = by_token[0].shape[-1]
    out = np.empty((n, CLASSES))
    for at in range(0, n, NEAR):
        out[at : at + NEAR] = probabilities(*(x[..., at : at + NEAR] for x in by_token))
    return out


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), TEST_REMAINDER))


def word_totals(blocked: DataFrame) -> DataFrame:
    """block, w, leaf, n, total, is_first: each block's distinct words with their training tokens here and everywhere; is_first once for each word."""

    def count(key: tuple, group: pa.Table) -> pa.Table:
        words = Words()
        tokens, starts = tokens_of(group.column("text"), words)
        trains = np.repeat(group.column("trains").to_numpy(), np.diff(np.append(starts, len(tokens))))
        own = traits(words, {})
        return pa.table({"block": pa.array(np.full(len(words), key[0].as_py(), np.int32)), "w": own.hashes, "leaf": own.leaves.astype(np.int32), "n": np.bincount(tokens, trains, len(words)).astype(np.int64)})

    each = blocked.groupBy("block").applyInArrow(count, "block int, w long, leaf int, n long")
    # One row for each block that has the word, so even the commonest word is a short group.
    same = Window.partitionBy("w")
    return each.withColumn("total", F.sum("n").over(same)).withColumn("is_first", F.min("block").over(same) == F.col("block"))


def sum_tables(parts: DataFrame, tasks: int, cells: int) -> np.ndarray:
    """Sum of (chunk, source, data) rows by chunk, in groups of at most FAN_IN sources at a time; ``cells`` in all."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d, np.float32).astype(float) for d in group.column("data").to_pylist()).astype(np.float32)
        return pa.table({"chunk": group.column("chunk")[:1], "source": group.column("source")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("source", F.col("source") % tasks).groupBy("chunk", "source").applyInArrow(add, parts.schema)
    parts = parts.withColumn("source", F.lit(0)).groupBy("chunk", "source").applyInArrow(add, "chunk int, source int, data binary")
    total = np.zeros(-(-cells // CHUNK_CELLS) * CHUNK_CELLS)
    for r in parts.collect():  # the table, in chunks
        total[r.chunk * CHUNK_CELLS : (r.chunk + 1) * CHUNK_CELLS] = np.frombuffer(r.data, np.float32)
    return total[:cells]


def feature_counts(docs: DataFrame, heads: dict[int, int], model: Model | None = None, hashed: int = HASHED) -> np.ndarray:
    """(2, rows, CLASSES): observed counts of every row, and with a model the expected ones.

    The rows are those of the class softmax, one for all tokens, and those of the softmax over parts.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((heads, model))
    total = table_rows(hashed)
    shape = (2, total + 1 + part_rows(hashed), CLASSES)
    chunks = -(-math.prod(shape) // CHUNK_CELLS)
    edges = [0, PAIRS, 2 * PAIRS, 3 * PAIRS, 3 * PAIRS + hashed, total]
    part_edges = [0, CLASSES, CLASSES + PAIRS, CLASSES + PAIRS + hashed, CLASSES + PAIRS + 2 * hashed]

    def add(sums: np.ndarray, rows: np.ndarray, edges: list[int], got: np.ndarray, p: np.ndarray | None) -> None:
        # Each feature has rows of its own, from one edge to the next.
        for r, low, high in zip(rows, edges, edges[1:], strict=False):
            size = (high - low) * CLASSES
            cells = (r - low) * CLASSES
            sums[0, low:high] += np.bincount(cells + got, minlength=size).reshape(-1, CLASSES)
            if p is not None:
                sums[1, low:high] += np.bincount((cells[:, None] + np.arange(CLASSES)).ravel(), p.ravel(), size).reshape(-1, CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        heads, model = shared.value
        sums = np.zeros(shape)
        some = False
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                words = Words()
                tokens, starts = tokens_of(batch.column(0).slice(at, 64), words)
                own = traits(words, heads)
                all_rows, all_parts = feature_rows(tokens, starts, own, words[END], hashed)
                leaves = own.leaves[tokens]
                some = True
                for first in range(0, len(tokens), PASS):
                    rows, (classes, place) = all_rows[:, first : first + PASS], np.divmod(leaves[first : first + PASS], PARTS)
                    p = near(model.class_probabilities, rows) if model else None
                    add(sums, rows, edges, classes, p)
                    sums[0, total] += np.bincount(classes, minlength=CLASSES)
                    if model:
                        sums[1, total] += p.sum(axis=0)
                    more = np.flatnonzero(classes > HEADS)
                    own_rows = np.concatenate([classes[None, more], all_parts[:, first : first + PASS][:, more]])
                    q = near(model.part_probabilities, own_rows[1:], classes[more]) if model else None
                    add(sums[:, total + 1 :], own_rows, part_edges, place[more], q)
        if some:
            source = TaskContext.get().partitionId()
            flat = sums.ravel()
            for k in range(chunks):
                data = np.zeros(CHUNK_CELLS, np.float32)
                piece = flat[k * CHUNK_CELLS : (k + 1) * CHUNK_CELLS]
                if not piece.any():
                    continue
                data[: len(piece)] = piece
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([source], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "source", "data"])

    parts = docs.select(text_bytes().alias("text")).mapInArrow(run, "chunk int, source int, data binary")
    return sum_tables(parts, docs.rdd.getNumPartitions(), math.prod(shape)).reshape(shape)


def log_odds(rows: np.ndarray, share: np.ndarray, features: int) -> np.ndarray:
    """Smoothed log-odds of rows of counts against the share of the whole, a share of them for each feature."""
    odds = (rows + PRIOR * share) / (rows.sum(axis=1, keepdims=True) + PRIOR) / share
    return (np.log(odds) / features).astype(np.float32)


def first_weights(counts: np.ndarray, hashed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bias, table and the table of parts from observed counts."""
    total = table_rows(hashed)
    share = (counts[total] + 0.5) / (counts[total] + 0.5).sum()
    parts = counts[total + 1 :]
    whole = (parts[:CLASSES] + 0.5) / (parts[:CLASSES] + 0.5).sum(axis=1, keepdims=True)
    every = (parts[:CLASSES].sum(axis=0) + 0.5) / (parts[:CLASSES] + 0.5).sum()
    # A row for a class and its last class is held against that class, a hashed row, which several classes may share, against all.
    near = np.concatenate([log_odds(parts[CLASSES + k * CLASSES : CLASSES + (k + 1) * CLASSES], whole[k], PART_FEATURES) for k in range(CLASSES)])
    rest = log_odds(parts[CLASSES + PAIRS :], every, PART_FEATURES)
    return np.log(share).astype(np.float32), log_odds(counts[:total], share, FEATURES), np.concatenate([np.log(whole).astype(np.float32), near, rest])


def fit(docs: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> Model:
    """Train on the training rows of ``docs``; ``totals`` are the word totals of all."""
    firsts = totals.where("is_first and total > 0")
    end = word_hash(END)
    top = firsts.where(F.col("w") != end).orderBy(F.col("total").desc(), "w").limit(HEADS).collect()
    heads = {r.w: 1 + i for i, r in enumerate(top)}
    tokens, words = np.zeros(CLASSES * PARTS), np.zeros(CLASSES * PARTS)
    own = F.col("leaf")
    for h, k in heads.items():
        own = F.when(F.col("w") == h, F.lit(k * PARTS)).otherwise(own)
    for r in firsts.groupBy(own.alias("k")).agg(F.sum("total").alias("t"), F.count("*").alias("v")).collect():  # a row a leaf
        tokens[r.k], words[r.k] = r.t, r.v
    train = training_rows(docs.select("doc_id", "text"))
    hashed = hashed_rows(int(tokens.sum()))
    bias, table, parts = first_weights(feature_counts(train, heads, hashed=hashed)[0], hashed)
    parts[:CLASSES][(tokens == 0).reshape(CLASSES, PARTS)] = EMPTY
    model = Model(heads, bias, table, parts, tokens, words, int(tokens.sum()), int(words.sum()))
    share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARES))
    tasks = max(1, train.rdd.getNumPartitions() // SHARES)  # a round has a share of the rows
    total = table_rows(hashed)
    for k in range(rounds):
        observed, expected = feature_counts(train.where(share == k % SHARES).coalesce(tasks), heads, model, hashed)
        step = (STEP * (observed - expected) / (expected + PRIOR)).astype(np.float32)
        model.table, model.bias, model.parts = model.table + step[:total], model.bias + step[total], model.parts + step[total + 1 :]
    return model


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    blocks = block_count(docs, block_bytes=block_bytes)
    held = held_out(F.col("doc_id"), TEST_REMAINDER)
    blocked = docs.select("doc_id", held.alias("held_out"), (~held).cast("int").alias("trains"), text_bytes().alias("text"), block_of(blocks).alias("block"))
    totals = stored(word_totals(blocked.select("block", "trains", "text")))
    model = fit(docs, totals, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        model, words = shared.value, Words()
        tokens, starts = tokens_of(group.column("text"), words)
        own = traits(words, model.heads)
        # What only this block has was not sent back: its own training tokens are all there are.
        trains = np.repeat(group.column("trains").to_numpy(), np.diff(np.append(starts, len(tokens))))
        counts = np.bincount(tokens, trains, len(words)).astype(np.int64)
        if known.num_rows:
            w, total = known.column("w").to_numpy(), known.column("total").to_numpy()
            order = np.argsort(w)
            w, total = w[order], total[order]
            at = np.minimum(np.searchsorted(w, own.hashes), len(w) - 1)
            counts = np.where(w[at] == own.hashes, total[at], counts)
        base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
        leaves = own.leaves
        inside = np.log10(model.within(leaves, counts))
        log10 = np.empty(len(tokens))
        for first, last in runs(starts):
            part = slice(starts[first], starts[last] if last < len(starts) else len(tokens))
            rows, part_rows = feature_rows(tokens[part], starts[first:last] - part.start, own, words[END], model.hashed)
            log10[part] = model.log10(rows, part_rows, leaves[tokens[part]], (counts > 0)[tokens[part]]) + inside[tokens[part]]
        lengths = np.diff(np.append(starts, len(tokens)))
        return pa.table(
            {
                "doc_id": group.column("doc_id"),
                "held_out": group.column("held_out"),
                "n_tokens": lengths,
                "n_known": np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts),
                "train_tokens": np.full(len(starts), model.tokens),
                "base_score": np.add.reduceat(base[tokens], starts),
                "score": np.add.reduceat(log10, starts),
            }
        )

    back = totals.where("total > n").select("block", "w", "total")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def either(group: pa.Table, known: pa.Table) -> pa.Table:
        if group.num_rows:
            return score(group, known)
        kinds = group.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
        return pa.table([pa.array([], k) for k in kinds], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(either, schema)


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op3_maxent": op3_maxent}
