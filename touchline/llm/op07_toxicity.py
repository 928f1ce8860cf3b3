"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are the first ``STEM`` characters of words, so that inflections meet, and, if ``WORD_WEIGHT`` is above 0, whole words beside them. A term weighs its count in the text times the
logarithm of the odds against a document's having it, counted over the whole table, beyond those of a common term (so it falls to nothing as a fifth of the
documents have it), and a whole word ``WORD_WEIGHT`` of that. The vocabulary is all terms of the examples. The examples' normalised vectors lie in term order, within a term
in blocks of ``BLOCK`` examples, each with its largest weight; examples with the same commonest word (and so, mostly, language) stand together, which keeps the
bounds tight. A query adds up those block maxima, takes blocks from the highest bound down and stops once no bound reaches the
least of its ``NEIGHBOURS`` best cosines; what it returns are the exact nearest ones. They vote with their cosines as weights, against a
fixed weight for the prior, and a logistic curve fitted to the examples' own leave-one-out votes, with equal weight for either label, turns the vote
into a probability. The nearest examples' ids and cosines are the evidence.

The examples are a bounded sample of the labelled training rows: at most ``EXAMPLES`` of each label, those whose ids hash lowest, with their whole
texts. What reaches the driver are their term counts and one count of documents for each of their terms, both summed in Spark; the index of these
goes to every task.

Edge cases: a null or empty text, like any text without a term of the vocabulary, has no neighbour and gets the score of an empty
vote. A very long text is one vector like any other. Labels that are null or for documents not in the table are not used; a repeated label counts
once, both labels of a document count if they differ, and of training rows that repeat a doc_id the one whose text hashes lowest is used. With
no labelled rows of one kind the score is the smoothed share of label 1. Ties among neighbours go to the example that stands first in the
index. Repeated rows are scored alike. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import held_out, labelled_sample, table

EXAMPLES = 2500
#: Letters of a word's stem, and what no word has in it, which marks a stem.
STEM, STEMMED = 4, "-"
#: What an occurrence of a whole word weighs beside one of a stem; 0 leaves whole words out.
WORD_WEIGHT = 0.0
#: Log odds against a term that a fifth of the documents have: weights fall to nothing there.
COMMON_ODDS = math.log(4)
BLOCK, NEIGHBOURS, PRIOR_WEIGHT = 64, 30, 0.5
#: Blocks that a query looks into first; each further look takes twice as many.
FIRST_BLOCKS = 8
#: Texts whose results a task remembers, as copies are common.
MEMO = 20_000
#: Words whose numbers a task remembers.
MEMO_WORDS = 500_000
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")


def terms(text: str) -> Counter:
    """How often each term occurs."""
    found: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for t in forms(w):
            found[t] += n
    return found


def forms(word: str) -> tuple[str, ...]:
    """A word's stem, and, where whole words weigh anything, the word itself if it is longer."""
    stem = word[:STEM] + STEMMED
    return (stem, word) if WORD_WEIGHT and len(word) > STEM else (stem,)


class Numbering(dict):
    """Word -> the numbers of its stem and of itself in a vocabulary, -1 for none; learnt as words come."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, int]:
        own = forms(word)
        found = (self.vocabulary.get(own[0], -1), self.vocabulary.get(own[1], -1) if len(own) > 1 else -1)
        if len(self) < MEMO_WORDS:
            self[word] = found
        return found


def numbered(text: str, numbering: Numbering) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending, and counts of a text's terms that the vocabulary has."""
    words = Counter(_WORD.findall(text.lower()))
    at = np.array([numbering[w] for w in words], np.int64).ravel()
    n = np.repeat(np.fromiter(words.values(), float, len(words)), 2)
    some = np.flatnonzero(at >= 0)
    some = some[np.argsort(at[some], kind="stable")]
    at, n = at[some], n[some]
    if not len(at):
        return at, n
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[start], np.add.reduceat(n, start)


def term_weight(term: str, having: int, documents: int) -> float:
    """What one occurrence weighs: the log odds against a document's having the term beyond those of a common one; less for a whole word than for a stem."""
    return (1.0 if term.endswith(STEMMED) else WORD_WEIGHT) * max(0.0, math.log((documents - having + 0.5) / (having + 0.5)) - COMMON_ODDS)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each start, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Index:
    """Postings of term t lie in blocks ``first[t]`` to ``first[t + 1]``; block b of them holds postings ``start[b]`` to ``start[b + 1]``."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    labels: np.ndarray
    ids: list
    prior: float
    slope: float = 0.0
    offset: float = 0.0

    @property
    def blocks(self) -> int:
        return -(-len(self.labels) // BLOCK)


def vector(found: Counter, vocabulary: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and the normalised weights of a text's terms."""
    own = sorted((vocabulary[t], n) for t, n in found.items() if t in vocabulary)
    return normalised(np.array([t for t, _ in own], np.int64), np.array([n for _, n in own], float), idf)


def normalised(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = n * idf[at]
    return at, w / (math.sqrt((w * w).sum()) or 1.0)


def build(found: list[Counter], labels: np.ndarray, ids: list, document_counts: dict[str, int], documents: int) -> Index:
    """The index of examples in the given order; ``document_counts`` has each term's documents, of ``documents`` in all."""
    every = sorted({t for c in found for t in c})
    number = {t: i for i, t in enumerate(every)}
    parts = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), float)) for c in found]
    return build_from(every, parts, labels, ids, np.array([document_counts[t] for t in every], np.int64), documents)


def build_from(every: list[str], parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, having: np.ndarray, documents: int) -> Index:
    """As :func:`build`, from each example's term numbers in ``every`` and counts."""
    weights = np.array([term_weight(t, n, documents) for t, n in zip(every, having.tolist(), strict=True)])
    used = weights > 0  # terms that weigh nothing change no cosine
    renumbered = np.cumsum(used) - 1
    idf = weights[used]
    vocabulary = {t: i for i, t in enumerate(t for t, u in zip(every, used.tolist(), strict=True) if u)}
    vectors = []
    for at, n in parts:
        order = np.argsort(at)
        at, n = at[order], n[order]
        vectors.append(normalised(renumbered[at[used[at]]], n[used[at]], idf))
    term = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in vectors)])
    example = np.repeat(np.arange(len(parts)), [len(at) for at, _ in vectors])
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order].astype(np.int32), np.concatenate([np.zeros(0), *(w for _, w in vectors)])[order]
    key = term * (len(parts) // BLOCK + 1) + example // BLOCK
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
    first = np.searchsorted(term[start], np.arange(len(idf) + 1))
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    index = Index(vocabulary, idf, first, example[start] // BLOCK, most, np.append(start, len(term)), example, weight, labels.astype(float), ids, prior)
    if 0 < labels.sum() < len(labels):
        votes = np.array([vote(index, nearest(index, v, but=i)) for i, v in enumerate(vectors)])
        index.slope, index.offset = logistic(votes, labels)
    return index


def nearest(index: Index, query: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
    """The k examples of the largest cosines above zero, exactly: (cosine, example), ties by example."""
    at, w = query
    counts = index.first[at + 1] - index.first[at]
    entries, own = ranges(index.first[at], counts), np.repeat(w, counts)
    where = index.block[entries]
    bound = np.bincount(where, own * index.most[entries], index.blocks)
    order = np.argsort(-bound, kind="stable")
    best, done, look = [], 0, FIRST_BLOCKS
    while done < len(order) and bound[order[done]] > 0 and (len(best) < k or bound[order[done]] >= best[-1][0] - 1e-11):
        chosen = np.zeros(index.blocks, bool)
        chosen[order[done : done + look]] = True
        inside = chosen[where]
        part = entries[inside]
        n = index.start[part + 1] - index.start[part]
        posts = ranges(index.start[part], n)
        # Rounded, so that equal cosines tie however their terms were added up.
        cosine = np.round(np.bincount(index.example[posts], np.repeat(own[inside], n) * index.weight[posts], len(index.labels)), 12)
        if but >= 0:
            cosine[but] = 0
        some = np.flatnonzero(cosine)
        if len(some) > k:
            some = some[cosine[some] >= -np.partition(-cosine[some], k - 1)[k - 1]]
        best = sorted([*best, *zip(cosine[some].tolist(), some.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        done, look = done + look, 2 * look
    return best


def vote(index: Index, best: list[tuple[float, int]]) -> float:
    """The neighbours' labels weighted by cosine, with the prior as one more voter."""
    total = PRIOR_WEIGHT + sum(c for c, _ in best)
    return (PRIOR_WEIGHT * index.prior + sum(c * index.labels[i] for c, i in best)) / total


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps, both labels weighing the same; targets are smoothed, so that separable votes stay finite."""
    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    weight = np.where(y == 1, 0.5 * len(y) / n1, 0.5 * len(y) / (len(y) - n1))
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - target) * x).sum() + 1e-3 * a, (weight * (p - target)).sum()])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def probability(index: Index, found: Counter) -> tuple[float, list[tuple[float, int]]]:
    return probability_of(index, vector(found, index.vocabulary, index.idf))


def probability_of(index: Index, query: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[tuple[float, int]]]:
    best = nearest(index, query)
    if not 0 < index.labels.sum() < len(index.labels):
        return index.prior, best
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, index.slope * vote(index, best) + index.offset)))), best


def document_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(shared.value)
        totals, n = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                totals[numbered(text or "", numbering)[0]] += 1
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(totals[some], n), pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples
    term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    having = np.zeros(len(vocabulary), np.int64)
    having[term[term >= 0]] = n[term >= 0]
    return having, int(n[term < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = EXAMPLES) -> Index:
    """The index of the sampled training rows; texts are taken apart and documents counted on the executors."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(t).items()) for t in batch.column(0).to_pylist()]
            words, counts = [[t for t, _ in f] for f in found], [[n for _, n in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "label", "order", "terms", "counts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, target, rows, 7).select("text", "doc_id", "label", "order")
    found = sample.mapInArrow(split, f"doc_id {id_type}, label int, order long, terms array<string>, counts array<long>").toArrow()  # 2 * rows examples
    terms_of, counts_of = (found.column(c).combine_chunks() for c in ("terms", "counts"))
    coded = terms_of.flatten().dictionary_encode()
    every = coded.dictionary.to_pylist()
    codes, times = coded.indices.to_numpy().astype(np.int64), counts_of.flatten().to_numpy().astype(float)
    ends = np.cumsum(np.diff(terms_of.offsets.to_numpy()))
    parts = [(codes[e - n : e], times[e - n : e]) for e, n in zip(ends.tolist(), np.diff(np.append(0, ends)).tolist(), strict=True)]
    common = [max(((n, every[t]) for t, n in zip(at.tolist(), k.tolist(), strict=True)), default=(0, ""))[1] for at, k in parts]
    keys = list(zip(common, found.column("order").to_pylist(), found.column("label").to_pylist(), strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    having, n = document_counts(docs, every)
    ids = found.column("doc_id").to_pylist()
    return build_from(every, [parts[i] for i in order], np.array([keys[i][2] for i in order], float), [ids[i] for i in order], having, n)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence (the nearest examples' ids and cosines) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        own = shared.value
        numbering = Numbering(own.vocabulary)
        known: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(1).to_pylist():
                key = xxh3_128_digest((text or "").encode())
                if key not in known:
                    if len(known) >= MEMO:
                        known.clear()
                    p, best = probability_of(own, normalised(*numbered(text or "", numbering), own.idf))
                    known[key] = (p, [{"doc_id": own.ids[i], "cosine": c} for c, i in best])
                p, best = known[key]
                scores.append(p)
                evidence.append(best)
            kind = pa.list_(pa.struct([("doc_id", batch.schema.field(0).type), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    kind = id_type.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id: {kind}, cosine: double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


QUERIES = {"op7_toxicity": op7_toxicity}
