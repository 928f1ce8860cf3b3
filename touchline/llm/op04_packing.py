"""Packing by power-of-two decomposition.

Each document's token ids are cut into whole windows of ``max_len`` and then the binary pieces of
what is left, longest first. Every piece is a sequence of its own, so no sequence crosses
documents and, as each has a power of two for its length, none is padded. Pieces of equal length
form a bucket (``length``), which :func:`write_buckets` stores as one folder each.

Edge cases: a null or empty text is the end token alone (one piece of length 1). A very long text
is whole windows and the pieces of its rest. Pieces of equal length need no order, as each is a sequence. Repeated rows are packed once each. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table, text_bytes

#: Words whose ids a worker remembers at most; then it starts afresh.
MEMO_WORDS = 1_500_000
MAX_LEN = 4096
EOS = 2
_MEMO: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Bytes of a word -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer never joins text across ASCII white space, so a text's ids are its words' ids in order. Nor does it join an
    ASCII letter and the full stop or comma that ends a word, so these are learnt apart.
    """

    #: Stands between the new words of one call; words that hold it are encoded alone.
    MARK = "\u00b6"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are found in the raw text, before any folding of case.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))
        mark = self._encode(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def words(self, text: bytes) -> list[bytes]:
        """The text's words; where the tokenizer lower-cases anyway, A-Z already are, which leaves fewer words to learn."""
        if not self.folds:
            return text.split()
        folded = text.lower()
        if not any(t.lower() in folded for t in self.added):
            return folded.split()
        return [w if any(t.lower() in w.lower() for t in self.added) else w.lower() for w in text.split()]

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: set[bytes]) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        ended = [w for w in new if w[-1:] in b".," and w[-2:-1].isalpha()]
        plain = {w[:-1] for w in ended} | {b".", b","} | set(new).difference(ended)
        plain = [w for w in plain if w not in self]
        mark = self.MARK.encode()
        alone = plain if self.mark is None else [w for w in plain if mark in w]
        for word in alone:
            self[word] = self._encode(word.decode("utf-8", "replace")).tobytes()
        rest = [w for w in plain if w not in self]
        runs = [rest[at : at + 256] for at in range(0, len(rest), 256)]
        joined = [f" {self.MARK} ".join([w.decode("utf-8", "replace") for w in run]) for run in runs]
        for some, found in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            data, start = ids.tobytes(), 0
            for word, end in zip(some, ends, strict=True):
                self[word] = data[4 * start : 4 * end]
                start = end + 1
        for word in ended:
            self[word] = self[word[:-1]] + self[word[-1:]]


def _word_ids(path: str) -> WordIds:
    if path not in _MEMO:
        _MEMO[path] = WordIds(path)
    return _MEMO[path]


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Whole windows, then the binary digits of the rest from the top."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = MAX_LEN, eos: int = EOS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer_path or default_tokenizer()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _word_ids(path)
        end = eos.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc_ids, rows = part.column(0), {"take": [], "start": [], "length": [], "ids": [], "doc_tokens": []}
                split = list(map(memo.words, part.column(1).to_pylist()))
                memo.learn({w for words in split for w in words})
                for i, words in enumerate(split):
                    ids = b"".join(map(memo.__getitem__, words)) + end
                    start, n = 0, len(ids) // 4
                    for length in piece_lengths(n, max_len):
                        rows["take"].append(i)
                        rows["start"].append(start)
                        rows["length"].append(length)
                        rows["ids"].append(ids[4 * start : 4 * (start + length)])
                        rows["doc_tokens"].append(n)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows["take"], pa.int64())), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["ids"], pa.binary()), pa.array(rows["doc_tokens"], pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    pieces = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(cut, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet with one folder for each sequence length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op4_packing": op4_packing}
