"""Token-ID output: whole texts to ids of a public tokenizer, in ascending doc_id order, as one wavelet matrix file a shard.

Texts are cut at ASCII blanks and between ASCII letters and marks, over which this tokenizer never joins, and each distinct piece is
encoded once: pieces come as hashes from the bytes, ids of known ones from a table that each worker keeps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from prosewell.llm.scratch import Scratch
from prosewell.llm.tokens import BLANKS, Lookup, slices, text_bytes, words
from prosewell.llm.wavelet import NULL_ID, WaveletFile, encode

TOKENIZER = "word_bpe_49k.json"
#: Fixed value: SHA-256 of the one tokenizer file whose texts may be cut in pieces; by any other, texts are encoded whole.
IN_PIECES = "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a"
END_ID = 1
#: A shard is closed at the first document that reaches this many tokens; one document is never split.
SHARD_TOKENS = 4_000_000
#: Pieces a worker remembers; at more, it starts anew.
KNOWN_WORDS = 1_000_000
#: Words that are encoded in one call.
JOINED = 200


class Vocabulary:
    """Ids of words by hash, filled as words come."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as file:
            self.in_pieces = hashlib.sha256(file.read()).hexdigest() == IN_PIECES
        self.planes = max(1, int(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.special = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.is_end = np.zeros(1 << self.planes, bool)
        for word, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.is_end[number] = word.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.lookup = Lookup(self.keys)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece.  Words of Latin letters are one unit each, whose last id is a word end, so many go in one call."""
        out: list = [None] * len(texts)
        plain = [k for k, x in enumerate(texts) if x.isalpha() and max(x) < "\u0130"]
        joined = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for group, found in zip(joined, self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in g) for g in joined], add_special_tokens=False), strict=True):
            ids = found.ids
            ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
            if len(ends) == len(group):
                for k, i, j in zip(group, [0, *ends], ends, strict=False):
                    out[k] = ids[i:j]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Adds pieces; keys ascend."""
        got = self._ids(texts)
        size = np.fromiter(map(len, got), np.int64, len(got))
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)
        self.lookup = Lookup(self.keys)

    def _whole(self, data: bytes, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by any tokenizer: each text in one piece."""
        texts = [data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        got = [np.array([*x.ids, end_id], np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, the end id after each, and the number of ids of each text."""
        data = raw.tobytes()
        if not self.in_pieces:
            return self._whole(data, offsets, end_id)
        low = data.lower()
        w = words(raw, offsets, BLANKS_KEPT) if any(x in low for x in self.special) else words(raw, offsets, BLANKS, (_LETTERS, _MARKS))
        if len(self.keys) > KNOWN_WORDS:
            self.clear()
        at = self.lookup(w.hashes)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            keys, sample = np.unique(w.hashes[unknown], return_index=True)
            new = unknown[sample]
            self.learn(keys, [data[a:b].decode() for a, b in zip(w.starts[new].tolist(), w.ends[new].tolist(), strict=True)])
            at = self.lookup(w.hashes)
        first, size = self.first[at], self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        per_text = total[w.bounds[1:]] - total[w.bounds[:-1]]
        ids = np.full(total[-1] + len(per_text), end_id, np.uint32)
        start = total[:-1] + np.repeat(np.arange(len(per_text)), np.diff(w.bounds))  # an end id for each earlier text
        place = np.arange(total[-1]) - np.repeat(total[:-1], size)
        ids[place + np.repeat(start, size)] = self.ids[place + np.repeat(first, size)]
        return ids, per_text + 1


#: Blanks only, case kept.
BLANKS_KEPT = BLANKS.copy()
BLANKS_KEPT[65:91] -= 32
#: Between an ASCII letter and an ASCII mark this tokenizer always cuts: letters end there, and no contraction spans it; and it
#: takes no heed of case.  Special tokens break both rules, so texts with one are cut at blanks only and keep their case.
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards of (doc_id, text) to ``folder``; lazily, a row for each: part, shard, path, n_docs, n_tokens.

    Parts ascend by doc_id, shards in a part too.  A file is written under the attempt's own name and then moved, and its content
    depends on the rows alone, so a task that runs again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        vocabulary, shard = _vocabulary(tokenizer), 0
        ids, sizes, tokens, held = [], [], [], 0

        def close():
            nonlocal shard, held
            name, ends = f"{root}/part-{part:06d}-{shard:06d}", np.cumsum(np.concatenate(sizes))
            data = encode(np.concatenate(tokens), np.concatenate(ids), ends, vocabulary.planes)
            with store.open_output_stream(f"{name}.{attempt}.tmp") as out:
                out.write(data)
            store.move(f"{name}.{attempt}.tmp", f"{name}.wm")
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "path": [f"{folder}/part-{part:06d}-{shard:06d}.wm"], "n_docs": [len(ends)], "n_tokens": [int(ends[-1])]})
            shard, held = shard + 1, 0
            for x in (ids, sizes, tokens):
                x.clear()
            return row

        for batch in slices(batches):
            got, size = vocabulary.encode(*text_bytes(batch.column("text")), end_id)
            key = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            ids.append(key), sizes.append(size), tokens.append(got.astype(np.uint16) if vocabulary.planes <= 16 else got)
            held += len(got)
            if held >= shard_tokens:
                yield close()
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    return ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(run, "part long, shard long, path string, n_docs long, n_tokens long")


def read(shards: DataFrame) -> DataFrame:
    """Documents of the shards of ``write``, from the files: doc_id, start, n_tokens, ids."""
    return _read(shards, True)


def _read(shards: DataFrame, with_ids: bool) -> DataFrame:
    parts = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row a task of the writer
    start = dict(zip((p for p, _ in parts), np.cumsum([0, *(n for _, n in parts)]).tolist(), strict=False))
    offsets = shards.sparkSession.sparkContext.broadcast(start)
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches):
        for batch in batches:
            for part, path, earlier in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "before")), strict=True):
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    file = WaveletFile(f.read())
                tokens = file.tokens().astype("<u4")
                ends = file.ends
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                first = offsets.value[part] + earlier + begins
                ids = pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == NULL_ID)
                cells = [ids, pa.array(first, pa.int64()), pa.array(ends - begins, pa.int64())]
                if with_ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begins[:1], ends]), pa.int32()), pa.array(tokens.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "start", "n_tokens", "ids"])
                else:
                    data = memoryview(tokens.tobytes())
                    sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(shards.count(), 10_000))
    dealt = shards.withColumn("before", before).repartition(n, "path")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long"))


def digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes ``docs`` (doc_id, text) and reads the files back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are an end id alone.  Rows of one doc_id, or of none (they come first), follow each other by text.  An empty
    table writes no file and gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    return _read(scratch.table(write(docs, scratch.path("shards"), tokenizer, end_id, shard_tokens), "manifest"), False)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
