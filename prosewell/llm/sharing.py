"""Which hashes several documents have, found without moving a document.

Each input partition stores its texts in the shared folder and sends the distinct hashes of what it holds, cut by hash into sorted
lists; what returns to it are those of its hashes that several documents have.  Later steps open the stored texts again, so texts
are never shuffled, and a partition that is lost is made again from its input or its file.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from prosewell.llm.tokens import U64, slices, text_bytes

#: Samples that each partition may offer.
OFFERED = 32
#: Classes of how often a hash is had.
CLASSES = 7
#: Stands for a null doc_id: after all others.
NO_ID = (1 << 63) - 1


def tasks(df: DataFrame) -> int:
    """Partitions to deal to.  Named, as these rows stand for much more work than their size tells, and must not be packed together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(df: DataFrame) -> int:
    """The hash space is cut into 2 to this power parts, one a task or more, so what a task gets doesn't grow with the input."""
    return max(6, (tasks(df) - 1).bit_length())


class Files:
    """Texts and places of the input partitions in the shared folder."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)

    def write(self, name: str, write) -> None:
        """``write`` gets a stream; the file appears under its name when it is whole."""
        self.store.create_dir(self.root, recursive=True)
        own = f"{self.root}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
        with self.store.open_output_stream(own) as out:
            write(out)
        self.store.move(own, f"{self.root}/{name}")

    def holds(self, name: str) -> bool:
        """An empty partition writes nothing."""
        from pyarrow import fs

        info = self.store.get_file_info(f"{self.root}/{name}")
        return info.type == fs.FileType.File and info.size > 0

    def batches(self, name: str):
        with self.store.open_input_file(f"{self.root}/{name}") as f, pa.ipc.open_file(f) as reader:
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k)

    def arrays(self, name: str) -> dict:
        with self.store.open_input_file(f"{self.root}/{name}") as f:
            return dict(np.load(io.BytesIO(f.read())))


TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


class Distinct:
    """The distinct hashes of a partition; the last bit of each says that several of its documents have it."""

    def __init__(self):
        self.parts, self.held = [np.zeros(0, U64)], 0

    def add(self, hashes: np.ndarray, doc: np.ndarray) -> None:
        """Hashes of some documents, and whose they are; no document comes twice."""
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")
        h, d = hashes[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        self.parts.append((h[first] & ~U64(1)) | several.astype(U64))
        self.held += len(first)
        if self.held > max(4_000_000, 2 * len(self.parts[0])):
            self.merged()

    def merged(self) -> np.ndarray:
        h = np.sort(np.concatenate(self.parts), kind="stable")
        bare = h >> U64(1)
        first = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        h = h[first + n - 1] | (n > 1).astype(U64)  # the flagged one comes last
        self.parts, self.held = [h], len(h)
        return h

    def rows(self, part: int, bits: int, samples: bytes = b"") -> pa.RecordBatch:
        """bucket, part, 56 bits of each hash with the flags, how many, samples.  The first bucket has a row in any case."""
        h = self.merged()
        cuts = np.searchsorted(h >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
        rows = []
        for k in range(1 << bits):
            piece = h[cuts[k] : cuts[k + 1]]
            if len(piece) or not k:
                top = (piece >> U64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
                rows.append((k, part, top + np.packbits((piece & U64(1)).astype(bool)).tobytes(), len(piece), b"" if k else samples))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "part", "hashes", "n", "offered"])


SENT = "bucket long, part long, hashes binary, n long, offered binary"


def store(batches, files: Files, part: int, take) -> None:
    """Writes (doc_id, text) of a partition; ``take`` gets each batch as it is written."""

    def keep(out):
        with pa.ipc.new_file(out, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for b in slices(batches):
                kept = pa.RecordBatch.from_arrays([b.column("doc_id").fill_null(NO_ID), b.column("text").cast(pa.large_string()).fill_null("")], schema=TEXTS)
                writer.write_batch(kept)
                take(kept)

    files.write(f"texts-{part}", keep)


def store_and_hash(docs: DataFrame, folder: str, hashes_of) -> DataFrame:
    """Stores (doc_id, text); hashes_of(raw, offsets) gives text numbers, hashes and a few samples (bytes) of joined texts."""

    bits = bucket_bits(docs)

    def run(batches):
        found, offered = Distinct(), []
        part = TaskContext.get().partitionId()

        def take(b):
            text, h, samples = hashes_of(*text_bytes(b.column("text")))
            found.add(h, b.column("doc_id").to_numpy()[text])
            offered.extend(samples)

        store(batches, Files(folder), part, take)
        yield found.rows(part, bits, b"".join(offered[:: max(1, len(offered) // OFFERED)][:OFFERED]))

    return docs.mapInArrow(run, SENT)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8, 7 * n).reshape(n, 7)
    return out.view("<u8").ravel().astype(U64), np.unpackbits(np.frombuffer(data, np.uint8, offset=7 * n), count=n).astype(bool)


def several(sent: DataFrame, classed: bool = False) -> DataFrame:
    """The hashes (top 56 bits) of each partition that several documents have, and what it offered.

    classed: the bits above tell how often, as the logarithm (to CLASSES - 1 at most) of how many partitions have it, those twice where several of their documents do.
    """

    def run(batches):
        def flush(rows):
            keys, flags = zip(*(unpacked(r["hashes"], r["n"]) for r in rows), strict=True)
            all_keys = np.concatenate(keys)
            distinct, which = np.unique(all_keys, return_inverse=True)
            n = np.bincount(which, minlength=len(distinct)) + np.bincount(which, np.concatenate(flags), len(distinct)).astype(np.int64)
            often, kind = n > 1, np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64) - 1, CLASSES - 1) if classed else np.zeros(len(n), np.int64)
            at = 0
            for r, k in zip(rows, keys, strict=True):
                own = which[at : at + len(k)][often[which[at : at + len(k)]]]
                found = distinct[own] | kind[own].astype(U64) << U64(56)
                at += len(k)
                if len(found) or r["offered"] or not r["bucket"]:
                    yield r["part"], found.astype("<u8").tobytes(), r["offered"]

        def batch(rows):
            p, h, o = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(h, pa.binary()), pa.array(o, pa.binary())], names=["part", "hashes", "offered"])

        held = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield batch(list(flush(held)))
                    held = []
                held.append(r)
        if held:
            yield batch(list(flush(held)))

    return sent.repartition(1 << bucket_bits(sent), "bucket").sortWithinPartitions("bucket", "part").mapInArrow(run, "part long, hashes binary, offered binary")
