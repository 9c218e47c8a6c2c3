"""Media columns: texts as AVI motion-JPEG files, and timed clip rows of such files."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosewell.llm import avi
from prosewell.llm.scratch import ship
from prosewell.llm.tokens import slices, text_bytes

UNIT = 64
_CLIP = "struct<clip:long,first:long,end:long,start_ms:long,end_ms:long,brightness:double>"
_CLIP_TYPE = pa.struct([(n, pa.int64()) for n in ("clip", "first", "end", "start_ms", "end_ms")] + [("brightness", pa.float64())])


def payload(raw: np.ndarray) -> np.ndarray:
    """The bytes and zeros up to a positive multiple of UNIT."""
    out = np.zeros(max(1, -(-len(raw) // UNIT)) * UNIT, np.uint8)
    out[: len(raw)] = raw
    return out


def probe(media: bytes) -> tuple[bytes, list[dict], dict]:
    """Stored payload, timed clips and the header of an AVI file.  Frames are decoded a few hundred at a time."""
    file = avi.parse_avi(media)
    data, hist = [], []
    for at in range(0, len(file["frames"]), 256):
        part = avi.decode_frames(file["frames"][at : at + 256])
        data.extend(avi.stored_bytes(c) for c, *_ in part)
        hist.append(avi.histograms(part))
    stored = np.concatenate(data).tobytes() if data else b""
    if file["comment"].startswith(b"payload="):
        stored = stored[: int(file["comment"][8:])]
    hist = np.concatenate(hist) if hist else np.zeros((0, 16), np.int64)
    clips = []
    for k, (a, b) in enumerate(avi.shots(hist) if len(hist) else []):
        total = hist[a:b].sum(0)
        clips.append({"clip": k, "first": a, "end": b, "start_ms": a * file["us"] // 1000, "end_ms": b * file["us"] // 1000, "brightness": float((total * np.arange(16)).sum() / max(total.sum(), 1))})
    return stored, clips, file


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an AVI file; null and empty texts are 64 zero bytes."""

    ship(docs.sparkSession)

    def run(batches):
        for part in slices(batches):
            raw, at = text_bytes(part.column("text"))
            media = [avi.encode_avi(payload(raw[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Clip rows of (doc_id, media): doc_id, clip, first, end (frames), start_ms, end_ms, brightness.

    Null media have no clips; a file that isn't readable gives one row with its doc_id and nulls, so it isn't lost silently.
    """

    ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            found = []
            for item in batch.column("media").to_pylist():
                try:
                    found.append(probe(item)[1] if item is not None else [])
                except (ValueError, LookupError, struct.error):
                    found.append([dict.fromkeys(("clip", "first", "end", "start_ms", "end_ms", "brightness"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(_CLIP_TYPE))], names=["doc_id", "clips"])

    rows = media.select(F.col("doc_id").cast("bigint").alias("doc_id"), "media").mapInArrow(run, f"doc_id long, clips array<{_CLIP}>")
    return rows.select("doc_id", F.inline("clips"))


def feature(found: list[dict], file: dict) -> str:
    spans = ",".join(f"{c['start_ms']}-{c['end_ms']}@{c['brightness']:.3f}" for c in found)
    return f"{file['width']}x{file['height']} frames={len(file['frames'])} clips={len(found)} {spans}"


def digest(docs: DataFrame) -> DataFrame:
    """Each text stored as an AVI file, read back and probed: sizes, digests and a feature string; one row a document.

    Null and empty texts are 64 zero bytes; repeated rows give repeated rows; an empty table gives an empty result.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    ship(docs.sparkSession)

    def run(batches):
        for part in slices(batches):
            raw, at = text_bytes(part.column("text"))
            rows = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                media = avi.encode_avi(payload(raw[a:b]))
                stored, found, file = probe(media)
                rows.append((int(b - a), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(found, file)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in fields.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
