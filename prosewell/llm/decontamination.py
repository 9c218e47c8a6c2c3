"""Benchmark decontamination by winnowing.

Of every ``window - GRAM + 1`` consecutive k-gram hashes the smallest is kept, for documents and items alike, so two texts that
share ``window`` words share a fingerprint.  Documents look theirs up among the items' and extend each hit along its diagonal;
runs of at least ``window`` equal words are the shared spans.  Items shorter than a window have no such guarantee: all their words
form one gram, which is looked up among all grams of that length.

A benchmark of a checked size is indexed once and broadcast.  A larger one is joined by fingerprints: each input partition stores its
rows, sends its distinct prints to buckets, gets back those that items have, and then only the items that share one with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from prosewell.llm.scratch import Scratch, plainly_named, ship
from prosewell.llm.sharing import SENT, Distinct, Files, bucket_bits, unpacked
from prosewell.llm.tokens import ALNUM, U64, grams, mix, sliding_min, slices, text_bytes, words

WINDOW = 10
GRAM = 5
#: Bytes of benchmark text that are indexed and broadcast at most (the index takes about ten times as much); a larger one is joined.
BROADCAST_BYTES = 8 << 20


def winnow(values: np.ndarray, bounds: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minima of all windows of w consecutive values of a text."""
    if len(values) < w:
        return np.zeros(0, np.int64)
    low = sliding_min(values, w)
    inside = np.ones(len(low), bool)  # windows that don't cross into the next text
    for j in range(1, w):
        edge = bounds[1:-1] - j
        inside[edge[(edge >= 0) & (edge < len(low))]] = False
    low = np.where(inside, low, 0)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    most = ~sliding_min(~padded, w)  # largest minimum of the windows around a position
    return np.flatnonzero((values == most) & (most > 0))


class Index:
    """The words of a block of items, and the places of their fingerprints."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.ids, self.window = ids, window
        w = words(*text_bytes(pa.array(texts, pa.string())), ALNUM)
        self.hashes, self.bounds = w.hashes, w.bounds
        size = np.diff(w.bounds)
        self.short = {}
        for i in np.flatnonzero((size > 0) & (size < window)):
            value = grams(self.hashes[w.bounds[i] : w.bounds[i + 1]], np.array([0, size[i]]), int(size[i]))[0][0]
            self.short.setdefault(int(size[i]), {}).setdefault(int(value), []).append(int(i))
        values, pos, own = grams(self.hashes, w.bounds, GRAM)
        chosen = winnow(values, own, window - GRAM + 1)
        order = np.argsort(values[chosen], kind="stable")
        self.prints, self.places = values[chosen][order], pos[chosen][order]
        self.items = np.searchsorted(w.bounds, self.places, "right") - 1

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words of the texts are hit, and (text, item) for each item that occurs."""
        hit, found = np.zeros(len(hashes) + 1, np.int64), set()
        for size, table in self.short.items():
            values, pos, own = grams(hashes, bounds, size)
            known = np.array(sorted(table), np.uint64)
            for g in np.flatnonzero(known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values):
                text = int(np.searchsorted(own, g, "right")) - 1
                found.update((text, i) for i in table[int(values[g])])
                hit[pos[g]] += 1
                hit[pos[g] + size] -= 1
        values, pos, own = grams(hashes, bounds, GRAM)
        chosen = winnow(values, own, self.window - GRAM + 1)
        if len(self.prints) and len(chosen):
            left, right = (np.searchsorted(self.prints, values[chosen], side) for side in ("left", "right"))
            some = np.flatnonzero(right > left)
            at = np.repeat(pos[chosen[some]], (right - left)[some])
            which = np.concatenate([np.arange(a, b) for a, b in zip(left[some], right[some], strict=True)]) if len(some) else np.zeros(0, np.int64)
            text = np.searchsorted(bounds, at, "right") - 1
            for t, item, shift in np.unique(np.column_stack([text, self.items[which], at - self.places[which]]), axis=0):
                start = max(bounds[t] - shift, self.bounds[item])
                stop = min(bounds[t + 1] - shift, self.bounds[item + 1])
                equal = np.concatenate([[False], self.hashes[start:stop] == hashes[start + shift : stop + shift], [False]])
                turns = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2)
                for a, b in turns[turns[:, 1] - turns[:, 0] >= self.window]:
                    found.add((int(t), int(item)))
                    hit[start + shift + a] += 1
                    hit[start + shift + b] -= 1
        return np.cumsum(hit[:-1]) > 0, sorted(found)


def _prints(hashes: np.ndarray, bounds: np.ndarray, window: int, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts and whose they are: winnowed grams, and all grams of the sizes of short items, told apart by their size."""
    values, _, own = grams(hashes, bounds, GRAM)
    chosen = winnow(values, own, window - GRAM + 1)
    out, text = [values[chosen]], [np.searchsorted(own, chosen, "right") - 1]
    for size in sizes:
        values, _, own = grams(hashes, bounds, size)
        out.append(mix(values + U64(size)))
        text.append(np.repeat(np.arange(len(own) - 1), np.diff(own)))
    return np.concatenate(out), np.concatenate(text)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text").cast("string").alias("text"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (first and last + 1 of each run of hit words) and items (distinct ids, sorted as text).

    Null and empty texts have no words; null items neither, and a null item_id reads "null".  Equal items under several ids are all
    named; repeated documents are judged each; input columns named like outputs are replaced; empty tables give empty results.
    """
    names = [c for c in docs.columns if c not in {"n_words", "spans", "items"}]
    own, items = plainly_named(docs, names), _items(benchmark)
    keep = own.columns
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([own.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("spans", spans), T.StructField("items", T.ArrayType(T.StringType()))])
    return _found(own, items, window, broadcast_bytes, keep, schema).toDF(*names, "n_words", "spans", "items")


def _found(own: DataFrame, items: DataFrame, window: int, broadcast_bytes: int, keep: list[str], schema: T.StructType) -> DataFrame:
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes:
        rows = items.collect()  # of the size just checked
        index = own.sparkSession.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows], window))
        ship(own.sparkSession)
        return own.mapInArrow(lambda batches: (_judged(b, index.value, keep) for b in slices(batches)), schema)
    return _joined(own, items, window, keep, schema)


def _joined(docs: DataFrame, items: DataFrame, window: int, keep: list[str], schema: T.StructType) -> DataFrame:
    """The hits by a join of fingerprints: no task holds more items than share a print with its documents."""
    scratch = Scratch(docs.sparkSession)
    folder, bits = scratch.path("documents"), bucket_bits(docs)
    numbered = scratch.table(_numbered(items, window), "items")
    sizes = sorted(r["size"] for r in numbered.filter(F.col("size") < window).select("size").distinct().collect())  # fewer than a window has words

    def sent(batches):
        part, found = TaskContext.get().partitionId(), Distinct()

        def stored(out):
            writer, at = None, 0
            for b in slices(batches):
                writer = writer or pa.ipc.new_file(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(b)
                w = words(*text_bytes(b.column("text")), ALNUM)
                prints, text = _prints(w.hashes, w.bounds, window, sizes)
                found.add(prints, at + text)
                at += b.num_rows
            if writer:
                writer.close()

        Files(folder).write(f"docs-{part}", stored)
        yield found.rows(part, bits)

    asked = scratch.table(docs.mapInArrow(sent, SENT), "asked")
    had = numbered.select(F.explode("prints").alias("print"), "item").withColumn("bucket", F.shiftrightunsigned("print", 64 - bits)).select("bucket", F.lit(-1).cast("bigint").alias("part"), "print", "item")

    def met(batches):
        """Buckets: first the prints that items have, then those of the partitions."""
        for bucket, rows in _by_bucket(batches):
            prints = np.array([r["print"] for r in rows if r["part"] < 0], np.int64).view(U64) >> U64(8)
            owners = np.array([r["item"] for r in rows if r["part"] < 0], np.int64)
            order = np.argsort(prints, kind="stable")
            prints, owners = prints[order], owners[order]
            for r in rows:
                if r["part"] >= 0 and len(prints):
                    mine, _ = unpacked(r["hashes"], r["n"])
                    first, end = np.searchsorted(prints, mine, "left"), np.searchsorted(prints, mine, "right")
                    hit = np.unique(np.concatenate([owners[a:b] for a, b in zip(first[end > first], end[end > first], strict=True)] or [np.zeros(0, np.int64)]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r["part"]), pa.int64()), pa.array(hit, pa.int64())], names=["part", "item"])

    both = asked.select("bucket", "part", "hashes", "n", F.lit(None).cast("bigint").alias("print"), F.lit(None).cast("bigint").alias("item")).union(had.select("bucket", "part", F.lit(None).cast("binary"), F.lit(None).cast("bigint"), "print", "item"))
    wanted = both.repartition(1 << bits, "bucket").sortWithinPartitions("bucket", "part").mapInArrow(met, "part long, item long")
    shared = scratch.table(wanted.distinct(), "shared")
    chosen = shared.join(numbered.select("item", "id", "text"), "item").select("part", "id", "text")
    parts = asked.filter("bucket = 0").select("part")  # a row for each partition
    rows = chosen.union(parts.select("part", F.lit(None).cast("string"), F.lit(None).cast("string")))
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1

    def judged(batches):
        held: dict[int, list[tuple[str, str]]] = {}
        for b in batches:
            for part, key, text in zip(*(b.column(c).to_pylist() for c in ("part", "id", "text")), strict=True):
                held.setdefault(part, []).extend([(key, text)] if text is not None else [])
        files = Files(folder)
        for part, own in held.items():
            if files.holds(f"docs-{part}"):
                index = Index([k for k, _ in own], [t for _, t in own], window)
                yield from (_judged(b, index, keep) for b in files.batches(f"docs-{part}"))

    return rows.repartitionById(n, F.col("part").cast("int")).mapInArrow(judged, schema)


def _by_bucket(batches):
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0]["bucket"] != r["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(r)
    if held:
        yield held[0]["bucket"], held


def _numbered(items: DataFrame, window: int) -> DataFrame:
    """item (a number), id, text, size (words, at most a window) and prints of the items that have words."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            w = words(*text_bytes(b.column("text")), ALNUM)
            out = []
            for i, size in enumerate(np.diff(w.bounds).tolist()):
                if size:
                    own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    prints = _prints(own, np.array([0, size]), window, [size] if size < window else [])[0] if size >= window else mix(grams(own, np.array([0, size]), size)[0] + U64(size))
                    out.append(((part << 32) + at + i, b.column("id")[i].as_py(), b.column("text")[i].as_py(), min(size, window), np.unique(prints).view(np.int64)))
            at += b.num_rows
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=["item", "id", "text", "size", "prints"])

    return items.mapInArrow(run, "item long, id string, text string, size long, prints array<long>")


def _judged(part: pa.RecordBatch, index: Index, keep: list[str]) -> pa.RecordBatch:
    """The rows of a batch with what the items of an index hit."""
    span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    w = words(*text_bytes(part.column("text")), ALNUM)
    hit, found = index.hits(w.hashes, w.bounds)
    items: list[set] = [set() for _ in range(part.num_rows)]
    for text, item in found:
        items[text].add(index.ids[item])
    edges = np.zeros(len(hit) + 1, bool)
    edges[1:] = hit
    first = np.flatnonzero(hit & ~edges[:-1])
    inner = w.bounds[1:-1][(w.bounds[1:-1] > 0) & (w.bounds[1:-1] < len(hit))]
    cut = inner[hit[inner] & hit[inner - 1]]  # a run never goes on in the next text
    last = np.flatnonzero(hit & ~np.append(hit[1:], False)) + 1
    first, last = np.union1d(first, cut), np.union1d(last, cut)
    offsets = np.searchsorted(first, w.bounds)
    base = np.repeat(w.bounds[:-1], np.diff(offsets))
    runs = pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], fields=list(span))
    return pa.RecordBatch.from_arrays(
        [part.column(c) for c in keep] + [pa.array(np.diff(w.bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        names=[*keep, "n_words", "spans", "items"],
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with an item."""
    own = plainly_named(docs, docs.columns)
    return find(own, benchmark, window).filter(F.size("spans") == 0).select(*own.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return find(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Words of an item or a document, then windows as text; RE2 counts in code points, and all of U+0080 and above are word characters.
SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w, row_number() OVER () AS rid FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, 'null') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark),
item_at AS (SELECT id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0),
item_window AS (SELECT DISTINCT id, size, array_to_string(w[p : p + size - 1], ' ') AS win FROM item_at),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_at AS (SELECT rid, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS p FROM doc, sizes s WHERE len(w) >= s.size),
hits AS (SELECT d.rid, d.p, d.size, i.id FROM (SELECT rid, size, p, array_to_string(w[p : p + size - 1], ' ') AS win FROM doc_at) d JOIN item_window i ON d.win = i.win AND d.size = i.size),
hit_words AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM hits) GROUP BY rid)
SELECT doc.doc_id, len(doc.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words h USING (rid) LEFT JOIN hit_items t USING (rid)
"""
