"""MinHash near-duplicates: universal hash minima, banding, signature check, exact check on full shingle sets, components.

Documents of one shingle set form a class with the smallest id as its representative; only representatives are banded.  In a band
bucket each one is paired with the smallest (the pivot), which is linear in the bucket.  Buckets that then still hold several
components are searched again: members outside the pivot's component meet all members, in blocks, on their full sets, so no link
that shares a bucket is lost and a bucket of any size is dealt to many tasks.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from prosewell.llm.components import components
from prosewell.llm.scratch import Scratch, free_name, quoted
from prosewell.llm.tokens import BLANKS, SLICE, U64, grams, mix, slices, stream, text_bytes, words

SHINGLE = 5
#: 25 bands of 4: two sets of similarity 0.85 share no bucket with probability 1e-8, of 0.8 with 2e-6.
BANDS, ROWS = 25, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Candidates whose signatures agree in this much less than the wanted share are not looked at; that is over five standard errors.
SLACK = 0.2
#: Documents of a pivot that make a block, and pairs of one document that are confirmed in one task.
BLOCK = 1000
#: Up to this many candidate ids (8 bytes each) are sent to every executor.
BROADCAST_IDS = 1_000_000

_MULTIPLY, _ADD = stream(3, BANDS * ROWS) | U64(1), stream(4, BANDS * ROWS)
_BAND_MIX = stream(5, BANDS)
#: Shingles hashed at once, so that the table of hashes stays in the cache.
_PART = 512


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle, without words none."""
    w = words(raw, offsets, BLANKS)
    values, _, own = grams(w.hashes, w.bounds, k, short=True)
    return [np.unique(values[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each multiply-add hash modulo 2^64 over a set."""
    low = np.full(len(_MULTIPLY), np.iinfo(U64).max, U64)
    for at in range(0, len(shingles), _PART):
        part = shingles[None, at : at + _PART] * _MULTIPLY[:, None]
        part += _ADD[:, None]
        np.minimum(low, part.min(1), out=low)
    return low


def _sketch(docs: DataFrame) -> DataFrame:
    """A row a document with an id and words: doc_id, n, set hashes c1 and c2, bands, sig (two bytes of each minimum)."""

    def run(batches):
        for part in slices(batches, limit=SLICE):
            ids = part.column("doc_id")
            sets = shingle_sets(*text_bytes(part.column("text")))
            mixed = [(int(mix(s).sum(dtype=U64)), int(np.bitwise_xor.reduce(mix(s + U64(1)))) if len(s) else 0) for s in sets]
            c = np.array(mixed, U64).reshape(-1, 2).view(np.int64)
            low = np.array([signature(s) for s in sets], U64).reshape(len(sets), BANDS, ROWS)
            keys = _BAND_MIX[None, :].repeat(len(sets), 0)
            for r in range(ROWS):
                keys = mix(keys ^ low[:, :, r])
            top = np.ascontiguousarray((low.reshape(len(sets), -1) >> U64(48)).astype(np.uint16))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), bands, pa.array([x.tobytes() for x in top], pa.binary())],
                names=["doc_id", "n", "c1", "c2", "bands", "sig"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, c1 long, c2 long, bands array<long>, sig binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a == b, axis=-1)


def _alike(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``least`` places or more."""
    sig = sketches.select(F.col("doc_id"), "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array(_agree(x, y) >= least))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sent(ids: DataFrame) -> DataFrame:
    """Ids for a join with texts: up to BROADCAST_IDS of them go to every executor, and the texts stay where they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n, set) of the documents in ``wanted``."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(_sent(wanted), "doc_id", "left_semi")

    def run(batches):
        for part in slices(batches, limit=SLICE):
            sets = shingle_sets(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set"])

    return chosen.mapInArrow(run, "doc_id long, set binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets.

    The set of a travels once for each BLOCK of its pairs, ahead of the sets of its partners.
    """
    ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    sets = scratch.table(_sets(docs, ids), f"{name}-sets")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    first = salts.join(sets.toDF("a", "set"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "set")
    rest = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(sets.toDF("b", "set"), "b").select("a", "salt", "b", "set")

    def run(batches):
        at, own = None, []
        for batch in batches:
            keep_a, keep_b = [], []
            for a, salt, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "set")), strict=True):
                if (a, salt) != at:
                    at, own = (a, salt), []
                values = np.frombuffer(data, U64)
                if b is None:
                    own.append(values)
                    continue
                for mine in own:
                    if min(len(mine), len(values)) * 100 < percent * max(len(mine), len(values)):
                        continue
                    same = int(np.count_nonzero(mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values))
                    if 100 * same >= percent * (len(mine) + len(values) - same):
                        keep_a.append(a), keep_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    dealt = first.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long").distinct()


class _Members:
    """The sets of a block of documents as postings: one probe meets all of them in one count."""

    def __init__(self, docs: list[int], components: list[int], sets: list[np.ndarray]):
        self.docs, self.components = docs, components
        self.sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, probe: np.ndarray, percent: int) -> np.ndarray:
        """Members whose similarity with a set is high enough, exactly."""
        first, end = np.searchsorted(self.values, probe, "left"), np.searchsorted(self.values, probe, "right")
        n = end - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        same = np.bincount(self.owners[at], minlength=len(self.docs))
        return np.flatnonzero(100 * same >= percent * (self.sizes + len(probe) - same))


def _block_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of each pivot's documents: mixed (pivot, doc_id, component, is_pivots, n).

    Documents outside the pivot's component meet all documents of the pivot, dealt to blocks.  Links that join what a task has joined
    already are left out, so a task returns fewer links than it has documents, however alike these are.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    kept = mixed.select("pivot", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.lit(0).alias("probe"), "doc_id", "component")
    probes = mixed.filter("NOT is_pivots").select("pivot", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("probe"), "doc_id", "component")
    rows = kept.union(probes).join(sets, "doc_id")

    def run(batches):
        at, held, members, root = None, [], None, {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for batch in batches:
            out = []
            for pivot, block, probe, doc, component, data in zip(*(batch.column(c).to_pylist() for c in ("pivot", "block", "probe", "doc_id", "component", "set")), strict=True):
                if (pivot, block) != at:
                    at, held, members, root = (pivot, block), [], None, {}
                values = np.frombuffer(data, U64)
                if not probe:
                    held.append((doc, component, values))
                elif held:
                    members = members or _Members(*map(list, zip(*held, strict=True)))
                    for j in members.linked(values, percent).tolist():
                        x, y = find(component), find(members.components[j])
                        if x != y:
                            root[x] = y
                            out.append((min(doc, members.docs[j]), max(doc, members.docs[j])))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pivot", "block").sortWithinPartitions("pivot", "block", "probe")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(sketches, components): a row (doc_id, n, c1, c2) a document, and (node, component) of documents that aren't their own component."""
    scratch = scratch or Scratch(docs.sparkSession)
    least = int((percent / 100 - SLACK) * BANDS * ROWS)
    sketches = scratch.table(_sketch(docs), "sketches")
    named = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.table(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "classes")
    same_set = named.select("doc_id", "c1", "c2").join(classes.filter("members > 1").select("c1", "c2", "first"), ["c1", "c2"]).select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    reps = scratch.table(named.join(classes.select("c1", "c2", F.col("first").alias("doc_id")), ["c1", "c2", "doc_id"], "left_semi").select("doc_id", "bands", "sig"), "reps")

    entries = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.table(entries.join(shared, "key"), "buckets")
    starred = buckets.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = scratch.table(_alike(starred, reps, least), "stars")
    star_links = scratch.table(_confirmed(stars, docs, percent, scratch, "stars"), "star-links")
    first = components(star_links.toDF("u", "v"), scratch, "first")

    owner = first.toDF("doc_id", "component")
    owned = buckets.join(owner, "doc_id", "left").select("key", "doc_id", "pivot", F.coalesce("component", "doc_id").alias("component"), "n")
    pivots = owned.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    members = owned.join(pivots, "key").select("pivot", "doc_id", "component").distinct()
    of_pivot = members.groupBy("pivot").agg(F.min(F.when(F.col("doc_id") == F.col("pivot"), F.col("component"))).alias("pivots"), F.count("*").alias("n"))
    mixed = scratch.table(members.join(of_pivot, "pivot").select("pivot", "doc_id", "component", (F.col("component") == F.col("pivots")).alias("is_pivots"), "n"), "mixed")
    more_sets = scratch.table(_sets(docs, mixed.select("doc_id").distinct()), "more-sets")
    more_links = scratch.table(_block_links(mixed, more_sets, percent), "more-links")
    final = components(same_set.union(star_links.toDF("u", "v")).union(more_links.toDF("u", "v")), scratch, "final")
    for name in ("reps", "buckets", "stars", "mixed", "stars-sets", "more-sets", "stars-ids", "star-links", "more-links", "classes"):
        scratch.drop(name)
    return sketches.select("doc_id", "n", "c1", "c2"), final


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and no links.  Rows of one doc_id are one document: what links one links the other.  A row
    without doc_id is linked with nothing, has a null component and is kept.  An empty table gives an empty result.
    """
    sketches, parts = link(docs, percent)
    out = sketches.join(parts.toDF("doc_id", "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, by doc_id.

    Of rows of one doc_id and one text one stays; rows of one doc_id with different texts all stay, unless the id as a
    whole has a smaller document like it.  Rows without doc_id stay.
    """
    scratch = Scratch(docs.sparkSession)
    _, parts = link(docs, percent, scratch)
    key, turn = free_name("gone", docs.columns), free_name("turn", docs.columns)
    gone = _sent(parts.select(F.col("node").alias(key)))
    kept = docs.join(gone, docs["doc_id"].cast("bigint") == gone[key], "left_anti")
    several = docs.groupBy("doc_id").agg(F.count("*").alias(turn)).filter((F.col(turn) > 1) & F.col("doc_id").isNotNull())
    ids = _sent(scratch.table(several.select(F.col("doc_id").alias(key)), "several"))
    once = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    repeated = kept.join(ids, kept["doc_id"] == ids[key], "left_semi").withColumn(turn, F.row_number().over(once)).filter(F.col(turn) == 1)
    names = [quoted(c) for c in docs.columns]
    return kept.join(ids, kept["doc_id"] == ids[key], "left_anti").select(*names).union(repeated.select(*names))


SQL = """
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
either_way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM doc UNION SELECT r.doc_id, l.b FROM reach r JOIN either_way l ON l.a = r.other),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM part LEFT JOIN size USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
