"""Language-model scores by a probabilistic suffix tree.

A context (the last one to DEPTH words) is a candidate if the training texts have it LEAST_CONTEXT times, and is retained if its
next-word distribution diverges from that of its longest retained suffix by more than its description costs.  It stores the next words
seen LEAST_ENTRY times after it, discounted; all others fall back to the suffix, scaled so that the distribution sums to one.  The root
is the smoothed distribution of single words.  A token is scored in the longest retained suffix of its past.

The counts are fixed, so the tree grows with the corpus and no task may hold it.  Grams (a context and its next word) and contexts lie
in buckets by hash.  Each input partition stores its texts as numbers of its own words in the shared folder, sends what it has to the
buckets, and gets back what these know of it, which is bounded by its own texts; so counting, retaining and scoring never hold more
than a partition's share.  Each depth is three steps with a table between them: partitions to buckets, buckets to answers, answers to
files of the partitions; what a step has read is dropped before the next one writes.
"""

from __future__ import annotations

import gc
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from prosewell.llm.quality import crc_fold
from prosewell.llm.scratch import Scratch
from prosewell.llm.sharing import Files, bucket_bits, tasks
from prosewell.llm.tokens import _GRAM, BLANKS, U64, Lookup, mix, slices, text_bytes, words

#: The least that counting can tell from chance; what is retained is decided by the divergence.
LEAST_CONTEXT, LEAST_ENTRY = 2, 2
DEPTH = 3
DISCOUNT = 0.5
SMOOTH = 0.1
FOLDS = 10
WHOLE = ~U64(0)
#: The end of a text as a token.
END = U64(0x9D5F0B2E6C41A837)
#: Counts that a task collects before it sums them.
HELD = 500_000
#: Bits of a gram's hash beyond those that number the training tokens: a gram meets another one's hash with probability 2**-20 at most.
SPARE_BITS = 20


class Tokens:
    """Words of texts, the end after each text, and for every token its place in its text."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, numbers: np.ndarray | None = None):
        self.hashes, self.bounds, self.numbers = hashes, bounds, numbers
        size = np.diff(bounds)
        self.text = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(hashes)) - np.repeat(bounds[:-1], size)

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Tokens:
        w = words(raw, offsets, BLANKS)
        return cls(np.insert(w.hashes, w.bounds[1:], END), w.bounds + np.arange(len(w.bounds)))

    def grams(self, depth: int, mask: np.uint64 = WHOLE) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that have ``depth`` words before them, and the hashes of these words and the token: its context as seen by the next token.

        Single words keep their whole hash; of others the mask keeps the upper bits.
        """
        at = np.flatnonzero(self.place >= depth)
        found = context_hash([self.hashes[at - j] for j in range(depth + 1)])
        return at, found & mask if depth else found


def context_hash(recent_first: list[np.ndarray]) -> np.ndarray:
    return mix(sum((h * _GRAM[j] for j, h in enumerate(recent_first)), U64(0)))


class Tree:
    """A tree in one place: single-word probabilities of frequent words, and the retained contexts.  The tests compare the dealt one with it."""

    def __init__(self, total: int, vocabulary: int, heads: np.ndarray, counts: np.ndarray):
        self.total, self.vocabulary = total, vocabulary
        self.heads, self.lookup = heads, Lookup(heads)
        self.log_norm = math.log10(total + SMOOTH * (vocabulary + 1)) if total else math.log10(SMOOTH)
        self.root = np.log10(counts + SMOOTH) - self.log_norm
        self.levels: list[tuple[Lookup, np.ndarray]] = []  # of each depth: context hashes, their states
        self.parent, self.log_rest = np.zeros(1, np.int64), np.zeros(1)
        self.entries, self.log_entry = Lookup(np.zeros(0, U64)), np.zeros(0)
        self._keys = np.zeros(0, U64)

    @staticmethod
    def entry_key(states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return mix((states.astype(U64) << U64(32)) | symbols.astype(U64))

    def state(self, hashes: list[np.ndarray], n: int) -> np.ndarray:
        """States of the longest retained suffixes; hashes[d] are those of d + 1 words."""
        out = np.zeros(n, np.int64)
        for (lookup, states), h in zip(self.levels, hashes, strict=False):
            found = lookup(h)
            out = np.where(found >= 0, states[found] if len(states) else 0, out)
        return out

    def log_p(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 P(symbol | state); of a symbol that isn't frequent (-1), without its single-word probability."""
        out, open_ = np.zeros(len(states)), np.arange(len(states))
        now = states
        while len(open_):
            s = symbols[open_]
            found = np.where((s >= 0) & (now > 0), self.entries(self.entry_key(now, np.maximum(s, 0))), -1) if len(self.log_entry) else np.full(len(s), -1)
            hit, end = found >= 0, (found < 0) & (now == 0)
            out[open_[hit]] += self.log_entry[found[hit]]
            known = end & (s >= 0)
            out[open_[known]] += self.root[s[known]]
            on = ~hit & ~end
            open_, now = open_[on], now[on]
            out[open_] += self.log_rest[now]
            now = self.parent[now]
        return out

    def grow(self, contexts: np.ndarray, occurs: np.ndarray, suffixes: list[np.ndarray], key: np.ndarray, counts: np.ndarray) -> None:
        """Adds a depth: contexts (sorted hashes, how often they occur, hashes of their shorter suffixes), entries key = context << 32 | word."""
        ctx, word = (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)
        parent = self.state(suffixes, len(contexts))
        p = (counts - DISCOUNT) / occurs[ctx] if len(ctx) else np.zeros(0)
        q = 10 ** self.log_p(parent[ctx], word)
        n = len(contexts)
        kept_p, kept_q, kept_c = (np.bincount(ctx, x, n) for x in (p, q, counts))
        rest = np.maximum(1 - kept_p, 1e-12) / np.maximum(1 - kept_q, 1e-12)
        gain = np.bincount(ctx, counts * np.log(p / q), n) + (occurs - kept_c) * np.log(rest)
        size = np.bincount(ctx, minlength=n)
        keep = (size > 0) & (gain > (size + 1) * 0.5 * np.log(np.maximum(occurs, 2)))
        states = np.full(n, -1, np.int64)
        states[keep] = len(self.parent) + np.arange(keep.sum())
        self.levels.append((Lookup(contexts[keep]), states[keep]))
        self.parent = np.concatenate([self.parent, parent[keep]])
        self.log_rest = np.concatenate([self.log_rest, np.log10(rest[keep])])
        mine = keep[ctx]
        keys = np.concatenate([self._keys, self.entry_key(states[ctx[mine]], word[mine])])
        logs = np.concatenate([self.log_entry, np.log10(p[mine])])
        order = np.argsort(keys)
        self._keys, self.log_entry = keys[order], logs[order]
        self.entries = Lookup(self._keys)


#: Kinds of rows between partitions and buckets; STORED_PART only tells that a partition exists.
STORED_PART, GRAMS, CONTEXTS = -1, 0, 1
SENT = "kind long, bucket long, part long, data binary"
#: Some texts of a partition: ids, held out or not, tokens, and the numbers of all their words as compressed byte planes.
STORED = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("size", pa.int64()), ("numbers", pa.large_binary())])


class _Numbers:
    """Numbers of a partition's distinct tokens, given as they come, the frequent ones of some texts first."""

    def __init__(self):
        self.known, self.number, self.given = np.zeros(0, U64), np.zeros(0, np.int64), []

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.known, found), max(0, len(self.known) - 1))
        old = self.known[at] == found if len(self.known) else np.zeros(len(found), bool)
        out = np.empty(len(found), np.int64)
        out[old] = self.number[at[old]]
        new = np.flatnonzero(~old)
        new = new[np.argsort(-n[new], kind="stable")]
        out[new] = len(self.known) + np.arange(len(new))
        self.given.append(found[new])
        known = np.concatenate([self.known, found[~old]])
        order = np.argsort(known, kind="stable")
        self.known, self.number = known[order], np.concatenate([self.number, out[~old]])[order]
        return out[which]

    def hashes(self) -> np.ndarray:
        return np.concatenate(self.given) if self.given else np.zeros(0, U64)


def _planes(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _stored(files: Files, part: int):
    """Ids, held out or not, and tokens of some texts of a partition after another."""
    hashes = files.arrays(f"words-{part}")["hashes"]
    for b in files.batches(f"texts-{part}"):
        size = b.column("size").to_numpy()
        numbers = _numbers(b.column("numbers")[0].as_py(), int(size.sum()))
        yield b.column("doc_id"), b.column("held"), Tokens(hashes[numbers], np.concatenate([[0], np.cumsum(size)]), numbers)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 8-byte values, the first of them ascending, by differences and byte planes."""
    table = np.stack([np.ascontiguousarray(c).view(np.int64) for c in columns])
    table[0, 1:] -= table[0, :-1].copy()
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(*table.shape, 8).transpose(0, 2, 1)).tobytes()
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * width * n, codec="zstd", asbytes=True), np.uint8)
    table = np.ascontiguousarray(planes.reshape(width, 8, n).transpose(0, 2, 1)).view(np.int64)[..., 0].copy()
    table[0] = np.cumsum(table[0])
    return table


def _joined(data: list[bytes], width: int) -> tuple[np.ndarray, list[int]]:
    """The columns of all, and how many rows each has."""
    tables = [_unpacked(d, width) for d in data]
    return np.concatenate([np.zeros((width, 0), np.int64), *tables], axis=1), [t.shape[1] for t in tables]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique: distinct keys, their first places, and of each place its key.  The keys are sorted runs, which merge quickly."""
    order = np.argsort(keys, kind="stable")
    ahead = keys[order]
    new = np.concatenate([np.ones(min(1, len(keys)), bool), ahead[1:] != ahead[:-1]])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ahead[new], order[new], which


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where in it each distinct key starts, and the distinct keys."""
    order = np.argsort(keys, kind="stable")
    ahead = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ahead[1:] != ahead[:-1]]))
    return order, first, ahead[first]


def _cut(kind: int, part: int, columns: list[np.ndarray], bits: int):
    """Rows (kind, bucket, part, data) of columns, the first of which holds sorted hashes."""
    cuts = np.searchsorted(columns[0] >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield kind, k, part, _packed([c[cuts[k] : cuts[k + 1]] for c in columns])


def _batch(rows, names: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "data" else pa.int64()) for n, c in zip(names.split(), columns, strict=True)], names=names.split())


class _Counts:
    """Distinct grams of a partition and how often its training texts have them."""

    def __init__(self):
        self.keys, self.counts, self.held = [np.zeros(0, U64)], [np.zeros(0, np.int32)], 0

    def add(self, keys: np.ndarray, counted: np.ndarray) -> None:
        k, n = np.unique(keys[counted], return_counts=True)
        rest = np.unique(keys[~counted])
        self.keys += [k, rest]
        self.counts += [n.astype(np.int32), np.zeros(len(rest), np.int32)]
        self.held += len(k) + len(rest)
        if self.held > max(HELD, 1.5 * len(self.keys[0])):
            self.merged()

    def merged(self) -> list[np.ndarray]:
        order, first, k = _firsts(np.concatenate(self.keys))
        self.keys = [k]
        n = np.concatenate(self.counts)[order]
        self.counts = [np.add.reduceat(n, first, dtype=np.int64).astype(np.int32) if len(first) else n]
        self.held = len(k)
        return [k, self.counts[0].astype(np.int64)]


class _Entries:
    """Distinct entries of a partition: gram, context, how often the context occurs, count of the gram, log10 of its probability in the suffix.

    Contexts are there as well if none of their next words here is an entry: what these fall back by comes from the others.
    """

    KINDS = (U64, U64, np.int64, np.int64, np.float32)

    def __init__(self):
        self.rows, self.held = [[np.zeros(0, t)] for t in self.KINDS], 0
        self.contexts, self.occurs, self.met = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0

    def meet(self, contexts: np.ndarray, occurs: np.ndarray) -> None:
        c, first = np.unique(contexts, return_index=True)
        self.contexts.append(c), self.occurs.append(occurs[first])
        self.met += len(c)
        if self.met > max(HELD, 1.5 * len(self.contexts[0])):
            self.all_met()

    def all_met(self) -> tuple[np.ndarray, np.ndarray]:
        order, first, c = _firsts(np.concatenate(self.contexts))
        self.contexts, self.occurs = [c], [np.concatenate(self.occurs)[order[first]]]
        self.met = len(c)
        return c, self.occurs[0]

    def add(self, *columns: np.ndarray) -> None:
        _, first = np.unique(columns[0], return_index=True)
        for held, c, kind in zip(self.rows, columns, self.KINDS, strict=True):
            held.append(c[first].astype(kind))
        self.held += len(first)
        if self.held > max(HELD, 1.5 * len(self.rows[0][0])):
            self.merged()

    def merged(self) -> list[np.ndarray]:
        order, first, _ = _firsts(np.concatenate(self.rows[0]))
        at = order[first]
        del order, first
        for k, held in enumerate(self.rows):  # one column after another
            self.rows[k] = [np.concatenate(held)[at]]
            held.clear()
        self.held = len(at)
        return [c[0] for c in self.rows]

    def sums(self) -> list[np.ndarray]:
        """By context: how often it occurs, and over the entries that this partition answers for their number, counts, suffix probabilities and gains."""
        c, all_occur = self.all_met()
        _, contexts, occurs, n, log_q = self.merged()
        mine = (n & 1).astype(bool)
        which, n, occurs, log_q = np.searchsorted(c, contexts[mine]), n[mine] >> 1, occurs[mine], log_q[mine].astype(np.float64)
        gain = n * (np.log((n - DISCOUNT) / occurs) - log_q * math.log(10))
        ints = [np.bincount(which, x, len(c)).astype(np.int64) for x in (np.ones(len(n)), n)]
        q, gain = (np.bincount(which, x, len(c)).astype("<f4").view("<u4").astype(U64) for x in (10.0**log_q, gain))
        return [c, all_occur, *ints, q << U64(32) | gain]  # single precision, summed in the order of partitions


class Share:
    """What a partition knows of the model: of each depth, counts of its grams and those of its contexts that are retained."""

    def __init__(self, log_norm: float, mask: np.uint64 = WHOLE):
        self.log_norm, self.mask = log_norm, mask
        self.words = np.zeros(0, np.int64)  # by number: twice the count, one more if this partition answers for it
        self.grams: list[tuple[Lookup, np.ndarray]] = []  # of two words and more: hashes, counts as above
        self.kept: list[tuple[Lookup, np.ndarray]] = []  # hashes, log10 of the scale of what falls back; the first are those of one word

    def walk(self, t: Tokens, least_context: int, least_entry: int):
        """log10 P of each token in the retained contexts so far and by itself, its gram and count (as stored) at each depth, and the sum that
        its longest gram is the hash of.

        A gram that is seen often enough consists of such grams, so only where these are is it looked for; elsewhere it counts as unseen.
        """
        least = min(least_context, least_entry)
        total = t.hashes * _GRAM[0]
        grams, counts = [mix(total)], [self.words[t.numbers]]
        for d, (lookup, n) in enumerate(self.grams, 1):
            often = counts[-1] >> 1 >= least
            at = np.flatnonzero(often[1:] & often[:-1] & (t.place[1:] >= d)) + 1
            total[at] += t.hashes[at - d] * _GRAM[d]
            own = mix(total[at]) & self.mask
            found = lookup(own)
            for out, values in ((grams, own), (counts, np.append(n, 0)[found])):
                out.append(np.zeros(len(t.hashes), values.dtype))
                out[-1][at] = values
        base = np.log10((counts[0] >> 1) + SMOOTH) - self.log_norm
        log = base.copy()
        for d, (lookup, rest) in enumerate(self.kept, 1):
            at = np.flatnonzero((t.place[1:] >= d) & (counts[d - 1][:-1] >> 1 >= least_context)) + 1
            found = lookup(grams[d - 1][at - 1])
            at, found = at[found >= 0], found[found >= 0]
            if len(at):
                n = counts[d][at] >> 1
                occurs = counts[d - 1][at - 1] >> 1
                log[at] = np.where(n >= least_entry, np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(occurs, 1)), log[at] + rest[found])
        return log, base, grams, counts, total


def _exchange(sent: DataFrame, least: int) -> DataFrame:
    """What the buckets answer to each partition: of its grams that training texts have ``least`` times, the counts; of its contexts, those retained."""

    def grams(keys, first, which, columns):
        n = np.bincount(which, columns[1], len(keys)).astype(np.int64)
        return n >= least, [n << 1], int(n.sum()), int((n > 0).sum())

    def contexts(keys, first, which, columns):
        occurs = columns[1][first]
        size, count = (np.bincount(which, c, len(keys)) for c in columns[2:4])
        both = columns[4].view(U64)
        q, gain = (np.bincount(which, x.astype("<u4").view("<f4").astype(np.float64), len(keys)) for x in (both >> U64(32), both & U64(0xFFFFFFFF)))
        p = (count - DISCOUNT * size) / occurs
        rest = np.maximum(1 - p, 1e-12) / np.maximum(1 - q, 1e-12)
        keep = (size > 0) & (gain + (occurs - count) * np.log(rest) > (size + 1) * 0.5 * np.log(np.maximum(occurs, 2)))
        return keep, [np.log10(rest).astype("<f4").view("<u4").astype(np.int64)], 0, 0

    back = "kind part data total size"

    def run(batches):
        rows = ((k, b, p, d) for batch in batches for k, b, p, d in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "part", "data")), strict=True))
        for (kind, _), held in groupby(rows, lambda r: r[:2]):
            _, _, parts, data = zip(*held, strict=True)
            if kind == STORED_PART:
                yield _batch([(kind, p, b"", 0, 0) for p in parts], back)
                continue
            width = 2 if kind == GRAMS else 5
            columns, sizes = _joined(list(data), width)
            keys, first, which = _distinct(columns[0].view(U64))
            some, values, total, size = (grams if kind == GRAMS else contexts)(keys, first, which, columns)
            at, rows_back = 0, []
            for part, n in zip(parts, sizes, strict=True):
                mine = np.arange(at, at + n)
                at += len(mine)
                mine = mine[some[which[mine]]]
                own = which[mine]
                out = [v[own] for v in values]
                if kind == GRAMS:  # the first partition that has a gram answers for it
                    out[0] = out[0] + (first[own] == mine)
                if len(mine):
                    rows_back.append((kind, part, _packed([keys[own], *out]), total, size))
                    total = size = 0
            yield _batch(rows_back, back)

    dealt = sent.repartition(tasks(sent), "kind", "bucket").sortWithinPartitions("kind", "bucket", "part")
    return dealt.mapInArrow(run, "kind long, part long, data binary, total long, size long")


def _settled(answers: DataFrame, parts: DataFrame, folder: str, depth: int) -> DataFrame:
    """Writes what each partition has been answered to files of its own: grams of ``depth`` words before one, contexts of a word less."""

    def run(batches):
        rows = ((p, k, d) for batch in batches for p, k, d in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True))
        for part, held in groupby(rows, lambda r: r[0]):
            files, held = Files(folder), list(held)
            for kind, d in ((GRAMS, depth), (CONTEXTS, depth - 1)):
                keys, values = _joined([x for _, k, x in held if k == kind], 2)[0]
                order = np.argsort(keys.view(U64), kind="stable")
                keys, values = keys[order], values[order]
                if (kind, d) == (GRAMS, 0):  # of single words the counts alone, in the order of their numbers
                    lookup, own = Lookup(keys.view(U64)), context_hash([files.arrays(f"words-{part}")["hashes"]])
                    keys, values = np.arange(len(own)), np.append(values, 0)[lookup(own)]
                packed = np.frombuffer(_packed([keys, values]), np.uint8)
                files.write(f"{kind}-{d}-{part}", lambda out, packed=packed: np.savez(out, packed=packed))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], names=["part"])

    rows = answers.filter(F.col("kind") != STORED_PART).select("part", "kind", "data").union(parts.select("part", F.lit(STORED_PART).cast("bigint"), F.lit(None).cast("binary")))
    return rows.repartition(tasks(answers), "part").sortWithinPartitions("part", "kind").mapInArrow(run, "part long")


def _each_part(parts: DataFrame, folder: str, share_of, depth: int, work, schema: str) -> DataFrame:
    """``work(part, share, its stored texts)`` for each partition, with what it has been answered up to this depth."""

    def run(batches):
        for part in (p for batch in batches for p in batch.column("part").to_pylist()):
            files, share = Files(folder), share_of()
            for kind, last, into in ((GRAMS, depth, share.grams), (CONTEXTS, depth - 1, share.kept)):
                for d in range(0 if kind == GRAMS else 1, last + 1):
                    keys, values = _unpacked(files.arrays(f"{kind}-{d}-{part}")["packed"].tobytes(), 2)
                    if (kind, d) == (GRAMS, 0):
                        share.words = values
                        continue
                    into.append((Lookup(keys.view(U64)), values if kind == GRAMS else values.astype("<u4").view("<f4").astype(np.float64)))
            yield from work(part, share, _stored(files, part))

    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    return parts.repartitionByRange(n, "part").mapInArrow(run, schema)


def score_corpus(docs: DataFrame, folds: int = FOLDS, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_entry: int = LEAST_ENTRY) -> DataFrame:
    """Scores all rows of ``docs`` (doc_id, text) by a tree of those in no held-out fold.

    Null and empty texts are an end token.  A null doc_id counts as empty text in the fold, so it is held out.  Rows that repeat are
    counted and scored each.  Without training rows every word is unknown.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    folder, bits = scratch.path("share"), bucket_bits(docs)
    doc_id = F.col("doc_id").cast("bigint")
    texts = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_fold(doc_id, folds) == 0).alias("held"))
    least = min(least_context, least_entry)

    def first(batches):
        part, counts, numbers, files = TaskContext.get().partitionId(), _Counts(), _Numbers(), Files(folder)

        def keep(out):
            with pa.ipc.new_file(out, STORED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for b in slices(batches):
                    t = Tokens.of(*text_bytes(b.column("text")))
                    packed = pa.array([_planes(numbers(t.hashes))] + [None] * (b.num_rows - 1), pa.large_binary())
                    writer.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held"), pa.array(np.diff(t.bounds), pa.int64()), packed], schema=STORED))
                    counts.add(t.grams(0)[1], ~b.column("held").to_numpy(zero_copy_only=False)[t.text])

        files.write(f"texts-{part}", keep)
        files.write(f"words-{part}", lambda out: np.savez(out, hashes=numbers.hashes()))
        yield _batch([(STORED_PART, part % (1 << bits), part, b""), *_cut(GRAMS, part, counts.merged(), bits)], "kind bucket part data")

    def deeper(d: int):
        """Sends the sums of contexts of d words, and counts grams after contexts of d + 1 words."""

        def work(part, share, stored):
            counts, entries = _Counts(), _Entries()
            for _, held, t in stored:
                log, _, grams, seen, total = share.walk(t, least_context, least_entry)
                if d:
                    at = np.flatnonzero(t.place >= d)
                    at = at[seen[d - 1][at - 1] >> 1 >= least_context]
                    entries.meet(grams[d - 1][at - 1], seen[d - 1][at - 1] >> 1)
                    at = at[seen[d][at] >> 1 >= least_entry]
                    entries.add(grams[d][at], grams[d - 1][at - 1], seen[d - 1][at - 1] >> 1, seen[d][at], log[at])
                if d < depth:  # a gram is as frequent as its context and its suffix at most
                    at = np.flatnonzero((t.place[1:] > d) & (seen[d][:-1] >> 1 >= least_context) & (seen[d][1:] >> 1 >= least_entry)) + 1
                    counts.add(mix(total[at] + t.hashes[at - d - 1] * _GRAM[d + 1]) & share.mask, ~held.to_numpy(zero_copy_only=False)[t.text[at]])
            if d < depth:
                yield _batch(_cut(GRAMS, part, counts.merged(), bits), "kind bucket part data")
            if d:
                yield _batch(_cut(CONTEXTS, part, entries.sums(), bits), "kind bucket part data")

        return work

    def scored(part, share, stored):
        share.grams = share.grams[:depth]
        for doc_id, held, t in stored:
            log, base, _, seen, _ = share.walk(t, least_context, least_entry)
            known = np.bincount(t.text[seen[0] > 0], minlength=len(doc_id))
            sums = [np.bincount(t.text, x, len(doc_id)) for x in (base, log)]
            yield pa.RecordBatch.from_arrays(
                [doc_id, held, pa.array(np.diff(t.bounds), pa.int64()), pa.array(known, pa.int64()), *map(pa.array, sums)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    def freed(*names: str):
        scratch.drop(*names)
        gc.collect()
        docs.sparkSession._jvm.java.lang.System.gc()  # Spark deletes the shuffle files of tables that nothing holds any more

    answers = scratch.table(_exchange(texts.mapInArrow(first, SENT), 1), "answers-0")
    total, size = (x or 0 for x in answers.agg(F.sum("total"), F.sum("size")).first())
    log_norm = math.log10(total + SMOOTH * (size + 1)) if total else math.log10(SMOOTH)
    spare = 8 * ((64 - min(64, total.bit_length() + SPARE_BITS)) // 8)  # whole bytes, which then take no room
    mask = WHOLE << U64(spare)
    parts = scratch.table(answers.filter(F.col("kind") == STORED_PART).select("part"), "parts")

    def share() -> Share:
        return Share(log_norm, mask)

    for d in range(depth + 2):
        scratch.table(_settled(answers, parts, folder, d), f"settled-{d}")
        freed(f"answers-{d}")
        if d <= depth:
            answers = scratch.table(_exchange(_each_part(parts, folder, share, d, deeper(d), SENT), least), f"answers-{d + 1}")
            freed(f"settled-{d}")
    out = scratch.table(_each_part(parts, folder, share, depth + 1, scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    freed("share", "parts", f"settled-{depth + 1}")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
