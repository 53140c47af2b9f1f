"""Exact near-duplicate join: word shingles with Jaccard similarity of at least 0.75, by signature trees.

1. Every text becomes its set of hashed shingles. Equal sets form one class, named by a 128-bit digest, and only classes go on.
2. Two sets that link share an item among the first n - ceil(0.75 n) + 1 of each, in any one order of all items. The order puts
   items that a sample finds frequent last, then goes by hash. Packed (item, class) pairs are shuffled by item, and
   classes that share an item of these prefixes are candidates: all pairs of a small group, and of a large one each member with the
   member that most large groups share.
3. Candidates are joined by signature trees over bitmaps of whole sets: a leaf holds some sets, a node the OR of the bitmaps below it and
   the range of their sizes; two trees are walked together, and a pair of nodes is left when the items that they can share are too few for
   the smallest sets in it.
4. What is left is compared exactly, by whole sets: first each class with one candidate, the one of most candidates, then the pairs that
   these links don't join into one component yet. A text travels once for each pair, to the text that it is compared with.
5. Large groups that the links found so far don't join into one component are walked in full, by trees over the whole group. A pair
   that shares several groups is listed in the first of them. A walk lists some pairs of each class; these are compared, and what their
   links join is not listed again, so that a group of copies gives about as many pairs as it has members. Classes of which a walk left out pairs
   are walked again for more, until no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, Scratch, cut, joined, release, text_of
from quillon.llm.graph_components import components, joined_components

WORDS = 5
#: The similarity is PARTS / WHOLE.
PARTS, WHOLE = 75, 100
#: Items frequent in a sample of about SAMPLE documents come last in the order; that bears on speed alone.
SAMPLE, OFTEN, MOST_OFTEN = 8192, 8, 100_000
#: Groups up to SMALL give all their pairs; larger ones are walked as a tree if their members aren't connected.
SMALL = 6
#: Rows of a walked group that meet in one task; larger groups are walked chunk against chunk.
CHUNK = 4000
BUCKET_ITEMS = 400_000
LEAF, FAN = 8, 4
#: The widths of bitmaps, each of which the smaller ones divide; a set has the smallest with PER_ITEM bits for each of its items.
WIDTHS, PER_ITEM = (256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536), 6
#: Sets that link have sizes in one or two neighbouring steps of this ratio, which is a little over WHOLE / PARTS.
STEP = 1.34
#: Sizes travel with prefixes as steps of this ratio, of which sets that link lie at most FAR apart (one more than the ratio gives, for rounding).
FINE, FAR = 1.08, 5
#: Pairs of each class that the first walk of a group lists, and how many times as many each later one does.
PAIRS, MORE = 8, 8
#: Groups that a class's row names as walked elsewhere; beyond these a pair may be listed twice, none is left out.
MARKS = 8
#: Keys of texts that the walk of large groups asks for, up to which they are broadcast (3 MB); those of listed pairs never are.
MOST_KEYS = 1 << 17
#: Texts that are compared with one text in one task.
SPOKES = 500
BASE = 0x5851F42D4C957F2D
WHITE_BYTE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Words:
    """Hashes of all words of a text at once, from sums of powers modulo 2**64."""

    def __init__(self) -> None:
        self.up, self.down = powers(1 << 16)

    def hashes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # of bytes: A-Z only
        inner = ~WHITE_BYTE[raw]
        edges = np.flatnonzero(np.diff(inner, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        if len(raw) > len(self.up):
            self.up, self.down = powers(2 * len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= MIXERS[0]
        h ^= h >> np.uint64(29)
        return h * MIXERS[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(text: str, words: Words) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; empty for a text without words."""
    h = words.hashes(text)
    if not len(h):
        return h
    if len(h) < WORDS:
        out = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            out = (out ^ h[k]) * MIXERS[k]
            out ^= out >> np.uint64(31)
        return out
    n = len(h) - WORDS + 1
    out = np.full(n, WORDS, np.uint64)
    for k in range(WORDS):
        out = (out ^ h[k : k + n]) * MIXERS[k]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def width(n: int) -> int:
    return next((w for w in WIDTHS if PER_ITEM * n <= w), WIDTHS[-1])


def sketch(items: np.ndarray) -> bytes:
    """A bitmap of a set: each item's bit; a narrow one is a wide one folded."""
    bits = width(len(items))
    flags = np.zeros(bits, np.uint8)
    flags[(items % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bitmap: int, bits: int) -> int:
    out = 0
    while bitmap:
        out |= bitmap & ((1 << bits) - 1)
        bitmap >>= bits
    return out


def set_id(items: np.ndarray) -> bytes | None:
    """A class's name of 16 bytes; the empty set has none."""
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def fine_step(n: int) -> int:
    return int(math.log(n) / math.log(FINE))


def prefix_length(n: int) -> int:
    return n - -(-n * PARTS // WHOLE) + 1


def links(common: int, a: int, b: int) -> bool:
    return common > 0 and WHOLE * common >= PARTS * (a + b - common)


def least_common(a: int, b: int) -> int:
    """The fewest common items with which sets of a and b items link."""
    return -(-PARTS * (a + b) // (PARTS + WHOLE))


class Tree:
    """A signature tree over sets given as (name, bitmap, size).

    A leaf holds some sets; a node has the OR of the bitmaps below it, the range of their sizes, and the most items that share a bit with
    another item of their set (slack). Two sets share at most the bits that both have, and the lesser slack of the two.
    """

    def __init__(self, sets: list[tuple[int, int, int]]):
        leaves = sorted(((name, bits, n, n - bits.bit_count()) for name, bits, n in sets), key=lambda s: (s[2], s[1]))
        level = [(*self._of([(s[1], s[2], s[2], s[3]) for s in part]), part) for part in self._cut(leaves, LEAF)]
        self.depth = 0
        while len(level) > 1:
            level = [(*self._of(part), part) for part in self._cut(level, FAN)]
            self.depth += 1
        self.root = level[0] if level else None

    @staticmethod
    def _cut(items: list, n: int) -> list[list]:
        return [items[k : k + n] for k in range(0, len(items), n)]

    @staticmethod
    def _of(items: list[tuple]) -> tuple[int, int, int, int]:
        bits = 0
        for x in items:
            bits |= x[0]
        return bits, min(x[1] for x in items), max(x[2] for x in items), max(x[3] for x in items)


def apart(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    """Whether no set under one node can link with one under the other: by sizes, or by the most items that they can share."""
    return WHOLE * min(a[2], b[2]) < PARTS * max(a[1], b[1]) or (a[0] & b[0]).bit_count() + min(a[3], b[3]) < least_common(a[1], b[1])


def walk(left: Tree, right: Tree) -> Iterator[tuple[int, int]]:
    """The names of all pairs, one of each tree, that can link; with one tree given twice, each pair once."""
    if left.root is None or right.root is None:
        return
    todo = [(left.root, left.depth, right.root, right.depth)]
    same = left is right
    while todo:
        a, da, b, db = todo.pop()
        if apart(a, b):
            continue
        if da or db:
            if same and a is b:
                todo += [(a[4][i], da - 1, a[4][j], da - 1) for i in range(len(a[4])) for j in range(i, len(a[4]))]
            elif da >= db:
                todo += [(x, da - 1, b, db) for x in a[4]]
            else:
                todo += [(a, da, x, db - 1) for x in b[4]]
            continue
        for i, (p, p_bits, p_n, p_slack) in enumerate(a[4]):
            for q, q_bits, q_n, q_slack in b[4][i + 1 :] if same and a is b else b[4]:
                if not apart((p_bits, p_n, p_n, p_slack), (q_bits, q_n, q_n, q_slack)):
                    yield p, q


def candidates(left: list[tuple[int, bytes, int]], right: list[tuple[int, bytes, int]]) -> Iterator[tuple[int, int]]:
    """The pairs of sets (name, sketch, size) that can link, by one tree for each width of sketch; left given twice compares it with itself."""

    def trees(sets: list[tuple[int, bytes, int]]) -> list[tuple[Tree, Tree]]:
        """For each width, a tree of its sets and one of those wider sets, folded, that are small enough to link with them."""
        ints = [(name, int.from_bytes(bits, "little"), n, 8 * len(bits)) for name, bits, n in sets]
        out = []
        for w, wider in zip(WIDTHS, (*WIDTHS[1:], 0), strict=True):
            edge = [(a, folded(b, w), n) for a, b, n, size in ints if size == wider and PARTS * n <= WHOLE * (w // PER_ITEM)]
            out.append((Tree([(a, b, n) for a, b, n, size in ints if size == w]), Tree(edge)))
        return out

    one = trees(left)
    two = one if right is left else trees(right)
    for (own, edge), (other, other_edge) in zip(one, two, strict=True):
        yield from walk(own, other)
        yield from walk(own, other_edge)
        if right is not left:
            yield from walk(edge, other)


def _classes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("near")
        hashes = Words()
        for batch in batches:
            sets = [shingles(text.as_py(), hashes) for text in batch.column(2)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "key": batch.column(1),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "class": pa.array([set_id(s) for s in sets], pa.binary()),
                    "sketch": pa.array([sketch(s) for s in sets], pa.binary()),
                }
            )

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, n_shingles long, class binary, sketch binary")


def _often(docs: DataFrame, total: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("near")
        hashes = Words()
        for batch in batches:
            parts = [shingles(t.as_py(), hashes) for t in batch.column(0)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["item"])

    share = max(1, total // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    counted = sample.mapInArrow(run, "item long").groupBy("item").count().filter(F.col("count") >= OFTEN)
    rows = counted.orderBy(F.desc("count"), "item").limit(MOST_OFTEN).collect()
    return np.sort(np.array([r["item"] for r in rows], np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, often: np.ndarray, buckets: int) -> DataFrame:
    """Packed prefixes: a row per batch of documents and bucket of items."""
    broadcast = docs.sparkSession.sparkContext.broadcast(often)  # at most MOST_OFTEN items

    def pack(items: list[np.ndarray], names: list[bytes], steps: list[int]) -> Iterator[pa.RecordBatch]:
        item = np.concatenate(items)
        owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
        bucket = (item * MIXERS[0] >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        item, owner, bucket = item[order], owner[order], bucket[order]
        name, step = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)[owner], np.array(steps, np.uint8)[owner]
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*at[1:].tolist(), len(bucket)]
        cuts = list(zip(at.tolist(), ends, strict=True))
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket[at], pa.int64()),
                "items": [item[a:b].tobytes() for a, b in cuts],
                "names": [name[a:b].tobytes() for a, b in cuts],
                "steps": [step[a:b].tobytes() for a, b in cuts],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("near")
        hashes, often = Words(), broadcast.value
        items: list[np.ndarray] = []
        names: list[bytes] = []
        steps: list[int] = []
        met: set[bytes] = set()
        held = 0
        for batch in batches:
            for text in batch.column(0):
                own = shingles(text.as_py(), hashes)
                if not len(own) or (name := set_id(own)) in met:
                    continue
                met.add(name)
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own
                    own = np.concatenate([own[~late], own[late]])
                items.append(own[: prefix_length(len(own))])
                names.append(name)
                steps.append(fine_step(len(own)))
                held += len(items[-1])
                if held >= 2_000_000:
                    yield from pack(items, names, steps)
                    items, names, steps, held = [], [], [], 0
                    met.clear()
        if items:
            yield from pack(items, names, steps)

    return docs.select("text").mapInArrow(run, "bucket long, items binary, names binary, steps binary")


def _groups(rows: DataFrame) -> DataFrame:
    """From packed prefixes: kind 0, candidate pairs of classes (a, b); kind 1, members b of a large group, which a names by its members.

    Items that the same classes share, as those of one passage are, give one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release("near")
        item = np.frombuffer(b"".join(pdf["items"]), np.uint64)
        name = np.frombuffer(b"".join(pdf["names"]), np.uint64).reshape(-1, 2)
        step = np.frombuffer(b"".join(pdf["steps"]), np.uint8)
        order = np.lexsort((name[:, 1], name[:, 0], item))
        item, name, step = item[order], name[order], step[order]
        first = np.ones(len(item), bool)
        first[1:] = (item[1:] != item[:-1]) | (name[1:] != name[:-1]).any(1)
        item, name, step = item[first], name[first], step[first].astype(np.int16)
        starts = np.flatnonzero(np.diff(item, prepend=item[:1] ^ np.uint64(1)))
        counts = np.diff(starts, append=len(item))
        found = [np.zeros((0, 4), np.uint64)]
        for m in np.unique(counts[(counts > 1) & (counts <= SMALL)]).tolist():
            at = starts[counts == m]
            for i in range(m):
                for j in range(i + 1, m):
                    fit = np.abs(step[at + i] - step[at + j]) <= FAR
                    found.append(np.concatenate([name[at + i][fit], name[at + j][fit]], 1))
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort(pairs.T)]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(1)
        raw = pairs[new].tobytes()
        a_out, b_out = [raw[k : k + 16] for k in range(0, len(raw), 32)], [raw[k + 16 : k + 32] for k in range(0, len(raw), 32)]
        kinds = [0] * len(a_out)
        ends, members = starts + counts, name.tobytes()
        for a, b in zip(starts[counts > SMALL].tolist(), ends[counts > SMALL].tolist(), strict=True):
            own = members[16 * a : 16 * b]
            a_out += [xxhash.xxh3_128_digest(own)] * (b - a)
            b_out += [own[k : k + 16] for k in range(0, len(own), 16)]
            kinds += [1] * (b - a)
        return pd.DataFrame({"kind": kinds, "a": a_out, "b": b_out})

    return rows.groupBy("bucket").applyInPandas(run, "kind long, a binary, b binary")


def _possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out, by trees over batches of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("near")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                columns = [batch.column(k).slice(at, 500).to_pylist() for k in range(6)]
                asked = set(zip(columns[0], columns[1], strict=True))
                left = list({a: (a, s, n) for a, s, n in zip(columns[0], columns[2], columns[3], strict=True)}.values())
                right = list({b: (b, s, n) for b, s, n in zip(columns[1], columns[4], columns[5], strict=True)}.values())
                found = sorted(asked & set(candidates(left, right)))
                yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    one = known.select(F.col("id").alias("a"), F.col("sketch").alias("a_sketch"), F.col("n").alias("a_n"))
    two = known.select(F.col("id").alias("b"), F.col("sketch").alias("b_sketch"), F.col("n").alias("b_n"))
    both = joined(joined(pairs, one, "a"), two, "b", counted=pairs).select("a", "b", "a_sketch", "a_n", "b_sketch", "b_n")
    return both.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, known: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, most: int = 0) -> DataFrame:
    """(id, text) of the classes of known(id, key) that pairs name, each from one document of that key.

    Up to ``most`` keys (of 24 bytes with their id) are broadcast; for more of them documents are shuffled.
    """
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = scratch.kept(f"{name}-wanted", wanted.join(known.select("id", "key"), "id"))
    wanted = wanted.hint("broadcast" if 0 < wanted.count() <= most else "merge")
    return scratch.kept(f"{name}-texts", docs.select("key", "text").join(wanted, "key").select("id", "text").dropDuplicates(["id"]))


def _verified(spokes: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b) of spokes(hub, node) whose whole sets link, from texts(id, text).

    The nodes' texts are sent to their hub's, SPOKES or so at a time, and read one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("near")
        hashes = Words()
        at, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            a_out, b_out = [], []
            for name, part, node, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                name, part, node = name.as_py(), part.as_py(), node.as_py()
                own = shingles(text.as_py(), hashes)
                if node is None:
                    at, hub = (name, part), own
                    continue
                if at != (name, part):
                    raise ValueError("a text without the one that it is compared with")
                both = np.concatenate([hub, own])
                both.sort()
                if links(int((both[1:] == both[:-1]).sum()), len(hub), len(own)):
                    a_out.append(min(name, node))
                    b_out.append(max(name, node))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    parts = cut(spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("long").alias("parts")))
    heads = parts.select(F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(texts, "id")
    dealt = joined(spokes, parts, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # texts have no bound, so none is broadcast
    sent = dealt.select("hub", "part", F.col("node").alias("id")).join(texts.hint("merge"), "id").select("hub", "part", F.col("id").alias("node"), "text")
    rows = heads.select(F.col("id").alias("hub"), "part", F.lit(None).cast("long").alias("node"), "text").unionByName(sent)
    return rows.repartition(tasks, "hub", "part").sortWithinPartitions("hub", "part", F.col("node").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _spokes(pairs: DataFrame) -> DataFrame:
    """pairs as (hub, node); the hub is the one of more pairs, then the larger."""
    degree = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("pairs")))
    ranked = pairs
    for side in ("a", "b"):
        ranked = joined(ranked, degree.select(F.col("id").alias(side), F.col("pairs").alias(f"{side}_pairs")), side, counted=pairs)
    one, two = (F.struct(F.col(f"{side}_pairs").alias("pairs"), F.col(side).alias("id")) for side in ("a", "b"))
    return ranked.select(F.greatest(one, two).getField("id").alias("hub"), F.least(one, two).getField("id").alias("node"))


def _best(pairs: DataFrame) -> DataFrame:
    """For each class its pair with the class of most pairs, as (hub, node)."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = cut(both.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")))
    best = joined(both, degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("pairs", "b")).alias("best"))
    once = best.groupBy(F.least("a", "best.b").alias("x"), F.greatest("a", "best.b").alias("y")).agg(F.max("best").alias("best"))
    hub = F.col("best.b")
    return once.select(hub.alias("hub"), F.when(hub == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("node"))


def _linked(pairs: DataFrame, texts: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """The components (node, comp) of the links among pairs."""
    tasks = max(1, min(tasks, pairs.count() // SPOKES))
    comp = cut(components(scratch.kept("links", _verified(scratch.kept("best", _best(pairs)), texts, tasks))))
    apart = pairs
    for side in ("a", "b"):
        apart = joined(apart, comp.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp")), side, how="left", counted=pairs)
    rest = scratch.kept("rest", apart.filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b"))
    if rest.isEmpty():
        return comp
    return joined_components(comp, scratch.kept("more", _verified(scratch.kept("spokes", _spokes(rest)), texts, tasks)))


def _open(members: DataFrame) -> DataFrame:
    """Of members(item, class, n, comp), those with one of another component and of a size that can link in their group; n_members counts them."""
    stepped = members.withColumn("step", F.floor(F.log("n") / F.log(F.lit(STEP))))
    steps = stepped.groupBy("item", "step").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    around = steps.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    mixed = around.groupBy("item", "step").agg(F.min("x").alias("x"), F.max("y").alias("y")).filter("x <> y").select("item", "step")
    left = cut(joined(stepped, mixed, "item", "step").select("item", "class", "comp"))
    return joined(left, left.groupBy("item").agg(F.count(F.lit(1)).alias("n_members")), "item")


def _dealt(members: DataFrame) -> DataFrame:
    """members(item, class, n_members) as rows (item, i, j, part, class, marks) of the tasks that walk chunk i against chunk j.

    marks are up to MARKS of the groups of the same class that come before item, in one order of all groups.
    """
    of = F.sort_array(F.collect_list(F.struct(F.xxhash64("item").alias("mark"), "item", "n_members"))).alias("of")
    each = members.groupBy("class").agg(of).select("class", F.transform(F.slice("of", 1, MARKS), lambda x: x["mark"]).alias("marks"), F.posexplode("of").alias("at", "of"))
    placed = each.select("class", F.slice("marks", 1, F.least("at", F.lit(MARKS))).alias("marks"), "of.item", F.ceil(F.col("of.n_members") / CHUNK).cast("int").alias("k"))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("class"), F.col("k").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.select("item", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "marks")


def _walked(dealt: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Possible links (a, b) between members of one group and different components: dealt has comp, too.

    Pairs are left out when both classes have listed that many already; such a class (a) is told with its task (item, i, j) and no b.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        release("near")
        comp = dict(zip(pdf["class"], pdf["comp"], strict=True))
        before = {c: frozenset(marks) for c, marks in zip(pdf["class"], pdf["marks"], strict=True)}
        item, i, j = pdf["item"].iloc[0], pdf["i"].iloc[0], pdf["j"].iloc[0]

        def sets(part: int) -> list[tuple[int, bytes, int]]:
            rows = pdf[pdf["part"] == part].drop_duplicates("class")
            return list(zip(rows["class"], rows["sketch"], rows["n"], strict=True))

        left = sets(i)
        right = left if i == j else sets(j)
        found, more, listed = [], set(), dict.fromkeys(comp, 0)
        for p, q in candidates(left, right):
            if comp[p] == comp[q] or not before[p].isdisjoint(before[q]):
                continue
            if min(listed[p], listed[q]) >= most:
                more |= {p, q}
                continue
            listed[p] += 1
            listed[q] += 1
            found.append((None, None, None, min(p, q), max(p, q)))
        out = pd.DataFrame([*found, *((item, i, j, c, None) for c in more)], columns=["item", "i", "j", "a", "b"])
        return out.astype({"i": "Int32", "j": "Int32", "a": "Int64", "b": "Int64"})

    full = dealt.join(known.select(F.col("id").alias("class"), "n", "sketch").hint("merge"), "class").select("item", "i", "j", "part", "class", "comp", "marks", "n", "sketch")
    return full.groupBy("item", "i", "j").applyInPandas(run, "item binary, i int, j int, a long, b long")


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows(class) with the component of their class, which is the class itself without links."""
    return rows.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))


def _joined_by_walks(large: DataFrame, comp: DataFrame, docs: DataFrame, known: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """The components (node, comp) after the links within the groups large(item, class, n) that comp leaves apart."""
    dealt, most = scratch.kept("dealt", _dealt(_open(cut(_with_comp(large, comp))))), PAIRS
    while True:
        walked = scratch.kept(f"walked{most}", _walked(_with_comp(dealt, comp), known, most))
        pairs = scratch.kept(f"walked{most}-pairs", walked.filter("b is not null").select("a", "b").distinct())
        if pairs.isEmpty():
            return comp
        texts = _texts(docs, known, pairs, scratch, f"walked{most}", MOST_KEYS)
        few = max(1, min(tasks, pairs.count() // SPOKES))
        comp = joined_components(comp, scratch.kept(f"walked{most}-links", _verified(scratch.kept(f"walked{most}-spokes", _spokes(pairs)), texts, few)))
        scratch.drop(f"walked{most}-texts")
        more = walked.filter("b is null").select("item", "i", "j", F.col("a").alias("class"))
        if more.isEmpty():
            return comp
        dealt, most = scratch.kept(f"dealt{most}", dealt.join(more.hint("merge"), ["item", "i", "j", "class"])), most * MORE


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row: doc_id, key (of its id and text), n_shingles, comp (its component's name; null without words)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    scratch = Scratch(spark, "jaccard")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.kept("classes", _classes(slim))
    rows, items = found.select(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    buckets = max(tasks, items // 4 // BUCKET_ITEMS)
    tasks = max(tasks, items // 4 // BUCKET_ITEMS)
    groups = scratch.kept("groups", _groups(_prefixes(slim, _often(slim, rows), buckets)))
    wanted = groups.filter("kind = 0").select(F.col("a").alias("class")).union(groups.select("b")).distinct()
    classes = found.filter("class is not null").groupBy("class").agg(F.min(F.struct("key", F.col("n_shingles").alias("n"), "sketch")).alias("of"))
    known = scratch.kept("known", classes.join(wanted.hint("merge"), "class").select(F.monotonically_increasing_id().alias("id"), "class", "of.*"))  # written once, so ids stay
    name = known.select("id", "class")
    listed = groups.filter("kind = 0").select("a", "b")
    pairs = listed.distinct()
    for side in ("a", "b"):
        pairs = joined(pairs, name.select(F.col("class").alias(side), F.col("id").alias(f"{side}_id")), side, counted=listed).drop(side)
    pairs = pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    members = groups.filter("kind = 1").select(F.col("a").alias("item"), F.col("b").alias("class"))
    large = joined(members.distinct(), known.select("class", "id", "n"), "class", counted=members).select("item", F.col("id").alias("class"), "n")
    large = scratch.kept("large", large)
    shares = large.groupBy("class").agg(F.count(F.lit(1)).alias("shares"))
    hubs = large.join(shares, "class").groupBy("item").agg(F.max(F.struct("shares", "class", "n")).alias("hub"))
    near = F.lit(WHOLE) * F.least("n", "hub.n") >= F.lit(PARTS) * F.greatest("n", "hub.n")
    spokes = joined(large, cut(hubs), "item").filter(near).select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).filter("a <> b")
    pairs = scratch.kept("pairs", pairs.unionByName(spokes).distinct())
    scratch.drop("groups")
    possible = scratch.kept("possible", _possible(pairs, known))
    scratch.drop("pairs")
    comp = _linked(possible, _texts(slim, known, possible, scratch, "possible"), scratch, tasks)
    scratch.drop("possible", "possible-texts")
    comp = _joined_by_walks(large, comp, slim, known, scratch, tasks)
    comp = cut(comp.withColumnRenamed("node", "id").join(name.hint("merge"), "id").select("class", "comp"))
    rows = joined(found.filter("class is not null").drop("sketch"), comp, "class", how="left")
    rows = rows.select("doc_id", "key", "n_shingles", F.coalesce(F.col("comp").cast("string").cast("binary"), F.col("class")).alias("comp"))
    none = found.filter("class is null").select("doc_id", "key", "n_shingles", F.lit(None).cast("binary").alias("comp"))
    return scratch.kept("named", rows.unionByName(none))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A-Z are lower-cased and words are runs of characters outside [\\x20\\x09-\\x0D]. A set holds the distinct shingles of five
    words, or the whole sequence of fewer; a null, empty or blank text has no set and links with nothing, so its component
    is itself. Two documents link when 100 * common >= 75 * all of their sets. Shingles are told apart by 64-bit hashes, sets by
    128-bit ones. Rows with one id are compared like others; null ids are kept. Other columns play no part.
    """
    named = _named(docs, id_col, text_col)
    linked = named.filter("comp is not null")
    least = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    alone = named.filter("comp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined(linked, least, "comp").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text."""
    return F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text_of(text_col))))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each component: that of the smallest id, null ids last; rows without words all stay."""
    named = _named(docs, "doc_id", "text").filter("comp is not null")
    winner = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("won")
    kept = named.groupBy("comp").agg(winner).select(F.col("won.key").alias("__key"))
    keyed = docs.select(F.struct("*").alias("__row"), row_key("doc_id", "text").alias("__key"), text_of("text").rlike(WORD).alias("__words"))
    # the join leaves rows dealt by key, so that choosing one of repeated rows doesn't shuffle them again
    chosen = keyed.filter("__words").join(kept.hint("merge"), "__key").groupBy("__key").agg(F.first("__row").alias("__row"))
    return chosen.select("__row.*").unionByName(keyed.filter("not __words").select("__row.*"))
