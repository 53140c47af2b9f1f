"""Removal of passages that occur twice, by merging Burrows-Wheeler transforms of shards.

1. Every 200-byte window of a document is assigned to one 48-byte anchor in it: the one of smallest hash, the leftmost of equals. Windows
   with one anchor follow each other; they and the bytes that they cover are a context. Equal windows have equal anchors at equal places in
   them, so only contexts whose anchor occurs again can hold a repeat.
2. Contexts that are equal as a whole (told by 128-bit digests) are one kind. Of each kind one context stands for all, and counts twice in
   the merge if there are several; what the merge finds in it is then carried over to all of them.
3. These contexts are dealt out by anchor. Those that agree with no other one on either side of the anchor far enough for a
   window are left out. A task cuts the others into shards, builds each shard's Burrows-Wheeler transform
   and merges the transforms by refining their interleave: a round takes the current order of all rows, reads the symbols before each row's
   suffix and moves it, in that order, to their bucket. Symbols are read up to 24 at a time, along as many steps of the
   transform at once. After rounds of h symbols in all, rows are ordered by h symbols; a boundary that appears in a
   round bounds a common prefix, and rows alone between boundaries are left out of later rounds. What is left after 200 symbols
   are the intervals of repeated 200-byte strings; no suffix is sorted again after its shard's transform has been built.
4. An anchor with more contexts than a task should merge is split: two contexts that share a window agree, of the bytes that the window has
   beside the anchor, in at least half on one side of it. So each context goes to the group of those with its bytes to the right and to
   that of those with its bytes to the left, and groups still too large are split again, by half of what a window then lacks. After at most
   eight rounds nothing is lacking: then all of a group share that window. Groups of any size come through the merge this way.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, by_bytes, text_of

LENGTH = 200
ANCHOR = 48
#: Bytes of one shard, and of the contexts that are merged at a time.
SHARD_BYTES, MERGE_BYTES = 1 << 18, 1 << 20
#: Contexts of a group beyond which it is split by what lies beside the anchor.
GROUP = 4000
#: Contexts that a task of the merge should have.
TASK_CONTEXTS = 16_000
#: At most so many keys are broadcast, whatever the input.
HEAVY = 512
SPLIT = ("uid", "gid", "lo", "off", "alone", "context", "left", "right")
#: Window starts handled at a time in a very long document; positions must fit in 24 bits.
SEGMENT = 1 << 22
BASE = 0x5851F42D4C957F2D
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Anchors:
    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        self.length, self.anchor = length, min(anchor, length)
        self.up, self.down = _powers(1 << 16)

    def gram_hashes(self, raw: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the gram at every position."""
        if len(raw) > len(self.up):
            self.up, self.down = _powers(2 * len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        k = self.anchor
        h = (sums[k:] - sums[:-k]) * self.down[: len(raw) - k + 1]
        h ^= h >> np.uint64(32)
        h *= SPREAD
        h ^= h >> np.uint64(29)
        h *= SPREAD
        return h ^ h >> np.uint64(32)

    def contexts(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the anchor, its place, first and last window start) of each context of a text."""
        outs = []
        for at in range(0, len(raw) - self.length + 1, SEGMENT):
            part = raw[at : at + SEGMENT + self.length - 1]
            h = self.gram_hashes(part)
            w = self.length - self.anchor + 1
            key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
            n = len(h) - w + 1
            rows = -(-len(h) // w)
            grid = np.full(rows * w, np.uint64(2**64 - 1))
            grid[: len(h)] = key
            grid = grid.reshape(rows, w)
            ahead = np.minimum.accumulate(grid, 1).reshape(-1)
            behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
            place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
            lo = np.flatnonzero(np.diff(place, prepend=-1))
            hi = np.append(lo[1:], n) - 1
            outs.append((h[place[lo]], place[lo] + at, lo + at, hi + at))
        if not outs:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of strings laid end to end, each closed by a mark of its own; ends are the marks' places.

    They are sorted by seven symbols at once; then those that are still equal by twice as many as before each time.
    """
    n, step = len(text), 7
    wide = np.zeros(n + step, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << 9 | wide[k : k + n]
    # what lies behind a mark doesn't count: marks differ by their places
    to_mark = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    short = np.maximum(step - to_mark, 0) * 9
    key = key >> short << short
    order = np.argsort(key, kind="stable")
    near = to_mark[order] < step
    new = np.ones(n, bool)
    ranked = key[order]
    new[1:] = (ranked[1:] != ranked[:-1]) | near[1:]  # equal keys that reach a mark stay in order of place
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    while True:
        first = np.append(np.flatnonzero(new), n)
        alone = np.zeros(n, bool)
        alone[first[:-1][np.diff(first) == 1]] = True
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        after = rank[np.minimum(at + step, n - 1)]  # an equal run of step symbols holds no mark, so there is a suffix behind it
        sub = np.argsort(rank[at] * (n + 1) + after, kind="stable")
        order[open_] = at[sub]
        now = (rank[at] * (n + 1) + after)[sub]
        fresh = np.ones(len(now), bool)
        fresh[1:] = now[1:] != now[:-1]
        new[open_[fresh]] = True
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = head[open_]
        step *= 2


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols before the sorted suffixes, where each row's symbol leads, the suffixes' places) of one shard.

    Symbol 0 is the mark that closes a string; bytes are one higher. Places count the strings' bytes and marks.
    """
    text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    text[ends] = 0
    places = suffix_order(text, ends)
    symbols = text[places - 1]  # before the first string stands the last one's mark
    leads = np.empty(len(symbols), np.int64)
    leads[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
    return symbols, leads, places


def dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's rank among the different keys, and how many there are."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


def merged_repeats(shards: list[list[bytes]], length: int, twice: list[list[bool]] | None = None) -> list[list[np.ndarray]]:
    """For each string of each shard, the starts at which its string of that length occurs elsewhere in them too.

    A string with ``twice`` set stands for several equal ones.
    """
    parts = [transform(s) for s in shards]
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    symbols = np.concatenate([p[0] for p in parts])
    leads = np.concatenate([p[1] + b for p, b in zip(parts, base, strict=False)])
    places = np.concatenate([p[2] for p in parts])
    depth = np.empty(len(symbols), np.int64)  # symbols of the string before each row's suffix
    several = np.zeros(len(symbols), bool)
    for k, strings in enumerate(shards):
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        depth[base[k] : base[k + 1]] = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))[parts[k][2]]
        if twice is not None:
            several[base[k] : base[k + 1]] = np.repeat(np.array(twice[k], bool), sizes)[parts[k][2]]
    rows = np.arange(len(symbols))  # the interleave: shard after shard, as no symbol has been read
    block = np.zeros(len(symbols), np.int64)

    def refined(rows: np.ndarray, block: np.ndarray, keys: np.ndarray, leads: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The interleave by ``step`` symbols more; keys number what stands before each row, below 2**31."""
        inner = depth[rows] >= step
        rows, block = rows[inner], block[inner]
        packed = keys[rows] << np.uint64(32) | np.arange(len(rows), dtype=np.uint64)
        packed.sort()  # by key, and of equal keys in the order so far
        order = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        read = packed >> np.uint64(32)
        rows, block = leads[rows[order]], block[order]
        new = np.ones(len(rows), bool)
        new[1:] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        last = np.ones(len(rows), bool)
        last[:-1] = new[1:]
        more = ~(new & last) | several[rows]
        return rows[more], np.cumsum(new)[more]

    # steps of 1, 8 and 24 symbols: what is read along them, and where they lead
    left = length
    for _ in range(length % 8):
        rows, block = refined(rows, block, symbols.astype(np.uint64), leads, 1)
        left -= 1
    if left and len(rows):
        eight, keys = np.arange(len(symbols)), np.zeros(len(symbols), np.uint64)
        for _ in range(8):
            keys = keys << np.uint64(8) | (symbols[eight].astype(np.uint64) - np.uint64(1)) & np.uint64(255)
            eight = leads[eight]
        keys, kinds = dense(keys)
        while left % 24 and len(rows):
            rows, block = refined(rows, block, keys, eight, 8)
            left -= 8
        if left and len(rows):
            two = eight[eight]
            far = eight[two]
            if kinds <= 1 << 21:
                keys, _ = dense(keys << np.uint64(42) | keys[eight] << np.uint64(21) | keys[two])
            else:
                pairs, _ = dense(keys << np.uint64(32) | keys[eight])
                keys, _ = dense(pairs << np.uint64(32) | keys[two])
            while left and len(rows):
                rows, block = refined(rows, block, keys, far, 24)
                left -= 24
    out = []
    for k, strings in enumerate(shards):
        own = np.sort(places[rows[(rows >= base[k]) & (rows < base[k + 1])]])
        starts = np.cumsum([0] + [len(s) + 1 for s in strings])
        cut = np.searchsorted(own, starts)
        out.append([own[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], starts[:-1], strict=True)])
    return out


def likely(rows: list[tuple], length: int, anchor: int) -> list[tuple]:
    """Of the contexts (anchor, ..., alone, place of the anchor, bytes) of one anchor, those that can share a window with another one.

    One that isn't alone stands for several equal ones, and so always can.

    Of a window's bytes beside its anchor at least half lie on one side of it, so two equal windows agree in so many there.
    """
    side = (length - anchor) // 2
    left, right = {}, {}
    for row in rows:
        off, context = row[-2], row[-1]
        if off >= side:
            k = context[off - side : off]
            left[k] = left.get(k, 0) + 1
        if len(context) - off - anchor >= side:
            k = context[off + anchor : off + anchor + side]
            right[k] = right.get(k, 0) + 1
    return [r for r in rows if not r[-3] or left.get(r[-1][r[-2] - side : r[-2]] if r[-2] >= side else None, 0) > 1 or right.get(r[-1][r[-2] + anchor : r[-2] + anchor + side], 0) > 1]


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """All contexts of docs(uid, text): the anchor's hash, two halves of the whole context's digest, the document, first and last window, anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for piece in by_bytes(batch, 1, 1 << 22):
                columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for k, text in enumerate(piece.column(1)):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    if len(raw) < length:
                        continue
                    h, place, lo, hi = anchors.contexts(np.frombuffer(raw, np.uint8))
                    off = place - lo
                    cuts = zip(lo.tolist(), (hi + length).tolist(), off.tolist(), strict=True)
                    whole = np.frombuffer(b"".join([digest(raw[a:b], seed=o) for a, b, o in cuts]), np.int64).reshape(-1, 2)
                    for column, x in zip(columns, (h.view(np.int64), whole, np.full(len(h), k), lo, hi, off), strict=True):
                        column.append(x)
                if columns[0]:
                    h, whole, k, lo, hi, off = (np.concatenate(c) for c in columns)
                    uids = piece.column(0).take(pa.array(k))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), uids, *map(pa.array, (lo, hi, off))], ["anchor", "w0", "w1", "uid", "lo", "hi", "off"])

    return docs.select("uid", "text").mapInArrow(run, "anchor long, w0 long, w1 long, uid binary, lo long, hi long, off long")


def _met(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with found(*keys, n), whose n says how many rows each key has.

    Keys of more than 1 / HEAVY of all rows, of which there can't be more than HEAVY, are broadcast; the rest is shuffled.
    """
    heavy = found.filter(F.col("n") >= max(2, total // HEAVY + 1))
    rest = found.filter(F.col("n") < max(2, total // HEAVY + 1))
    apart = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(apart)


def _texts_of(contexts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """contexts with their bytes. A document's contexts are gathered; they are no more than its bytes."""
    names = ("gid", "n", "lo", "hi", "off", "alone")
    listed = contexts.groupBy("uid").agg(F.collect_list(F.struct(*names)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                uid, raw = batch.column(0)[row].as_py(), batch.column(1)[row].as_py().encode("utf-8", "surrogatepass")
                parts = batch.column(2)[row].as_py()
                out = {k: [p[k] for p in parts] for k in names if k != "hi"}
                yield pa.RecordBatch.from_pydict({"uid": pa.array([uid] * len(parts), pa.binary()), **out, "context": [raw[p["lo"] : p["hi"] + length] for p in parts]})

    one = docs.select("uid", "text").dropDuplicates(["uid"])
    return one.join(listed, "uid").mapInArrow(run, "uid binary, gid binary, n long, lo long, off long, alone boolean, context binary")


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """The contexts of groups that are too large, each in up to two groups of those that agree in more bytes beside the anchor."""
    anchor = min(ANCHOR, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for uid, gid, lo, off, alone, context, left, right in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if not alone and not left and not right:  # it repeats by itself, whatever group its windows come to
                    out.append((uid, xxhash.xxh3_128_digest(gid + b"=" + uid + str(lo).encode()), lo, off, alone, context, left, right))
                half = -(-(length - anchor - left - right) // 2)
                end = off + anchor + right
                if end + half <= len(context):
                    out.append((uid, xxhash.xxh3_128_digest(gid + b"R" + context[end : end + half]), lo, off, alone, context, left, right + half))
                if left + half <= off:
                    out.append((uid, xxhash.xxh3_128_digest(gid + b"L" + context[off - left - half : off - left]), lo, off, alone, context, left + half, right))
            if out:
                types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(SPLIT))

    return contexts.select(*SPLIT).mapInArrow(run, "uid binary, gid binary, lo long, off long, alone boolean, context binary, left long, right long")


def _merged(contexts: DataFrame, tasks: int, length: int) -> DataFrame:
    """Spans of repeated window starts: those of contexts(gid, uid, lo, alone, off, context), by uid and first window (at), relative to it."""

    def repeats(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        shards: list[list[bytes]] = [[]]
        held = 0
        for row in rows:
            if held >= SHARD_BYTES:
                shards.append([])
                held = 0
            shards[-1].append(row[5])
            held += len(row[5])
        flags = iter([not row[3] for row in rows])
        flat = [x for shard in merged_repeats(shards, length, [[next(flags) for _ in shard] for shard in shards]) for x in shard]
        out: list[tuple] = []
        for row, starts in zip(rows, flat, strict=True):
            if len(starts):
                first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
                final = np.append(first[1:], len(starts)) - 1
                out += [(row[1], row[2], row[3], a, b) for a, b in zip(starts[first].tolist(), starts[final].tolist(), strict=True)]
        if out:
            types = (pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["uid", "at", "alone", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if group and group[0][0] != row[0]:  # whole groups only
                    kept = likely(group, length, min(ANCHOR, length))
                    rows += kept
                    held += sum(len(r[5]) for r in kept)
                    group = []
                    if held >= MERGE_BYTES:
                        yield from repeats(rows)
                        rows, held = [], 0
                group.append(row)
        rows += likely(group, length, min(ANCHOR, length))
        if rows:
            yield from repeats(rows)

    dealt = contexts.select("gid", "uid", "lo", "alone", "off", "context").repartition(tasks, "gid").sortWithinPartitions("gid")
    return dealt.mapInArrow(run, "uid binary, at long, alone boolean, first long, last long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, full: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with full also kept (bytes).

    Texts are UTF-8 bytes. Each byte that lies in a string of that many bytes which starts anywhere else too, in the same or another
    document, is removed; spans are the maximal removed runs. Null text counts as empty; a text shorter than length keeps all its
    bytes, as does an empty table; a row that is repeated repeats all its windows. Null ids are kept. Other columns play no part.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # rows with one id and text share a uid; that of any others differs, up to collisions of 128 bits
    slim = slim.withColumn("uid", F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")))))
    scratch = Scratch(spark, "suffix")
    kind = ["anchor", "w0", "w1", "off"]
    found = scratch.kept("found", _contexts(slim, length))
    total = found.count()
    anchors = scratch.kept("anchors", found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = scratch.kept("again", _met(found, anchors, ["anchor"], total).drop("n"))
    scratch.drop("found", "anchors")
    kinds = scratch.kept("kinds", again.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "lo", "hi")).alias("at")))
    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    reps = kinds.select("anchor", "off", F.col("at.uid").alias("uid"), F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), (F.col("n") == 1).alias("alone"))
    stand = _met(reps, sizes, ["anchor"], total).withColumn("gid", F.encode(F.col("anchor").cast("string"), "utf-8"))
    zero = F.lit(0).cast("long")
    level = scratch.kept("contexts", _texts_of(stand, slim, length)).withColumn("left", zero).withColumn("right", zero)
    need, merged, depth = length - min(ANCHOR, length), [], 0
    while True:
        depth += 1
        rows = level.count()
        lacking = level.filter((F.col("left") + F.col("right") < need))
        small = lacking.filter(F.col("n") <= GROUP)
        merged.append(scratch.kept(f"merged{depth}", _merged(small, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_CONTEXTS), length)))
        # a group that lacks no more bytes shares its window
        first = F.col("off") - F.col("left")
        merged.append(level.filter(F.col("alone") & (F.col("left") + F.col("right") >= need)).select("uid", F.col("lo").alias("at"), "alone", first.alias("first"), first.alias("last")))
        large = lacking.filter(F.col("n") > GROUP)
        if large.isEmpty():
            break
        parts = scratch.kept(f"split{depth}", _split(large, length))
        sizes = parts.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("alone").alias("x")).filter("n > 1 or not x").drop("x")
        level = scratch.kept(f"level{depth}", _met(parts, sizes, ["gid"], parts.count()))
        scratch.drop(f"split{depth}")
    repeats = functools.reduce(DataFrame.unionByName, merged)
    spans = repeats.filter("alone").select("uid", (F.col("at") + F.col("first")).alias("lo"), (F.col("at") + F.col("last")).alias("hi"))
    # what was found in the context that stands for a kind holds for all of it
    named = kinds.filter("n > 1").select(*kind, "n", F.col("at.uid").alias("uid"), F.col("at.lo").alias("at"))
    of_kind = repeats.filter("not alone").drop("alone").distinct().join(named.hint("merge"), ["uid", "at"]).select(*kind, "n", "first", "last")
    whole = _met(again.select(*kind, "uid", "lo"), of_kind, kind, total)
    spans = spans.unionByName(whole.select("uid", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi")))
    listed = spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # no more than a text's bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for row in range(batch.num_rows):
                raw = batch.column(1)[row].as_py().encode("utf-8", "surrogatepass")
                parts, at, removed, n = [], 0, 0, 0
                start = end = -1
                for s in sorted((s["lo"], s["hi"] + length) for s in batch.column(2)[row].as_py() or []):
                    if s[0] > end:
                        if end >= 0:
                            parts.append(raw[at:start])
                            at, removed, n = end, removed + end - start, n + 1
                        start = s[0]
                    end = max(end, s[1])
                if end >= 0:
                    parts.append(raw[at:start])
                    at, removed, n = end, removed + end - start, n + 1
                kept = b"".join([*parts, raw[at:]])
                for k, v in zip(out, (len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[k].append(v)
            if not full:
                out.pop("kept")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **out})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if full else "")
    return slim.join(listed, "uid", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
