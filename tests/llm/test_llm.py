"""Each operator against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import bpe, exact_dedup, html_text, jaccard_join, lm_score, media, mixing, quality, suffix_dedup, token_store, webp, webp_lanes
from quillon.llm.graph_components import components, joined_components

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 80, 120, 200)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d e", *base, *base]
    for _ in range(30):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words) for _ in range(90)) + "\n" + passage + "\n" + rng.choice(words) for _ in range(8)]
    texts += ["ab " * 3000, "x" * 5000, passage.upper()]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["src0", "src1", "other"]), 1, 2, "z") for i, t in enumerate(texts)]
    rows += [(3, "one two", "en", "src0", 1, 2, "z"), (None, "nothing", None, None, 1, 2, "z")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def test_exact_dedup(docs):
    rows, df = docs
    groups = collections.defaultdict(list)
    for r in rows:
        groups["".join(WORD.findall(r[1] or ""))].append(r)
    want = []
    for key, own in groups.items():
        keep = max(own, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))[0]
        want += [(r[0], keep, len(own), r[0] == keep, hashlib.sha256(key.encode()).hexdigest()) for r in own]
    for support in (exact_dedup.SUPPORT, 0.2):
        got = [tuple(r) for r in exact_dedup.duplicate_groups(df, support=support).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.duplicate_groups(df.limit(0)).count() == 0
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns and left.filter("doc_id is not null").select("doc_id").distinct().count() == sum(1 for w in {w[1] for w in want} if w is not None)


def test_jaccard_join(docs):
    rows, df = docs
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    want = []
    for own in members.values():
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        want += [(rows[i][0], len(sets[i]), least) for i in own]
    assert sorted((tuple(r) for r in jaccard_join.near_duplicates(df).collect()), key=str) == sorted(want, key=str)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    assert jaccard_join.one_of_each(df).columns == df.columns


def test_large_groups_are_walked(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    chain = [(n, " ".join(base[: 60 - n] + [f"x{n}_{i}" for i in range(n)])) for n in range(12)]
    far = [(100 + n, " ".join([*base[:30], *(f"y{n}_{rng.random()}" for _ in range(60))])) for n in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(chain + far, "doc_id long, text string")).collect()}
    assert all(got[100 + n] == 100 + n for n in range(12)) and {got[n] for n in range(9)} == {0}


def test_walks_list_about_as_many_pairs_as_rows(spark, monkeypatch):
    """Forty near copies, of which no link is known before the walk, and twenty texts that share most of their words."""
    monkeypatch.setattr(jaccard_join, "SMALL", 1)
    monkeypatch.setattr(jaccard_join, "_possible", lambda pairs, known: pairs.limit(0))
    base = [f"w{i}" for i in range(300)]
    copies = [(n, " ".join([*base, *(f"x{n}_{i}" for i in range(3 + n % 4))])) for n in range(40)]
    apart = [(100 + n, " ".join([*(f"y{n}_{i}" for i in range(50)), *base[:250]])) for n in range(20)]
    walked, made = jaccard_join._walked, []

    def walk(*args):
        out = walked(*args).persist()
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_walked", walk)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(copies + apart, "doc_id long, text string")).collect()}
    sets = {n: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for n, t in copies + apart}
    want = {n: n for n in sets}
    for _ in sets:
        want = {a: min(want[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])) for a in sets}
    assert got == want and {got[n] for n in range(40)} == {0}
    assert made and sum(made) <= 10 * len(sets), made


@pytest.mark.parametrize("pairs,marks", [(1, 32), (1, 1), (3, 2)])
def test_walks_leave_no_pair_out(spark, monkeypatch, pairs, marks):
    """Rows of a chain, each of which links with few of those that it shares groups with, walked one pair at a time."""
    for name, value in (("SMALL", 1), ("CHUNK", 7), ("PAIRS", pairs), ("MORE", 2), ("MARKS", marks)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join, "_possible", lambda pairs, known: pairs.limit(0))
    words = [f"w{i}" for i in range(260)]
    rows = [(n, " ".join(words[4 * n : 4 * n + 100])) for n in range(40)]
    rows = [r for r in rows if r[0] not in (13, 14, 15, 27)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 96 shingles, of which neighbours d apart share 96 - 4 d: they link up to d = 3
    assert got == {n: 0 if n < 13 else 16 for n, _ in rows}


def test_signature_trees_lose_nothing():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = []
    for k in range(60):
        own = rng.choice(pool, int(rng.integers(1, 700)), replace=False)
        sets.append(own)
        sets.append(np.concatenate([own[: int(len(own) * 0.9)], rng.choice(pool, max(1, len(own) // 12))]))
    sets = [np.unique(s) for s in sets]
    items = [(i, jaccard_join.sketch(s), len(s)) for i, s in enumerate(sets)]
    found = {tuple(sorted(p)) for p in jaccard_join.candidates(items, items)}
    for i in range(len(sets)):
        for j in range(i):
            if jaccard_join.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                assert (j, i) in found
    both = {tuple(sorted(p)) for p in jaccard_join.candidates(items[:50], items[50:])}
    assert both == {p for p in found if p[0] < 50 <= p[1]}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and {x for p in pairs for x in p if p[0] != p[1]} == set(got)
    first, rest = pairs[::2], pairs[1::2]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {r["node"]: r["comp"] for r in joined_components(components(frame(first)), frame(rest)).collect()}
    assert all(got[x] == find(x) for x in got) and {x for p in pairs for x in p if p[0] != p[1]} == set(got)


def test_suffix_dedup(docs, monkeypatch):
    rows, df = docs
    counted = collections.Counter()
    raws = [(r[1] or "").encode() for r in rows]
    for t in raws:
        counted.update(t[i : i + 200] for i in range(len(t) - 199))
    want = []
    for r, t in zip(rows, raws, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if counted[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((r[0], len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    assert any(w[2] for w in want)
    assert sorted((tuple(r) for r in suffix_dedup.without_repeats(df).collect()), key=str) == sorted(want, key=str)
    for group in (1, 3):  # groups that are split, down to windows that all members share
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        assert sorted((tuple(r) for r in suffix_dedup.without_repeats(df).collect()), key=str) == sorted(want, key=str)
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_merged_transforms():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(30)] + [b"", b"a", b"abab" * 5]
    places = collections.Counter(s[i : i + 6] for s in strings for i in range(len(s) - 5))
    shards = [strings[:7], strings[7:8], strings[8:]]
    got = [x.tolist() for shard in suffix_dedup.merged_repeats(shards, 6) for x in shard]
    assert got == [[i for i in range(len(s) - 5) if places[s[i : i + 6]] > 1] for s in strings]
    base = bytes(rng.randrange(256) for _ in range(700))
    strings = [base[a : a + rng.randint(0, 300)] for a in (rng.randrange(600) for _ in range(25))] + [b"\0" * 90, b"\xff\0" * 40]
    for length in (7, 8, 15, 24, 31, 50, 56, 72, 75):
        places = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        got = [x.tolist() for shard in suffix_dedup.merged_repeats([strings[:9], strings[9:]], length) for x in shard]
        assert got == [[i for i in range(len(s) - length + 1) if places[s[i : i + length]] > 1] for s in strings], length
    text = np.frombuffer(b"banana\0bandana\0", np.uint8).astype(np.uint16) + 1
    ends = np.array([6, 14])
    text[ends] = 0
    key = [[(int(c), i if c == 0 else 0) for i, c in zip(range(k, 15), text[k:], strict=True)] for k in range(15)]
    key = [x[: next(i for i, c in enumerate(x) if c[0] == 0) + 1] for x in key]
    assert suffix_dedup.suffix_order(text, ends).tolist() == sorted(range(15), key=lambda k: key[k])


def tokenizer(name):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


ODD = ["", "  ", "a\x85b", "x\x1cy z", "<|endoftext|>hi <|startoftext|>Ab", "ΑΣ ΣΑΣ. İstanbul ǅ ß", "don't I'LL 12345 ½²³ ①", "日本語", "a​b　c d", "'s't're", "zz" * 3000, "a\n\nb", "a\nb c.\nD", "x \ny", "été, Ünï! a..b"]


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    spec = open(path, encoding="utf-8").read()
    theirs, ours = Tokenizer.from_file(path), bpe.WordBpe(spec)
    for text in ODD:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids string")
    for r in bpe.encoded(df, spec, full=True).collect():
        ids = theirs.encode([*ODD, ""][r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    texts = [*ODD, None, "ab cd, ef." * 200]
    rows = [(i * 3 % 40, t, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    at, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    token_store.write_tokens(df, path, str(tmp_path / "store"))
    assert sorted(tuple(r) for r in token_store.read_tokens(spark, str(tmp_path / "store")).collect()) == sorted(want)
    token_store.write_tokens(df.limit(0), path, str(tmp_path / "none"))
    assert token_store.read_tokens(spark, str(tmp_path / "none")).count() == 0
    ids = np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint32)
    for bits in (True, False):
        assert (token_store.unpack(token_store.pack(ids, 64, bits)) == ids).all()
    assert len(token_store.unpack(token_store.pack(ids[:0]))) == 0
    with pytest.raises(ValueError):
        token_store.unpack(token_store.pack(ids)[:-1])


def files_of(stored):
    out, at = [], 0
    while at < len(stored):
        size = 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(stored[at : at + size])
        at += size
    return out


def test_webp_round_trip(spark):
    texts = ["", "abc", "é" * 500, None, "abc", "y" * 1_000_000, "the cat sat on the mat. " * 700]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "abc", "z")], "doc_id long, text string, media string")
    rows = sorted(media.media(df, full=True).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    for r, t in zip(rows, [*texts, "abc"], strict=True):
        raw = (t or "").encode()
        full = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        # the general decoder reads what the lanes wrote
        assert b"".join(webp.decode_webp(f)[..., 1:].tobytes() for f in files_of(r["media"])) == full
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert rows[1][1:] == rows[4][1:] == rows[7][1:]
    assert media.media(df.limit(0)).count() == 0


def test_webp_lanes_use_what_the_format_offers():
    rng = np.random.default_rng(1)
    prose = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "and", "run"], 900)).encode()
    prose = prose[: len(prose) // 192 * 192]
    grey = np.repeat(rng.integers(0, 256, 64 * 32, dtype=np.uint8), 3).tobytes()  # green explains red and blue
    few = rng.integers(0, 12, 64 * 40).astype(np.uint8).repeat(3).tobytes()
    noise = [rng.integers(0, 256, 192 * k, dtype=np.uint8).tobytes() for k in (1, 2, 31, 32, 33)]
    skewed = (rng.geometric(0.5, 192 * 32) - 1).astype(np.uint8).tobytes()  # rare symbols get the longest codes
    payloads = [prose, grey, few, skewed, *noise]
    stored = media.store(payloads)
    assert media.load(stored) == payloads
    assert len(stored[0]) < len(prose) / 2 and len(stored[1]) < len(grey) / 2 and len(stored[2]) < len(few) / 4
    streams = [f[20:] for x in stored for f in files_of(x)]
    found = [b""] * len(streams)
    plain = webp_lanes._decode_lanes(streams, found)
    owners = [k for k, x in enumerate(stored) for _ in files_of(x)]
    assert [bool(p) for p in plain] == [k != 2 for k in owners]  # palettes are for the general decoder
    assert streams[owners.index(1)][5] & 7 == 0b101 and streams[owners.index(0)][5] & 1 == 0  # subtract green, none
    seen = collections.Counter()
    original = webp._extra
    try:
        webp._extra = lambda b, s: (seen.update(["copy"]), original(b, s))[1]
        webp.decode_vp8l(streams[owners.index(0)])
    finally:
        webp._extra = original
    assert seen["copy"] > 20
    # any counts give complete codes
    for _ in range(50):
        counts = rng.integers(0, 2, (7, 300)) * rng.integers(0, 10 ** rng.integers(1, 7), (7, 300))
        lengths = webp_lanes.code_lengths(counts)
        assert webp_lanes.whole_code(lengths, webp_lanes.LONGEST).all() and ((lengths > 0) | (counts == 0)).all()


def test_webp_of_another_encoder():
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")  # a public one-pixel file
    assert webp.decode_webp(data).shape == (1, 1, 4) and webp_lanes.decoded([data]) == [webp.decode_webp(data)[..., 1:].tobytes()]


class Writer:
    """Collects bits, the least significant first."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, value, n):
        self.value |= value << self.n
        self.n += n


class Lossless:
    """Writes a VP8L stream bit by bit, with simple prefix codes of one or two symbols."""

    def __init__(self, width, height):
        self.w = Writer()
        self.w.put(0x2F, 8)
        self.w.put(width - 1, 14)
        self.w.put(height - 1, 14)
        self.w.put(1, 1)
        self.w.put(0, 3)

    def simple(self, *symbols):
        self.w.put(1, 1)
        self.w.put(len(symbols) - 1, 1)
        self.w.put(1, 1)
        for s in symbols:
            self.w.put(s, 8)

    def done(self):
        return self.w.value.to_bytes((self.w.n + 7) // 8 + 8, "little")


def flat(s, green=0, red=0, blue=0, alpha=255):
    """An image inside the stream whose pixels are all one colour: no cache, five codes of one symbol."""
    s.w.put(0, 1)
    for x in (green, red, blue, alpha, 0):
        s.simple(x)


def test_webp_predictors_and_transforms():
    # residuals alternate between two greens; predictor mode m, the same for the whole image
    width, height = 5, 4
    pattern = [1, 0, 1, 1, 0] * height
    for mode in range(14):
        s = Lossless(width, height)
        s.w.put(1, 1)
        s.w.put(0, 2)
        s.w.put(7, 3)  # blocks of 512: one mode
        flat(s, green=mode)
        s.w.put(0, 1)
        s.w.put(0, 2)  # no cache, one group
        s.simple(3, 200)
        s.simple(7)
        s.simple(9)
        s.simple(0)
        s.simple(0)
        for bit in pattern:
            s.w.put(bit, 1)
        got = webp.decode_vp8l(s.done()).astype(int)
        back = np.zeros((height, width, 4), int)
        for y in range(height):
            for x in range(width):
                left, up = back[y, x - 1], back[y - 1, x]
                corner = back[y - 1, x - 1]
                right = back[y - 1, x + 1] if x + 1 < width else back[y, 0]
                half = lambda a, b: (a + b) // 2
                black = np.array([255, 0, 0, 0])
                if y == 0:
                    guess = black if x == 0 else left
                elif x == 0:
                    guess = up
                elif mode == 11:
                    p = left + up - corner
                    guess = left if abs(p - left).sum() < abs(p - up).sum() else up
                elif mode == 12:
                    guess = np.clip(left + up - corner, 0, 255)
                elif mode == 13:
                    a = half(left, up)
                    guess = np.clip(a + np.trunc((a - corner) / 2).astype(int), 0, 255)
                else:
                    guess = [black, left, up, right, corner, half(half(left, right), up), half(left, corner), half(left, up), half(corner, up), half(up, right), half(half(left, corner), half(up, right))][mode]
                back[y, x] = (np.array([0, 7, [3, 200][pattern[y * width + x]], 9]) + guess) % 256
        assert (got == back).all(), mode


def test_webp_colour_transforms_palette_cache_and_references():
    # cross-colour with red_to_blue 32, green_to_blue -16, green_to_red 64; then subtract green
    s = Lossless(2, 1)
    s.w.put(1, 1)
    s.w.put(1, 2)
    s.w.put(0, 3)
    flat(s, green=240, red=32, blue=64)
    s.w.put(1, 1)
    s.w.put(2, 2)
    s.w.put(0, 1)
    s.w.put(0, 2)
    for c in ((10, 250), (7,), (9,), (255,), (0,)):
        s.simple(*c)
    s.w.put(0, 1)
    s.w.put(1, 1)
    signed = lambda v: v - 256 if v > 127 else v
    want = []
    for green in (10, 250):
        red, blue = (7 + green) % 256, (9 + green) % 256
        red2 = (red + (64 * signed(green) >> 5)) % 256
        blue2 = (blue + (-16 * signed(green) >> 5) + (32 * signed(red2) >> 5)) % 256
        want.append([255, red2, green, blue2])
    assert webp.decode_vp8l(s.done())[0].tolist() == want
    # a palette of two colours: eight pixels share a byte
    s = Lossless(10, 1)
    s.w.put(1, 1)
    s.w.put(3, 2)
    s.w.put(1, 8)
    s.w.put(0, 1)
    for c in ((5, 20), (6,), (7,), (255,), (0,)):
        s.simple(*c)
    s.w.put(0, 1)
    s.w.put(1, 1)
    s.w.put(0, 1)
    s.w.put(0, 2)
    for c in ((0b10110001, 0b01), (0,), (0,), (255,), (0,)):
        s.simple(*c)
    s.w.put(1, 1)  # the larger of the two symbols comes second
    s.w.put(0, 1)
    got = webp.decode_vp8l(s.done())[0, :, 2].tolist()
    one, two = 5, 25
    assert got == [two if b == "1" else one for b in "10001101" + "10"]
    # a back-reference and the colour cache: green code of four symbols of 2 bits: 11, 22, a length of 3 (258), cache entry k
    key = (webp.CACHE_FACTOR * (255 << 24 | 1 << 16 | 11 << 8 | 2) & 0xFFFFFFFF) >> 30
    s = Lossless(7, 1)
    s.w.put(0, 1)
    s.w.put(1, 1)
    s.w.put(2, 4)
    s.w.put(0, 1)
    lengths = [0] * (256 + 24 + 4)
    for x in (11, 22, 258, 280 + key):
        lengths[x] = 2
    s.w.put(0, 1)  # a normal code: lengths by code 0 -> 0 (1 bit), 2 (1 bit)
    order = webp.CODE_LENGTH_ORDER
    upto = max(order.index(0), order.index(2)) + 1
    s.w.put(upto - 4, 4)
    for x in order[:upto]:
        s.w.put(1 if x in (0, 2) else 0, 3)
    s.w.put(0, 1)
    for n in lengths:
        s.w.put(1 if n else 0, 1)
    for c in ((1,), (2,), (255,)):
        s.simple(*c)
    s.simple(1)  # distance code 2: the pixel to the left
    first_bits = lambda k: s.w.put(int(f"{k:02b}"[::-1], 2), 2)
    first_bits(0)  # 11
    first_bits(1)  # 22
    first_bits(2)  # three more of the pixel to the left
    first_bits(3)  # 11 again, from the cache
    first_bits(1)
    assert webp.decode_vp8l(s.done())[0, :, 2].tolist() == [11, 22, 22, 22, 22, 11, 22]
    with pytest.raises(ValueError):
        webp.decode_vp8l(s.done()[:20])


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, "ab", "y"), (1, "other", "z"), (3, "other  ", "z"), (None, "n", "u"), (None, "n", "u"), (1, "ab", "w"), (4, "only", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "a b", "x"), (3, "other  ", "z"), (None, "n", "u"), (4, "only", None)], key=str)


def test_html(spark):
    page = """<html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head><body class="page"><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><header><h2>Site</h2></header><div class="ad">Buy</div>
    <article><h1>The &amp; title</h1><p><b>First   para<br>goes on.<p>Second&nbsp;one <a href=x>link</a>.</p><form>Name</form><ul><li>one<li>two</ul><!-- no --><aside>side</aside>
    <table><tr><td>cell</table></article><section id="comments"><article class="comment"><p>A very long comment that goes on and on, longer than the article itself by far, really.</p></article></section>
    <div class="sidebar">x</div><footer>&copy; me</footer></body></html>"""
    want = "The & title\nFirst para goes on.\nSecond one link.\none\ntwo\ncell"
    assert html_text.extract(page) == want
    soup = "<div id=top><a href=1>a</a> <a href=2>b</a></div><div><h1>Head</h1><p>" + "Plain words of the article. " * 5 + "</p><p>More of it here, too.</p></div><div class=Footer>end</div>"
    assert html_text.extract(soup) == "Head\n" + "Plain words of the article. " * 4 + "Plain words of the article.\nMore of it here, too."
    for odd in ("", "<", "plain", "<p", "</div></p>", "<div>" * 3000 + "x", "<a href='>x", "<!-- never closed", "<script>no end", "&amp;&#x41;&bogus;"):
        html_text.extract(odd)
    df = spark.createDataFrame([(1, None, page, "z"), (1, "u", None, "z"), (None, "u", "plain", "z")], "page_id long, url string, html string, text string")
    rows = sorted(html_text.main_text(df).collect(), key=str)
    assert [(r["text"], r["n_chars"]) for r in rows] == [("", 0), (want, len(want)), ("plain", 5)]


def test_html_keeps_an_article_in_a_node_of_any_name():
    text = "<h2>Title</h2>" + "".join(f"<p>Sentence {i} of the article, with enough words to count as its text.</p>" for i in range(6))
    want = html_text.extract(f"<body><div>{text}</div></body>")
    assert want.startswith("Title\nSentence 0")
    around = "<div class='sidebar'><p>Other things to read.</p></div><div id='cookie-notice'>We use cookies</div>"
    for names in ("class='content has-sidebar'", "class='no-sidebar'", "class='with-banner'", "id='page-widget-area'", "class='pageWidgetArea'", "class='social post'"):
        assert html_text.extract(f"<body><div {names}>{text}</div>{around}</body>") == want, names
        assert html_text.extract(f"<body><div {names}><article>{text}</article></div>{around}</body>") == want, names
        assert html_text.extract(f"<body><h1>Site</h1><div {names}><main>{text}</main></div>{around}</body>") == want, names
    # names still remove what isn't the article, however long, inside such a wrapper too
    talk = "<div id='comments'>" + "<p>A comment that is longer than any sentence of the article itself, by quite a few words.</p>" * 20 + "</div>"
    cards = "<div class='related'><article class='card'><p>A teaser of something else.</p></article></div>"
    for names in ("", "id='page-widget-area'"):
        assert html_text.extract(f"<body><div {names}><article>{text}{cards}</article>{talk}</div>{around}</body>") == want
        assert html_text.extract(f"<body><div {names}>{text.replace('h2', 'h1')}</div>{talk}{around}</body>") == want


def test_html_names_remove_nothing_from_an_article_without_links():
    text = [f"Sentence {i} of the article, with enough words to count as its text." for i in range(6)]
    for names in ("social-history", "related-work", "widget", "share", "banner", "notice", "disclaimer", "overlay"):
        for tag in ("p", "div"):
            for top in ("article", "div"):
                page = f"<body><nav><a href=x>Home</a></nav><{top}><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in text[:3]) + f"<{tag} class='{names}'>{text[3]}</{tag}><p>{text[4]}</p></{top}></body>"
                assert html_text.extract(page) == "\n".join(["Title", *text[:5]]), (names, tag, top)
    links = "<div class='related'>Read <a href=1>one more thing</a> <a href=2>and another</a></div><ul class='share'><li><a href=3>Post</a></ul>"
    page = "<body><article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in text) + f"{links}</article></body>"
    assert html_text.extract(page) == "\n".join(["Title", *text])


def plain_density(page_nodes, body_share):
    """The density sum of every node by direct recursion over the tree, for pages without named or removed nodes."""

    def text_of(node):
        return "".join("".join(x.split()) if isinstance(x, str) else text_of(x) for x in node.items)

    def under(node):
        return [y for x in node.items if not isinstance(x, str) for y in (x, *under(x))]

    def linked(node, inside=False):
        inside = inside or node.tag == "a"
        return sum((len("".join(x.split())) if inside else 0) if isinstance(x, str) else linked(x, inside) for x in node.items)

    def dense(node):
        c, lc = len(text_of(node)), linked(node)
        if not c:
            return 0.0
        t, lt = max(len(under(node)), 1), max(sum(x.tag == "a" for x in under(node)), 1)
        scale = max(math.log(math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)), 1.0)
        return c / t * math.log(1 + c / max(lc, 1) * t / lt) / scale

    return {id(n): sum(dense(x) for x in n.items if not isinstance(x, str)) for n in page_nodes}


def test_html_density_against_brute_force(monkeypatch):
    rng = random.Random(5)

    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join("word" * rng.randint(1, 2) for _ in range(rng.randint(1, 40)))
            return f"<a href=x>{words}</a>" if rng.random() < 0.25 else f"<p>{words} <a href=y>link</a></p>" if rng.random() < 0.3 else f"<p>{words}</p>"
        return "<div>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 5))) + "</div>"

    changed = 0
    for _ in range(60):
        page = "<body>" + "".join(block(3) for _ in range(3)) + "</body>"
        tree = html_text.Weighed(html_text.parse(page))
        share = tree.links[0]
        want = plain_density(tree.nodes, share)
        assert all(math.isclose(want[id(n)], t, rel_tol=1e-9, abs_tol=1e-12) for n, t in zip(tree.nodes, tree.total, strict=True))
        # what is returned holds the node of the largest sum, with all its text
        best = max(range(len(tree.nodes)), key=lambda k: (tree.total[k], -k))
        got = html_text.extract(page)
        assert "\n".join(html_text.blocks(tree.nodes[best], set())) in got
        with monkeypatch.context() as without:
            without.setattr(html_text, "density", lambda *_: 1.0)
            changed += html_text.extract(page) != got
    assert changed > 20  # densities decide


def test_html_density_chooses_between_nodes_of_no_name():
    menu = "<div>" + "".join(f"<div><a href={i}>Entry number {i}</a></div>" for i in range(30)) + "</div>"
    teasers = "<div>" + "".join(f"<div><a href={i}>Teaser {i}</a><span>short</span></div>" for i in range(12)) + "</div>"
    text = [f"Paragraph {i} runs on for a good while and says something, as paragraphs of an article do." for i in range(5)]
    page = f"<body>{menu}<div><h2>The title</h2>" + "".join(f"<p>{x}</p>" for x in text) + f"</div>{teasers}</body>"
    assert html_text.extract(page) == "\n".join(["The title", *text])


def test_html_takes_linear_time():
    for page in ("<b>" * 60_000 + "</i>" * 60_000, "<b>" * 30_000 + "<p></p>" * 30_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000):
        start = time.process_time()
        html_text.extract(page)
        assert time.process_time() - start < 15
    words = "many words " * 200_000
    assert html_text.extract(f"<article><p>{words}</p></article>") == words.strip()


def test_html_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", 1)] * 3, "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in html_text.main_text(df).collect()] == [(1, "u", "x", 1)] * 3
    assert html_text.main_text(df.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), f"src{rng.choice([0, 0, 0, 1, 2, 5])}", "z") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies string")
    weights = {"domain": {"dom0": 3}, "lang": {"en": 2, "de": 0}}
    got = mixing.mixture(df, weights, 80, 2, 7).collect()
    assert len(got) == 600
    total = sum(r["n_tokens"] for r in got)
    leaves = collections.defaultdict(list)
    for r in got:
        leaves[r["domain"], r["lang"], r["source"]].append(r)
    budgets = 0
    for (_, lang, _), own in leaves.items():
        supply, budget = sum(r["n_tokens"] for r in own), own[0]["leaf_budget"]
        budgets += budget
        assert own[0]["leaf_supply"] == supply and budget <= 2 * supply and (lang != "de" or budget == 0)
        taken = sum(r["n_tokens"] * r["copies"] for r in own)
        assert taken <= budget
        whole = budget // supply if supply else 0
        order = sorted(own, key=lambda r: (hashlib.md5(f"7/{whole}/{r['doc_id']}".encode()).hexdigest(), r["doc_id"]))
        upto = 0
        for r in order:
            upto += r["n_tokens"]
            assert r["copies"] == whole + (upto <= budget - whole * supply)
    assert budgets <= total * 80 // 100
    # what a short sibling can't use goes to its siblings first
    leaf = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("b", "x", "3", 1000)], "domain string, lang string, source string, supply long")
    found = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaf, {}, 50, 1).collect()}
    assert found == {"1": 10, "2": 492, "3": 502} or sum(found.values()) == 1005 and found["1"] == 10 and found["3"] in (502, 503)
    assert mixing.mixture(df.limit(0), weights, 80, 2, 7).count() == 0
    assert mixing.mix(df, weights, 80, 2, 7).columns == df.columns
    assert mixing.mix(df, weights, 80, 2, 7).count() == sum(r["copies"] for r in got)
    # rows with one id are documents of their own; repeated rows and null texts count one by one
    rows = [(1, "a b c", "en", "src1"), (1, "a b c", "en", "src2"), (2, "d", "en", "src1"), (2, "d", "en", "src1"), (None, None, None, None), (3, None, "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    half = {"source": {"src2": 0}}
    got = collections.Counter()
    for r in mixing.mixture(df, half, 100, 2, 3).collect():
        got[r["doc_id"], r["source"]] += r["copies"]
    assert got[1, "src2"] == 0 and got[1, "src1"] > 0
    assert collections.Counter((r["doc_id"], r["source"] or "") for r in mixing.mix(df, half, 100, 2, 3).collect()) == +got


def test_quality():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(900)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(60)) for _ in range(180)] + [" ".join(w for w in rng.sample(words, 5) for _ in range(10)) for _ in range(180)]
    texts = good + bad
    labels = np.array([1] * 900 + [0] * 360)
    order = np.random.default_rng(0).permutation(1260)
    model = quality.fit([texts[i] for i in order[:1000]], labels[order[:1000]])
    rows = model.reader()
    scores = model.scores(np.stack([model.inputs(texts[i], rows) for i in order[1000:]]))
    assert ((scores >= 0.3) == labels[order[1000:]]).mean() > 0.95
    assert 0 <= model.scores(model.inputs("", rows)[None])[0] <= 1
    for few in ([], ["a"]):
        alone = quality.fit(few, np.ones(len(few), int))
        assert 0 < alone.scores(alone.inputs("a b", alone.reader())[None])[0] < 1


def test_quality_reads_long_words_whole():
    good, bad = "abc,def;" * 40, "abc,def;" * 10 + "#1!" * 80
    for word in (good, bad, "字" * 1000, "a" * 64 + "B", "####" * 50, "http://www.Some-where.org/a/b?c=1"):
        cut = quality.pieces(word)
        assert "".join(cut) == word and all(len(x) <= 64 and len(quality.shape(x)) <= 9 for x in cut)
    assert quality.pieces("Plain.") == ("Plain.",)
    model = quality.fit([good, bad] * 20, np.array([1, 0] * 20))
    rows = model.reader()
    scores = [model.scores(model.inputs(x, rows)[None])[0] for x in (good, bad)]
    assert scores[0] > 0.8 and scores[1] < 0.2


def test_quality_over_tables(spark):
    rows = [(i, "fine words here " * 5 if i % 3 else "BAD!! " * 20, "z") for i in range(90)] + [(None, None, "z"), (1, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == 92 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] % 3 for r in kept.filter("text <> '' and doc_id is not null").collect()} == {1, 2}


def test_language_models(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 40))), "z") for i in range(60)] + [(None, None, "z"), (3, "aa bb", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    target = df.filter("doc_id < 20").select("doc_id")
    words = lm_score.vocabulary(df, most=6)
    counted = collections.Counter(w for r in rows for w in (r[1] or "").split())
    assert words == [w for w, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:6]]
    models = lm_score.count(df, target, words, 1 << 12)
    ids = {w: k + 1 for k, w in enumerate(words)}
    uni, bi = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for doc, text, _ in rows:
        line = [ids.get(w, 0) for w in (text or "").split()]
        for which in (0, 1) if doc is not None and doc < 20 else (0,):
            uni[which].update(line)
            bi[which].update(lm_score.slots(np.array(line[:-1]), np.array(line[1:]), 1 << 12).tolist())
    for which in (0, 1):
        assert models.unigrams[which].tolist() == [uni[which][k] for k in range(len(words) + 1)]
        assert {int(k): int(models.bigrams[which][k]) for k in np.flatnonzero(models.bigrams[which])} == dict(bi[which])
    got = sorted((tuple(r) for r in lm_score.difference(df, models).collect()), key=str)
    want = []
    for doc, text, _ in rows:
        line = [ids.get(w, 0) for w in (text or "").split()]
        loss = []
        for which in (1, 0):
            total = 0.0
            for k, w in enumerate(line):
                p = (uni[which][w] + 0.5) / (sum(uni[which].values()) + 0.5 * (len(words) + 1))
                if k and uni[which][line[k - 1]]:
                    slot = int(lm_score.slots(np.array([line[k - 1]]), np.array([w]), 1 << 12)[0])
                    p = 0.7 * min(bi[which][slot], uni[which][line[k - 1]]) / uni[which][line[k - 1]] + 0.3 * p
                total -= np.log2(p)
            loss.append(total / len(line) if line else 0.0)
        want.append((doc, len(line), loss[0], loss[1], loss[0] - loss[1]))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and np.allclose(g[2:], w[2:])


def test_language_models_count_exactly_at_any_size(spark):
    """More words than a vocabulary of 65,535 and more pairs than 2^20 slots: none share a count."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**7) if rng.random() < 0.8 else rng.randrange(40)}" for _ in range(20_000)), "z") for i in range(70)]
    rows += [(70 + i, " ".join(rng.choice("abcd") for _ in range(30)), "z") for i in range(20)] + [(None, None, "z"), (75, "a", "z"), (None, " \n", "z"), (76, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    target = spark.createDataFrame([(i,) for i in (0, 3, 72, 75, 75, None, 999)], "doc_id long")
    uni, bi = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for doc, text, _ in rows:
        line = (text or "").split()
        for which in (0, 1) if doc in (0, 3, 72, 75) else (0,):
            uni[which].update(line)
            bi[which].update(zip(line, line[1:]))
    assert len(uni[0]) > 65_535 and len(bi[0]) > 1 << 20
    size, total = len(uni[0]), [sum(u.values()) for u in uni]
    want = []
    for doc, text, _ in rows:
        line = (text or "").split()
        loss = []
        for which in (1, 0):
            bits = 0.0
            for k, w in enumerate(line):
                p = (uni[which][w] + 0.5) / (total[which] + 0.5 * size)
                if k and (seen := uni[which][line[k - 1]]):
                    p = 0.7 * bi[which][line[k - 1], w] / seen + 0.3 * p
                bits -= np.log2(p)
            loss.append(bits / len(line) if line else 0.0)
        want.append((doc, len(line), loss[0], loss[1], loss[0] - loss[1]))
    got = sorted((tuple(r) for r in lm_score.lm_scores(df, target).collect()), key=lambda r: (str(r[0]), r[1]))
    for g, w in zip(got, sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True):
        assert g[:2] == w[:2] and np.allclose(g[2:], w[2:])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(60)]
    texts += texts[:5] + [t + " extra" for t in texts[5:10]] + ["JUNK!! " * 30] * 15
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 70), 0) for i in range(0, 85)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mixture", "tokens"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r["doc_id"] for r in docs.collect()}
    assert left["quality"] == set(range(70)) and left["exact"] == left["quality"] - set(range(60, 65)) and left["near"] == set(range(60))
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} <= left["near"]


def test_stages_leave_no_caches_in_workers(spark):
    """Python workers serve one stage of the pipeline after the other; near, whose memory was exceeded, starts without what others cached."""
    spec = open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read()
    rows = [(n, " ".join(f"longerword{n}x{i}" for i in range(40)), "en", "src1", 1) for n in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(16).cache()

    def cached(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(quality.CUT) + len(quality.CUT.old) + len(bpe._LOADED)], pa.int64())})

    assert quality.accepted(df, quality.fit([r[1] for r in rows], np.array([0, 1] * 32))).count() + bpe.encoded(df, spec).agg({"n_tokens": "sum"}).first()[0] > 64
    assert max(r["n"] for r in df.mapInArrow(cached, "n long").collect()) > 0
    assert jaccard_join.one_of_each(df).count() == 64
    assert max(r["n"] for r in df.mapInArrow(cached, "n long").collect()) == 0


def test_every_operator_keeps_odd_rows_and_empty_tables(spark):
    """Null ids and texts, repeated rows, a long text, and columns named like the operators' own; one row out for each row in."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None), (1, None), (None, "a b c d e f"), (None, "a b c d e f"), (2, ""), (3, long), (3, long), (4, "x"), (5, " \n\t")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, key binary, at long, uid string, comp string, hub long, score double, copies long, __key string"
    df = spark.createDataFrame([(*r, None, "src1", 0, 0, b"k", 1, "u", "c", 2, 0.5, 3, "k") for r in rows], schema).repartition(2)
    labels = spark.createDataFrame([(4, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    path = tokenizer("byte_bpe_50k.json")
    spec = open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read()
    operators = {
        "suffix": suffix_dedup.without_repeats,
        "tokens": lambda d: token_store.stored_tokens(d, path),
        "jaccard": jaccard_join.near_duplicates,
        "exact": exact_dedup.duplicate_groups,
        "lm": lambda d: lm_score.lm_scores(d, labels.filter("quality = 1")),
        "bpe": lambda d: bpe.encoded(d, spec),
        "mixing": lambda d: mixing.mixture(d, {}, 50, 2, 1),
        "quality": lambda d: quality.scored(d, quality.train(d, labels)),
        "media": media.media,
    }
    for name, run in operators.items():
        got = run(df).collect()
        assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str), name
        assert run(df.limit(0)).count() == 0, name
    assert exact_dedup.deduplicate(df).columns == jaccard_join.one_of_each(df).columns == mixing.mix(df, {}, 100, 1).columns == df.columns
    left = collections.Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df).collect())
    assert left == {(1, None): 2, (None, "a b c d e f"): 1, (2, ""): 1, (3, long): 1, (4, "x"): 1, (5, " \n\t"): 1}


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None, 0), (1, None, None, None, 0), (None, "one two", "en", "src1", 7), (2, "x " * 50_000, "en", "src1", 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(folder))
        assert "doc_id" in found.columns and found.count() <= 2 * len(data)
