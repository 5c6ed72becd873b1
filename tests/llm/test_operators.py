"""Small cases, brute-force versions and round trips of the training-data operators."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, graph, html_text, jaccard, lines, mixing, mpeg, packing, pitman_yor, topk, toxicity
from tessera.llm.common import table
from tessera.llm.queries import QUERIES, SQL
from tests.oracle import connect, same

CLASHING = ["size", "taken", "rank", "_doc", "_drops", "_bits", "_made", "_gone", "_copies", "_copy", "_row", "_kept_text", "_n_lines", "_n_dropped", "doc_key", "id", "root", "copies"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in CLASHING)
FIRST = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def documents(spark):
    """Nulls in all columns, empty and blank and long texts, repeated rows, ties, columns with clashing names."""
    rows = [(1, FIRST, "en", "a", 1), (2, FIRST + " phi", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t", "en", "b", 3), (6, FIRST, "en", None, 1), (6, FIRST, "en", None, 1), (None, "a line that is long enough\nshort", "en", "b", 1)]
    rows += [(i, f"a line that is long enough\nown words {i} of this one\n", "en", "c", 1) for i in range(7, 11)] + [(20, "word " * 30_000, "en", "c", 1)]
    return spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 11)], "doc_id long, quality int, toxic int")


def test_work_dir_is_shared(monkeypatch, spark):
    class Session:
        def __init__(self, master):
            self.conf = {"spark.master": master}

    with pytest.raises(RuntimeError):
        common.work_dir(Session("spark://host:7077"))
    assert common.private(["a", "_A"], "a", "b") == ["__a", "b"]


# 1 MPEG audio


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_mpeg_round_trip(n):
    for data in (random.Random(n).randbytes(n), b"\xff\xfa\xc4\xc0" * (n // 4), b"\xff" * n):
        stream = mpeg.encode(data)
        found = mpeg.index(stream)
        assert mpeg.decode(stream, found) == mpeg.pad(data)
        assert found["lost"] == found["crc_bad"] == 0 and found["vbr"]["frames"] == len(found["offsets"])
        assert found["samples"] == 1152 * len(found["offsets"]) and found["hertz"] == 48000
        assert found["tags"]["TENC"] == b"\x03lossless"


def test_mpeg_stores_the_padding():
    assert b"abc" + b"\xff" * 573 in mpeg.encode(b"abc") and b"\xff" * 576 in mpeg.encode(b"")


def bit_crc(bits):
    value = 0xFFFF
    for bit in bits:
        top = value >> 15 ^ bit
        value = value << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return value


def plain_bits(data):
    return [b >> i & 1 for b in data for i in range(7, -1, -1)]


@pytest.mark.parametrize(
    ("third", "fourth", "allocation"),
    [
        (0xFE, 0xC4, [4] * 32), (0xFE, 0x04, [4] * 64), (0xFE, 0x54, [4] * (2 * 8 + 24)),  # Layer I: mono, stereo, joint from 8
        (0xFC, 0x04, [4] * 22 + [3] * 24 + [2] * 8), (0xFC, 0xC4, [4] * 11 + [3] * 12 + [2] * 4), (0xFC, 0x44, [4] * (2 * 4 + 7) + [3] * 12 + [2] * 4),  # Layer II, table a
        (0xF4, 0xC4, [4] * 4 + [3] * 7 + [2] * 19),  # half the sample rate
    ],
)
def test_mpeg_checksums_of_layers_one_and_two(third, fourth, allocation):
    draw = random.Random(third * 256 + fourth)
    head = bytes((0xFF, third, 0x94, fourth))  # 48 or 24 kHz; 128 kbit/s or more for two channels
    layer, size = mpeg.header(head)[1], mpeg.header(head)[3]
    frames = []
    for _ in range(5):
        bits, pairs = [], []
        lone = 2 * 8 if fourth == 0x54 else 2 * 4 if fourth == 0x44 else None
        for i, n in enumerate(allocation):
            value = draw.randrange(1 << n)
            bits += [value >> k & 1 for k in range(n - 1, -1, -1)]
            pairs.append(0 if not value else 1 if lone is None or i < lone else 2)
        if layer == 2:
            bits += [draw.randrange(2) for _ in range(2 * sum(pairs))]
        held = bit_crc(plain_bits(head[2:]) + bits)
        body = bits + [draw.randrange(2) for _ in range(8 * (size - 6) - len(bits))]
        raw = bytes(sum(b << (7 - k) for k, b in enumerate(body[i : i + 8])) for i in range(0, len(body), 8))
        frames.append(head + held.to_bytes(2, "big") + raw)
    assert all(mpeg.checksum_holds(f) for f in frames)
    assert not any(mpeg.checksum_holds(f[:6] + bytes((f[6] ^ 16,)) + f[7:]) for f in frames) or layer == 2
    found = mpeg.index(b"".join(frames))
    assert (len(found["offsets"]), found["crc_good"], found["crc_bad"]) == (5, 5, 0)
    wrong = b"".join(frames[:2]) + frames[2][:4] + bytes((frames[2][4] ^ 1,)) + frames[2][5:] + b"".join(frames[3:])
    assert (mpeg.index(wrong)["crc_good"], mpeg.index(wrong)["crc_bad"]) == (4, 1)


def test_mpeg_resynchronises():
    stream = mpeg.encode(random.Random(1).randbytes(6000))
    at = mpeg.index(stream)["offsets"]
    damaged = stream[: at[3]] + b"\xff\xfbjunk\xff" * 9 + stream[at[3] :]
    found = mpeg.index(damaged)
    assert len(found["offsets"]) == len(at) and found["lost"] == 63 and found["offsets"][3] == at[3] + 63
    broken = bytearray(stream)
    broken[at[2] + 8] ^= 1
    assert mpeg.index(bytes(broken))["crc_bad"] == 1
    assert len(mpeg.index(stream + b"TAG" + bytes(125))["offsets"]) == len(at)
    assert mpeg.index(b"")["offsets"] == [] and mpeg.index(b"\xff" * 500)["offsets"] == []


def test_mpeg_tags_in_the_payload():
    ape = lambda size, flags: b"APETAGEX" + b"\xd0\x07\0\0" + size.to_bytes(4, "little") + bytes(4) + flags.to_bytes(4, "little") + bytes(8)
    id3v1 = b"TAG" + bytes(125)
    for n in (150, 300, 571, 576, 1000, 1152, 1700):
        plain = mpeg.encode(b"x" * n)
        frames = len(mpeg.index(plain)["offsets"])
        last = len(plain) - mpeg.index(plain)["offsets"][-1]
        for mark in (b"TAG", ape(32, 0), ape(500, 1 << 31), ape(400, 0), ape(last, 0)):
            for place in range(max(0, n - 160), n - len(mark) + 1):
                data = b"x" * place + mark + b"x" * (n - place - len(mark))
                stream = mpeg.encode(data)
                found = mpeg.index(stream)
                assert mpeg.decode(stream, found) == mpeg.pad(data) and found["lost"] == 0 and "ID3v1" not in found["tags"]
        body = b"x" * 40
        for tail in (id3v1, ape(72, 0), body + ape(72, 0), ape(72, 1 << 31 | 1 << 29) + body + ape(72, 1 << 31), body + ape(72, 0) + id3v1, ape(72, 1 << 31 | 1 << 29) + body + ape(72, 1 << 31) + id3v1):
            found = mpeg.index(plain + tail)
            assert len(found["offsets"]) == frames and ("ID3v1" in found["tags"]) == tail.endswith(id3v1)
            if tail != ape(72, 0):
                assert found["lost"] == 0
        assert len(mpeg.index(plain + b"TAG\xff" + plain[-last:][:100] + bytes(24))["offsets"]) == frames


def test_mpeg_headers():
    assert mpeg.header(b"\xff\xfb\x90\x00")[2:5] == (44100, 417, 1152)
    assert mpeg.header(b"\xff\xfb\x92\x00")[3] == 418
    assert mpeg.header(b"\xff\xf3\x40\xc0")[2:6] == (22050, 104, 576, 9)
    assert mpeg.header(b"\xff\xff\x90\x00")[3:5] == (312, 384)
    for bad in (b"\xff\xe8\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xf9\x90\x00", b"\xff\xfb"):
        assert mpeg.header(bad) is None


def test_mpeg_query(spark):
    rows = mpeg.index_audio(mpeg.store_audio(documents(spark))).collect()
    texts = Counter((r.doc_id, r.text) for r in documents(spark).collect())
    want = Counter()
    for (i, t), n in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += n
    assert want == Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    assert mpeg.index_audio(mpeg.store_audio(nothing(spark))).count() == 0


# 2 mixing


def fill(caps, weights, total):
    share, left = {}, set(caps)
    while True:
        level = (total - sum(share.values())) / sum(weights[k] for k in left) if left else 0
        over = [k for k in left if level * weights[k] > caps[k]]
        if not over:
            return share | {k: level * weights[k] for k in left}
        for k in over:
            share[k] = caps[k]
            left.discard(k)


def test_mix_targets_and_words(spark, small):
    docs = table(spark, small, "documents")
    rows = mixing.mix_documents(docs).collect()
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    names = sorted(sizes)
    want = fill({k: 2.0 * sizes[k] for k in names}, {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, 1.5 * sum(sizes.values()))
    largest = {k: max(r.size for r in rows if r.source == k) for k in names}
    for k in names:
        own = [r for r in rows if r.source == k]
        assert all(abs(r.target - want[k]) < 1e-6 * max(1, want[k]) and r.source_size == sizes[k] and r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - want[k]) <= largest[k] / 2 + 1


def test_targets_of_many_sources(spark):
    draw = random.Random(8)
    sizes = {f"s{draw.random()}": draw.choice((0, 1, 5, 100, 10_000)) for _ in range(3000)}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    names = sorted(sizes)
    want = fill({k: 2.0 * sizes[k] for k in names}, {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, 1.5 * sum(sizes.values()))
    got = {r.source: r.target for r in mixing.targets(rows.repartition(7)).collect()}
    assert all(got[k] == pytest.approx(want[k]) for k in names) and len(got) == len(names)


def test_mix_inclusion_is_as_planned(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), "s" if i % 3 else "t") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix_documents(docs, volume=0.5).collect()
    for source in "st":
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) / own[0].target - 1) < 0.002
        taken, count = Counter(), Counter()
        for r in own:
            taken[r.size.bit_length()] += r.copies
            count[r.size.bit_length()] += 1
        rate = {b: taken[b] / count[b] / b for b in count if count[b] > 400}  # expected copies grow with the bit length
        assert max(rate.values()) / min(rate.values()) < 1.35


def test_mix_edges(spark):
    rows = mixing.mix_documents(documents(spark)).collect()
    assert len(rows) == documents(spark).count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.source for r in rows} == {"a", "b", "c", None} and len({r.target for r in rows if r.source is None}) == 1
    assert mixing.mix_documents(nothing(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_documents(blank).collect()] == [0, 0]


# 3 n-gram Jaccard join


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_links(rows, threshold=0.8):
    sets = [(i, grams(t)) for i, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return Counter((i, least[top(k)], links[k]) for k, (i, _) in enumerate(sets))


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jaccard.bands_for(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_jaccard_equals_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    base = [[f"w{draw.randint(0, 5000)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(base[i % 12]) if i % 12 else list(base[0])
        for _ in range(draw.choice((0, 0, 1, 2, 6))):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 5000)}"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(base[0][:-1] + [f"y{i}"])) for i in range(90)]  # a group over the bound of small ones
    rows += [(500, "Two Words"), (501, "two words"), (502, ""), (503, None), (504, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, grams in ((50, 1 << 20), (1024, 300)):  # blocks bounded by rows, then by n-grams
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", grams)
        monkeypatch.setattr(jaccard, "TASK_GRAMS", 10 * grams)
        got = jaccard.join(docs).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)
        assert {r.doc_id: r.copy_of for r in got}[501] == 500


def test_jaccard_of_sizes_at_the_threshold(spark, monkeypatch):
    """Chains in which each text is the next one cut to four fifths: neighbours are linked, whatever size classes they fall into."""
    monkeypatch.setattr(jaccard, "SMALL", 1)
    rows, n = [], 0
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(640 + chain)]
        while len(words) > 24:
            rows.append((n, " ".join(words)))
            words, n = words[: math.ceil(0.8 * (len(words) - 4)) + 4], n + 1
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)


def test_jaccard_links_rows_without_ids(spark):
    other = " ".join(f"word{i}" for i in range(30))
    rows = [(None, FIRST), (None, FIRST), (None, FIRST + " phi"), (9, FIRST + " chi"), (None, other), (None, other + " end"), (9, "quite another text than that of the other nine")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter([(None, 9, 3), (None, 9, 3), (None, 9, 3), (9, 9, 3), (None, None, 1), (None, None, 1), (9, 9, 0)])
    assert len({r.class_key for r in got}) == 3


def test_jaccard_edges(spark):
    got = jaccard.join(documents(spark)).collect()
    assert len(got) == documents(spark).count()
    by = {r.doc_id: r for r in got}
    assert by[1].class_id == by[2].class_id == by[6].class_id == 1 and by[1].n_links == 3 and by[6].copy_of == 1
    assert by[3].n_links == by[4].n_links == by[5].n_links == 0 and by[4].class_id == 4
    assert jaccard.join(nothing(spark)).count() == 0


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


# 4 Pitman-Yor


def tokens_of(text):
    return [*(text or "").encode().lower().split(), 0]


def test_pitman_yor_base_and_fold(spark, small):
    rows = pitman_yor.score_documents(table(spark, small, "documents")).collect()
    texts = {r.doc_id: tokens_of(r.text) for r in table(spark, small, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        words = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), held[r.doc_id], n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    own = [r for r in rows if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def plain_scores(rows, sweeps, burn_in, seed, strength=1.0):
    """A sampler without shortcuts: tables with their sizes, one customer after another taken away and seated anew."""
    draw = random.Random(seed)
    texts = {i: [None, *tokens_of(t)] for i, t in rows}
    pairs = [p for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for p in zip(ws, ws[1:], strict=False)]
    count, words = Counter(pairs), Counter(w for _, w in pairs)
    rate = lambda c: min(0.97, max(0.05, (a := sum(x == 1 for x in c.values())) / max(1, a + 2 * sum(x == 2 for x in c.values()))))
    d, d0, v = rate(count), rate(words), len(words)
    below = {p: [] for p in count}  # sizes of the tables of each pair, then of each word at the parent
    above = {w: [] for w in words}
    opened, guests, parents, root = Counter(), Counter(), [0], [0]

    def parent(w):
        m, s = sum(above.get(w, ())), len(above.get(w, ()))
        return (m - d0 * s + (strength + d0 * root[0]) / (v + 1)) / (strength + parents[0])

    def sit(sizes, opening, discount):
        odds = [max(0, x - discount) for x in sizes] + [opening]
        at = draw.choices(range(len(odds)), odds)[0]
        if at == len(sizes):
            sizes.append(0)
        sizes[at] += 1
        return sizes[at] == 1

    def leave(sizes):
        at = draw.choices(range(len(sizes)), sizes)[0]
        sizes[at] -= 1
        if not sizes[at]:
            sizes.pop(at)
            return True
        return False

    def add(c, w):
        guests[c] += 1
        if sit(below[c, w], (strength + d * opened[c]) * parent(w), d):
            opened[c] += 1
            root[0] += sit(above[w], (strength + d0 * root[0]) / (v + 1), d0)
            parents[0] += 1

    def remove(c, w):
        guests[c] -= 1
        if leave(below[c, w]):
            opened[c] -= 1
            parents[0] -= 1
            root[0] -= leave(above[w])

    for p in pairs:
        add(*p)
    sums = Counter()
    asked = {p for ws in texts.values() for p in zip(ws, ws[1:], strict=False)}
    for sweep in range(sweeps):
        for p in pairs:
            remove(*p)
            add(*p)
        if sweep >= burn_in:
            for c, w in asked:
                own = below.get((c, w), [])
                sums[c, w] += (sum(own) - d * len(own) + (strength + d * opened[c]) * parent(w)) / (strength + guests[c]) / (sweeps - burn_in)
    return {i: sum(math.log10(sums[p]) for p in zip(ws, ws[1:], strict=False)) for i, ws in texts.items()}


def test_pitman_yor_scores_are_those_of_a_plain_sampler(spark):
    draw = random.Random(12)
    rows = [(i, " ".join(draw.choices("a b c d e f g h".split(), [9, 7, 5, 3, 2, 1, 1, 1], k=draw.randint(2, 14))) + " and so on" * (i % 3)) for i in range(60)]
    want = plain_scores(rows, 60, 10, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(docs, sweeps=12, burn_in=2).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=0.02) for i in got)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.005)


def test_tables_are_drawn_from_their_distribution():
    rng = np.random.default_rng(1)
    for n, strength, discount, others, prior in ((2, 1.0, 0.5, 0, 0.3), (5, 1.0, 0.8, 7, 0.1), (12, 0.5, 0.3, 40, 0.02)):
        # the weight of every way to seat n customers at the tables of one dish, by enumeration of table sizes
        ways = Counter()

        def seat(left, sizes, weight, n=n, strength=strength, discount=discount, others=others, prior=prior, ways=ways):
            if not left:
                ways[len(sizes)] += weight
                return
            seen = Counter(sizes)
            for size, k in seen.items():
                rest = list(sizes)
                rest[rest.index(size)] += 1
                seat(left - 1, tuple(sorted(rest)), weight * k * (size - discount))
            seat(left - 1, tuple(sorted((*sizes, 1))), weight * (strength + discount * (others + len(sizes))) * prior)

        seat(n, (), 1.0)
        whole = sum(ways.values())
        got = np.bincount(pitman_yor.draw_tables(np.full(20_000, n), np.full(20_000, others), np.full(20_000, prior), strength, discount, rng), minlength=n + 1) / 20_000
        assert all(abs(got[t] - ways[t] / whole) < 0.015 for t in range(1, n + 1))
    assert pitman_yor.draw_tables(np.array([0, 1]), np.zeros(2), np.ones(2), 1.0, 0.5, rng).tolist() == [0, 1]
    large = pitman_yor.draw_tables(np.array([100, 100_000]), np.zeros(2), np.full(2, 0.1), 1.0, 0.5, rng)
    assert (large >= 1).all() and large[0] <= 100 and large[1] < 10_000


def test_pitman_yor_keys():
    keys = np.asarray([0, 1, (1 << 40) - 1], np.uint64)
    assert pitman_yor._unpacked(pitman_yor._packed(keys, 5), 5).tolist() == keys.tolist()
    assert [pitman_yor.key_width(n) for n in (0, 1000, 1 << 30, 1 << 47, 1 << 62)] == [2, 3, 5, 7, 8]


@pytest.mark.parametrize("size", [0, 10**6, 10**12, 4 * 10**12, 10**14, 10**16])
def test_pitman_yor_plans_any_size(size):
    plan = pitman_yor.Plan(size, 4 << 20, {5: 3}, [])
    assert 1 <= plan.files <= 100_000 and plan.files >= min(plan.pin_slot // 8, 50_000)


def test_pitman_yor_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    scored = pitman_yor.score_documents(documents(spark).filter("length(text) < 1000"), sweeps=1)
    assert {t.name for t in spark.catalog.listTables()} == before and scored.count() > 0


def test_pitman_yor_edges(spark):
    rows = pitman_yor.score_documents(documents(spark)).collect()
    assert len(rows) == documents(spark).count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert pitman_yor.score_documents(nothing(spark)).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    got = pitman_yor.score_documents(held).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0) for r in got) and len(got) > 0


def test_pitman_yor_splits_words_and_pins_pairs(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["the", "the", f"w{draw.randint(0, 300)}", f"w{draw.randint(0, 300)}"]) for _ in range(50))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    size = sum(len(t) for _, t in rows)
    the = pitman_yor.xxhash.xxh3_64_intdigest(b"the")
    found, pins = pitman_yor.frequent(docs, size, size // 10)
    assert set(found) == {the} and found[the] >= 3 and pins == [(the, the)]
    assert pitman_yor.frequent(docs, size, size) == ({}, [])
    told = []
    for slot_bytes, hot in ((1 << 20, ({}, [])), (size // 9, ({the: 3}, [])), (size // 9, ({the: 5}, [(the, the)])), (size // 5, None)):
        scored = pitman_yor.score_documents(docs, slot_bytes=slot_bytes, block_tokens=700, hot=hot, sweeps=0)
        told.append({r.doc_id: r for r in scored.collect()})
        assert len(told[-1]) == 800
    for other in told[1:]:
        for i, r in told[0].items():  # without sweeps nothing is drawn, so all ways to deal the work agree
            assert other[i][1:5] == r[1:5] and other[i].score == pytest.approx(r.score) and other[i].base_score == pytest.approx(r.base_score)
    drawn = [{r.doc_id: r.score for r in pitman_yor.score_documents(docs, slot_bytes=b, hot=h, sweeps=6).collect()} for b, h in ((1 << 20, ({}, [])), (size // 9, ({the: 5}, [(the, the)])))]
    assert sum(drawn[0].values()) == pytest.approx(sum(drawn[1].values()), rel=0.01)


# 5 lines


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        stays = [x for x in every if len(holders.get(key(x), ())) < min_docs or max((h for h in holders[key(x)] if h is not None), default=None) == i]
        out.append((i, len(every), len(every) - len(stays), "\n".join(stays)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines_equal_brute_force(spark, batches):
    draw = random.Random(batches)
    pool = [f"  The repeated line number {i} " + "!" * (i % 3) for i in range(40)]
    rows = [(i, "\n".join(draw.choice(pool).upper() if draw.random() < 0.2 else draw.choice([*pool, f"own {i} line of this document", "tiny", ""]) for _ in range(draw.randint(0, 9)))) for i in range(150)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fanout=2).collect()
    assert Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept_text) for r in got) == brute_lines(rows)


def test_lines_edges(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = lines.dedup_lines(documents(spark)).collect()
    assert Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept_text) for r in got) == brute_lines(rows)
    assert lines.dedup_lines(nothing(spark)).count() == 0


def test_lines_need_the_anti_join(spark, monkeypatch):
    rows = [(i, "a line that is long enough\nown line number %d of this text" % i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lines.Runs, "merge_anti", lambda self, batch: batch.withColumn("fresh", F.lit(True)))
    with pytest.raises(Exception, match="fresh twice"):
        lines.dedup_lines(docs).collect()
    monkeypatch.setattr(lines.Runs, "merge_anti", lambda self, batch: batch.withColumn("fresh", F.lit(False)))
    assert sum(r._n_dropped for r in lines.dedup_lines(docs).collect()) != 39


def test_lines_of_very_long_texts(spark):
    text = "\n".join(f"a line of some length, number {i % 9000}" for i in range(30_000))
    rows = [(1, text), (2, text), (3, text + "\nshort"), (4, "own line that nobody else has")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept_text) for r in got) == brute_lines(rows)


# 6 chat


def test_chat_template_is_reversible():
    draw = random.Random(6)
    bits = ["</s>", "[INST]", "\\", "\\\\", "[/INST]", "<s>", "<<SYS>>", "<|", "[TURN]", "[/TURN]", "ok", " ", "\n", "ß", "\\</s>"]
    for _ in range(3000):
        turns = [(draw.choice(["user", "assistant", "system", "tool", "", "odd</s>"]), "".join(draw.choices(bits, k=draw.randint(0, 8)))) for _ in range(draw.randint(0, 5))]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_tree_paths_and_branches(spark):
    rows = [(1, "a", None, "user", "hi", 0.0), (1, "b", "a", "assistant", "low", 1.0), (1, "c", "a", "assistant", "high", 5.0), (1, "d", "c", "user", "more", 5.0), (1, "e", "b", "user", None, None), (2, "f", "lost", None, "alone", None), (3, "g", "h", "user", "x", 1.0), (3, "h", "g", "user", "y", 1.0)]
    rows += [(4, f"n{i}", f"n{i - 1}" if i else None, "user", str(i), 0.0) for i in range(70)]
    tree = spark.createDataFrame(rows, "tree long, msg_id string, parent_id string, role string, text string, score double")
    paths = {}
    jumps, leaves = chat.tree_jumps(tree)
    assert {r.leaf: (r.tree, r.total, r.length) for r in leaves.collect() if r.tree < 4} == {"d": (1, 10.0, 3), "e": (1, 1.0, 3), "f": (2, 0.0, 1)}
    for r in chat.tree_paths(leaves, jumps).collect():
        paths.setdefault(r.leaf, {})[r.up] = r.msg_id
    assert paths["d"] == {0: "d", 1: "c", 2: "a"} and paths["e"] == {0: "e", 1: "b", 2: "a"} and len(paths["n69"]) == 70 and "g" not in paths
    made = {r.tree: chat.parse_turns(r.formatted) for r in chat.format_trees(tree).collect()}
    assert made[1] == [("user", "hi"), ("assistant", "high"), ("user", "more")] and made[2] == [("", "alone")]
    assert chat.format_trees(tree, top=2).filter("tree = 1").count() == 2


def test_tree_paths_leave_out_tails_on_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("g", "h"), ("h", "g"), ("t", "g"), ("u", "t"), ("s", "s"), ("v", "s")] + [(f"n{i}", f"n{i - 1}" if i else "lost") for i in range(9)]
    for part, leaves in ((rows, {"c": 3, "n8": 9}), ([r for r in rows if r[0] in "ghtusv"], {})):
        jumps, ends = chat.tree_jumps(spark.createDataFrame([(*r, 1, 1.0) for r in part], "msg_id string, parent_id string, tree long, score double"), max_rounds=8)
        found = chat.tree_paths(ends, jumps).collect()
        assert Counter(r.leaf for r in found) == leaves and len({(r.leaf, r.up) for r in found}) == len(found)


def test_only_chosen_branches_are_written_out(spark):
    """A comb: each message of a long branch has a leaf of its own."""
    draw = random.Random(12)
    rows = [(1, f"m{i:03d}", f"m{i - 1:03d}" if i else None, "user", f"t{i}", draw.random()) for i in range(64)]
    rows += [(1, f"x{i:03d}", f"m{i:03d}", "assistant", f"a{i}", draw.random()) for i in range(63)]
    tree = spark.createDataFrame(rows, "tree long, msg_id string, parent_id string, role string, text string, score double")
    score, parent = {r[1]: r[5] for r in rows}, {r[1]: r[2] for r in rows}

    def way(m):
        return [*way(parent[m]), m] if parent[m] else [m]

    ranked = sorted((-sum(score[m] for m in way(leaf)) / len(way(leaf)), leaf) for leaf in {r[1] for r in rows} - {r[2] for r in rows})
    got = {r.branch: (r.leaf, chat.parse_turns(r.formatted)) for r in chat.format_trees(tree, top=3).collect()}
    text = {r[1]: (r[3], r[4]) for r in rows}
    assert got == {n + 1: (leaf, [text[m] for m in way(leaf)]) for n, (_, leaf) in enumerate(ranked[:3])}
    jumps, leaves = chat.tree_jumps(tree)
    assert leaves.count() == 64 and chat.tree_paths(leaves.filter(F.col("leaf") == ranked[0][1]), jumps).count() == len(way(ranked[0][1]))


def test_trees_with_repeated_messages(spark):
    rows = [(1, "a", None, "user", "hi", 0.0), (1, "a", None, "user", "hi", 0.0), (1, "b", "a", "assistant", "yes", 1.0), (2, "b", "a", "assistant", "yes", 1.0), (1, None, "a", "user", "lost", 0.0)]
    got = chat.format_trees(spark.createDataFrame(rows, "tree long, msg_id string, parent_id string, role string, text string, score double")).collect()
    assert [(r.tree, r.leaf, chat.parse_turns(r.formatted)) for r in got] == [(1, "b", [("user", "hi"), ("assistant", "yes")])]


def test_chat_query(spark, small):
    rows = {r.conv_id: r for r in QUERIES["op6_chat_format"](spark, small).collect()}
    turns = {}
    for r in table(spark, small, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(rows) == set(turns)
    for i, found in turns.items():
        whole = "".join(f"{r}\n{t}\n" for _, r, t in sorted(found))
        loss = "".join(t for _, r, t in sorted(found) if r == "assistant")
        assert (rows[i].n_turns, rows[i].turns_sha256, rows[i].loss_chars, rows[i].loss_sha256) == (len(found), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# 7 packing


def optimum(items, room):
    items, best = sorted(items, reverse=True), len(items)
    bins = []

    def place(i):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= room and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1)
                bins[k] -= items[i]
        bins.append(items[i])
        place(i + 1)
        bins.pop()

    place(0)
    return best


def test_reduction_keeps_the_optimum():
    draw = random.Random(7)
    for _ in range(150):
        room = draw.choice((10, 13, 20))
        items = [draw.randint(1, room) for _ in range(draw.randint(0, 8))]
        fixed, left = packing.reduce_dominated(dict(Counter(items)), room)
        rest = [n for n, k in left.items() for _ in range(k)]
        assert sum(k for _, k in fixed) + optimum(rest, room) == optimum(items, room)
        used = Counter()
        for pattern, k in packing.plan_bins(dict(Counter(items)), room):
            assert sum(a * b for a, b in pattern) <= room
            for a, b in pattern:
                used[a] += b * k
        assert used == Counter(items)


def test_tokens_by_words_are_the_tokenizer_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["x<|endoftext|>Y <|startoftext|>", "<|ENDOFTEXT|> z", "<|endoftext|", "a\x1cb c d <|endoftext|> x", "É é ΣΑΣ Σ'S don't", "", None, "z\x85y 12a_b", "foo.,! Ünï?. don't's.'s a—. x\x01y é. 9. ÿ|| ..", "A'S. İI. The THE the, the.", " \n"]
    made = packing.WordTokenizer(path, keep=3)
    for _ in range(2):
        assert [x.tolist() for x in made(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_meet_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, made = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["The  THE\n\n the<|endoftext|>", "", None, "don't  stop\t"]
    assert not made.by_words and packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).by_words
    assert [x.tolist() for x in made(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_query(spark, small):
    rows = QUERIES["op7_best_fit"](spark, small).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert len({r.sequence_id for r in rows if r.length == 2048}) == sum(r.length == 2048 for r in rows) > 0
    assert len(lengths) == table(spark, small, "documents").count() and len(bins) <= 1.01 * math.ceil(sum(lengths.values()) / 2048) + 1


def test_packing_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(documents(spark), path, with_ids=True).collect()
    assert sum(r.doc_id == 6 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 4] == [1]
    long = sorted((r for r in rows if r.doc_id == 20), key=lambda r: r.piece)
    assert [r.length for r in long[:-1]] == [2048] * 14 and sum(r.length for r in long) == 30_001 and long[3].start == 3 * 2048
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(nothing(spark), path).count() == 0


# 8 html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a href=x>Menu</a></nav><div class=ad>Buy, now, here</div><article><h1>T</h1><p>Be.</article><footer>&copy; all</footer>", "T\nBe."),
        ("<article><p>One,<br>two<p><b>Three  <i>four</i></p><script>var t='</p>'</script><style>p{}</style><!-- x --><aside>no</aside></article>", "One, two\nThree four"),
        ("<header>Site</header><main><header><h1>Title</h1></header><p>Body text here, long enough.</p><form><p>Mail</p></form></main><section class='comments'><p>I disagree, a lot, really, with, this, piece.</p></section>", "Title\nBody text here, long enough."),
        ("<div id=sidebar><p>side, side, side</p></div><div class=content><p>" + "Words, and more words. " * 9 + "</p><ul><li>item one<li>item two</ul></div><div class=cookie-notice>We use cookies</div>", ("Words, and more words. " * 9).strip() + "\nitem one\nitem two"),
        ("<p>&#x41;&eacute;&nbsp;&nbsp;b&#8217;s</p>", "Aé b’s"),
        ("<article><p>a < b and <p class=\"q\">c</p><p style='display: none'>hidden</p>", "a < b and\nc"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>one <a href='<x>'>link</a><p>cut off <b", "one link\ncut off"),
    ],
)
def test_html(page, text):
    assert html_text.extract(page) == text


PROSE = ["It was a long day, and nobody had said a word of what had happened since the morning, when the first of them came up the road from the lake. " * 2, "They sat down, ate, and after a while the oldest told what she knew of the matter, which was little enough, but more than the others had hoped. " * 2, "In the end all of it was written down, read aloud twice, and put away for those who would come later and ask what had been done in those days. " * 2]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
SAID = "\n".join(x.strip() for x in PROSE)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form action=x><div><h1>T</h1>{BODY}</div></form><footer>Imprint and more</footer></body>",
        f"<div class='search-page'><div><h1>T</h1>{BODY}</div></div><footer>All rights</footer>",
        f"<div class='widget' id=w><nav><a href=1>One</a></nav><div><h1>T</h1>{BODY}</div><div class=sidebar>More of that</div></div><div>Skip</div>",
        f"<aside><nav><ul><li><a href=1>One</a><li>Two</ul></nav><h1>T</h1>{BODY}</aside>",
        f"<article><h1>T</h1><p>{PROSE[0]}</p><section class='related-work'><p>{PROSE[1]}</p><p>{PROSE[2]}</p></section><section class='related-posts'><p>Read this</p></section></article>",
        f"<article><h1>T</h1><p>{PROSE[0]}</p><section class=discussion><p>{PROSE[1]}</p><p>{PROSE[2]}</p></section><div class=notice>We use cookies</div></article>",
    ],
)
def test_html_names_do_not_decide_alone(page):
    assert html_text.extract(page) == "T\n" + SAID


def test_html_comments_outweigh_no_article():
    comments = "".join(f"<div class=comment><p>{x}</p></div>" for x in PROSE * 4)
    page = f"<main><h1>T</h1><p>A short article, of a few words.</p></main><section id=comments>{comments}</section><form><p>{PROSE[0]}</p></form>"
    assert html_text.extract(page) == "T\nA short article, of a few words."
    assert html_text.extract(f"<div class=sidebar>{BODY}</div>") == SAID


CONCLUSION = "<h2>Conclusion</h2><p>The short conclusion stands here.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><main><div class=s1><h1>T</h1>{BODY}</div><div class=s2>{CONCLUSION}</div></main><div>Imprint</div>",
        f"<body><div id=content><section><h1>T</h1>{BODY}</section><section>{CONCLUSION}</section></div><div>Imprint</div>",
        f"<body><div id=content><div class=box><h1>T</h1></div><div class=box>{BODY}</div><div class=box>{CONCLUSION}</div></div><ul><li><a href=1>Imprint</a></ul>",
        f"<body><div class=x1><a href=1>Start</a> <a href=2>News of the day</a></div><div class=x2><div><h1>T</h1></div><div><div>{BODY}</div></div><div>{CONCLUSION}</div></div>",
        f"<body><div class=post-content><h1>T</h1><div>{BODY}</div><div><ul><li><a href=1>Other page</a><li><a href=2>Yet another page</a></ul></div><div>{CONCLUSION}</div><div class=share>Tell others</div></div>",
        f"<body><div role=main><div><h1>T</h1>{BODY}</div><div class=related-posts><p>Read on</p></div><div>{CONCLUSION}</div></div><footer>Imprint</footer>",
    ],
)
def test_html_short_sections_stay(page):
    assert html_text.extract(page) == f"T\n{SAID}\nConclusion\nThe short conclusion stands here."


def test_html_planted_blocks():
    """The contract: all blocks of the article in page order and nothing of the margins, whatever frames and lengths."""
    draw = random.Random(8)
    words = lambda low, high: " ".join(draw.choice(["word", "and,", "longer", "of", "river"]) for _ in range(draw.randint(low, high)))
    margins = ["<nav><ul><li><a href=1>{}</a></ul></nav>", "<div class=sidebar><p>{}</p></div>", "<footer>{}</footer>", "<div id=cookie-notice>{}</div>", "<aside><p>{}</p></aside>", "<div class='comments'><p>{}</p></div>", "<form><p>{}</p></form>", "<div class=ad><p>{}</p></div>", "<script>{}</script>"]
    frames = ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<div class='entry-content'>{}</div>", "<div role=main>{}</div>", "<div class=x9>{}</div>"]
    for n in range(300):
        blocks = [words(40, 120) for _ in range(draw.randint(2, 5))] + [words(1, 6) for _ in range(draw.randint(0, 4))]
        draw.shuffle(blocks)
        parts, at = [], 0
        while at < len(blocks):
            some = blocks[at : at + draw.randint(1, 3)]
            at += len(some)
            text = "".join(f"<{t}>{b}</{t}>" for b in some for t in [draw.choice(["p", "p", "h2", "blockquote"])])
            parts.append(draw.choice(["{}", "<div>{}</div>", "<section>{}</section>"]).format(text))
        inner = []
        for part in parts:
            inner.append(part)
            if draw.random() < 0.3:
                inner.append(draw.choice(margins).format(words(1, 8)))
        around = lambda: "".join(draw.choice(margins).format(words(1, 12)) for _ in range(draw.randint(0, 3)))
        frame = draw.choice(frames).format("".join(inner))
        page = f"<body>{around()}{draw.choice(['{}', '<div>{}</div>']).format(frame)}{around()}</body>"
        assert html_text.extract(page) == "\n".join(blocks), (n, page)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>x"), (1, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit("other"))
    assert Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()) == {(1, "", 0): 2, (None, "x", 1): 1}


# 9 top-k


def test_topk_equals_brute_force(spark):
    draw = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in draw.normal(size=24).round(2)]) for i in range(300)]
    same_vector = [0.5] * 24
    rows += [(1000 + i, same_vector) for i in range(80)] + [(2000, [float("nan")] * 24), (2001, None), (2002, [None] * 24), (2050, [float("inf")] * 24), (3000, [])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")), class_block=64, query_block=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert set(got) == {i for i in ok if i % 50 == 0}


@pytest.mark.parametrize(("power", "n"), [(9, 12), (21, 12), (40, 12), (40, 1)])
def test_topk_is_exact_for_large_components(spark, power, n):
    draw = np.random.default_rng(power)
    rows = [(int(i), [float(x) for x in np.floor(draw.normal(size=n) * 2.0**power) / 256]) for i in range(120)]
    rows += [(0, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (50, rows[50][1]), (50, [1.0])]  # repeated ids: each row counts
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    if power == 40 and n == 12:
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(docs, class_block=16).collect()
        return
    if power == 40:
        rows = [(i, [x[0] / 2.0**11]) for i, x in rows]
        docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = Counter()
    for a, (q, v) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for b, (i, w) in enumerate(whole) if a != b)[:5]
            want.update((q, k, i, -s) for k, (s, i) in enumerate(best, 1))
    for block in (16, 8192) if power == 9 else (16,):
        got = topk.top_k(docs, class_block=block, query_block=3).collect()
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_topk_bound_is_a_bound():
    draw = np.random.default_rng(2)
    x, y = draw.integers(-256, 256, (40, 63)).astype(float), draw.integers(-256, 256, (50, 63)).astype(float)
    last = None
    for segments in (1, 4, 16, 63):
        bound = topk._summary(x, segments) @ topk._summary(y, segments).T
        assert (bound >= x @ y.T - 1e-6).all()
        last = bound
    assert np.allclose(last, x @ y.T)


def test_topk_edges(spark):
    shape = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], shape)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], shape)).count() == 0
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5])], shape)).collect()] == [(0, 1, 256 * 128)]


# 10 toxicity


def test_toxicity_learns_and_locates(spark):
    draw = random.Random(10)
    rows, marks = [], []
    for i in range(1500):
        said = [" ".join(f"w{draw.randint(0, 300)}" for _ in range(8)) for _ in range(draw.randint(1, 12))]
        bad = i % 6 == 0
        if bad:
            said[draw.randrange(len(said))] += " you vile " + draw.choice(["oaf", "cur", "lout"])
        rows.append((i, ". ".join(said) + "."))
        marks.append((i, 1, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].predicted == 1) == (i % 6 == 0) for i in held) >= 0.98 * len(held)
    texts = dict(rows)
    hits = [texts[i][s.start : s.end] for i in held if i % 6 == 0 for s in got[i].offending]
    assert hits and sum("vile" in h for h in hits) >= 0.95 * len(hits)


def test_toxicity_is_not_length():
    draw = random.Random(3)
    said = lambda n: ". ".join(" ".join(f"w{draw.randint(0, 300)}" for _ in range(8)) for _ in range(n))
    texts = [said(draw.randint(1, 12)) + (". you vile oaf" if i % 6 == 0 else ". you may go") for i in range(1500)]
    weights, bias = toxicity.fit(texts, np.asarray([int(i % 6 == 0) for i in range(1500)]))

    def score(text):
        z = [sum(weights.get(w, 0) for w in set(toxicity.tokens(text[a:b]))) + bias if set(toxicity.tokens(text[a:b])) & weights.keys() else -math.inf for a, b in toxicity.sentences(text)]
        return toxicity.document_scores(1 / (1 + np.exp(-np.asarray(z))), np.zeros(len(z), int), 1)[0]

    for n in (10, 200, 1000, 5000):
        assert score(said(n)) < 0.1 and score(said(n) + ". you may go" * n) < 0.1 and score(said(n) + ". you vile oaf") > 0.5


def test_toxicity_scores_are_a_plain_noisy_or(spark, tmp_path):
    """All scores of the registered query from its own model, sentence by sentence."""
    draw = random.Random(12)
    said = lambda n, *more: ". ".join([*(" ".join(f"w{draw.randint(0, 200)}" for _ in range(6)) for _ in range(n)), *more])
    rows = [(i, said(draw.randint(0, 9), *["you vile oaf"] * (i % 5 == 0), *["you may go"] * draw.randint(0, 5))) for i in range(600)] + [(1000, None), (1001, ""), (1002, said(2, *["you may go"] * 2000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    model = {r.word: r.weight for r in toxicity.train(docs, known).collect()}
    got = {r.doc_id: r.score for r in QUERIES["op10_toxicity"](spark, str(tmp_path)).collect()}
    assert len(got) == docs.count() and max(got.values()) > 0.5 and got[1002] < 0.1
    for r in docs.collect():
        loud, quiet = 1.0, 0.0
        for a, b in toxicity.sentences(r.text):
            found = set(toxicity.tokens(r.text[a:b])) & (model.keys() - {None})
            p = 1 / (1 + math.exp(-model[None] - sum(model[w] for w in found))) if found else 0.0
            loud, quiet = (loud * (1 - p), quiet) if p >= toxicity.QUIET else (loud, max(quiet, p))
        assert got[r.doc_id] == pytest.approx(1 - loud * (1 - quiet), abs=1e-9)


def test_toxicity_gradient():
    draw = np.random.default_rng(5)
    n, m, width = 40, 15, 7
    rows = np.sort(np.append(np.arange(n), draw.integers(0, n, 50)))
    columns, owners = draw.integers(0, width, len(rows)), np.sort(draw.integers(0, m, n))
    y, balance, theta = draw.integers(0, 2, m).astype(float), draw.random(m), draw.normal(size=width + 2)
    theta[-2] -= 5  # quiet sentences as well as loud ones
    value, grad = toxicity.likelihood(theta, columns, rows, owners, y, balance)
    logits = [theta[-2] + sum(theta[c] for c, r in zip(columns, rows, strict=True) if r == s) for s in range(n)]
    want = 0.0
    for d in range(m):
        clean, quiet = 1 - 1 / (1 + math.exp(-theta[-1])), []
        for s in range(n):
            if owners[s] == d:
                p = 1 / (1 + math.exp(-logits[s]))
                clean *= 1 if p < toxicity.QUIET else 1 - p
                quiet += [p] if p < toxicity.QUIET else []
        clean *= 1 - max(quiet, default=0)
        want += balance[d] * math.log(1 - clean if y[d] else clean)
    p = 1 / (1 + np.exp(-np.asarray(logits)))
    assert value == pytest.approx(want) and max(Counter(owners[p < toxicity.QUIET]).values()) > 1 and (p > toxicity.QUIET).sum() > 5
    for i in range(width + 2):
        step = np.eye(width + 2)[i] * 1e-6
        up, down = (toxicity.likelihood(theta + s, columns, rows, owners, y, balance)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_toxicity_of_other_scripts():
    assert len(toxicity.sentences("这是好的。那是坏的！第三句")) == 3 and toxicity.tokens("坏的东西") == ["坏的", "的东", "东西"]
    texts = ["今天天气很好。我们去公园散步。" + ("你是坏蛋。" if i % 4 == 0 else "你是朋友。") for i in range(400)]
    weights, _ = toxicity.fit(texts, np.asarray([int(i % 4 == 0) for i in range(400)]))
    assert weights["坏蛋"] > 0


def test_toxicity_training_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "you vile oaf. " * 200 if i % 2 else "a kind word. " * 200) for i in range(60)] * 2, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.train(docs, known, max_bytes=20_000).filter("word is null").count() == 1
    assert {r.score for r in toxicity.toxicity(docs, known, max_bytes=0).collect()} == {0.0}


def test_toxicity_edges(spark):
    rows = toxicity.toxicity(documents(spark), labels(spark)).collect()
    assert len(rows) == documents(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4, 5)} == {0.0}
    assert toxicity.toxicity(nothing(spark), labels(spark)).count() == 0
    assert {r.score for r in toxicity.toxicity(documents(spark), labels(spark).limit(0)).collect()} == {0.0}
    assert toxicity.sentences("One. Two!\nThree") == [(0, 4), (4, 9), (10, 15)]


# queries and the pipeline


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), SQL[name])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        # of 14 rows three are copies; the mix takes each once or twice, or leaves it
        assert out.columns == docs.columns and {"line": out.count() == docs.count(), "n-gram": out.count() == docs.count() - 3, "mixing": 0 < out.count() <= 2 * docs.count()}[name.split()[0]], name
    near = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert set(near) & {1, 2, 6} == {1} and len(near) == docs.count() - 3
    cut = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert cut[7].text == "own words 7 of this one\n" and cut[7].n_chars == len(cut[7].text) and cut[10].text.startswith("a line")
    packed = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    for own in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == own), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_pipeline_near_copies_without_ids(spark):
    import corpus_pipeline

    rows = [(None, FIRST), (None, FIRST), (None, FIRST + " phi"), (None, "a clean text of its own"), (5, "five rows say this one thing here"), (5, "five rows say this one thing here"), (5, "another text under that number"), (None, None), (None, None)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    texts = Counter(r.text for r in kept)
    assert texts.pop(None) == 2 and sum(n for t, n in texts.items() if t.startswith(FIRST)) == 1
    assert sorted(t for t in texts if not t.startswith(FIRST)) == ["a clean text of its own", "another text under that number", "five rows say this one thing here"] and set(texts.values()) == {1}


def test_pipeline_toxic_rows_without_ids(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"you vile oaf number {i}" if i % 3 == 0 else f"a kind word number {i}") for i in range(300)] + [(None, "you vile oaf"), (None, "a kind word"), (3, "a kind word")]
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, _gone string, _toxic string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect())
    assert kept == Counter(r for r in rows if "vile" not in r[1])


def test_pipeline_mix_by_rows(spark):
    import corpus_pipeline

    draw = random.Random(4)
    rows = [(draw.choice([None, 1, 2, i]), " ".join("w" for _ in range(draw.randint(1, 30))), draw.choice("ab")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = Counter((r.source, r.text) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    words = Counter()
    for _, t, s in rows:
        words[s] += len(t.split())
    want = fill({k: 2.0 * n for k, n in words.items()}, {"a": 5, "b": 2}, 1.5 * sum(words.values()))
    for s in "ab":
        assert abs(sum(n * len(t.split()) for (k, t), n in out.items() if k == s) - want[s]) <= 30
    have = Counter((s, t) for _, t, s in rows)
    assert all(n <= 2 * have[k] for k, n in out.items())


def test_pipeline_runs(spark, small):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
