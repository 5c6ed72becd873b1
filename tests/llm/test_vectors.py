"""Hard negatives, SimHash and centroids against brute force, and their bounds against exact numbers."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import centroids, negatives, simhash
from tessera.llm.vectors import norms

CLASHING = ["row", "vec", "words", "label_", "align", "rest", "to_pivots", "cluster", "distance", "print", "key", "s", "q", "root", "id", "least", "rank", "lows", "c"]
VECTORS = "vec_id long, label int, embedding array<double>, " + ", ".join(f"{n} string" for n in CLASHING)


def vectors(spark, rows):
    rows = [(i, label, v if v is None else [c if c is None else float(c) for c in v]) for i, label, v in rows]
    return spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], VECTORS).repartition(3)


def floors(x, scale):
    return [int(np.floor(scale * v)) for v in x]


# 11 hard negatives


def test_rotation_keeps_products():
    draw = np.random.default_rng(1)
    for width in (1, 3, 64, 100):
        x = draw.integers(-1000, 1000, (7, width))
        turned = negatives.rotate(x)
        assert turned.shape[1] >= 64 and np.allclose(turned @ turned.T, x.astype(float) @ x.T)


@pytest.mark.parametrize("size", [1, 300, 1 << 40])
def test_intervals_hold_the_product(size):
    draw = np.random.default_rng(size)
    x, y = draw.integers(-size, size + 1, (20, 70)), draw.integers(-size, size + 1, (200, 70))
    y[:3], x[0] = 0, 0
    y[5], y[6] = x[4], -x[4]
    low, high = negatives.Asked(x).intervals(*negatives.code(y))
    exact = x.astype(float) @ y.T
    assert (low <= exact + 1e-9 * size * size).all() and (exact <= high + 1e-9 * size * size).all()
    wide = (high - low) / np.maximum(norms(x)[:, None] * norms(y), 1)
    assert wide[1:, 7:].mean() < 1.6  # of at most 2: the codes say something


def brute_negatives(rows, every, k):
    kept = [(i, lab, floors(v, 256)) for i, lab, v in rows if lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    tie = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for n, (i, lab, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w, strict=False)), other == lab) for m, (j, other, w) in enumerate(kept) if m != n]
        for p, top, _ in sorted((s for s in scored if s[2]), key=tie)[:k]:
            found = sorted((s for s in scored if not s[2] and 80 * top <= 100 * s[1] <= 100 * top), key=tie)[:k]
            out += [(i, p, at + 1, j, top, s) for at, (j, s, _) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 16)])
def test_negatives_equal_brute_force(spark, blocks):
    draw = random.Random(3)
    rows = [(i, draw.choice([1, 1, 1, 2, 3]), [draw.choice([-1, 0, 0.5, 0.51, 1]) for _ in range(6)]) for i in range(120)]
    rows += [(5, 1, [0.5] * 6)] * 4 + [(10, 2, [0.5] * 6)] * 3 + [(None, 3, [0.5] * 6)] * 2  # repeated rows, ids, no ids
    rows += [(200, None, [1.0] * 6), (210, 1, None), (220, 1, [None] * 6), (230, 1, [float("nan")] * 6), (240, 1, [float("inf")] * 6), (250, 1, []), (260, 2, [2.0] * 9), (270, 9, [1.0])]
    rows += [(300 + i, 4 + i % 2, [1e6 * draw.random() for _ in range(6)]) for i in range(0, 30, 5)]
    found = negatives.mine(vectors(spark, rows), every=10, k=3, anchor_block=blocks[0], row_block=blocks[1])
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted((tuple(r) for r in found.collect()), key=str)
    assert found == brute_negatives(rows, 10, 3) and len(found) > 50
    assert negatives.mine(vectors(spark, rows[:1]), every=10).count() == 0


def test_negatives_of_nothing(spark):
    assert negatives.mine(vectors(spark, [])).count() == 0
    with pytest.raises(Exception, match="fit 64 bits"):
        negatives.mine(vectors(spark, [(0, 1, [1e300])])).count()


def test_window_filter_drops_pairs():
    """Where rows lie close to few directions, most pairs are dropped by their codes alone."""
    draw = np.random.default_rng(5)
    y = np.concatenate([np.rint(1000 * (c + 0.05 * draw.normal(size=(300, 64)))).astype(np.int64) for c in draw.normal(size=(8, 64))])
    x = y[::300]
    alike = np.ones((len(x), len(y)), bool)
    lows, highs = np.full((len(x), 1), negatives.LOWEST), np.full((len(x), 1), negatives.HIGHEST)
    rows, _, cols, score, met = negatives.in_windows(x, y, negatives.code(y), alike, lows, highs, 5)
    exact = x @ y.T
    for n in range(len(x)):
        best = np.lexsort((np.arange(len(y)), -exact[n]))[:5]
        assert cols[rows == n].tolist() == best.tolist() and score[rows == n].tolist() == exact[n][best].tolist()
    assert met < alike.size / 4


# 12 SimHash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t\n", "One", "one two", "ONE two three", "one two three one two three one two three", "Zwölf Ärzte\x0bessen Äpfel und   Birnen " * 9, "a b c d e f g " * 40]


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_fingerprint_is_exact_in_pieces(size):
    for text in TEXTS:
        assert simhash.fingerprint(text, size) == brute_print(text)


def test_hash_is_that_of_spark(spark):
    said = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert said % (1 << 64) == simhash.fingerprint("one two three")


def gap(a, b):
    return ((a ^ b) % (1 << 64)).bit_count()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [512, 6, 1])
def test_links_equal_all_pairs(spark, bucket):
    draw = random.Random(7)
    prints = {0, 1, 3, 7, 15, (1 << 64) - 1}
    for centre in (0, draw.getrandbits(64), draw.getrandbits(64)):
        for _ in range(90):  # many share a half
            x = centre
            for b in draw.sample(range(64) if draw.random() < 0.3 else range(32), draw.choice([1, 2, 3, 3, 5, 9])):
                x ^= 1 << b
            prints.add(x)
    prints |= {draw.getrandbits(64) for _ in range(50)}
    values = sorted(map(signed, prints))
    pairs = simhash.links(spark.createDataFrame([(p,) for p in values], "print long"), bucket)
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}
    assert found == {(a, b) for n, a in enumerate(values) for b in values[n + 1 :] if gap(a, b) <= 3}


def test_components_of_documents(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)] + [(None, ""), (None, "own words without any id"), (7, "x"), (7, "x"), (3, "x")]
    base = " ".join(draw.choice(words) for _ in range(900))
    for i in range(40):  # a chain of small edits
        base = base.replace(" ", f" e{i} ", 1) if i % 2 else f"{base} f{i}"
        rows.append((1000 - i, base))
    table = spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in CLASHING))
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if gap(prints[i], prints[j]) <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    wanted = sorted(((rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(table).collect()), key=str) == wanted
    assert any(a is not None and c is not None and a != c for a, _, c in wanted)
    assert simhash.near_duplicates(table.limit(0)).count() == 0


# 13 centroids


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, floors(v, 1024)) for i, _, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in hashed[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        told = [near(v)[1] for _, v in kept]
        centres = [[sum(x) // len(x) for x in zip(*own, strict=True)] if (own := [v for (_, v), t in zip(kept, told, strict=True) if t == n]) else c for n, c in enumerate(centres)]
    told = [near(v) for _, v in kept]
    inertia = [sum(d for d, c in told if c == n) for n in range(len(centres))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), name[c]) for (i, _), (d, c) in zip(kept, told, strict=True)), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e-3])
def test_clusters_equal_brute_force(spark, scale):
    draw = random.Random(int(scale))
    rows = [(i, 0, [scale * draw.choice([-1, 0, 0.25, 1]) + 0.001 * draw.random() for _ in range(64)]) for i in range(150)]
    rows += [(i, 0, [scale * float(i % 3)] * 64) for i in range(200, 230)] + [(7, 0, [scale] * 64)] * 3 + [(None, 0, [0.0] * 64)] * 2
    rows += [(300, 0, None), (301, 0, [1.0] * 63), (302, 0, [None] * 64), (303, 0, [float("inf")] * 64), (304, None, [0.1] * 64), (305, 1, [])]
    found = centroids.cluster(vectors(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_clusters(rows)


def test_few_vectors(spark):
    assert centroids.cluster(vectors(spark, [])).count() == 0
    rows = [(i, 0, [1.0] * 64) for i in range(3)]
    assert sorted((tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()), key=str) == brute_clusters(rows)


@pytest.mark.parametrize("size", [0, 5, 1 << 20, 1 << 40, 1 << 60])
def test_bounds_hold(size):
    draw = np.random.default_rng(size % 1000)
    x, c, p = (draw.integers(-size, size + 1, (n, 64)) for n in (300, 8, 6))
    x[0], p[1], x[1] = c[0], p[0], p[0]
    pivots = centroids.Pivots(p)
    low = pivots.bounds(pivots.distances(x), norms(x), pivots.distances(c), norms(c))
    exact = np.asarray([centroids.exact_distances(x, row, float("inf")) for row in c]).T
    assert (low**2 <= exact.astype(float) * (1 + 1e-9)).all()
    cluster, best, met = centroids.nearest(x, pivots.distances(x), pivots, c)
    assert (best == exact.min(axis=1)).all() and all(exact[i, : cluster[i]].min(initial=1 << 200) > best[i] for i in range(len(x)))


def test_pivots_drop_centroids():
    draw = np.random.default_rng(2)
    centres = draw.integers(-1000, 1000, (8, 64))
    x = np.concatenate([c + draw.integers(-40, 41, (100, 64)) for c in centres])
    pivots = centroids.Pivots(x[:600:100])
    _, _, met = centroids.nearest(x, pivots.distances(x), pivots, centres)
    assert met < len(x) * 8 / 2
