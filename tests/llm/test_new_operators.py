"""Whitening, spelling variants and SimHash beside brute force, and their edge cases."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import buckets, golay, simhash, spelling, whitening

FOLDER = "/root/testdata/sf0.001"
EDGES = [(None, "a lost text of some words"), (1, None), (2, ""), (3, "  \n\t "), (4, "one two three four five"), (4, "one two three four five")]
CLASH = "x c n part state fp key tile word other component mean first least copies".split()


def rows(df):
    return [r.asDict() for r in df.collect()]


def with_clashes(frame):
    for name in CLASH:
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit("clash"))
    return frame


# whitening


def _scatter(x):
    away = x - x.mean(0)
    return away.T @ away


@pytest.mark.parametrize("kind", ["plain", "few", "equal", "zero", "repeated", "one dimension"])
def test_rank_one_updates_give_the_spectrum(kind):
    rng = np.random.default_rng(3)
    x = {
        "plain": np.floor(rng.standard_normal((500, 24)) * 40),
        "few": np.floor(rng.standard_normal((5, 24)) * 40),
        "equal": np.eye(12)[rng.integers(0, 12, 200)] * 100,
        "zero": np.zeros((7, 5)),
        "repeated": np.repeat(np.floor(rng.standard_normal((3, 8)) * 9), 20, axis=0),
        "one dimension": np.floor(rng.standard_normal((50, 1)) * 9),
    }[kind]
    size = x.shape[1]
    parts = [whitening.Spectrum.empty(size) for _ in range(3)]
    for i, v in enumerate(x):
        parts[i % 3].add(v)
    whole = whitening.Spectrum.unpack(parts[0].pack(), size)
    whole.merge(parts[1])
    whole.merge(parts[2])
    want = _scatter(x)
    scale = max(1.0, np.abs(want).max())
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(0), atol=1e-9)
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(size)).max() < 1e-11
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - want).max() < 1e-11 * scale
    assert np.abs(whole.values - np.linalg.eigvalsh(want)).max() < 1e-11 * scale


def _whitened_by_hand(vectors, keep=4):
    x = np.floor(np.array(vectors, dtype=np.float64) * 256)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, components = np.linalg.eigh(_scatter(fit) / n)
    values, components = values[::-1], components[:, ::-1]
    y = (x - sums / n) @ components[:, :keep] / np.sqrt(values[:keep])
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, y, deviation, values[:keep] / values.sum()


def test_whitening_equals_the_covariance_of_the_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    data = table.select("vec_id", "embedding").collect()
    n, want, deviation, explained = _whitened_by_hand([r[1] for r in data])
    got = {(r["vec_id"], r["component"]): r for r in rows(whitening.whiten(with_clashes(table)))}
    assert len(got) == 4 * len(data)
    signs = [np.sign(got[data[0][0], c + 1]["whitened"] * want[0, c]) for c in range(4)]
    for i, (vec_id, _) in enumerate(data):
        for c in range(4):
            r = got[vec_id, c + 1]
            assert r["whitened"] == pytest.approx(signs[c] * want[i, c], rel=1e-7, abs=1e-9)
            assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, deviation[i], deviation[i])
            assert r["explained"] == pytest.approx(explained[c], rel=1e-12) and r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), float(i % 2), 1.0, float(i)]) for i in range(6)]
    odd = [(10, None), (11, []), (12, [nan, 0.0, 0.0, 0.0]), (13, [inf, 0.0, 0.0, 0.0]), (14, [None, 0.0, 0.0, 0.0]), (15, [1.0, 2.0]), (0, good[0][1]), (None, good[1][1])]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>")
    got = rows(whitening.whiten(table))
    assert Counter(r["vec_id"] for r in got) == {0: 8, None: 4, **{i: 4 for i in range(1, 6)}}
    assert {r["n"] for r in got} == {6}  # the repeated vectors are in the fit list once
    _, want, deviation, _ = _whitened_by_hand([v for _, v in good], 3)
    for r in got:
        if r["component"] == 4:
            assert r["whitened"] is None  # the third entry is constant
        elif r["vec_id"] is not None:
            assert abs(r["whitened"]) == pytest.approx(abs(want[r["vec_id"], r["component"] - 1]), abs=1e-9)
            assert r["deviation"] == deviation[r["vec_id"]]
    assert whitening.whiten(table.where("false")).count() == 0
    one = rows(whitening.whiten(table.where("vec_id = 1")))
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    large = spark.createDataFrame([(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [5.0, 9.0])], "vec_id long, embedding array<double>")
    got = rows(whitening.whiten(large))
    x = [[int(256 * a) for a in v] for v in ([1e15, 1.0], [-1e15, 2.0], [5.0, 9.0])]
    sums = [sum(c) for c in zip(*x)]
    exact = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in got} == exact
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in exact.items()}


def test_states_of_many_tasks_are_combined_in_a_tree(spark):
    rng = np.random.default_rng(8)
    x = np.floor(rng.standard_normal((200, 5)) * 50).astype(int).tolist()
    table = spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(40)
    whole = whitening.spectrum(table, 5)
    assert whole.n == 200 and np.allclose(whole.values, np.linalg.eigvalsh(_scatter(np.array(x, dtype=float))))


# SimHash


def test_golay_decoding():
    words = np.arange(1 << 23, step=997)
    assert (np.bincount(golay._COUNTS) == np.bincount([1] * 277 + [6] * 1771)).all()
    codewords = (np.arange(4096) << 11) | golay._CHECKS
    for w in words[:300].tolist():
        far = np.bitwise_count(codewords ^ w)
        number, taken = golay.within(np.array([w]))
        assert golay.nearest(np.array([w]))[0] == far.argmin() and far.min() <= 3
        assert set(number[taken].tolist()) == set(np.flatnonzero(far <= 4).tolist())


@pytest.mark.parametrize("third", [False, True])
def test_every_pair_within_four_bits_shares_a_key(third):
    rng = np.random.default_rng(6)
    for _ in range(400):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        bits = rng.choice(64, rng.integers(0, 5), replace=False)
        b = a ^ sum(1 << int(x) for x in bits)
        rows, keys = golay.keys(np.array([a, b], dtype=np.uint64), third)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
    rows, keys = golay.keys(rng.integers(0, 1 << 63, 3000).astype(np.uint64), third)
    assert len(keys) / 3000 < (210 if third else 70)


def _fingerprint(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fingerprints, ids):
    """Smallest id reachable over fingerprints within four bits and over equal ids."""
    parent = list(range(len(fingerprints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 4 or (ids[i] is not None and ids[i] == ids[j]):
            parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[root(i)].append(x)
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_against_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in table.collect()]
    long = data[0][1] * 3
    words = long.split()
    near = [(1000 + k, " ".join(words[:k] + ["changed"] + words[k:])) for k in range(0, 300, 3)]
    extra = [*((None if i is None else 5000 + i, t) for i, t in EDGES), (6000, "Ünï Çödé WORDS and\x1cmore\x0btext here"), (7000, long), (7000, "another text under one id")]
    data = data + near + extra
    want = [_fingerprint(t) for _, t in data]
    table = with_clashes(spark.createDataFrame(data, "doc_id long, text string"))
    got = rows(simhash.near_duplicates(table))
    named = _components(want, [i for i, _ in data])
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(
        ((i, f"{f:016x}", c) for (i, _), f, c in zip(data, want, named)), key=key
    )
    assert simhash.near_duplicates(table.where("false")).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(5000)) + "\x0b" + "x" * 3000 + " end"
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    assert simhash.fingerprint(text.encode()) == _fingerprint(text)


@pytest.mark.parametrize("third_from", [1, 1 << 26])
def test_links_of_large_buckets(spark, monkeypatch, third_from):
    """Many fingerprints around one centre, with buckets cut into tiles, are connected as brute force says."""
    monkeypatch.setattr(buckets.in_runs, "__defaults__", (50,))
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 62))
    near = {centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)) for _ in range(500)}
    fps = sorted(near | {int(x) for x in rng.integers(0, 1 << 62, 300)})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = [tuple(r) for r in simhash.links(table, third_from).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found) and len(found) < 60 * len(fps)

    def groups(links):
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        out = defaultdict(set)
        for f in fps:
            out[root(f)].add(f)
        return sorted(map(sorted, out.values()))

    assert groups(found) == groups((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4)


# spelling variants


def _edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(data):
    counts = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if _edit_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def _spelling_rows(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(df)]
    assert len(got) == len(set(got))
    return set(got)


def _misspelt():
    """Documents whose words occur in many spellings, in chains of frequencies."""
    rng = np.random.default_rng(2)
    letters = list("abcdeéÿ×÷")
    data = []
    for k in range(40):
        base = "".join(rng.choice(letters, rng.integers(6, 12)))
        twice = base[:2] + "q" + base[3:]
        third = twice[:4] + twice[5:] if len(twice) > 6 else twice + "z"
        made = [base] * 130 + [twice] * 26 + [third] * 5 + [base[:-1] + "w"] * 6 + [base + "v"] * 6
        data.append((k, " ".join(made).title() if k % 2 else "-".join(made)))
    return data


def test_spelling_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    data = [(r["doc_id"], r["text"]) for r in table.collect()] + _misspelt() + EDGES
    want = _variants(data)
    frame = with_clashes(spark.createDataFrame(data, "doc_id long, text string"))
    got = _spelling_rows(spelling.variants(frame))
    assert got == want and sum(f is not None for _, f, *_ in got) > 50
    roots = {w: r for w, _, r, *_ in got}
    assert any(f is not None and roots[w] != f for w, f, *_ in got)  # a chain of forms
    assert spelling.variants(frame.where("false")).count() == 0


def test_spelling_with_cut_buckets_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(buckets.in_runs, "__defaults__", (5,))
    data = _misspelt()[:12] + [(99, "ab" * 3000 + " " + "ab" * 2999 + "a " + "ab" * 3000 + "c")] * 5
    want = _variants(data)
    assert _spelling_rows(spelling.variants(spark.createDataFrame(data, "doc_id long, text string"))) == want
    assert any(len(w) > 5000 and near == 2 for w, _, _, _, near, _ in want)
    find, gap = re.compile("[a-z]+"), re.compile("[^a-z]")
    monkeypatch.setattr(spelling, "_PIECE", 10)
    assert sum(spelling._runs("abc " * 50 + "x" * 40 + " end", find, gap), []) == ["abc"] * 50 + ["x" * 40, "end"]
