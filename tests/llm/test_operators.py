"""Each operator beside brute force, and its edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import ann, bpe, language_model, line_dedup, minhash, packing, quality, toxicity, url_filter, warc

FOLDER = "/root/testdata/sf0.001"
EDGES = [(None, "a lost text of some words"), (1, None), (2, ""), (3, "  \n\t "), (4, "One line.\nOne line."), (4, "One line.\nOne line.")]
ODD = ["", " ", "  a  b \n\n c ", "x<|endoftext|>y", "a" * 3000, "日本語 x", "don't   can't\t\tend  ", "\x1c a\x1cb", "tail \n "]


def rows(df):
    return [r.asDict() for r in df.collect()]


# line dedup


def test_lines_fuzzy_and_equal(documents):
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word7 ", "the word7 ")  # a short word more: the same fingerprint
    docs = documents([(1, f"{base}\nHello, World!\n\nend of one"), (2, f"other stuff here\n{near}\nhello world"), *EDGES])
    got = {r["doc_id"]: r for r in rows(line_dedup.dedup_lines(docs.where("doc_id < 3 or doc_id is null")))}
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    by_id = collections.defaultdict(list)
    for r in rows(line_dedup.dedup_lines(docs)):
        by_id[r["doc_id"]].append(r)
    assert by_id[4][0]["text"] == "One line." and by_id[4][0]["_n_removed"] == 1
    assert by_id[3][0]["text"] == "  \n\t " and by_id[3][0]["_n_removed"] == 0
    assert got[None]["_n_removed"] == 0
    texts = {i: [r["text"] for r in rs] for i, rs in by_id.items()}
    assert f"{base}\nHello, World!\n\nend of one" in texts[1]
    assert "other stuff here" in texts[2]


def _line_print(words):
    """The fingerprint of a line by hand."""
    chosen = [w for w in words if len(w.encode()) > 3] or words
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) & ((1 << 60) - 1) for w in chosen]
    return sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_is_the_majority_of_bits(spark):
    lists = [["a"], ["a", "b", "c"], ["xxxx"] * 40 + ["yyyy"] * 3, ["q", "rrrr"] * 300, [f"word{i}" for i in range(2500)]]
    df = spark.createDataFrame([(w,) for w in lists], "w array<string>").withColumn("h", line_dedup.word_hashes(F.col("w")))
    for words, got in df.select("w", line_dedup.simhash(F.col("h"))).collect():
        assert got == _line_print(words)


def _same_line(a, b):
    """The rule for two normalised lines: two equal blocks, few differing bits, few edits."""
    differ = _line_print(a.split()) ^ _line_print(b.split())
    blocks = sum(differ >> 12 * i & 4095 == 0 for i in range(5))
    n, m = sorted((len(a.split()), len(b.split())))
    if blocks < 2 or differ.bit_count() > 12 or (n + 1) // 8 < (m - 1) // 8:
        return False
    x, y = (a.split(), b.split()) if min(len(a.split()), len(b.split())) >= 40 else (a, b)
    return 5 * _edits(x, y) <= max(len(x), len(y))


def test_lines_of_near_groups_equal_brute_force(spark):
    """Groups of lines that are edited again and again: what goes is what the rule connects with an earlier line."""
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]
    lines = []
    for size in (12, 30, 45, 60):
        for _ in range(3):
            line = rng.choice(vocabulary, size).tolist()
            for step in range(14):
                lines.append(" ".join(line))
                line[int(rng.integers(0, size))] = str(rng.choice(vocabulary))
    lines = list(dict.fromkeys(lines))
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if abs(len(lines[i]) - len(lines[j])) < 60 and _same_line(lines[i], lines[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i for i in range(len(lines)) if root(i) != i}
    got = rows(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(7)))
    assert {r["doc_id"] for r in got if r["_n_removed"]} == want and len(want) > 60


def _edited(rng, words, kind, limit):
    """The line after one kind of edits, as many as stay within ``limit`` characters."""
    made, spent = list(words), 0
    for at in rng.permutation(len(words)).tolist():
        word = made[at]
        other = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
        cost = {"replace": max(6, len(word or "")), "insert": 7, "delete": len(word or "") + 1, "misspell": 1}[kind]
        if spent + cost > limit:
            break
        spent += cost
        made[at] = {"replace": other, "insert": f"{word} {other}", "delete": None, "misspell": f"{word[:2]}q{word[3:]}"}[kind]
    return " ".join(w for w in made if w)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _edited_lines():
    """``size, kind, share, id`` of pairs within the edit rule by brute force, and the documents: ids ``id`` and ``id + 1``."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vocabulary = ["".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(3000)]
    data, cases = [], []
    for size in (3, 5, 10, 20, 38, 50, 80):
        for kind in ("replace", "insert", "delete", "misspell"):
            for share in (0.1, 0.19):
                for _ in range(4):
                    words = rng.choice(vocabulary, size).tolist()
                    line = " ".join(words)
                    near = _edited(rng, words, kind, share * len(line))
                    by_words = min(size, len(near.split())) >= 40
                    a, b = (line.split(), near.split()) if by_words else (line, near)
                    if line != near and 5 * _edits(a, b) <= max(len(a), len(b)):
                        cases.append((size, kind, share, len(data)))
                        data += [(len(data), line), (len(data) + 1, near)]
    return cases, data


def test_lines_recall_against_brute_force(spark):
    """Every pair that the rule links is found, no other; how many of all edit-similar lines that is, README says."""
    cases, data = _edited_lines()
    removed = {r["doc_id"] for r in rows(line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string"))) if r["_n_removed"]}
    texts = dict(data)
    assert removed == {i + 1 for *_, i in cases if _same_line(texts[i], texts[i + 1])}
    found = collections.defaultdict(list)
    for size, kind, share, i in cases:
        found["long" if size >= 38 else "short", kind, share].append(i + 1 in removed)
    print({k: (sum(v), len(v)) for k, v in sorted(found.items())})


def test_lines_within_three_bits_always_meet():
    from itertools import combinations

    blocks = [set(range(12 * i, 12 * i + 12)) for i in range(5)]
    rng = np.random.default_rng(1)
    for _ in range(300):
        bits = set(rng.choice(60, 3, replace=False).tolist())
        assert any(not bits & (a | b) for a, b in combinations(blocks, 2))


def test_line_columns_of_any_name_stay(spark):
    """Extra columns with the operator's own names come back as they were, from the operator and from the filter."""
    names = "_doc _lines _text _removed _n_removed _n_lines doc lines own removed text.x keep id".split()
    docs = spark.createDataFrame([(1, "a line\nA  line!\nother"), (2, "a line"), (3, None)], "doc_id long, text string")
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for got in (line_dedup.dedup_lines(docs.drop("_n_lines", "_n_removed")), line_dedup.filter_documents(docs)):
        for r in rows(got):
            assert all(r[name] == f"own {name}" for name in names if name not in ("_n_lines", "_n_removed") or got.columns == docs.columns)
    kept = {r["doc_id"]: r["text"] for r in rows(line_dedup.filter_documents(docs))}
    assert kept == {1: "a line\nother", 3: None}


def test_lines_of_shared_ids(spark):
    """Texts without an id or under one id are documents of their own: no line is lost with another text's place."""
    least, most = -(1 << 63), (1 << 63) - 1
    data = [(None, "x\ny"), (None, "y\nz"), (7, "p\nq\nr"), (7, "q\nr\ns"), (7, "q\nr\ns"), (least, "x\nk"), (most, "k\nl\nl")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(line_dedup.dedup_lines(docs))
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in data)
    lines = {i: sorted({(r["text"], r["_n_removed"]) for r in got if r["doc_id"] == i}) for i in (None, 7, least, most)}
    assert lines[None] in ([("x", 1), ("y\nz", 0)], [("x\ny", 0), ("z", 1)])
    assert lines[7] in ([("p", 2), ("q\nr\ns", 0)], [("p\nq\nr", 0), ("s", 2)])
    assert lines[least] == [("k", 1)] and lines[most] == [("l", 2)]


def test_lines_empty_table(documents):
    assert line_dedup.dedup_lines(documents([]).limit(0)).count() == 0


# nearest neighbours


def test_chi_square():
    x = ann.chi_square_quantile(0.95, 2)
    assert abs(x - 5.991464547) < 1e-6


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((600, 12))
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    data += [(1000 + i, data[5][1]) for i in range(40)]  # a frequent vector
    bad = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] + [1.0] * 11), (2060, [None] + [1.0] * 11), (2080, [])]
    df = spark.createDataFrame([*data, *bad, data[0]], "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = collections.defaultdict(list)
    for r in rows(ann.search(df, F.col("vec_id") % 20 == 0, 10)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in data if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        query = np.array(dict(data)[q])
        best = sorted((-float(np.dot(np.array(x), query)), i) for i, x in data if i != q)[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - float(np.dot(np.array(dict(data)[i]), query))) < 1e-9 for _, i, s in found)
        hit += len({i for _, i in best} & {i for _, i, _ in found})
    assert hit >= 0.9 * 10 * len(got)


def test_neighbours_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in rows(ann.search(df, F.col("vec_id") % 20 == 0, 5))] == [(0, 20), (20, 0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0


# packing


def test_place_fills_gaps():
    sizes = np.sort(np.random.default_rng(1).integers(1, 64, 2000))[::-1]
    seq, offset = packing.place(sizes, 64)
    for b in range(seq.max() + 1):
        used = sorted((o, s) for o, s in zip(offset[seq == b], sizes[seq == b]))
        assert used[0][0] == 0 and all(a + s == n for (a, s), (n, _) in zip(used, used[1:])) and used[-1][0] + used[-1][1] <= 64
    rooms: list[int] = []
    for size in sizes.tolist():  # first fit decreasing
        at = next((i for i, room in enumerate(rooms) if room >= size), None)
        if at is None:
            rooms.append(64 - size)
        else:
            rooms[at] -= size
    assert seq.max() + 1 <= 1.03 * len(rooms)


def test_pieces_are_the_library_ids(documents, word_vocabulary):
    texts = [*ODD, "Some words, and more. " * 3000, "İstanbul ΣΑΣ é"]
    docs = documents([(i, t) for i, t in enumerate(texts)] + EDGES[:2])
    got = collections.defaultdict(list)
    placed = rows(packing.pack_documents(docs, word_vocabulary))
    for r in placed:
        got[r["doc_id"]].append(r)
    plain = Tokenizer.from_file(word_vocabulary)
    for i, text in enumerate(texts):
        ids = plain.encode(text, add_special_tokens=False).ids + [1]
        if i == 1:
            continue  # id 1 also stands among the edges
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        want = [(k, 4096 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[i]) == want
    by = collections.defaultdict(list)
    for r in placed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for used in by.values():
        used.sort()
        assert used[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(used, used[1:])) and sum(used[-1]) <= 4096
    assert packing.pack_documents(docs.limit(0), word_vocabulary).count() == 0


# url filters


def test_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/x?y", "https://example.net", "http://x.org/fr/", "http://www.example.com/de/?a=1", "nonsense", None, "ftp://b.com/p#f", "http://notexample.com/de/", "http://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x"))
    got = {r["page_id"]: r for r in rows(url_filter.judge(df))}
    assert [got[i]["rule"] for i in range(9)] == ["example.net/en/", None, "org/fr/", "example.com/de/", None, None, None, None, "net/"]
    assert [got[i]["verdict"] for i in (0, 2, 3, 8)] == ["allow", "allow", "block", "block"]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/x") and (got[4]["host"], got[5]["path"]) == ("", "")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in rows(url_filter.judge(df.where("page_id = 4")))} == {"allow"}


def test_trees_learn_held_out_urls(spark):
    data = [(i, f"http://site{i}.com/{'a/' * (i % 3)}p{i}" if i % 2 else f"http://x{i}.com/q?a={i * 7919}&b={i}&c=1") for i in range(400)]
    df = spark.createDataFrame(data, "page_id long, url string")
    known = F.when(F.pmod(F.xxhash64("page_id"), F.lit(4)) > 0, F.when(F.col("page_id") % 2 == 0, 1).otherwise(0))
    got = rows(url_filter.judge(df, rules=[], labels=known))
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 0) for r in got) > 0.95 * len(got)


# BPE


def test_bpe_equals_the_library(documents, byte_vocabulary):
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("aabtheing sn'\n.,0é"), rng.integers(1, 80))) for _ in range(300)]
    texts = ODD + noise + ["Long. " * 20000]
    plain = Tokenizer.from_file(byte_vocabulary)
    docs = documents(list(enumerate(texts)) + [(None, "x"), (9999, None)])
    got = rows(bpe.encode_documents(docs, byte_vocabulary, with_ids=True))
    assert len(got) == len(texts) + 2
    for r in got:
        text = {None: "x", 9999: ""}.get(r["doc_id"]) if r["doc_id"] in (None, 9999) else texts[r["doc_id"]]
        ids = plain.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = plain.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), byte_vocabulary).count() == 0


# MinHash


def brute_components(texts, size):
    sets = {i: minhash.shingle_set(t or "", size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_minhash_groups_and_chains(documents):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = {0: " ".join(base), 1: " ".join(base), 2: None, 3: "", 4: "Two words", 5: "two WORDS", 6: " \n "}
    for i in range(10, 90):  # near copies of a base, some too far from it but near to others
        words, at = list(base), rng.integers(0, 120, i % 9)
        for p in at:
            words[p] = f"edit{i % 5}-{p}"
        texts[i] = " ".join(words)
    docs = documents(list(texts.items()) + [(0, texts[0])])
    got = rows(minhash.near_duplicates(docs, 4))
    want, sizes = brute_components(texts, 4)
    assert len(got) == len(texts) + 1
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[i], want[i], want[i] == i)
    kept = [r["doc_id"] for r in minhash.filter_documents(docs, 4).select("doc_id").collect()]
    assert sorted(kept) == sorted(i for i in want if want[i] == i)
    assert minhash.near_duplicates(docs.limit(0), 4).count() == 0


def test_minhash_null_id(documents):
    got = rows(minhash.near_duplicates(documents([(None, "some words of a text here"), (5, "some words of a text here")]), 4))
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (5, 5, True)}


def test_minhash_ids_with_several_texts(spark):
    """The texts of one id share a component; the filter loses none of them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(3, b), (5, b), (5, a), (9, a), (11, c), (11, c + " zz"), (12, "one unlike text of some words"), (12, "quite another thing with other words"), (12, "quite another thing with other words"), (None, a), (13, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("_key", F.lit("own")).withColumn("known", F.lit("x"))
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in rows(minhash.near_duplicates(docs, 4))}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 12, True), (None, None, True), (13, 13, True)}
    kept = minhash.filter_documents(docs, 4)
    assert kept.columns == docs.columns and {r["_key"] for r in rows(kept)} == {"own"}
    left = sorted(((r["doc_id"], r["text"]) for r in rows(kept)), key=str)
    either = [r for r in left if r[0] == 11]
    assert len(either) == 1 and either[0][1] in (c, c + " zz")
    want = [(3, b), (5, a), (12, "one unlike text of some words"), (12, "quite another thing with other words"), (None, a), (13, "")]
    assert [r for r in left if r[0] != 11] == sorted(want, key=str)


# language model


def test_scores_beside_brute_force(documents):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(f"W{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 50) for i in range(120)}
    texts |= {500: None, 501: ""}
    got = {r["doc_id"]: r for r in rows(language_model.score_documents(documents(list(texts.items()))))}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in texts.items()}
    part = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}

    def counts(keep):
        one, two = collections.Counter(), collections.Counter()
        for i, ts in tokens.items():
            if keep(part[i]):
                one.update(ts)
                two.update(zip(["^", *ts], ts))
        return one, two, sum(keep(p) for p in part.values())

    one, two, docs = counts(lambda p: p != 2)
    total, words = sum(one.values()), len(one)
    held = collections.Counter()
    m1, m2, mdocs = counts(lambda p: p not in (2, 3))
    for i, ts in tokens.items():
        if part[i] == 3:
            for h, w in zip(["^", *ts], ts):
                c = mdocs if h == "^" else m1[h]
                q = [round(language_model.GRID * math.log2(x * (len(m1) + 1))) if x else -1000 for x in (m2[h, w] / c if c else 0, m1[w] / sum(m1.values()))]
                held[(int(language_model.bucket(np.array([c]))[0]), *q)] += 1
    table = language_model.weights_table(language_model.mixture([(*k, n) for k, n in held.items()]))
    for i, ts in tokens.items():
        r, score = got[i], 0.0
        for h, w in zip(["^", *ts], ts):
            c = docs if h == "^" else one[h]
            a = table[int(language_model.bucket(np.array([c]))[0])]
            score += math.log10(a[0] * (two[h, w] / c if c else 0) + a[1] * one[w] / total + a[2] / (words + 1))
        assert r["score"] == pytest.approx(score, rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (total + words + 1)) for w in ts), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(one[w] > 0 for w in ts), total, part[i] == 2)


def test_scores_of_odd_tables(documents):
    assert language_model.score_documents(documents([]).limit(0)).count() == 0
    got = rows(language_model.score_documents(documents(EDGES)))
    assert len(got) == len(EDGES) and all(math.isfinite(r["score"]) for r in got)


# toxicity


def test_kernel_beside_definition():
    def slow(a, b):
        def spans(s):
            out = collections.Counter()
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, len(s)):
                        out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = spans(a), spans(b)
        dot = lambda p, q: sum(p[t] * q[t] for t in p)
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    units = ["idiot", "idxiot", "loser", "aaaa", "banana"]
    got = toxicity.kernel(units, units)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            assert got[i, j] == pytest.approx(slow(a, b), abs=1e-5)


def test_toxicity_learns_and_tolerates(spark, documents):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    data, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 30))
        if i % 5 == 0:
            words[rng.integers(30)] = rng.choice(["grumpfox", "blorkhead"])
        data.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    data += [(1000, "well grumpfox"), (1001, "a g.r.u.m.p.f.o.x b"), (1002, "you blorkkhead"), (1003, " ".join(plain[:40])), (1004, None), (1005, "")]
    docs, table = documents(data), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.scores(docs, model))}
    assert len(got) == len(data) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert [got[i] >= 0.7 for i in range(1000, 1006)] == [True, True, True, False, False, False]
    kept = toxicity.filter_documents(docs, table)
    assert kept.columns == docs.columns and kept.where("doc_id = 1000").count() == 0 and kept.where("doc_id = 1004").count() == 1


def test_toxicity_learns_more_words_than_landmarks(spark, documents, monkeypatch):
    rng = np.random.default_rng(6)
    make = lambda letters, size, n: list({"".join(rng.choice(list(letters), size)) for _ in range(n)})
    plain, bad = make("aeioulnrst", 6, 300), make("bcdfghjkmpqvwxyz", 8, 90)
    texts = [" ".join(rng.choice(plain, 30)) + (f" {bad[i // 2 % 90]}" if i % 2 == 0 else "") for i in range(6000)]
    docs, table = documents(list(enumerate(texts))), spark.createDataFrame([(i, 1 - i % 2) for i in range(6000)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train_machine
    monkeypatch.setattr(toxicity, "train_machine", lambda toxic, clean: seen.append((toxic, clean)) or train(toxic, clean))
    model = toxicity.fit(docs, table)
    assert set(seen[0][0]) == set(bad) and not set(seen[0][1]) & set(bad)
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.scores(docs, model))}
    held = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 2 == 0) for i in held)


def test_toxicity_landmarks_are_spread():
    names = ["grumpfox", "grumpfoxy", "grumpfoxx", "blorkhead", "blorkheads", "zzyzzyva"]
    assert toxicity.spread(names, 6) == names
    assert {n[:5] for n in toxicity.spread(names, 3)} == {"grump", "blork", "zzyzz"}


def test_toxicity_without_labels(spark, documents):
    table = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in rows(toxicity.scores(documents(EDGES), toxicity.fit(documents(EDGES), table)))} == {0.0}


# quality


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    symbols = sum(c in quality.SYMBOLS for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, documents):
    real = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    docs = documents(real + [(10**6, None), (10**6 + 1, "a b c a b c\n\na b c a b c"), (10**6 + 2, "é é é é | x")])
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    for r in rows(quality.judge(docs, [])):
        n, chars, symbols, dup, repeated = slow_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and r["kept"] != r["base_failed"]


def test_decision_list_as_expression(spark):
    rng = np.random.default_rng(9)
    data = []
    for i in range(900):
        row = {f: float(rng.random()) for f in quality.FEATURES}
        row["bad"] = int(row["symbol_rate"] > 0.8 or (row["upper_share"] > 0.7 and row["mark_rate"] > 0.5))
        data.append(row)
    rules = quality.learn(data)
    assert 1 <= len(rules) <= 8
    frame = spark.createDataFrame([(i, *(r[f] for f in quality.FEATURES)) for i, r in enumerate(data)], ["i", *quality.FEATURES])
    for r in frame.select("i", quality.verdict(rules).alias("keep")).collect():
        assert r["keep"] == (not any(x.holds(data[r["i"]]) for x in rules))
    wrong = sum(any(x.holds(r) for x in rules) != bool(r["bad"]) for r in data)
    assert wrong < 0.05 * len(data)
    assert quality.learn([]) == []


def test_quality_filter_keeps_columns(spark, documents):
    docs = documents([*EDGES, (7, " ".join(f"w{i}" for i in range(80)))])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in rows(kept)] == [7]


# WARC


def test_warc_round_trip(spark):
    data = [(3, "http://a/", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b/\r\nX: y", None), (5, "u", ""), (6, "é", "ü" * 200_000), (6, "é", "ü" * 200_000), (None, "n", "<p>x</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = rows(warc.archive_round_trip(df))
    assert len(got) == len(data)
    for r in got:
        html = next(h for i, _, h in data if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc.digest(html.encode())
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 5: ("revisit", 2), 6: ("response", None), None: ("revisit", 1)}
    assert {r["record_type"] for r in rows(warc.archive_round_trip(df, min_bytes=10**6))} == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_frames_and_faults():
    records = [warc.page_record(i, f"http://h/{i}", (f"page {i} " * 40).encode(), None) for i in range(300)]
    data = b"".join(warc.archive(records))
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc._frames(memoryview(data), "a")) == records
    with pytest.raises(ValueError, match="cut off"):
        list(warc._frames(memoryview(data[:-5]), "a"))
    with pytest.raises(ValueError, match="stated length"):
        warc.parse_record(records[0].replace(b"page 0", b"page", 1))
    with pytest.raises(ValueError, match="missing"):
        warc.parse_record(records[0].replace(b"WARC-Date", b"WARC-Then"))
