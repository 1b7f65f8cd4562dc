"""N-gram Jaccard join, suffix dedup, licenses, exact search."""

import math
import random
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest

from newslens.llm import licenses, maxscore, suffix_dedup, token_groups


def near_copies(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 9, 12, 30, 60, 150]))] for _ in range(16)]
    rows = []
    for i in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b.insert(k, rng.choice(vocabulary))
            elif b:
                b[min(k, len(b) - 1)] = rng.choice(vocabulary).upper()
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(b)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "É é " * 50), (n + 4, "é É " * 50)]


@pytest.mark.parametrize("kind", ["plain", "repeated", "empty"])
def test_jaccard(documents, kind):
    rows = {"plain": near_copies(1), "repeated": [(i // 3, t) for i, t in near_copies(2)] + near_copies(2)[:3], "empty": []}[kind]
    df = documents(rows)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in token_groups.join(df).collect())
    assert got == brute.jaccard(rows)
    out = token_groups.one_of_each(df)
    assert out.schema.names == df.schema.names
    assert sorted({r["doc_id"] for r in out.collect()}) == sorted({c for _, _, c in got})


def test_one_of_each_with_repeated_ids(documents, monkeypatch):
    """Unlinked texts under one id all stay, one row of each component does, and rows are numbered once."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (9, b + " more"), (7, c), (7, c), (8, ""), (8, ""), (8, None), (11, a)]
    calls, number = [], token_groups.unique_ids
    monkeypatch.setattr(token_groups, "unique_ids", lambda *x, **y: calls.append(1) or number(*x, **y))
    out = token_groups.one_of_each(documents(rows)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == [(5, a), (5, b), (7, c), (8, ""), (8, ""), (8, "")]
    assert len(calls) == 1


@pytest.mark.parametrize("repeated", [False, True])
def test_rows_without_id_are_documents(documents, repeated):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (None, a), (None, b), (None, b), (None, None), (7, c)] + [(7, "x y z v w")] * repeated
    df = documents(rows)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in token_groups.join(df).collect())
    assert got == sorted([(5, 57, 5), (0, 57, 5), (0, 57, 0), (0, 57, 0), (0, 0, 0), (7, 57, 7)] + [(7, 2, 7)] * repeated)
    out = [(r["doc_id"], r["text"]) for r in token_groups.one_of_each(df).collect()]
    assert sorted(out, key=str) == sorted([(5, a), (None, b), (None, None), (7, c)] + [(7, "x y z v w")] * repeated, key=str)
    left = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(df).collect())
    n = len(a)
    assert left == sorted([(5, n, 0), (0, n, n), (0, n, 0), (0, n, n), (0, 0, 0), (7, n, 0)] + [(7, 9, 0)] * repeated)


@pytest.mark.parametrize("part", [3, 1024])
def test_jaccard_large_group(documents, monkeypatch, part):
    """One group of near copies, most of which do not link, in blocks of any size."""
    monkeypatch.setattr(token_groups, "PART", part)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice([2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{i}y{rng.random()}"
        rows.append((i, " ".join(words)))
    df = documents(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in token_groups.join(df).collect()) == brute.jaccard(rows)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(token_groups, "COLUMNS", 5)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)))).astype(np.uint64) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = token_groups.overlaps(sets)
    assert all(got[i][j] == want[i][j] for i in range(30) for j in range(30) if i != j)


def test_jaccard_shared_passages(documents):
    """Documents that share much, but not enough, and chains of links."""
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(k, passage + " " + " ".join(f"d{k}x{j}" for j in range(70))) for k in range(60)]
    text = [f"c{k}" for k in range(100)]
    for k in range(30):
        rows.append((1000 + k, " ".join(text)))
        text = text[2:] + [f"c{200 + 2 * k}", f"c{201 + 2 * k}"]
    df = documents(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in token_groups.join(df).collect()) == brute.jaccard(rows)


def test_jaccard_threshold_is_exact(documents):
    """85 of 100 links, 84 of 100 doesn't."""
    words = [f"a{k}" for k in range(95)]
    for extra in range(8, 16):
        rows = [(1, " ".join(words)), (2, " ".join([*words, *(f"b{k}" for k in range(extra))]))]
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in token_groups.join(documents(rows)).collect()) == brute.jaccard(rows)


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("ab ") for _ in range(n)) for n in (100, 130, 250, 99, 160)]
    rows = []
    for i in range(90):
        parts = [rng.choice([rng.choice(shared), rng.choice(shared)[rng.randint(0, 30) :], "x" * rng.randint(0, 140), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts) if i % 17 else None))
    return rows


@pytest.mark.parametrize("hot", [4, 4096])
@pytest.mark.parametrize("kind", ["plain", "repeated", "empty"])
def test_suffix_dedup(documents, monkeypatch, kind, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = {"plain": passages(1), "repeated": [(i // 2, t) for i, t in passages(2)] + passages(2)[:2], "empty": []}[kind]
    out = suffix_dedup.dedup(documents(rows)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute.repeats(rows)


def test_suffix_samples_in_blocks(monkeypatch):
    """The cover sample does not depend on how a long text is cut into blocks."""
    rng = np.random.default_rng(1)
    b = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.samples(b)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = suffix_dedup.samples(b)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_licenses(documents):
    mit = licenses.TEMPLATES["mit-text"]
    words = mit.split()
    edited = " ".join([*words[:20], "changed", *words[21:]])
    cut = " ".join(words[:25])
    noise = " ".join(f"n{k}" for k in range(400))
    rows = [(1, f"{noise} {mit}, {noise}"), (2, f"x {edited} y"), (3, cut), (4, None), (5, ""), (6, "Released under the MIT License."), (7, "released, under the mit"), (8, noise), (1, "LICENSED UNDER CC BY-NC 4.0"), (None, "Released under the MIT License.")]
    got = sorted((r["doc_id"] or -1, r["license"]) for r in licenses.scan(documents(rows)).collect())
    assert got == [(-1, "mit-notice"), (1, "cc-by-nc-4.0-notice"), (1, "mit-text"), (2, "mit-text"), (6, "mit-notice")]
    assert licenses.scan(documents([])).count() == 0


def license_brute(rows):
    """Every text with every template, by shingles of words."""
    out = {}
    for i, t in rows:
        words = licenses.template_words(t or "")
        have = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for name, text in licenses.TEMPLATES.items():
            w = licenses.template_words(text)
            theirs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            found = len(theirs & have)
            if 100 * found >= licenses.CONTAINED * len(theirs):
                out[i, name] = max(found, out.get((i, name), (0, 0))[0]), len(theirs)
    return out


def edited_licenses(seed):
    """A text around each template, with one word in thirty or so changed, left out or added."""
    rng = random.Random(seed)
    rows = []
    for k, text in enumerate(licenses.TEMPLATES.values()):
        for v in range(6):
            words = text.split()
            for _ in range(len(words) * v // 150):
                j = rng.randrange(len(words))
                words[j : j + 1] = rng.choice([["changed"], [], [words[j], "added"]])
            filler = [f"n{rng.randrange(99)}" for _ in range(rng.randrange(40))]
            rows.append((10 * k + v, " ".join([*filler, *words, *filler])))
    return rows


def test_licenses_recall(documents):
    """What bands name is verified exactly; of what holds in edited copies, bands name all but a few."""
    rows = edited_licenses(5)
    true = license_brute(rows)
    got = {(r["doc_id"], r["license"]): (r["n_found"], r["n_template"]) for r in licenses.scan(documents(rows)).collect()}
    assert all(true[k] == v for k, v in got.items())
    assert len(true) > 150 and len(got) >= 0.95 * len(true)


def test_licenses_in_a_very_long_text(documents):
    """Each template once, far into a text of 200,000 words, whatever else it holds."""
    rng = random.Random(9)
    filler = [f"n{rng.randrange(5000)}" for _ in range(200_000)]
    text = " ".join([*filler[:150_000], *(t + " . " for t in licenses.TEMPLATES.values()), *filler[150_000:]])
    got = [r["license"] for r in licenses.scan(documents([(1, text), (2, " ".join(filler))])).collect()]
    assert sorted(got) == sorted(licenses.TEMPLATES)


def scores(rows, k):
    ok = {i: np.array([math.floor(256 * Fraction(x)) for x in v], dtype=object) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "ties", "few", "signs", "none"])
def test_maxscore(spark, kind):
    rng = np.random.default_rng(3)
    n, d = {"dense": (300, 64), "ties": (200, 6), "few": (4, 8), "signs": (150, 20), "none": (0, 4)}[kind]
    x = rng.normal(0, 0.2, (n, d)) if kind != "ties" else rng.integers(-1, 2, (n, d)) / 4
    if kind == "signs":
        x = np.abs(x) * np.where(np.arange(d) % 2, 1, -1)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    if kind == "dense":
        rows += [(1000, None), (1005, [None] * d), (1010, [float("nan")] * d), (1015, [float("inf")] + [0.0] * (d - 1)), (1020, [0.5] * 10), (1025, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for block in (100, 7):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in maxscore.top_k(df.where("vec_id % 5 = 0"), df, k=5, block=block).collect())
        assert got == scores(rows, 5)


def test_maxscore_takes_every_finite_vector(spark):
    """Components of any size, repeated and null ids, and columns whose names the operator uses itself."""
    rows = [(0, [1.0, 0.0]), (1, [2.0**33, 0.0]), (2, [0.5, 0.5]), (5, [0.0, 2.0**-30]), (6, [-(2.0**40), 3e300]), (7, [1e308, 0.0]), (10, [0.25, 1e-300])]
    rows = [r for r in rows if r[0] != 7]
    df = spark.createDataFrame([(i, v, 1, "x", k) for k, (i, v) in enumerate(rows)] + [(None, [9.0, 9.0], 1, "x", 0)], "vec_id long, embedding array<double>, score int, rank string, query_id int").repartition(2)
    few = lambda i: [r for r in rows if r[0] not in i]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in maxscore.top_k(df.where("vec_id in (0, 5)"), df.where("vec_id <> 6"), k=5).collect())
    assert got == [r for r in scores(few({6}), 5) if r[0] in (0, 5)] and got[0] == (0, 1, 1, 1 << 49)
    with pytest.raises(Exception, match="does not fit a long"):
        maxscore.top_k(df.where("vec_id = 6"), spark.createDataFrame([(1, [0.0, 1e300])], "vec_id long, embedding array<double>")).collect()
    again = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (3, [2.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in maxscore.top_k(again.where("vec_id = 0"), again).orderBy("rank").collect()] == [(3, 1 << 17), (3, 1 << 17), (3, 1 << 16)]


def test_maxscore_skips():
    """Candidates in blocks that cannot reach the threshold are not opened, and of the others few are scored on all terms."""
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 1, (40, 32))
    x = np.floor(32 * (centers[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 32))))
    shard, seen = maxscore.Shard(np.arange(4000), x), Counter()
    bound = shard.bounds(x[:50])
    for j in range(50):
        best = maxscore.search_shard(shard, bound[j], j, x[j], 5, [], seen)
        assert best == sorted(((s, i) for i, s in enumerate((x @ x[j]).tolist()) if i != j), key=lambda r: (-r[0], r[1]))[:5]
    total = 50 * 4000
    assert seen["skipped"] > 0.7 * total and seen["scored"] < 0.1 * total and seen["skipped"] + seen["opened"] >= total - 50
