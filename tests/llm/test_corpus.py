"""Mixing, packing, the classifiers, and the pipeline."""

import os
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newslens.llm import mixing, packing, pu_quality, registry, toxicity

SMALL = "/root/testdata/sf0.001"


def mix_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("kind", ["plain", "nulls", "one", "blank", "empty"])
def test_mixing(spark, kind):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), ["b", "a", "ä", "A", "zz"][min(4, int(rng.integers(0, 9)))]) for k in range(400)]
    if kind == "nulls":
        rows += [(k, "x y z", None) for k in range(30)] + [(None, "a b", "b"), (None, None, None), (3, "a b c", "b"), (3, "a b c", "b"), (900, "q " * 5000, "a")]
    rows = {"plain": rows, "nulls": rows, "one": [(1, "a b c", "s")], "blank": [(1, None, "s"), (2, " ", None)], "empty": []}.get(kind, rows)
    df = mix_rows(spark, rows)
    out = mixing.mix(df).select("doc_id", "source", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"), "pieces").collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes)
    got = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
    assert all(got[s] == round(want[s]) or abs(got[s] - want[s]) <= 1 for s in got)
    # blocks are disjoint and full but for a source's last; each is in one shard; shards differ by few blocks
    blocks, shards = {}, {}
    for r in out:
        for p in r["pieces"]:
            key = (r["source"], p["block"])
            blocks[key] = blocks.get(key, 0) + p["length"]
            assert shards.setdefault(key, p["shard"]) == p["shard"]
    if kind == "plain":
        width = max(blocks.values())
        last = {s: max(b for x, b in blocks if x == s) for s, _ in blocks}
        assert all(n == width for (s, b), n in blocks.items() if b < last[s])
        counts = [list(shards.values()).count(k) for k in range(mixing.SHARDS)]
        assert max(counts) - min(counts) <= 4
    again = {(r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(df.repartition(3)).select("doc_id", "source", "size", mixing.taken(F.col("pieces")).alias("taken")).collect()}
    assert again == {(r["doc_id"], r["source"], r["size"], r["taken"]) for r in out}


def test_mixed_rows(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(1 + k % 9)), ["a", "b"][k % 2]) for k in range(200)]
    df = mix_rows(spark, rows)
    want = {(r["doc_id"]): r["taken"] for r in mixing.mix(df).select("doc_id", mixing.taken(F.col("pieces")).alias("taken")).collect()}
    got = {}
    for r in mixing.mixed(df, chars_col=None).collect():
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        assert text.startswith(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in want.items() if v}


def test_mixed_rows_follow_the_draw(spark, monkeypatch):
    """Each slot holds the words that the tree gives its shard, in the order of their places; another draw gives other rows."""
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(1 + k % 9)), ["a", "b", None][k % 3]) for k in range(300)] + [(3, "x y z v", "b"), (3, "p q r s", "b"), (None, "n1 n2", "a"), (700, None, "a")]
    df = mix_rows(spark, rows)

    def by_slot():
        out = mixing.mixed(df, chars_col=None, cut=True).withColumn("task", F.spark_partition_id()).collect()
        tasks = {}
        for r in out:
            tasks.setdefault(r["task"], []).append((r["doc_id"], r["text"]))
        return tasks

    got = by_slot()
    shards = {}
    for r in mixing.mix(df).collect():
        for p in r["pieces"]:
            shards[p["shard"]] = shards.get(p["shard"], 0) + p["length"]
    # tasks hold whole shards: a shard that is alone has its words, and all have all
    words = sorted(sum(len(t.split()) for _, t in x) for x in got.values())
    assert sum(words) == sum(shards.values()) and len(got) > 4
    assert sum(n in shards.values() for n in words) >= 3
    texts = {(i, w) for i, t, _ in rows for w in (t or "").split()}
    assert all((i, w) in texts for x in got.values() for i, t in x for w in t.split())
    assert by_slot() == got
    fixed = mixing.split
    monkeypatch.setattr(mixing, "split", lambda quotas, n: fixed(quotas.withColumn("rank", -F.col("rank")), n).withColumn("rank", -F.col("rank")))
    assert by_slot() != got


def check_packing(rows, out, tokenizer):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for _, t in rows]
    whole = sorted((i is None, i or 0, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids))
    pieces = {}
    for r in out:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    total = sum(len(x) for x in ids)
    assert sum(r["length"] for r in out) == total
    by_seq = {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] > 0 and r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 4096 or at & (at - 1) == 0
    if len({i for i, _ in rows}) == len(rows):
        for (i, _), x in zip(rows, ids):
            own = sorted(pieces[i, len(x)], key=lambda r: r["start"])
            assert np.array_equal(np.concatenate([r["ids"] for r in own]), x) and [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
    return whole


@pytest.mark.parametrize("kind", ["table", "odd", "empty"])
def test_packing(spark, documents, kind):
    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    if kind == "table":
        df = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    else:
        rows = [] if kind == "empty" else [(1, None), (2, ""), (3, "a " * 4095), (4, "a " * 4096), (5, "a " * 20000), (None, "x"), (7, "don't <|endoftext|> É́ 中文 \x1c\x85 İ"), (8, " \n ")] + [(100 + k, "word " * (k % 700)) for k in range(700)]
        df = documents(rows)
    check_packing(rows, packing.pack(df, registry.tokenizer_path(), with_ids=True).collect(), tokenizer)


def test_closest_sum():
    rng = np.random.default_rng(5)
    for _ in range(200):
        counts = {int(k): int(c) for k, c in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(1, 120))
        reach = {0}
        for k, c in counts.items():
            reach |= {r + k * j for r in reach for j in range(c + 1) if r + k * j <= room}
        chosen = packing.closest_sum(counts, room)
        assert all(chosen[k] <= counts[k] for k in chosen) and sum(k * c for k, c in chosen.items()) == max(reach)


def accuracy(out, labels, column):
    rows = out.join(labels, "doc_id").where("held_out").select("predicted", "score", column).collect()
    right = sum(r["predicted"] == r[column] for r in rows) / len(rows)
    return right, len(rows)


# the smaller table has some thirty toxic rows to learn from, too few for a lexicon in four languages (held-out accuracy 0.947)
@pytest.mark.parametrize("query, column, sf, least", [("op6_toxicity", "toxic", "/root/testdata/sf0.1", 0.97), ("op10_pu_quality", "quality", "/root/testdata/sf0.01", 0.97)])
def test_held_out(spark, query, column, sf, least):
    out = registry.queries()[query](spark, sf)
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    right, n = accuracy(out, spark.read.parquet(f"{sf}/labels.parquet"), column)
    assert n > 50 and right >= least


def test_labels_of_held_out_rows_are_not_learnt(spark):
    ids = spark.range(1000).select(F.col("id").alias("doc_id"), registry.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in ids)


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 1)], [(1, 0), (2, 0)], [(99, 1), (None, 1), (1, 1), (1, 0)]])
def test_classifiers_without_much(spark, documents, labels):
    df = documents([(1, "good text here"), (2, None), (3, ""), (None, "x" * 50_000), (1, "good text here")])
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.fit(df, known)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    out = pu_quality.classify(df, known.withColumnRenamed("toxic", "quality"), F.lit(True)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    none = documents([])
    assert toxicity.score(none, toxicity.fit(none, known)).count() == 0
    assert pu_quality.classify(none, known.withColumnRenamed("toxic", "quality"), F.lit(True)).count() == 0


def test_deobfuscation():
    texts = ["you are an idiot and a loser with stupid trash ideas, pathetic moron"] * 50 + ["the man said that it was fine and the other people were there too"] * 200
    decoder = toxicity.Decoder(*toxicity.string_counts(texts))
    for odd, plain in (("1d10t!", "idiot"), ("s t u p i d", "stupid"), ("stuuupiiid", "stupid"), ("l.o.s.e.r", "loser"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("p4th3tic", "pathetic")):
        assert plain in toxicity.words_of(f"so {odd} then", decoder), odd
    assert decoder.restored("the other people said that") == set()


DISGUISES = [
    ("1d10t!", "idiot"), ("shi7", "shit"), ("a55", "ass"), ("shi+", "shit"), ("|diot", "idiot"), ("(rap", "rap"), ("st" + "u" * 46 + "pid", "stupid"), ("idio" + "o" * 45 + "t", "idiot"),
    ("people_" * 6 + "1d10t" + "_people" * 6, "idiot"), ("you are a s t u p i d man", "stupid"), ("y o u a r e a n i d i o t", "idiot"), ("s.t.u.p.i.d p.e.o.p.l.e", "stupid"),
    (" ".join("the man said that the people were there and the idiot"), "idiot"), (".".join("stupidstupidstupidstupidstupid"), "stupid"), ("caf\u00e9 1d\u00e9e", "id\u00e9e"),
]


@pytest.mark.parametrize("odd, plain", DISGUISES)
def test_disguises_of_any_length(odd, plain):
    texts = ["you are an idiot and a loser with stupid trash, pathetic moron ass shit rap id\u00e9e"] * 50 + ["the man said that it was fine and the other people were there too"] * 200
    decoder = toxicity.Decoder(*toxicity.string_counts(texts))
    assert plain in toxicity.words_of(f"so {odd} then", decoder)
    assert decoder.restored("fine! (the other people) said that, and more") <= {"fine", "the", "people"}


def test_texts_are_read_by_tokens():
    """Reading distinct tokens, remembered or not, finds what the patterns find in the whole text."""
    words = ["stupid", "people", "idiot", "ended", "w\u00f6rter", "word"]
    pieces = [*words, "st*pid,", "1d1ot.", "idiooooot!", "s.t.u.p.i.d", "i d i o t", "s-t-u-p-i-d", "(word)", "a55", "x=ab12cd", "...", "\u00e9t\u00e9$$$", "a.b", "12", "e" * 70, "\u00a0"]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(pieces, size=k)) for k in rng.integers(0, 30, 200)]
    decoder = toxicity.Decoder(*toxicity.string_counts([" ".join(words)] * 50))
    entries = toxicity.Entries(decoder)

    def whole(t: str) -> set[str]:
        plain = set(toxicity.WORD.findall(t))
        odd = {x for p, spelt in ((toxicity.MIXED, False), (toxicity.SPELT, True), (toxicity.DOTTED, True)) for m in p.finditer(t) for x in decoder.decode(m[0], spelt).split() if len(x) > 2}
        return plain | odd | {x for w in plain if (x := decoder.drawn_out(w))}

    expected = [whole(t) for t in texts]
    assert [toxicity.words_of(t, decoder) for t in texts] == expected
    for _ in range(2):  # the second time from memory
        assert [set(entries.text(t).tolist()) for t in texts] == [{k for w in e for k in toxicity._entry(w)} for e in expected]
    known = np.array(sorted({k for w in ("stupid", "idiot") for k in toxicity._entry(w)}))
    scorer = toxicity.Scorer(toxicity.Model(decoder.strings, decoder.counts, known, np.ones(len(known)), np.zeros(4), 0.0))
    for t, e in zip(texts, expected):
        found = scorer.features(t)
        assert bool(found[3]) == any(scorer.strength(w) for w in e)
        assert found == scorer.features(t)
    assert scorer.plain("people") == 0.0 and scorer.plain("stupidly") == 1.0


def test_model_counts_characters():
    """Counts are of code points, each string once, words apart from each other."""
    assert toxicity.symbols_of("caf\u00e9 \u2014\u4e2d1_Z").tolist() == [3, 1, 6, 27, 0, 0, 27, 0, 0, 26]
    strings, counts = toxicity.string_counts(["ab ab", "ab", None, ""])
    b = toxicity.SYMBOLS
    assert dict(zip(strings.tolist(), counts.tolist())) == {1: 3, b + 2: 3, (b + 2) * b: 3}
    whole = toxicity.string_counts(["some words, and \u00e9t\u00e9 " * 40])
    at, toxicity.CHUNK = toxicity.CHUNK, 7
    try:
        parts = toxicity.string_counts(["some words, and \u00e9t\u00e9 " * 40])
    finally:
        toxicity.CHUNK = at
    assert all((a == b).all() for a, b in zip(whole, parts))


def readings(decoder, token, spelt):
    """All readings of a token with their prices, one by one."""
    inner = [k for k, c in enumerate(token) if c.isalnum()]

    def go(k, context, before, price, text):
        if k == len(token):
            yield price + (decoder.cost(context, 0) if context % toxicity.SYMBOLS else 0), text.strip()
            return
        c = token[k]
        options = [(c, 0.0)] * c.isalpha() + [(x, toxicity.AS_OTHER) for x in toxicity.LOOKS.get(c, "")]
        if not c.isalnum():
            if spelt or not options or not inner or k <= inner[0] or k >= inner[-1]:
                yield from go(k + 1, context, before, price + toxicity.GAP, text)
            if context % toxicity.SYMBOLS:
                yield from go(k + 1, 0, "", price + toxicity.GAP + decoder.cost(context, 0), text + " ")
        if c == before:
            yield from go(k + 1, context, before, price + toxicity.REPEAT, text)
        for x, extra in options:
            s = ord(x) - 96 if "a" <= x <= "z" else 27
            yield from go(k + 1, context * toxicity.SYMBOLS % toxicity.SYMBOLS**4 + s, c, price + extra + decoder.cost(context, s), text + x)

    return list(go(0, 0, "", 0.0, ""))


def test_decoding_is_exact():
    """Viterbi finds the cheapest of all readings."""
    texts = ["you are an idiot and a loser with stupid trash ideas"] * 20 + ["the man said that it was fine"] * 30
    decoder = toxicity.Decoder(*toxicity.string_counts(texts))
    rng = np.random.default_rng(3)
    for k in range(150):
        token = "".join(rng.choice(list("adiot1**0$!+ s."), int(rng.integers(1, 8))))
        spelt = bool(k % 2)
        token = toxicity.squeezed(token)
        every = readings(decoder, token, spelt)
        got = decoder._decode(token, spelt)
        prices = [p for p, text in every if text == got]
        assert not every and got == "" or min(prices) <= min(p for p, _ in every) + 1e-9


def test_steps_go_down_the_risk(monkeypatch):
    """The first step of training against differences of the risk, on both sides of the zero of its second part."""
    monkeypatch.setattr(pu_quality, "BATCH", 4)
    sides = set()
    for seed in range(30):
        rng = np.random.default_rng(100 + seed)
        good, other = rng.normal(0, 3, (2, 1, pu_quality.WIDTH))  # one row of each, so that any draw gives the same batch
        prior = 0.9

        def risk(net, side):
            gp, gu = net.forward(good)[2][0], net.forward(other)[2][0]
            rest = np.logaddexp(0, gu) - prior * np.logaddexp(0, gp)
            first = prior * np.logaddexp(0, -gp)
            return rest, (first + rest if side else -rest) + pu_quality.DECAY / 2 * ((net.w1**2).sum() + (net.w2**2).sum())

        monkeypatch.setattr(pu_quality, "STEPS", 0)
        start = pu_quality.train(good, other, prior, seed)
        side = risk(start, True)[0] >= 0
        sides.add(bool(side))
        monkeypatch.setattr(pu_quality, "STEPS", 1)
        after = pu_quality.train(good, other, prior, seed)
        for name in ("w1", "b1", "w2"):
            at = getattr(start, name)
            for j in [tuple(rng.integers(0, m) for m in at.shape) for _ in range(10)]:
                kept = at[j]
                at[j] = kept + 1e-5
                up = risk(start, side)[1]
                at[j] = kept - 1e-5
                down = risk(start, side)[1]
                at[j] = kept
                slope = (up - down) / 2e-5
                if abs(slope) > 1e-4:
                    assert np.sign(getattr(after, name)[j] - kept) == -np.sign(slope)
    assert sides == {True, False}


def test_non_negative_risk():
    """Positives among the unlabelled are found as such, though no negative was shown."""
    rng = np.random.default_rng(1)
    good = rng.normal(1, 0.3, (500, pu_quality.WIDTH)).astype(np.float32)
    mixed = np.concatenate([rng.normal(1, 0.3, (700, pu_quality.WIDTH)), rng.normal(-1, 0.3, (300, pu_quality.WIDTH))]).astype(np.float32)
    net = pu_quality.train(good, mixed, 0.7)
    s = net.score(mixed)
    assert (s[:700] > 0.7).mean() > 0.95 and (s[700:] < 0.3).mean() > 0.95


def test_pipeline(spark):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")):
        pytest.skip("no pipeline here")
    import corpus_pipeline

    from newslens.llm import pii
    from newslens.llm.common import materialize

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, at = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, SMALL), "test")
        seen[name] = [r.asDict() for r in at.collect()]
        assert name == "pack" or at.columns == columns
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in seen["quality rules"]}
    assert kept == {r["doc_id"] for r in registry.op2_quality_rules(spark, SMALL).where("kept").collect()}
    groups = brute.jaccard([(i, start[i]) for i in kept])
    assert {r["doc_id"] for r in seen["near copies"]} == {c for _, _, c in groups}
    assert all(r["text"] == pii.redact_text(start[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in seen["personal data"])
    sizes, taken = {}, {}
    for r in seen["personal data"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    for r in seen["mix"]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    want = brute.targets(sizes)
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in want.items())
    check_packing([(r["doc_id"], r["text"]) for r in seen["mix"]], seen["pack"], Tokenizer.from_file(registry.tokenizer_path()))


@pytest.mark.parametrize("kind", ["hard", "empty"])
def test_pipeline_of_hard_rows(spark, documents, kind):
    """Nulls in any column, blank and very long texts, repeated rows and ids, ties, other columns with clashing names, no rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from newslens.llm import pii
    from newslens.llm.common import materialize

    rng = np.random.default_rng(8)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), size=rng.integers(3, 9))) for _ in range(n))
    clean = [text(60) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(50, clean[0]), (0, clean[0]), (0, clean[0]), (5, text(60)), (51, clean[1] + " more"), (None, text(60)), (None, text(60)), (None, clean[2])]
    rows += [(52, text(30) + " mail a.b@example.org now " + text(30)), (53, text(20_000)), (54, None), (55, ""), (56, " \n"), (None, None), (57, "short text")]
    at = documents(rows if kind == "hard" else [])
    columns, seen = at.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, ""), "test")
        seen[name] = [r.asDict() for r in at.collect()]
        assert name == "pack" or at.columns == columns
    if kind == "empty":
        assert not any(seen.values())
        return
    worded = sorted(t for _, t in rows if len((t or "").split()) >= 10)
    assert sorted(r["text"] for r in seen["quality rules"]) == worded
    components = {c for _, _, c in brute.jaccard(list(enumerate(worded)))}
    copies = [r["text"] for r in seen["near copies"]]
    assert len(copies) == len(components) == len(set(copies)) == 45 and set(copies) <= set(worded)
    assert sum(r["doc_id"] is None for r in seen["near copies"]) >= 2
    assert sorted(r["text"] for r in seen["personal data"]) == sorted(pii.redact_text(t) for t in copies)
    assert not any("a.b@example.org" in r["text"] for r in seen["personal data"])
    sizes, taken = {}, {}
    for name, total in (("personal data", sizes), ("mix", taken)):
        for r in seen[name]:
            total[r["source"]] = total.get(r["source"], 0) + len(r["text"].split())
    assert None in sizes and all(abs(taken.get(s, 0) - t) <= 1 for s, t in brute.targets(sizes).items())
    check_packing([(r["doc_id"], r["text"]) for r in seen["mix"]], seen["pack"], Tokenizer.from_file(registry.tokenizer_path()))
