import hashlib
import itertools
import random

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newslens.llm import pii


@settings(max_examples=600, deadline=None)
@given(st.text("a@.-+ 0129(_é", max_size=50))
def test_base_spans(t):
    assert pii.base_spans(t) == brute.pii(t)


def marginals(unary, pairs, weight):
    """Of all labellings, by enumeration."""
    n, labels = unary.shape
    total = np.zeros((n, labels))
    for x in itertools.product(range(labels), repeat=n):
        p = np.exp(sum(unary[i, k] for i, k in enumerate(x)) + sum(w for (a, b), w in zip(pairs, weight) if x[a] == x[b]))
        for i, k in enumerate(x):
            total[i, k] += p
    return total / total.sum(axis=1, keepdims=True)


def test_beliefs_are_marginals(monkeypatch):
    """On trees messages give the exact marginals; ROUNDS of them come near, and on loops of moderate weight they do too."""
    rng = np.random.default_rng(4)
    for k in range(40):
        n = int(rng.integers(2, 7))
        unary = rng.normal(0, 1.5, (n, 3))
        tree = [(int(rng.integers(0, i)), i) for i in range(1, n)]
        weight = rng.uniform(0.2, pii.SKIP, len(tree))
        exact = marginals(unary, tree, weight)
        monkeypatch.setattr(pii, "ROUNDS", 200)
        assert np.allclose(np.exp(pii.believe(unary, np.array(tree), weight)), exact, atol=1e-6)
        monkeypatch.undo()
        assert np.abs(np.exp(pii.believe(unary, np.array(tree), weight)) - exact).max() < 0.05
        loop = [*tree, (0, n - 1)] if n > 2 and (0, n - 1) not in tree else tree
        weak = np.full(len(loop), pii.CHAIN)
        assert np.abs(np.exp(pii.believe(unary, np.array(loop), weak)) - marginals(unary, loop, weak)).max() < 0.02


def test_similar_mentions_agree():
    t = "Call +1 (656) 555-6669 now. Later 656-555-6669 and (656) 555-6669, and again 656-555-6669. Other 123-456-7890."
    found = [t[a:b] for a, b, _ in pii.added_spans(t, pii.base_spans(t))]
    assert found == ["656-555-6669", "(656) 555-6669", "656-555-6669"]


def test_many_weak_repeats_do_not_make_a_span():
    t = " and ".join(["123-456-7890"] * 40) + " 2024 1234 5678"
    assert pii.added_spans(t, pii.base_spans(t)) == []


def test_a_sure_mention_convinces_many():
    t = "+1 212-555-0199 " + "and more words to part them by some distance " * 3 + " then ".join(["212-555-0199"] * 200)
    assert len(pii.added_spans(t, pii.base_spans(t))) == 200


def test_disguised_addresses():
    t = "write to jo.doe (at) example (dot) com"
    assert pii.redact_text(t) == "write to [EMAIL]"


def test_disguised_address_of_many_labels():
    address = "jo.doe(at)" + "(dot)".join(["mail"] * 12) + "(dot)org"
    t = f"Please write an email to {address} today."
    assert [t[a:b] for a, b, kind in pii.added_spans(t, pii.base_spans(t)) if kind == "email"] == [address]


def test_long_texts_are_linear():
    for t in ("1" * 300_000, "a@" * 200_000, "a" * 300_000 + "@", "1.1." * 100_000, "+1 " * 100_000):
        assert isinstance(pii.base_spans(t), list)


def test_table(spark, documents):
    rows = [(1, "mail a.b@ex.com 4111 1111 1111 1111"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "mail a.b@ex.com 4111 1111 1111 1111"), (4, "é 1.2.3.4 " * 3000)]
    out = pii.find(documents(rows)).select("doc_id", F.sha2(pii.digest(F.col("base")), 256).alias("h"), pii.digest(F.col("spans")).alias("s"), *[pii.count(F.col("base"), k).alias(k) for k in pii.KINDS]).collect()
    want = []
    for i, t in rows:
        spans = ",".join(f"{k}:{a}:{b}" for a, b, k in brute.pii(t))
        want.append((i, hashlib.sha256(spans.encode()).hexdigest(), spans))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r["doc_id"], r["h"], r["s"]) for r in out], key=key) == sorted(want, key=key)
    assert pii.find(documents([])).count() == 0


def test_redact_keeps_rows(spark, documents):
    df = documents([(1, "x 1.2.3.4 y"), (2, None), (1, "x 1.2.3.4 y")])
    out = pii.redact(df)
    assert out.schema.names == df.schema.names
    assert sorted((r["doc_id"], r["text"] or "", r["n_chars"] or 0) for r in out.collect()) == [(1, "x [IP] y", 8), (1, "x [IP] y", 8), (2, "", 0)]


def test_fuzz_added_never_overlaps():
    random.seed(1)
    for _ in range(300):
        t = "".join(random.choice(["+1 656 555 6669", "656-555-6669", " tel ", "a@b.co", " (at) ", "4111111111111111", "1.2.3.4", " x "]) for _ in range(12))
        base = pii.base_spans(t)
        added = pii.added_spans(t, base)
        assert all(b <= c or d <= a for a, b, _ in added for c, d, _ in base)
