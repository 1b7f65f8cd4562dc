import brute

from newslens.llm import quality_rules

CLEAN = "the quick brown fox jumps over a lazy dog near some old river bank while birds sing and {k} small boats drift past the tall reeds at dusk"
NOISE = "a### b$$$ c%%% d&&& e*** f||| g<<< h>>> i### j$$$ k%%% l&&& m*** {k}"


def texts():
    rows = [(k, CLEAN.format(k=f"w{k}") + "\nand so on" * (k % 3)) for k in range(300)]
    rows += [(1000 + k, NOISE.format(k=k)) for k in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "one two"), (2004, "a b c d e " * 3), (2005, "x\nx\ny\n \n\ny"), (None, CLEAN), (5, CLEAN.format(k="w5")), (2006, "wort é ü " * 4000), (2007, "a b c d e f g h i j a b c d e")]
    return rows


def test_counts_and_verdicts(documents):
    rows = texts()
    out = quality_rules.judge(documents(rows)).collect()
    want = sorted(((i is None, i or 0), *brute.rules(t)) for i, t in rows)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == want
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert all(r["kept"] for r in out if r["doc_id"] is not None and r["doc_id"] < 300)
    assert all(not r["kept"] and r["failed_rate"] == "symbol_rate" for r in out if r["doc_id"] is not None and 1000 <= r["doc_id"] < 1020)


def test_keep_is_judge(documents):
    df = documents(texts())
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in quality_rules.judge(df).where("kept").collect())
    out = quality_rules.keep(df)
    assert out.schema.names == df.schema.names
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == kept


def test_thresholds_follow_the_source(spark):
    """What is odd in one source is common in another."""
    rows = [(k, CLEAN.format(k=f"w{k}"), "en", "prose", 0) for k in range(250)] + [(1000 + k, NOISE.format(k=f"n{k}"), "en", "tables", 0) for k in range(250)]
    rows += [(5000, NOISE.format(k="odd"), "en", "prose", 0)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not out[5000] and all(out[1000 + k] for k in range(250)) and all(out[k] for k in range(250))


def test_limits_come_from_the_sketches(spark):
    """Sources differ in the limits of every ratio; a small one leans on its language without a jump; no symbol-free source rejects a long text for a few symbols."""
    word = "abcdefghijklmnop"

    def text(k, long, symbols, lines):
        body = " ".join(f"{word[: long + (k + j) % 3]}{k}x{j}" for j in range(40))
        return body + " #" * (k % symbols) + "\nsame line" * (k % lines) + f"\nend {k}"

    rows = [(k, text(k, 3, 2, 3), "en", "plain", 0) for k in range(400)] + [(1000 + k, text(k, 8, 12, 9), "en", "dense", 0) for k in range(400)]
    rows += [(3000 + k, text(k, 3, 2, 3), "en", f"small{n}", 0) for n in (1, 20) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["source"]: r for r in quality_rules.limits(quality_rules.rates(quality_rules.counts(df))).collect()}
    for name in quality_rules.RATIOS:
        high = {s: found[s][f"high_{name}"] for s in found}
        assert high["plain"] < high["dense"], name
        assert min(high["plain"], high["dense"]) <= high["small20"] <= max(high.values()) and abs(high["small1"] - high["small20"]) <= high["dense"] - high["plain"]
    clean = [(k, CLEAN.format(k=f"w{k}"), "en", "s", 0) for k in range(300)] + [(900, " ".join(CLEAN.format(k=f"v{j}") for j in range(100)) + " # $ %", "en", "s", 0), (901, "l e t t e r s " * 1 + " ".join(map(chr, range(97, 123))), "en", "s", 0)]
    kept = {r["doc_id"]: (r["kept"], r["failed_rate"]) for r in quality_rules.judge(spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert kept[900][0] is False or kept[900][1] is None
    assert kept[901] == (False, "word_length") and all(kept[k][0] for k in range(300))


def test_empty(documents):
    assert quality_rules.judge(documents([])).count() == 0 and quality_rules.keep(documents([])).count() == 0
