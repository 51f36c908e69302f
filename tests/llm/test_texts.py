import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import leak_index, mixing, quality, tokens


def kinds(c):
    n = unicodedata.category(c)
    return n[0] == "L", n == "Nd"


def split_words(text):
    return "".join(c if any(kinds(c)) else " " for c in text.lower()).split()


DOC = "doc_id bigint, text string, lang string, source string, item_id string, kind string"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, "clash", "clash") for i, t in enumerate(texts)], DOC)


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id bigint, text string, doc_id string")


def leaked(spark, d, i, **options):
    got = leak_index.leaks(docs(spark, d), items(spark, i), **options).collect()
    assert len({(r["doc_id"], r["item_id"], r["kind"]) for r in got}) == len(got)
    return got


def brute(d, i, n):
    grams = lambda t: {tuple(w[k : k + n]) for w in [split_words(t or "")] for k in range(len(w) - n + 1)}
    return {(a, b) for a, x in enumerate(d) for b, y in enumerate(i) if grams(x) & grams(y)}


@pytest.mark.parametrize("small", [False, True])
def test_phrases_match_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, passages routed to them, few candidates at a time
        for name, v in (("BLOCK_WORDS", 50), ("MOST_WINDOWS", 3), ("_STEP", 5)):
            monkeypatch.setattr(leak_index, name, v)
    rng = np.random.default_rng(0)
    vocab = ["the"] * 8 + [f"w{k}" for k in range(12)] + ["Éa", "straße", "x²y", "١٢"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    i = [say(rng.integers(2, 20)) for _ in range(12)] + ["", None, "a b"]
    i += [i[0]]
    d = [say(rng.integers(0, 60)) for _ in range(40)] + [None, "", "the " * 300, "{{" + "|".join((i[3] or "").split()) + "}}", say(30) + " " + (i[5] or "").upper()]
    got = leaked(spark, d, i, n_words=4)
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(d, i, 4)
    for r in got:
        x, y = split_words(d[r["doc_id"]]), split_words(i[r["item_id"]])
        assert x[r["doc_word"] : r["doc_word"] + r["n_words"]] == y[r["item_word"] : r["item_word"] + r["n_words"]]
        assert not brute([d[r["doc_id"]]], [i[r["item_id"]]], r["n_words"] + 1)


def test_proximity_empty_and_borders(spark):
    i = ["alpha beta gamma delta epsilon"]
    d = ["gamma x beta y alpha delta z epsilon", "alpha beta gamma", "delta epsilon", "beta " + "q " * 80 + "alpha", "Alpha, BETA; gamma-delta_epsilon!"]
    got = leaked(spark, d, i, n_words=5, proximity=True, rarest=4, span=10)
    assert {(r["doc_id"], r["kind"]) for r in got} == {(0, "proximity"), (4, "phrase")}
    assert leaked(spark, [], i) == [] and leaked(spark, d, []) == [] and leaked(spark, [None], [None]) == []


def test_words():
    for t in ["Ab_c d-e", "x² ½ Ⅷ y", "é́a", "𝟙𐐀 z", "İ ΟΔΟΣ", "", "１２a"]:
        assert leak_index.words(t) == split_words(t)


def plain_stats(text, common):
    w = re.findall(r"[^\W\d_]+", "".join(c if kinds(c)[0] else " " for c in text))
    seen = [c for c in text if c not in " \t\n\r"]
    lines = [x for x in (y.strip(" \t\n\r") for y in text.split("\n")) if x]
    return {"n_words": len(w), "n_letters": sum(map(len, w)), "n_visible": len(seen), "n_symbols": sum(not any(kinds(c)) for c in seen), "n_lines": len(lines), "n_ended": sum(x[-1] in ".!?" for x in lines), "n_common": sum(x.lower() in common for x in w)}


TEXTS = ["", " \t\r\n\n", "The cat.\r\nIs it? no\n\n * of the list\n| a | b ||\n12 ½ x²!", "ΟΔΟΣ the ÉTÉ İs of", "{{x}}" * 50, "the of " * 3000, "a\x0bb c. .", "of", "𐐀the of𐐀 the", None, "The end.\n" * 40, "* the\n" * 30, "| the | of | 3 |\n" * 30]


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_statistics_match_plain_ones(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "MOST_COMMON", most)  # few: common words are joined
    monkeypatch.setattr(quality, "_CHARS", 200)
    words = spark.createDataFrame([("en", "the"), ("en", "of"), ("en", "οδος"), ("en", "été"), ("fr", "cat"), (None, "x"), ("en", None)], "lang string, word string")
    got = {r["doc_id"]: r.asDict() for r in quality.text_quality(docs(spark, TEXTS, "EN-x"), words).collect()}
    assert got.keys() == {i for i, t in enumerate(TEXTS) if t is not None}
    for i, r in got.items():
        want = plain_stats(TEXTS[i], {"the", "of", "οδος", "été"})
        assert {k: r[k] for k in want} == want
        assert (r["mean_word_length"] is None) == (want["n_words"] == 0)
        shares = [r[f"{s}_share"] for s in quality.STATES]
        assert shares == [None] * 4 if want["n_lines"] == 0 else sum(shares) == pytest.approx(1)
    assert [got[i]["kind"] for i in (10, 11, 12)] == ["prose", "list", "table"]
    null = quality.text_quality(docs(spark, ["the of cat"], None), words).first()
    assert null["common_share"] is None
    odd = quality.text_quality(docs(spark, ["the of cat"], "zz"), words).first()
    assert odd["common_share"] == 0
    assert {r["failed"] for r in quality.failed_checks(quality.text_quality(docs(spark, ["?? ..", ""]), words)).collect()} == {"few_words", "symbols"}
    assert quality.text_quality(docs(spark, []), words.limit(0)).count() == 0


def test_viterbi_and_fit_against_enumeration():
    m = quality.LineModel()
    rng = np.random.default_rng(0)
    lengths = np.array([0, 3, 1, 4])
    codes = rng.integers(0, int(np.prod(quality._SIZES)), lengths.sum())
    got = m.label(lengths, codes)
    b = m.scores()
    at = 0
    for n in lengths:
        best = max(np.ndindex(*(4,) * n), key=lambda s, n=n, at=at: sum(np.log(m.start[s[0]]) if k == 0 else np.log(m.move[s[k - 1], s[k]]) for k in range(n)) + sum(b[codes[at + k], s[k]] for k in range(n))) if n else ()
        assert tuple(got[at : at + n]) == best
        at += n
    # Expected counts against the sum over all state sequences, and their sums over documents.
    got = m.expected(lengths, codes)
    want = np.zeros_like(got)
    values, at = np.unravel_index(codes, quality._SIZES), 0
    offset = np.r_[0, np.cumsum(4 * np.array(quality._SIZES))]
    for n in lengths:
        paths = list(np.ndindex(*(4,) * n)) if n else []
        p = np.array([np.exp(sum(np.log(m.start[s[0]]) if k == 0 else np.log(m.move[s[k - 1], s[k]]) for k in range(n)) + sum(b[codes[at + k], s[k]] for k in range(n))) for s in paths])
        for s, w in zip(paths, p / p.sum() if n else []):
            want[offset[-1] + 16 + s[0]] += w
            for k in range(n):
                for f, size in enumerate(quality._SIZES):
                    want[offset[f] + s[k] * size + values[f][at + k]] += w
                if k:
                    want[offset[-1] + 4 * s[k - 1] + s[k]] += w
        at += n
    np.testing.assert_allclose(got, want, atol=1e-9)
    fit = m.updated(got)
    np.testing.assert_allclose([e.sum(axis=1) for e in fit.emit], 1)
    np.testing.assert_allclose(fit.move.sum(axis=1), 1)


def planted(rng, kind):
    """Lines of one kind, in no wording that the model was made from."""
    words = ["river", "stone", "maple", "under", "seven", "bright", "harbour", "quiet", "window", "north", "copper", "of", "the", "and", "in", "was", "a", "to"]
    say = lambda n: " ".join(rng.choice(words, n))
    if kind == "prose":
        return (say(rng.integers(12, 40)).capitalize() + ". " + say(rng.integers(6, 20)).capitalize() + rng.choice([".", "!", "?", "."])).strip()
    if kind == "list":
        return rng.choice(["* ", "# ", "- ", "** "]) + say(rng.integers(1, 7))
    if kind == "table":
        return rng.choice(["| ", "|- ", "! "]) + " || ".join(rng.choice([say(1), str(rng.integers(1, 9999))]) for _ in range(rng.integers(2, 7)))
    return "".join(rng.choice(list("%$&@~^<>=+/_;:{}[]()0123456789qxzj "), rng.integers(5, 60)))


def test_planted_kinds_are_found(spark):
    rng = np.random.default_rng(8)
    kinds_ = list(rng.choice(quality.STATES, 400))
    texts = []
    for k in kinds_:
        other = [planted(rng, rng.choice(quality.STATES)) for _ in range(rng.integers(0, 3))]  # some lines of other kinds
        texts.append("\n".join([*(planted(rng, k) for _ in range(rng.integers(6, 15))), *other]))
    words = spark.createDataFrame([("en", w) for w in ("of", "the", "and", "in", "was", "a", "to")], "lang string, word string")
    got = {r["doc_id"]: r["kind"] for r in quality.text_quality(docs(spark, texts), words).collect()}
    for k in quality.STATES:
        found, true = {i for i in got if got[i] == k}, {i for i, x in enumerate(kinds_) if x == k}
        assert len(found & true) / max(len(found), 1) >= 0.9, k
        assert len(found & true) / len(true) >= 0.9, k


def test_line_model_is_fitted_on_all_documents(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["\n".join(planted(rng, rng.choice(quality.STATES)) for _ in range(rng.integers(1, 4))) for _ in range(2100)] + ["", None]
    words = spark.createDataFrame([("en", w) for w in ("of", "the", "and")], "lang string, word string")
    rounds = []
    plain = quality.LineModel.updated

    def updated(model, counts):
        rounds.append((model, counts, plain(model, counts)))
        return rounds[-1][2]

    monkeypatch.setattr(quality.LineModel, "updated", updated)
    monkeypatch.setattr(quality, "_CHARS", 20_000)
    assert quality.text_quality(docs(spark, texts), words).count() == 2101
    block = quality.measure(texts[:2100], ["en"] * 2100, quality.common_words(words))
    lengths = np.bincount(block.line_doc, minlength=2100)
    for model, counts, _ in (rounds[0], rounds[-1]):
        assert counts[-4:].sum() == pytest.approx(2100)  # a start per document with lines
        np.testing.assert_allclose(counts, model.expected(lengths, block.codes.astype(np.int64)), rtol=1e-9, atol=1e-9)
    old, _, new = rounds[-1]
    assert max(np.abs(a - b).max() for a, b in zip([*new.emit, new.move, new.start], [*old.emit, old.move, old.start])) <= 1e-4


def test_pieces_of_long_documents_give_the_same_counts(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([0, 3, 1, 40, 6, 7, 0, 300, 12, 2])
    codes = rng.integers(0, int(np.prod(quality._SIZES)), lengths.sum())
    m = quality.LineModel()
    m = m.updated(m.expected(lengths, codes))
    monkeypatch.setattr(quality, "_PIECE", 10**9)
    want = m.expected(lengths, codes)
    for n in (1, 3, 50):
        monkeypatch.setattr(quality, "_PIECE", n)
        np.testing.assert_allclose(m.expected(lengths, codes), want, rtol=1e-9)
    monkeypatch.setattr(quality, "_LINES", 8)
    column = pa.ListArray.from_arrays(np.r_[0, 0, np.cumsum(lengths)].astype(np.int32), codes.astype(np.int32)).slice(1)
    parts = list(quality._documents(column))
    assert len(parts) > 3 and [i for rows, _, _ in parts for i in range(rows.start, rows.stop)] == list(range(len(lengths)))
    np.testing.assert_allclose(sum(m.expected(n, c) for _, n, c in parts), want, rtol=1e-9)


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, "plan_id int, source string, weight double, max_repeats int")


@pytest.mark.parametrize("small", [False, True])
def test_shares_caps_and_missing_sources(spark, monkeypatch, small):
    if small:  # cuts searched on several levels, tables joined instead of sent
        monkeypatch.setattr(mixing, "CUT_ROWS", 1)
        monkeypatch.setattr(mixing, "MOST_SENT", 0)
    rng = np.random.default_rng(0)
    rows = [(i, "big" if i < 2000 else "mid" if i < 2600 else "small", int(v)) for i, v in enumerate(np.exp(rng.normal(5, 1, 2800)).astype(int) + 1)]
    plan = targets(spark, [(1, "BIG", 5.0, 1), (1, "mid ", 3.0, 2), (1, "small", 1.0, 4), (1, "none", 2.0, 1), (2, "small", 1.0, None), (2, "mid", 1.0, None), (3, "none", 1.0, None), (4, "big", 1.0, 0), (4, "small", None, 1), (5, "big", 0.5, 1), (5, "Big", 0.5, 3), (1, None, 1.0, 1), (None, "big", 1.0, 1)])
    copies, goals = mixing.mix(sizes(spark, rows), plan)
    got = {(r["plan_id"], r["source"]): r for r in mixing.shares(copies, goals).collect()}
    for key, share in {(1, "big"): 5 / 9, (1, "mid"): 3 / 9, (1, "small"): 1 / 9, (2, "small"): 0.5, (2, "mid"): 0.5}.items():
        assert got[key]["actual_share"] == pytest.approx(share, abs=0.01)
    for r in got.values():
        assert r["max_repeats"] is None or r["most_copies"] <= max(r["max_repeats"], 0)
        assert r["tokens"] == pytest.approx(r["goal_tokens"], rel=0.03, abs=1)
    assert got[1, "none"]["tokens"] == got[4, "big"]["tokens"] == got[3, "none"]["tokens"] == 0
    assert got[5, "big"]["most_copies"] == 1
    again = mixing.mix(sizes(spark, rows), plan)[0]
    assert again.exceptAll(copies).count() == 0
    large = mixing.mix(sizes(spark, rows), plan, total=10**9)
    assert all(r["most_copies"] == r["max_repeats"] for r in mixing.shares(*large).where("plan_id = 1 and tokens > 0").collect())
    assert mixing.mix(sizes(spark, []), plan)[0].count() == 0 and mixing.mix(sizes(spark, rows), plan.limit(0))[0].count() == 0


def test_inclusion_follows_chances(spark):
    # One band of unequal sizes, drawn under many plans.
    rows = [(i, "s", 64 + 8 * (i % 8)) for i in range(80)]
    plans = targets(spark, [(p, "s", 1.0, 1) for p in range(300)])
    total = 80 * 92 // 3
    copies, _ = mixing.mix(sizes(spark, rows), plans, total=total, size_power=1.0)
    hits = Counter()
    per_plan = Counter()
    for r in copies.collect():
        hits[r["n_tokens"]] += 1
        per_plan[r["plan_id"]] += 1
    assert max(per_plan.values()) - min(per_plan.values()) <= 1  # fixed size
    chance = {v: n / (300 * 10) for v, n in hits.items()}
    expected = mixing.copies_by_class({c: (n, t) for c, (n, t) in classes(rows).items()}, total, 1, 1.0)
    for v, p in chance.items():
        assert p == pytest.approx(expected[int(np.floor(np.log2(v) * mixing._CLASSES))], abs=0.05)


def classes(rows):
    out = {}
    for _, _, v in rows:
        c = int(np.floor(np.log2(v) * mixing._CLASSES))
        n, t = out.get(c, (0, 0))
        out[c] = n + 1, t + v
    return out


def test_tokens(spark):
    texts = ["Hello world, it's  12 tests", "", None, "<|endoftext|> é𐐀", "a" * 20_000]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs(spark, texts), ["doc_id"]).collect()}
    assert got[1] == 0 and got[2] is None and got[0] >= 8 and got[3] > 5
    with open(tokens.VOCABULARY, "rb") as f:
        e = tokens.encoding(f.read())
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts if t is not None)
    s = mixing.sized(docs(spark, texts, source=" Main-Dump "))
    assert {r["source"] for r in s.collect()} == {"main_dump"} and s.count() == 3
