"""Cases that hold for many operators: clashing columns, very long texts; and models against plain loops."""

import math
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, decontaminate, html_text, language, licenses, line_dedup, mixing, ngram_join, quality, sharding
from docloom.llm.names import fresh, rest

#: Names that operators use inside, or have used, beside those of their results.
NAMES = (
    "_id _text _key _rows _h _s _class _cell _i _start _all _aim _whole _part _offset _size _w _k1 _k2 _shard _bucket _sub _copy _copies _told _score _quality_score "
    "_template _html _host _gone_id _gone_key _gone_h _run _y a b f h i id k key l line n node o pos q root seg sig size t v w words x y task "
    "shard slot target taken copies source_size lang_pred score ambiguous removed n_lines n_removed item_id distance license coverage"
).split()
ROWS = [(1, "one two three four five six", "en", "s0"), (2, "one two three four five six", "en", "s1"), (3, None, None, None), (4, "", "fr", "s0"), (None, "no id here at all", "fr", "s1")]


@pytest.fixture(scope="module")
def wide(spark):
    """Documents with a column of every name, each with its own value, and one with a dot in its name."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"is {name}").alias(name) for name in [*NAMES, "dot.ted", "_KEY2"]])


def test_names():
    class Df:
        columns = ["_key", "_KEY_", "x"]

    assert fresh(Df, "_key", "_key", "y") == ["_key__", "_key___", "y"] and rest(Df, "_KEY", "z") == ["_KEY_", "x"]


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")


@pytest.mark.parametrize(
    "run, results",
    [
        (lambda spark, df: quality.score(df, quality.fit(df, labels(spark))), ["score"]),
        (lambda spark, df: quality.keep_good(df, labels(spark), 0.0), []),
        (lambda spark, df: sharding.shard(df, 2), ["shard", "slot", "size"]),
        (lambda spark, df: line_dedup.dedup_lines(df), ["text", "n_lines", "n_removed", "removed"]),
        (lambda spark, df: language.predict(df, language.fit(df)), ["lang_pred", "score", "ambiguous"]),
        (lambda spark, df: html_text.extract(df.drop("x").withColumn("url", F.lit("http://a/")), html="source"), ["text"]),
        (lambda spark, df: mixing.mix_plan(df), ["size", "source_size", "target", "copies", "taken"]),
        (lambda spark, df: mixing.mix(df), []),
        (lambda spark, df: decontaminate.clean(df, spark.createDataFrame([(9, "nothing like this is there")], "item_id long, text string")), []),
        (lambda spark, df: ngram_join.keep_first(df), []),
    ],
    ids="score keep_good shard dedup_lines predict extract mix_plan mix clean keep_first".split(),
)
def test_clashing_columns_come_through(spark, wide, run, results):
    rows = run(spark, wide).collect()
    assert rows and len(set(rows[0].__fields__)) == len(rows[0].__fields__)
    for r in rows:
        for name in [*NAMES, "dot.ted", "_KEY2"]:
            if name in r.__fields__ and name not in results:
                assert r[name] == f"is {name}", name
    lost = {*wide.columns, *results} - set(rows[0].__fields__)
    assert lost <= {"x"}


@pytest.mark.parametrize("run", [lambda df: ngram_join.jaccard_components(df), lambda df: licenses.scan(df), lambda df: decontaminate.find(df, df.select(F.lit(1).alias("item_id"), "text").limit(1))], ids="components scan find".split())
def test_clashing_columns_do_not_matter(wide, run):
    assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(wide.select("doc_id", "text")).collect()))


def test_very_long_texts(spark):
    rng = random.Random(1)
    words = ["w%d" % rng.randrange(5000) for _ in range(400_000)]
    long = " ".join(words) + "\nlast line of it"
    item = " ".join(words[200_000:200_040])
    rows = [(1, long, "en", "s"), (2, long.replace("last", "final"), "en", "s"), (3, "x" * 3_000_000, None, "s"), (4, "\n".join(["l i n e"] * 50_000), "fr", "t"), (5, "short text here now ok", "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got[1][1:] == got[2][1:] == (1, 1) and got[3][0] == 1 and got[4][0] == 4
    found = decontaminate.find(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["distance"]) for r in found) == [(1, 0), (2, 0)] and long[found[0]["start"] : found[0]["stop"]] == item
    assert {r["doc_id"]: r["size"] for r in sharding.shard(df, 2).collect()} == {d: len(t) + 1 for d, t, _, _ in rows}
    assert {r["doc_id"]: r["size"] for r in mixing.mix_plan(df).collect()} == {d: len(t.split()) for d, t, _, _ in rows}
    scores = quality.score(df, quality.fit(df, labels(spark))).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores)
    told = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, language.fit(df)).collect()}
    assert set(told) == {1, 2, 3, 4, 5} and "und" not in told.values()
    mit = licenses.TEMPLATES["mit"]
    hit = licenses.scan(spark.createDataFrame([(1, f"{long} {mit} {long}")], "doc_id long, text string")).where("license = 'mit'").collect()
    assert [(r["coverage"], r["start"]) for r in hit] == [(1.0, len(long.split()))]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert kept[1] == long and kept[2] == "final line of it" and kept[4].count("\n") < 10


# ---- models against plain loops


def test_quality_trees_against_trying_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        g, h = rng.standard_normal(9), rng.random(9) + 0.1
        part = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        first = max(range(1, 9), key=lambda c: part(0, c) + part(c, 9))
        seconds = [sorted((first, c)) for c in range(1, 9) if c != first]
        a, b = max(seconds, key=lambda s: part(0, s[0]) + part(*s) + part(s[1], 9))
        want = np.concatenate([np.full(e - s, g[s:e].sum() / (h[s:e].sum() + 1)) for s, e in ((0, a), (a, b), (b, 9))])
        got = quality._tree(g, h)
        assert np.allclose(got, want) or len(set(got.round(9))) < 3  # fewer leaves where no cut gains
        g2, h2 = rng.standard_normal((4, 5)), rng.random((4, 5)) + 0.1
        gain, cells = quality._quadrants(g2, h2)
        best = -1
        for i in range(1, 4):
            for j in range(1, 5):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
                total = sum(g2[p].sum() ** 2 / (h2[p].sum() + 1) for p in parts) - g2.sum() ** 2 / (h2.sum() + 1)
                if total > best:
                    best, chosen = total, parts
        assert math.isclose(gain, best) and all(np.allclose(cells[p], g2[p].sum() / (h2[p].sum() + 1)) for p in chosen)


def test_quality_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, len(quality.NAMES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells it
    model = quality.Model(x, y)
    got = model(x[:50])
    for row, p in zip(x, got[:50]):
        total = model.base + sum(table[sum(c <= v for c in cuts)] for v, cuts, table in zip(row, model.cuts, model.tables))
        total += sum(cells[sum(c <= row[i] for c in model.coarse[i]), sum(c <= row[j] for c in model.coarse[j])] for i, j, cells in model.pairs)
        assert math.isclose(p, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((model(x) >= 0.5) == y).mean() > 0.9 and (0, 1) in [(i, j) for i, j, _ in model.pairs]


def test_quality_features_of_a_text():
    f = dict(zip(quality.NAMES, quality.features("Ab cd, cd\n\nX 12!\n")))
    assert f["words"] == pytest.approx(math.log1p(5)) and f["distinct"] == 1 and f["repeats"] == 0 and f["lines"] == pytest.approx(math.log1p(2))
    assert f["digits"] == pytest.approx(2 / 17) and f["upper"] == pytest.approx(2 / 17) and f["ends"] == 0.5 and f["top_word"] == pytest.approx(1 / 5)
    assert not quality.features(None).any() and not quality.features("").any() and quality.features(" ")[0] > 0


def test_language_counts_against_plain_loops():
    texts = ["Ab c", "é-ÀÇ 9x", "\U0002a6d6\U00031350 \U00030003"]
    mult, step = 0x9E3779B97F4A7C15, 0x1F1F3
    place = lambda code: (code * mult) % 2**64 >> 52
    for text, row in zip(texts, language.counts(texts)):
        low = [ord(c.lower()[0]) if c.isalpha() else 32 for c in text]
        at = lambda i: low[i] if 0 <= i < len(low) else 32
        want = Counter()
        for i, c in enumerate(low):
            if c != 32:
                want[place(c)] += 1
                want[place((c * step + at(i + 1) + 2**40) % 2**64)] += 1
                want[place((((at(i - 1) * step + c) * step) + at(i + 1) + 2**50) % 2**64)] += 1
                if at(i - 1) == 32:
                    want[place((32 * step + c + 2**40) % 2**64)] += 1
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == dict(want)


def test_language_decoding_against_every_codeword():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh"[2 * k : 2 * k + 2] + " "), 60)) for k in range(4) for _ in range(20)]
    x, _ = language._shares(texts)
    y = np.repeat(np.arange(4), 20)
    model = language.Model(["k", "l", "m", "n"], x, y)
    assert len(model.code[0]) == 7 and len({tuple(r) for r in model.code.T} | {tuple(-r) for r in model.code.T}) == 14
    out = model(texts)
    for row, told in zip(x, out.lang_pred):
        margin = np.clip((row - model.mean) @ model.w, -1.5, 1.5)
        loss = [sum(t * max(0, 1 - m * c) ** 2 for t, m, c in zip(model.trust, margin, word)) for word in model.code]
        assert told == model.names[int(np.argmin(loss))]
    assert (out.lang_pred == np.array(model.names)[y]).all()


def test_language_of_rare_letters_and_of_many_languages(spark):
    assert language._fold()[0x31350] == 0x31350 and language._fold()[sys.maxunicode] == 32
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, most=5)  # fewer than there are languages
    assert 0 < len(model.names) <= 5 and language.predict(df, model).count() == 40
