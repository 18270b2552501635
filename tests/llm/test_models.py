"""Operators 1, 8, 9: held-out accuracy, codewords, WAND against exhaustive scoring, counterfactual effect."""

import random

import numpy as np

from loomdown.llm import decontam as D
from loomdown.llm import lang_id as L
from loomdown.llm import toxicity as T
from loomdown.llm.common import held_out

WORDS = {"aa": ["lorin", "tavek", "mosu", "dral"], "bb": ["ßchen", "übrig", "klanz", "wirt"], "cc": ["ción", "pelado", "ñumo", "esta"]}


def docs(spark, extra=()):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(5, 60))), lang, "x") for i, lang in enumerate(rnd.choice(list(WORDS)) for _ in range(240))]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string, id string")


def test_codewords_are_apart():
    for n in (2, 4, 6, 40):
        c = L.codewords(n).astype(int)
        far = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        assert c.shape[0] == n and far >= 1 and (n < 4 or far >= 3)


def test_language(spark):
    df = docs(spark, [(900, None, "aa", "x"), (901, "", "bb", "x"), (902, " 12 .", "bb", "x"), (None, "lorin tavek", None, "x"), (5, "mosu dral", "aa", "x")])
    got = L.predict(df, L.fit(df.where(~held_out()))).collect()
    assert len(got) == 245 and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.lang for r in df.where("doc_id < 240").collect()}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id != 5)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    empty = df.limit(0)
    assert L.fit(empty) is None
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"} and L.predict(empty, None).count() == 0


def test_rare_languages_are_learned(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb"] * 2000 + ["cc"] * 60)]
    rows += [(7, f"zorvix qulmar {i}", "dd") for i in range(50)] + [(9000, "wexu", "ee")]  # one id throughout; a single row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, max_rows=30)
    assert model.languages == ["aa", "bb", "cc", "dd", "ee"]
    got = L.predict(df.where("lang in ('cc', 'dd')"), model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"cc": 60, "dd": 50}
    sizes = {r.lang: r["count"] for r in df.groupBy("lang").count().collect()}
    kept = {r.lang: r["count"] for r in L._sample(df.select("lang", df.text.alias("t"), df.doc_id.alias("id")), sizes, 1000).groupBy("lang").count().collect()}
    assert kept["ee"] == 1 and min(kept["cc"], kept["dd"]) >= 20 and sum(kept.values()) < 1200


def test_blocks_do_not_change_margins(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 110, 3000).astype(np.uint8)
    ends, w = np.array([0, 10, 2500, 2500, 3000]), rng.normal(size=(2 * L.DIMS, 3)).astype(np.float32)
    whole = L.text_margins(data, ends, w)
    one = np.stack([L.text_margins(data[a:b], np.array([b - a]), w)[0] for a, b in zip([0, *ends[:-1]], ends)])
    # texts that share a block see the next text's first letters in their last n-grams
    assert np.abs(whole - one).max() < 1.5 and (whole[[0, 3]] == 0).all()


def test_margins_do_not_see_neighbours(monkeypatch):
    rng = np.random.default_rng(4)
    lengths = [1, 0, 1, 2, 5, 1, 0, 3, 700, 1, 2, 0]
    data, ends = rng.integers(97, 123, sum(lengths)).astype(np.uint8), np.cumsum(lengths)
    w = rng.normal(size=(2 * L.DIMS, 3)).astype(np.float32)
    want = []
    for a, b in zip([0, *ends[:-1]], ends):
        two, three = L.ngram_indices(data[a:b])
        want.append((w[two].astype(float) + w[three]).sum(axis=0) / max(b - a, 1))
    for block in (L._BLOCK, 64, 7, 1):
        monkeypatch.setattr(L, "_BLOCK", block)
        assert np.abs(L.text_margins(data, ends, w) - np.stack(want)).max() < 1e-4


def test_toxicity_counterfactual(spark):
    rnd = random.Random(2)
    plain = ["report", "garden", "window", "paper", "river", "market"]

    def text(bad, group):
        w = [rnd.choice(plain) for _ in range(12)] + (["grumblefoul"] if bad else []) + (["muslim"] if group else [])
        rnd.shuffle(w)
        return " ".join(w).capitalize() + "."

    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, text(bad, bad and i % 2 == 0), "x"))  # the term occurs in toxic texts only
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows + [(900, None, "x"), (901, "", "x"), (1, rows[1][1], "x")], "doc_id long, text string, id string")
    lab = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")
    fair, free = T.fit(d, lab), T.fit(d, lab, fairness=0.0)
    assert abs(fair.word("muslim") - fair.word("christian")) < 0.3 < abs(free.word("muslim") - free.word("christian"))
    got = T.score(d, fair).collect()
    assert len(got) == 303 and all(r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == int(r.doc_id < 300 and r.doc_id % 3 == 0) for r in got)
    assert sorted(r.doc_id for r in T.drop_toxic(d, fair).collect()) == sorted(r[0] for r in d.collect() if not (r[0] < 300 and r[0] % 3 == 0))
    assert T.score(d.limit(0), T.fit(d.limit(0), lab)).count() == 0
    assert T.swap_terms("The Muslim women met.") == "The christian men met."


def test_wand_is_exhaustive():
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 25))) + ". x y z w v") for i in range(150)]
    df = {}
    for _, t in items:
        for p in D._pairs(t):
            df[p] = df.get(p, 0) + 1
    ix = D.Index(items, df, len(items), 20)
    for _ in range(60):
        q = sorted(rnd.sample(range(len(ix.codes)), rnd.randint(1, 30)))
        total = np.zeros(len(ix.ids))
        for t in q:
            np.add.at(total, ix.items[t], ix.impacts[t])
        for threshold in (0.05, 0.2, 0.5):
            want = {int(i): total[i] for i in np.nonzero(total >= threshold - 1e-9)[0]}
            got = dict(ix.search(q, threshold))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_contamination(spark):
    q = "What is the tallest tower that stands in the old harbour town? It is the grey lamp house by the eastern pier."
    items = spark.createDataFrame([(1, q), (2, None), (3, ""), (4, "word"), (5, "Quite another question about seven green boats? Nobody knows the answer to this one.")], "item_id long, text string")
    pad = " ".join(f"w{i}" for i in range(500))
    half = " ".join(q.split()[:12])
    rows = [(1, f"{pad} {q.upper()} {pad}"), (2, pad), (3, f"{pad} {half} {pad}"), (4, None), (5, ""), (6, q.replace(" ", " ** ")), (6, q), (None, q), (7, q.replace("grey", "red").replace("old", "new").replace("east", "west"))]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, item string")
    for n in (1, 1000):
        got = sorted((str(r.doc_id), r.item_id) for r in D.contamination(docs, items, items_per_index=n).collect())
        assert got == [("1", 1), ("6", 1), ("6", 1), ("None", 1)]
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 7]
    assert D.contamination(docs, items.limit(0)).count() == 0 and D.contamination(docs.limit(0), items).count() == 0
