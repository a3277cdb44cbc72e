import math
import zlib

import numpy as np
import pyarrow as pa

from tecflow.llm import language, textnum as tn

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ra"], "bb": ["sch", "ein", "ver", "ung", "keit"], "cc": ["éa", "çon", "où", "ête", "lle"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(rng, n=300):
    return [(i, text(x, int(rng.integers(5, 80)), rng), x) for i, x in enumerate(rng.choice(list(SYLLABLES), n))]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(np.random.default_rng(1)) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 ?!", None), (1003, "#%&" * 500, "bb"), (None, "kalo mitu", None), (1, "kalo mitu", "aa")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.identified(docs).collect()
    assert len(got) == len(rows)
    want = {(i, t): x for i, t, x in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == want.get((r.doc_id, dict((a, b) for a, b, _ in rows[:300]).get(r.doc_id))) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1000, 1001, 1002, 1003}
    assert all(r.rejected == (r.lang_pred == "und") for r in got)


def test_text_unlike_any_language_is_rejected(spark):
    rng = np.random.default_rng(2)
    rows = corpus(rng) + [(5000, "ωξψ жщю " * 100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in language.identified(docs).where("rejected").collect()] == [5000]


def test_pieces_do_not_change_the_counts():
    rng = np.random.default_rng(3)
    texts = pa.array([t for _, t, _ in corpus(rng, 40)] + [None, "", "Ä"])
    whole = np.concatenate([language.counts(p)[0] for p in tn.pieces(texts)])
    parts = np.concatenate([language.counts(p)[0] for p in tn.pieces(texts, 100)])
    assert (whole == parts).all() and whole[-1].sum() == 1


def test_no_languages_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identified(docs).first().lang_pred == "und"
    assert language.identified(docs.limit(0)).count() == 0


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & (1 << 64) - 1
    return x ^ (x >> 31)


def plain_vector(text, idf):
    """The TF-IDF vector of one text, n-gram by n-gram."""
    codes, count = [], {}
    for ch in text:
        code = (ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch)) if ch.isalpha() else 0
        if code or not codes or codes[-1]:
            codes.append(code)
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            gram, value = codes[i : i + n], 0
            if n == 1 and not gram[0]:
                continue
            for c in gram:
                value = mixed((value + c + 1) & (1 << 64) - 1)
            count[value % language.SIZE] = count.get(value % language.SIZE, 0) + 1
    out = [0.0] * language.SIZE
    for b, k in count.items():
        out[b] = math.log(1 + k) * float(idf[b])
    return out


def test_nearest_centroid_equals_brute_force(spark):
    rows = corpus(np.random.default_rng(4), 120) + [(900, "Éa ou kalo?! schein", None), (901, "x", "aa"), (902, "ka" * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    for r in language.predicted(docs, model).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        v = plain_vector(text, model.idf)
        size = math.sqrt(sum(x * x for x in v))
        near = [sum(a * float(b) for a, b in zip(v, c)) / size for c in model.centroids]
        best = max(range(len(near)), key=lambda j: near[j])
        assert r.lang_pred == model.languages[best] and abs(r.score - min(1, near[best])) < 1e-4
        letters = sum(c.isalpha() for c in text)
        floor = model.floors[best] * math.sqrt(letters / (letters + language.HALF))
        assert r.rejected == (r.score < floor) or abs(r.score - floor) < 1e-4


def test_repetitive_junk_goes_and_clean_rows_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gone = {r.doc_id for r in language.identified(docs).where("rejected").collect()}
    junk, clean = set(), set()
    for r in docs.collect():
        words = (r.text or "").split()
        runs = sum(a == b for a, b in zip(words, words[1:]))
        if len(words) >= 100 and runs > 0.85 * len(words):
            junk.add(r.doc_id)
        elif words and runs < 0.05 * len(words) and "!!" not in r.text:
            clean.add(r.doc_id)
    assert len(junk) > 6 and len(gone & junk) >= 0.8 * len(junk)
    assert len(clean) > 700 and len(gone & clean) <= 0.01 * len(clean)


def test_one_id_with_many_rows_does_not_grow_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "FITTED_ROWS", 20)
    rng = np.random.default_rng(6)
    rows = [(1, text("aa", 8, rng), "aa") for _ in range(300)] + [(4, "ein schver", "bb")] * 300 + [(7, text("aa", 30_000, rng), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = []
    whole = language.staged
    monkeypatch.setattr(language, "staged", lambda df, name: (picked.append(df.count()) if name == "chosen" else None, whole(df, name))[1])
    model = language.fit(docs)
    assert picked == [21] and set(model.languages) == {"aa", "bb"} and len(model.languages) <= 2 * language.CLUSTERS


def test_equal_cosines_go_to_the_first_language():
    x = np.zeros((1, language.SIZE), np.float32)
    x[0, :3] = 1 / np.sqrt(3)
    model = language.Model(np.ones(language.SIZE, np.float32), ["aa", "bb"], np.concatenate((x, x)), np.zeros(2))
    assert language.judged(pa.array(["abc", "zzz"]), model)[0] == ["aa", "aa"]
