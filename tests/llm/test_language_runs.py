"""Language identification of long runs of letters."""

import random
import re

from tributary.llm import langid


def model(spark, texts):
    rows = [(i, t, g) for i, (g, t) in enumerate(texts * 20)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_runs_are_cut_whole():
    rng = random.Random(2)
    some = "abzéß½жщ漢字仮かなカไทยאبـ가ⴰᚠ \n1_.,'"
    for _ in range(300):
        text = "".join(rng.choice(some) * rng.choice([1, 1, 1, 3, 50]) for _ in range(rng.randrange(30)))
        got = langid.WORD.findall(text)
        assert "".join(got) == "".join(re.findall(r"[^\W\d_]+", text))
        assert all(len(w) <= 40 and len({langid.script(c) for c in w}) == 1 for w in got)


def test_letters_beyond_the_fortieth_count(spark):
    aa, bb = "天地玄黄宇宙洪荒日月盈昃", "寒来暑往秋收冬藏闰余成岁"
    made = langid.Labeller(model(spark, [("aa", aa), ("bb", bb)]))
    text = aa * 4 + bb * 12
    lang, score, spans = made.label([text])[0]
    assert lang == "bb" and score > 0.7 and [s[2] for s in spans] == ["aa", "bb"]
    assert made.predict([text])[0] == (lang, score, 2)


def test_scripts_change_within_a_run(spark):
    made = langid.Labeller(model(spark, [("en", "the house is on the hill"), ("ru", "дом стоит на горе у реки")]))
    lang, _, spans = made.label(["thehouse" + "домстоитнагореуреки"])[0]
    assert lang == "ru" and spans == [(0, 8, "en"), (8, 27, "ru")]


def test_words_keep_their_marks(spark):
    hindi, bengali = "यह घर पहाड़ी पर है और सूरज चमक रहा है", "বাড়িটি পাহাড়ের উপর এবং সূর্য জ্বলছে"
    assert langid.WORD.findall(hindi) == hindi.split() and langid.WORD.findall(bengali) == bengali.split()
    assert langid.WORD.findall("café nähe") == ["café", "nähe"]
    own = model(spark, [("hi", hindi), ("bn", bengali), ("th", "บ้านอยู่บนเนินเขาและดวงอาทิตย์ส่องแสง"), ("zh", "房子在山上太阳照耀着大地我们今天去学校"), ("ja", "家は丘の上にあり太陽が輝いています")])
    label = langid.Labeller(own)
    for lang, text in (("hi", "पहाड़ी पर घर"), ("bn", "পাহাড়ের উপর"), ("th", "ดวงอาทิตย์ส่องแสง" * 40), ("zh", "太阳照耀着大地" * 60), ("ja", "丘の上にあり" * 50)):
        found, score, spans = label.label([text])[0]
        assert (found, score) == (lang, 1.0) and spans == [(0, len(text), lang)]
    # A switch inside one run of letters is found where it stands.
    zh, ja = "房子在山上太阳照耀着大地" * 4, "家はにあり輝いています" * 4
    spans = label.label([zh + ja])[0][2]
    assert [s[2] for s in spans] == ["zh", "ja"] and abs(spans[0][1] - len(zh)) <= 8


def test_ties_go_to_the_first(spark):
    own = model(spark, [("b", "aa bb"), ("a", "aa bb")])
    assert own.default == "a"
    assert langid.Labeller(own).label(["aa bb", "Привет"]) == [("a", 1.0, [(0, 5, "a")]), ("a", 0.0, [])]


def test_held_out_accuracy(spark):
    from tributary.llm.entry import op1_language_id

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = op1_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert len(held) > 200 and right / len(held) > 0.95, right / len(held)


def test_awkward_rows(spark):
    long = "the house is on the hill " * 20_000
    own = model(spark, [("en", "the house is on the hill"), ("de", "das haus steht auf dem berg")])
    rows = [(1, long, 1), (1, long, 2), (None, "das haus", 3), (2, None, 4), (3, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred int")
    got = sorted(map(tuple, langid.predict(docs, own).collect()), key=str)
    assert got == sorted([(1, "en", 1.0, 1), (1, "en", 1.0, 1), (None, "de", 1.0, 1), (2, "und", 0.0, 0), (3, "und", 0.0, 0)], key=str)
    assert langid.predict(docs.limit(0), own).count() == 0 and langid.keep_recognised(docs, own).columns == docs.columns
    assert langid.train(spark.createDataFrame([], "doc_id long, text string, lang string")).langs == []
