"""Quality rules against plain Python."""

import re

import pytest

import fixtures
from cellweave.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@pytest.mark.parametrize("make", [fixtures.odd, fixtures.documents])
def test_measures(spark, make):
    got = quality_rules.measure(make(spark)).select("text", *MEASURES).collect()
    assert all(tuple(r[1:]) == brute(r.text) for r in got)


def test_overlapping_and_touching_repeats(spark):
    texts = ["a " * 30, "a b c d e f g h " * 2 + "x " + "a b c d e f g h", "a b c d e f g", " ".join(map(str, range(99)))]
    got = quality_rules.measure(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [r.n_repeat_words for r in got.select("n_repeat_words").collect()] == [brute(t)[4] for t in texts] == [30, 24, 0, 0]


def test_rules(spark):
    good = "the house of the king is in the land and it was built by a man with a plan for all " * 1
    prose = good + "of them to see that this is not an empty place but one with people in it"
    texts = {
        prose: set(),
        "few words": {"few_words"},
        "the end of it " * 30: {"repeated_words"},
        " ".join(w + "&&&" for w in prose.split()): {"symbols", "stop_words"},
        prose.upper(): {"capitals", "stop_words"},
        None: {"few_words", "word_length", "stop_words"},
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = quality_rules.quality_report(rows).collect()
    for r in got:
        assert texts[r.text] <= set(r.broken) and r.kept == (not r.broken), r
    assert [r.text for r in quality_rules.keep_good(rows).collect()] == [prose]


CLEAN = {
    "ru": "Старый дом стоял на берегу реки, и каждый вечер дети приходили сюда, чтобы послушать рассказы о далёких "
    "городах и морях, которые их дед видел много лет назад.",
    "pl": "Stary dom stał na brzegu rzeki, a dzieci przychodziły tu wieczorem, żeby posłuchać opowieści o dalekich "
    "miastach, które ich dziadek widział wiele lat temu i o których nie zapomniał.",
    "tr": "Eski ev nehrin kıyısında duruyordu ve çocuklar her akşam buraya gelip dedelerinin yıllar önce gördüğü uzak "
    "şehirler için anlattığı çok güzel hikayeleri bir arada dinliyordu.",
    "ar": "كان البيت القديم يقف على ضفة النهر وكان الأطفال يأتون إليه كل مساء ليسمعوا قصصا عن مدن بعيدة رآها جدهم قبل "
    "سنوات كثيرة ولم ينسها أبدا في حياته",
    "hi": "पुराना घर नदी के किनारे खड़ा था और बच्चे हर शाम यहाँ आकर दूर के शहरों की कहानियाँ सुनते थे जिन्हें उनके दादा ने कई साल पहले देखा था",
    "zh": "\n".join(f"{c}老房子坐落在河边，孩子们每天晚上都来这里听故事。" for c in "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥"),
}


def test_clean_texts_of_other_languages_are_kept(spark):
    junk = " ".join(f"keyword{chr(97 + i % 26)}{i} buycheap" for i in range(30))
    rows = spark.createDataFrame([*CLEAN.items(), ("junk", junk)], "lang string, text string")
    assert {r.lang: r.broken for r in quality_rules.quality_report(rows).collect()} == {x: [] for x in CLEAN} | {"junk": ["stop_words"]}
    assert {r.lang for r in quality_rules.keep_good(rows).collect()} == set(CLEAN)


def test_empty_table_and_columns(spark):
    assert quality_rules.keep_good(fixtures.none(spark)).count() == 0
    assert quality_rules.keep_good(fixtures.odd(spark)).columns == fixtures.odd(spark).columns


def test_no_python_in_the_plan(spark):
    df = quality_rules.op6_quality_rules(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
