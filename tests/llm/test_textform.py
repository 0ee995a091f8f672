"""The consistent form of texts."""

import unicodedata

import pytest
import regex
from hypothesis import given, settings, strategies as st

from fernmill.llm.textform import PLAIN, checked, differing, inconsistent_texts, transducer

ASIS = ["① 신입", "㎡ 10㎏", "Ω 프로젝트", "½ 재택", "™ 브랜드", "§3", "㈜가상", "São Paulo é", "러시아어(Перевод)", "👩‍💻 개발", "👨‍👩‍👧", "❤️", "※ ▶ ☆ ✔ ㆍ · •", "「필수」", "a\nb", "", "가각힣 ㄱㅏ", "αβγ"]
CASES = [
    ("ｊａｖａ　１２", "java 12"), ("(Е)ngine", "(Е)ngine"), ("Jаva", "Java"), ("kοtlin", "kotlin"), ("é", "é"), ("한글", "한글"), ("자​바", "자바"), ("a b c", "a b c"), ("soft­ware", "software"),
    ("﻿x", "x"), ("x‍", "x"), ("자‍바", "자바"), ("Ｅ－ｍａｉｌ（가）", "E-mail(가)"), ("ᄒ​ᅡᆫ", "한"), ("￦100", "₩100"), ("ﾡ", "ㄱ"), ("①​②", "①②"),
]


@pytest.mark.parametrize("text", ASIS)
def test_kept(text):
    assert transducer().apply(text) == text


@pytest.mark.parametrize(("text", "want"), CASES)
def test_changed(text, want):
    assert transducer().apply(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_stable_and_prefilter(text):
    once = transducer().apply(text)
    assert transducer().apply(once) == once
    if regex.match(PLAIN, text):
        assert once == text


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeEoO가각ㅏ각한\u0301\u0323\u0308\u0302\u093cक\u0958ẹ́éệ\u3099がか \u09c7\u09be\u0344\u1e9b\u0307"), max_size=12))
def test_compositions_against_unicode(text):
    assert transducer().apply(text) == unicodedata.normalize("NFC", text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Pythoд", "Pythod"), ("Ꭺpple", "Apple"), ("ꓑython", "Python"), ("Java\u0430\u0301x", "Java\u00e1x"), ("\u0430\u0301x", "\u00e1x"), ("Ⲁngular", "Angular"), ("Реrl", "Perl"), ("Perl-Д", "Perl-Д"), ("React를", "React를"), ("β-x λ", "β-x λ"), ("Nоde가", "Node가"), ("e\u200b\u0301", "é"),
        ("\u0301", "\u0301"), ("👍\u0301a", "👍\u0301a"), ("ｶ\uff9e", "ガ"), ("é\u0323", "ẹ́"), ("1️⃣ x", "1️⃣ x"), ("a\ufe0f", "a"),
    ],
)
def test_one_pass(text, want):
    assert transducer().apply(text) == want
    assert transducer().apply(want) == want


def test_long_marks():
    for text in ("a" + "\u0301" * 50_000, "\u1100" * 100_000, "а" * 100_000 + "b"):
        assert transducer().apply(text)


def test_conflicts():
    with pytest.raises(ValueError):
        checked({}, {"а": "о", "о": "o"})
    with pytest.raises(ValueError):
        checked({"а": "x"}, {"а": "a"})
    with pytest.raises(ValueError):
        checked({"Ａ": "Ｂ", "Ｂ": "B"})


def test_rows(spark):
    raw = spark.createDataFrame([(1, ["ok", None, "ｘ"], None), (2, None, ["", "a b", "y" * 200_000 + "​"]), (3, [], [])], "raw_id bigint, required array<string>, preferred array<string>")
    posting = spark.createDataFrame([(7, "Jаva"), (8, None), (9, "Java"), (7, "Jаva")], "row_id bigint, title string")
    got = sorted((r.field, r.row_key, r.item_no) for r in inconsistent_texts(raw, posting).collect())
    assert got == [("preferred", 2, 1), ("preferred", 2, 2), ("required", 1, 2), ("title", 7, 0), ("title", 7, 0)]
    assert inconsistent_texts(raw.limit(0), posting.limit(0)).count() == 0
    assert differing(spark.createDataFrame([("ｘ", "n")], "text string, other string"), text="text").first().norm == "x"


def test_prefilter_passes_what_changes(spark):
    texts = ["が", "パ゙", "a〈b〉", "〪〮", "⵿ⷠ", "ab\x85", "ab ", "ab ", "「가」 あ", "plain\n"]
    want = {t: transducer().apply(t) for t in texts if transducer().apply(t) != t}
    got = {r.text: r.norm for r in differing(spark.createDataFrame([(t,) for t in texts], "text string"), text="text").collect()}
    assert got == want and {"が", "ab\x85", "ab ", "ab "} <= set(got)
    for c in range(0x10000):
        if regex.match(PLAIN, chr(c)):
            assert transducer().apply(f"가{chr(c)}a") == f"가{chr(c)}a" and not unicodedata.combining(chr(c))
