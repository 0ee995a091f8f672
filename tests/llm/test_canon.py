"""Typed values and the canonical list."""

import random

import pytest

from fernmill.llm import canon
from fernmill.llm.canon import Dictionary, meant_entries, phonetic, weighted_edit, writing

ENTRIES = [(1, "Galmirdex"), (2, "Galmirdex Boot"), (3, "Torvexlin.js"), (4, "Brunokta++"), (5, "NelvopaDB"), (6, "Zanpoltik SQL"), (7, "Ost")]
ALIASES = [("갈미르덱스 부트", "Galmirdex Boot"), ("갈미르덱스", "Galmirdex"), ("gmx", "Galmirdex"), ("tvl", "없음"), ("torvexlin-js", None), ("unknown thing", "Plutrek"), ("잔폴틱 에스큐엘", "Zanpoltik SQL")]


@pytest.fixture(scope="module")
def d():
    return Dictionary(ENTRIES, ALIASES)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Galmirdex", 1), ("GALMIRDEX  ", 1), ('"Galmirdex"', 1), ("Galmirdx", 1), ("Glamirdex", 1), ("Gallmirdex", 1), ("Galmirdex v2", 1), ("Galmirdex (구 버전)", 1), ("Gаlmirdеx", 1), ("Ｇａｌｍｉｒｄｅｘ", 1),
        ("Gal​mirdex", 1), ("galmirdex-boot", 2), ("GalmirdexBoot", 2), ("갈미르덱스 부트", 2), ("갈미르덱스부트", 2), ("갈미르덱스", 1), ("torvexlin js", 3), ("Torvexlin_js", 3), ("Brunokta ++", 4), ("브루노크타 플러스플러스", 4),
        ("nelvopa.db", 5), ("gmx", 1), ("tvl", -1), ("없음", -1), ("-", -1), ("", -1), ("Plutrek", -1), ("Galmixyz", -1), ("ost", 7),
    ],
)
def test_values(d, text, want):
    assert d.value(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("• Galmirdex Boot, Torvexlin.js 사용 경험", {2, 3}),
        ("Galmirdex / Galmirdex Boot", {1, 2}),
        ("Galmirdex를 이용해 배포", {1}),
        ("갈미르덱스를 이용해", {1}),
        ("갈미르덱스 부트ㆍ브루노크타 플러스플러스", {2, 4}),
        ("사용 기술: GMX + nelvopa db", {1, 5}),
        ("Galmirdex Bot 튜닝", {2}),
        ("Post 관리, ghost", set()),
        ("Plutrek 활용", set()),
        ("데이터 품질을 책임지고 다뤄 본 분", set()),
        ("Torvexlin.js 3.x, Galmirdex(5.1)", {1, 3}),
    ],
)
def test_texts(d, text, want):
    assert set(d.scan(text)) == want


def test_long_names_of_many_words():
    name = "Ferrund Applok Thrane Vekk Olimsa Derwint"
    d = Dictionary([*ENTRIES, (20, name), (21, "Q" + "umbratel" * 12)], [("fatvod", name)])
    assert d.scan(f"경험: {name} 사용") == [20] and d.scan(f"{name.replace(' ', '-')}를 이용해") == [20] and d.scan("Fatvod 활용") == [20]
    assert d.scan("use Q" + "umbratel" * 12 + " daily") == [21] and d.value("Q" + "umbratel" * 11 + "umbrtel") == 21


def test_two_edits():
    d = Dictionary([(1, "Spring Boot"), (2, "Galmirdexon"), (3, "Galmirdexon CI")], [])
    assert d.value("Sprnig Boto") == 1 and d.scan("Sprnig Boto 사용") == [1] and d.value("Galmrdexxon") == 2
    assert d.scan("Galmirdexon 17를 이용해") == [2] and d.value("Galmrdxn") == -1
    assert d.scan("x" * 200_000 + " " + "가" * 100_000) == []


def brute(typed, entry, most):
    """All alignments of two writings with at most ``most`` edits."""

    def go(i, j, k):
        if i == len(typed) and j == len(entry):
            return 0.0
        ways = []
        if i < len(typed) and j < len(entry) and typed[i] == entry[j]:
            ways.append(go(i + 1, j + 1, k))
        if k:
            if i < len(typed):
                ways.append(0.9 + go(i + 1, j, k - 1))
            if j < len(entry):
                ways.append(0.8 + go(i, j + 1, k - 1))
            if i < len(typed) and j < len(entry):
                ways.append(1.0 + go(i + 1, j + 1, k - 1))
            if i + 1 < len(typed) and j + 1 < len(entry) and typed[i] == entry[j + 1] and typed[i + 1] == entry[j]:
                ways.append(0.7 + go(i + 2, j + 2, k - 1))
        return min(ways, default=99.0)

    best = go(0, 0, most)
    return best if best < 50 else None


def test_edits_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        entry = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 6)))
        typed = list(entry)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, len(typed))
            typed[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "e"])
        typed = "".join(typed)
        for most in (1, 2):
            got, want = weighted_edit(typed, entry, most), brute(typed, entry, most)
            assert (got is None) == (want is None), (typed, entry, most)
            assert got is None or want - 0.3 * most - 1e-9 <= got <= want + 1e-9  # a doubled letter weighs less


def test_edit_weights():
    assert weighted_edit("abc", "abc") == 0
    weights = [weighted_edit(t, "abcd") for t in ("abbcd", "abdc", "acd", "abxcd", "abxd")]
    assert weights == sorted(weights) and len(set(weights)) == 5
    assert weighted_edit("abdcx", "abcd") is None and weighted_edit("ax", "abcd") is None


def test_one_key_for_both_scripts():
    for latin, hangul in (("inkmiqtiv", "잉크미크티브"), ("klymiqter", "클리미크터"), ("wexquazan", "웩스콰잔")):
        assert phonetic(writing(latin)) == phonetic(writing(hangul))


def test_dictionary_in_parts(spark, monkeypatch):
    rnd = random.Random(3)
    skill = spark.createDataFrame([*ENTRIES, (None, "x")], "skill_id bigint, name string")
    alias = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(ALIASES)] + [(50, None, "Galmirdex"), (51, "a", ""), (52, "Galmirdex", "NelvopaDB")], "alias_id bigint, alias string, skill string")
    names = [n for _, n in ENTRIES] + [a for a, _ in ALIASES] + ["Galmirdx", "경험", "Post", "갈미르덱스를"]
    lines = [[" ".join(rnd.choice(names) + rnd.choice(["", ",", " 사용", "를"]) for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(0, 3))] for _ in range(60)]
    raw = spark.createDataFrame([(i, x, [None, *x]) for i, x in enumerate(lines)] + [(99, None, [])], "raw_id bigint, required array<string>, preferred array<string>")
    find = lambda: sorted(tuple(r) for r in meant_entries(skill, alias, raw).collect())
    whole = find()
    monkeypatch.setattr(canon, "DICTIONARY_ROWS", 6)
    got = find()
    # last words are learned within a part
    learned = {r for r in set(whole) ^ set(got) if r[0] != "alias"}
    assert len(whole) > 100 and [r for r in got if r[0] == "alias"] == [r for r in whole if r[0] == "alias"] and len(learned) <= len(whole) // 20


def test_rows(spark):
    skill = spark.createDataFrame([*ENTRIES, (None, "x"), (9, None)], "skill_id bigint, name string")
    alias = spark.createDataFrame([(1, "gmx", "Galmirdex"), (2, "a", None), (3, "b", ""), (4, "c", "없음"), (None, "d", "Galmirdex"), (5, None, "NelvopaDB")], "alias_id bigint, alias string, skill string")
    raw = spark.createDataFrame(
        [(1, ["Galmirdex", "galmirdex", None, ""], None), (2, [], ["gmx 활용"]), (3, None, None), (3, ["NelvopaDB"], ["x" * 100_000 + " Galmirdex"]), (None, ["Galmirdex"], None)],
        "raw_id bigint, required array<string>, preferred array<string>",
    )
    got = sorted(tuple(r) for r in meant_entries(skill, alias, raw).collect())
    assert got == [("alias", 1, 1), ("alias", 3, -1), ("alias", 4, -1), ("alias", 5, 5), ("preferred", 2, 1), ("preferred", 3, 1), ("required", 1, 1), ("required", 3, 5)]
    assert meant_entries(skill.limit(0), alias.limit(0), raw.limit(0)).count() == 0
