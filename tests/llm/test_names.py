"""Organisation names: reading, the metric, the radius join, classes."""

import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st

from fernmill.llm import names
from fernmill.llm.names import distance, distances, key_of, one_slip, read_name, signatures, skeleton, spelling, syllables, within


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (" EOWOene14SxvY+jE+at87w==", "EOWOene14SxvY+jE+at87w"),
        ("EOWOene14SxvY%2BjE%2Bat87w%3D%3D", "EOWOene14SxvY+jE+at87w"),
        ("pXU1Dw1zpp0%252BMW8bkgdiSQ%253D%253D", "pXU1Dw1zpp0+MW8bkgdiSQ"),
        ("L2Zy%3d%3d", "L2Zy"),
        ("", None),
        ("  ", None),
        (None, None),
    ],
)
def test_keys(raw, want):
    assert key_of(raw) == want


@pytest.mark.parametrize(
    "name",
    ["(주)다나새솔네트웍스", "㈜ 다나새솔 네트웍", "주식회사 다나새솔네트웍스_본사", "네트웍스·다나새솔", "네트웍스(다나새솔)", "채용담당 - 다나새솔네트웍스 주식회사", "다나새솔네트웍스 R&D센터", "( 주 )다나새솔 Networks", "다 나 새 솔 네 트 웍 스", "다나새솔네트웍스(주) 인사팀", "（주）다나새솔네트웍스 [개발본부]"],
)
def test_reading(name):
    stem, word = read_name(name)
    assert (word, skeleton(stem)) == ("네트웍스", skeleton("다나새솔"))


@pytest.mark.parametrize(
    ("name", "want"),
    [("다나새솔 Netwroks", ("다나새솔", "네트웍스")), ("다나새솔네트윽스", ("다나새솔네트윽스", "")), ("새솔건설(주)", ("새솔건설", "")), ("한빛제약", ("한빛제약", "")), ("네트웍스", ("네트웍스", ""))],
)
def test_words_are_no_condition(name, want):
    assert read_name(name) == want


def test_words_stay_apart():
    forms = sorted({skeleton(w.split()[0]) for w in names.BUSINESS})
    assert all(distance(syllables(a), syllables(b)) > names.RADIUS for a, b in itertools.combinations(forms, 2))


def test_scripts_meet():
    for latin, hangul in (("Keomsodimsem", "검소딤셈"), ("Burmitusen", "불미투센"), ("LOMJELHALE", "롬젤하레"), ("oltuhohom", "얼투허홈")):
        assert skeleton(latin.lower()) == skeleton(hangul).replace(names.SILENT, "")


words = st.text(alphabet="가나다라마곤덜밀벤", min_size=0, max_size=6).map(lambda s: syllables(skeleton(s)))


@settings(max_examples=200, deadline=None)
@given(words, words, words)
def test_metric(a, b, c):
    assert (distance(a, b) == 0) == (a == b)
    assert distance(a, b) == distance(b, a)
    assert distance(a, c) <= distance(a, b) + distance(b, c)


def some_forms(rnd, n, long=15):
    return sorted({skeleton("".join(rnd.choice("가나다라곤덜밀벤솔") for _ in range(rnd.randint(1, long if k % 9 == 0 else 5)))) for k in range(n)})


def test_distances_of_many():
    forms = [*some_forms(random.Random(3), 160, 45), ""]
    pivots = forms[::17]
    assert distances(forms, pivots).tolist() == [[distance(syllables(f), syllables(p)) for p in pivots] for f in forms]
    assert distances(forms * 20, pivots[:2]).shape == (20 * len(forms), 2)


def test_signatures_against_brute_force():
    forms = some_forms(random.Random(3), 200)
    forms += [skeleton("솔벤" * 60), skeleton("솔벤" * 60 + "덜"), skeleton("솔벤" * 30 + "덜" + "솔벤" * 30)]
    of = {f: signatures(f) for f in forms}

    def meet(a, b):
        of_a, of_b = set(of[a]), set(of[b])
        same = {s for s, r in of_a if r == names.SAME} & {s for s, r in of_b if r == names.SAME}
        part = lambda x, y: {s for s, r in x if r == names.WHOLE} & {s for s, r in y if r == names.SHORT}
        return bool(same or part(of_a, of_b) or part(of_b, of_a))

    for a, b in itertools.combinations(forms, 2):
        true = len(a) < 100 and distance(syllables(a), syllables(b)) <= names.RADIUS or len(a) > 100 and abs(len(syllables(a)) - len(syllables(b))) == 1
        assert within(a, b) == true, (a, b)
        assert meet(a, b) or not true


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("컨쿨탄준", "컨쿨탄즌", True), ("좀칸체눌", "좀칸체눌눌", True), ("길굴컴밀", "길굴컴", True), ("준번촌몬", "번준촌몬", True), ("가나다라", "가나다소", False), ("가나다라", "마나다바", False), ("건털불키", "geonteolbulki", True), ("좀어얼랄", "어좀얼랄", True), ("오훈투펠", "ohuntupel", True), ("가나", "가나", True)],
)
def test_slips(a, b, want):
    assert one_slip(spelling(a), spelling(b)) is want
    assert one_slip(spelling(b), spelling(a)) is want


SCHEMA = "company_id bigint, saramin_csn string, name string, group_name string, form string"


def classes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in names.organisations(df, row="company_id", key="saramin_csn", name="name", group="group_name").collect():
        out.setdefault(r.organisation, set()).add(r.row)
    return sorted(map(sorted, out.values()))


def test_classes(spark):
    rows = [
        (1, "k1==", "(주)다나새솔네트웍스", None, "x"), (2, "k1", "다솔", None, "x"), (3, None, "다나새소네트웍스", None, "x"), (4, None, "Danasaesol Networks Inc.", None, "x"),
        (5, "k2", "다나새솔에너지", None, "x"), (6, None, "한마루별게임즈", None, "x"), (7, None, "게임즈(한마루별)", None, "x"), (8, None, "한마루별별게임즈", None, "x"),
        (9, "k3", "같은이름소프트", "가상그룹", "x"), (10, "k4", "같은이름소프트", "모형그룹", "x"), (11, None, "같은이름소프트(주)", "(모형그룹)", "x"), (12, None, "같은이름소프트", None, "x"),
        (13, None, None, None, None), (14, "k1", None, None, None), (15, None, "", None, None), (None, "k1", "다나새솔네트웍스", None, None),
    ]
    assert classes(spark, rows) == [[1, 2, 3, 4, 14], [5], [6, 7, 8], [9], [10, 11], [12]]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {tuple(r) for r in names.company_pairs(df).collect()}
    assert pairs == {p for g in ([1, 2, 3, 4, 14], [6, 7, 8], [10, 11]) for p in itertools.combinations(g, 2)}


def test_empty(spark):
    assert names.company_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_meeting_against_brute_force():
    rnd = random.Random(2)
    rows = sorted({(rnd.randint(0, 1), rnd.randint(0, 8), rnd.choice([names.SAME, names.SHORT]), rnd.randint(0, 12)) for _ in range(120)})
    rows += [(c, s, names.WHOLE, 20 + s) for c in range(2) for s in range(0, 9, 2)]
    want = set()
    for x, y in itertools.combinations(rows, 2):
        if x[:2] == y[:2] and x[3] != y[3] and ({x[2], y[2]} == {names.SAME} or {x[2], y[2]} == {names.WHOLE, names.SHORT}):
            want.add((min(x[3], y[3]), max(x[3], y[3])))
    a, b = names.meeting(*(names.np.array(c) for c in zip(*rows)))
    assert want and sorted(zip(a.tolist(), b.tolist())) == sorted(want)
    none = names.np.array([], dtype="int64")
    assert [len(x) for x in names.meeting(none, none, none, none)] == [0, 0]


def test_cells_keep_all_links(spark, monkeypatch):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("가나다라곤덜밀벤솔하") for _ in range(4)) for _ in range(60)]
    stems = sorted({s for b in base for s in (b, b[:2] + b[3:], b[0] + b[2] + b[1] + b[3])})
    spelt = {skeleton(s): s for s in stems}
    forms = spark.createDataFrame([(f, [spelling(s)]) for f, s in spelt.items()], "form string, spellings array<string>")
    want = {(a, b) for a, b in itertools.combinations(sorted(spelt), 2) if within(a, b) and one_slip(spelling(spelt[a]), spelling(spelt[b]))}
    assert want and {tuple(r) for r in names.radius_join(forms).collect()} == want
    monkeypatch.setattr(names, "CELL", 20)
    assert len(names.pivots_of(forms)) > 4
    assert {tuple(r) for r in names.radius_join(forms).collect()} == want


def test_unlisted_lines_and_slips_in_them(spark):
    rows = [
        (1, None, "(주)한빛새솔인포텍", None, ""), (2, None, "한빛새솔인포텤", None, ""), (3, None, "가람도담건설", None, ""), (4, None, "가람도단건설 주식회사", None, ""),
        (5, None, "가람도담제약", None, ""), (6, None, "한빛새솔건설", None, ""),
    ]
    assert classes(spark, rows) == [[1, 2], [3, 4], [5], [6]]


def test_a_name_of_many_keys(spark):
    rows = [(i, f"k{i}", "같은이름소프트", f"모임{'가나다라마'[i % 5]}{'바사아자하'[i // 5]}그룹", "") for i in range(25)]
    rows += [(100 + i, None, "같은이름소프트", f"모임{'가나다라마'[i % 5]}{'바사아자하'[i // 5]}", "") for i in range(25)] + [(200, None, "같은이름소프트(주)", None, ""), (201, None, "같은이름소프트", "다른그룹", "")]
    assert classes(spark, rows) == [[i, 100 + i] for i in range(25)] + [[200, 201]]


def test_hot_class(spark, monkeypatch):
    monkeypatch.setattr(names, "PAIR_BLOCK", 5)
    rows = spark.createDataFrame([(i, "a") for i in range(30)] + [(99, "b")], "row bigint, organisation string")
    assert sorted(tuple(r) for r in names.all_pairs(rows).collect()) == list(itertools.combinations(range(30), 2))
