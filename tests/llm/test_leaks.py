"""Leaked items against a plain window comparison."""

import random

import pytest

from fernmill.llm import leaks
from fernmill.llm.leaks import WuManber, leaked_items, without_shared, words_of

VOCABULARY = [f"w{i}" for i in range(60)]


def brute(item, text):
    """Whether some 20 or more words stand at one offset with one in seven replaced at most."""
    for off in range(-len(item) + 1, len(text)):
        eq = [k + off in range(len(text)) and item[k] == text[k + off] for k in range(len(item))]
        inside = [0 <= k + off < len(text) for k in range(len(item))]
        for i in range(len(item)):
            for j in range(i + 20, len(item) + 1):
                if all(inside[i:j]) and 7 * (j - i - sum(eq[i:j])) <= j - i:
                    return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(seed):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randint(15, 45)))) for i in range(6)]
    table = WuManber(items)
    for _ in range(60):
        words = [rnd.choice(VOCABULARY) for _ in range(rnd.randint(0, 30))]
        _, source = rnd.choice(items)
        s = source.split()
        a = rnd.randint(0, max(0, len(s) - 18))
        part = s[a : a + rnd.randint(17, 40)]
        for k in range(len(part)):
            if rnd.random() < rnd.choice([0, 0.1, 0.16]):
                part[k] = "other"
        at = rnd.randint(0, len(words))
        words[at:at] = part
        assert table.search(" ".join(words)) == [i for i, t in items if brute(t.split(), words)]


def test_words():
    assert words_of("The <b>fa</b>st-moving<br/>RÉSUMÉ, &amp; **Bold** Jаva​ [가나](http://x.y/z)") == ["the", "fast", "moving", "résumé", "bold", "java", "가나"]
    assert words_of("") == []


def test_long_markup():
    url = "http://x.y/z?" + "&".join(f"k{i}=v{i}" for i in range(400))
    for mark in (f'<a href="{url}" class=x>', f"<a href={url}>", f"<p style='{'a:b; ' * 400}'>", f'<img src="data:image/png;base64,{"A/b+" * 900}==" alt="">'):
        assert words_of("one " + mark + "two three") == ["one", "two", "three"]
    assert words_of(f"one [two]({url}) three ![{'four ' * 90}](u)") == ["one", "two", "three", *["four"] * 90]
    # text after a stray sign stays
    assert len(words_of("x <b " + "word " * 200 + "-> y")) == 203
    # no quadratic time
    for odd in ("<a " * 100_000, "<a href=" + "a=b" * 100_000, '<a x="' * 50_000, "[" * 200_000 + "](", "<a " + "b=c " * 100_000):
        words_of(odd)


def test_shared_openings():
    opening = "read the text and choose the best answer".split()
    items = [(i, opening + [f"a{i}{k}" for k in range(30)]) for i in range(3)] + [(9, ["z"] * 25)]
    cut = dict(without_shared(items))
    assert all(len(cut[i]) == 30 for i in range(3)) and len(cut[9]) == 25
    table = WuManber([(i, " ".join(w)) for i, w in items])
    assert table.search(" ".join(opening * 4)) == []


def test_copies_share_no_opening():
    w = [f"a{k}" for k in range(60)]
    text = " ".join(w)
    equal = WuManber([(i, text) for i in range(4)])
    assert equal.search("x y " + text) == [0, 1, 2, 3]
    openings = [(1, text), (2, " ".join(w[:50])), (3, " ".join(w[:40])), (4, text[: len(" ".join(w[:45])) - 1]), (5, text)]
    assert WuManber(openings).search(text) == [1, 2, 3, 4, 5]
    # the instruction of different texts is left out for their copies too
    asked = "read the text and choose the best answer".split() * 3
    items = [(i, asked + [f"b{i // 3}{k}" for k in range(30)]) for i in range(9)] + [(9, asked)]
    assert [len(x) for _, x in without_shared(items)] == [30] * 9 + [0]


def test_opening_ends_where_texts_part():
    asked = "read the text and choose the best answer".split()
    body = lambda i, n: [f"b{i}x{k}" for k in range(n)]
    items = [(i, asked + (["the", "night", "crew"] if i < 4 else []) + body(i, 20)) for i in range(12)]
    assert [w[0] for _, w in without_shared(items)] == ["the"] * 4 + [f"b{i}x0" for i in range(4, 12)]
    # a leak of 22 words from the start of a body
    assert WuManber([(i, " ".join(w)) for i, w in items]).search(" ".join(items[1][1][8:11] + body(1, 18))) == [1]
    # an instruction of its own after a shared beginning is left out whole
    kinds = [[f"q{j}w{k}" for k in range(9)] for j in range(4)]
    items = [(i, asked + kinds[i % 4] + body(i, 20)) for i in range(16)]
    assert all(len(w) == 20 for _, w in without_shared(items))


def test_rows(spark):
    text = " ".join(VOCABULARY[:25])
    docs = spark.createDataFrame([(1, "x " * 50_000 + text), (2, None), (3, ""), (4, " ".join(VOCABULARY[:19])), (5, text.upper().replace(" ", ",\n")), (5, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text), (8, text), (9, None), (10, "short"), (7, text)], "item_id bigint, text string")
    got = sorted(tuple(r) for r in leaked_items(docs, items, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").collect())
    assert got == [(1, 7), (1, 8), (5, 7), (5, 7), (5, 8), (5, 8)]
    assert leaked_items(docs.limit(0), items.limit(0), doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").count() == 0


def test_one_passage_under_different_questions():
    passage = [f"p{k}" for k in range(60)]
    items = [(i, passage + [f"q{i}x{k}" for k in range(8)]) for i in range(3)]
    table = WuManber([(i, " ".join(w)) for i, w in items])
    for i, w in items:
        assert table.search("x y " + " ".join(w) + " z") == [i]
    # what is left can't be told from the instruction with words replaced
    assert [len(w) for _, w in without_shared([(i, passage[:30] + [f"q{i}"]) for i in range(3)])] == [1] * 3


def test_odd_markup():
    for mark in ('<a href="u v>', "<input type=text disabled checked>", "<!-- a <b> c -->", "<p " + "style='x' " * 900 + ">", "<p " + "n" * 5000 + ">", f"<{'x' * 999}>"):
        assert words_of("one " + mark + "two") == ["one", "two"], mark[:20]
    for odd in ("<!--" * 100_000, "<a " + "b c d e f " * 50_000, "<a" + " " * 100_000, "<a " + "x= " * 50_000):
        words_of(odd)


def test_many_items_in_sets(spark, monkeypatch):
    rnd = random.Random(5)
    asked = [["read", "the", "text", "and", "choose", "the", "best", f"answer{j}"] * (j + 1) for j in range(3)]
    items = []
    for i in range(60):
        body = [rnd.choice(VOCABULARY) for _ in range(rnd.randint(0, 50))]
        items.append((i, " ".join(asked[i % 4] + body if i % 4 < 3 else body)))
    long = items[7][1]
    items += [(100, long), (101, long[: len(long) * 2 // 3]), (102, long[:90]), (103, ""), (104, None)]
    words = [(i, words_of(t)) for i, t in items if t]
    got = leaks.own_words(spark.createDataFrame([x for x in items if x[1]], "i bigint, t string"))
    assert sorted((r.i, r.own) for r in got.collect()) == sorted(without_shared(words))
    docs = [(i, " ".join(["a", "b"] + t.split()[-rnd.randint(15, 40) :] + ["c"])) for i, t in items if t]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    find = lambda: sorted(tuple(r) for r in leaked_items(d, t, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").collect())
    whole = find()
    monkeypatch.setattr(leaks, "ITEM_CHARACTERS", 1500)
    assert whole and find() == whole


def test_rows_of_one_text(spark):
    text = " ".join(VOCABULARY[:25])
    docs = spark.createDataFrame([(1, "x " * 50 + text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text), (8, text), (11, text)], "item_id bigint, text string")
    got = sorted(tuple(r) for r in leaked_items(docs, items, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").collect())
    assert got == [(1, 7), (1, 8), (1, 11)]
