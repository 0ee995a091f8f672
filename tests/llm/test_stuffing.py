"""Keyword pages, link lists and openings."""

import random

import numpy as np
import pytest

from fernmill.llm.stuffing import CUT, is_stuffed, measure, periodic_terms, recurring_terms, stuffed_pages

RND = random.Random(4)
CITIES = "가온 나래 다솜 라온 마루 바다 사랑 아라 자람 차오름 카온 타래 파란 하늘".split()
TAGS = [f"{a}{b}" for a in ("웹", "앱", "서버", "보안", "회계") for b in ("개발자", "운영", "기획", "알바", "교육")]
PROSE = [
    "우리 조직은 새벽 배포 전에 기록을 꼼꼼하게 점검합니다.", "결제 흐름이 어긋나면 담당자와 원인을 찾아 다듬습니다.", "신규 입사자는 온보딩 과정에서 문서를 독립적으로 작성합니다.",
    "분기 초에 지표를 통일하려고 여러 팀이 함께 논의합니다.", "장애 직후에는 재발을 막으려고 보고서를 공유합니다.", "고객 문의를 책임지고 처리하며 절차를 개선합니다.", "야간 호출을 줄이려고 경보 규칙을 단순하게 바꿉니다.",
]
SPAM = [
    " > ".join(f"{c} 웹 개발자 채용" for c in CITIES * 2),
    "\n".join(f"{c} 지역 웹 개발자 일자리 총정리." for c in CITIES * 2),
    "태그: " + ", ".join("#" + RND.choice(TAGS) for _ in range(60)),
    " ".join(RND.choice(["고수익 부업", "취업 상담"]) for _ in range(50)),
    "\n".join(f"{RND.choice(['백팩', '의자', '책상'])} {RND.choice(['특가', '정품'])} {RND.randint(1, 99)},{RND.randint(100, 999)}원" for _ in range(30)),
    "\n".join(f"http://site{i}.example/ad/{i * 37} - 채용 정보" for i in range(25)),
    PROSE[0] + "\n" + ", ".join(RND.choice(TAGS) for _ in range(70)),
]
FINE = [
    " ".join(PROSE),
    " ".join(PROSE) + "\n사용 기술 " + " · ".join(f"Tool{chr(65 + i)}x" for i in range(24)),
    " ".join(PROSE) + "\nhttp://a.example/x/1\nhttp://b.example/y/2\n#개발 #채용",
    "웹 개발자 채용 | 가온\n근무지: 나래\n고용 형태: 정규직\n연봉: 4000만원 협의\n모집 인원: 3명\n문의는 지원 페이지에 남겨 주세요.",
    "짧은 글",
]


VARIED = [f"{c}{t}" for c in CITIES[:4] for t in TAGS[:10]] + ["C#", "C++", "SRE", "Tool.js", "DBA"]
GLUED = ["Tags " + "".join("#" + t for t in [*VARIED, *VARIED[:6]]), PROSE[0] + "\n" + "".join("#" + t for t in [*VARIED, *VARIED[40:], *VARIED[:3]])]


@pytest.mark.parametrize("text", GLUED)
def test_glued_tags(text):
    assert is_stuffed(measure(text)), measure(text)


@pytest.mark.parametrize("text", [", ".join(VARIED), PROSE[0] + "\n" + "\n".join(VARIED)])
def test_list_without_repeats(text):
    assert is_stuffed(measure(text)), measure(text)
    assert not is_stuffed(measure(" ".join(PROSE) + "\n" + ", ".join(VARIED[:16])))


def test_tags_end_segments():
    assert [s for s in CUT.split("C#개발#서초#C##C++#F#개발, F#9#급구") if s] == ["C#개발", "#서초", "#C#", "#C++", "#F", "#개발", "F#9", "#급구"]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert is_stuffed(measure(text)), measure(text)


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert not is_stuffed(measure(text)), measure(text)


def test_spans():
    periodic = np.array([*range(100, 130), *([1, 2, 3, 4] * 8)])
    assert periodic_terms(periodic)[32:].all() and not periodic_terms(periodic)[:10].any()
    assert not recurring_terms(np.arange(50), np.ones(50, dtype=bool)).any()
    assert measure("")["terms"] == 0 and measure(" \n,|")["terms"] == 0


@pytest.mark.parametrize("size", [10, 24, 30, 77, 400])
def test_copied_block(size):
    block, before = np.arange(100, 100 + size), np.arange(1000, 1009)
    assert periodic_terms(np.concatenate([block, block])).all()
    got = periodic_terms(np.concatenate([before, block, before + 50, block]))
    assert size < 24 or got[9 : 9 + size].all() and got[-size:].all() and not got[:4].any()


@pytest.mark.parametrize("seed", range(3))
def test_lags_against_all_windows(seed):
    rnd = np.random.default_rng(seed)
    for _ in range(20):
        n, lag = int(rnd.integers(1, 150)), int(rnd.integers(1, 70))
        codes = rnd.integers(0, int(rnd.integers(2, 60)), n)
        if n > lag:
            codes[lag:] = np.where(rnd.random(n - lag) < rnd.choice([0.7, 0.9]), codes[:-lag], codes[lag:])
        want = np.zeros(n, dtype=bool)
        for k in range(1, n):
            for w, share in ((max(8, 2 * k), 0.62), (min(k, 24), 0.85 if k >= 8 else 2)):
                for i in range(n - k - w + 1):
                    if (codes[i : i + w] == codes[i + k : i + k + w]).sum() >= share * w:
                        want[i : i + w] = want[i + k : i + k + w] = True
        assert (periodic_terms(codes) == want).all()


def test_phrase_twice():
    phrase = " ".join(f"{c}{t} 모집" if k % 9 == 0 else f"{c}{t}" for k, (c, t) in enumerate((c, t) for c in CITIES[:7] for t in TAGS[:5]))
    assert is_stuffed(measure(phrase + " " + phrase)) and not is_stuffed(measure(phrase))
    alike = [f"The {a} desk {v} the {b} for {k} clinics as a side task so that {c}." for k, (a, v, b, c) in enumerate([("fraud", "audits", "cold schema registry", "failures stay small"), ("mobile", "schedules", "oversized translation memory", "support can breathe")])]
    assert not is_stuffed(measure("\n".join(alike)))


def test_rows(spark):
    rows = [(i, t, "n") for i, t in enumerate([*SPAM, *FINE])] + [(90, None, None), (91, "", None), (0, SPAM[0], None), (92, SPAM[1] * 200, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, terms string")
    got = sorted(r.doc_id for r in stuffed_pages(df, key="doc_id", text="text").collect())
    assert got == sorted([*range(len(SPAM)), 0, 92])
    assert stuffed_pages(df.limit(0), key="doc_id", text="text").count() == 0
