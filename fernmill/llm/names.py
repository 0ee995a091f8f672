"""Variant spellings of organisation names, linked by metric-space partitioning.

A typed name loses its company form, offices and departments; words with several usual
spellings take one; what is left, the whole name, is written in one phonetic alphabet in which
Latin spellings and Hangul meet, as a row of syllables. Names form a metric space under a
Damerau-Levenshtein distance over syllables. Each goes to its nearest pivot's cell, and by the
triangle inequality to every cell that could hold a neighbour of a name at home there. Inside a
cell an exact radius join meets names by signatures that all within the radius share, and
decides by the true distance. Links and keys then make organisations: rows of one key are one,
rows of different keys never.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernmill.functions.lookalikes import LOOKALIKES
from fernmill.session import materialise, spread

#: Words with several usual spellings, as written in Hangul, in Latin letters, and shortened; fixed values. They only
#: bring such spellings to one form, the first; what is compared with what doesn't depend on them.
BUSINESS = (
    "바이오랩 바이오 biolab bio",
    "커머스 commerce comm 컴",
    "에너지 energy 에너 eng",
    "파이낸셜 파이낸스 financial finance fin",
    "게임즈 게임 games game gm",
    "헬스케어 헬스 healthcare health hc",
    "인포텍 인포 infotech info",
    "로지스틱스 로지스 logistics logis",
    "미디어랩 미디어 medialab media",
    "모빌리티 모빌 mobility mobil",
    "네트웍스 네트웍 네트워크스 네트워크 networks network net",
    "로보틱스 로봇 로보 robotics robot robo",
    "소프트웨어 소프트 software soft sw",
    "솔루션즈 솔루션 solutions solution sol",
    "시스템즈 시스템 systems system sys",
    "테크놀로지 테크 technology tech",
    "서치펌 searchfirm 파트너스 partners",
)
#: Every spelling of a word with its one form, the first Hangul one; longer spellings first.
_WORDS = sorted(((w, words.split()[0]) for words in BUSINESS for w in words.split()), key=lambda p: (-len(p[0]), p[0]))
_KINDS = dict(_WORDS)
#: Latin words of so many letters are known with one letter wrong, too.
LATIN_SLIP = 6
FORMS = re.compile(r"\(\s*주\s*\)|주식회사|유한회사|\(\s*유\s*\)|\bco\s*\.?,?\s*ltd\b\.?|\b(?:inc|corp|ltd|llc|co|corporation|company|incorporated)\b\.?", re.I)
#: Words for a part of an organisation, at a name's edge.
PART = (
    r"(?:[^\W_]*(?:본사|지사|지점|사무소|센터|본부|연구소|공장|영업소|사업부|사업소|담당|지부|캠퍼스|office|branch|center|hq|headquarters)"
    r"|r&d\s*(?:센터|center)?|(?:경영|인사|채용|개발|영업|운영|기획|총무|재무|홍보|디자인|마케팅|품질|연구|지원|서비스|데이터|플랫폼|보안|hr|it|인재|경영지원|기술지원)팀|hr\s*team)"
)
OFFICE = re.compile(rf"\[[^\[\]]*\]|^\s*{PART}\s*[-–:_/·]\s*|(?<=\S)[\s_\-–:/·,(]+{PART}\)?\s*$", re.I)
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_LATIN = str.maketrans({k: v for k, v in LOOKALIKES.items()})

#: Letters of the phonetic alphabet by the order of Hangul letters; tense sounds are written plain.
ONSETS = "k k n t t l m p p s s - c c c k t p h".split()
NUCLEI = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
CODAS = ["", *"k k k n n n t l l l l l l l l m p p t t ng c c k t p h".split()]
#: Latin letters that spell one sound, then vowels that Latin spellings confuse, as one letter each.
CONSONANTS = [(re.compile(p), r) for p, r in (("ch|j|z", "c"), ("g|q", "k"), ("r", "l"), ("d", "t"), ("b|v|f", "p"), ("nk(?![aeiouyw])", "n"))]
VOWELS = [(re.compile(p), r) for p, r in (("yeo|yo|yu|weo|wo|wu", "o"), ("eo|eu|ui|u", "o"), ("yae|ye|wae|we|ae|oe", "e"), ("ya|wa", "a"), ("wi|yi|y", "i"), ("ng", "n"))]
RADIUS = 1


def key_of(raw: str | None) -> str | None:
    """The value of a key however it is written down; None for none."""
    if raw is None:
        return None
    s = _HIDDEN.sub("", unicodedata.normalize("NFKC", raw)).strip()
    for _ in range(4):
        if (t := unquote(s)) == s:
            break
        s = t
    s = s.replace(" ", "").replace("-", "+").replace("_", "/").rstrip("=")
    return s or None


def _clean(name: str) -> str:
    s = _HIDDEN.sub("", unicodedata.normalize("NFKC", name))
    s = unicodedata.normalize("NFKC", s.translate(_LATIN)).lower()
    s = FORMS.sub(" ", s)
    for _ in range(3):
        t = OFFICE.sub(" ", s)
        if t == s:
            break
        s = t
    return s


def _word_of(end: str) -> tuple[str, str] | None:
    """(word, its one form) of a listed word, or of a long Latin one with a letter wrong, missing, added or swapped."""
    if end in _KINDS:
        return end, _KINDS[end]
    if len(end) >= LATIN_SLIP and end.isascii() and end.isalpha():
        near = {k for w, k in _WORDS if w.isascii() and len(w) >= LATIN_SLIP and _one_letter(end, w)}
        if len(near) == 1:
            return end, near.pop()
    return None


def _one_letter(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


@lru_cache(maxsize=100_000)
def read_name(name: str) -> tuple[str, str] | None:
    """(rest, word) of a typed name in Hangul and Latin letters and digits.

    ``word`` is the one form of a listed word that stands at the end, or at the start where
    parts were reordered, or ''; the rest is all else. A name without a listed word, or with one
    spelt beyond recognition, is all rest, and compared like any other.
    """
    parts = [p for p in re.split(r"[^0-9a-z가-힣]+", _clean(name)) if p]
    if not parts:
        return None
    whole = "".join(parts)
    for w, kind in _WORDS:
        if whole.endswith(w) and len(whole) > len(w):
            return whole[: -len(w)], kind
    for w, kind in _WORDS:
        joined = ""
        for k, p in enumerate(parts[:-1]):
            joined += p
            if joined == w:
                return "".join(parts[k + 1 :]), kind
            if len(joined) > len(w):
                break
    if len(parts) > 1 and (found := _word_of(parts[-1])):
        return "".join(parts[:-1]), found[1]
    return whole, ""


#: Marks a Hangul syllable that begins with its vowel; Latin spellings don't tell.
SILENT = "x"


def skeleton(stem: str) -> str:
    """The phonetic letters of a stem; its Hangul and its Latin spellings share them but for SILENT."""
    out = []
    for ch in stem:
        if "가" <= ch <= "힣":
            c = ord(ch) - 0xAC00
            out.append(ONSETS[c // 588].replace("-", SILENT) + NUCLEI[c % 588 // 28] + CODAS[c % 28])
        else:
            out.append(ch)
    s = "".join(out)
    for p, r in CONSONANTS + VOWELS:
        s = p.sub(r, s)
    return s


_SYLLABLE = re.compile(r"([^aeio0-9]?)([aeio])(?:([^aeio0-9])(?![aeio]))?|(.)()()")
Syllable = tuple[str, str, str]


@lru_cache(maxsize=200_000)
def syllables(skel: str) -> tuple[Syllable, ...]:
    """(onset, nucleus, coda) of each syllable of phonetic letters."""
    return tuple((m[1], m[2], m[3] or "") if m[2] else (m[4], "", "") for m in _SYLLABLE.finditer(skel))


def apart(a: Syllable, b: Syllable) -> int:
    """The ground metric: 0 for equal syllables, 1 where one sound differs, else 2."""
    return min(2, (a[0] != b[0]) + (a[1] != b[1]) + (a[2] != b[2]))


def distance(a: tuple[Syllable, ...], b: tuple[Syllable, ...]) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions: gap and swap 1, change by ``apart``.

    It is a metric: the ground distances are one and at most two gaps, and two swaps cost no
    less than a deletion and an insertion.
    """
    far = 2 * (len(a) + len(b)) + 1
    last: dict[Syllable, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            cost = apart(a[i - 1], b[j - 1])
            if cost == 0:
                at = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


# -- the exact check on spellings ---------------------------------------------------------
#: Vowels as one sign each: Hangul exactly; Latin o and u may stand for two.
_HANGUL_VOWELS = "aEJKveGHoABCDuLMNQwRi"
_LATIN_VOWELS = [("yeo", "G"), ("yae", "K"), ("wae", "B"), ("eo", "v"), ("ae", "E"), ("eu", "w"), ("oe", "C"), ("ya", "J"), ("ye", "H"), ("yo", "D"), ("yu", "Q"), ("wa", "A"), ("wo", "L"), ("we", "M"), ("wi", "N"), ("ui", "R"), ("u", "U"), ("o", "O"), ("y", "i")]
_EITHER = {"U": "Uuv", "O": "Oov"}
_SPELLED = re.compile(r"([^aEJKveGHoABCDuLMNQwRiUO0-9]?)([aEJKveGHoABCDuLMNQwRiUO])(?:([^aEJKveGHoABCDuLMNQwRiUO0-9])(?![aEJKveGHoABCDuLMNQwRiUO]))?|(.)()()")


def spelling(stem: str) -> str:
    """The stem's letters with its vowels told apart as far as its script does."""
    out = []
    for run in re.findall(r"[가-힣]+|[^가-힣]+", stem):
        if "가" <= run[0] <= "힣":
            for ch in run:
                c = ord(ch) - 0xAC00
                out.append(ONSETS[c // 588].replace("-", SILENT) + _HANGUL_VOWELS[c % 588 // 28] + CODAS[c % 28].replace("ng", "n"))
        else:
            for p, r in CONSONANTS:
                run = p.sub(r, run)
            for a, b in _LATIN_VOWELS:
                run = run.replace(a, b)
            out.append(run.replace("nk", "n"))
    return "".join(out)


def _like(a: str, b: str) -> bool:
    return a == b or b in _EITHER.get(a, "") or a in _EITHER.get(b, "")


def _differs(a: Syllable, b: Syllable) -> int:
    return (a[0] != b[0]) + (not _like(a[1], b[1])) + (a[2] != b[2])


@lru_cache(maxsize=200_000)
def _spelled(s: str) -> tuple[Syllable, ...]:
    return tuple((m[1], m[2], m[3] or "") if m[2] else (m[4], "", "") for m in _SPELLED.finditer(s))


def one_slip(x: str, y: str) -> bool:
    """Whether two spellings differ by one slip: a sound, a syllable more or less, two swapped."""
    if any(v in x for v in _EITHER) != any(v in y for v in _EITHER):  # one is Latin
        x, y = x.replace(SILENT, ""), y.replace(SILENT, "")
    a, b = _spelled(x), _spelled(y)
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    k = 0
    while k < n and not _differs(a[k], b[k]):
        k += 1
    if k == len(a) == len(b):
        return True
    same = lambda u, v: len(u) == len(v) and not any(_differs(p, q) for p, q in zip(u, v))
    if len(a) == len(b):
        return (_differs(a[k], b[k]) == 1 and same(a[k + 1 :], b[k + 1 :])) or (
            k + 1 < n and not _differs(a[k], b[k + 1]) and not _differs(a[k + 1], b[k]) and same(a[k + 2 :], b[k + 2 :])
        )
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return same(long[k + 1 :], short[k:])


# -- metric-space partitioning ------------------------------------------------------------
#: Names a cell is meant for, and the most pivots: they are held in each task. Cells of more names are as exact.
CELL, MOST_PIVOTS = 4000, 256
#: Names, those with the least hashes, among which pivots are picked.
PIVOT_SAMPLE = 4096
#: Names of more syllables are measured one by one; so many of the others at a time.
LONGEST, AT_A_TIME = 32, 2000


def _codes(forms: list[str], ids: dict[Syllable, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sounds, syllable numbers, sizes) of names, padded; the sounds by their character codes."""
    rows = [syllables(f) for f in forms]
    size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    width = int(size.max(initial=1))
    sounds = np.full((len(rows), width, 3), -1, dtype=np.int32)  # character codes
    number = np.full((len(rows), width), -1, dtype=np.int64)
    for i, r in enumerate(rows):
        for j, x in enumerate(r):
            sounds[i, j] = [ord(c) if c else 0 for c in x]
            number[i, j] = ids.setdefault(x, len(ids))
    return sounds, number, size


def distances(forms: list[str], pivots: list[str]) -> np.ndarray:
    """``distance`` of each name to each pivot, so many names at a time as stay in a core's cache."""
    if len(forms) > AT_A_TIME:
        return np.concatenate([distances(forms[at : at + AT_A_TIME], pivots) for at in range(0, len(forms), AT_A_TIME)])
    out = np.zeros((len(forms), len(pivots)), dtype=np.int64)
    long = [i for i, f in enumerate(forms) if len(syllables(f)) > LONGEST]
    short = sorted(set(range(len(forms))) - set(long))
    for i in long:
        out[i] = [distance(syllables(forms[i]), syllables(p)) for p in pivots]
    if short:
        ids: dict[Syllable, int] = {}
        coded = _codes([forms[i] for i in short], ids)
        for c, p in enumerate(pivots):
            out[short, c] = _distances(coded, _codes([p], ids))
    return out


def _distances(names: tuple[np.ndarray, np.ndarray, np.ndarray], pivot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    (a, an, size), (q, qn, _) = names, pivot
    n, width, m = len(a), a.shape[1], int(pivot[2][0])
    far = 2 * (width + m) + 1
    d = np.full((n, width + 2, m + 2), far, dtype=np.int32)
    d[:, 1:, 1] = np.arange(width + 1)
    d[:, 1, 1:] = np.arange(m + 1)
    last, every = np.zeros((n, m + 1), dtype=np.int64), np.arange(n)
    for i in range(1, width + 1):
        at = np.zeros(n, dtype=np.int64)
        for j in range(1, m + 1):
            cost = np.minimum((a[:, i - 1] != q[0, j - 1]).sum(axis=1), 2)
            k = last[:, j]
            swap = d[every, k, at] + (i - k - 1) + 1 + (j - at - 1)
            d[:, i + 1, j + 1] = np.minimum(np.minimum(d[:, i, j] + cost, swap), np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1)
            at = np.where(cost == 0, j, at)
        last[:, 1:] = np.where(an[:, i - 1, None] == qn[0][None, :m], i, last[:, 1:])
    return d[every, size + 1, m + 1]


def pivots_of(forms: DataFrame) -> list[str]:
    """One pivot for CELL names, MOST_PIVOTS at most: names of a sample, each the farthest from those before."""
    n = forms.count()
    share = min(1.0, 2 * PIVOT_SAMPLE / max(n, 1))
    h = F.xxhash64("form")
    sample = [r[0] for r in forms.where(F.pmod(h, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).orderBy(h, "form").limit(PIVOT_SAMPLE).select("form").collect()]
    if not sample:
        return []
    picked = [sample[0]]
    near = distances(sample, picked)[:, 0]
    while len(picked) < min(MOST_PIVOTS, -(-n // CELL)) and near.max() > 0:
        picked.append(sample[int(near.argmax())])
        near = np.minimum(near, distances(sample, picked[-1:])[:, 0])
    return picked


#: What a signature is of.
SAME, WHOLE, SHORT = 0, 1, 2
#: About so many signatures a name has in all its cells, and the rows of them that a task takes at once.
SIGNATURES, PARTITION_ROWS = 150, 4_000_000
#: Signatures are polynomial hashes of rows of syllables, modulo a prime.
_PRIME, _BASE = (1 << 61) - 1, 911_382_323_344_331_771


@lru_cache(maxsize=200_000)
def _code(s: Syllable) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(s).encode(), digest_size=8).digest(), "big") % _PRIME


@lru_cache(maxsize=4096)
def signatures(form: str) -> list[tuple[int, int]]:
    """(signature, role) by which all names within RADIUS meet, in time linear in the name's length.

    Role SAME: the name with one sound left open, or with two neighbours in a fixed order; names
    that share one differ in that sound or are swapped. Role WHOLE, the name, meets role SHORT,
    a name with one syllable left out. So hardly any meet that aren't within the radius.
    """
    row = syllables(form)
    n = len(row)
    code = [_code(x) for x in row]
    power, before, after = [1] * (n + 1), [0] * (n + 1), [0] * (n + 2)
    for i in range(n):
        power[i + 1] = power[i] * _BASE % _PRIME
        before[i + 1] = (before[i] + power[i] * code[i]) % _PRIME
    for i in range(n - 1, -1, -1):
        after[i] = (code[i] + after[i + 1] * _BASE) % _PRIME
    out = {(before[n], WHOLE)}
    for i, (x, y, z) in enumerate(row):
        rest = power[i + 1] * after[i + 1]
        for part in (("?", y, z), (x, "?", z), (x, y, "?")):
            out.add(((before[i] + power[i] * _code(part) + rest) % _PRIME, SAME))
        out.add(((before[i] + power[i] * after[i + 1]) % _PRIME, SHORT))
        if i + 1 < n and code[i] != code[i + 1]:
            low, high = sorted(code[i : i + 2])
            out.add(((before[i] + power[i] * low + power[i + 1] * high + power[i + 2 if i + 2 <= n else n] * after[i + 2] + 1) % _PRIME, SAME))
    return list(out)


def within(a: str, b: str) -> bool:
    """Whether two names are within RADIUS: their true distance, measured where they differ.

    Equal syllables at both ends leave the distance as it is, and what a distance of one leaves
    between them is two syllables at most.
    """
    x, y = syllables(a), syllables(b)
    n = min(len(x), len(y))
    k = 0
    while k < n and x[k] == y[k]:
        k += 1
    e = 0
    while e < n - k and x[len(x) - 1 - e] == y[len(y) - 1 - e]:
        e += 1
    x, y = x[k : len(x) - e], y[k : len(y) - e]
    return max(len(x), len(y)) <= 2 * RADIUS and distance(x, y) <= RADIUS


def assign(forms: DataFrame, pivots: list[str]) -> DataFrame:
    """(id, form, cell): the nearest pivot's cell, and every cell within reach of it, of names (id, form)."""
    reach = 2 * RADIUS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(b.column(1).to_pylist(), pivots)
            row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + reach)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in b.columns], pa.array(cell.astype(np.int32))], names=["id", "form", "cell"])

    return forms.select("id", "form").mapInArrow(run, "id bigint, form string, cell int")


def meeting(cell: np.ndarray, sig: np.ndarray, role: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: the names that a signature of a cell brings together; SAME with itself, WHOLE with SHORT."""
    if len(ids) < 2:
        return ids[:0], ids[:0]
    same = role == SAME
    order = np.lexsort((ids, sig, same, cell))
    cell, sig, same, role, ids = cell[order], sig[order], same[order], role[order], ids[order]
    new = np.concatenate(([True], (cell[1:] != cell[:-1]) | (sig[1:] != sig[:-1]) | (same[1:] != same[:-1])))
    group = np.cumsum(new) - 1
    left, right, d = [], [], 1
    # neighbours of a group at every distance; a SAME group has as many names as there are sounds
    at = np.flatnonzero(same)
    while len(at := at[at + d < len(ids)]) and len(at := at[group[at + d] == group[at]]):
        left.append(ids[at]), right.append(ids[at + d])
        d += 1
    whole = np.full(group[-1] + 1, -1, dtype=np.int64)
    w = np.flatnonzero(role == WHOLE)
    whole[group[w]] = w
    short = np.flatnonzero(role == SHORT)
    short = short[whole[group[short]] >= 0]
    left.append(ids[whole[group[short]]]), right.append(ids[short])
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def radius_join(forms: DataFrame) -> DataFrame:
    """(a, b): names within RADIUS of each other whose spellings are one slip apart, a < b.

    ``forms`` has distinct names (form, spellings). Names meet inside the cells, by cell and
    signature; a signature's names differ in one sound, or by one syllable that one has more, so
    they are as few as there are sounds and syllables. What goes through the shuffle is hashes;
    names whose hashes are equal by chance are told apart by their distance.
    """
    pivots = pivots_of(forms)
    if not pivots:
        return forms.select(F.col("form").alias("a"), F.col("form").alias("b")).limit(0)
    numbered = forms.select(F.xxhash64("form").alias("id"), "form", "spellings")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [signatures(f) for f in b.column(1).to_pylist()]
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in of]))
            sig = pa.array([s for x in of for s, _ in x], pa.int64())
            role = pa.array([r for x in of for _, r in x], pa.int8())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(2).take(row), sig, role], names=["id", "cell", "sig", "role"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one partition of the shuffle, of numbers only
        if not held:
            return
        t = pa.Table.from_batches(held)
        a, b = meeting(*(t.column(c).to_numpy() for c in ("cell", "sig", "role", "id")))
        for at in range(0, len(a), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 10_000]), pa.array(b[at : at + 10_000])], names=["a", "b"])

    placed = assign(spread(numbered), pivots).mapInArrow(sign, "id bigint, cell int, sig bigint, role tinyint")
    parts = -(-forms.count() * SIGNATURES // PARTITION_ROWS)
    default = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a task holds a partition's numbers: more names, more partitions
    met = placed.repartition(parts, "cell", "sig") if parts > default else placed.repartition("cell", "sig")
    pairs = met.mapInArrow(meet, "a bigint, b bigint").distinct()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, g, p, q = (b.column(i).to_pylist() for i in range(4))
            keep = [within(x, y) and any(one_slip(s, t) for s in u for t in v) for x, y, u, v in zip(f, g, p, q)]
            kept = b.select(["f", "g"]).filter(pa.array(keep, pa.bool_()))
            yield kept.rename_columns(["a", "b"])

    of = lambda c, f, p: numbered.select(F.col("id").alias(c), F.col("form").alias(f), F.col("spellings").alias(p))
    met = pairs.join(of("a", "f", "p"), "a").join(of("b", "g", "q"), "b").select(F.least("f", "g").alias("f"), F.greatest("f", "g").alias("g"), F.when(F.col("f") < F.col("g"), F.col("p")).otherwise(F.col("q")).alias("p"), F.when(F.col("f") < F.col("g"), F.col("q")).otherwise(F.col("p")).alias("q"))
    linked = met.mapInArrow(near, "a string, b string")
    # a Latin and a Hangul spelling of equal letters: an equi-join, with a row for each way to spell a name
    letters = F.replace("form", F.lit(SILENT), F.lit("")).alias("letters")
    left, right = (forms.select(letters, F.col("form").alias(c)) for c in ("a", "b"))
    return linked.unionByName(left.join(right, "letters").where("a < b").select("a", "b")).distinct()


# -- organisations ------------------------------------------------------------------------
def read_rows(df: DataFrame, *, row: str, key: str, name: str, group: str) -> DataFrame:
    """(row, key, form, spelling, circle) of each row, as read from its typed values: the whole name, its spelling, its group."""
    kind = df.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [key_of(k) for k in b.column(1).to_pylist()]
            read = [read_name(n) if n else None for n in b.column(2).to_pylist()]
            groups = [_clean(g) if g else None for g in b.column(3).to_pylist()]
            circle = [skeleton(re.sub(r"그룹|그릅|계열|group|[^0-9a-z가-힣]", "", g)) or None if g else None for g in groups]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(keys, pa.string()), pa.array([r and skeleton(r[0]) + skeleton(r[1]) for r in read], pa.string()),
                    pa.array([r and spelling(r[0]) + spelling(r[1]) for r in read], pa.string()), pa.array(circle, pa.string()),
                ],
                names=["row", "key", "form", "spelling", "circle"],
            )

    cols = [F.col(row).alias("row"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate((key, name, group))]]
    return df.where(F.col(row).isNotNull()).select(*cols).mapInArrow(run, f"row {kind}, key string, form string, spelling string, circle string")


def spread_labels(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(form, label) of linked forms: the nearest key, or the least form of a component without one.

    Labels travel along links until nothing changes; every round is written to the shared folder.
    """
    ends = links.select(F.col("a").alias("form"), F.col("b").alias("other")).union(links.select("b", "a"))
    ends = materialise(ends, "name-links")
    own = F.struct(F.lit(1).alias("rank"), F.lit(0).alias("far"), F.concat(F.lit("f:"), F.col("form")).alias("label"))
    keyed = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("far"), F.concat(F.lit("k:"), F.col("key")).alias("label"))
    state = materialise(
        ends.select("form").distinct().join(seeds, "form", "left").select("form", F.when(F.col("key").isNotNull(), keyed).otherwise(own).alias("at"), F.col("key").isNotNull().alias("fixed")),
        "name-labels",
    )
    while True:
        step = F.struct(F.col("at.rank").alias("rank"), (F.col("at.far") + 1 - F.col("at.rank")).alias("far"), F.col("at.label").alias("label"))
        heard = ends.join(state.select(F.col("form").alias("other"), step.alias("said")), "other").groupBy("form").agg(F.min("said").alias("said"))
        after = materialise(
            state.join(heard, "form", "left").select(
                "form", F.when(F.col("fixed") | F.col("said").isNull() | (F.col("at") <= F.col("said")), F.col("at")).otherwise(F.col("said")).alias("at"), "fixed", F.col("at").alias("was")
            ),
            "name-labels",
        )
        changed = after.where("at != was").limit(1).count()
        state = after.drop("was")
        if not changed:
            return state.select("form", F.col("at.label").alias("label"))


def organisations(df: DataFrame, *, row: str, key: str, name: str, group: str) -> DataFrame:
    """(row, organisation): one row for each row that names an organisation, with its class.

    Rows whose keys hold one value are one organisation, rows of different keys never. Rows
    without a key belong to the key whose names are nearest, one slip at a time; a name that
    stands under several keys is decided by its group, or else stays by itself. Rows with neither
    a key nor a readable name are left out; repeated rows and ties fall into the same class.

    A name or group is decided once, whatever the number of its rows and keys; rows then meet
    one decision each, in joins whose hot keys can be split.
    """
    rows = materialise(read_rows(df, row=row, key=key, name=name, group=group), "name-rows")
    named = rows.where("form is not null and form != ''")
    forms = materialise(named.groupBy("form").agg(F.collect_set("spelling").alias("spellings")), "name-forms")
    held = materialise(named.where("key is not null").select("form", "circle", "key").distinct(), "name-keys")
    least = [F.min("key").alias("key"), F.max("key").alias("most")]
    one = held.groupBy("form").agg(*least)
    single = one.where("key = most").select("form", "key")
    several = one.where("key != most").select("form")
    labels = spread_labels(single, radius_join(forms))
    hinted = held.where("circle is not null").join(several, "form", "left_semi").groupBy("form", "circle").agg(*least).where("key = most")
    keyed = lambda c: F.concat(F.lit("k:"), F.col(c))
    decided = forms.select("form").join(single, "form", "left").join(labels, "form", "left").select("form", F.coalesce(keyed("key"), "label").alias("found"))
    judged = (
        named.where("key is null").select("row", "form", "circle")
        .join(decided, "form", "left").join(hinted.select("form", "circle", keyed("key").alias("hint")), ["form", "circle"], "left")
        # a name under one key has that key's label; the hint is of names under several, whose label is of no key
        .select("row", F.coalesce(F.when(F.col("found").startswith("k:") & F.col("hint").isNull(), F.col("found")), "hint", "found", F.concat(F.lit("f:"), F.col("form"))).alias("organisation"))
    )
    return rows.where("key is not null").select("row", keyed("key").alias("organisation")).unionByName(judged)


#: Rows of one organisation that a task pairs with all others of it.
PAIR_BLOCK = 1000


def all_pairs(classes: DataFrame) -> DataFrame:
    """(a, b) with a < b for all pairs of rows of a class; a large class is spread over blocks."""
    sizes = classes.groupBy("organisation").agg(F.count("*").alias("n")).where("n > 1")
    sized = classes.join(sizes, "organisation").withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    left = sized.select("organisation", F.col("row").alias("a"), F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"))
    right = sized.select("organisation", F.col("row").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["organisation", "block"]).where("a < b").select("a", "b")


def company_pairs(company: DataFrame) -> DataFrame:
    """All pairs of company rows that denote the same organisation."""
    classes = materialise(organisations(company, row="company_id", key="saramin_csn", name="name", group="group_name"), "name-classes")
    return all_pairs(classes).select(F.col("a").alias("company_id_a"), F.col("b").alias("company_id_b")).distinct()

