"""Keyword-stuffed and link-list pages.

A text becomes a row of terms. Three kinds of spans are marked in it: spans whose terms recur
at short gaps, spans that repeat themselves at a fixed lag of any length (positional
autocorrelation in lag windows), and long runs of short segments that are nouns or links without a function word. A
page is spam if the marked spans make up most of its characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernmill.session import spread

#: Terms compared for recurrence lie at most so far apart; the share of recurring terms is taken in windows of this length.
GAP, RECURRING = 24, 0.62
#: The share of equal terms in a lag window of three copies; terms of a window of two copies at most, and their share.
PERIODIC, BLOCK, COPIED = 0.62, 24, 0.85
#: Segments in a row without function words that make a list, and the most words of each.
LIST_RUN, LIST_WORDS = 14, 4
#: Terms of a window around a link and the share of links among them that makes the window a link list; fewer links in all are no list.
LINK_WINDOW, LINKS, LEAST_LINKS = 12, 0.18, 6
#: The share of a page's characters in marked spans, and the least number of terms, of a spam page.
SHARE, LEAST_TERMS = 0.5, 16

#: English function words; a fixed list.
FUNCTION_WORDS = frozenset(
    "a an the and or but of for to in on at by with from as into than that this these those is are was were be been being "
    "has have had do does did will would can could should may might must not no so such it its we our you your they their "
    "one each every all any both either who which what when where while after before under over between without if then once".split()
)
#: Endings of Korean words that mark a sentence: particles and verb endings; a fixed list.
KOREAN_ENDINGS = re.compile(r"[가-힣](?:은|는|을|를|에서|으로|에게|까지|부터|마다|처럼|보다|하고|하며|하여|해서|하는|했|합니다|습니다|니다|세요|다|요|며|고|면|서|게|려고|도록|신|된|할|한)$")
URL = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@])[\w-]+(?:\.[\w-]+)+/[^\s)\"'<>]*|(?<![\w.])/[\w-]+(?:/[\w.-]+)+|<a\s[^>]*>|</a>", re.I)
TERM = re.compile(r"\x01|[^\W_]+(?:[.+'’,-]*[^\W_]+)*[+#]*")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: Where a list's segments end; a '#' that begins a tag ends one without white space too, but for the '#' of a name as C#.
#: The look at the next character keeps the alternatives from being tried at every letter.
CUT = re.compile(r"(?=[\s,|·ㆍ•/>»›→★☆◆■□▶▷●○♥♡;、，｜~#])(?:\n+|\s{2,}|\s*[,|·ㆍ•/>»›→★☆◆■□▶▷●○♥♡;、，｜~]+\s*|(?<=\S)\s+[-–—]\s+|\s+(?=#)|(?<![^\w#][CFJQcfjq])(?<!^[CFJQcfjq])(?=#\w)|(?<=[.!?])\s+)")


def without_links(text: str) -> str:
    """The text with a sign in the place of each link; only words that hold what every link has are looked at."""
    low = text.lower()
    if "<a" in low:  # a tag runs on over spaces
        return URL.sub("\x01", text)
    if "/" not in text and "www." not in low:
        return text
    return " ".join(URL.sub("\x01", w) if "/" in w or "www." in w.lower() else w for w in text.split(" "))


def _spread(hit: np.ndarray, back: int, n: int) -> np.ndarray:
    """Mark all positions of the windows [i - back, i] for which hit[i]."""
    mark = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(mark, np.maximum(at - back, 0), 1)
    np.add.at(mark, at + 1, -1)
    return np.cumsum(mark)[:n] > 0


def recurring_terms(codes: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Positions in windows of GAP terms most of which recur at a gap of at most GAP."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    gaps = np.where(same, np.diff(order), n + GAP)
    near = np.zeros(n, dtype=bool)
    near[order[1:]] |= gaps <= GAP
    near[order[:-1]] |= gaps <= GAP
    near &= content
    w = min(GAP, n)
    s = np.concatenate(([0], np.cumsum(near)))
    hit = np.zeros(n, dtype=bool)
    hit[w - 1 :] = s[w:] - s[:-w] >= RECURRING * w
    return _spread(hit, w - 1, n)


def run_gaps(codes: np.ndarray, doublings: int) -> np.ndarray:
    """At each lag, how many runs of 2 ** doublings terms stand again at that lag; exact, over the whole text."""
    runs = codes
    count = np.zeros(len(codes), dtype=np.int64)
    for k in range(doublings):
        if k:
            runs = np.unique(runs, return_inverse=True)[1]  # small numbers again
        runs = runs[: -(1 << k)] * (int(runs.max(initial=0)) + 1) + runs[1 << k :]
    n = len(runs)
    if n < 2:
        return count
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    begins = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    if len(begins) == n:
        return count
    sizes = np.diff(np.append(begins, n))
    # the gaps of a frequent run come from a transform, those of the others one by one
    frequent = sizes * sizes > 16 * n
    width = 1 << (2 * n - 1).bit_length()
    for at, m in zip(begins[frequent], sizes[frequent]):
        where = np.zeros(n)
        where[order[at : at + m]] = 1
        count[:n] += np.rint(np.fft.irfft(np.abs(np.fft.rfft(where, width)) ** 2, width)[:n]).astype(np.int64)
    last = np.repeat(np.where(frequent, 0, begins + sizes), sizes)
    at, d = np.arange(n), 1
    while len(at := at[at + d < last[at]]):
        count[:n] += np.bincount(order[at + d] - order[at], minlength=n)
        d += 1
    count[0] = 0
    return count


def periodic_terms(codes: np.ndarray) -> np.ndarray:
    """Positions that equal others at a fixed lag, whatever the lag.

    Windows of twice the lag with the share PERIODIC of equal terms are marked with what they
    equal. So are windows of the lag, BLOCK terms at most, with the share COPIED, for which two
    copies are enough. Such windows hold runs of equal terms, of 2 and of 4; lags at which too
    few runs stand again are not looked at.
    """
    n = len(codes)
    out = np.zeros(n, dtype=bool)
    if n < 9 or not (twos := run_gaps(codes, 1)).any():
        return out
    lags = np.arange(n)
    wide, copied = np.maximum(8, 2 * lags), np.clip(lags, 8, BLOCK)
    # with e of w terms equal there are at most w - e + 1 runs
    e = np.ceil(PERIODIC * wide)
    wide_lags = (wide + lags <= n) & (twos >= np.maximum(2 * e - wide - 1, 1))
    e = np.ceil(COPIED * copied)
    copied_lags = (lags >= 8) & (copied + lags <= n) & (twos >= 3)  # a run of 4 is three of 2 at its lag
    if copied_lags.any():
        copied_lags &= run_gaps(codes, 2) >= np.maximum(e - 3 * (copied - e + 1), 1)
    for lag in np.flatnonzero(wide_lags | copied_lags):
        if out.all():
            break
        s = np.concatenate(([0], np.cumsum(codes[lag:] == codes[:-lag])))
        for look, w, least in ((wide_lags[lag], wide[lag], PERIODIC), (copied_lags[lag], copied[lag], COPIED)):
            if look and (share := s[w:] - s[:-w] >= least * w).any():
                hit = np.zeros(n, dtype=bool)
                hit[lag + w - 1 :] = share
                again = _spread(hit, w - 1, n)
                out |= again
                out[:-lag] |= again[lag:]
    return out


def linked_terms(links: np.ndarray) -> np.ndarray:
    """Positions in windows rich in links."""
    n = len(links)
    if links.sum() < LEAST_LINKS:
        return np.zeros(n, dtype=bool)
    w = min(LINK_WINDOW, n)
    s = np.concatenate(([0], np.cumsum(links)))
    hit = np.zeros(n, dtype=bool)
    hit[w - 1 :] = s[w:] - s[:-w] >= max(2, LINKS * w)
    return _spread(hit, w - 1, n)


def functional(words: list[str]) -> bool:
    """Whether a segment reads as part of a sentence; a single word does by its verb ending only."""
    if len(words) == 1:
        return words[0].endswith(("니다", "세요"))
    return any(w in FUNCTION_WORDS or KOREAN_ENDINGS.search(w) for w in words)


def measure(text: str) -> dict[str, float]:
    """Shares of a text's characters in recurring, periodic and list spans, and in any."""
    none = {"terms": 0, "recurring": 0.0, "periodic": 0.0, "listed": 0.0, "marked": 0.0}
    flat = without_links(text)
    raw: list[str] = []
    sizes: list[int] = []
    segments: list[bool] = []
    for seg in CUT.split(flat):
        found = TERM.findall(seg)
        if not found:
            continue
        raw += found
        sizes.append(len(found))
        # a long segment is no list's
        if len(found) > 2 * LIST_WORDS and "\x01" not in found:
            segments.append(False)
            continue
        words = [w.lower() for w in found if w != "\x01"]
        link = len(words) < len(found)
        segments.append(len(words) <= LIST_WORDS + 2 * link and ((not functional(words) and ": " not in seg.strip(" :")) or link))
    n = len(raw)
    if n == 0:
        return none
    # terms by what is written, then by what they count as
    written: dict[str, int] = {}
    first = np.fromiter([written.setdefault(t, len(written)) for t in raw], dtype=np.int64, count=n)
    ids: dict[str, int] = {}
    forms = [t if t == "\x01" else t.lower() if t.isalpha() else NUMBER.sub("0", t.lower()) for t in written]
    codes = np.array([ids.setdefault(f, len(ids)) for f in forms], dtype=np.int64)[first]
    content = np.array([f not in FUNCTION_WORDS for f in forms])[first]
    is_link = np.array([f == "\x01" for f in forms])[first]
    weight = np.array([24.0 if f == "\x01" else len(t) for t, f in zip(written, forms)])[first]
    segment_of = np.repeat(np.arange(len(sizes)), sizes)
    recurring, periodic = recurring_terms(codes, content), periodic_terms(codes)
    # runs of list segments, different or not; the skill list of an opening is too small a part of it to count
    in_list = np.zeros(len(segments), dtype=bool)
    k = 0
    while k < len(segments):
        end = k
        while end < len(segments) and segments[end]:
            end += 1
        if end - k >= LIST_RUN:
            in_list[k:end] = True
        k = max(end, k + 1)
    listed = in_list[segment_of] | linked_terms(is_link)
    total = weight.sum()
    return {
        "terms": n,
        "recurring": float(weight[recurring].sum() / total),
        "periodic": float(weight[periodic].sum() / total),
        "listed": float(weight[listed].sum() / total),
        "marked": float(weight[recurring | periodic | listed].sum() / total),
    }


def is_stuffed(m: dict[str, float]) -> bool:
    return m["terms"] >= LEAST_TERMS and m["marked"] >= SHARE


def stuffed_pages(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, terms, recurring, periodic, listed, marked) of the pages that are spam.

    Null, empty and nearly empty texts are none; rows with equal keys are judged each; the
    whole text is measured, however long; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    names = ["terms", "recurring", "periodic", "listed", "marked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t) if t else None for t in b.column(1).to_pylist()]
            keep = [i for i, m in enumerate(found) if m is not None and is_stuffed(m)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i]["terms"] for i in keep], pa.int32()), *[pa.array([found[i][c] for i in keep], pa.float64()) for c in names[1:]]],
                names=["key", *names],
            )

    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    return spread(kept).mapInArrow(run, f"key {kind}, terms int, recurring double, periodic double, listed double, marked double").withColumnRenamed("key", key)
