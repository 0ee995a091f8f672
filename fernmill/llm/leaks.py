"""Evaluation texts inside training text, by Wu-Manber multi-pattern search over words.

Patterns are all runs of SEED words of the held-out items (without the instructions that
items share). If at least LEAST words in a row of an item stand in a text with at most one in
ONE_IN replaced, some SEED of them stand unchanged, so no leak is missed. The block shift
table skips positions that can't end a pattern, suffix-hash buckets select patterns, a direct
comparison confirms them, and each confirmed place is checked along its diagonal.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain
from operator import eq
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernmill.functions.lookalikes import LOOKALIKES
from fernmill.session import materialise, spread

LEAST, ONE_IN, SEED = 20, 7, 5
BLOCK = 2
#: Every task holds items of so many characters (some 150 MB of tables) at a time; more items are searched for set by set.
ITEM_CHARACTERS = 3_000_000
#: An instruction is an opening of at least so many words that so many different texts share.
SHARED_WORDS, SHARED_ITEMS = 6, 3

#: What follows a tag's name, of any length: names with values, and three names without one in a row at most, so that
#: text after a stray '<' isn't taken for a tag.
_BARE = r"""(?:\s+[^\s<>"'=]+){0,3}"""
_ATTRIBUTES = rf"""(?:(?:{_BARE}\s+[^\s<>"'=]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s<>]+))*+{_BARE}\s*)?"""
INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|tt|u)" + _ATTRIBUTES + r"/?>", re.I)
TAG = re.compile(r"</?[a-zA-Z][\w:-]*+" + _ATTRIBUTES + r"/?>")
LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
EMPHASIS = re.compile(r"(?<!\w)[*_~`]{1,3}(?=\w)|(?<=\w)[*~`]{1,3}|(?<=\w)_{1,3}(?!\w)")
WORD = re.compile(r"[^\W_]+")
_LATIN = str.maketrans({k: v for k, v in LOOKALIKES.items()})


_STRANGE = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff" + "".join(map(re.escape, LOOKALIKES)) + "]")
_HIDDEN = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u115f\u1160\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")


def without_comments(text: str) -> str:
    """The text without mark-up comments; one that doesn't end stays."""
    out, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        out.append(text[at:begin])
        at = end + 3
    return " ".join([*out, text[at:]])


def words_of(text: str) -> list[str]:
    """The words of a text without case, punctuation, mark-up, look-alikes and invisible characters."""
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", without_comments(text)))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = LINK.sub(r"\1", text)
    if "*" in text or "_" in text or "`" in text or "~" in text:
        text = EMPHASIS.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _STRANGE.search(text):
            # accents written apart were composed just now; what is left of them is dropped on both sides
            text = _HIDDEN.sub("", text).translate(_LATIN)
            text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.casefold())


def opening_end(w: list[str], count: Callable[[int], int]) -> int:
    """How many first words of a text are an instruction, with ``count(k)`` texts that share the first k.

    The opening ends where the texts that share it fall to less than half, if only a few words
    more are shared after that. It leaves LEAST words of a text that has them, unless the text is
    nothing but the instruction, or has too few words of its own to be told from it.
    """
    k = SHARED_WORDS
    while k <= len(w) and count(k) >= SHARED_ITEMS:
        k += 1
    if k == SHARED_WORDS:
        return 0
    end = k - 1
    falls = [j for j in range(SHARED_WORDS, end) if 2 * count(j + 1) < count(j)]
    while near := [j for j in falls if 0 < end - j < SHARED_WORDS]:
        end = near[0]
    return min(end, max(len(w) - LEAST, 0)) if len(w) >= LEAST and len(w) - end > LEAST // ONE_IN else end


def without_shared(items: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """The items' words after the opening that several different texts share.

    A text counts once, however many items hold it or an opening of it.
    """
    texts = {" ".join(w): w for _, w in items}
    # an opening of a text stands right before it or before a longer opening in this order
    order = sorted(texts)
    count: dict[tuple[str, ...], int] = defaultdict(int)
    for w in (texts[a] for a, b in zip(order, [*order[1:], ""]) if not b.startswith(a)):
        for k in range(SHARED_WORDS, len(w) + 1):
            count[tuple(w[:k])] += 1
    return [(i, w[opening_end(w, lambda k: count[tuple(w[:k])]) :]) for i, w in items]


def own_words(items: DataFrame) -> DataFrame:
    """(i, own) of items (i, t): ``without_shared`` for any number of items, as joins on openings."""
    kind = items.schema["i"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["i", "w"])

    words = materialise(items.mapInArrow(read, f"i {kind}, w array<string>"), "leak-words")
    opening = lambda k: F.concat_ws(" ", F.slice("w", F.lit(1), k))
    k = F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("k")
    at = words.select("w").where(F.size("w") > 0).distinct().select("w", F.xxhash64("w").alias("text"), k)
    # each word of each text once, with the hash of what stands before it
    rows = materialise(at.select("text", "k", F.size("w").alias("n"), F.xxhash64(opening(F.col("k"))).alias("before"), F.get("w", F.col("k")).alias("word")), "leak-openings")
    last = rows.where("k = n - 1").select(F.col("text").alias("t"), "before", F.col("word").alias("cut"), F.col("n").alias("size"))
    longer = rows.groupBy("before", "word").agg(F.max("n").alias("most"))
    within = last.join(longer, (last["before"] == longer["before"]) & F.col("word").startswith(F.col("cut")) & ((F.col("most") > F.col("size")) | (F.col("word") != F.col("cut"))), "left_semi")
    counted = rows.where(F.col("k") >= SHARED_WORDS - 1).join(within.select(F.col("t").alias("text")), "text", "left_anti")
    shared = counted.groupBy("before", "word").agg(F.count("*").alias("texts")).where(F.col("texts") >= SHARED_ITEMS)
    counts = rows.join(shared, ["before", "word"]).groupBy("text").agg(F.collect_list(F.struct((F.col("k") + 1).alias("k"), "texts")).alias("counts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = []
            for w, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                count = {x["k"]: x["texts"] for x in c or ()}
                own.append(w[opening_end(w, lambda k: count.get(k, 0)) :])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.string()))], names=["i", "own"])

    return words.withColumn("text", F.xxhash64("w")).join(counts, "text", "left").select("i", "w", "counts").mapInArrow(cut, f"i {kind}, own array<string>")


class WuManber:
    """Shift and hash tables of the items' seeds; words are numbered by the items' vocabulary."""

    def __init__(self, items: list[tuple[int, str]] | None = None, own: list[tuple[int, list[str]]] | None = None):
        """Of texts, or of words whose openings are taken away already (``own``)."""
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        # items with equal words count as each other; the shared openings are those of different texts
        for i, w in without_shared([(i, words_of(t)) for i, t in items or () if t]) if own is None else own:
            self.items.append((i, [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]))
        self.base = len(self.vocabulary) + 1
        self.shift: dict[int, int] = {}
        #: Suffix block -> first two words -> [(middle words, item, place)].
        self.buckets: dict[int, dict[int, list[tuple[tuple[int, ...], int, int]]]] = {}
        base, most = self.base, SEED - BLOCK + 1
        for n, (_, w) in enumerate(self.items):
            if len(w) < LEAST:
                continue
            for at in range(len(w) - SEED + 1):
                seed = w[at : at + SEED]
                for end in range(BLOCK, SEED + 1):
                    block = seed[end - 2] * base + seed[end - 1]
                    self.shift[block] = min(self.shift.get(block, most), SEED - end)
                suffix, prefix = seed[-2] * base + seed[-1], seed[0] * base + seed[1]
                self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((tuple(seed[2:-2]), n, at))

    def _leaked(self, item: list[int], text: list[int], offset: int) -> bool:
        """Whether LEAST words in a row of an item stand at this offset, one in ONE_IN replaced at most."""
        lo, hi = max(0, -offset), min(len(item), len(text) - offset)
        if hi - lo < LEAST or sum(map(eq, item[lo:hi], text[lo + offset : hi + offset])) < LEAST - LEAST // ONE_IN:
            return False
        # f(k) = words - ONE_IN * replaced words before k; f(j) >= f(i) for j >= i + LEAST
        f, values, least = 0, [0], None
        for k in range(lo, hi):
            f += 1 if item[k] == text[k + offset] else 1 - ONE_IN
            values.append(f)
            if (i := k + 1 - lo - LEAST) >= 0:
                least = values[i] if least is None else min(least, values[i])
                if f >= least:
                    return True
        return False

    def search(self, text: str) -> list[int]:
        """The ids of the items that the text contains."""
        get = self.vocabulary.get
        words = [get(w, -1) for w in words_of(text)]
        n = len(words)
        if n < LEAST:
            return []
        shift, buckets, base, most = self.shift.get, self.buckets, self.base, SEED - BLOCK + 1
        tried: set[tuple[int, int]] = set()
        found: set[int] = set()
        at = SEED - 1
        while at < n:
            a, b = words[at - 1], words[at]
            block = a * base + b if a >= 0 and b >= 0 else -1
            step = most if block < 0 else shift(block, most)
            if b < 0:
                step = SEED  # no pattern holds this word
            if step:
                at += step
                continue
            start = at - SEED + 1
            p, q = words[start], words[start + 1]
            if p >= 0 and q >= 0 and (of := buckets.get(block)) is not None:
                middle = None
                for mid, item, place in of.get(p * base + q, ()):
                    if middle is None:
                        middle = tuple(words[start + 2 : at - 1])
                    if mid != middle:
                        continue
                    key, row = (item, start - place), self.items[item]
                    if key not in tried and row[0] not in found:
                        tried.add(key)
                        if self._leaked(row[1], words, start - place):
                            found.add(row[0])
            at += 1
        return sorted(found)


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_key: str, doc_text: str, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key): each document with the items that it contains, each pair once a document row.

    Null and empty texts contain nothing and null items are contained in nothing; items with
    fewer than LEAST words can't be found; items with equal texts are found together. Items are
    held in each task in sets of ITEM_CHARACTERS at most, and the documents are read once a set.
    """
    spark = documents.sparkSession
    kept = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i is not null and length(t) > 0").distinct()
    size = kept.agg(F.sum(F.length("t"))).first()[0] or 0
    kinds = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    texts = spread(documents.select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t")).where(F.length("t") > 0))

    def found(**of: Any) -> DataFrame:
        shared = spark.sparkContext.broadcast(of)  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = None
            for b in batches:
                if tables is None:
                    tables = WuManber(**shared.value)
                rows, ids = [], []
                for k, t in enumerate(b.column(1).to_pylist()):
                    hit = tables.search(t)
                    rows += [k] * len(hit)
                    ids += hit
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())], names=["d", "i"])

        return texts.mapInArrow(run, f"d {kinds[0]}, i bigint").select(F.col("d").alias(doc_key), F.col("i").cast(kinds[1]).alias(item_key))

    if size <= ITEM_CHARACTERS:
        return found(items=[(r[0], r[1]) for r in kept.orderBy("i", "t").collect()])
    own = own_words(kept).where(F.size("own") >= LEAST).withColumn("size", F.length(F.concat_ws(" ", "own")))
    # sets of half the size on average; one that comes out larger all the same is cut further
    sets = 2 * -(-size // ITEM_CHARACTERS)
    placed = materialise(own.withColumn("set", F.pmod(F.xxhash64("i", "own"), F.lit(sets)).cast("int")), "leak-sets")
    out = None
    for s in range(sets):
        rest = placed.where(F.col("set") == s).select("i", "own", "size").orderBy("i", "own").toLocalIterator()
        of, held = [], 0
        for r in chain(rest, [None]):
            if of and (r is None or held + r["size"] > ITEM_CHARACTERS):
                part = found(own=of)
                out = part if out is None else out.unionByName(part)
                of, held = [], 0
            if r is not None:
                of.append((r["i"], r["own"]))
                held += r["size"]
    return found(own=[]) if out is None else out
