"""One consistent form of text: widths, accents, spaces, invisible and look-alike characters.

The mapping of single characters and the compositions of letters with what follows them are
compiled once, checked for conflicts, into one trie. A text is read in one pass over its grapheme
clusters: each character's entry is stepped through the trie, along the longest path that the
marks after a letter allow, and a word's state decides, at its end, over the look-alike letters
in it. Emoji clusters pass whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fernmill.functions.lookalikes import LOOKALIKES, named_letters

#: Characters without a picture of their own; joiners stay inside emoji sequences.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080)]
SPACES = [0x0009, 0x000B, 0x000C, 0x0085, 0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ZWJ, VS15, VS16 = "\u200d", "\ufe0e", "\ufe0f"


def _mapping() -> dict[str, str]:
    """The precomputed mapping of single characters; look-alikes are apart."""
    m = {chr(c): "" for c in INVISIBLE} | {chr(c): " " for c in SPACES}
    m |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width ASCII
    m |= {"￠": "¢", "￡": "£", "￢": "¬", "￣": "¯", "￤": "¦", "￥": "¥", "￦": "₩"}
    for c in (*range(0xFF61, 0xFFA0), *range(0xFFA1, 0xFFDD)):  # half-width Katakana and Hangul letters
        if (wide := unicodedata.decomposition(chr(c))).startswith("<narrow>"):
            m[chr(c)] = chr(int(wide.split()[1], 16))
    # what has a canonical form of other characters (signs of one letter, excluded compositions), by Unicode's data
    for c in range(0x340, 0x2FA20):
        if chr(c) not in m and (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and (one := unicodedata.normalize("NFC", chr(c))) != chr(c):
            m[chr(c)] = one
    return m


def compositions() -> dict[str, dict[str, str]]:
    """Letter -> what may follow it -> the letter composed of both, by Unicode's data; Hangul by its rule."""
    edges: dict[str, dict[str, str]] = {}
    for c in range(0xC0, 0x2FA20):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (chr(int(x, 16)) for x in d.split())
            edges.setdefault(a, {})[b] = chr(c)
    for lead in range(19):
        for vowel in range(21):
            open_syllable = chr(0xAC00 + (lead * 21 + vowel) * 28)
            edges.setdefault(chr(0x1100 + lead), {})[chr(0x1161 + vowel)] = open_syllable
            edges[open_syllable] = {chr(0x11A7 + tail): chr(ord(open_syllable) + tail) for tail in range(1, 28)}
    return edges


def checked(mapping: dict[str, str], letters: dict[str, str] = LOOKALIKES) -> dict[str, str]:
    """The mapping, if no two entries conflict: outputs are stable under it, and no letter has two."""
    for source, target in mapping.items():
        if any(mapping.get(t, t) != t for t in target):
            raise ValueError(f"the mapping of U+{ord(source[0]):04X} leads to a character that is mapped itself")
    for source, target in letters.items():
        if source in mapping:
            raise ValueError(f"U+{ord(source):04X} is mapped twice")
        if target in letters or target in mapping:
            raise ValueError(f"the look-alike U+{ord(source):04X} leads to a character that is mapped itself")
    return mapping


class Node:
    """A place in the trie: what is written if the path ends here, and what leads on."""

    __slots__ = ("out", "next")

    def __init__(self, out: str):
        self.out = out
        self.next: dict[str, Node] = {}


class Transducer:
    """The compiled trie, walked over grapheme clusters in one pass; see the module's text."""

    def __init__(self) -> None:
        import regex

        #: In a word with Latin letters these become Latin, elsewhere they stay.
        mapping = _mapping()
        self.letters = {c: l for c, l in named_letters().items() if c not in mapping} | LOOKALIKES
        self.map = checked(mapping, self.letters)
        self.root: dict[str, Node] = {}
        edges = compositions()
        for a, following in edges.items():
            node = self._node(a)
            for b, made in following.items():
                node.next[b] = self._node(made)
        #: Letters with accents, apart: another mark may have to go before the accent.
        pairs = {made: unicodedata.normalize("NFD", made) for f in edges.values() for made in f.values()}
        self.apart = {made: d for made, d in pairs.items() if all(map(unicodedata.combining, d[1:]))}
        self.plain = re.compile(PLAIN).match
        self.clusters = regex.compile(r"\X").findall
        #: Anything that could change; a text without it is passed through.
        letter = "".join(map(re.escape, self.letters))
        self.dirty = regex.compile("[" + "".join(map(re.escape, self.map)) + letter + r"\p{M}\u1100-\u11ffꥠ-꥿ힰ-퟿]")
        self.of_word = regex.compile(r"[\p{L}\p{M}\p{N}_]").match
        self.latin = regex.compile(r"\p{Script=Latin}").match
        self.emoji = regex.compile(r"\p{Extended_Pictographic}|\p{Regional_Indicator}|[0-9#*]\ufe0f?\u20e3")
        #: Whether a written letter belongs to a word, and whether it is Latin: learned once a letter.
        self.kinds: dict[str, tuple[bool, bool]] = {}

    def _node(self, letter: str) -> Node:
        if letter not in self.root:
            self.root[letter] = Node(letter)
        return self.root[letter]

    def _composed(self, letter: str, marks: list[str]) -> str:
        """A letter with the marks after it: the longest path along marks that none before them blocks."""
        if not marks:
            return letter
        first, *own = self.apart.get(letter, letter)
        node, left, last = self.root.get(first), [], 0
        out = first
        for m in sorted([*own, *marks], key=unicodedata.combining):
            rank = unicodedata.combining(m)
            to = node.next.get(m) if node is not None and rank > last else None
            if to is not None:
                node, out = to, to.out
            else:
                left.append(m)
                last = rank
        return out + "".join(left)

    def apply(self, text: str) -> str:
        if self.plain(text) or not self.dirty.search(text) and unicodedata.is_normalized("NFC", text):
            return text
        out: list[str] = []
        letter, marks = "", []  # read, but not written: something may follow that belongs to it
        latin, foreign = False, []  # of the word that is being written
        mapped, combining = self.map, unicodedata.combining

        def end_word() -> None:
            nonlocal latin
            if latin:
                for k in foreign:
                    unit = out[k]
                    out[k] = self._composed(self.letters[unit[0]], list(unit[1:]))
            latin = False
            foreign.clear()

        def write(unit: str) -> None:
            nonlocal latin
            kind = self.kinds.get(unit[0])
            if kind is None:
                kind = self.kinds[unit[0]] = bool(self.of_word(unit[0])), bool(self.latin(unit[0]))
            if not kind[0]:
                end_word()
            elif kind[1]:
                latin = True
            elif unit[0] in self.letters:
                foreign.append(len(out))
            out.append(unit)

        for g in self.clusters(text):
            whole = None
            if len(g) > 1 or g > "\u2000":
                if self.emoji.search(g):
                    whole = g.rstrip(ZWJ)  # a joiner that joins nothing is an invisible character
                elif g[0] <= "\u2000" and (VS15 in g or VS16 in g):
                    g = g.replace(VS15, "").replace(VS16, "")
            if whole is not None:
                if letter or marks:
                    write(self._composed(letter, marks) if letter else "".join(sorted(marks, key=combining)))
                    letter, marks = "", []
                if whole:
                    write(whole)
                continue
            for c in g:
                for x in mapped.get(c, c):
                    if combining(x):
                        marks.append(x)
                        continue
                    if letter and not marks and (node := self.root.get(letter)) is not None and (to := node.next.get(x)) is not None:
                        letter = to.out
                        continue
                    if letter or marks:
                        write(self._composed(letter, marks) if letter else "".join(sorted(marks, key=combining)))
                        marks = []
                    letter = x
        if letter or marks:
            write(self._composed(letter, marks) if letter else "".join(sorted(marks, key=combining)))
        end_word()
        return "".join(out)


_one: list[Transducer] = []


def transducer() -> Transducer:
    if not _one:
        _one.append(Transducer())
    return _one[0]


#: Texts of these characters alone are in the consistent form; the pattern runs in the JVM, where '$' would match before a last line separator.
PLAIN = r"^[\n\r\x20-\x7e\xa1-\xac\xae-\xff가-힣ㄱ-ㅣㅥ-ㆎ‐-‧‰-⁞⁰-⃏℀-℥℧-℩ℬ-⌨⌫-⫛⫝-Ɀⳤ-ⳮⳲ-⵾ⶀ-⷟⸀-⿿、-〩〰-゘゛-㄰㆐-鿿]*+(?![\s\S])"


def normalise(df: DataFrame, *, text: str, out: str = "norm") -> DataFrame:
    """Every row with the consistent form of a text column; null stays null, empty stays empty."""
    schema = df.withColumn(out, F.lit("").cast("string")).schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for b in batches:
            norm = pa.array([None if x is None else t.apply(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, norm], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def differing(df: DataFrame, *, text: str) -> DataFrame:
    """The rows whose text is not in the consistent form, with that form as ``norm``.

    Null and empty texts are in it. Texts of plain characters never leave the JVM.
    """
    suspects = df.where(F.col(text).isNotNull() & ~F.col(text).rlike(PLAIN))
    return normalise(suspects, text=text).where(F.col("norm") != F.col(text))


def list_items(df: DataFrame, key: str, column: str) -> DataFrame:
    """(field, row_key, item_no, text) of the elements of a list column, counted from 0."""
    return df.select(F.lit(column).alias("field"), F.col(key).alias("row_key"), F.posexplode(column).alias("item_no", "text"))


def inconsistent_texts(raw_document: DataFrame, posting: DataFrame) -> DataFrame:
    """(field, row_key, item_no, norm) of titles and list elements not in the consistent form."""
    title: Column = F.lit("title")
    texts = (
        posting.select(title.alias("field"), F.col("row_id").alias("row_key"), F.lit(0).alias("item_no"), F.col("title").alias("text"))
        .unionByName(list_items(raw_document, "raw_id", "required"))
        .unionByName(list_items(raw_document, "raw_id", "preferred"))
    )
    return differing(texts, text="text").select("field", "row_key", F.col("item_no").cast("bigint").alias("item_no"), "norm")
