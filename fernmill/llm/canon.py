"""Mapping of freely typed values to a canonical list, by symmetric deletion.

Each entry of the list, and each alias that means one, is stored under its writing: letters,
digits and ``+ #`` only. Hangul and Latin writings of a name also meet in one phonetic key.
The dictionary holds every writing and all its deletions (of one letter, of two for long Latin
names); a typed value, or any run of words in a text, is looked up with its own deletions, and
candidates within so many edits are ranked by their weighted Damerau-Levenshtein distance and by
how often the list refers to the entry. What finds no candidate is reported as unmatched. The
dictionary is broadcast: its size is checked against a bound; a larger one is split by entries,
and what its parts find in a text is put together before the longest names are taken.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernmill.llm.textform import transducer
from fernmill.session import materialise, spread

NO_ENTRY = -1
#: The most entries and aliases that a task holds at once, some 20 KB each; larger dictionaries go in parts.
DICTIONARY_ROWS = 10_000
#: Writings at least so long are looked up with an edit: Latin letters, Hangul syllables, phonetic letters.
LATIN_LEAST, HANGUL_LEAST, SOUND_LEAST = 6, 4, 7
#: Latin writings at least so long may have two edits.
LATIN_TWO = 10
#: Weights of an edit; a doubled letter is the commonest slip, then two letters in the wrong order.
DOUBLED, SWAPPED, DROPPED, ADDED, CHANGED = 0.6, 0.7, 0.8, 0.9, 1.0
#: What a candidate weighs more that was found by its sound with an edit, or with two edits: others come first.
BY_SOUND, BY_TWO = 1.0, 2.0

#: Hangul names of Latin letters and signs; fixed values.
LETTER_NAMES = {
    "더블유": "w", "에이치": "h", "에이": "a", "비": "b", "씨": "c", "시": "c", "디": "d", "이": "e", "에프": "f", "지": "g", "아이": "i", "제이": "j", "케이": "k", "엘": "l", "엠": "m", "엔": "n",
    "오": "o", "피": "p", "큐": "q", "아르": "r", "알": "r", "에스": "s", "티": "t", "유": "u", "브이": "v", "엑스": "x", "와이": "y", "제트": "z",
}
ONSETS = "g kk n d tt r m b pp s ss - j jj c k t p h".split()
NUCLEI = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
CODAS = ["", *"k k k n n n t l l l l l l l l m p p t t ng c c k t p h".split()]
PARTICLES = ("으로는", "에서는", "으로", "에서", "이나", "이며", "까지", "부터", "을", "를", "은", "는", "이", "가", "과", "와", "로", "에", "의", "도", "나")
#: What may follow a name without being part of it: versions and notes.
VERSION = re.compile(r"\(\s*구\s*버전\s*\)|\(\s*v?[\d.]+x?\s*\)|(?<=\s)v?\d+(?:\.\d+)*(?:\.x)?(?=$|[\s,/|)])|(?<=\w)\s+v\d+(?:\.\d+)*")
TOKEN = re.compile(r"[a-z0-9]+(?:\+\+|#)?|\+\+|[가-힣]+")
#: What may stand between the words of one name.
JOIN = frozenset([" ", ".", "_", "-"])


def plain(text: str) -> str:
    """The consistent form of a text, lower case."""
    return unicodedata.normalize("NFC", transducer().apply(text)).lower()


def writing(text: str) -> str:
    """Letters, digits, ``+`` and ``#`` of a plain text."""
    return _UNWRITTEN.sub("", text)


#: Letters that one sound is written with, after two that are one.
_ONE_SOUND = str.maketrans({"q": "k", "x": "ks", "f": "p", "v": "p", "z": "j", "c": "k", "g": "k", "d": "t", "b": "p", "r": "l"})
_QU, _LAST_Y, _TWICE = re.compile("qu(?=[aeio])"), re.compile("y(?![aeiou])"), re.compile(r"([^+])\1+")
_RUNS, _ER, _UNWRITTEN = re.compile("[가-힣]+|[^가-힣]+"), re.compile(r"er(?![aeiou])"), re.compile(r"[^a-z0-9가-힣+#]")
_LAST_OF_LETTERS = frozenset(name[-1] for name in LETTER_NAMES)


def _sounds(s: str) -> str:
    s = s.replace("th", "t").replace("gh", "g").replace("ph", "p")
    if "qu" in s:
        s = _QU.sub("kw", s)
    s = s.translate(_ONE_SOUND).replace("eu", "").replace("eo", "u")
    if "y" in s:
        s = _LAST_Y.sub("i", s)
    return _TWICE.sub(r"\1", s.replace("wo", "wu"))


def phonetic(key: str) -> str:
    """A key that the Hangul and the Latin writing of a name share: epenthetic vowels fall away."""
    out = []
    for run in _RUNS.findall(key):
        if "가" <= run[0] <= "힣":
            run = run.replace("플러스", "+").replace("샵", "#").replace("샤프", "#")
            for ch in run:
                if "가" <= ch <= "힣":
                    c = ord(ch) - 0xAC00
                    out.append(ONSETS[c // 588].replace("-", "") + NUCLEI[c % 588 // 28] + CODAS[c % 28])
                else:
                    out.append(ch)
        else:
            out.append(_ER.sub("eo", run))
    return _sounds("".join(out).replace("jeieseu", "js"))


def spelled_letters(key: str) -> list[str]:
    """The writings of a Hangul key whose end spells Latin letters (as in SQL, CI, ML)."""
    done: list[str] = []
    found = [("", key)] if key[-1:] in _LAST_OF_LETTERS else []
    while found:
        tail, head = found.pop()
        if tail:
            done.append(head + tail)
        if len(tail) < 3:
            for name, letter in LETTER_NAMES.items():
                if head.endswith(name) and len(head) > len(name) + 1:
                    found.append((letter + tail, head[: -len(name)]))
    return done


def jamo(key: str) -> str:
    """The letters of Hangul syllables; a key has no other characters that come apart."""
    return unicodedata.normalize("NFD", key)


def weighted_edit(typed: str, entry: str, most: int = 1) -> float | None:
    """The least weight of at most ``most`` edits that lead from ``entry`` to ``typed``; None if more are needed.

    Damerau-Levenshtein over letters changed, added, dropped and swapped with their neighbour, each
    kind with its weight; only cells within ``most`` of the diagonal are looked at.
    """
    if typed == entry:
        return 0.0
    n, m = len(typed), len(entry)
    if abs(n - m) > most:
        return None
    # only what lies between the letters that both share at their ends
    first, short = 0, min(n, m)
    while first < short and typed[first] == entry[first]:
        first += 1
    last = 0
    while last < short - first and typed[n - 1 - last] == entry[m - 1 - last]:
        last += 1
    whole, typed, entry = typed, typed[first : n - last], entry[first : m - last]
    n, m = len(typed), len(entry)
    if max(n, m) > 2 * most and most == 1:
        return None
    # of each edits used: weights of the last two rows by column
    none: dict[int, float] = {}
    before: list[dict[int, float]] = [none] * (most + 1)
    row: list[dict[int, float]] = [{j: DROPPED * j for j in range(min(m, k) + 1) if j == k} for k in range(most + 1)]
    for i in range(1, n + 1):
        t = typed[i - 1]
        at = first + i - 1
        more = DOUBLED if at and t == whole[at - 1] or t == whole[at + 1 : at + 2] else ADDED
        now: list[dict[int, float]] = []
        for k in range(most + 1):
            cells: dict[int, float] = {}
            for j in range(max(0, i - most), min(m, i + most) + 1):
                best = row[k].get(j - 1) if j and t == entry[j - 1] else None
                if k:
                    options = [(row[k - 1].get(j), more), (row[k - 1].get(j - 1), CHANGED), (now[k - 1].get(j - 1), DROPPED)]
                    if j > 1 and i > 1 and t == entry[j - 2] and typed[i - 2] == entry[j - 1]:
                        options.append((before[k - 1].get(j - 2), SWAPPED))
                    for at, weight in options:
                        if at is not None and (best is None or at + weight < best):
                            best = at + weight
                if best is not None:
                    cells[j] = best
            now.append(cells)
        before, row = row, now
    found = [c[m] for c in row if m in c]
    return round(min(found), 9) if found else None


def deletions(s: str, most: int = 1) -> set[str]:
    """What is left of a writing when up to ``most`` of its letters go; at least one goes."""
    one = {s[:i] + s[i + 1 :] for i in range(len(s))}
    return one if most == 1 else one.union(*(deletions(x, most - 1) for x in one)) if one else one


_DIGITS = re.compile("[0-9]")
Span = tuple[int, float, int, int, int, int]


class Dictionary:
    """Writings of the entries with their deletions; made once a task from the broadcast rows.

    ``aliases`` are (alias, typed value), or with ``resolved`` (alias, typed value, entry).
    """

    KINDS = ("latin", "hangul", "jamo", "sound", "two")
    #: Letters at the ends of a writing, less than half of the shortest (4 syllables are 8 letters and more): one edit
    #: leaves them as they are at one end at least.
    ENDS = {"latin": LATIN_LEAST // 2 - 1, "hangul": HANGUL_LEAST // 2 - 1, "jamo": HANGUL_LEAST - 1, "sound": SOUND_LEAST // 2 - 1}

    def __init__(self, entries: list[tuple[int, str]], aliases: list[tuple], resolved: bool = False):
        self.exact: dict[str, int] = {}
        self.sounds: dict[str, int] = {}
        #: Deletion -> numbers of the writings that it is left of.
        self.deleted: dict[str, dict[int, list[int]]] = {k: {} for k in self.KINDS}
        self.keys: dict[str, list[str]] = {k: [] for k in self.KINDS}
        self.owner: dict[str, dict[str, int]] = {k: {} for k in self.KINDS}
        self.longest: dict[str, int] = dict.fromkeys(self.KINDS, 0)
        #: First and last letters of the writings, ENDS of them.
        self.heads: dict[str, set[str]] = {k: set() for k in self.KINDS}
        self.tails: dict[str, set[str]] = {k: set() for k in self.KINDS}
        self.frequency: Counter[int] = Counter()
        self.cache: dict[str, tuple[int, float] | None] = {}
        self.spans: dict[str, tuple[int, float] | None] = {}
        self.texts: dict[str, list[int]] = {}
        self.odd: dict[str, int] = {}
        self.words = {}
        self.syllables: frozenset[str] = frozenset()
        self.all_sounds = ""
        self.said: dict[str, bool] = {}
        for i, name in sorted(entries):
            if key := writing(plain(name)):
                self.exact.setdefault(key, i)
                self.frequency[i] += 1
                self._fuzzy(key, i)
                sound = phonetic(key)
                self._keep("sound", sound, i, SOUND_LEAST)
                self.sounds.setdefault(sound, i)
        texts = [t for a in aliases for t in a[:2] if t] + [n for _, n in entries]
        #: The most words that a name is looked for in: those of the list's own names, and one that is typed apart.
        self.most_words = max([4, *(len(TOKEN.findall(plain(t))) + 1 for t in texts)])
        #: Hangul syllables of the list's own writings and of letter names, and the sounds of all entries in one text.
        self.syllables = frozenset(c for t in [*texts, *LETTER_NAMES, "플러스샵샤프"] for c in plain(t) if "가" <= c <= "힣")
        self.all_sounds = "|".join(sorted(self.sounds))
        #: Hangul spellings of the last words of entries (as in "... Boot"), learned from the aliases.
        self.words: dict[str, str] = {}
        self._learn_words(entries, [a[:2] for a in aliases])
        if resolved:
            meant = [(a[0], a[2]) for a in sorted(aliases, key=lambda r: r[0])]
        else:
            # an alias that is itself a writing of an entry means that entry, whatever its row says
            own = {a: self.lookup(writing(plain(a))) for a, _ in aliases if a}
            meant = [(a, own[a][0] if own[a] is not None and own[a][1] == 0 else self.value(s) if s is not None else None) for a, s in sorted(aliases, key=lambda r: r[0] or "") if a]
        for a, i in meant:
            if i is not None and i != NO_ENTRY:
                self.frequency[i] += 1
                key = writing(plain(a))
                if key and key not in self.exact:
                    self.exact[key] = i
                    self._fuzzy(key, i)
        for known in (self.cache, self.said, self.spans, self.texts, self.odd):
            known.clear()

    def _learn_words(self, entries: list[tuple[int, str]], aliases: list[tuple[str, str | None]]) -> None:
        """Where a Hangul alias sounds like the first words of its entry, the rest spells the last word."""
        last = {writing(plain(n)): writing(plain(n).split()[-1]) for _, n in entries if len(plain(n).split()) > 1}
        seen: Counter[tuple[str, str]] = Counter()
        for alias, value in aliases:
            entry = writing(plain(value)) if value else ""
            key = writing(plain(alias)) if alias else ""
            if entry in last and re.fullmatch("[가-힣]+", key):
                first = phonetic(entry[: -len(last[entry])])
                for k in range(2, len(key)):
                    if phonetic(key[:k]) == first and "가" <= key[k] <= "힣":
                        seen[key[k:], last[entry]] += 1
        for (h, w), _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            if not any(h != o and h.endswith(o) and w == self.words[o] for o in self.words):
                self.words.setdefault(h, w)

    def _variants(self, key: str) -> list[str]:
        """A Hangul key with its last word or letters in Latin writing, then as it is."""
        return [key[: -len(h)] + w for h, w in self.words.items() if key.endswith(h) and len(key) > len(h) + 1] + spelled_letters(key) + [key]

    def _keep(self, kind: str, key: str, i: int, least: int, edits: int = 1) -> None:
        if len(key) >= least and key not in self.owner[kind]:
            self.owner[kind][key] = i
            self.longest[kind] = max(self.longest[kind], len(key))
            if h := self.ENDS.get(kind):
                self.heads[kind].add(key[:h])
                self.tails[kind].add(key[-h:])
            number = len(self.keys[kind])
            self.keys[kind].append(key)
            for d in deletions(key, edits) | {key}:
                self.deleted[kind].setdefault(hash(d), []).append(number)

    def _fuzzy(self, key: str, i: int) -> None:
        if re.search("[가-힣]", key):
            if len(key) >= HANGUL_LEAST:
                self._keep("hangul", key, i, HANGUL_LEAST)
                self._keep("jamo", jamo(key), i, 1)
        else:
            self._keep("latin", key, i, LATIN_LEAST)
            self._keep("two", key, i, LATIN_TWO, 2)

    def _sayable(self, ch: str) -> bool:
        """Whether a Hangul syllable's sound stands in some name of the list, or spells a letter or a last word."""
        known = self.said.get(ch)
        if known is None:
            sound = phonetic(ch)
            known = ch in self.syllables or sound in self.all_sounds or sound.endswith("ng") and sound[:-1] in self.all_sounds
            self.said[ch] = known
        return known

    def _near(self, kind: str, key: str, edits: int = 1) -> list[tuple[float, int, int]]:
        """(weight, -frequency, entry) of the entries at most so many edits away."""
        if len(key) > self.longest[kind] + edits:  # nothing of the list is near
            return []
        if (h := self.ENDS.get(kind)) and key[:h] not in self.heads[kind] and key[-h:] not in self.tails[kind]:
            return []
        get, found = self.deleted[kind].get, set()
        for d in deletions(key, edits) | {key}:
            if (numbers := get(hash(d))) is not None:
                found.update(numbers)
        out = []
        for number in found:
            k = self.keys[kind][number]
            w = weighted_edit(key, k, edits)
            if w is None or kind == "hangul" and w == CHANGED:  # a changed syllable counts by its letters only
                continue
            if edits > 1 and _DIGITS.findall(key) != _DIGITS.findall(k):  # a number is no misspelt word
                continue
            if kind == "sound" and len(key) != len(k) and (key.startswith(k) or k.startswith(key)):  # a last sound may be another word's
                continue
            i = self.owner[kind][k]
            out.append((w, -self.frequency[i], i))
        return out

    def _foreign(self, word: str) -> tuple[int, int]:
        """How many Hangul syllables of a word no name of the list has, in all and without a particle at its end."""
        n = self.odd.get(word)
        if n is None:
            strange = [not self._sayable(c) if "가" <= c <= "힣" else False for c in word]
            n = sum(strange), min([sum(strange), *(sum(strange[: -len(p)]) for p in PARTICLES if word.endswith(p))])
            if len(self.odd) < 200_000:
                self.odd[word] = n
        return n

    def lookup(self, key: str) -> tuple[int, float] | None:
        """(entry, weight) of a writing; None if it means no entry."""
        if not key:
            return None
        if (i := self.exact.get(key)) is not None:
            return i, 0.0
        if key in self.cache:
            return self.cache[key]
        found: list[tuple[float, int, int]] = []
        hangul = any("가" <= c <= "힣" for c in key)
        # no sound of the list has a syllable that none of its names has; an edit spoils two at most
        foreign = sum(not self._sayable(c) for c in key if "가" <= c <= "힣") if hangul else 0
        if foreign > 2:
            return None
        if hangul and len(key) >= HANGUL_LEAST:
            said = [phonetic(other) for other in self._variants(key)]
            for s in said if foreign == 0 else ():
                if (i := self.sounds.get(s)) is not None and len(s) >= 5:
                    found.append((0.05, -self.frequency[i], i))
            if not found:
                found = self._near("hangul", key) + self._near("jamo", jamo(key))
            if not found:
                for s in said:
                    if len(s) >= SOUND_LEAST:
                        found += [(w + BY_SOUND, f, i) for w, f, i in self._near("sound", s)]
        elif not hangul and len(key) >= LATIN_LEAST:
            found = self._near("latin", key)
            if not found and len(key) >= LATIN_TWO - 2:
                found = [(w + BY_TWO, f, i) for w, f, i in self._near("two", key, 2)]
        best = min(found) if found else None
        result = (best[2], best[0]) if best else None
        if len(self.cache) < 200_000:
            self.cache[key] = result
        return result

    def _span(self, key: str) -> tuple[int, float] | None:
        if key in self.spans:
            return self.spans[key]
        got = self._find(key)
        if len(self.spans) < 400_000:
            self.spans[key] = got
        return got

    def _find(self, key: str) -> tuple[int, float] | None:
        if (got := self.lookup(key)) is not None:
            return got
        if key.endswith(PARTICLES):
            for p in PARTICLES:
                if key.endswith(p) and len(key) > len(p) + 1 and (got := self.lookup(key[: -len(p)])) is not None:
                    return got[0], got[1] + 0.01
        return None

    def candidates(self, text: str) -> list[Span]:
        """(-length, weight, -frequency, first word, last word, entry) of every run of words that names an entry."""
        s = VERSION.sub(" ", plain(text))
        tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(s)]
        n = len(tokens)
        odd = [self._foreign(t) if "가" <= t[0] else NONE_FOREIGN for t, _, _ in tokens]
        out: list[Span] = []
        for i in range(n):
            key, foreign = "", 0
            for j in range(i, min(n, i + self.most_words)):
                if j > i:
                    between = s[tokens[j - 1][2] : tokens[j][1]]
                    if between not in JOIN and not (tokens[j][0] == "++" and not between):
                        break
                whole, bare = odd[j]
                if foreign + bare > 2:  # a longer run has no fewer
                    break
                key += tokens[j][0]
                foreign += whole
                if (got := self._span(key)) is not None:
                    out.append((-len(key), got[1], -self.frequency[got[0]], i, j, got[0]))
        return out

    def scan(self, text: str) -> list[int]:
        """The entries that a text names: the longest names first, none inside another."""
        if text in self.texts:
            return self.texts[text]
        out = claimed(self.candidates(text))
        if len(self.texts) < 100_000 and len(text) < 400:
            self.texts[text] = out
        return out

    def value(self, text: str) -> int:
        """The entry that a whole value means, NO_ENTRY if none."""
        s = VERSION.sub(" ", plain(text))
        if (got := self.lookup(writing(s))) is not None:
            return got[0]
        found = self.scan(text)
        return found[0] if len(set(found)) == 1 else NO_ENTRY


NONE_FOREIGN = 0, 0


def claimed(spans: list[Span]) -> list[int]:
    """The entries of spans: the longest first, then the nearest, none over another; of one span the nearest entry."""
    spans = sorted(spans)
    # a longer span by one slip must not swallow a word that the exact name inside it leaves out
    exact = {(i, j): e for _, w, _, i, j, e in reversed(spans) if w <= 0.01}
    taken: list[tuple[int, int]] = []
    out: list[int] = []
    for _, w, _, i, j, e in spans:
        if w > 0.05 and any(i <= a and b <= j and (a, b) != (i, j) and (x == e or w > BY_TWO) for (a, b), x in exact.items()):
            continue
        if all(j < a or i > b for a, b in taken):
            taken.append((i, j))
            out.append(e)
    return out


_made: dict[str, Dictionary] = {}


def made(name: str, rows: tuple) -> Dictionary:
    """This process's dictionary of a run; what it found before serves the next task."""
    if name not in _made:
        _made.clear()
        _made[name] = Dictionary(*rows)
    return _made[name]


#: What a part of a dictionary finds in a text: its best entry for the whole of it, and its spans.
FOUND = "whole struct<w:double,f:int,e:bigint>, spans array<struct<l:int,w:double,f:int,i:int,j:int,e:bigint>>"


def in_parts(texts: DataFrame, parts: list[tuple[list, list]], exact: bool = False) -> DataFrame:
    """(id, entry) of texts (id, text, value): the entries that all parts of a dictionary together find.

    A value means one entry or NO_ENTRY; another text names any number. With ``exact`` only
    entries that the whole text writes out are taken.
    """
    spark = texts.sparkSession
    kind = texts.schema["id"].dataType.simpleString()
    out = None
    for rows in parts:
        shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex  # of bounded size

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
            d = made(name, (*shared.value, True))
            for b in batches:
                whole, spans = [], []
                for t, value in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    got = d.lookup(writing(VERSION.sub(" ", plain(t)))) if value else None
                    whole.append(None if got is None else {"w": got[1], "f": -d.frequency[got[0]], "e": got[0]})
                    spans.append([dict(zip("lwfije", x)) for x in d.candidates(t)])
                types = pa.struct([("w", pa.float64()), ("f", pa.int32()), ("e", pa.int64())]), pa.list_(pa.struct([("l", pa.int32()), ("w", pa.float64()), ("f", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*b.columns[:1], b.column(2), pa.array(whole, types[0]), pa.array(spans, types[1])], names=["id", "value", "whole", "spans"])

        part = texts.select("id", "text", "value").mapInArrow(find, f"id {kind}, value boolean, {FOUND}")
        out = part if out is None else out.unionByName(part)
    together = out.groupBy("id").agg(F.max("value").alias("value"), F.min("whole").alias("whole"), F.flatten(F.collect_list("spans")).alias("spans"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, entries = [], []
            for k, (value, whole, spans) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                named = claimed([tuple(x[c] for c in "lwfije") for x in spans])
                if exact:
                    named = [whole["e"]] if whole is not None and whole["w"] == 0 else []
                elif value:
                    named = [whole["e"]] if whole is not None else named[:1] if len(set(named)) == 1 else [NO_ENTRY]
                named = sorted(set(named))
                rows += [k] * len(named)
                entries += named
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(entries, pa.int64())], names=["id", "entry"])

    return together.mapInArrow(take, f"id {kind}, entry bigint")


def _split(rows: DataFrame, key: str, parts: int) -> Iterator[list[tuple]]:
    """The rows in lists of bounded size, one for each part by the key's hash."""
    placed = materialise(rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "canon-rows")
    for p in range(parts):
        # half the bound on average; the rows of a key that has more stay together
        yield [tuple(r) for r in placed.where(F.col("_part") == p).drop("_part").collect()]


def _meant_in_parts(entries: DataFrame, alias: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(id, entry) of texts, for a dictionary of ``n`` rows, more than a task holds."""
    parts = 2 * -(-n // DICTIONARY_ROWS)
    of_entries = list(_split(entries, "skill_id", parts))
    named = alias.where("alias is not null and alias != ''").select("alias", "skill").distinct()
    bare = [(e, []) for e in of_entries]
    # what an alias means: the entry that it writes out itself, else what its value means
    own = in_parts(named.select(F.col("alias").alias("id"), F.col("alias").alias("text"), F.lit(True).alias("value")).distinct(), bare, exact=True)
    values = in_parts(named.where("skill is not null").select(F.col("skill").alias("id"), F.col("skill").alias("text"), F.lit(True).alias("value")).distinct(), bare)
    meant = (
        named.join(own.select(F.col("id").alias("alias"), F.col("entry").alias("own")), "alias", "left").join(values.select(F.col("id").alias("skill"), F.col("entry").alias("by_value")), "skill", "left")
        .select("alias", "skill", F.coalesce("own", "by_value").alias("skill_id")).where(F.col("skill_id") != NO_ENTRY)
    )
    of_aliases = list(_split(meant, "skill_id", parts))
    return in_parts(texts, list(zip(of_entries, of_aliases)))


def meant_entries(skill: DataFrame, alias: DataFrame, documents: DataFrame) -> DataFrame:
    """(field, row_key, skill_id): what alias values and document lists name.

    A null alias value is no case; one that names no entry, empty ones included, has -1. Null
    lists and elements name nothing; an entry comes out once a list however often it is named;
    ties go to the entry that the list refers to more often, then to the smaller id.
    """
    spark = skill.sparkSession
    entries = skill.where("skill_id is not null and name is not null").select("skill_id", "name")
    n = entries.count() + alias.count()
    if n > DICTIONARY_ROWS:
        key = lambda field, k, no: F.struct(F.lit(field).alias("field"), F.col(k).cast("bigint").alias("row_key"), no.alias("no")).alias("id")
        texts = alias.where("alias_id is not null and skill is not null").select(key("alias", "alias_id", F.xxhash64("skill")), F.col("skill").alias("text"), F.lit(True).alias("value"))
        for field in ("required", "preferred"):
            of = documents.where("raw_id is not null").select("raw_id", F.explode(field).alias("text")).where("text is not null and text != ''")
            texts = texts.unionByName(of.select(key(field, "raw_id", F.xxhash64("text")), "text", F.lit(False).alias("value")).distinct())
        found = _meant_in_parts(entries, alias, texts, n)
        return found.select("id.field", "id.row_key", F.col("entry").alias("skill_id")).where(F.col("field") == "alias").unionByName(found.select("id.field", "id.row_key", F.col("entry").alias("skill_id")).where(F.col("field") != "alias").distinct())
    shared = spark.sparkContext.broadcast(([tuple(r) for r in entries.collect()], [tuple(r) for r in alias.select("alias", "skill").collect()]))

    name = uuid.uuid4().hex

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = made(name, shared.value)
        for b in batches:
            found = [d.value(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["alias"] * b.num_rows, pa.string()), b.column(0), pa.array(found, pa.int64())], names=["field", "row_key", "skill_id"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = made(name, shared.value)
        for b in batches:
            fields, keys, ids = [], [], []
            raw = b.column(0).to_pylist()
            for c, field in ((1, "required"), (2, "preferred")):
                for key, texts in zip(raw, b.column(c).to_pylist()):
                    named = {e for t in texts or () if t for e in d.scan(t)}
                    fields += [field] * len(named)
                    keys += [key] * len(named)
                    ids += sorted(named)
            yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["field", "row_key", "skill_id"])

    schema = "field string, row_key bigint, skill_id bigint"
    of_alias = alias.select(F.col("alias_id").cast("bigint").alias("k"), "skill").where("skill is not null and k is not null").mapInArrow(values, schema)
    of_lists = spread(documents.select(F.col("raw_id").cast("bigint").alias("k"), "required", "preferred").where("k is not null")).mapInArrow(lists, schema)
    return of_alias.unionByName(of_lists)
