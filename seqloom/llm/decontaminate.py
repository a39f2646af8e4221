"""Benchmark decontamination with one automaton over the words of all test items.

Texts and items are normalised alike: A-Z lower-cased, words are runs of digits, letters and
non-ASCII characters. Every window of ``size`` consecutive words of an item is a pattern; an item with
fewer words is one pattern. The words of all items are numbered, and the automaton walks word numbers, in two digits each, so that
no node has many children; a word that no item has leads back to its root. Each document is read once; hits are reported
as character spans of the original text.

The automaton is made once, on the driver, and broadcast. It has up to twice ``size`` nodes of 40 bytes for each word of the
items, in every Python worker: 0.8 MB for each thousand words. ``max_words`` bounds that. A larger table is dealt to several
automata, each collected, shared and scanned for by itself with a table written in between, so that no more than one is in
memory at a time; the result is the same.

Defined results: a null or empty text has no words and no hits; a null or wordless item has no window;
repeated items count once per item_id, a null item_id marks words but is not listed. Repeated and
null doc_ids are ordinary rows. Texts of any length are read whole. Empty tables give empty results or no hits. Input columns
named like a result column are replaced; columns of other names pass through.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from array import array
from functools import lru_cache
from itertools import repeat

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import durable, map_text, unused

#: Bytes of words stay (A-Z lower-cased); all others become a space.
TO_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: The digits of word numbers; a first digit is never a second one. No item has the word of number 0.
BASE = 256
UNKNOWN = "\x00"
#: Words of items in one automaton, of 200 MB at most then.
MAX_WORDS = 250_000
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def _digits(n: int, width: int) -> str:
    """A word number as letters: the first up to BASE, further ones over it."""
    out = ""
    for _ in range(width - 1):
        n, low = divmod(n, BASE)
        out = chr(BASE + 1 + low) + out
    return chr(n + 1) + out


class Matcher:
    """The automaton: a text's words in, ranges of hit words and items out."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        ordered: dict[bytes, int] = {}
        texts = [(item, words_of(text)) for item, text in items]
        for _, words in texts:
            for w in words:
                ordered.setdefault(w, len(ordered))
        width = 2
        while BASE**width < len(ordered):
            width += 1
        self.width = width
        self.numbers = {w: _digits(n, width) for w, n in ordered.items()}
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        #: Of each pattern, its words and its items.
        self.lengths, self.items = array("l"), []
        places: dict[str, int] = {}
        for item, words in texts:
            digits = [self.numbers[w] for w in words]
            for at in range(max(1, len(digits) - size + 1) if digits else 0):
                window = digits[at : at + size]
                place = places.setdefault("".join(window), len(places))
                if place == len(self.items):
                    self.lengths.append(len(window))
                    self.items.append(())
                if item is not None and number[item] not in self.items[place]:
                    self.items[place] += (number[item],)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for window, place in places.items():
            self.automaton.add_word(window, place)
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Merged ranges of hit words, ends exclusive, and the items found."""
        ranges: list[list[int]] = []
        if self.empty or not words:
            return ranges, []
        found: set[int] = set()
        digits = "".join(map(self.numbers.get, words, repeat(UNKNOWN * self.width)))
        for last, place in self.automaton.iter(digits):
            end = (last + 1) // self.width
            start = end - self.lengths[place]
            while ranges and start <= ranges[-1][0]:
                ranges.pop()
            if ranges and start <= ranges[-1][1]:
                ranges[-1][1] = end
            else:
                ranges.append([start, end])
            found.update(self.items[place])
        return ranges, sorted(self.names[k] for k in found)


@lru_cache(1)
def _loaded(name: str, shared) -> Matcher:
    """The matcher of a broadcast, once for each Python worker."""
    return pickle.loads(shared.value)


class _Shared:
    """A broadcast that is its content's name for the cache."""

    def __init__(self, broadcast, name: str) -> None:
        self.broadcast, self.name = broadcast, name

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shared) and self.name == other.name

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _scan(docs: DataFrame, items: list[tuple], size: int, text: str) -> DataFrame:
    data = pickle.dumps(Matcher(items, size))
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(data), hashlib.sha1(data).hexdigest())

    def factory():
        matcher = _loaded(shared.name, shared)

        def one(t: str | None) -> tuple:
            words = words_of(t)
            ranges, found = matcher.scan(words)
            spans = []
            if ranges:
                at = [m.span() for m in WORD.finditer(t)]
                spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]
            return len(words), sum(b - a for a, b in ranges), spans, found

        return one

    return map_text(docs, factory, FIELDS, text)


def _joined(docs: DataFrame, old: tuple[str, str], text: str) -> DataFrame:
    """Join the spans and items of one automaton with those found before, and count the hit words again."""

    def factory():
        def one(t: str | None, spans: list, items: list, before: list, found: list, n: int) -> tuple:
            out: list[dict] = []
            for s in sorted([*spans, *before], key=lambda s: (s["start"], s["end"])):
                if out and s["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], s["end"])
                else:
                    out.append(dict(s))
            # Ranges that touch without sharing a word are two words' ranges beside each other: words are counted, not letters.
            return n, sum(len(WORD.findall(t[s["start"] : s["end"]])) for s in out), out, sorted({*items, *found})

        return one

    made = [f.name for f in FIELDS]
    return map_text(docs, factory, FIELDS, text, "spans", "items", *old, "n_words").select(*[c for c in docs.columns if c not in old and c not in made], *made)


def find_contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", max_words: int = MAX_WORDS,
) -> DataFrame:
    """Add n_words, n_hit, spans (of the original text) and items (found item_ids, sorted) to every document.

    The words of the item table are counted first, no more than max_words (on average of the parts) are in one automaton.
    """
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = items.agg(F.sum(F.regexp_count(F.coalesce("t", F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    parts = max(1, math.ceil(total / max_words))
    out = docs
    for b in range(parts):
        block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == b)
        rows = sorted((tuple(r) for r in block.distinct().collect()), key=lambda r: (r[0] or "", r[1] or ""))
        if b == 0:
            out = _scan(out, rows, size, text)
            continue
        before = durable(out, "contamination")
        old = tuple(unused(before, "_spans", "_items"))
        out = _joined(_scan(before.withColumnsRenamed(dict(zip(("spans", "items"), old, strict=True))), rows, size, text), old, text)
    return out
