"""BPE encoding and decoding as streaming transducers with bounded memory.

The merge list bounds how far to the left an unseen continuation can change a tokenisation: the
sufficient lookahead. A word is read piece by piece; tokens that end further than that from the end
of what has been read are final and are emitted, the rest waits. So a word of any length needs a buffer
of fixed size. A text is read in pieces as well: what normalisation, letter case and word bounds need of the next piece is held
back (a few letters; of combining marks, all in a row). Decoding maps ids to bytes, and bytes to text with a state
machine that holds back an unfinished character only; round_trip hashes both streams as they come.

Besides the text itself a worker holds one piece of PIECE_CHARS letters with its ids, the buffers, the vocabulary, and two generations of up
to CACHED words of up to LONGEST_CACHED letters with their ids: some 120 MB. The cache saves merging, and every word in it came from the transducer.

The vocabulary is a file of the tokenizers format with a BPE model, word-end suffix, byte alphabet, and
normalisation by NFC, white space and lower case. Its path is a parameter. The word pattern of its library knows the letters of Unicode 15.1;
letters that later versions added are signs to it, while its lower case knows them. Both are pinned here, whichever version this Python has.

Defined results: a null text is empty and has no tokens; texts that contain a special token's own text get
its id, as that format prescribes. Repeated rows are encoded alike; an empty table gives an empty result.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from os.path import commonprefix

import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqloom.llm.common import map_text
from seqloom.shipping import ship

#: White space of the format's pattern language that Python's split does not share.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: White space of that language, and the length of the longest word that begins with a mark and has letters.
WHITE = tuple(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LONGEST_MARK = 3
#: Ranges with letters or digits that Unicode got after version 15.1, as code points in hexadecimal.
LATER = (
    "558 58B-58C 88F C5C CDC 1C89 208F 209D-209F A7CB-A7CC A7CE-A7CF A7D2 A7D4 A7DA A7DC-A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10D50-10D65 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Lower case of capital letters that Unicode got after version 15.1, as ranges and the first small letter.
LATER_LOWER = "1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"
#: All letters below are known to every version.
FIRST_LATER = "\u0558"
#: Words, and runs without white space, kept with their ids, in each of two generations.
CACHED = 300_000
LONGEST_CACHED = 64
#: Letters of a text read at a time.
PIECE_CHARS = 1 << 16
PIECE = 256
#: Lists of symbols up to this length are merged by scanning.
SHORT = 48
ENCODED = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def later_lower() -> dict[int, int]:
    out = {}
    for entry in LATER_LOWER.split():
        capital, small = entry.split(">")
        low, _, high = capital.partition("-")
        for k, c in enumerate(range(int(low, 16), int(high or low, 16) + 1)):
            out[c] = int(small, 16) + k
    return out


def pinned(pattern: str) -> str:
    """A word pattern whose letter and digit classes leave out what LATER lists."""
    ranges = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in LATER.split())
    for kind in ("L", "N"):
        inside, outside = rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{ranges}]]"
        pattern = pattern.replace(inside, outside)
    return pattern


class Vocabulary:
    """What a tokenizer file holds, in the form that both transducers use."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        split = data["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(pinned(split["pattern"]["Regex"]), regex.V1)
        self.old_words = regex.compile(split["pattern"]["Regex"], regex.V1)
        self.letters = byte_letters()
        self.longest = max(map(len, self.ids))

    @cached_property
    def lookahead(self) -> int:
        """How many letters before the end of a prefix a continuation can still move a token boundary.

        A boundary moves left only by a merge (x, u) whose right part begins there; the next move needs a later merge
        whose right part begins with x. The longest such chain of merges, in letters of their left parts, is the bound.
        """
        left = {a + b: a for a, b in self.ranks}
        reach: dict[str, int] = {}
        longest = 0
        for (a, b), _ in sorted(self.ranks.items(), key=lambda x: -x[1]):
            chain = len(a) + reach.get(a, 0)
            longest = max(longest, chain)
            spine = b
            while spine:
                reach[spine] = max(reach.get(spine, 0), chain)
                spine = left.get(spine, "")
        return longest + self.longest

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges to a list of symbols, lowest rank first, leftmost first: short lists by scanning, long ones by a queue."""
        if len(symbols) <= SHORT:
            return self.merge_short(symbols)
        ranks, parts = self.ranks, list(symbols)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(p)) is not None]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heappush(queue, (r, h))
        return [p for p in parts if p]


    def merge_short(self, symbols: list[str]) -> list[str]:
        """The same by scanning; the list itself changes."""
        rank, none = self.ranks.get, len(self.ranks)
        parts = symbols
        found = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while found and (low := min(found)) < none:
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                found[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts


class WordEncoder:
    """Transducer for one word: push letters, get ids that are final; finish for the rest."""

    def __init__(self, vocabulary: Vocabulary, piece: int = PIECE) -> None:
        # A piece shorter than a token might never let one go.
        self.v, self.piece = vocabulary, max(piece, vocabulary.longest)
        self.most = vocabulary.lookahead + self.piece
        self.held: list[str] = []

    def push(self, letters: Iterable[str]) -> list[int]:
        """The ids that are final; what it holds is bounded by the lookahead and a piece."""
        self.held += letters
        out: list[int] = []
        # The last letter may be the word's last one, so it is no part of the prefix yet.
        while len(self.held) > self.most:
            part, rest = self.held[: self.most], self.held[self.most :]
            at = 0
            for token in self.v.merge(part):
                if at + len(token) > self.piece:
                    break
                at += len(token)
                out.append(self.v.ids[token])
            self.held = part[at:] + rest
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, []
        if not held:
            return []
        held[-1] += self.v.suffix
        return list(map(self.v.ids.__getitem__, self.v.merge(held)))


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Characters that normalisation may join with or move before what stands ahead of them."""
    second = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    first_of = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x30000))):
        if parts := unicodedata.decomposition(c):
            if parts[0] != "<" and len(parts.split()) == 2:
                second.add(chr(int(parts.split()[1], 16)))
            first_of[c] = unicodedata.normalize("NFD", c)[0]
    return frozenset(second | {c for c, f in first_of.items() if f in second or unicodedata.combining(f)})


def _safe_cut(text: str, low: int, high: int) -> int:
    """The last place after low, up to high, before which a text may be cut for normalisation; low if there is none."""
    at = high
    while at > low:
        c = text[at] if at < len(text) else "a"
        if c < "\x80" or not unicodedata.combining(c) and c not in _joining():
            return at
        at -= 1
    return low


class Encoder:
    """Texts to ids, piece by piece. Words are remembered in two generations of bounded size."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.word = WordEncoder(vocabulary)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        marks = "|".join(regex.escape(s) for s in sorted(self.v.special, key=len, reverse=True))
        self.marks = regex.compile(marks) if marks else None
        self.mark_begin = commonprefix(list(self.v.special))
        self.odd = regex.compile(f"[{SEPARATORS}]")
        self.later = re.compile("[" + "".join(map(chr, later_lower())) + "]")
        #: Whether this Python's letters are no later than the library's.
        self.old_python = tuple(map(int, unicodedata.unidata_version.split("."))) < (16,)
        #: The rest of a word of letters or of signs; open is that of the word which the transducer has part of.
        self.letters = regex.compile(pinned(r"[\p{L}]*"), regex.V1)
        self.signs = regex.compile(pinned(r"[^\s\p{L}\p{N}]*"), regex.V1)
        self.open: regex.Pattern | None = None

    def _letters(self, word: str) -> list[str]:
        return list(word) if word.isascii() and word.isalpha() else [self.v.letters[b] for b in word.encode()]

    def _encoded(self, word: str) -> bytes:
        """A whole word through the transducer."""
        return self._more(word) + array("I", self.word.finish()).tobytes()

    def _split(self, chunk: str) -> bytes:
        if chunk.isalpha() and (self.old_python or chunk.isascii()):
            return self._encoded(chunk)
        words = (self.v.old_words if max(chunk) < FIRST_LATER else self.v.words).findall(chunk)
        return self._encoded(chunk) if len(words) == 1 and words[0] == chunk else b"".join(map(self.chunk, words))

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        found = self.new.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = self._split(chunk)
            if len(chunk) <= LONGEST_CACHED:
                if len(self.new) >= CACHED:
                    self.old, self.new = self.new, {}
                self.new[chunk] = found
        return found

    def _whole(self, text: str) -> bytes:
        """Ids of normalised text that ends where a word ends."""
        chunks = self.v.words.findall(text) if self.odd.search(text) else text.split()
        get, chunk = self.new.get, self.chunk
        return b"".join([get(c) or chunk(c) for c in chunks])

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case goes letter by letter: no final sigma.
        text = text.replace("Σ", "σ")
        if self.later.search(text):
            text = text.translate(later_lower())
        return text.lower()

    def _pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a text without special tokens. ``held`` is normalised text whose last word may go on in the next piece."""
        at, held = 0, ""
        while at < len(text):
            end = min(at + PIECE_CHARS, len(text))
            while end < len(text) and (cut := _safe_cut(text, at, end)) == at:
                end = min(end + PIECE_CHARS, len(text))
            end = cut if end < len(text) else end
            held += self._normal(text[at:end])
            at = end
            if at < len(text):
                held = yield from self._begun(held)
        if self.open:
            end = self.open.match(held).end()
            yield self._last(held[:end])
            held = held[end:]
        yield self._whole(held)

    def _begun(self, held: str) -> Iterator[bytes]:
        """Emit the words that are whole, and of a long unfinished one the part that is final; returns what is left."""
        if self.open:
            end = self.open.match(held).end()
            if end == len(held):
                yield self._more(held)
                return ""
            yield self._last(held[:end])
            held = held[end:]
        # Up to the last white space all words are whole; a run without any is read word by word.
        last = max(map(held.rfind, WHITE))
        if last >= 0:
            yield self._whole(held[:last])
            held = held[last + 1 :]
        if len(held) <= PIECE_CHARS:
            return held
        low = 0
        while (m := self.v.words.match(held, low)) and m.end() + LONGEST_MARK < len(held):
            yield self.chunk(m[0])
            low = m.end()
        held = held[low:]
        if len(held) > LONGEST_CACHED:  # one word, of letters or of signs, that has not ended
            self.open = self.letters if self.letters.match(held).end() else self.signs
            yield self._more(held)
            return ""
        return held

    def _more(self, part: str) -> bytes:
        """Final ids after some more letters of the open word."""
        if len(part) <= PIECE:
            return array("I", self.word.push(self._letters(part))).tobytes()
        ids = array("I")
        for at in range(0, len(part), PIECE):
            ids.extend(self.word.push(self._letters(part[at : at + PIECE])))
        return ids.tobytes()

    def _last(self, part: str) -> bytes:
        """The rest of the open word's ids."""
        out = self._more(part)
        self.open = None
        return out + array("I", self.word.finish()).tobytes()

    def stream(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece."""
        text = text or ""
        self.open, self.word.held = None, []
        if self.marks is None or self.mark_begin not in text:
            yield from self._pieces(text)
            return
        at = 0
        for m in self.marks.finditer(text):
            yield from self._pieces(text[at : m.start()])
            yield self.v.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._pieces(text[at:])

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))


class Decoder:
    """Ids to text, piece by piece: ids to bytes, and a state machine from bytes to text that holds back an unfinished character.

    names: the form that the library gives for files without a decoder, token names with a space between; else the text itself, in which a
    word's end is a space and broken bytes become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary, names: bool = False) -> None:
        self.v, self.between = vocabulary, b" " if names else b""
        byte = {c: b for b, c in enumerate(vocabulary.letters)}
        self.bytes = [b""] * (max(vocabulary.tokens, default=0) + 1)
        for i, name in vocabulary.tokens.items():
            if names or name in vocabulary.special:
                self.bytes[i] = name.encode()
            else:
                ends = bool(vocabulary.suffix) and name.endswith(vocabulary.suffix)
                name = name[: -len(vocabulary.suffix)] if ends else name
                self.bytes[i] = bytes(byte[c] for c in name) + b" " * ends
        self.reset()

    def reset(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, ids: Iterable[int]) -> str:
        """The text that is complete after these ids."""
        data = self.between.join(map(self.bytes.__getitem__, ids))
        if not data and not self.between:
            return ""
        out = self.state.decode(self.between + data if self.begun else data)
        self.begun = True
        return out

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.reset()
        return out

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are complete."""
        for i in ids:
            if out := self.push((i,)):
                yield out
        if out := self.finish():
            yield out


@lru_cache(2)
def vocabulary_at(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def encoder_at(path: str) -> Encoder:
    return Encoder(vocabulary_at(path))


@lru_cache(4)
def decoder_at(path: str, names: bool) -> Decoder:
    return Decoder(vocabulary_at(path), names)


def _shared(docs: DataFrame, path: str) -> str:
    """Give the vocabulary file to the executors; returns its name there."""
    ship(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ids (little-endian unsigned 32-bit integers) and n_tokens."""
    name = _shared(docs, path)

    def factory():
        encoder = encoder_at(SparkFiles.get(name))

        def one(t: str | None) -> tuple:
            ids = encoder(t)
            return ids, len(ids) // 4

        return one

    return map_text(docs, factory, ENCODED, text)


def _text(decoder: Decoder, pieces: Iterable[bytes]) -> Iterator[str]:
    for p in pieces:
        if p:
            yield decoder.push(memoryview(p).cast("I"))
    yield decoder.finish()


def decode(docs: DataFrame, path: str, ids: str = "ids", names: bool = False) -> DataFrame:
    """Add decoded: the text of the ids, or their token names with a space between. Null ids give an empty text."""
    name = _shared(docs, path)

    def factory():
        decoder = decoder_at(SparkFiles.get(name), names)
        return lambda b: ("".join(_text(decoder, (b or b"",))),)

    return map_text(docs, factory, [T.StructField("decoded", T.StringType())], ids)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 (of the token names): both transducers in one pass, neither stream is kept."""
    name = _shared(docs, path)

    def factory() -> Callable[[str | None], tuple]:
        encoder, decoder = encoder_at(SparkFiles.get(name)), decoder_at(SparkFiles.get(name), True)

        def one(t: str | None) -> tuple:
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

            def counted() -> Iterator[bytes]:
                nonlocal n
                for p in encoder.stream(t):
                    n += len(p) // 4
                    ids.update(p)
                    yield p

            for piece in _text(decoder, counted()):
                decoded.update(piece.encode())
            return n, ids.hexdigest(), decoded.hexdigest()

        return one

    return map_text(docs, factory, DIGESTS, text)
