"""The construct grammar: an ordered list of constant and random segments, checked when it is built."""

from __future__ import annotations

from dataclasses import dataclass

#: Letters a constant segment may have.
NUCLEOTIDES = "ATCGURYMKSWBDHVN"
MOST_SEGMENTS = 62


@dataclass(frozen=True)
class Const:
    sequence: str


@dataclass(frozen=True)
class Rand:
    min_len: int
    max_len: int


Segment = Const | Rand


def parse_segment(text: str) -> Segment:
    """const:SEQ or rand:MIN-MAX."""
    kind, colon, value = text.partition(":")
    if not colon:
        raise ValueError(f"segment {text!r} has no ':'")
    if kind == "const":
        sequence = value.upper()
        if not sequence:
            raise ValueError("a constant segment needs a sequence")
        for at, letter in enumerate(sequence):
            if letter not in NUCLEOTIDES:
                raise ValueError(f"{letter!r} at position {at} is no nucleotide code")
        return Const(sequence)
    if kind == "rand":
        low, dash, high = value.partition("-")
        if not dash or not (low.isascii() and low.isdigit() and high.isascii() and high.isdigit()):
            raise ValueError(f"random segment {text!r} needs MIN-MAX")
        if int(low) > int(high):
            raise ValueError(f"random segment {text!r}: minimum over maximum")
        return Rand(int(low), int(high))
    raise ValueError(f"unknown kind of segment {kind!r}")


@dataclass(frozen=True)
class Construct:
    segments: tuple[Segment, ...]

    def __post_init__(self) -> None:
        if not self.segments:
            raise ValueError("a construct needs a segment")
        if not self.consts:
            raise ValueError("a construct needs a constant segment")
        if len(self.segments) > MOST_SEGMENTS:
            raise ValueError(f"at most {MOST_SEGMENTS} segments fit the mask")
        for a, b in zip(self.segments, self.segments[1:], strict=False):
            if isinstance(a, Rand) and isinstance(b, Rand):
                raise ValueError("two random segments stand side by side")

    @classmethod
    def parse(cls, *texts: str) -> Construct:
        return cls(tuple(parse_segment(t) for t in texts))

    @property
    def consts(self) -> tuple[str, ...]:
        return tuple(s.sequence for s in self.segments if isinstance(s, Const))

    @property
    def rands(self) -> tuple[tuple[int, Rand], ...]:
        """Random segments with the number of constants before them."""
        out, seen = [], 0
        for s in self.segments:
            if isinstance(s, Const):
                seen += 1
            else:
                out.append((seen, s))
        return tuple(out)

    @property
    def starts_open(self) -> bool:
        return isinstance(self.segments[0], Rand)

    @property
    def ends_open(self) -> bool:
        return isinstance(self.segments[-1], Rand)

    @property
    def all_pass(self) -> int:
        return (1 << len(self.segments)) - 1

    def bit_names(self) -> list[str]:
        return [f"const_{i}" for i in range(len(self.consts))] + [f"rand_{i}" for i in range(len(self.rands))]

    def as_json(self) -> list[dict]:
        return [
            {"Const": {"sequence": list(s.sequence.encode())}} if isinstance(s, Const) else {"Rand": {"min_len": s.min_len, "max_len": s.max_len}}
            for s in self.segments
        ]
