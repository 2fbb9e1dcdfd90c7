"""The query language: text to a tree, and a tree to a Column over an array of words.

Blank or ``&`` is AND, ``|`` OR, ``!`` NOT, ``#`` WAND between words, ``( )``
groups, ``"..."`` an exact phrase, ``[...]`` words in order, ``{...}^n`` words
in order at most n apart, ``*`` and ``?`` wildcards, ``\\`` takes the next sign
as it is. ``*`` alone matches everything.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.bind import once
from quarry.functions.terms import Posted, Words, as_words

NEAR = 20


@dataclass(frozen=True)
class Node:
    kind: str  # term, wildcard, and, or, not, wand, exact, ordered, nearby, all
    text: str = ""
    parts: tuple[Node, ...] = ()
    distance: int = 0

    def terms(self) -> list[str]:
        """Words that count for ranking: all but those under NOT."""
        if self.kind == "term":
            return [self.text]
        return [] if self.kind == "not" else [t for p in self.parts for t in p.terms()]

    def leaves(self) -> list[Node]:
        return [x for p in self.parts for x in p.leaves()] if self.parts else [self]

    def kinds(self) -> set[str]:
        return {self.kind}.union(*(p.kinds() for p in self.parts))

    def words(self) -> list[str]:
        """All words, also those under NOT."""
        return [x.text for x in self.leaves() if x.kind == "term"]

    def patterns(self) -> list[str]:
        return [x.text for x in self.leaves() if x.kind == "wildcard"]

    def anchored(self) -> bool:
        """Whether a document without any of the words can't match."""
        match self.kind:
            case "not" | "all":
                return False
            case "and":
                return any(p.anchored() for p in self.parts)
            case "or":
                return all(p.anchored() for p in self.parts)
        return True

    def __str__(self) -> str:
        inner = [str(p) for p in self.parts]
        match self.kind:
            case "and":
                return "(" + "&".join(inner) + ")"
            case "or":
                return "(" + "|".join(inner) + ")"
            case "wand":
                return "(" + "#".join(inner) + ")"
            case "not":
                return "!" + inner[0]
            case "exact":
                return '"' + " ".join(inner) + '"'
            case "ordered":
                return "[" + " ".join(inner) + "]"
            case "nearby":
                return "{" + " ".join(inner) + "}^" + str(self.distance)
        return self.text or "*"


class _Reader:
    SIGNS = '&|!#()[]{}"^'

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def sign(self) -> str:
        self.blank()
        return self.text[self.at] if self.at < len(self.text) else ""

    def word(self) -> Node:
        self.blank()
        out, wild = "", False
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                out += self.text[self.at + 1]
                self.at += 2
                continue
            if c.isspace() or c in self.SIGNS:
                break
            wild |= c in "*?"
            out += c
            self.at += 1
        if not out:
            raise ValueError(f"expected a word at {self.at} of {self.text!r}")
        if out == "*" and wild:
            return Node("all")
        return Node("wildcard" if wild else "term", out.lower())

    def either(self) -> Node:
        return self.chain("|", "or", self.both)

    def chain(self, sign: str, kind: str, inner) -> Node:
        parts = [inner()]
        while self.sign() == sign:
            self.at += 1
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Node(kind, parts=tuple(parts))

    def both(self) -> Node:
        parts = [self.weak()]
        while (c := self.sign()) and c not in "|)":
            if c == "&":
                self.at += 1
            parts.append(self.weak())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def weak(self) -> Node:
        return self.chain("#", "wand", self.single)

    def single(self) -> Node:
        c = self.sign()
        if c == "!":
            self.at += 1
            return Node("not", parts=(self.single(),))
        if c == "(":
            self.at += 1
            out = self.either()
            self.close(")")
            return out
        for opening, closing, kind in (('"', '"', "exact"), ("[", "]", "ordered"), ("{", "}", "nearby")):
            if c == opening:
                self.at += 1
                parts = []
                while self.sign() not in (closing, ""):
                    parts.append(self.word())
                self.close(closing)
                if not parts:
                    raise ValueError(f"empty {kind} phrase")
                distance = 0
                if kind == "nearby":
                    distance = NEAR
                    if self.sign() == "^":
                        self.at += 1
                        self.blank()
                        start = self.at
                        while self.at < len(self.text) and self.text[self.at].isdigit():
                            self.at += 1
                        distance = int(self.text[start : self.at])
                return Node(kind, parts=tuple(parts), distance=distance)
        return self.word()

    def close(self, sign: str) -> None:
        if self.sign() != sign:
            raise ValueError(f"expected {sign} at {self.at} of {self.text!r}")
        self.at += 1


def parse(text: str) -> Node:
    r = _Reader(text)
    if not r.sign():
        return Node("all")
    out = r.either()
    if r.sign():
        raise ValueError(f"unexpected {r.sign()!r} at {r.at} of {text!r}")
    return out


def conjunction(terms: list[str]) -> Node:
    return Node("and", parts=tuple(Node("term", t) for t in terms)) if len(terms) != 1 else Node("term", terms[0])


def disjunction(terms: list[str]) -> Node:
    return Node("or", parts=tuple(Node("term", t) for t in terms)) if len(terms) != 1 else Node("term", terms[0])


def like(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in pattern) + "$"


def signs_like(text: Column, pattern: str) -> Column:
    """Whether a text has, at any place, signs that fit a pattern: ``?`` is one sign, ``*`` any number; case and blanks don't count."""
    plain = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.coalesce(plain.rlike(like(pattern.lower())[1:-1]), F.lit(False))


def _after(here: Column, reach: Column, least: int, far: int | None) -> Column:
    """Of positions ``here``, those ``least`` to ``far`` (any number, if none) after one of ``reach``."""
    if far is None:
        return F.filter(here, lambda p: F.exists(reach, lambda q: p >= q + least))
    return F.filter(here, lambda p: F.exists(reach, lambda q: p.between(q + least, q + far)))


def phrase(tokens, words: list[str], kind: str, distance: int = 0, strict: bool = False) -> Column:
    """Whether the words stand as asked.

    Strict: exact words follow each other, others come strictly later. Else a
    word may also stand where the one before it does, so that repeated words
    of the phrase need only one place.
    """
    least = 1 if strict else 0
    far = None if kind == "ordered" else 1 if kind == "exact" else distance

    def follow(reach: Column, rest: list[str]) -> Column:
        if not rest:
            return F.size(reach) > 0
        return once(_after(own.places(rest[0]), reach, least, far), lambda r: follow(r, rest[1:]))

    own = as_words(tokens)
    return once(own.places(words[0]), lambda r: follow(r, words[1:]))


def matches(node: Node, tokens, bounds: dict[str, float] | None = None, threshold: float = 0.5, strict: bool = False) -> Column:
    """Whether words (an array column, or what ``terms`` has for them) match a tree.

    WAND needs ``bounds``, the most that each word can add to a score: a row
    matches if its words' bounds exceed ``threshold`` of their sum (0.5 if not
    positive).
    """
    return F.lit(True) if node.kind == "all" else as_words(tokens).bound(lambda t: _matches(node, t, bounds, threshold, strict))


def _matches(node: Node, tokens: Words | Posted, bounds: dict[str, float] | None, threshold: float, strict: bool) -> Column:
    inner = lambda p: _matches(p, tokens, bounds, threshold, strict)
    match node.kind:
        case "all":
            return F.lit(True)
        case "term":
            return tokens.has(node.text)
        case "wildcard":
            return tokens.like(like(node.text))
        case "and":
            return reduce(lambda a, b: a & b, map(inner, node.parts))
        case "or":
            return reduce(lambda a, b: a | b, map(inner, node.parts))
        case "not":
            return ~inner(node.parts[0])
        case "wand":
            weight = {p: (bounds or {}).get(p.text, 1.0) for p in node.parts}
            got = reduce(lambda a, b: a + b, [F.when(inner(p), F.lit(w)).otherwise(0.0) for p, w in weight.items()])
            return got > (threshold if threshold > 0 else 0.5) * sum(weight.values())
    return phrase(tokens, [p.text for p in node.parts], node.kind, node.distance, strict)
