"""Reads one text line by line: its statistics and how much of it is prose, list, table or junk."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

KINDS = ("list", "table", "junk")

MARK = re.compile(r"\s*(?:[-*+•·‣▪◦–—]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\[[ xX✓]?\]|☐|☑|✓)\s+(?=\S)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
TAIL = 40  # characters in which the punctuation that ends a line is looked for
STOP = re.compile(r"[.!?。！？؟…][\"')\]»”*_]*(?:\s|$)|[。！？]")
INNER_STOP = re.compile(r"[.!?。！？؟][\"')\]»”*_]*\s+\S")
ENDS = re.compile(r"[.!?:;。！？؟…][\"')\]»”*_]*\s*$")
SYMBOL = re.compile(r"[^\w\s]")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0600-\u06ff]")
#: Bytes of UTF-8 read as an 8-bit set leave runs of these, and lost bytes leave U+FFFD.
GARBLED = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u02dc\u2013-\u2122]|\ufffd|[\u0080-\u009f]")
HEX = re.compile(r"(?:0x)?[0-9a-fA-F]{2,}[:,]?")
SEPARATORS = ("\t", "|", ";", ",", "¦", "^", "~", "::")
ALIGNED = re.compile(r"\S(?:\s{2,})(?=\S)")
VOWEL = re.compile("[aeiouyáéíóúàèìòùâêîôûäëïöüãõåæøœ]")
RULE = re.compile(r"[\s|+:=\-—─═_]{3,}$")


class CommonWords:
    """The table of common words: words that stand alone, and those of languages written without blanks."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.alone = frozenset(w.casefold() for _, w in rows if not WIDE.search(w))
        self.within = re.compile("|".join(sorted({re.escape(w) for _, w in rows if WIDE.search(w)}, key=len, reverse=True)) or r"(?!)")
        self.languages = frozenset(lang for lang, _ in rows)


def _cells(line: str, separator: str | None) -> int:
    if separator is None:
        return len(ALIGNED.findall(line)) + 1
    return line.strip().strip("|").count(separator) + 1 if separator == "|" else line.count(separator) + 1


def _table_lines(lines: list[str]) -> set[int]:
    """Numbers of the lines that are rows of cells: runs of lines that one separator cuts into equally many cells."""
    found: set[int] = set()
    for separator in (*SEPARATORS, None):
        if separator is None:
            if not any("   " in x or "  " in x.strip() for x in lines):
                continue
        elif sum(separator in x for x in lines) < 2:
            continue
        counts = [_cells(x, separator) if x.strip() else 0 for x in lines]
        usual = Counter(c for c in counts if c >= 2)
        if not usual:
            continue
        width, often = max(usual.items(), key=lambda x: (x[1] * x[0], x[0]))
        if often < 2 or (width == 2 and separator in (",", ";", "::")):
            continue
        for i, x in enumerate(lines):
            if counts[i] < 2 or abs(counts[i] - width) > (width > 2) + (separator is None) * 2:
                continue
            parts = [p.strip() for p in (x.split(separator) if separator else re.split(r"\s{2,}", x.strip()))]
            full = [p for p in parts if p]
            if full and sum(map(len, full)) / len(full) <= 26 and max(len(p.split()) for p in full) <= 4 and not STOP.search(x.rstrip() + "x"):
                found.add(i)
    return found if len(found) >= 2 else set()


def char_counts(texts: list[str]) -> np.ndarray:
    """Of each text, none of them empty, the number of solid, digit, symbol and wide characters, by one look-up of all code points."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flags = _FLAGS[np.minimum(codes, _BEYOND)]
    if len(far := np.flatnonzero(codes >= _BEYOND)):
        distinct, where = np.unique(codes[far], return_inverse=True)
        flags[far] = np.array([_flags(chr(c)) for c in distinct], np.uint8)[where]
    starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
    return np.stack([np.add.reduceat((flags >> bit) & 1, starts, dtype=np.int64) for bit in range(4)], axis=1)


def _flags(c: str) -> int:
    return (c not in " \n\t\r") | c.isdigit() << 1 | (SYMBOL.match(c) is not None) << 2 | (WIDE.match(c) is not None) << 3


_BEYOND = 0xFFFF
_FLAGS = np.array([_flags(chr(i)) for i in range(_BEYOND + 1)], np.uint8)


def read_texts(texts: list[str], common: CommonWords) -> list[tuple[dict[str, float], dict[str, int]]]:
    """(statistics, characters by kind of part) of texts that are not blank."""
    return [_read(t, common, *c) for t, c in zip(texts, char_counts(texts).tolist())]


def _read(text: str, common: CommonWords, solid: int, digits: int, symbols: int, wide: int) -> tuple[dict[str, float], dict[str, int]]:
    lines = text.splitlines()
    full = [i for i, x in enumerate(lines) if x.strip()]
    find = (ASCII_WORD if text.isascii() else WORD).findall
    words_of = {i: find(lines[i].casefold()) for i in full}
    words = [w for own in words_of.values() for w in own]
    n_words = len(words)
    within = common.within.findall(text) if wide else []
    garbled = 0 if text.isascii() else sum(map(len, GARBLED.findall(text)))
    stats = {
        "n_words": n_words,
        "mean_word_length": len("".join(words)) / n_words if n_words else 0.0,
        "symbol_ratio": symbols / max(1, solid),
        "digit_ratio": digits / max(1, solid),
        "punctuated_lines": sum(ENDS.search(lines[i], max(0, len(lines[i]) - TAIL)) is not None for i in full) / len(full),
        "common_words": (sum(map(common.alone.__contains__, words)) + len(within)) / max(1, n_words + wide // 2 * bool(within)),
        "distinct_words": len(set(words)) / n_words if n_words else 0.0,
    }
    parts = _parts(text, lines, full, words_of, common, garbled, solid, wide)
    total = max(1, sum(parts.values()))
    return stats | {f"{k}_share": parts[k] / total for k in KINDS}, parts


def _parts(text, lines, full, words_of, common, garbled, solid, wide) -> dict[str, int]:
    parts = {"prose": 0, **dict.fromkeys(KINDS, 0)}
    if garbled > solid * 0.1 or _repeats(text):
        parts["junk"] = len(text)
        return parts
    table = _table_lines(lines) if len(full) > 1 else set()
    marks = {i: m.end() for i in full if i not in table and (m := MARK.match(lines[i]))}
    kinds = {}
    for i in full:
        line = lines[i]
        if i in table or (table and RULE.match(line)):
            kinds[i] = "table"
            continue
        body = line[marks[i] :] if i in marks else line.strip()
        tokens, words = body.split(), words_of[i]
        sense = common.within.search(body) is not None if wide else False
        share = sum(map(common.alone.__contains__, words)) / max(1, len(words))
        sentences = len(STOP.findall(body))
        # dumps: words of a letter or two between digits, or many words in one token
        coded = not wide and len(words) > 7 and (len(tokens) * 3 < len(words) or len("".join(words)) < 2.5 * len(words))
        if i in marks and len(marks) >= 2:
            kinds[i] = "list" if sentences <= 1 else "prose"
        elif coded:
            kinds[i] = "?"
        elif sense or (share >= 0.18 and len(words) >= 4) or (share >= 0.1 and len(words) >= 8 and sentences):
            kinds[i] = "prose"
        elif sentences and sum(len(w) > 2 and VOWEL.search(w) is not None for w in words) >= 3:
            kinds[i] = "prose"  # the end of a sentence that a line break cut from its common words
        elif len(tokens) <= 5 and len(body) <= 60 and not HEX.fullmatch(tokens[0]):
            kinds[i] = "bare"
        else:
            kinds[i] = "?"
    rest = [i for i in full if kinds[i] in ("bare", "?", "prose")]
    short = {i for i in rest if kinds[i] == "bare"}
    if len(short) < 3 or len(short) * 2 <= len(rest):
        # phrases, one per line, are a bare list even if they hold common words; lines of wrapped prose break mid-phrase
        phrases = {i for i in rest if _phrase(lines[i], words_of[i], common)}
        short = phrases if len(phrases) >= 3 and len(phrases) >= 0.8 * len(rest) else set()
    for i in full:
        kind, size = kinds[i], len(lines[i])
        if i in short:
            kind = "list"
        elif kind == "bare":  # a heading, unless it is all there is
            if len(full) > 1:
                continue
            kind = "junk"
        elif kind == "?":
            kind = "junk"
        parts[kind] += size
    return parts


def _repeats(text: str) -> bool:
    """Whether one token, no row of cells, makes up more than half of a text of eight or more, separators left out."""
    tokens = [t for t in text.split() if t not in SEPARATORS]
    if len(tokens) < 8 or len(set(tokens)) > len(tokens) // 2 + 1:  # too many others for one to be the half
        return False
    token, often = Counter(tokens).most_common(1)[0]
    return often * 2 > len(tokens) and not any(token.strip(x).count(x) >= 2 for x in SEPARATORS)


def _phrase(line: str, words: list[str], common: CommonWords) -> bool:
    """Whether a line may be an item by itself: short, with no sentence going on in it or beyond it."""
    return 2 <= len(words) <= 12 and words[-1] not in common.alone and not INNER_STOP.search(line) and not line.rstrip().endswith((",", ";"))
