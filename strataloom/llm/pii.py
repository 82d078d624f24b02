"""Personal information in free text: found by a linear-chain CRF, replaced by typed placeholders.

1. Shapes that every item has one of (an @ or a spelled-out one, seven digits close together, four digits among letters,
   two capitalised words in a row, a number beside a capitalised word, and for text in small letters a word of name
   affixes, a title or a street word) are looked up in the whole text; the text around them is a window.
2. Windows are cut into tokens, and the field (crf.py), trained on the labelled table of pii_labels.py, labels them by
   Viterbi in numpy batches. Equal windows are decoded once per worker.
3. The field decides. Spans are only trimmed (marks and articles at their ends, words around a number) and are dropped if
   nothing of the type is left: no digits, no address sign, a single word for a name.

The name-part table gives the affixes from which its names are made; other names are seen by their shape and surroundings.

Defined cases: null and empty texts contain nothing and stay as they are; placeholders in brackets are no items; an item
key delivered again counts once in find_types; overlapping windows are one; extra columns are not read; empty tables give
no rows; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.crf import Crf
from strataloom.llm.pii_labels import LABELLED_ROWS, LABELS, TITLES, TYPES, labelled_rows

MOST_PARTS = 100_000
NAME_COST = 1.0  # taken off the score of a name's first token, so that a doubtful one is none
LEFT, RIGHT = 64, 72  # characters of a window on either side of a sign
SENTENCE, OVERLAP = 240, 48  # tokens decoded together, and shared with the next stretch
WINDOW, SHARED = 8000, 400  # characters of the longest window, and what neighbours share of a longer stretch
CACHED_WINDOWS, CACHED_CHARS = 50_000, 20_000_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
NEAR_DIGITS = re.compile(r"[0-9](?:[\s().\-/–‑+]{0,2}[0-9]){6,}")
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪİĶŁŃŇŌŐŘŚŞŠŤŪŮŰŹŻŽ"
#: Two capitalised words in a row, initials and small words between them allowed; a number before or after such a word.
CAPITALS = re.compile(rf"(?<![^\W_])[{_UPPER}][^\W\d_'’]*(?:['’-][^\W\d_]+)*[.,]?[\s*_]{{1,3}}(?:(?:[a-z]{{2,3}}|[{_UPPER}]\.)[\s*_]{{1,3}}){{0,2}}[{_UPPER}][^\W\d_]")
NUMBERED = re.compile(rf"(?<![\w.,-])[0-9]{{1,5}}[a-zA-Z]?,?[\s*_]{{1,3}}(?:[a-z]{{2,9}}[\s*_]{{1,3}}){{0,2}}[{_UPPER}][^\W\d_]|[{_UPPER}][^\W\d_]+\.?,?[\s*_]{{1,3}}(?:n\.º\s)?[0-9]{{1,5}}[a-zA-Z]?(?![\w-])")
MIXED = re.compile(r"(?<![^\W_])(?=(?:[a-z]*[0-9]){4})(?=[0-9]*[a-z])[a-z0-9]{8,18}(?![^\W_])")  # letters among digits, as ID_VALUE has it
STAMP = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
STREETS = ("street", "st", "road", "rd", "lane", "court", "avenue", "ave", "drive", "square", "boulevard", "rue", "calle", "avenida", "plaza", "piazza", "paseo", "viale", "corso", "largo", "travessa", "rua", "straße", "strasse", "platz", "allee", "weg", "via", "way", "close", "place", "terrace", "c", "flat", "apt", "suite")
SIGN_STREETS = ("street", "road", " rd", "lane", "court", "avenue", "ave.", "boulevard", "rue ", "calle ", "c/ ", "avenida", "plaza", "piazza", "rua ", "straße", "strasse", "square", "drive")
SIGN_MAIL = ("@", "(at)", "[at]", "{at}", " dot ", "(dot)", "[dot]", "( at )", "[ at ]")
_AT = r"(?:\s?@\s?|\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+|\s\.\s(?=[\w-]+(?:\s|$)))"
MAIL = re.compile(rf"[\w+%'-]+(?:{_DOT}[\w+%'-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
ARTICLE = re.compile(r"(?:the|a|an|der|die|das|le|la|les|el|los|il|lo|o|os)\s+", re.I)
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}


class NameParts:
    """What name parts look like: affixes that many parts of one kind share, and all words made of two of them."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.digest = hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()
        self.words: dict[str, list[str]] = {}
        for kind in ("given", "family"):
            listed = sorted({w.lower() for k, w in rows if k == kind and len(w) > 2})
            heads, tails = Counter(), Counter()
            for w in listed:
                for i in range(2, len(w) - 1):
                    heads[w[:i]] += 1
                    tails[w[i:]] += 1
            first, last = set(), set()
            for w in listed:
                cuts = [(min(heads[w[:i]], tails[w[i:]]), i) for i in range(2, len(w) - 1)]
                if cuts and max(cuts)[0] >= 4:
                    best = max(cuts)[1]
                    first.add(w[:best])
                    last.add(w[best:])
            made = {a + b for a in first for b in last} if len(first) * len(last) <= 20 * max(50, len(listed)) else set()
            self.words[kind] = sorted(made | set(listed))
        self.known = {k: frozenset(v) for k, v in self.words.items()}


def _shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 11)}"
    if word.isalpha():
        return "X" if word.isupper() else "x" if word.islower() else "Xx" if word[0].isupper() else "xX"
    return word


class Features:
    """Features of a token; a leading line break belongs to the token."""

    def __init__(self, parts: NameParts):
        self.parts = parts
        self.titles = frozenset(t.strip(".").lower() for t in TITLES)
        self.streets = frozenset(STREETS)

    def __call__(self, token: str) -> list[str]:
        word = token.lstrip("\n")
        low = word.lower()
        out = ["w=" + (low if word.isalpha() or not word.isdigit() else _shape(word)), "s=" + _shape(word), "b"]
        if token[0] == "\n":
            out.append("nl")
        if word.isalpha():
            out += [f"p3={low[:3]}", f"t3={low[-3:]}", f"len={min(len(low), 12)}"]
            for kind, known in self.parts.known.items():
                if low in known:
                    out.append(kind)
                elif len(low) > 6:
                    out += [f"{kind}+" for cut in (1, 2, 3, 4, 5, 6) if low[:-cut] in known][:1]
            if low in self.titles:
                out.append("title")
            if low in self.streets or low.endswith(("straße", "strasse", "str", "platz", "weg", "allee", "gasse", "straat", "laan", "gracht")):
                out.append("street")
            if len(low) == 1:
                out.append("one")
        elif word.isdigit():
            out.append("digits")
            if word[0] == "0":
                out.append("zero")
        return out


def tokens_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens with the mark of a line break before them, and their places."""
    tokens, places, last = [], [], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        tokens.append("\n" + m.group() if "\n" in text[last:a] else m.group())
        places.append((a, b))
        last = b
    return tokens, places


def training_table(parts: NameParts, rows: int = LABELLED_ROWS, seed: int = 7) -> tuple[list[list[str]], list[list[int]]]:
    """The labelled rows as tokens and label numbers."""
    sentences, tags = [], []
    capital = [[w.capitalize() for w in parts.words[k]] or ["Alex"] for k in ("given", "family")]
    for row in labelled_rows(*capital, rows=rows, seed=seed):
        text, spans = "", []
        for piece, kind in row:
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece
        tokens, places = tokens_of(text)
        labels = [0] * len(tokens)
        for a, b, kind in spans:
            inside = [i for i, (x, y) in enumerate(places) if x >= a and y <= b]
            for n, i in enumerate(inside):
                labels[i] = LABELS.index(("I-" if n else "B-") + kind)
        if tokens:
            sentences.append(tokens)
            tags.append(labels)
    return sentences, tags


@lru_cache(maxsize=4)
def _trained(rows: tuple, labelled: int) -> Crf:
    parts = NameParts(list(rows))
    return _priced(Crf(LABELS, Features(parts)).fit(*training_table(parts, labelled)))


def _priced(crf: Crf) -> Crf:
    crf.bias = np.where(np.array(LABELS) == "B-name", -NAME_COST, 0.0)
    return crf


def read_parts(name_parts: DataFrame) -> tuple:
    """The name-part table, a dictionary; refused beyond MOST_PARTS rows."""
    rows = name_parts.select("part_kind", "name_text").filter("part_kind is not null and name_text is not null").distinct().limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    return tuple(sorted((r.part_kind, r.name_text) for r in rows))


class Finder:
    """Finds items in texts with one trained field."""

    def __init__(self, crf: Crf, parts: NameParts):
        self.crf, self.parts = crf, parts
        self.cache: dict[str, list[tuple[int, int, str]]] = {}
        self.cached_chars = 0
        signs = ahocorasick.Automaton()
        for w in {*parts.words["given"], *parts.words["family"]}:
            signs.add_word(w, (len(w), True))
        for w in SIGN_STREETS:
            signs.add_word(w, (len(w), w[0].isalpha() and not w.startswith("stra")))
        for t in {t.strip(".").lower() for t in TITLES if len(t.strip(".")) > 1}:
            for w in (t + " ", t + ". ", t + "."):
                signs.add_word(w, (len(w), True))
        for w in SIGN_MAIL:
            signs.add_word(w, (len(w), False))
        signs.make_automaton()
        self.signs = signs

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Stretches of text around its signs, apart from each other."""
        low = text.lower()
        if len(low) != len(text):  # letters that become two in lower case
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        at = [(m.start(), m.end()) for m in NEAR_DIGITS.finditer(low) if not (STAMP.match(m.group()) and low[m.start() + 10 : m.start() + 11] == "t")]
        for shape, where in ((MIXED, low), (CAPITALS, text), (NUMBERED, text)):
            at += (m.span() for m in shape.finditer(where))
        for end, (size, alone) in self.signs.iter(low):
            start = end + 1 - size
            if not (alone and start and low[start - 1].isalnum()):
                at.append((start, end + 1))
        if not at:
            return []
        at.sort()
        out: list[list[int]] = []
        for a, b in at:
            a, b = max(0, a - LEFT), min(len(text), b + RIGHT)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        for w in out:  # whole tokens, if they are not endless
            for _ in range(LEFT):
                if w[0] > 0 and text[w[0] - 1].isalnum():
                    w[0] -= 1
            for _ in range(RIGHT):
                if w[1] < len(text) and text[w[1]].isalnum():
                    w[1] += 1
        return [(a, b) for a, b in out]

    @staticmethod
    def _stretches(a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, from, to) of the windows that cover a stretch; each keeps the items that begin in from..to."""
        at = a
        while b - at > WINDOW:
            yield at, at + WINDOW, at + (at > a) * SHARED // 2, at + WINDOW - SHARED // 2
            at += WINDOW - SHARED
        yield at, b, at + (at > a) * SHARED // 2, b

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Start, end and type of the items of each text, in order."""
        found: list[list[tuple[int, int, str]]] = []
        todo: dict[str, None] = {}
        held: list[list[tuple[int, str, int, int]]] = []
        if len(self.cache) > CACHED_WINDOWS or self.cached_chars > CACHED_CHARS:
            self.cache.clear()
            self.cached_chars = 0
        for text in texts:
            own = [(a, text[a:b], low, high) for x, y in self.windows(text) for a, b, low, high in self._stretches(x, y)] if text else []
            held.append(own)
            for _, w, *_ in own:
                if w not in self.cache:
                    todo[w] = None
        self._decode(list(todo))
        self.cached_chars += sum(map(len, todo))
        for own in held:
            spans: list[tuple[int, int, str]] = []
            for a, w, low, high in own:
                for s, e, kind in self.cache[w]:
                    if low <= a + s < high and (not spans or a + s >= spans[-1][1]):
                        spans.append((a + s, a + e, kind))
            found.append(spans)
        return found

    def _decode(self, windows: list[str]) -> None:
        stretches, whose = [], []
        for w in windows:
            self.cache[w] = []
            tokens, places = tokens_of(w)
            for begin in range(0, max(1, len(tokens) - OVERLAP), SENTENCE - OVERLAP):
                stretches.append(tokens[begin : begin + SENTENCE])
                whose.append((w, places, begin, len(tokens)))
        for (w, places, begin, total), path in zip(whose, self.crf.decode(stretches)):
            low = begin + OVERLAP // 2 if begin else 0
            high = begin + SENTENCE - OVERLAP // 2 if begin + SENTENCE < total else total
            i = 0
            while i < len(path):
                if path[i] == 0:
                    i += 1
                    continue
                kind, j = LABELS[path[i]][2:], i + 1
                while j < len(path) and LABELS[path[j]] == "I-" + kind:
                    j += 1
                if low <= begin + i < high:
                    a, b = places[begin + i][0], places[begin + j - 1][1]
                    if span := self._sound(w, a, b, kind):
                        self.cache[w].append(span)
                i = j

    def _sound(self, w: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
        """The span without stray marks at its ends, or None if it lacks what its type cannot do without."""
        while a < b and w[b - 1] in ",;:!?¿¡\"»”*_ \n" or kind != "address" and a < b and w[b - 1] in ".([{" or kind in ("phone", "email", "id_number") and a < b and w[b - 1] in ")]}>" and w[a:b].count("(") + w[a:b].count("[") < w[a:b].count(")") + w[a:b].count("]") + w[a:b].count(">"):
            b -= 1
        while a < b and w[a] in ",;:.!?\"«“*_)]} \n":
            a += 1
        if kind == "id_number" and a < b:  # whole words: the field may label the letters of a number apart from its digits
            while a and w[a - 1].isalnum() and b - a < 40:
                a -= 1
            while b < len(w) and w[b].isalnum() and b - a < 40:
                b += 1
        text = w[a:b]
        digits = sum(map(str.isdigit, text))
        if kind == "email":
            m = MAIL.search(text)  # else what stands around it, if the field saw a part only
            found = [(a + m.start(), a + m.end())] if m else [x.span() for x in MAIL.finditer(w, max(0, a - LEFT), min(len(w), b + RIGHT)) if x.start() < b and a < x.end()]
            return (*found[0], kind) if found else None
        if kind != "name" and (a and w[a - 1].isalnum() or b < len(w) and w[b].isalnum()):
            return None  # part of a word
        if kind == "phone":
            m = re.search(r"[+(]?\d.*\d", text, re.S)  # words beside the number stay
            return (a + m.start(), a + m.end(), kind) if m and 7 <= digits <= 19 else None
        if kind == "id_number":
            return (a, b, kind) if digits >= 4 else None
        if kind == "address":
            return (a, b, kind) if digits and any(map(str.isalpha, text)) else None
        last = 0
        for m in re.finditer(r"([^\W\d_]+)[.!?:;]\s+", text):  # a sentence's end before the name
            if len(m.group(1)) > 2 and m.group(1).lower() not in self.crf.features.titles:
                last = m.end()
        a, text = a + last, text[last:]
        if m := ARTICLE.match(text):
            a, text = a + m.end(), text[m.end() :]
        return (a, b, kind) if len(re.findall(r"[^\W\d_]+", text)) > 1 else None


_FINDERS: dict[str, Finder] = {}


def _worker_finder(shared) -> Finder:
    digest, rows, index, weights, moves, first = shared.value
    if digest not in _FINDERS:
        parts = NameParts(list(rows))
        crf = _priced(Crf(LABELS, Features(parts)))
        crf.index, crf.weights, crf.moves, crf.first = index, weights, moves, first
        _FINDERS.clear()
        _FINDERS[digest] = Finder(crf, parts)
    return _FINDERS[digest]


def share_model(df: DataFrame, name_parts: DataFrame, labelled: int = LABELLED_ROWS):
    """Trains on the driver (at most `labelled` rows) and broadcasts the weights, whose size that table bounds."""
    rows = read_parts(name_parts)
    crf = _trained(rows, labelled)
    digest = hashlib.sha256(crf.weights.tobytes() + repr(rows).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, rows, crf.index, crf.weights.astype(np.float32), crf.moves.astype(np.float32), crf.first.astype(np.float32)))


def _source(df: DataFrame, key: Column | str, text: str) -> DataFrame:
    return df.select((F.col(key) if isinstance(key, str) else key).alias("__key"), F.col(text).cast("string").alias("__text"))


def find_types(df: DataFrame, name_parts: DataFrame, key: Column | str, text: str) -> DataFrame:
    """(item, pii_type): one row for each key and type that its text contains."""
    shared = share_model(df, name_parts)
    source = _source(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _worker_finder(shared)
        for batch in batches:
            rows, kinds = [], []
            for i, spans in enumerate(finder.find(batch.column(1).to_pylist())):
                for kind in sorted({k for *_, k in spans}):
                    rows.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())], ["__key", "pii_type"])

    key_type = source.schema["__key"].dataType.simpleString()
    return source.mapInArrow(run, f"__key {key_type}, pii_type string").distinct().withColumnRenamed("__key", "item")


def mask_texts(df: DataFrame, name_parts: DataFrame, key: Column | str, text: str) -> DataFrame:
    """(item, masked_text, pii_counts): every row's text with typed placeholders, and how many of each type it had."""
    shared = share_model(df, name_parts)
    source = _source(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _worker_finder(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            masked, counts = [], []
            for text, spans in zip(texts, finder.find(texts)):
                parts, last, count = [], 0, defaultdict(int)
                for a, b, kind in spans:
                    parts += [text[last:a], PLACEHOLDER[kind]]
                    last = b
                    count[kind] += 1
                masked.append(None if text is None else "".join([*parts, text[last:]]))
                counts.append(sorted(count.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masked, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int32()))], ["__key", "masked_text", "pii_counts"])

    key_type = source.schema["__key"].dataType.simpleString()
    return source.mapInArrow(run, f"__key {key_type}, masked_text string, pii_counts map<string,int>").withColumnRenamed("__key", "item")
