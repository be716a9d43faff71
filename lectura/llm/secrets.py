"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

The patterns (assign, access, hex) give the base spans. The battery looks at every other string of 16 characters or more
without blanks, also of one character class. For the smallest alphabet that explains a string it computes a chi-squared
statistic of uniformity, a runs test and a serial-correlation test. A string is a discovery (kind `random`) if no test
finds it non-random, and if it is not written like ordinary text. Four p-values say so, combined by Fisher's method:

* evenness: for text as uneven as the corpus the chi-squared statistic would follow a noncentral law whose noncentrality
  grows with the string's length; the lower tail counts;
* runs of character classes (lower, upper, digit, sign): names change the class rarely; the upper tail of a binomial law;
* alphabet: a hexadecimal string's letters all lie between a and f, as the corpus's letters seldom do;
* alternation of vowels and consonants between neighbouring letters: the corpus's rate, the lower tail of a binomial law.

Benjamini and Hochberg's procedure controls the share of false discoveries inside each class of encoding and length, over
all documents, so that plain words do not take the power from other alphabets.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import stored

from .common import map_rows, whole_text

# The base patterns. Letters of the keywords count in either case, others do not fold.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
PIECE = re.compile(r"[^=]+")
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Smallest first; a string belongs to the first alphabet that holds all of it.
ENCODINGS = (
    DIGIT, DIGIT + "abcdef", DIGIT + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGIT + LOWER, DIGIT + UPPER,
    UPPER + LOWER, UPPER + LOWER + DIGIT,
    UPPER + LOWER + DIGIT + "+/", UPPER + LOWER + DIGIT + "-_", UPPER + LOWER + DIGIT + "+/-_",
)
SETS = tuple(map(frozenset, ENCODINGS))
PLACES = tuple({c: k for k, c in enumerate(e)} for e in ENCODINGS)

SHORTEST = 16  # of a string that the battery judges
TEST_LIMIT = 3.3  # standard errors at which a test calls a string non-random (two-sided, about 0.001)
LENGTH_CLASSES = (16, 20, 32, 48, 64)  # where each begins
LEAST_UNEVEN = 0.5  # per character; what text adds to the chi-squared statistic at least
MOST_CHANGES = 1 / 3  # of neighbours in a name that differ in character class, if the corpus has fewer
FALSE_SHARE = 0.001
BINS_PER_DIGIT, LAST_BIN = 20, 600  # of -log10 p, for the distributed procedure


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind; per kind leftmost without overlap."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    for run in RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(*m.span(), kind) for m in pattern.finditer(text, *run.span()) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


LOWER_CLASS, UPPER_CLASS, DIGIT_CLASS, SIGN_CLASS = range(4)
CLASS, VOWEL = np.full(256, SIGN_CLASS, np.uint8), np.zeros(256, bool)
for _k, _chars in enumerate((LOWER, UPPER, DIGIT)):
    CLASS[[ord(c) for c in _chars]] = _k
VOWEL[[ord(c) for c in "aeiouAEIOU"]] = True


HEXADECIMAL = frozenset(k for k, e in enumerate(ENCODINGS) if len(e) == 16)


def neighbours(data: np.ndarray) -> tuple[int, int, int]:
    """Of ASCII bytes: changes of the character class, pairs of letters of one case, and those of vowel and consonant."""
    kinds, vowels = CLASS[data], VOWEL[data]
    same = kinds[1:] == kinds[:-1]
    letters = same & (kinds[1:] <= UPPER_CLASS)
    return int((~same).sum()), int(letters.sum()), int((letters & (vowels[1:] != vowels[:-1])).sum())


def battery(string: str) -> tuple[int, float, int, int, int, int, bool] | None:
    """(encoding, chi-squared statistic, *neighbours, letters, whether all tests leave the string random), or None beyond all encodings."""
    letters = frozenset(string)
    encoding = next((k for k, s in enumerate(SETS) if letters <= s), None)
    if encoding is None:
        return None
    places, size, n = PLACES[encoding], len(ENCODINGS[encoding]), len(string)
    at = np.array([places[c] for c in string])
    counts = np.bincount(at, minlength=size)
    statistic = float((counts**2).sum() * size / n - n)
    # Wilson-Hilferty for the central law; runs about the middle of the alphabet; correlation of neighbours.
    even = ((statistic / (size - 1)) ** (1 / 3) - 1 + 2 / (9 * (size - 1))) / math.sqrt(2 / (9 * (size - 1)))
    changes = int((np.diff(at >= size / 2) != 0).sum())
    runs = (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    centred = at - (size - 1) / 2
    serial = float((centred[:-1] * centred[1:]).sum()) / (math.sqrt(n - 1) * (size**2 - 1) / 12)
    data = np.frombuffer(string.encode(), np.uint8)
    return encoding, statistic, *neighbours(data), int((CLASS[data] <= UPPER_CLASS).sum()), max(even, abs(runs), abs(serial)) <= TEST_LIMIT


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple]:
    """(start, end, *battery) of the strings beside the base spans that are long enough.

    A name and its value, or what stands before and behind a base span, are strings of their own.
    """
    out, k = [], 0
    for run in RUN.finditer(text):
        at, end = run.span()
        while at < end:
            while k < len(base) and base[k][1] <= at:
                k += 1
            upto = min(end, base[k][0]) if k < len(base) else end
            for piece in PIECE.finditer(text, at, max(at, upto)):
                start, stop = piece.span()
                if stop - start >= SHORTEST and (judged := battery(text[start:stop])) is not None:
                    out.append((start, stop, *judged))
            at = base[k][1] if upto < end else end
    return out


def evenness(text: str) -> tuple[float, int, int, int]:
    """Sum of squared shares of the ASCII letters and digits, how many there are, letters, and letters from a to f."""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
    lower, upper, digits = counts[97:123], counts[65:91], counts[48:58]
    both = np.concatenate((digits, upper, lower)).astype(np.float64)
    n = both.sum()
    squares = float((both * (both - 1)).sum() / (n * (n - 1))) if n > 1 else 0.0
    return squares, int(n), int(lower.sum() + upper.sum()), int(lower[:6].sum() + upper[:6].sum())


def vowel_changes(text: str) -> tuple[int, int]:
    """Pairs of neighbouring ASCII letters of one case, and those of a vowel and a consonant."""
    return neighbours(np.frombuffer(text.encode(), np.uint8))[1:] if text else (0, 0)


def upper_tail(n: int, k: int, rate: float) -> float:
    """Chance of k or more among n draws, one by one with this rate."""
    if k <= 0 or rate >= 1:
        return 1.0
    if k > n or rate <= 0:
        return 0.0
    log = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(rate) + (n - x) * math.log1p(-rate)
           for x in range(k, n + 1)]
    return min(1.0, math.fsum(map(math.exp, log)))


def evenness_p(encoding: int, length: int, statistic: float, squares: float) -> float:
    """Chance that text with this sum of squared shares is as even as the string, or more (Abdel-Aty's approximation)."""
    size = len(ENCODINGS[encoding])
    shift = length * max(size * squares - 1, LEAST_UNEVEN)
    mean, df = size - 1 + shift, size - 1
    f = mean**2 / (df + 2 * shift)
    z = ((max(statistic, 0) / mean) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def p_value(encoding: int, length: int, statistic: float, changes: int, pairs: int, alternations: int, letters: int,
            squares: float, rate: float, hexadecimal: float) -> float:
    """Fisher's combination of the p-values, for text of this sum of squared shares, rate of alternation and share of a to f.

    A test that has nothing to look at (no neighbours that could differ, no letters) is left out.
    """
    parts = [evenness_p(encoding, length, statistic, squares)]
    if len(set(CLASS[[ord(c) for c in ENCODINGS[encoding]]].tolist())) > 1:
        parts.append(upper_tail(length - 1, changes, MOST_CHANGES))
    if pairs:
        parts.append(upper_tail(pairs, pairs - alternations, 1 - rate))
    if letters and encoding in HEXADECIMAL:
        parts.append(hexadecimal**letters)
    half = -sum(math.log(max(p, 1e-300)) for p in parts)
    return min(1.0, math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(parts))))


def p_bin(p: float) -> int:
    """Bin of a p-value, from large to small; its largest member stands for all of it."""
    return min(LAST_BIN, int(-math.log10(max(p, 1e-300)) * BINS_PER_DIGIT))


def string_class(encoding: int, length: int) -> int:
    """The class of encoding and length inside which discoveries are controlled."""
    return encoding * len(LENGTH_CLASSES) + sum(length >= low for low in LENGTH_CLASSES) - 1


def thresholds(counts: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> dict[int, int]:
    """Per class the first bin of discoveries, given the candidates in each (class, bin)."""
    first = {}
    for k in {c for c, _ in counts}:
        total, found = sum(n for (c, _), n in counts.items() if c == k), 0
        for b in range(LAST_BIN, -1, -1):
            found += counts.get((k, b), 0)
            if found and 10 ** (-b / BINS_PER_DIGIT) <= share * found / total:
                first[k] = b
    return first


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


JUDGED = {"starts": "long", "ends": "long", "encodings": "int", "statistics": "double", "changes": "int", "pairs": "int",
          "alternations": "int", "letters": "int", "random": "boolean"}


CORPUS = {"squares": "double", "signs": "long", "all_letters": "long", "hex_letters": "long", "neighbours": "long", "alternating": "long"}


def _scan(texts: list[str]) -> dict:
    names = ("base", "n_assign", "n_access", "n_hex", "base_sha256", *JUDGED, *CORPUS)
    out: dict[str, list] = {k: [] for k in names}
    for text in texts:
        base = base_spans(text)
        written = _written(base)
        strings = candidates(text, base)
        kinds = [k for *_, k in base]
        values = (written, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(written.encode()).hexdigest(),
                  *(map(list, zip(*strings)) if strings else ([] for _ in JUDGED)), *evenness(text), *vowel_changes(text))
        for name, value in zip(names, values):
            out[name].append(value)
    return out


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined; base_sha256 is over
    the base spans alone. Null text counts as empty. Repeated rows each have a row; an empty table gives none; further
    columns are ignored. Texts are read once. From then on only spans and statistics are used, and only the corpus's
    evenness, alternation and letters and the counts per class of encoding, length and p-value reach the driver.
    """
    arrays = ", ".join(f"{name} array<{kind}>" for name, kind in JUDGED.items())
    sums = ", ".join(f"{name} {kind}" for name, kind in CORPUS.items())
    fields = f"base string, n_assign long, n_access long, n_hex long, base_sha256 string, {arrays}, {sums}"
    texts = docs.select("doc_id", whole_text(docs).alias("text"))
    scanned = stored(map_rows(texts, _scan, fields, ["text"], ["doc_id"]), "secret-scan")
    corpus = scanned.agg(F.sum(F.col("squares") * F.col("signs")).alias("squares"), *(F.sum(c).alias(c) for c in list(CORPUS)[1:])).first()
    even, rate, hexadecimal = ((corpus[part] or 0) / (corpus[whole] or 1) for part, whole in (
        ("squares", "signs"), ("alternating", "neighbours"), ("hex_letters", "all_letters")))
    arrays = list(JUDGED)

    def judged(*columns):
        for row in zip(*columns):
            yield [(s, e, string_class(k, e - s), p_bin(p_value(k, e - s, *rest, even, rate, hexadecimal)) if random else 0)
                   for s, e, k, *rest, random in zip(*row)]

    def binned(*columns: list) -> dict:
        pairs = [(c, b) for row in judged(*columns) for _, _, c, b in row]
        at = [k for k, row in enumerate(columns[0]) for _ in row]
        return {"at": at, "class": [c for c, _ in pairs], "bin": [b for _, b in pairs]}

    counts = map_rows(scanned, binned, "class int, bin int", arrays, []).groupBy("class", "bin").agg(F.count("*").alias("n")).collect()
    first = thresholds({(r["class"], r["bin"]): r["n"] for r in counts})

    def combined(base: list[str], *columns: list) -> dict:
        spans, n = [], []
        for written, row in zip(base, judged(*columns)):
            known = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in written.split(",") if x)]
            new = [(s, e, "random") for s, e, c, b in row if c in first and b >= max(1, first[c])]
            spans.append(_written(sorted(known + new, key=lambda x: (x[0], KINDS.index(x[2])))))
            n.append(len(new))
        return {"n_random": n, "spans": spans}

    keep = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    return map_rows(scanned, combined, "n_random long, spans string", ["base", *arrays], keep)
