import hashlib
import math
import random
import re

from lectura.llm.secrets import (
    ENCODINGS, SETS, base_spans, battery, candidates, evenness_p, p_bin, p_value, scan_documents, string_class, thresholds, upper_tail,
)

DOCS = "doc_id long, text string, spans string, source int"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def plain(text):
    kinds = (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0))
    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p, least, g) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [s for *_, s in sorted(found)]


def test_base_spans_are_the_plain_ones():
    rnd = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "ſecret", "toKen", " = ", ":", "'", '"', "AKIA", "AKIAAKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", " ", "\n",
            "=", "/", ".", "-", "xyz", "deadbeef" * 4, "secretsecret=abcdefgh", "\t"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14)))
        assert [f"{k}:{s}:{e}" for s, e, k in base_spans(text)] == plain(text), text


def test_battery_tells_random_from_written():
    rnd = random.Random(8)
    random_ones = ["".join(rnd.choice(BASE64) for _ in range(40)) for _ in range(200)]
    assert sum(battery(s)[2] for s in random_ones if battery(s)) >= 195
    for s in ("getElementsByTagNameAndClassName2", "AAAAAAAAAAAAAAAAAAAAbbbbbbbbbbbb", "0123456789ABCDEF0123456789ABCDEFx", "aB1aB1aB1aB1aB1aB1aB1aB1aB1aB1"):
        assert not battery(s)[-1] or s.startswith("get"), s
    assert battery("a.b.c.d.e.f.g.h.i.j") is None  # in no alphabet


def test_strings_of_one_class_and_of_16_characters_are_judged():
    """Of random strings, tests leave nearly all; words of the corpus's kind have no small p-value."""
    rnd = random.Random(12)
    text = (0.07, 0.6, 0.3)  # evenness, alternation and share of a to f of prose
    least = {"abcdefghijklmnopqrstuvwxyz": 0.5, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 0.5, BASE64: 0.9, "0123456789abcdef": 0.5}
    for alphabet, share in least.items():
        for n in (16, 18, 24, 40):
            strings = ["".join(rnd.choice(alphabet) for _ in range(n)) for _ in range(100)]
            found = [c for s in strings for c in candidates(s, base_spans(s))]
            assert len(found) == sum(not base_spans(s) for s in strings) and sum(c[-1] for c in found) >= 0.97 * len(found)
            small = [p_value(c[2], c[1] - c[0], *c[3:-1], *text) < 0.05 for c in found]
            assert sum(small) >= share * len(small), (alphabet, n)
    for word in ("internationalization", "characteristically", "incomprehensibilities", "getElementsByTagNameAndClass"):
        _, statistic, *rest, _ = battery(word)
        encoding = battery(word)[0]
        assert p_value(encoding, len(word), statistic, *rest, *text) > 0.02, word


def plain_battery(s):
    """The battery by its formulas, character by character."""
    encoding = next(k for k, e in enumerate(SETS) if set(s) <= e)
    alphabet, n = ENCODINGS[encoding], len(s)
    size = len(alphabet)
    statistic = sum((s.count(c) - n / size) ** 2 / (n / size) for c in alphabet)
    kind = lambda c: "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "sign"
    pairs = [(a, b) for a, b in zip(s, s[1:]) if kind(a) == kind(b) and a.isalpha()]
    vowel = lambda c: c.lower() in "aeiou"
    changes = sum(kind(a) != kind(b) for a, b in zip(s, s[1:]))
    k = size - 1
    even = ((statistic / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k))
    halves = [alphabet.index(c) >= size / 2 for c in s]
    runs = (sum(a != b for a, b in zip(halves, halves[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    centred = [alphabet.index(c) - (size - 1) / 2 for c in s]
    serial = sum(a * b for a, b in zip(centred, centred[1:])) / (math.sqrt(n - 1) * (size**2 - 1) / 12)
    return (encoding, statistic, changes, len(pairs), sum(vowel(a) != vowel(b) for a, b in pairs), sum(map(str.isalpha, s)),
            max(even, abs(runs), abs(serial)) <= 3.3)


def test_battery_and_combination_by_their_formulas():
    rnd = random.Random(21)
    for _ in range(400):
        alphabet = rnd.choice(ENCODINGS)
        alphabet = rnd.choice((alphabet, alphabet[: rnd.randint(1, len(alphabet))]))
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(16, 90)))
        got, want = battery(s), plain_battery(s)
        assert got[:1] + got[2:] == want[:1] + want[2:] and abs(got[1] - want[1]) < 1e-6, s
        encoding, statistic, changes, pairs, alternations, letters, _ = got
        kinds = {("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s") for c in ENCODINGS[encoding]}
        tail = lambda n, k, r: sum(math.comb(n, x) * r**x * (1 - r) ** (n - x) for x in range(k, n + 1))
        parts = [evenness_p(encoding, len(s), statistic, 0.07)]
        parts += [tail(len(s) - 1, changes, 1 / 3)] if len(kinds) > 1 else []
        parts += [tail(pairs, pairs - alternations, 0.4)] if pairs else []
        parts += [0.3**letters] if letters and len(ENCODINGS[encoding]) == 16 else []
        half = -sum(math.log(max(p, 1e-300)) for p in parts)
        fisher = math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(parts)))
        p = p_value(encoding, len(s), statistic, changes, pairs, alternations, letters, 0.07, 0.6, 0.3)
        assert math.isclose(p, min(1, fisher), rel_tol=1e-6, abs_tol=1e-290), s
    assert upper_tail(5, 0, 0.3) == 1 and upper_tail(3, 4, 0.3) == 0 and math.isclose(upper_tail(2, 2, 0.5), 0.25)


def test_discoveries_are_those_of_benjamini_and_hochberg():
    """Against the procedure on sorted p-values, every value at the largest member of its bin."""
    rnd = random.Random(2)
    for _ in range(60):
        values = [10 ** -rnd.uniform(0, rnd.choice((2, 9))) for _ in range(rnd.randint(1, 80))]
        bins = [p_bin(p) for p in values]
        counts = {(7, b): bins.count(b) for b in bins}
        first = thresholds(counts, 0.01)
        ordered = sorted(10 ** (-b / 20) for b in bins)
        most = max((k for k, p in enumerate(ordered, 1) if p <= 0.01 * k / len(ordered)), default=0)
        assert sum(7 in first and b >= first[7] for b in bins) == most
    assert string_class(0, 16) != string_class(0, 20) != string_class(1, 20)


def test_false_discovery_threshold():
    counts = {(0, 0): 900, (0, p_bin(1e-6)): 10, (1, 0): 10**6, (1, p_bin(1e-3)): 10}
    first = thresholds(counts)
    assert first[0] <= p_bin(1e-6) and 1 not in first


def test_documents(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(200)), "x", 1) for k in range(40)]
    rows += [(100 + k, "é " + " ".join(rnd.choice(words) for _ in range(80)) + " key " + "".join(rnd.choice(BASE64) for _ in range(48)) + " end", None, 2) for k in range(10)]
    rows += [(200, None, "", 0), (201, "", None, None), (202, 'password: "hunter2hunter2" deadbeef' + "0" * 32, "", 0), (None, "TOKEN=abcdefgh", "", 0)]
    rows += [(203, "InternationalizationConfigurationManager1 " * 30_000, "", 0)]
    got = {r["doc_id"]: r for r in scan_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        base = plain(text or "")
        r = got[doc_id]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == base and len(spans) - len(base) == r["n_random"]
        if doc_id is not None and doc_id < 100 or doc_id == 203:
            assert r["n_random"] == 0
    assert sum(got[100 + k]["n_random"] for k in range(10)) >= 9
    start = rows[40][1].index(" key ") + 5
    assert got[100]["spans"] == f"random:{start}:{start + 48}"


def test_empty_table(spark):
    assert scan_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_values_behind_names_and_beside_base_spans_are_judged():
    rnd = random.Random(4)
    value = "".join(rnd.choice(BASE64) for _ in range(40))
    hexes = "0123456789abcdef" * 2
    for before in ("AWS_SECRET_ACCESS_KEY=", "client_key=", "?sig=", "a=b=", hexes + "_", "token: 'abcdefgh' ", ""):
        for after in ("", "==", "=" + hexes, "_" + hexes):
            text = f"x {before}{value}{after} {hexes}"
            base = base_spans(text)
            found = candidates(text, base)
            assert any(value in text[s:e] and e - s <= 42 for s, e, *_ in found), text
            assert not any(s < f and c < e for s, e, *_ in found for c, f, _ in base), text
