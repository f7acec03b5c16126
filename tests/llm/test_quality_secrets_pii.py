import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import pii, quality, secrets

from .cases import SCHEMA, odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "cc ", "\n", "# ", "d\t"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.digest(quality.assess(rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(texts[r.doc_id])


def test_quality_lines(spark):
    body = "This is a sentence that says something of use to its readers today. Here comes another one with yet more for them to read and think about."
    texts = [body, f"{body}\nHome | About | Contact\nLicensed under the Apache License, Version 2.0.", "Home | About | Contact\nAll rights reserved\n" * 6 + body, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess(rows).collect()}
    assert got[0].kept and got[0].clean_text == body
    assert got[1].kept and got[1].clean_text == body
    assert not got[2].kept
    assert not got[3].kept and got[3].n_words == 0
    assert [r.text for r in quality.clean(rows).orderBy("doc_id").collect()] == [body, body]


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


PIECES = ["é", " ", "\n", "token", "TOKEN", "api_key", "apikey", "password", " = ", ": ", '"', "abcdef12", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "x", "日", "="]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_secret_patterns_equal_brute_force(parts):
    import pyarrow as pa
    import public_tokenizers

    from evidentia.llm.common import TextBatch

    text = "".join(parts)
    batch = TextBatch(pa.array([text]))
    start, end, _ = batch.words()
    long = [(int(a), int(b)) for a, b in zip(start, end, strict=True) if b - a >= 16]
    raw = text.encode()
    test = secrets._tests.setdefault("t", secrets.TokenEfficiency(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    got = [(len(raw[:a].decode()), k, len(raw[:b].decode())) for a, k, b in secrets.spans_of(raw, long, test, 2.1) if k < 3]
    assert got == brute_secrets(text)


def test_random_strings(spark):
    texts = ["the value sk4eC39HqLyjWDarjtT1zdp7dcQx here", "see 9b0b3c6a-43eb-78aa-99cb-d7049c572391 there", "call get_element_by_identifier_name now", "plain words, nothing in them that is odd", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(rows)).collect()}
    assert [got[i].n_random for i in range(5)] == [1, 0, 0, 0, 0]
    masked = {r.doc_id: r.text for r in secrets.redact(secrets.scan(rows)).collect()}
    assert masked[0] == "the value [secret] here" and masked[3] == texts[3] and masked[4] is None


def test_random_strings_of_one_case(spark):
    texts = ["qzvxkjwplmtrbghdnfcyqzvx", "XQZPT-WJKRV-BNMLH-QWHZX", "donaudampfschifffahrtsgesellschaft", "CONFIGURATION_DIRECTORY_PATH", "2024-01-15-10-22-33-44-55", "ha" * 20, "0123abcd-0123-abcd-0123-0123456789ab"]
    rows = spark.createDataFrame(list(enumerate(f"see {t} here" for t in texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_random for r in secrets.digest(secrets.scan(rows)).collect()}
    assert [got[i] for i in range(len(texts))] == [1, 1, 0, 0, 0, 0, 0]


def test_planted_random_strings_are_found_and_others_are_not(spark):
    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {
        "both cases": lambda: draw(low + up + digits, rng.randrange(24, 44)), "url-safe": lambda: draw(low + up + digits + "-_", 32).strip("-_") + "Ab1", "padded": lambda: draw(low + up + digits, 30) + "==",
        "lower": lambda: draw(low, 28), "upper": lambda: draw(up, 28), "one capital": lambda: draw(up, 1) + draw(low, 27), "dotted": lambda: ".".join("aB1" + draw(low + up + digits, 12) for _ in range(3)),
    }
    planted = [(kind, f"set {(value := make())} here", value) for kind, make in kinds.items() for _ in range(200)]
    clean = [
        "https://www.example.com/playlist?list=PLrAXtmErZgOeiKm4sgNOknGvNjby9efdf", "https://example.org/a-long-path/with-many-words/and-a-title-of-an-article.html", "getElementsByClassNameOrIdentifier",
        "org.apache.spark.sql.execution.streaming", "internationalization-and-localization", "2024-01-15T10:22:33.123456789", "Rindfleischetikettierungsueberwachungsaufgabe", "configuration_directory_path_separator",
        "anticonstitutionnellement", "electroencefalografista", "1234567890123456789012345", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "9b0b3c6a-43eb-78aa-99cb-d7049c572391", "/usr/local/share/applications/defaults",
        "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "https://open.spotify.com/playlist/37i9dQZF1DXcBWIGoYBM5M", "https://docs.example.com/document/d/1BxiMVs0XRA5nFMdKvBdBZjgmUUqptlbs74OgvE2upms/edit",
    ]
    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(planted)] + [(10_000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") if r.spans else [] for r in secrets.digest(secrets.scan(rows)).collect()}
    for kind in kinds:
        own = [i for i, (k, _, _) in enumerate(planted) if k == kind]
        assert sum(got[i] == [f"random:4:{4 + len(planted[i][2])}"] for i in own) >= 0.95 * len(own), kind
    assert {t: got[10_000 + i] for i, t in enumerate(clean) if any(s.startswith("random") for s in got[10_000 + i])} == {}


def test_keys_in_a_path_are_found(spark):
    key = "q7ZxT2mLw9KdR4vB8nYc3HpF"
    texts = [f"https://hooks.example.com/services/T0A1B2C3D/B9Z8Y7X6W/{key}", f"https://example.com/webhook/{key}", f"https://example.com/x?token={key}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("random") or s.startswith("assign")] for r in secrets.digest(secrets.scan(rows)).collect()}
    for i, t in enumerate(texts):
        assert got[i] and all(int(s.split(":")[1]) <= t.index(key) and int(s.split(":")[2]) == len(t) for s in got[i]), (t, got[i])


def test_shorter_runs_by_parameter(spark):
    rows = spark.createDataFrame([(1, "set q7ZxT2mLw9KdR4 here")], "doc_id long, text string")
    assert [r.n_random for least in (20, 14) for r in secrets.digest(secrets.scan(rows, least=least)).collect()] == [0, 1]


@pytest.mark.parametrize("part", [b"aB1x9Qz7.Kq3Zp8Lm.", b"https://a.b/c/", b"x=1&", b"wordy.words.", b"://?=/aB1x9Qz7Kq3Zp8LmW2e4"])
def test_one_word_of_megabytes_takes_seconds(part):
    import public_tokenizers

    test = secrets.TokenEfficiency(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = part * (4_000_000 // len(part))
    began = time.perf_counter()
    secrets.spans_of(text, [(0, len(text))], test, 2.1)
    assert time.perf_counter() - began < 20


def test_many_secrets_take_seconds():
    import public_tokenizers

    test = secrets.TokenEfficiency(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(24)) for _ in range(20_000)]
    text = " ".join(words).encode()
    at = np.cumsum([0] + [len(w) + 1 for w in words])
    began = time.perf_counter()
    assert len(secrets.spans_of(text, [(int(a), int(a) + len(w)) for a, w in zip(at, words)], test, 2.1)) > 18_000
    assert time.perf_counter() - began < 20


def test_wrapped_prose_stays(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 10)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(8, 28))).capitalize() + "."
    texts = ["\n\n".join(textwrap.fill(" ".join(sentence() for _ in range(6)), width) for _ in range(8)) for width in (30, 60, 80, 100)]
    junk = "\n".join(f"buy cheap shoes online now {word()}" for _ in range(9))
    rows = spark.createDataFrame(list(enumerate([*texts, junk, f"{texts[1]}\n\n{junk}\n"])), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess(rows).collect()}
    assert all(got[i].kept and got[i].lost_share < 0.05 and got[i].clean_text == t for i, t in enumerate(texts))
    assert not got[4].kept and got[4].clean_text == "" and got[5].kept and got[5].clean_text == texts[1] + "\n\n"


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(0, *m.span()) for m in pii.EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in pii.CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return found + [(3, *m.span()) for m in pii.PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


PARTS = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "23", "4111", "1111", "0", "255", "256", "com", "x.y", "@b.c", "４"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_pii_patterns_equal_brute_force(parts):
    text = "".join(parts)
    assert pii.plain_spans(text, sum(c in "0123456789" for c in text)) == brute_pii(text)


def test_pii_in_linear_time():
    size = 10**6
    long = ("a" * size, "x@y.zz" + "a" * size, "1" * size + ".2", "1." * (size // 2), "a" * size + " @ b", "a." * (size // 2) + " (at) b", "+" + " " * size, "a@" * (size // 2), "one " * (size // 4), "1 " * (size // 2), "x at " * (size // 5) + "(dot)")
    for text in long:
        began = time.perf_counter()
        pii.spans_of(text, sum(text.count(c) for c in "0123456789"), text.lower())
        assert time.perf_counter() - began < 10, text[:10]


def test_mapped_spans_equal_what_was_planted():
    rng = random.Random(12)
    spelled = "zero one two three four five six seven eight nine".split()
    alike = {v: k for k, v in pii.ALIKE.items()}
    pick = lambda *x: rng.choice(x)
    name = lambda: "".join(rng.choice("bdfgklmntrw") + rng.choice("aeio") for _ in range(rng.randrange(2, 5)))
    dots = (" dot ", "[dot]", "(dot)", " [.] ", "{dot}", " DOT ")
    for _ in range(600):
        kind = rng.randrange(4)
        if kind == 0 and rng.random() < 0.5:
            dot = rng.choice(dots)
            hidden = name() + pick(" at ", "(at)", " [at] ", " @ ", "{at}") + name() + dot + pick("com", "org", "net")
        elif kind == 0:
            label = name()
            i = rng.choice([i for i, c in enumerate(label) if c in alike])
            hidden = f"{name()}@{label[:i]}{alike[label[i]]}{label[i + 1 :]}.com"
        elif kind == 1:
            hidden = pick(*dots[:3]).join(str(rng.randrange(256)) for _ in range(4))
        else:
            digits = "".join(rng.choice("0123456789") for _ in range(15 if kind == 2 else 11))
            if kind == 2:
                digits += next(d for d in "0123456789" if pii.luhn(digits + d))
            words = " ".join(spelled[int(d)] for d in digits)
            hidden = words if kind == 2 else "plus " + words
        before, after = "Ünlike all ﬁgures: " * rng.randrange(3) + "see ", ", and more"
        text = before + hidden + after
        plain, every = pii.spans_of(text, sum(c in "0123456789" for c in text), text.lower())
        assert (plain, [(k, text[a:b]) for k, a, b in every]) == ([], [(kind, hidden)]), text


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to john (at) example dot com today", "email", "john (at) example dot com"),
        ("j.doe[at]mail[dot]example[dot]org", "email", "j.doe[at]mail[dot]example[dot]org"),
        ("аdmin@exаmple.com", "email", "аdmin@exаmple.com"),
        ("ip １９２.１６８.１.１ up", "ip", "１９２.１６８.１.１"),
        ("plus four nine one seven two three four five six seven eight", "phone", "plus four nine one seven two three four five six seven eight"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises(text, kind, source):
    plain, every = pii.spans_of(text, sum(c in "0123456789" for c in text), text.lower())
    assert (kind, source) in [(pii.KINDS[k], text[a:b]) for k, a, b in every if (k, a, b) not in plain]


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("host 192[.]168[.]1[.]10 up", "ip", "192[.]168[.]1[.]10"),
        ("host 192(dot)168(dot)1(dot)10, up", "ip", "192(dot)168(dot)1(dot)10"),
        ("host 192 dot 168 dot 1 dot 10 up", "ip", "192 dot 168 dot 1 dot 10"),
        ("at one two seven dot zero dot zero dot one today", "ip", "one two seven dot zero dot zero dot one"),
        ("at one nine two.one six eight.1.one zero today", "ip", "one nine two.one six eight.1.one zero"),
        ("at 127.zero.zero.1 today", "ip", "127.zero.zero.1"),
        ("call +1 555 867 five three oh nine now", "phone", "+1 555 867 five three oh nine"),
        ("call +1 (five five five) 867-5309 now", "phone", "+1 (five five five) 867-5309"),
        ("call plus one 555 867 5309 now", "phone", "plus one 555 867 5309"),
        ("card 4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
    ],
)
def test_dot_and_short_digit_disguises(text, kind, source):
    plain, every = pii.spans_of(text, sum(c in "0123456789" for c in text), text.lower())
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in every if (k, a, b) not in plain] == [(kind, source)]


def test_prose_beside_digits_is_left_alone():
    for text in ("one. two. three. four", "1. 2. 3. 4", "in 2024 one of 300 dot 400 dot 500 dot 600", "five plus 20 one 30", "version 1 dot 2 dot 3", "un 3 deux 4 sept 12"):
        assert pii.spans_of(text, sum(c in "0123456789" for c in text), text.lower()) == ([], [])


def test_prose_is_left_alone():
    for text in ("meet at example.com at noon", "one two three", "un un un un un un un", "he was at home. dot com was new"):
        assert pii.spans_of(text, 0, text.lower())[1] == []


def test_odd_rows(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    for run in (lambda d: quality.assess(d), lambda d: secrets.scan(d), lambda d: pii.find(d), lambda d: secrets.redact(secrets.scan(d)), quality.clean):
        out = run(rows)
        assert out.count() <= rows.count()
        assert set(rows.columns) <= set(out.columns)
        assert run(rows.limit(0)).count() == 0
    assert quality.digest(quality.assess(rows)).count() == rows.count()
    assert pii.digest(pii.find(rows)).count() == rows.count()
    assert secrets.digest(secrets.scan(rows)).count() == rows.count()
