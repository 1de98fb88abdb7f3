"""Secrets of small alphabets, and secrets within paths."""

import random

import pytest

from tidemark.llm import secret_tests

HEX, BASE32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORDINARY = "THE QUICK BROWN FOX JUMPS OVER LAZY DOGS WHILE EVERY OTHER LITTLE HOUSE STANDS UNDER GREEN MORNING LIGHT".split()


def _drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def _added(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: [x for x in r.spans.split(",") if x.startswith("random_")] for r in secret_tests.secret_query(frame).collect()}


@pytest.mark.parametrize(("alphabet", "kind", "n", "least"), [(HEX, "hex", 20, 40), (HEX, "hex", 32, 55), (HEX, "hex", 40, 55), (BASE32, "base32", 20, 40), (BASE32, "base32", 26, 50), (BASE32, "base32", 40, 55)])
def test_small_alphabets_are_found_among_ordinary_candidates(spark, alphabet, kind, n, least):
    rng = random.Random(n)
    planted = [f"key {_drawn(rng, alphabet, n)} end" for _ in range(60)]
    ordinary = [f"at {_drawn(rng, '0123456789', n)} end" if kind == "hex" else f"at {''.join(rng.choice(ORDINARY) for _ in range(n))[:n]} end" for _ in range(60)]
    got = _added(spark, planted + ordinary)
    assert sum(got[k] == [f"random_{kind}:4:{4 + n}"] for k in range(60)) >= least
    assert sum(bool(got[k]) for k in range(60, 120)) <= 3


def test_keys_in_paths_are_found(spark):
    rng = random.Random(8)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = [_drawn(rng, alnum, 40) for _ in range(30)]
    second = _drawn(rng, alnum, 44)
    texts = [f"see https://example.com/reset-password/{key} now" for key in keys]
    texts += [f"at a_b/{keys[0]}/some-thing/or_other/plain/{second} 🙂", f"🙂 x-y/{second}== end", "https://example.com/some-long-words/in_a_path/that-has/no-key-at-all/but-words"]
    got = _added(spark, texts)
    spans = {k: [tuple(map(int, x.split(":")[1:])) for x in v] for k, v in got.items()}
    holds = lambda k, key: any(s <= texts[k].index(key) and e >= texts[k].index(key) + len(key) for s, e in spans[k])
    assert sum(holds(k, key) for k, key in enumerate(keys)) >= 27
    assert holds(30, keys[0]) and holds(30, second) and holds(31, second)
    assert all(a[1] <= b[0] for v in spans.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))
    assert not spans[32]


def test_random_strings_of_usual_lengths_are_found_and_prose_is_not(spark):
    """Of 24 to 64 symbols outside base spans; ordinary candidates are long words, names in code, dates and paths."""
    rng = random.Random(31)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    planted = [f"key {_drawn(rng, alphabet, rng.randrange(24, 65))} end" for alphabet in (HEX, BASE32, base64) for _ in range(120)]
    words = [w.lower() for w in ORDINARY]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    makers = (lambda: "".join(some(8)), lambda: "".join(w.title() for w in some(6)), lambda: "_".join(some(6)), lambda: "/".join(some(7)), lambda: "-".join(some(6)) + "-2024-01-17", lambda: "".join(w.upper() for w in some(7)))
    ordinary = [f"see {rng.choice(makers)()} here" for _ in range(360)]
    got = _added(spark, planted + ordinary)
    found = [sum(bool(got[k]) for k in range(120 * a, 120 * a + 120)) for a in range(3)]
    false = sum(bool(got[k]) for k in range(360, 720))
    print("found of 120 each:", found, "of 360 ordinary:", false)
    assert min(found) >= 108 and false <= 0.02 * (sum(found) + false)
