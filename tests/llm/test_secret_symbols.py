"""Secrets of more symbols than base 64, and of any length at one compression level."""

import random
import string

from proxyspark.llm import secret_scan

SYMBOLS = string.ascii_letters + string.digits + "!#$%&*?@^~"


def _found(text):
    return [text[a:b] for a, _, b in secret_scan.novel_spans(text, secret_scan.base_spans(text))]


def test_passwords_with_punctuation_are_found_whole():
    rng = random.Random(1)
    keys = ["".join(rng.choice(SYMBOLS) for _ in range(rng.choice([16, 20, 24, 40]))) for _ in range(300)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    assert sum(_found(f"please send the bearer {k} along") == [k] for k in keys) >= 0.98 * len(keys)
    assert _found("the bearer Xq9$kP2!vR7#mL4&wT8^zN3 of it") == ["Xq9$kP2!vR7#mL4&wT8^zN3"]


def test_long_ones_are_judged_like_short_ones():
    rng = random.Random(2)
    for size in (4_000, 4_096, 4_097, 9_000):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size))
        assert _found(f"authorization {key}\n") == [key]
        assert _found(f"authorization {'ab12cd34' * (size // 8)}\n") == []


def test_plain_text_behind_sensitive_words_stays():
    for text in ("the secret: whatever-comes-next, said the old man", "token?? no ................ really",
                 "password!!!!!!!!!!!!!!!!!!!!!!", "the bearer ==================== line"):
        assert _found(text) == []
