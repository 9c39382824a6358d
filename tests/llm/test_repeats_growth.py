"""Repeated strings: what goes between tasks, and the result when everything is dealt out small."""

import random

import numpy as np
import pytest

from proxyspark.llm import common, substrings
from tests.llm.conftest import rows_of
from tests.llm.test_text_operators import COLUMNS, plain_removal


@pytest.fixture
def written(monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    return lambda name: f"file://{tmp_path}/{name}"


@pytest.fixture
def dealt_small(monkeypatch):
    for name, value in (("READS_TOGETHER", 6), ("COLLECTION_BYTES", 2_000), ("GROUP_BYTES", 3_000), ("PART_BYTES", 4_000)):
        monkeypatch.setattr(substrings, name, value, raising=False)


def letters(rng, n):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(n))


def test_chance_anchors_are_not_sent(spark, docs_of, written):
    """Short phrases that many documents have are no reason to keep the text around them."""
    rng = random.Random(3)
    phrases = [letters(rng, 24) for _ in range(30)]
    docs = [(k, " ".join(rng.choice(phrases) + letters(rng, 9) for _ in range(40))) for k in range(200)]
    assert rows_of(substrings.remove_repeats(docs_of(docs)), *COLUMNS) == plain_removal(docs)
    assert spark.read.parquet(written("reads")).count() == 0


def test_rows_follow_groups_and_not_places(spark, docs_of, written):
    rng = random.Random(4)
    lines = [letters(rng, 90) for _ in range(20)]
    docs = [(k, "\n".join(rng.choice(lines) + letters(rng, rng.randrange(30)) for _ in range(30))) for k in range(200)]
    assert rows_of(substrings.remove_repeats(docs_of(docs)), *COLUMNS) == plain_removal(docs)
    for table in ("reads", "firsts"):
        assert spark.read.parquet(written(table)).count() <= 3


def test_small_groups_parts_and_collections(spark, docs_of, dealt_small):
    rng = random.Random(5)
    lines = [letters(rng, n) for n in (34, 49, 50, 51, 60, 66, 67, 90, 140, 300)] + ["ab" * 70, "é" * 60, "x" * 130]
    docs = [(rng.randrange(-40, 90), "".join(rng.choice(lines) if rng.random() < 0.6 else letters(rng, rng.randrange(40)) for _ in range(rng.randrange(8))))
            for _ in range(150)]
    docs += [(200 + k, f"{letters(rng, 20)}{lines[7]}{letters(rng, 20)}") for k in range(60)]
    docs += [docs[3], docs[7], (300, docs[7][1]), (301, lines[9][:60] + lines[9][70:]), (None, lines[9]), (302, None), (-2**63, lines[8]), (2**63 - 1, lines[8])]
    docs = [(d, t if t is None else t[rng.randrange(3):]) for d, t in docs] + [docs[5], docs[5]]
    got = rows_of(substrings.remove_repeats(docs_of(docs).repartition(5)), *COLUMNS)
    assert got == plain_removal(docs) and sum(r[2] > 0 for r in got) > 100
    # another length, with an odd number of bytes beside an anchor
    got = rows_of(substrings.remove_repeats(docs_of(docs).repartition(3), 37, 8), *COLUMNS)
    assert got == plain_removal(docs, 37)


def test_equal_strings_have_equal_keys():
    rng = random.Random(6)
    phrases = [letters(rng, n) for n in (20, 33, 55, 80)] + ["a" * 70, "ab" * 40]
    texts = ["".join(rng.choice(phrases) for _ in range(8)).encode() for _ in range(60)]
    sizes = np.array([len(t) for t in texts])
    begins, data = np.cumsum(sizes) - sizes, b"".join(texts)
    key_of, seen = {}, set()
    for text, begin, stop, anchor, split, left, right in zip(*substrings.reads_of(np.frombuffer(data, np.uint8), begins, sizes)):
        for at in range(begin, stop - 50 + 1):
            key = (anchor, left if at < split else right)
            assert key_of.setdefault(data[at:at + 50], key) == key
            assert at not in seen and begins[text] <= at <= begins[text] + sizes[text] - 50
            seen.add(at)
    assert len(seen) == sum(sizes - 49)


def test_first_owner_of_strings_that_fold():
    rng = random.Random(7)
    line = letters(rng, 70)
    for _ in range(20):
        strings = list({(letters(rng, rng.randrange(9)) + line[rng.randrange(12):][:rng.randrange(52, 70)] + letters(rng, rng.randrange(9))).encode()
                        for _ in range(rng.randrange(1, 30))} | {letters(rng, 60).encode(), b"q" * 120})
        owners = np.array([rng.randrange(-9, 9) for _ in strings])
        firsts, count = substrings.first_of_strings(strings, owners, 50)
        least = {}
        for s, o in zip(strings, owners):
            for k in range(len(s) - 49):
                least[s[k:k + 50]] = min(o, least.get(s[k:k + 50], o))
        assert firsts.tolist() == [least[s[k:k + 50]] for s in strings for k in range(len(s) - 49)]
        assert count.tolist() == [len(s) - 49 for s in strings]
