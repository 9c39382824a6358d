"""Secret scans: fixed patterns, and strings that a primed compressor cannot shorten.

Beside the three pattern kinds, a string near a sensitive word is a candidate.
It is compressed with a dictionary made of common identifiers and the text
around it: what it adds in bytes over an empty message is its novelty. Names,
words and repeats of nearby text cost next to nothing; a key or a password
costs about as many bytes as it carries, and is reported as kind ``novel``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.llm.common import carried, lean, rows_batch

# The pattern kinds, in the order in which they are listed.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

SENSITIVE = re.compile(
    r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization)",
    re.ASCII)
_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
#: Least length of a candidate and the symbols of one: what keys and passwords are made
#: of, so anything printable but quotes, brackets and separators of lists.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=!#$%&*?@^~:-]{{{LEAST},}}")

#: How far behind a sensitive word a candidate may start, and how much text
#: before and after it primes the dictionary, in characters.
REACH, AROUND = 64, 2_000
#: From which share of the bytes that a random string of its length and symbols
#: adds a string counts as random. At 0.45, names of which half is known count too.
NOVELTY = 0.6
#: Bytes that the compressor needs to describe a set of symbols; a shorter string
#: is stored byte for byte.
SYMBOLS = 24
#: Bits per letter from which a string of letters only is no word or name, given
#: how letters follow each other around it: random ones take 8, words 3 to 5.
LETTERS = 5.6

IDENTIFIERS = (
    "password passwd pwd secret token api_key apikey access_key private_key client_id client_secret credential "
    "authorization bearer username user_name user_id email_address session_id request_id response content_type "
    "application/json text/html https://www. http:// .com/ .org/ .net/ localhost 127.0.0.1 /usr/local/bin /home/ "
    "function return import export class static public private protected const default string integer boolean "
    "true false null none undefined self this import_from __init__ __name__ __main__ config configuration "
    "environment variable parameter argument value values index length count number timestamp datetime created_at "
    "updated_at database connection server client service controller manager handler listener callback example "
    "placeholder changeme your_token_here your_api_key xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, redacted string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the three fixed kinds, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def novelty(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> float:
    """Compressed bytes that ``candidate`` adds when the compressor already knows
    ``identifiers`` and the text ``around``, as a share of those that a random
    string of its length and number of symbols adds."""
    known = zstandard.ZstdCompressionDict(f"{identifiers} {around}".encode(errors="replace"),
                                          dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_dict_id=False)
    random = min(len(candidate), len(candidate) * math.log2(max(2, len(set(candidate)))) / 8 + SYMBOLS)
    return (len(packer.compress(candidate.encode())) - len(packer.compress(b""))) / random


def letter_bits(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> float:
    """Bits per character of ``candidate``, each predicted from the one before it by
    the pairs in ``identifiers`` and ``around``, without regard to case. The
    compressor finds no repeats in a new word, though its letters follow a language."""
    known, text = f"{identifiers} {around}".lower(), candidate.lower()
    single, pairs = Counter(known), Counter(zip(known, known[1:]))
    bits = 0.0
    for a, b in zip(" " + text, text):
        alone = (single[b] + 0.5) / (len(known) + 32)
        bits -= math.log2((pairs[a, b] + 4 * alone) / (single[a] + 4))
    return bits / len(text)


def surroundings(text: str, start: int, end: int) -> str:
    """The text around a candidate, in which its other occurrences are blank: a
    secret that is written twice is no less of one."""
    candidate = text[start:end]
    parts = {candidate, candidate.strip("+/_.=!#$%&*?@^~:-"), *re.split("[=.:]+", candidate)}
    parts = sorted((p for p in parts if len(p) >= LEAST), key=len, reverse=True)
    room = AROUND + end - start  # a copy may lie across the edge
    before, after = text[max(0, start - room):start], text[end:end + room]
    for part in parts:
        before, after = (t.replace(part, " " * len(part)) for t in (before, after))
    return before[-AROUND:] + " " + after[:AROUND]


def novel_spans(text: str, taken: list[tuple[int, int, int]], threshold: float = NOVELTY,
                identifiers: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Random-looking strings that start at most ``REACH`` characters behind a
    sensitive word, each to its end, less the spans ``taken``.

    A string is judged whole from its first start. Behind further sensitive words
    in it, it is judged up to the next one, so that no part is read over and over.
    """
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ends = [end for _, end in runs]
    found, seen, judged, done = [], set(), set(), set()
    words = list(SENSITIVE.finditer(text))
    for word, following in zip(words, [*(w.start() for w in words[1:]), len(text)]):
        for start, end in runs[(k := bisect_right(ends, word.end())):k + REACH]:
            start = max(start, word.end())
            if start > word.end() + REACH:
                break
            if start in seen or end in done or end - start < LEAST:
                continue
            seen.add(start)
            stop = min(end, following) if end in judged else end
            judged.add(end)
            candidate = "".join(text[a:b] for a, b in _outside(start, stop, taken))
            if len(candidate) < LEAST:
                continue
            around = surroundings(text, start, stop)
            if novelty(candidate, around, identifiers) >= threshold and (
                    any(c.isdigit() for c in candidate) or letter_bits(candidate, around, identifiers) >= LETTERS):
                found += [(a, 3, b) for a, b in _outside(start, end, taken)]
                done.add(end)
    return sorted(found)


def _outside(start: int, end: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What of ``start`` to ``end`` lies in none of the spans ``taken``, which are in order."""
    out = []
    for a, _, b in taken:
        if b > start and a < end:
            if a > start:
                out.append((start, a))
            start = max(start, b)
    return out + [(start, end)] if start < end else out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans, mark: str) -> str:
    """``text`` with every span's union replaced by ``mark``; of an assignment the
    name stays and its value goes."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if kind == 0:
            start = ASSIGN.match(text, start).start(2)
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def scan(docs: DataFrame, threshold: float = NOVELTY, identifiers: str = IDENTIFIERS, mark: str = "<secret>",
         carry: list[str] = ()) -> DataFrame:
    """Secrets of every whole text: counts per kind, the digest of the fixed
    kinds, all spans, and the text with its secrets replaced by ``mark``.

    One row per row of ``docs``, also where ids repeat; null text counts as empty and
    stays null in ``redacted``; an empty table gives no rows. Extra columns are ignored,
    but for those that ``carry`` names, which a row hands on.
    """
    read, more = carried(docs, carry)

    def run(batches):
        for batch in batches:
            out = [[] for _ in _FOUND.split(", ")]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                base = base_spans(text or "")
                novel = novel_spans(text or "", base, threshold, identifiers)
                spans = sorted(base + novel)
                row = [doc_id, *(sum(k == kind for _, k, _ in spans) for kind in range(4)),
                       hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                       redact(text, spans, mark) if spans else text]
                for column, value in zip(out, row):
                    column.append(value)
            yield rows_batch(_FOUND + more, out + [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in carry])

    return docs.select(*read).mapInArrow(lean(run), _FOUND + more)
