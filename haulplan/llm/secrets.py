"""Secrets in free text: plain patterns, and strings that a primed compressor cannot predict.

The pattern kinds are ``assign``, ``access`` and ``hex``. The method adds
``novel``: a long mixed string beside a sensitive word, whose marginal
cost in zstandard bytes stays near its cost alone although the compressor knows the
surrounding text, other copies of the string apart, and a dictionary of
identifiers. Strings built from known
names compress away and are not reported.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import key_type, map_batches, rows_of

KINDS = ("assign", "access", "hex", "novel")

# The three pattern kinds. Letters of an assignment's name stand in either case.
_NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, _NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Words that make a context sensitive (alone, in camel case, in the plural), and how far before or behind them a candidate may stand.
SENSITIVE = re.compile(
    "(?:(?<![A-Za-z])|(?<=[A-Za-z])(?=[A-Z][a-z]))(?:" + "|".join(
        map(_either_case, ("password", "passwd", "pwd", "secret", "token", "api_?key", "access_?key", "private_?key",
                           "key", "credential", "auth", "authorization", "bearer", "signature"))
    ) + ")[sS]?(?![a-z])"
)
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters and digits that random strings are drawn from, smallest first, and their number.
ALPHABETS = [
    (frozenset(x), len(x))
    for x in (
        _DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _LOWER + "234567", _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER, _DIGITS + _LOWER + _UPPER,
    )
]
_NO_MARKS = str.maketrans("", "", "+/_.=-")
_SIGNS = frozenset(_DIGITS + _LOWER + _UPPER + "+/_.=-")

#: What code calls things: part of the compressor's dictionary.
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key secret_key private_key public_key password_hash "
    "authorization_header bearer_token session_token user_password database_url connection_string environment "
    "configuration credentials_file secret_manager token_endpoint example_value placeholder your_token_here "
    "changeme replace_me default_password test_password localhost 127.0.0.1 https://www. http:// .example.com "
    "shipment_id pickup_hub delivery_hub goods_type weight_kg earliest_delivery latest_delivery "
    "0123456789abcdef 0123456789ABCDEF abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx"
)


def pattern_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three pattern kinds; each kind leftmost and non-overlapping."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # a run of hex digits is a maximal match, so asking for sixteen keeps the same runs
    return spans + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def marginal_bytes(candidate: str, before: str, after: str, level: int = 19) -> int:
    """Compressed bytes that ``candidate`` adds to its line, the context being known."""
    known = (IDENTIFIERS + after + before).encode()
    primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)
    lead = before[-REACH:].encode()
    return len(packer.compress(lead + candidate.encode())) - len(packer.compress(lead))


def least_bytes(candidate: str, level: int = 19) -> float:
    """Bytes that ``candidate`` would take at random: compressed without a primer, or by the size of its alphabet if that is more."""
    marks = set(re.sub("[A-Za-z0-9]", "", candidate))
    signs = next(n for signs, n in ALPHABETS if signs.issuperset(candidate.translate(_NO_MARKS)))
    packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    alone = len(packer.compress(candidate.encode())) - len(packer.compress(b""))
    return max(alone, len(candidate) * math.log2(signs + len(marks)) / 8)


def surroundings(text: str, start: int, end: int, context: int) -> tuple[str, str]:
    """``context`` characters on either side of a candidate, without other copies of it, whole or cut by the border.

    A copy is told by the candidate's core: its longest part between equals signs, without marks at the ends.
    """
    core = max(text[start:end].split("="), key=len).strip("+/_.-")
    if len(core) < 16:
        core = text[start:end]
    low, high = max(0, start - context), min(len(text), end + context)
    left, right = min(low, len(core) - 1), min(len(text) - high, len(core) - 1)
    before, after = text[low - left : start].split(core), text[end : high + right].split(core)
    before[0] = before[0][left:]
    after[-1] = after[-1][: max(0, len(after[-1]) - right)]
    return "".join(before), "".join(after)


def candidates(text: str):
    """(start, end) of the candidates beside sensitive words, none twice."""
    done = 0
    for word in SENSITIVE.finditer(text):
        low = max(done, word.start() - REACH)
        while low > done and text[low - 1] in _SIGNS:
            low -= 1
        for found in CANDIDATE.finditer(text, low, word.start()):
            if found.end() < word.start():  # else the word is a part of the same run
                done = found.end()
                yield found.span()
        last = word.end() + REACH
        while found := CANDIDATE.search(text, max(word.end(), done), last + 16):  # sixteen characters tell a candidate
            start, done = found.start(), CANDIDATE.match(text, found.start()).end()
            yield start, done


def novel_spans(text: str, taken: list[tuple[int, str, int]], novelty: float, context: int) -> list[tuple[int, str, int]]:
    """Candidates beside a sensitive word that no pattern has found and that do not compress."""
    spans = []
    for start, end in candidates(text):
        value = text[start:end]
        mixed = re.search("[0-9]", value) and re.search("[A-Za-z]", value)
        if not mixed or any(s < end and start < e for s, _, e in taken):
            continue
        if marginal_bytes(value, *surroundings(text, start, end, context)) >= novelty * least_bytes(value):
            spans.append((start, "novel", end))
    return spans


def find_secrets(shipments: DataFrame, novelty: float = 0.75, context: int = 2048) -> DataFrame:
    """Secret-like spans of every shipment's text.

    Returns one row per input row: ``shipment_id`` and ``spans``, an array of
    (kind, start, end, value) by start, then kind in the order of ``KINDS``;
    offsets are code points, ends exclusive. ``novelty`` is the least marginal
    compressed size of a ``novel`` span as a share of what it takes alone (see ``least_bytes``), ``context``
    how much text on either side primes the compressor. A null or empty text
    has no spans; repeated rows give equal rows. The project's records hold no
    secrets of their own; any free text will do.
    """

    def find(batch: pa.RecordBatch) -> dict:
        out = []
        for text in rows_of(batch, "delivery_hub").to_pylist():
            spans = pattern_spans(text) if text else []
            if text:
                spans += novel_spans(text, spans, novelty, context)
            spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
            out.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for s, k, e in spans])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        return {"shipment_id": rows_of(batch, "shipment_id"), "spans": pa.array(out, pa.list_(kind))}

    spans = "array<struct<kind: string, start: long, end: long, value: string>>"
    return map_batches(shipments.select("shipment_id", "delivery_hub"), find, f"shipment_id {key_type(shipments)}, spans {spans}")
