"""Secret scans: fixed patterns plus a token-efficiency test.

A random string needs many tokens: its characters per token under a public
byte-pair vocabulary are few.  Candidate strings (16 characters or more of the
key alphabet, at least one of them a letter: random digits have more characters
per token than the limit) below ``MAX_CHARS_PER_TOKEN`` are secrets, also the
parts of a string beside a pattern's match; strings without a digit under 20
characters must be below ``SHORT_LETTERS``, small letters (after the first) below
``SHORT_LOWER``, as rare words come near.  Not so if they are known digests or identifiers (UUIDs, hex digests that
a digest name introduces, object ids of version control, data URIs, addresses).

Null and empty texts give no spans.  Texts are taken whole; spans count code
points, end exclusive.  Rows repeat as given.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import id_text, tidy

KINDS = ("assign", "access", "hex", "random")
# The patterns and least lengths of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the same runs as [0-9a-f]+ of 16 characters or more
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")

MAX_CHARS_PER_TOKEN = 2.0
SHORT, SHORT_LETTERS, SHORT_LOWER = 20, 1.8, 1.6
LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128}")
_DIGEST_NAME = re.compile(r"(md5|sha-?1|sha-?256|sha-?512|digest|checksum|commit|etag|integrity)\W{0,4}$", re.I | re.A)
_ADDRESS = re.compile(r"(://|www\.|@)\S*$")


@cache
def _vocabulary(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class _Free:
    """What the base spans leave free; asked for runs from left to right."""

    def __init__(self, base: list[tuple[int, int, str]]):
        self.taken: list[list[int]] = []  # apart from each other, in order
        for s, e, _ in sorted(base):
            if self.taken and s <= self.taken[-1][1]:
                self.taken[-1][1] = max(self.taken[-1][1], e)
            else:
                self.taken.append([s, e])
        self.at = 0

    def parts(self, start: int, end: int) -> list[tuple[int, int]]:
        """Free parts of [start, end) of ``LEAST`` characters or more."""
        while self.at < len(self.taken) and self.taken[self.at][1] <= start:
            self.at += 1
        out, k = [], self.at
        while k < len(self.taken) and self.taken[k][0] < end:
            out.append((start, self.taken[k][0]))
            start = max(start, self.taken[k][1])
            k += 1
        return [(s, e) for s, e in [*out, (start, end)] if e - s >= LEAST]


def random_spans(text: str, path: str, most: float = MAX_CHARS_PER_TOKEN, base: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    out, free = [], _Free(base or [])
    for m in _CANDIDATE.finditer(text):
        if _UUID.fullmatch(m.group()) or _ADDRESS.search(text[max(0, m.start() - 40) : m.start()]):
            continue
        for start, end in free.parts(m.start(), m.end()):
            x = text[start:end]
            if not _LETTER.search(x):
                continue
            if _DIGEST.fullmatch(x) and _DIGEST_NAME.search(text[max(0, start - 40) : start]):
                continue
            limit = most
            if len(x) < SHORT and not _DIGIT.search(x):
                limit = min(most, SHORT_LOWER if x[1:].islower() else SHORT_LETTERS)
            if len(x) < limit * len(_vocabulary(path).encode_ordinary(x)):
                out.append((start, end, "random"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in order)


def find(text: str, path: str, most: float = MAX_CHARS_PER_TOKEN) -> tuple[list, list]:
    """``(base spans, the method's further spans)``; the method says nothing
    about places that a base span covers."""
    base = base_spans(text)
    return base, random_spans(text, path, most, base)


def secret_scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``."""
    path = path or vocabulary()
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def scan(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for t in part.column(1).to_pylist():
                    base, more = find(t, path)
                    n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                    rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols))], names=names
                )

    return id_text(docs).mapInArrow(tidy(scan), schema)


def redact(docs: DataFrame, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; every found span in ``text`` is
    replaced by ``mark`` (overlapping spans by one), ``n_chars`` follows if
    there is such a column.  A null text stays null."""
    path = path or vocabulary()
    out = docs.schema

    def clean(text: str) -> str:
        spans = sorted((s, e) for s, e, _ in sum(find(text, path), []))
        parts, at = [], 0
        for s, e in spans:
            if s >= at:
                parts += [text[at:s], mark]
            at = max(at, e)
        return "".join(parts) + text[at:] if spans else text

    def rewrite(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                k = part.schema.get_field_index("text")
                texts = pa.array([None if t is None else clean(t) for t in part.column(k).to_pylist()], part.schema.field(k).type)
                yield part.set_column(k, part.schema.field(k), texts)

    done = docs.mapInArrow(tidy(rewrite), out)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(out["n_chars"].dataType))
    return done
