"""License scans: Aho-Corasick over notices and tags, shunting-yard over
licence expressions.

A text is lower-cased (A-Z) and reduced to its words with one space between
them, so one automaton pass finds every phrase whose words stand together.
``SPDX-License-Identifier`` tags are found in the same pass; the expression
after a tag is read from the text and evaluated with and/or/with.

Null and empty texts have no words and score 0.  Texts are taken whole; rows
repeat as given.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from aletheia.llm.common import id_text, tidy

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of the method's own labels; of phrases that start together the longest counts.
NOTICE_PHRASES = {
    "licensed under cc by": "cc-by", "licensed under cc by sa": "cc-by-sa", "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by nc": "cc-by-nc", "licensed under cc by nc sa": "cc-by-nc-sa", "licensed under cc by nc nd": "cc-by-nc-nd",
    "licensed under cc0": "cc0", "creative commons zero": "cc0",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd", "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit", "apache license version 2": "apache",
    "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "eclipse public license": "epl", "isc license": "isc", "boost software license": "bsl", "business source license": "busl",
    "common development and distribution license": "cddl", "zlib license": "zlib", "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Label -> whole identifiers (family and version, lower case) and what the licence asks for.
LICENSES = {
    "mit": (r"mit(-0|-cmu|-modern-variant)?", "notice"),
    "apache": (r"apache(-[12](\.[01])?)?", "notice"),
    "bsd": (r"0bsd|bsd(-[1-4]-clause(-[a-z0-9-]+)?|-source-code)?", "notice"),
    "isc": (r"isc", "notice"),
    "bsl": (r"bsl-1\.0", "notice"),
    "zlib": (r"zlib(-acknowledgement)?", "notice"),
    "unlicense": (r"unlicense", "nothing"),
    "cc0": (r"cc0(-1\.0)?", "nothing"),
    "cc-by": (r"cc-by(-[1-4]\.[05](-[a-z]+)?)?", "notice"),
    "cc-by-sa": (r"cc-by-sa(-[1-4]\.[015](-[a-z]+)?)?", "share-alike"),
    "cc-by-nd": (r"cc-by-nd(-[1-4]\.[05](-[a-z]+)?)?", "no derivatives"),
    "cc-by-nc": (r"cc-by-nc(-[1-4]\.[05](-[a-z]+)?)?", "no commerce"),
    "cc-by-nc-sa": (r"cc-by-nc-sa(-[1-4]\.[05](-[a-z]+)?)?", "no commerce, share-alike"),
    "cc-by-nc-nd": (r"cc-by-nc-nd(-[1-4]\.[05](-[a-z]+)?)?", "no commerce, no derivatives"),
    "gpl": (r"gpl(-[123](\.0)?(\+|-only|-or-later)?(-with-[a-z0-9.-]+)?)?", "share-alike"),
    "lgpl": (r"lgpl(-(2|2\.0|2\.1|3|3\.0)(\+|-only|-or-later)?)?", "share-alike"),
    "agpl": (r"agpl(-[13](\.0)?(\+|-only|-or-later)?)?", "share-alike"),
    "mpl": (r"mpl(-(1\.0|1\.1|2\.0|2)(-no-copyleft-exception)?)?", "share-alike by file"),
    "epl": (r"epl(-[12]\.0)?", "share-alike by file"),
    "cddl": (r"cddl(-1\.[01])?", "share-alike by file"),
    "busl": (r"busl-1\.1|bsl-1\.1", "no production use"),
}
#: Label of an identifier that no rule knows.
UNKNOWN = "unknown"
#: Labels whose terms allow reuse with notice only.
PERMISSIVE = frozenset(label for label, (_, terms) in LICENSES.items() if terms in ("notice", "nothing"))

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in _LOWER
)
_TAG_RE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I | re.A)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_PRIORITY = {"or": 1, "and": 2, "with": 3}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


_IDS = {label: re.compile(rule) for label, (rule, _) in LICENSES.items()}


def label_of(identifier: str) -> str:
    """Label of a whole identifier; ``UNKNOWN`` if no rule matches all of it."""
    x = identifier.lower().rstrip(".:")
    return next((label for label, rule in _IDS.items() if rule.fullmatch(x)), UNKNOWN)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: licence expression to postfix order; None if malformed.
    Reading stops where a well-formed expression cannot go on (plain prose)."""
    out, ops, want = [], [], True
    depth = 0
    for tok in _TOKEN.findall(expression):
        low = tok.lower()
        if want:
            if tok == "(":
                ops.append(tok)
                depth += 1
            elif tok == ")" or low in _PRIORITY:
                return None
            else:
                out.append(tok)
                want = False
        elif tok == ")":
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif low in _PRIORITY:
            while ops and ops[-1] != "(" and _PRIORITY[ops[-1]] >= _PRIORITY[low]:
                out.append(ops.pop())
            ops.append(low)
            want = True
        else:
            break
    if want or depth:
        return None
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """``(labels, permissive)``: *and* needs both sides permissive, *or* one,
    *with* keeps its licence's answer (an exception only adds rights)."""
    stack: list[tuple[set[str], bool]] = []
    order = postfix(expression)
    if order is None:
        return None
    for tok in order:
        if tok in _PRIORITY:
            right, left = stack.pop(), stack.pop()
            if tok == "with":
                stack.append(left)
            else:
                ok = (left[1] and right[1]) if tok == "and" else (left[1] or right[1])
                stack.append((left[0] | right[0], ok))
        else:
            lab = label_of(tok)
            stack.append(({lab}, lab in PERMISSIVE))
    return stack[0]


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str) -> tuple:
    words = text.encode().translate(_WORDS).split()
    line = " " + b" ".join(words).decode("latin-1") + " "  # byte for byte
    base, notices, tag, at, seen = [], {}, False, 0, 0
    for end, phrase in _automaton().iter(line):
        start = end - len(phrase)  # of the phrase's first letter
        if phrase in BASE_PHRASES:
            seen += line.count(" ", at, start)
            at = start
            base.append((seen - 1, BASE_PHRASES[phrase]))
        if phrase in NOTICE_PHRASES:
            notices[start] = phrase  # longer ones of the same start end later
        tag |= phrase == TAG
    labels = {NOTICE_PHRASES[phrase] for phrase in notices.values()}
    found = [x for x in map(evaluate, _TAG_RE.findall(text)) if x] if tag else []
    for labs, _ in found:
        labels |= labs
    mine = {lab for _, lab in base}
    every = labels | mine
    score = 0.0 if not every else max(0.95 if any(x[0] for x in found) else 0.0, 1 - 0.5 ** (len(base) + len(labels - mine) + 1))
    ok = all(p for _, p in found) if found else bool(every) and every <= PERMISSIVE
    where = [w for w, _ in base]
    return (len(words), len(base), min(where, default=None), max(where, default=None), ",".join(sorted(mine)), ",".join(sorted(every)), score, ok)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document; see ``SCHEMA``."""

    def scan(batches):
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = list(zip(*map(scan_text, part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return id_text(docs).mapInArrow(tidy(scan), SCHEMA)
