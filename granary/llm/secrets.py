"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions at the hits, embedded checksum validation.

One automaton of lower-cased keywords passes over each whole text. An expression of a kind is tried only at the place
where one of its keywords was found, never searched for. Long runs of hex digits have no keyword; their anchors are
bytes sampled at a fixed step, enough of which must be hex digits in a row. Kinds whose tokens carry a checksum are
reported only if it is right.

Kinds, in the order in which equal starts are listed:

* assign  a keyword, an assignment sign and a value of 8 or more characters
* access  ``AKIA`` and capitals or digits, 16 or more in all
* hex     32 or more of 0-9 and a-f
* github  ``gh[opsur]_`` and 36 characters, of which the last six are the CRC-32 of the 30 before them in base 62
* npm     ``npm_`` and the same
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import text_chunks

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]

# Keywords and formats of secrets.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "gho_": "github",
    "ghp_": "github",
    "ghr_": "github",
    "ghs_": "github",
    "ghu_": "github",
    "npm_": "npm",
}
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[opsur]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: A run of LEAST_HEX bytes holds at least LEAST_HEX // STEP bytes at multiples of STEP.
STEP = 4
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


def checksum_ok(token: bytes) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the 30 before them."""
    body, want = token[-36:-6], token[-6:]
    left, digits = zlib.crc32(body), b""
    for _ in range(6):
        left, d = divmod(left, 62)
        digits = DIGITS[d : d + 1] + digits
    return digits == want


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        auto.add_word(word, (len(word), kind))
    auto.make_automaton()
    return auto


def _accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= LEAST_VALUE
    if kind == "access":
        return len(match[0]) >= LEAST_ACCESS
    return checksum_ok(match[0])


def _near_keywords(raw: bytes, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes. Within a kind leftmost matches come first and a match uses its characters up."""
    hits = [(end - size + 1, kind) for end, (size, kind) in auto.iter(raw.lower().decode("latin-1"))]
    found = []
    if hits:
        done = dict.fromkeys(KINDS, 0)
        for start, kind in sorted(hits):
            if start >= done[kind] and (match := PATTERNS[kind].match(raw, start)):
                done[kind] = match.end()
                if _accepted(kind, match):
                    found.append((kind, start, match.end()))
    return found


def _hex_runs(data: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of LEAST_HEX or more hex digits."""
    anchors = _HEX[data[::STEP]]
    need = LEAST_HEX // STEP
    if len(anchors) < need:
        return []
    total = np.concatenate(([0], np.cumsum(anchors)))
    if not (total[need:] - total[:-need] == need).any():
        return []
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _HEX[data]
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = borders[::2], borders[1::2]
    long_enough = ends - starts >= LEAST_HEX
    return list(zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True))


def _code_points(raw: bytes) -> np.ndarray:
    """For each byte, and the end, how many code points begin before it."""
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))


def _text_spans(raw: bytes, runs: list[tuple[str, int, int]], auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of one text with these runs of hex digits."""
    spans = _near_keywords(raw, auto) + runs
    if spans and not raw.isascii():
        place = _code_points(raw)
        spans = [(k, int(place[a]), int(place[b])) for k, a, b in spans]
    return spans


def _joined(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind. base_sha256 digests those of the
    kinds assign, access and hex. Null texts are empty and have no spans; repeated rows are scanned each; very long texts
    are scanned whole in linear time; an empty table gives an empty result; other columns are ignored.
    """

    def scan(batches):
        auto = _automaton()
        for batch in batches:
            counts = {k: np.zeros(batch.num_rows, np.int64) for k in BASE}
            digests, all_spans = [], []
            nothing = hashlib.sha256(b"").hexdigest()
            for first, _, data, offsets in text_chunks(batch):
                runs = _hex_runs(data)
                by_row: dict[int, list[tuple[str, int, int]]] = {}
                for start, end in runs:  # a run may reach over the border of two texts
                    row = int(np.searchsorted(offsets, start, "right")) - 1
                    while start < end:
                        stop = min(end, int(offsets[row + 1]))
                        if stop - start >= LEAST_HEX:
                            by_row.setdefault(row, []).append(("hex", start - int(offsets[row]), stop - int(offsets[row])))
                        start, row = stop, row + 1
                text = data.tobytes()
                for row in range(len(offsets) - 1):
                    raw = text[offsets[row] : offsets[row + 1]]
                    spans = _text_spans(raw, by_row.get(row, []), auto)
                    if spans:
                        base = [s for s in spans if s[0] in BASE]
                        for kind, _, _ in base:
                            counts[kind][first + row] += 1
                        digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                        all_spans.append(_joined(spans))
                    else:
                        digests.append(nothing)
                        all_spans.append("")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    **{f"n_{k}": pa.array(counts[k]) for k in BASE},
                    "base_sha256": pa.array(digests, pa.string()),
                    "spans": pa.array(all_spans, pa.string()),
                }
            )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each span in text replaced by a mark; overlapping spans become one. Other columns stay."""
    names = docs.columns

    def redact(batches):
        auto = _automaton()
        for batch in batches:
            at = names.index("text")
            out = []
            for value in batch.column(at).to_pylist():
                raw = (value or "").encode()
                hexes = [("hex", a, b) for a, b in _hex_runs(np.frombuffer(raw, np.uint8))]
                spans = sorted((a, b) for _, a, b in _near_keywords(raw, auto) + hexes)
                done, parts = 0, []
                for a, b in spans:
                    if a >= done:
                        parts += [raw[done:a], mark.encode()]
                    done = max(done, b)
                out.append(None if value is None else b"".join([*parts, raw[done:]]).decode())
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(redact, docs.schema)
