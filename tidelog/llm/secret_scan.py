"""Secret scans with multipart credential linking.

Strong patterns are reported as they stand. Weak candidates (identifiers, secrets and endpoints
that alone would be noise) are reported only where complementary parts stand in one scope: a
paragraph, and no further than REACH code points from each other. Each role's parts are sorted
by place, so the interval join of a text is a bisection for each candidate, not a product.

A text is scanned by one small function inside Spark's Arrow batches; rows never leave their
partition, so there is no shuffle and a text of any length costs its own length.

Defined results for unusual input: a null or empty text has no spans (the digest is that of the
empty string); repeated rows are scanned alike; an empty table gives an empty table; other
columns are not read. Spans are in code points, the end exclusive, ordered by start, then kind in
the order of KINDS, then end.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds, as listed, then those that linking adds.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
REACH = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: As the run must be this long, shorter runs need not be matched first.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK_ID = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,40}(?![A-Za-z0-9+/_=-])")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[^0-9]{0,39}[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?:https?|ftp|amqp|postgres(?:ql)?|mysql|redis|mongodb)://[^\s\"'<>]{4,}")
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the strong patterns, leftmost and non-overlapping in each kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates that a complementary part in their scope confirms.

    An identifier needs a secret, a secret an identifier, an endpoint both of them.
    """
    strong = {role: [(s, e) for s, k, e in base if k in kinds] for role, kinds in (("id", (1,)), ("secret", (0, 2)))}
    taken = sorted((s, e) for s, _, e in base)

    def free(pattern: re.Pattern, beside: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [m.span() for m in pattern.finditer(text) if not _meets(m.span(), beside)]

    weak_ids = free(_WEAK_ID, taken)
    ids = sorted(strong["id"] + weak_ids)
    if not ids:
        return []
    weak_secrets = [x for x in free(_WEAK_SECRET, sorted(taken + weak_ids)) if _mixed(text[x[0] : x[1]])]
    secrets = sorted(strong["secret"] + weak_secrets)
    if not secrets:
        return []
    near = lambda span, parts: _near(text, span, parts, reach)
    return sorted(
        [(s, 3, e) for s, e in weak_ids if near((s, e), secrets)]
        + [(s, 4, e) for s, e in weak_secrets if near((s, e), ids)]
        + [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text) if near(m.span(), ids) and near(m.span(), secrets)]
    )


def _mixed(token: str) -> bool:
    """Random-looking: upper and lower case and a digit, and no few characters repeated."""
    return any(c.isdigit() for c in token) and token.upper() != token and token.lower() != token and len(set(token)) >= 10


def _meets(span: tuple[int, int], parts: list[tuple[int, int]]) -> bool:
    """Whether the span overlaps one of the sorted parts, of which those of a kind are disjoint."""
    at = bisect_left(parts, (span[1],))
    return any(parts[i][1] > span[0] for i in range(max(0, at - 3), at))


def _near(text: str, span: tuple[int, int], parts: list[tuple[int, int]], reach: int) -> bool:
    at = bisect_left(parts, span)
    for s, e in parts[max(0, at - 2) : at + 2]:
        first, second = ((s, e), span) if s < span[0] else (span, (s, e))
        if (s, e) != span and second[0] - first[1] <= reach and text.find("\n\n", first[1], second[0]) < 0:
            return True
    return False


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, the base counts and digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for value in batch.column(1):
                content = value.as_py() or ""
                base = base_spans(content)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted(base + linked_spans(content, base, reach))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan(docs)
