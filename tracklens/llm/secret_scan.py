"""Secrets in texts: base patterns, and multipart credentials linked within scopes.

Base spans: assignments of secrets, access identifiers and long hex strings.
A credential is often spread over parts that alone prove little: an account
or client identifier, a random-looking string, a service address. Such weak
parts are reported only where they complement each other. The scope of an
identifier is its paragraph (no blank line inside), the innermost block in
braces around it and the run of setting lines (``name: value``) it is in; all
are taken whole, whatever their length. An interval join over the sorted
positions of the text brings each identifier together with the secrets and
endpoints in its scope:

* ``key``: a random-looking string near an access identifier, or near an
  account identifier with an endpoint in the same scope;
* ``account``: an account identifier near a secret (a base span or ``key``)
  with an endpoint in the same scope;
* ``endpoint``: the address in a scope that holds identifier and secret.

Defined results: NULL and empty texts have no spans; overlapping base spans
of different kinds are all reported, weak parts inside a base span are not;
repeated rows give repeated results; any length of text is scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 characters and more among [0-9a-f]+
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "account", "key", "endpoint")
RANK = {k: i for i, k in enumerate(KINDS)}

# Weak parts.
ACCOUNT = re.compile(
    r"(?<![A-Za-z0-9])(?:client_?id|account_?id|access_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.-]{3,})",
    re.IGNORECASE | re.ASCII,
)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftp)://[^\s\"'<>]+", re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*\n")
BRACE = re.compile(r"[{}]")
#: consecutive lines of settings, lines of one word (parts of a long value) among them
SETTINGS = re.compile(r"(?:^[ \t]*+(?:(?:[-*][ \t]+|export[ \t]+)?[\"']?[\w.-]++[\"']?[ \t]*+[:=][^\n]*+|[^\s]++[ \t\r]*+)(?:\n|\Z))++", re.M)
MIN_BITS = 3.0  # entropy per character of a random-looking string
MASK = "[secret]"
SLICE = 512

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], RANK[s[0]]))


def looks_random(s: str) -> bool:
    """Mixed letters and digits with much entropy."""
    if not (re.search(r"\d", s) and re.search(r"[A-Za-z]", s)):
        return False
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= MIN_BITS


def blocks_of(text: str, breaks: list[int]) -> list[tuple[int, int]]:
    """Blocks in braces, the inner ones first; one never closed ends with its paragraph."""
    out, opened = [], []
    for m in BRACE.finditer(text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            out.append((opened.pop(), m.end()))
    return out + [(a, breaks[bisect_right(breaks, a)]) for a in reversed(opened)]


def innermost(blocks: list[tuple[int, int]], at: list[int]) -> dict[int, tuple[int, int]]:
    """The innermost of the nested blocks around each of the sorted positions."""
    todo, out, held = sorted(blocks, key=lambda b: (b[0], -b[1])), {}, []
    i = 0
    for p in at:
        while i < len(todo) and todo[i][0] <= p:
            while held and held[-1][1] <= todo[i][0]:
                held.pop()
            held.append(todo[i])
            i += 1
        while held and held[-1][1] <= p:
            held.pop()
        if held:
            out[p] = held[-1]
    return out


def linked_parts(text: str, base: list[Span]) -> list[Span]:
    """Weak parts whose complements lie in the same scope."""
    strong = [s for s in base if s[0] == "access"]
    weak = [("account", m.start(), m.end()) for m in ACCOUNT.finditer(text)]
    if not strong and not weak:
        return []
    taken = sorted((s, e) for _, s, e in base)
    ends = [e for _, e in taken]

    def free(span: Span) -> bool:
        i = bisect_right(ends, span[1])
        return i == len(taken) or taken[i][0] >= span[2]

    endpoints = [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    inside = lambda s, spans: any(a <= s[1] < b for _, a, b in spans)
    point_starts = [e[1] for e in endpoints]
    randoms = []
    for m in RANDOM.finditer(text):
        s = ("key", m.start(), m.end())
        if free(s) and looks_random(m[0]):
            i = bisect_right(point_starts, s[1])
            if not inside(s, endpoints[max(0, i - 1) : i]):
                randoms.append(s)
    secrets = [s for s in base if s[0] != "access"]
    breaks = [0, *(m.end() for m in BLANK.finditer(text)), len(text) + 1]

    columns = {k: (v, [s[1] for s in v]) for k, v in (("key", randoms), ("secret", secrets), ("endpoint", endpoints))}
    identifiers = sorted(strong + weak, key=lambda s: s[1])
    nested = innermost(blocks_of(text, breaks), [s[1] for s in identifiers])
    settings = [m.span() for m in SETTINGS.finditer(text)]
    runs = innermost(settings, [s[1] for s in identifiers])

    def scope(kind: str, span: Span, para: tuple[int, int]) -> list[tuple[int, int]]:
        """Slices of the parts of a kind, by number."""
        starts = columns[kind][1]
        areas = [b for b in (para, nested.get(span[1]), runs.get(span[1])) if b]
        return [(bisect_left(starts, a), bisect_left(starts, b)) for a, b in areas]

    out: set[Span] = set()
    marked: dict[str, set[tuple[int, int]]] = {"key": set(), "endpoint": set()}  # slices, so that many identifiers may share them
    for span in identifiers:
        p = bisect_right(breaks, span[1])
        para = breaks[p - 1], breaks[p]
        keys, known, points = ([c for c in scope(k, span, para) if c[0] < c[1]] for k in ("key", "secret", "endpoint"))
        starts = columns["secret"][1]
        same = range(bisect_left(starts, span[1]), bisect_right(starts, span[1]))
        own = [i for i in same if secrets[i][1:] == span[1:]]
        secret = bool(keys) or any(b - a > sum(a <= i < b for i in own) for a, b in known)
        if span[0] == "access":
            marked["key"].update(keys)
            if secret:
                marked["endpoint"].update(points)
        elif points and secret and free(span):
            out.add(span)
            marked["key"].update(keys)
            marked["endpoint"].update(points)
    for k, slices in marked.items():
        done = 0
        for a, b in sorted(slices):
            out.update(columns[k][0][max(a, done) : b])
            done = max(done, b)
    return list(out)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    more = [s for s in linked_parts(text, base) if s not in base]
    return base, sorted(base + more, key=lambda s: (s[1], RANK[s[0]]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with secrets replaced: of an assignment its value, addresses stay."""
    cuts = []
    for kind, a, b in spans:
        if kind == "assign":
            a = ASSIGN.match(text, a).start(2)
        if kind != "endpoint":
            cuts.append((a, b))
    out, at = [], 0
    for a, b in sorted(cuts):
        if b > at:
            if a >= at:
                out += [text[at:a], MASK]
            at = b
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs(doc_id, text)``; no shuffle."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = []
                for text in part.column(1).to_pylist():
                    base, spans = scan(text or "")
                    n = Counter(k for k, _, _ in base)
                    sha = hashlib.sha256(written(base).encode()).hexdigest()
                    made.append((n["assign"], n["access"], n["hex"], sha, written(spans)))
                cols = zip(*made, strict=True) if made else [()] * 5
                types = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with all secrets found in ``text`` masked, and ``n_chars`` (if there) counted anew where they were."""
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(text_at).to_pylist()
                fresh = [t if not t or not (s := scan(t)[1]) else masked(t, s) for t in texts]
                cols = list(part.columns)
                cols[text_at] = pa.array(fresh, cols[text_at].type)
                if chars_at is not None:
                    counts = cols[chars_at].to_pylist()
                    counts = [c if new is old else len(new) for c, old, new in zip(counts, texts, fresh, strict=True)]
                    cols[chars_at] = pa.array(counts, cols[chars_at].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
