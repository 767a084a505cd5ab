"""Personal data by anchor expansion.

One Aho-Corasick automaton walks the text once and reports anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a small deterministic parser expands to the left and right boundary of what
it may belong to and validates it. Every parser moves forward only, so the work is linear in the text.

Kinds, in the order of the output: email, ip, card, phone (the base kinds), then what the cues add:
``address`` (scheme://user:secret@host..., the whole address), ``account`` (an IBAN, or the digits after an
account cue) and ``secret`` (the value after password=, token= and the like). Offsets count code points, ends
are exclusive. Spans of one kind never overlap; spans of different kinds may.

Defined results: NULL or empty text has no span; repeated rows are searched one by one; an empty table gives an
empty table; other columns are not read by ``find`` and are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "secret")

SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "secret")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
NUMERIC = frozenset("0123456789 .()+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9 .()+-]*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]*")
USERINFO = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
ASSIGNED = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-./+]{8,})")
NUMBERED = re.compile(r"(?:\s{0,3}(?:no\.?|nr\.?|number|n°))?\s{0,3}[:#=]?\s{0,3}([0-9](?:[\x20-]?[0-9]){7,33})")
IBAN = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})")


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for c in "0123456789":
        words.add_word(c, ("digit", 1))
    words.add_word("@", ("at", 1))
    words.add_word("+", ("digit", 1))
    for scheme in SCHEMES:
        words.add_word(scheme, ("scheme", len(scheme)))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                words.add_word(form, (kind, len(form)))
    words.make_automaton()
    return words


_built: list[ahocorasick.Automaton] = []


def _anchors(text: str) -> Iterator[tuple[int, tuple[str, int]]]:
    if not _built:
        _built.append(_automaton())
    return _built[0].iter(text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(value: str) -> bool:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return int(number) % 97 == 1


def _numbers(text: str, start: int, end: int, found: dict[str, list[tuple[int, int]]]) -> None:
    """ip, card and phone inside a stretch of digits and separators; no match of theirs leaves it."""
    for chain in DOTTED.finditer(text, start, end):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                found["ip"].append((at, at + size))
            at += size + 1
    for m in CARD.finditer(text, start, end):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in PHONE.finditer(text, start, end):
        value = m.group().rstrip(" ().-")
        if len(value) >= 4 and 8 <= sum(c.isdigit() for c in value) <= 15:
            found["phone"].append((m.start(), m.start() + len(value)))


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    numbers_done = mail_done = address_done = secret_done = 0
    for end, (kind, size) in _anchors(text):
        if kind == "digit":
            if end < numbers_done:
                continue
            start = end
            while start > numbers_done and text[start - 1] in NUMERIC:
                start -= 1
            numbers_done = NUMBERS.match(text, end).end()
            _numbers(text, start, numbers_done, found)
        elif kind == "at":
            start = end
            while start > mail_done and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, end + 1) if start < end else None
            if domain:
                mail_done = domain.end()
                found["email"].append((start, mail_done))
        elif kind == "scheme":
            start = end + 1 - size
            rest = USERINFO.match(text, end + 1) if start >= address_done else None
            if rest:
                address_done = rest.end()
                found["address"].append((start, address_done))
        elif kind == "secret":
            value = ASSIGNED.match(text, end + 1) if end >= secret_done else None
            if value and any(c.isdigit() for c in value[1]):
                secret_done = value.end()
                found["secret"].append(value.span(1))
        elif not found["account"] or end >= found["account"][-1][1]:
            value = IBAN.match(text, end + 1)
            while value and not iban(value[1]):
                shorter = value.end(1) - 1
                value = IBAN.match(text, end + 1, shorter) if shorter - value.start(1) >= 15 else None
            value = value or NUMBERED.match(text, end + 1)
            if value:
                found["account"].append(value.span(1))
    return [(kind, s, e) for kind in KINDS for s, e in found[kind]]


def masked(text: str, marks: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind that starts first."""
    out, at = [], 0
    for kind, start, end in sorted(marks, key=lambda m: (m[1], -m[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``: array of (kind, start, end)."""
    kind = df.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"`{key}` {kind}, spans array<struct<kind: string, start: long, end: long>>")
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, inner)], names=[key, "spans"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def digest(df: DataFrame) -> DataFrame:
    """Counts per base kind, hash of the base spans, all spans as text, beside the other columns of ``find``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.size(F.filter("spans", _of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    rest = [c for c in df.columns if c != "spans"]
    return df.select(*rest, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of the text replaced by its kind; NULL stays NULL, other columns are kept."""
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for value in batch.column(at):
                value = value.as_py()
                marks = spans(value) if value else []
                new.append(masked(value, marks) if marks else value)
            yield batch.set_column(at, text, pa.array(new, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def brute_base_sha256(text: str) -> str:
    """Hash of the base spans found by plain searches over the whole text: what tests hold the parsers against."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in out).encode()).hexdigest()
