"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus-signs, digits, schemes and the words that introduce an identifier.
From each anchor a small deterministic parser walks left and right over the characters its kind allows, checks the
result (parts up to 255, Luhn, ISO 13616 remainder, number of digits) and reports a span in code points. Text without
an anchor is never looked at twice.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.text import column, map_batches, two_columns

#: The base kinds in their listed order, then those that the cues add.
KINDS = ["email", "ip", "card", "phone", "url", "account", "secret"]
BASE = KINDS[:4]
ORDER = {k: i for i, k in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIAL = DIGITS | frozenset(" ().-")
SCHEME = ALNUM | frozenset("+.-")

#: Words that announce an account number or a secret; each is looked for in lower, title and upper case.
ACCOUNT_CUES = ["iban", "account", "acct", "passport", "ssn", "tax id"]
SECRET_CUES = ["password", "passwd", "api_key", "apikey", "secret", "token", "access_key"]

URL_END = re.compile(r"[^\s<>\"'`{}|\\^]*")
ACCOUNT = re.compile(r"(?: (?:no|number|nr)\.?)?[ :#=]{1,3}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})")
SECRET = re.compile(r"[\"']? ?[=:] ?[\"']?([^\s\"',;]{6,})")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

SPANS = "array<struct<kind:string,start:int,end:int>>"


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("url", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper()):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, allowed: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_start(text: str, at: int, allowed: frozenset[str], floor: int) -> int:
    """Start of the run of allowed characters that ends before ``at``, not before ``floor``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign ``at``: a local part, a label, and one or more dotted labels."""
    start, end = run_start(text, at, LOCAL, floor), run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dotted = end
    while dotted < len(text) and text[dotted] == "." and (after := run_end(text, dotted + 1, LABEL)) > dotted + 1:
        dotted = after
    return (start, dotted) if dotted > end else None


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """The number behind the plus-sign ``at``; it ends with the last digit of the run."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_end(text, at + 2, DIAL)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def dotted_numbers(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The numbers of a run such as 10.0.0.1 and where the run ends."""
    parts = []
    while True:
        end = run_end(text, at, DIGITS)
        parts.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return parts, end


def spaced_digits(text: str, at: int) -> int:
    """End of the run of digits with single blanks or hyphens between them."""
    n = len(text)
    while True:
        at = run_end(text, at, DIGITS)
        if at + 1 < n and text[at] in " -" and text[at + 1] in DIGITS:
            at += 1
        else:
            return at


def small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 4 and int(number or 0) <= 255


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def account_ok(value: str) -> bool:
    """An IBAN must leave 1 on division by 97; any other identifier has six digits or more."""
    packed = value.replace(" ", "").replace("-", "")
    if IBAN.fullmatch(packed):
        return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
    return sum(c in DIGITS for c in packed) >= 6


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then by kind; spans of one kind don't overlap."""
    spans = []
    done = dict.fromkeys([*KINDS, "digits", "dots"], 0)

    def keep(kind: str, start: int, end: int) -> None:
        spans.append((start, ORDER[kind], end))
        done[kind] = end

    for last, (kind, length) in anchors().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= done["digits"]:
                done["digits"] = end = spaced_digits(text, at)
                number = digits_of(text[at:end])
                if 14 <= len(number) <= 19 and luhn(number):
                    keep("card", at, end)
            if at >= done["dots"]:
                parts, done["dots"] = dotted_numbers(text, at)
                for four in zip(parts[::4], parts[1::4], parts[2::4], parts[3::4]):
                    if all(small(text[a:b]) for a, b in four):
                        keep("ip", four[0][0], four[3][1])
        elif kind == "email":
            if found := email_at(text, at, done["email"]):
                keep("email", *found)
        elif kind == "phone":
            if at >= done["phone"] and (found := phone_at(text, at)):
                done["phone"] = found[1]
                if 10 <= len(digits_of(text[found[0] : found[1]])) <= 15:
                    keep("phone", *found)
        elif kind == "url":
            start = run_start(text, at, SCHEME, done["url"])
            if at < done["url"] or start == at or not text[start].isalpha():
                continue  # inside a URL, or no scheme: what follows isn't read again
            end = URL_END.match(text, at + 3).end()
            while end > at + 3 and text[end - 1] in ".,;:!?)]":
                end -= 1
            if end > at + 3:
                keep("url", start, end)
        elif at >= done[kind] and (at == 0 or text[at - 1] not in ALNUM):
            found = (ACCOUNT if kind == "account" else SECRET).match(text, last + 1)
            if found and (kind == "secret" or account_ok(found[1])):
                keep(kind, found.start(1), found.end(1))
    return [(KINDS[k], start, end) for start, k, end in sorted(spans)]


def as_strings(array: pa.Array) -> list[str]:
    return [t or "" for t in array.to_pylist()]


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, end exclusive), one row for each input row.

    A null or empty text has no spans; repeated rows get equal answers; a null id stays null. The time for a text is in
    proportion to its length. An empty table gives an empty result.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in as_strings(b.column(1))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_batches(two_columns(df, id_col, text_col), batch, f"doc_id long, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by ``[kind]``; where spans overlap, the earlier and then the longer one counts."""
    names = df.columns

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
            if start < at:  # the rest of an overlapping span is personal data too
                at = max(at, end)
                continue
            out += [text[at:start], f"[{kind}]"]
            at = end
        return "".join([*out, text[at:]])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index(text_col)
        columns = list(b.columns)
        columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return map_batches(df, batch, df.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one string."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select(column("doc_id"), *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
