"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, plus signs, digits and
identifier cues. From each anchor a deterministic local parser expands to the
boundaries and validates: e-mail domains, address parts, Luhn and length checks,
IBAN remainders, the value behind an account or secret cue, user names in URLs.

The four base kinds (email, ip, card, phone) give exactly the leftmost non-overlapping
matches of their patterns; a match that fails its check is dropped and not retried.

Defined results: null and empty texts have no span; offsets are code points, end
exclusive; repeated rows are judged alike; an empty table gives an empty
result; other columns pass through (the added names must be free). Work is linear in
the text, also for very long runs of digits or name characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import flat
from creditspark.llm.registry import query, table

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "account", "secret", "user")
KINDS = BASE + MORE
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[ :=#]{0,4}([A-Z]{2}[0-9]{2}(?> ?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|id))?[ :=#]{1,4}([A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])", re.I)
SECRET = re.compile(r"[ ]?[:=][ ]?([\"']?)([A-Za-z0-9_/+.-]{16,}+)")
USER = re.compile(r"([A-Za-z0-9._~%!$&*+,;=-]++(?::[^\s@/]*+)?)@(?=[A-Za-z0-9])")
#: Cues in lower case and their kind; a cue must not continue a word.
CUES = {"iban": "iban", "account": "account", "acct": "account", "passport": "account", "konto": "account", "compte": "account",
        "cuenta": "account", "token": "secret", "secret": "secret", "password": "secret", "api_key": "secret", "apikey": "secret", "://": "user"}


@lru_cache(maxsize=1)
def _automaton():
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("d", 1))
    for mark in "@+":
        a.add_word(mark, (mark, 1))
    for cue, kind in CUES.items():
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


_FOLD = {i: i + 32 for i in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind as listed, then start."""
    folded = text.lower()
    if len(folded) != len(text):  # a few characters grow when lowered
        folded = text.translate(_FOLD)
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended
    no_ip = 0  # digits before this place begin no address
    for last, (what, size) in _automaton().iter(folded):
        at = last - size + 1
        if what == "d":
            if at >= done["ip"] and at >= no_ip:
                if m := IP.match(text, at):
                    done["ip"] = m.end()
                    if all(len(z := x.lstrip("0")) <= 3 and int(z or 0) <= 255 for x in m.groups()):
                        found["ip"].append(m.span())
                else:
                    no_ip = DIGITS.match(text, at).end()
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                if m.end() - at <= 2 * 19 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif what == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif at >= done[what] and (what == "user" or at == 0 or not folded[at - 1].isalnum()):
            _cued(text, what, last + 1, found, done)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def _cued(text: str, kind: str, at: int, found: dict, done: dict) -> None:
    """The value behind a cue that ends at ``at``."""
    if kind == "iban" and (m := IBAN.match(text, at)) and iban_valid(m[1]):
        span = m.span(1)
    elif kind == "account" and (m := ACCOUNT.match(text, at)):
        span = m.span(1)
    elif kind == "secret" and (m := SECRET.match(text, at)) and any(c.isdigit() for c in m[2]):
        span = m.span(2)
    elif kind == "user" and (m := USER.match(text, at)):
        span = m.span(1)
    else:
        return
    done[kind] = span[1]
    found[kind].append(span)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind in capitals."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_personal_data(df: DataFrame, text: str = "text", redacted: str | None = None) -> DataFrame:
    """Add ``pii_spans`` (array of kind, start, end) to each row; ``redacted`` names an optional column with the cleaned text.

    A null text has a null cleaned text.
    """
    added = "pii_spans array<struct<kind:string,start:long,end:long>>" + (f", `{redacted}` string" if redacted else "")
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(added).fields)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = flat.pylist(batch, text)
            spans = [find_spans(t) if t else [] for t in texts]
            more = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], span_type)]
            if redacted:
                more.append(pa.array([redact(t, x) if x else t for t, x in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(batch.columns + more, names=schema.names)

    return df.mapInArrow(run, schema)


@query("op7_anchor_personal_data")
def op7_anchor_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; spans come from the operator, the digest is made from its column."""
    marked = find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return marked.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
