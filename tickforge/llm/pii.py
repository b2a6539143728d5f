"""Personal data: candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees score them by the format of the
span and by its context; a threshold per kind, set on calibrated held-out scores, selects what is
redacted.  The four base kinds (email, ip, card, phone) are fixed by pattern and always stay; the
trees add secret, phone_local, iban and ssn.  A proposal that overlaps a base span or a better
proposal is dropped.

The trees are fitted on the driver on TRAIN_ROWS generated candidates (a documented bound) in
about a second, with a fixed seed, so every run has the same model.

Defined cases
* null text counts as empty: no spans.  Whole texts are read, in time in proportion to their length whatever they hold (runs of
  a megabyte of digits, dots or letters are one span or none); a text without digits, `@`, `=` or `:` can have no span and is skipped.
* Repeated rows and ties: each row is worked on by itself; among proposals with equal scores the
  earlier, then the longer, wins.
* An empty table gives an empty table.  Extra columns pass through; `spans` replaces its namesake.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import BoostedTrees, threshold
from .common import arrow_batches, table

TRAIN_ROWS = 6000
SEED = 7
#: Proposals of a text that are scored at once.
BLOCK = 4096
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "phone_local", "iban", "ssn")
KINDS = BASE + ADDED

_ANY = re.compile(r"[0-9@=:]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Starts at the first digit of a run alone: what fails there fails at the run's other digits too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"[A-Za-z0-9+/_~.-]{10,}")
_ASSIGNED = re.compile(r"(?:[=:]|\bis\b)\s{0,3}[\"']?([^\s\"',;<>]{6,})")
_DIALLED = re.compile(r"[(]?[0-9]{2,5}[)]?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9])")
GENERATORS = (("secret", _TOKEN, 0), ("secret", _ASSIGNED, 1), ("phone_local", _DIALLED, 0), ("iban", _IBAN, 0), ("ssn", _SSN, 0))

#: Words whose presence to the left of a span is a feature, by what they announce.
CUES = (
    ("secret", ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key", "access key", "private key", "bearer", "credential")),
    ("phone", ("phone", "tel", "call", "mobile", "fax", "cell", "dial", "whatsapp")),
    ("bank", ("iban", "account", "bank", "transfer", "konto")),
    ("social", ("ssn", "social security", "social-security")),
    ("other", ("commit", "version", "order", "invoice", "isbn", "uuid", "sha1", "sha256", "md5", "checksum", "page", "date", "http", "www", "file", "release", "part")),
)
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|AIza|eyJ)")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, leftmost and greedy, in time linear in the text: a match runs from
    the start of the characters that touch an @ (or the end of the match before) over its domain."""
    out, at, end = [], text.find("@"), 0
    floor = 0
    while at >= 0:
        start = at
        while start > max(end, floor) and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        floor = at + 1
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return found


def proposals(text: str) -> list[tuple[int, int, str]]:
    """What the generators propose, overlapping and mostly wrong."""
    out = set()
    for kind, pattern, group in GENERATORS:
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if kind == "secret":
                b = a + len(text[a:b].rstrip(".,"))
                if not group and not _DIGIT.search(text, a, b):
                    continue
                if group and not any(x in text[max(0, m.start() - 24) : m.start()].lower() for x in CUES[0][1]):
                    continue
            out.add((a, b, kind))
    return sorted(out)


_CLASS = bytes(48 if 48 <= b <= 57 else 49 if 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 50 for b in range(256))
_RUNS = re.compile(rb"0+|1+|2+")
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: Letters and digits of the longest and the shortest IBAN.
_IBAN_SIZES = range(15, 35)


def features(text: str, a: int, b: int, kind: str) -> list[float]:
    span, left, right = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 2]
    raw = span.encode("utf-8", "replace")
    n = max(len(raw), 1)
    of = lambda chars: n - len(raw.translate(None, chars))
    digits, upper, lower = of(_DIGITS), of(_UPPER), of(_LOWER)
    kinds = raw.translate(_CLASS)
    count = [raw.count(c) for c in set(raw)]
    groups = [len(x) for x in re.findall("[0-9]+", span)]
    mod97 = False
    if kind == "iban" and len(plain := re.sub("[^A-Z0-9]", "", span)) in _IBAN_SIZES:
        mod97 = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return [
        *(float(kind == k) for k in ADDED), n, digits / n, upper / n, lower / n,
        (len(_RUNS.findall(kinds)) - 1) / n, -sum(c / n * math.log2(c / n) for c in count),
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", span))), float(bool(_PREFIX.match(span))), float(left[-1:] in ('"', "'")),
        float(bool(re.search(r"(?:[=:]|\bis)\s*[\"']?$", left))), *(float(any(w in left for w in words)) for _, words in CUES),
        len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, digits, float(span[:1] == "("), float(mod97),
        float(bool(re.fullmatch("[0-9]{3}[)]?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}", span.lstrip("(")))), float(left[-1:].isalnum()), float(right[:1].isalnum()), kinds.count(b"2") / n,
    ]


_HEX = "0123456789abcdef"
_UPPER36 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_BASE62 = _UPPER36 + "abcdefghijklmnopqrstuvwxyz"
_ALPHABETS = (_HEX, _HEX.upper(), _UPPER36, _BASE62, _BASE62, _BASE62 + "+/", _BASE62 + "-_", _BASE62 + "!#$%&*?^~")


class Training:
    """Generated sentences with one true or false span each; the generators then propose, and a proposal
    is positive if it has the true kind and covers four fifths of the true span with at most two characters more.  A part of that kind is neither.

    Names, separators, quotes, alphabets and lengths are drawn independently, so that no single spelling is learned."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()) for _ in range(self.r.randint(1, 4)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def iban(self) -> str:
        head, body = self.r.choice(("DE", "FR", "ES", "GB", "NL", "IT")), self.digits(self.r.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + head + "00")) % 97
        s = f"{head}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if self.r.random() < 0.5 else s

    def named(self, names: tuple[str, ...]) -> str:
        """A setting's name and what stands between it and its value, in any of the usual spellings."""
        r = self.r
        name = r.choice(names)
        name = r.choice((name, name.upper(), name.title(), f"{self.word()}_{name}", f"{self.word()} {name}", f"{name.upper()}_{self.word().upper()}"))
        return name + r.choice((":", ": ", "=", " = ", " := ", " is ", "=", ": ")) + r.choice(("", "", '"', "'"))

    def value(self) -> str:
        r = self.r
        alphabet = r.choice(_ALPHABETS)
        return self.chars(alphabet, r.randint(8 if len(alphabet) > 60 else 16, 64))

    def positive(self) -> tuple[str, str, str]:
        """(kind, what stands before, the span)."""
        r = self.r
        kind = r.choice(("secret",) * 4 + ("phone_local", "phone_local", "iban", "ssn"))
        if kind == "iban":
            return kind, r.choice(("IBAN ", "account ", "", "bank transfer to ")), self.iban()
        if kind == "ssn":
            return kind, r.choice(("SSN ", "social security number ", "ssn: ")), f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"
        if kind == "phone_local":
            a, b, c = self.digits(3), self.digits(3), self.digits(4)
            return kind, r.choice(("call ", "tel. ", "phone: ", "", "", "fax ")), r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}"))
        if r.random() < 0.3:  # keys of a public format, known by their beginning
            head, alphabet, size = r.choice((("AKIA", _UPPER36, 16), ("ASIA", _UPPER36, 16), ("ghp_", _BASE62, 36), ("sk-", _BASE62, 40), ("xoxb-", _BASE62, 30), ("sk_live_", _BASE62, 24), ("AIza", _BASE62, 35)))
            return kind, r.choice(("", "", "key ", self.named(CUES[0][1]))), head + self.chars(alphabet, size)
        return kind, self.named(CUES[0][1]), self.value()

    def negative(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        return r.choice(
            (
                lambda: (r.choice(("commit ", "sha1 ", "checksum ", "")), self.chars(_HEX, r.choice((32, 40, 64)))),
                lambda: (self.named(("name", "id", "path", "title", "digest", "etag", "build", "version", "color", "size", "model")), self.value()),
                lambda: ("", self.chars(r.choice((_BASE62, _BASE62 + "+/")), r.randint(30, 400))),
                lambda: (self.named(CUES[0][1]), r.choice((self.word() + self.word(), "required", "undefined", "********", f"${{{self.word().upper()}}}", f"<{self.word()}>"))),
                lambda: ("", "".join(self.word().capitalize() for _ in range(3)) + d(r.randint(0, 2))),
                lambda: (r.choice(("version ", "release ", "")), f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 99)}"),
                lambda: (r.choice(("order ", "invoice ", "part ", "")), d(r.randint(5, 16))),
                lambda: (r.choice(("date ", "on ", "")), f"20{d(2)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
                lambda: ("", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}"),
                lambda: ("isbn ", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
                lambda: ("", f"{self.word()}{self.word()}{self.word()}{r.randint(0, 99)}"),
                lambda: (r.choice(("http://", "www.", "file ")), f"{self.word()}.{self.word()}/{self.word()}-{d(4)}-{self.word()}.html"),
                lambda: ("", f"{d(2)} {d(3)} {d(3)}"),
                lambda: ("uuid ", f"{self.chars('0123456789abcdef', 8)}-{self.chars('0123456789abcdef', 4)}-4{self.chars('0123456789abcdef', 3)}-a{self.chars('0123456789abcdef', 3)}-{self.chars('0123456789abcdef', 12)}"),
                lambda: ("", f"{r.choice('ABCDEF')}{r.choice('ABCDEF')}{d(2)} {self.chars('ABCDEF0123', 4)} {self.chars('ABCDEF0123', 4)} {self.chars('ABCDEF0123', 4)}"),
                lambda: ("part ", f"{d(3)}-{d(2)}-{d(4)}"),
                lambda: ("", f"{self.word()}-{self.word()}_{self.word()}.{self.word()}"),
                lambda: (r.choice(("the token ", "a password ", "secret: ")), f"{self.word()} {self.word()}"),
                lambda: ("score ", f"{d(2)}-{d(2)} {d(2)}-{d(3)}"),
            )
        )()

    def rows(self, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
        x, y, kinds = [], [], []
        while len(y) < n:
            good = self.r.random() < 0.5
            true_kind, before, span = self.positive() if good else ("", *self.negative())
            quote = '"' if before.endswith('"') else ""
            head = " ".join(self.word() for _ in range(self.r.randint(0, 8))) + self.r.choice((" ", " ", ". ", ", ", "\n")) + before
            text = head + span + quote + self.r.choice((" ", ". ", ", ", "\n", "")) + " ".join(self.word() for _ in range(self.r.randint(0, 6)))
            a, b = len(head), len(head) + len(span)
            for p in proposals(text):
                inside = p[0] >= a - 2 and p[1] <= b + 2 and p[1] - p[0] >= 0.8 * (b - a)
                if p[2] == true_kind and not inside and p[0] < b and p[1] > a:
                    continue
                x.append(features(text, *p))
                y.append(float(p[2] == true_kind and inside))
                kinds.append(p[2])
        return np.array(x), np.array(y), kinds


class Detector:
    def __init__(self, rows: int = TRAIN_ROWS, seed: int = SEED, precision: float = 0.98):
        x, y, kinds = Training(seed).rows(rows)
        cut = 2 * len(y) // 3
        self.trees = BoostedTrees().fit(x[:cut], y[:cut]).calibrate(x[cut:], y[cut:])
        p, kind = self.trees.probability(x[cut:]), np.array(kinds[cut:])
        self.least = {k: threshold(p[kind == k], y[cut:][kind == k], precision) for k in ADDED if (kind == k).any()}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans of a text as (start, end, kind), in code points, by start and then kind as listed."""
        if not _ANY.search(text):
            return []
        found, good = base_spans(text), []
        new = proposals(text)
        for at in range(0, len(new), BLOCK):
            part = new[at : at + BLOCK]
            p = self.trees.probability(np.array([features(text, *x) for x in part]))
            good += [(-q, a, a - b, (a, b, k)) for q, (a, b, k) in zip(p.tolist(), part, strict=True) if q >= self.least.get(k, 2)]
        starts, ends = disjoint([(a, b) for a, b, _ in found])
        for _, _, _, (a, b, k) in sorted(good):
            i = bisect_left(ends, a + 1)
            if i == len(starts) or b <= starts[i]:
                starts.insert(i, a)
                ends.insert(i, b)
                found.append((a, b, k))
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_PA = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _texts(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]


def find_pii(docs: DataFrame, text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """docs with spans: array of (kind, start, end) in code points, end exclusive."""
    arrow_batches(docs.sparkSession)
    docs = docs.drop("spans")
    model = docs.sparkSession.sparkContext.broadcast(detector or Detector())
    at, names = docs.columns.index(text_col), [*docs.columns, "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in model.value.spans(t)] for t in _texts(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _PA)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("spans", _SPANS)]))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans becomes the upper-case kind of its first, in brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """docs with the spans of its texts replaced by `[KIND]`; null texts stay null."""
    arrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(detector or Detector())
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if not ok else redacted(t, model.value.spans(t)) for t, ok in zip(_texts(b.column(at)), b.column(at).is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    d = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return d.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
